"""Benchmark decontamination with an FM-index per training shard.

The benchmark's words get numbers from 2 up; any other word is the separator 1, which no test
phrase holds, and 0 ends a shard. Each shard (a run of documents of about ``SHARD_WORDS``
words within a task) is numbered, its suffix array sorted by prefix doubling, the BWT stored
in a wavelet matrix and every ``SAMPLE``-th text position kept. All test phrases (the
distinct windows of all items) are searched backwards at once over rank queries; the rows
of each hit range walk the LF mapping to a sampled position, and the located spans merge
into the removal spans of each document.

Runs of benchmark words shorter than the shortest phrase cannot hold a phrase, so they
shrink to one separator before the index is built. The benchmark is sent out in blocks of at
most ``BLOCK_WORDS`` words (and one item more): a larger benchmark means more passes over a
shard, not a larger block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
SHARD_WORDS = 1 << 19
SAMPLE = 8
BLOCK_WORDS = 1 << 20

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of an int array whose last entry is its only minimum."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        sa = np.argsort(key, kind="stable")
        key = key[sa]
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        if rank[sa[-1]] == n - 1:
            return sa
        step *= 2


class FMIndex:
    """Backward search and location over one shard's numbers; the last is 0, the only one."""

    def __init__(self, t: np.ndarray, sigma: int) -> None:
        sa = suffix_array(t)
        self.n = len(t)
        self.first = np.r_[0, np.cumsum(np.bincount(t, minlength=sigma))]
        self.bwt = t[sa - 1]
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        cur = self.bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int64))
            self.zeros.append(int((bit == 0).sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.sampled = sa % SAMPLE == 0
        self.before = np.r_[0, np.cumsum(self.sampled)]
        self.at = sa[self.sampled]

    def extend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """First row of c's bucket plus the occurrences of c in the BWT's first i rows."""
        lo, hi = np.zeros_like(i), i
        for lv in range(self.bits):
            one = (c >> (self.bits - 1 - lv)) & 1 == 1
            a, b = self.ones[lv][lo], self.ones[lv][hi]
            lo = np.where(one, self.zeros[lv] + a, lo - a)
            hi = np.where(one, self.zeros[lv] + b, hi - b)
        return self.first[c] + hi - lo

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row range [lo, hi) of each phrase; empty where it does not occur."""
        longest = max(map(len, phrases))
        grid = np.full((len(phrases), longest), -1, dtype=np.int64)
        for k, p in enumerate(phrases):
            grid[k, longest - len(p) :] = p
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for col in range(longest - 1, -1, -1):
            live = np.flatnonzero((grid[:, col] >= 0) & (lo < hi))
            c = grid[live, col]
            lo[live], hi[live] = self.extend(c, lo[live]), self.extend(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by LF steps to a sampled one."""
        pos = np.empty(len(rows), dtype=np.int64)
        live, row, steps = np.arange(len(rows)), rows, 0
        while len(live):
            hit = self.sampled[row]
            pos[live[hit]] = self.at[self.before[row[hit]]] + steps
            live, row = live[~hit], row[~hit]
            row = self.extend(self.bwt[row], row)
            steps += 1
        return pos


class Phrases:
    """The distinct windows of a block of items, over numbered words."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        self.number: dict[bytes, int] = {}
        window: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 2) for w in words_of(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                window.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        self.windows = [np.array(w, dtype=np.int64) for w in window]
        self.items = [{x for x in s if x is not None} for s in window.values()]
        self.least = min(map(len, self.windows), default=0)

    def hits(self, docs: list[np.ndarray]) -> list[tuple[list[int], set[str]]]:
        """Of each document (its word numbers): [start, end, ...] of hit words, items found."""
        none: list[tuple[list[int], set[str]]] = [([], set()) for _ in docs]
        if not self.windows or not docs:
            return none
        starts = np.cumsum([1] + [len(d) + 1 for d in docs])
        flat = np.ones(starts[-1], dtype=np.int64)
        for s, d in zip(starts, docs, strict=False):
            flat[s : s + len(d)] = d
        edge = np.flatnonzero(np.diff(np.r_[False, flat > 1, False].astype(np.int8)))
        run, end = edge[::2], edge[1::2]
        run, end = run[end - run >= self.least], end[end - run >= self.least]
        if not len(run):
            return none
        size = end - run + 1  # with the separator behind it
        back = np.repeat(run - (np.cumsum(size) - size), size) + np.arange(size.sum())
        text = flat[np.minimum(back, len(flat) - 1)]
        text[np.cumsum(size) - 1] = 1
        index = FMIndex(np.r_[text, 0], len(self.number) + 2)
        lo, hi = index.search(self.windows)
        found = np.flatnonzero(lo < hi)
        n = (hi - lo)[found]
        which = np.repeat(found, n)
        at = back[index.locate(np.repeat(lo[found] - (np.cumsum(n) - n), n) + np.arange(n.sum()))]
        hit = np.zeros(len(flat) + 1, dtype=np.int64)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + np.array([len(w) for w in self.windows])[which], -1)
        edge = np.flatnonzero(np.diff(np.r_[False, np.cumsum(hit[:-1]) > 0, False].astype(np.int8)))
        doc = np.searchsorted(starts, edge[::2], side="right") - 1
        for d, a, b in zip(doc.tolist(), (edge[::2] - starts[doc]).tolist(), (edge[1::2] - starts[doc]).tolist(), strict=True):
            none[d][0].extend((a, b))
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, w in np.unique(np.stack([doc, which]), axis=1).T.tolist():
            none[d][1].update(self.items[w])
        return none


def blocks(benchmark: DataFrame) -> Iterator[Phrases]:
    """The items' windows, streamed to the driver in blocks of bounded size."""
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        block.append((item, text))
        size += len(words_of(text))
        if size >= BLOCK_WORDS:
            yield Phrases(block)
            block, size = [], 0
    yield Phrases(block)


def _scanner(phrases: Phrases, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds this block's findings to the last three columns: n_words, spans, items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = phrases.number
        for batch in batches:
            rows = batch.num_rows
            counts, spans, items = [], [], []
            docs: list[np.ndarray] = []
            total = 0
            for k, text in enumerate(batch.column(text_at)):
                words = words_of(text.as_py())
                docs.append(np.fromiter((number.get(w, 1) for w in words), dtype=np.int32, count=len(words)))
                counts.append(len(words))
                total += len(words)
                if total >= SHARD_WORDS or k == rows - 1:
                    for s, i in phrases.hits(docs):
                        spans.append(s)
                        items.append(i)
                    docs, total = [], 0
            had = [batch.column(batch.num_columns - 1 - k).to_pylist() for k in (1, 0)]
            spans = [merged(a or [], b) for a, b in zip(had[0], spans, strict=True)]
            items = [sorted({*(a or ()), *b}) for a, b in zip(had[1], items, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-3],
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.int64())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                batch.schema.names,
            )

    return scan


def merged(a: list[int], b: list[int]) -> list[int]:
    """Union of two sorted [start, end, ...] lists."""
    if not a or not b:
        return a or b
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` plus hit_words, hit_spans ([start, end, ...] in words) and hit_items.

    Narrow: no shuffle, whatever the skew; further benchmark blocks chain on. Null or
    wordless texts have no words and no hits. An item without words has no window; one
    with a null item_id hits words but is not listed. Repeated rows stay and are equal;
    an empty table gives no rows, an empty benchmark no hits.
    """
    added = ("hit_words", "hit_spans", "hit_items")
    out = docs.drop(*added).withColumns({"hit_words": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast("array<long>"), "hit_items": F.lit(None).cast("array<string>")})
    text_at = [c.lower() for c in out.columns].index("text")
    for phrases in blocks(benchmark):
        out = out.mapInArrow(_scanner(phrases, text_at), out.schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest per row of ``docs(doc_id, text)``; see :func:`spans` for the edge cases."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.get("hit_spans", i + 1) - F.get("hit_spans", i))
    return spans(own, benchmark).select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        F.when(F.size("hit_spans") > 0, n_hit).otherwise(0).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
