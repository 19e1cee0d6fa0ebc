"""Lempel-Ziv phrase fingerprints: how much of one text another would compress.

A text is parsed from left to right into dictionary phrases (LZ78: each is the longest one
known, and a letter more). The set of its phrases, by hash, is what a compressor has learnt from it; its
``SLOTS`` smallest hashes are the signature, and the share of common ones among the smallest of both texts
estimates the Jaccard similarity of the phrase sets (exact for texts of up to ``SLOTS`` phrases).

``neighbours`` compares each text with the next one by id and with its own edited text. Texts are
dealt once, to ranges of descending id. A range gets the first text of the range that follows
besides its own, so a task meets every pair that it has to compare, one text after the other, and
holds two at a time. The parse of an edited text starts from the dictionary that its unchanged part has left.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import checkpoint

SLOTS = 128
DIGITS = 10
#: Of an edited text, one in so many letters is other.
SHARE = 3
#: Text in a range, and ranges (those of more text than both allow grow).
RANGE_CHARS, LEAST_RANGES, MOST_RANGES = 1 << 22, 16, 20_000
BROADCAST_KEYS = 200_000
_LAST = -(1 << 63)
_U = np.uint64
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


#: A place in a dictionary of phrases: a node, and the letter of one of its leaves (None: the node itself).
Place = tuple[dict, "str | None"]


def grow(text: str, root: dict, place: Place, new: list[tuple[dict, str, bool | None]] | None = None) -> tuple[list[int], Place]:
    """Parses on from a place in the dictionary: where phrases end, and the place of what is left over.

    A node holds its longer phrases by their next letter; most have none and are ``False``. ``new`` gets what the dictionary gets, with what was there.
    """
    ends, letters = [], enumerate(text, 1)
    node, leaf = place
    if leaf is not None:
        for i, d in letters:
            if new is not None:
                new.append((node, leaf, False))
            node[leaf] = {d: False}
            ends.append(i)
            node, leaf = root, None
            break
    for i, c in letters:
        child = node.get(c)
        if child:
            node = child
        elif child is None:
            if new is not None:
                new.append((node, c, None))
            node[c] = False
            ends.append(i)
            node = root
        else:
            leaf = c
            for j, d in letters:
                if new is not None:
                    new.append((node, c, False))
                node[c] = {d: False}
                ends.append(j)
                node, leaf = root, None
                break
    return ends, (node, leaf)


class Hashes:
    """64-bit hashes of a text's phrases, all at once: polynomial ones from running sums, then mixed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def __call__(self, codes: np.ndarray, ends: list[int]) -> np.ndarray:
        """Of the phrases that end at ``ends``, the first of which begins at 0."""
        if not ends:
            return np.zeros(0, dtype=_U)
        n = ends[-1]
        if len(self.up) <= n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.cumprod(np.r_[_U(1), np.full(size, _U(b))], dtype=_U) for b in (_BASE, _UNBASE))
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((codes[:n] + _U(1)) * self.up[:n], out=sums[1:])
        at = np.array(ends)
        begin = np.r_[0, at[:-1]]
        h = (sums[at] - sums[begin]) * self.down[begin]
        for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> _U(s))) * _U(m)
        return (h ^ (h >> _U(31))) >> _U(64 - 4 * DIGITS)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The ``SLOTS`` smallest different hashes, in order."""
    least = np.unique(np.partition(hashes, SLOTS)[:SLOTS] if len(hashes) > SLOTS else hashes)
    return least if len(least) == SLOTS or len(hashes) <= SLOTS else np.unique(hashes)[:SLOTS]


def without_collector(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Dictionaries of phrases have no cycles, and searching them for some takes a third of the time."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return held


def printed(sign: np.ndarray) -> str:
    return sign.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i : i + DIGITS], 16) for i in range(0, len(fingerprint), DIGITS)], dtype=_U)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets; that of two empty ones is 1."""
    least, times = np.unique(np.concatenate([a, b]), return_counts=True)
    return float(np.mean(times[:SLOTS] == 2)) if len(least) else 1.0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)


class Parsed:
    """A text's signature, and its dictionary as it is before the last third."""

    def __init__(self, text: str, hashes: Hashes) -> None:
        self.text, self.hashes, self.codes, self.root = text, hashes, _codes(text), {}
        self.cut = len(text) - len(text) // SHARE
        self.ends, self.place = grow(text[: self.cut], self.root, (self.root, None))
        new: list[tuple[dict, str, bool | None]] = []
        tail, _ = grow(text[self.cut :], self.root, self.place, new)
        self._forget(new)
        self.whole = hashes(self.codes, self.ends + [self.cut + e for e in tail])
        self.sign = signature(self.whole)

    @staticmethod
    def _forget(new: list[tuple[dict, str, bool | None]]) -> None:
        for node, c, had in reversed(new):
            if had is None:
                del node[c]
            else:
                node[c] = had

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last third replaced by the beginning of another, and that text's signature."""
        tail = other[: len(self.text) // SHARE]
        new: list[tuple[dict, str, bool | None]] = []
        ends, _ = grow(tail, self.root, self.place, new)
        self._forget(new)
        open_ = self.ends[-1] if self.ends else 0
        fresh = self.hashes(np.concatenate([self.codes[open_ : self.cut], _codes(tail)]), [self.cut - open_ + e for e in ends])
        return self.text[: self.cut] + tail, signature(np.concatenate([self.whole[: len(self.ends)], fresh]))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            ends, _ = grow(text, root := {}, (root, None))
            rows.append((len(text), len(ends), printed(signature(hashes(_codes(text), ends)))))
        cols = zip(*rows, strict=True) if rows else ([], [], [])
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_chars", "n_phrases", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_phrases, fingerprint for every row of ``docs(doc_id, text)``, in one narrow pass.

    Null and empty texts have no phrases and an empty fingerprint. Repeated rows stay; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(without_collector(_fingerprints), "doc_id long, n_chars long, n_phrases long, fingerprint string")


def likeness(a: Column | str, b: Column | str) -> Column:
    """Of two columns of fingerprints, 0 to 1; null where one is null."""

    @F.pandas_udf("double")
    def compared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else alike(read(p), read(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return compared(a, b)


_COLUMNS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, times, guest) in order; a range ends with its guest, which is only compared with."""
    hashes, held, rows = Hashes(), None, []

    def against(own: Parsed, next_: Parsed) -> tuple:
        text, sign = own.edited(next_.text)
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return len(own.text), sha, printed(own.sign), printed(sign), alike(own.sign, sign), alike(own.sign, next_.sign)

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)], list(_COLUMNS))
        rows.clear()
        return out

    for batch in batches:
        for k in range(batch.num_rows):
            now = Parsed(batch.column(1)[k].as_py(), hashes)
            if held:
                id_, own, times = held
                if times > 1:
                    same = (id_, *against(own, own))
                    for _ in range(times - 1):
                        rows.append(same)
                        if len(rows) >= 1024:
                            yield flushed()
                rows.append((id_, *against(own, now)))
            held = None if batch.column(3)[k].as_py() else (batch.column(0)[k].as_py(), now, batch.column(2)[k].as_py())
            if len(rows) >= 1024:
                yield flushed()
    if rows:
        yield flushed()


def _ranged(cuts: np.ndarray, heads: dict[int, tuple[int, int]]):  # noqa: ANN202
    """Range of each (key, digest), and the range to which the first of a range is a guest. The rows of one key are split by digest if they fill ranges."""
    parts = sorted(heads)
    key, digest, goes = (np.zeros(len(cuts) + 1, dtype=np.int64) for _ in range(3))
    for i, p in enumerate(parts):
        key[p], digest[p] = heads[p]
        goes[p] = parts[(i + 1) % len(parts)]

    @F.pandas_udf("part long, guest long")
    def ranged(keys: pd.Series, digests: pd.Series) -> pd.DataFrame:
        k, d = keys.to_numpy(), digests.to_numpy()
        part = _part(cuts, k, d)
        first = (k == key[part]) & (d == digest[part])
        return pd.DataFrame({"part": part, "guest": pd.Series(np.where(first, goes[part], -1))})

    return ranged


def _part(cuts: np.ndarray, k: np.ndarray, d: np.ndarray) -> np.ndarray:
    low, high = np.searchsorted(cuts, k, side="left"), np.searchsorted(cuts, k, side="right")
    share = (d.astype(np.float64) + 2.0**63) / 2.0**64
    return low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)


def _numbered(cuts: np.ndarray):  # noqa: ANN202
    @F.pandas_udf("long")
    def numbered(keys: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series(_part(cuts, keys.to_numpy(), digests.to_numpy()))

    return numbered


def neighbours(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: its fingerprint, that of its edited text, and how alike it is to that and to the next text.

    Null texts count as empty: they have an empty fingerprint, like only to another empty one. The next row is that
    of the next smaller doc_id, null ids last; of equal ids that of the next smaller 64-bit digest of the text, so that repeated rows
    follow each other, each with a row of its own. After the last comes the first; the only row of a table follows itself. An empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("key"), F.xxhash64("text").alias("digest"))
    keys = checkpoint(own.groupBy("key", "digest").agg(F.count("*").alias("times"), F.max(F.length("text")).cast("long").alias("size")))
    size, rows, repeats = keys.agg(F.sum("size"), F.count("*"), F.count_if(F.col("times") > 1)).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, (size or 0) // RANGE_CHARS), max(1, rows))
    cuts = keys.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)] or [0.5], 50 * ranges)).first()[0] or []
    cuts = np.array(cuts if ranges > 1 else [], dtype=np.int64)
    heads = keys.groupBy(_numbered(cuts)("key", "digest").alias("part")).agg(F.max(F.struct("key", "digest")).alias("head")).collect()
    heads = {r["part"]: (r["head"]["key"], r["head"]["digest"]) for r in heads}
    own = own.withColumn("times", F.lit(1).cast("long"))
    if repeats:
        marks = keys.where("times > 1").select(F.col("key").alias("its_key"), F.col("digest").alias("its_digest"), F.col("times").alias("n"))
        marks = F.broadcast(marks) if repeats <= BROADCAST_KEYS else marks
        on = (F.col("key") == F.col("its_key")) & (F.col("digest") == F.col("its_digest"))
        once = own.join(marks, on).groupBy("key", "digest").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("n").alias("times"))
        own = own.join(marks, on, "left_anti").unionByName(once)
    at = F.col("at")
    places = F.array_compact(F.array(F.struct(at["part"].alias("part"), F.lit(0).alias("guest")), F.when(at["guest"] >= 0, F.struct(at["guest"].alias("part"), F.lit(1).alias("guest")))))
    dealt = own.withColumn("at", _ranged(cuts, heads)("key", "digest")).withColumn("place", F.explode(places))
    dealt = dealt.select("doc_id", "text", "times", F.col("place.guest").alias("guest"), F.col("place.part").alias("part"), "key", "digest")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "guest", F.desc("key"), F.desc("digest"))
    return dealt.select("doc_id", "text", "times", F.col("guest").cast("int").alias("guest")).mapInArrow(without_collector(_compared), SCHEMA)
