"""Exact-substring deduplication by prefix-free parsing.

Triggers: a string of ``LEAST`` bytes is triggered by the least rolling hash of its ``GRAM``-byte
windows; that depends on the string alone, so equal strings have equal triggers. Consecutive
strings of one trigger span a phrase, which overlaps its neighbours so that no string is
cut (in periodic text it is cut after ``LONGEST`` strings). A document's parse is its row
of phrases; the dictionary is the set of distinct phrases.

1. Shards of documents send their triggers' short hashes to hash buckets and learn which
   occur in several documents. (A collision only lets a phrase through.)
2. Shards send the phrases of those triggers, each once with its smallest doc_id: the
   dictionary, dealt out by trigger.
3. A bucket sorts the suffixes of its dictionary (to LEAST bytes, those that start a
   string) and takes the smallest doc_id of each class of common prefix LEAST; a trigger
   with one phrase needs no sort. Shards get back the smallest doc_id of each string.
4. The parse maps that to the documents' bytes: a string is removed where its smallest
   doc_id is smaller than the document's own.

Strings are compared byte for byte. Shards and buckets are sized by the input's bytes, so
a group's memory is bounded (by the longest document at least); a passage in a third of all
documents reaches a bucket once per shard. The shards' exchange is one and reused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 50
GRAM = 16
LONGEST = 128
SHARD_BYTES = 3 << 20
SORT_STRINGS = 1 << 17
_SPAN = LEAST - GRAM + 1
_U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of each GRAM bytes (GRAM is a power of two), by doubling."""
    h, power, size = data.astype(_U), 0x9E3779B97F4A7C15, 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            left = h[:-size] * _U(power)
            left += h[size:]
            h, power, size = left, power * power % (1 << 64), size * 2
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
    return h


def phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string start, number of strings, trigger hash) of each phrase of a document."""
    if len(data) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    low, size = gram_hashes(data), 1
    while size * 2 <= _SPAN:
        low, size = np.minimum(low[size:], low[:-size]), size * 2
    if size < _SPAN:
        low = np.minimum(low[_SPAN - size :], low[: size - _SPAN])
    first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    count = np.empty_like(first)
    count[:-1] = first[1:] - first[:-1]
    count[-1] = len(low) - first[-1]
    if count.max() > LONGEST:
        cuts = -(-count // LONGEST)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        end = np.repeat(first + count, cuts)
        first = np.repeat(first, cuts) + nth * LONGEST
        count = np.minimum(end - first, LONGEST)
    return first, count, low[first]


class Shard:
    """The documents of a shard by doc_id, with their phrases."""

    def __init__(self, t: pa.Table, bits: int) -> None:
        t = t.sort_by([("doc_id", "ascending")])
        self.ids = t["doc_id"].to_pylist()
        self.texts = [x or b"" for x in t["text"].to_pylist()]
        empty = np.empty(0, np.int64)
        self.doc, self.start, self.count, trigger = [], [], [], []
        for k, data in enumerate(self.texts):
            a, n, h = phrases(np.frombuffer(data, dtype=np.uint8)) if self.ids[k] is not None else (empty, empty, empty.view(_U))
            self.doc.append(np.full(len(a), k, dtype=np.int32))
            self.start.append(a.astype(np.int32))
            self.count.append(n.astype(np.int32))
            trigger.append(h)
        self.doc, self.start, self.count, trigger = (np.concatenate(x) if x else empty for x in (self.doc, self.start, self.count, trigger))
        # bucket and the 32 bits behind it, as one number
        self.key = (trigger.view(_U) >> _U(32 - bits)).astype(np.int64)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys; which of them occur in two of the shard's documents."""
        order = np.argsort(self.key, kind="stable")  # rows are in document order
        key, doc = self.key[order], self.doc[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        ids = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)
        last = np.r_[first[1:], len(key)] - 1
        return key[first], ids[doc[first]] != ids[doc[last]] if len(key) else np.zeros(0, dtype=bool)

    def dictionary(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Of the shared keys: phrase rows, each row's entry, the entries' keys (by bucket), bytes and lowest doc_id."""
        at = np.searchsorted(shared, self.key)
        rows = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == self.key) if len(shared) else np.empty(0, np.int64)
        entry: dict[tuple[int, bytes], int] = {}
        texts = self.texts
        found = [
            entry.setdefault((k, texts[d][a:b]), len(entry))
            for k, d, a, b in zip(
                self.key[rows].tolist(), self.doc[rows].tolist(), self.start[rows].tolist(),
                (self.start[rows] + self.count[rows] + (LEAST - 1)).tolist(), strict=True,
            )
        ]
        of = np.array(found, dtype=np.int64)
        key = np.fromiter((k for k, _ in entry), dtype=np.int64, count=len(entry))
        order = np.argsort(key >> 32, kind="stable")
        rank = np.empty(len(entry), dtype=np.int64)
        rank[order] = np.arange(len(entry))
        of = rank[of]
        own = [p for _, p in entry]
        ids = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)
        low = np.full(len(entry), np.iinfo(np.int64).max)
        np.minimum.at(low, of, ids[self.doc[rows]])
        return rows, of, key[order], [own[k] for k in order.tolist()], low


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """Slices of a sorted bucket column."""
    if not len(bucket):
        return []
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return [(int(bucket[a]), slice(int(a), int(b))) for a, b in zip(cut, np.r_[cut[1:], len(bucket)], strict=True)]


_SENT = "shard long, bucket long, keys binary, lengths binary, docs binary, bytes binary"
_REPLY = "shard long, kind int, bucket long, body binary, more binary, docs binary"


def _table(columns: list[list], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


def _send_keys(bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        keys, several = Shard(t, bits).repeats()
        low = (keys & 0xFFFFFFFF).astype(np.uint32)
        parts = _by_bucket(keys >> 32)
        n = len(parts)
        flags = [np.packbits(several[s]).tobytes() for _, s in parts]
        return _table([[shard] * n, [b for b, _ in parts], [low[s].tobytes() for _, s in parts], flags, [b""] * n, [b""] * n], _schema(_SENT))

    return run


def _shared_keys(t: pa.Table) -> pa.Table:
    """A bucket's answer to each shard: its keys that two documents or more have."""
    sent = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in t["keys"]]
    flags = [np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=len(k)).astype(bool) for x, k in zip(t["lengths"], sent, strict=True)]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    several = values[counts > 1]
    known = lambda k: several[np.minimum(np.searchsorted(several, k), len(several) - 1)] == k if len(several) else False
    body = [k[f | known(k)].tobytes() for k, f in zip(sent, flags, strict=True)]
    n = len(sent)
    return _table([t["shard"].to_pylist(), [0] * n, t["bucket"].to_pylist(), body, [b""] * n, [b""] * n], _schema(_REPLY))


def _shared(replies: pa.Table) -> np.ndarray:
    got = replies.filter(pa.compute.equal(replies["kind"], 0)).select(["bucket", "body"]).to_pylist()
    keys = [np.frombuffer(r["body"], dtype=np.uint32).astype(np.int64) | r["bucket"] << 32 for r in sorted(got, key=lambda r: r["bucket"])]
    return np.concatenate(keys) if keys else np.empty(0, np.int64)


def _send_phrases(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        schema = _schema(_SENT)
        if not t.num_rows:
            return schema.empty_table()
        own = Shard(t, bits)
        _, _, key, entries, low = own.dictionary(_shared(replies))
        shard = t["shard"][0].as_py()
        out: list[list] = [[], [], [], [], [], []]
        for b, s in _by_bucket(key >> 32):
            own_phrases = entries[s]
            sizes = np.array([len(p) for p in own_phrases], dtype=np.uint8)
            row = (shard, b, (key[s] & 0xFFFFFFFF).astype(np.uint32).tobytes(), sizes.tobytes(), low[s].tobytes(), b"".join(own_phrases))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return _table(out, schema)

    return run


def string_hashes(text: np.ndarray) -> np.ndarray:
    """Rolling hash of the LEAST bytes at each position, joined from powers of two."""
    h, power, size = text.astype(_U), 0x9E3779B97F4A7C15, 1
    out, covered = None, 0
    with np.errstate(over="ignore"):
        while size <= LEAST:
            if LEAST & size:
                part = h[covered:]
                out = part.copy() if out is None else out[: len(part)] * _U(power) + part
                covered += size
            if size * 2 <= LEAST:
                left = h[:-size] * _U(power)
                left += h[size:]
                h = left
            power, size = power * power % (1 << 64), size * 2
    return out[: len(text) - LEAST + 1]


def string_classes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class number of the LEAST bytes at each start, by sorting the suffixes there.

    A string whose hash no other has is alone in its class and need not be sorted.
    """
    _, out, count = np.unique(string_hashes(text)[starts], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[out] > 1)
    if not len(again):
        return out
    starts = starts[again]
    columns = []
    for i in range(0, LEAST, 8):
        part = np.zeros(len(starts), dtype=_U)
        for j in range(i, min(i + 8, LEAST)):
            part = (part << _U(8)) | text[starts + j]
        columns.append(part)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(starts), dtype=bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    out[again[order]] = len(count) + np.cumsum(new)
    return out


def _lowest_docs(t: pa.Table) -> pa.Table:
    """A bucket's answer to each shard: runs (length, smallest doc_id) of each phrase's strings."""
    rows = t.to_pylist()
    keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint32) for r in rows])
    sizes = np.concatenate([np.frombuffer(r["lengths"], dtype=np.uint8) for r in rows]).astype(np.int64)
    docs = np.concatenate([np.frombuffer(r["docs"], dtype=np.int64) for r in rows])
    text = np.frombuffer(b"".join(r["bytes"] for r in rows), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    buf = text.tobytes()
    distinct: dict[tuple[int, bytes], int] = {}
    of = np.array([distinct.setdefault((k, buf[a : a + n]), len(distinct)) for k, a, n in zip(keys.tolist(), begin.tolist(), sizes.tolist(), strict=True)], dtype=np.int64)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(low, of, docs)
    sample = np.empty(len(distinct), dtype=np.int64)
    sample[of] = np.arange(len(of))
    key = keys[sample]
    several = np.isin(key, (lambda v, c: v[c > 1])(*np.unique(key, return_counts=True)))
    count = sizes[sample] - LEAST + 1
    # strings of the phrases whose trigger has several: classes and their smallest doc_id
    pick = np.flatnonzero(several)
    pick = pick[np.argsort(key[pick], kind="stable")]
    n = count[pick]
    offset = np.cumsum(n) - n
    lows = np.repeat(low[pick], n)
    new = np.flatnonzero(np.r_[True, key[pick][1:] != key[pick][:-1]]) if len(pick) else pick
    cuts = [0, *(int(k) for k in new[1:][np.diff(offset[new] // SORT_STRINGS) > 0]), len(pick)]  # whole triggers at a time
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        if x == y:
            continue
        m, own_bytes = n[x:y], n[x:y] + LEAST - 1
        at = np.cumsum(own_bytes) - own_bytes
        part = text[np.repeat(begin[sample[pick[x:y]]] - at, own_bytes) + np.arange(own_bytes.sum())]
        cls = string_classes(part, np.repeat(at - (np.cumsum(m) - m), m) + np.arange(m.sum()))
        best = np.full(cls.max() + 1, np.iinfo(np.int64).max)
        own = slice(offset[x], offset[x] + len(cls))
        np.minimum.at(best, cls, lows[own])
        lows[own] = best[cls]
    # runs of equal doc_id within a phrase
    head = np.zeros(len(lows), dtype=bool)
    head[offset] = True
    head[1:] |= lows[1:] != lows[:-1]
    at = np.flatnonzero(head)
    length = np.diff(np.r_[at, len(lows)])
    runs = np.ones(len(distinct), dtype=np.int64)
    runs[pick] = np.add.reduceat(head.astype(np.int64), offset) if len(pick) else 0
    first = np.cumsum(runs) - runs
    run_len, run_doc = np.empty(runs.sum(), dtype=np.uint8), np.empty(runs.sum(), dtype=np.int64)
    single = np.flatnonzero(~several)
    run_len[first[single]], run_doc[first[single]] = count[single], low[single]
    slots = np.repeat(first[pick] - (np.cumsum(runs[pick]) - runs[pick]), runs[pick]) + np.arange(runs[pick].sum())
    run_len[slots], run_doc[slots] = length, lows[at]

    out: list[list] = [[], [], [], [], [], []]
    done = 0
    for r in rows:
        mine = of[done : done + len(r["lengths"])]
        own_low = docs[done : done + len(mine)]
        done += len(mine)
        k = runs[mine].copy()
        k[(k == 1) & (run_doc[first[mine]] == own_low)] = 0  # as the shard assumes
        which = np.repeat(first[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        for column, value in zip(out, (r["shard"], 1, r["bucket"], k.astype(np.uint8).tobytes(), run_len[which].tobytes(), run_doc[which].tobytes()), strict=True):
            column.append(value)
    return _table(out, _schema(_REPLY))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def _mark(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        schema = _schema(RESULT)
        if not t.num_rows:
            return schema.empty_table()
        own = Shard(t, bits)
        rows, of, key, entries, low = own.dictionary(_shared(replies))
        count = np.array([len(p) - LEAST + 1 for p in entries], dtype=np.int64)
        runs = np.zeros(len(entries), dtype=np.int64)
        lens, docs = {}, {}
        where = dict(_by_bucket(key >> 32))
        for r in replies.filter(pa.compute.equal(replies["kind"], 1)).to_pylist():
            s = where[r["bucket"]]
            runs[s] = np.frombuffer(r["body"], dtype=np.uint8)
            lens[s.start], docs[s.start] = np.frombuffer(r["more"], dtype=np.uint8), np.frombuffer(r["docs"], dtype=np.int64)
        run_len = np.concatenate([lens[a] for a in sorted(lens)] or [np.empty(0, np.uint8)]).astype(np.int64)
        run_doc = np.concatenate([docs[a] for a in sorted(docs)] or [np.empty(0, np.int64)])
        # a phrase without an answer has one run: the shard's own smallest doc_id
        silent = runs == 0
        full = np.where(silent, 1, runs)
        first = np.cumsum(full) - full
        all_len, all_doc = np.empty(full.sum(), dtype=np.int64), np.empty(full.sum(), dtype=np.int64)
        told = np.repeat(~silent, full)
        all_len[told], all_doc[told] = run_len, run_doc
        all_len[first[silent]], all_doc[first[silent]] = count[silent], low[silent]
        ends = np.cumsum(all_len) - (np.cumsum(count) - count).repeat(full) if len(full) else all_len
        ids = np.array([0 if i is None else i for i in own.ids], dtype=np.int64)
        k = full[of]
        which = np.repeat(first[of] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        doc, base = np.repeat(own.doc[rows], k), np.repeat(own.start[rows].astype(np.int64), k)
        hit = all_doc[which] < ids[doc]
        which, doc, base = which[hit], doc[hit], base[hit]
        stop = base + ends[which]
        start = stop - all_len[which]
        stop += LEAST - 1
        cut = np.searchsorted(doc, np.arange(len(own.ids) + 1))  # rows are in document order
        out: list[list] = [[], [], [], [], [], []]
        for d, (i, data) in enumerate(zip(own.ids, own.texts, strict=True)):
            a, b = start[cut[d] : cut[d + 1]], stop[cut[d] : cut[d + 1]]
            if len(a):
                new = np.r_[True, a[1:] > np.maximum.accumulate(b)[:-1]]
                a, b = a[new], np.maximum.reduceat(b, np.flatnonzero(new))
            kept, done = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                kept.update(data[done:x])
                done = y
            kept.update(data[done:])
            row = (i, len(data), int((b - a).sum()), len(a), kept.hexdigest(), np.stack([a, b], 1).astype(np.int64).tobytes())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return _table(out, schema)

    return run


def repeated_spans(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: sizes, digest and spans (int64 byte pairs) removed.

    Null texts are empty. A null doc_id is neither smaller nor larger than another: such rows
    lose nothing and take nothing away, and neither do rows of one doc_id among
    themselves. Texts under 50 bytes stay. No rows give no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // shard_bytes) + 1
    bits = min(31, max(3, (shards - 1).bit_length() + 1))  # buckets grow with the shards; 31 bits are six petabytes
    dealt = own.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(shards)).alias("shard"), "doc_id", "text")
    tasks = max(shards, 8)  # fixed, so that a task's input stays a shard's size and is not coalesced with others
    dealt = dealt.repartition(tasks, "shard")
    keys = dealt.groupBy("shard").applyInArrow(_send_keys(bits), _SENT).repartition(tasks, "bucket")
    shared = keys.groupBy("bucket").applyInArrow(_shared_keys, _REPLY)
    sent = dealt.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(_send_phrases(bits), _SENT).repartition(tasks, "bucket")
    lowest = sent.groupBy("bucket").applyInArrow(_lowest_docs, _REPLY)
    return dealt.groupBy("shard").cogroup(shared.unionByName(lowest).groupBy("shard")).applyInArrow(_mark(bits), RESULT)


def remove_spans(data: bytes, spans: bytes) -> bytes:
    kept, done = [], 0
    for a, b in np.frombuffer(spans, dtype=np.int64).reshape(-1, 2).tolist():
        kept.append(data[done:a])
        done = b
    return b"".join([*kept, data[done:]])


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return repeated_spans(docs).drop("spans")
