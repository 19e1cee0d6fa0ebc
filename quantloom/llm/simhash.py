"""SimHash near-duplicates over a Gray-ordered hierarchical index.

Every document gets a 64-bit SimHash; two fingerprints link when at most three bits differ.
The *distinct* fingerprints are sorted by Gray rank, so that neighbours share most bits, and
indexed as one tree: an upper node holds the bits on which all fingerprints below it agree,
less those its parent holds already. A search adds up the differing bits on its way down,
drops a whole group as soon as the sum exceeds three, and takes a whole group at once where the
sum and the bits still open below stay within three.

The tree is spread over the cluster by Gray rank. Each range of neighbouring ranks holds the
lower part of the tree; one summary a range (two words) makes up the upper part, which
travels with the tasks. A fingerprint descends the upper part first and is sent only to the
later ranges it cannot be told apart from, where it descends the rest. For fingerprints without
structure that is C(log2 of the ranges, up to 3) / 2 rows: 5 for 8 ranges, 20 for 60, 100 for 2,000. A range's own fingerprints are all that a task holds (``range_size``);
visitors stream past them, so neither a hub nor a crowded range has to be gathered. Only a spanning
forest leaves a range, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import checkpoint, connected_components

RADIUS = 3
FANOUT = 4
FRONTIER = 1 << 14
#: Pairs that are held before they are folded into the forest.
HELD_PAIRS = 1 << 18
LEAST_RANGE, MOST_RANGE = 1 << 16, 1 << 22
LEAST_RANGES = 8
#: Keys of rows to drop or to merge that may be broadcast (some 10 MB).
BROADCAST_KEYS = 200_000
_U = np.uint64
_xx = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of ASCII-lower-cased words in 3-word shingles; no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
    h = np.fromiter(map(_xx, shingles), dtype=_U)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(_U)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, text, ...): doc_id, fp and the rest."""
    for batch in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=_U, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of x in the reflected Gray sequence: the prefix XOR of its bits."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> _U(s))
    return x


def range_size(n: int) -> int:
    """Fingerprints of a range: growing with the square root of all, within the bounds of a task's memory."""
    return min(MOST_RANGE, max(LEAST_RANGE, isqrt(n) << 7))


class GrayIndex:
    """A tree over leaves in Gray order; a leaf is a fingerprint, or a range by the OR and AND of its own."""

    def __init__(self, ors: np.ndarray, ands: np.ndarray) -> None:
        self.agree, self.value, self.end = [], [], []
        self.pruned = 0  # upper nodes at which a search gave a whole group up
        end = np.arange(1, len(ors) + 1)
        while True:
            self.agree.append(~(ors ^ ands))
            self.value.append(ands)
            self.end.append(end)
            if len(ors) <= 1:
                break
            start = np.arange(0, len(ors), FANOUT)
            ors, ands = np.bitwise_or.reduceat(ors, start), np.bitwise_and.reduceat(ands, start)
            end = end[np.minimum(start + FANOUT, len(end)) - 1]
        self.top = len(self.agree) - 1
        self.open = [64 - np.bitwise_count(a).astype(np.int16) for a in self.agree]
        self.below = []  # (value, bits new to the parent) of each node's children, side by side
        for lv in range(self.top):
            parent = np.arange(len(self.agree[lv])) // FANOUT
            fresh = self.agree[lv] & ~self.agree[lv + 1][parent]
            spare = -len(fresh) % FANOUT
            self.below.append(tuple(np.pad(x, (0, spare)).reshape(-1, FANOUT) for x in (self.value[lv], fresh)))

    def first(self, lv: int, node: np.ndarray) -> np.ndarray:
        """First leaf below each node."""
        return node * FANOUT**lv

    def search(self, fp: np.ndarray, later: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) pairs within RADIUS; of a group within it as a whole only the first leaf.

        ``later``: the queries are the leaves themselves, and only leaves behind them are looked for.
        """

        def descend(lv: int, q: np.ndarray, node: np.ndarray, acc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Nodes within RADIUS so far: depth first, FRONTIER of them at a time."""
            if later:
                ahead = self.end[lv][node] > q + 1
                q, node, acc = q[ahead], node[ahead], acc[ahead]
            if lv == 0:
                yield q, node
                return
            whole = acc + self.open[lv][node] <= RADIUS
            if whole.any():
                yield q[whole], self.first(lv, node[whole])
                q, node, acc = q[~whole], node[~whole], acc[~whole]
            value, fresh = self.below[lv - 1]
            for i in range(0, len(q), FRONTIER):
                part, at = q[i : i + FRONTIER], node[i : i + FRONTIER]
                diff = np.bitwise_count((fp[part][:, None] ^ value[at]) & fresh[at])
                diff += acc[i : i + FRONTIER, None]
                near = np.flatnonzero(diff <= RADIUS)
                up = near // FANOUT
                kid = at[up] * FANOUT + near % FANOUT
                real = kid < len(self.value[lv - 1])
                if lv > 1:
                    self.pruned += diff.size - len(near)
                yield from descend(lv - 1, part[up][real], kid[real], diff.ravel()[near][real])

        for i in range(0, len(fp), FRONTIER >> 4):
            q = np.arange(i, min(len(fp), i + (FRONTIER >> 4)))
            acc = np.bitwise_count((fp[q] ^ self.value[-1][0]) & self.agree[-1][0])
            q, acc = q[acc <= RADIUS], acc[acc <= RADIUS]
            yield from descend(self.top, q, np.zeros(len(q), dtype=np.int64), acc)

    def together(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(leaf, first leaf) of the groups whose fingerprints are all within RADIUS of each other."""
        for lv in range(1, self.top + 1):
            node = np.flatnonzero(self.open[lv] <= RADIUS)
            size = self.end[lv][node] - self.first(lv, node)
            head = np.repeat(self.first(lv, node), size)
            yield head + np.arange(len(head)) - np.repeat(np.cumsum(size) - size, size), head


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= HELD_PAIRS:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, size = [], 0
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def joined(root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest member of each item's set under the union of all pairs."""
    for i, j in _gathered(pairs):
        while len(i):
            a, b = root[i], root[j]
            live = a != b
            i, j, a, b = i[live], j[live], a[live], b[live]
            if not len(i):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (jump := root[root]).tobytes() != root.tobytes():
                root = jump
    return root


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, visits, rank, fp) sorted by the first three: a range's own, then its visitors."""
    part, own, index, root = None, [], None, None

    def built() -> pa.RecordBatch:
        nonlocal index, root, own
        fp = np.concatenate(own)
        index = GrayIndex(fp, fp)
        root = joined(np.arange(len(fp)), index.together())
        root = joined(root, index.search(fp, later=True))
        own = [fp]
        far = root != np.arange(len(fp))
        return _edges(fp[far], fp[root[far]])

    for batch in batches:
        parts, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        fps = batch.column(3).to_numpy().view(_U)
        cut = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (visits[1:] != visits[:-1])]) if len(fps) else []
        for a, b in zip(cut, [*cut[1:], len(fps)], strict=True):
            if parts[a] != part:
                if own and index is None:
                    yield built()
                part, own, index = parts[a], [], None
            if not visits[a]:
                own.append(fps[a:b])
                continue
            if index is None:
                yield built()
            for q, leaf in _gathered(index.search(fps[a:b])):
                found = np.unique(np.stack([q, root[leaf]]), axis=1)
                yield _edges(fps[a:b][found[0]], own[0][found[1]])
    if own and index is None:
        yield built()


def _router(parts: np.ndarray, ors: np.ndarray, ands: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sends each row (part, rank, fp) to its own range and to the later ones it may have a link in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = GrayIndex(ors, ands)
        for batch in batches:
            own, rank, fp = (batch.column(k).to_numpy() for k in range(3))
            no = np.zeros(len(fp), dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(no), batch.column(1), batch.column(2)], _DEALT_NAMES)
            for q, leaf in _gathered(upper.search(fp.view(_U))):
                ahead = parts[leaf] > own[q]
                q, leaf = q[ahead], leaf[ahead]
                yield pa.RecordBatch.from_arrays([pa.array(parts[leaf]), pa.array(~no[q]), pa.array(rank[q]), pa.array(fp[q])], _DEALT_NAMES)

    return run


_DEALT_NAMES = ["part", "visits", "rank", "fp"]
_DEALT = "part int, visits boolean, rank long, fp long"


def _numbered(bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = gray_rank(batch.column(0).to_numpy().view(_U))
            part = np.searchsorted(bounds, rank, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(rank.view(np.int64) ^ np.int64(-(1 << 63))), batch.column(0)], ["part", "rank", "fp"])

    return run


def ranked(fps: DataFrame) -> DataFrame:
    """(part, rank, fp) of the distinct fingerprints: the range of Gray rank that each falls in.

    The ranges' bounds are quantiles, so their number does not depend on the partitions.
    """
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    rank = rank.bitwiseXOR(F.lit(-(1 << 63)))  # so that signed order is the ranks' order
    n = fps.count()
    ranges = max(LEAST_RANGES, -(-n // range_size(n)))
    cuts = fps.agg(F.percentile_approx(rank, [k / ranges for k in range(1, ranges)], 50 * ranges)).first()[0] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64)).view(_U) ^ _U(1 << 63)
    return checkpoint(fps.select("fp").mapInArrow(_numbered(bounds), "part int, rank long, fp long"))


def upper_nodes(dealt: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, OR, AND) of each range, in order: two words for a range."""
    rows = dealt.groupBy("part").agg(F.expr("bit_or(fp)").alias("o"), F.expr("bit_and(fp)").alias("a")).orderBy("part").toArrow()
    return rows["part"].to_numpy(), rows["o"].to_numpy().view(_U), rows["a"].to_numpy().view(_U)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is linked among the distinct values of ``fps(fp)``."""
    dealt = ranked(fps)
    parts, ors, ands = upper_nodes(dealt)
    if not len(parts):
        return dealt.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    sent = dealt.mapInArrow(_router(parts, ors, ands), _DEALT)
    sent = sent.repartition("part").sortWithinPartitions("part", "visits", "rank")
    return sent.mapInArrow(_search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint, component_id.

    Null or wordless texts have fingerprint zero and link like any other. A null doc_id is
    kept and never names a component (a component of null ids only is null). Repeated
    rows stay repeated. No rows give no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps = checkpoint(own.mapInArrow(_fingerprints, "doc_id long, fp long"))
    return grouped(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped(fps: DataFrame) -> DataFrame:
    """``fps(doc_id, fp, ...)`` plus component_id, the smallest doc_id reachable, and root, which names the group."""
    reps = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    tree = checkpoint(connected_components(links(reps.select("fp"))))
    named = checkpoint(
        reps.join(tree, reps.fp == tree.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    )
    lows = checkpoint(named.groupBy("root").agg(F.min("low").alias("component_id")))
    parts = checkpoint(named.join(lows, "root").select("fp", "component_id", "root"))
    return fps.join(parts, "fp")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates.

    The row with the smallest doc_id (null ids last, of equal ids the smallest digest of the text)
    stays; of rows that agree in both, one. Other texts of a doc_id that goes stay. What has to
    be done is a small table of keys, broadcast up to BROADCAST_KEYS of them and joined by a
    shuffle beyond; only rows that repeat as a whole are grouped with their texts.
    """
    digest = F.xxhash64(F.col("text").cast("string"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest"))
    rows = grouped(checkpoint(own.mapInArrow(_fingerprints, "doc_id long, fp long, digest long")))
    keys = checkpoint(rows.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("times")))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    best = keys.groupBy("root").agg(F.min(rank).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    marks = keys.join(best, "root").select("doc_id", "digest", stays.alias("stays"), "times")
    marks = checkpoint(marks.where("not stays or times > 1").select(F.col("doc_id").alias("at_id"), F.col("digest").alias("at_digest"), "stays"))

    def on(df: DataFrame, how: str) -> DataFrame:
        sized = F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
        return docs.join(sized, F.col("doc_id").cast("long").eqNullSafe(F.col("at_id")) & (digest == F.col("at_digest")), how)

    repeated = on(marks.where("stays"), "left_semi")
    first = [F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")]
    once = repeated.groupBy(F.col("doc_id").alias("key_id"), digest.alias("key_digest")).agg(*first).select("row.*")
    return on(marks, "left_anti").unionByName(once)
