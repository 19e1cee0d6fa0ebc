"""Hard negatives by distributed radix selection.

Vectors become integers, so scores are exact and a threshold is a number that every task agrees on.
For each window of an anchor (its positives: all scores; the negatives of a positive: scores from
``low`` to ``high`` percent of the positive's) the k-th best score is found digit by digit. A pass over the rows counts
scores below the window's upper end in ``BUCKETS`` equal buckets, the counts are added up, and the bucket that holds the
k-th is split in the next pass, until a bucket is one score wide. Only then are rows gathered: those at the threshold or better.

A task sends no bucket behind the one in which its own counts reach k, for the k-th of all rows lies no
further; and of rows it gathers it sends its own k best (scores first, then ids), for no other can be among the k best of
all. So however many rows share a score, a task sends k rows a window.

Rows are never shuffled: anchors travel, in blocks of ``BLOCK`` that the driver pages through by id. What it holds
is one block and its windows (some 5 MB), whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import checkpoint

SCALE = 256
#: Components count as at most so much: 65,536 before scaling.
LIMIT = 1 << 24
BUCKETS = 512
BLOCK = 1024
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Anchors that are scored at once, and gathered rows that are held before they are cut to the best.
TILE, HELD = 128, 1 << 18
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, v, top) of rows that take part; v holds 32-bit integers, top their largest size."""
    for batch in batches:
        vectors = batch.column(2)
        size = np.asarray(vectors.value_lengths().fill_null(0))
        flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
        row = np.repeat(np.arange(len(size)), size)
        finite = np.isfinite(flat)
        bad = np.bincount(row[~finite], minlength=len(size)) > 0
        whole = np.clip(np.floor(SCALE * np.where(finite, flat, 0.0)), -LIMIT, LIMIT).astype("<i4")
        keep = ~bad
        for k in range(3):
            keep &= np.asarray(batch.column(k).is_valid())
        cells = np.split(whole, np.cumsum(size)[:-1]) if len(size) else []
        v = [cells[i].tobytes() for i in np.flatnonzero(keep)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(v, pa.binary())], ["vec_id", "label", "v"])


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): one row of each vec_id that has one, a label and a vector without null or non-finite components.

    Of rows that share a vec_id the one with the smallest label, then the smallest bytes of the vector, counts.
    """
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = checkpoint(own.mapInArrow(_integers, "vec_id long, label long, v binary"))
    again = checkpoint(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if not again.head(1):
        return rows
    best = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("best"))
    return checkpoint(rows.join(again, "vec_id", "left_anti").unionByName(best.select("vec_id", "best.*")))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    width = max(map(len, vectors), default=0)
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in vectors), dtype="<i4").reshape(len(vectors), width // 4).astype(np.float64)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: as doubles where no sum can pass 2^53."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d and np.abs(a).max() * np.abs(b).max() * d >= 2.0**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


@dataclass
class Windows:
    """A block's anchors and, for each, ``slots`` windows: scores from ``high`` down to ``high - reach``, of which ``need`` are wanted.

    The open bucket begins ``off`` below ``high`` and is split into buckets of ``width``; ``last`` is its end. All three arrays are (anchor, slot);
    a window with ``last < off`` is closed.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same: bool
    high: np.ndarray
    off: np.ndarray
    last: np.ndarray
    need: np.ndarray

    def __post_init__(self) -> None:
        self.width = np.maximum(1, -(-(self.last - self.off + 1) // BUCKETS))

    def fields(self) -> dict:
        """What travels: plain arrays, for workers have no copy of this module."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def near(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first anchor, anchor, score, distance into its slots' open buckets, id) of rows with the right label, a tile at a time."""
        ids, labels, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2).to_pylist())
        live = self.last >= self.off
        floor = np.where(live, self.high - self.last, np.iinfo(np.int64).max).min(1)
        for i in range(0, len(self.ids), TILE):
            t = slice(i, i + TILE)
            s = _scores(self.vectors[t], rows)
            wanted = s >= floor[t, None]
            if self.same:
                wanted &= (labels == self.labels[t, None]) & (ids != self.ids[t, None])
            else:
                wanted &= labels != self.labels[t, None]
            a, r = np.nonzero(wanted)
            yield i, a, s[a, r], ids[r]


def _counter(held: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(**held.value)
        slots = w.high.shape[1]
        counts = np.zeros((len(w.ids), slots, BUCKETS), dtype=np.int64)
        for batch in batches:
            for i, a, s, _ in w.near(batch):
                for j in range(slots):
                    u = w.high[i + a, j] - s
                    inside = (u >= w.off[i + a, j]) & (u <= w.last[i + a, j])
                    at = a[inside]
                    bucket = (u[inside] - w.off[i + at, j]) // w.width[i + at, j]
                    n = min(TILE, len(w.ids) - i)
                    counts[i : i + n, j] += np.bincount(at * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
        before = counts.cumsum(2) - counts
        a, j, bucket = np.nonzero((counts > 0) & (before < w.need[:, :, None]))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a * slots + j, w.need[a, j], bucket, counts[a, j, bucket])], ["win", "need", "bucket", "n"])

    return run


def _gatherer(held: Broadcast, keys: tuple[np.ndarray, np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task's best rows of each window, down to its threshold ``last``; keys: ids and scores of the windows' positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(**held.value)
        slots = w.high.shape[1]
        wins, scores, ids = (np.zeros(0, dtype=np.int64) for _ in range(3))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            win, s, id_ = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.lexsort((id_, -s, win))
            win, s, id_ = win[order], s[order], id_[order]
            rank = np.arange(len(win)) - np.searchsorted(win, win, side="left")
            keep = rank < w.need.ravel()[win]
            return win[keep], s[keep], id_[keep]

        parts.append((wins, scores, ids))
        for batch in batches:
            for i, a, s, id_ in w.near(batch):
                for j in range(slots):
                    u = w.high[i + a, j] - s
                    inside = (u >= 0) & (u <= w.last[i + a, j])
                    parts.append(((i + a[inside]) * slots + j, s[inside], id_[inside]))
                if sum(len(p[0]) for p in parts) > HELD:
                    parts[:] = [cut()]
        win, s, id_ = cut()
        a, j = win // slots, win % slots
        positive, positive_score = (k[a, j] for k in keys) if keys else (np.zeros_like(win), np.zeros_like(win))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (win, w.ids[a], positive, positive_score, id_, s)], ["win", "anchor_id", "positive_id", "positive_score", "id", "score"])

    return run


def _selected(rows: DataFrame, w: Windows) -> Windows:
    """The windows with ``off`` 0 and ``last`` at the score of the last row that is wanted (at the window's end, if it has fewer)."""
    sc = rows.sparkSession.sparkContext
    need, last = w.need.copy(), w.last.copy()
    while (w.last >= w.off).any():
        held = sc.broadcast(w.fields())
        counts = rows.mapInArrow(_counter(held), "win long, need long, bucket long, n long").groupBy("win", "need", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("win").orderBy("bucket"))
        found = counts.withColumn("upto", upto).where("upto >= need and upto - n < need").select("win", "bucket", (F.col("need") - F.col("upto") + F.col("n")).alias("rest")).toArrow()
        held.unpersist()
        a, j = np.divmod(found["win"].to_numpy(), w.high.shape[1])
        off, end = w.off.copy(), np.full_like(w.last, -1)
        off[a, j] += found["bucket"].to_numpy() * w.width[a, j]
        wide = w.width[a, j] > 1
        end[a, j] = np.where(wide, np.minimum(off[a, j] + w.width[a, j] - 1, w.last[a, j]), -1)
        last[a[~wide], j[~wide]] = off[a[~wide], j[~wide]]
        rest = w.need.copy()
        rest[a, j] = found["rest"].to_numpy()
        w = Windows(w.ids, w.labels, w.vectors, w.same, w.high, off, end, rest)
    return Windows(w.ids, w.labels, w.vectors, w.same, w.high, np.zeros_like(last), last, need)


def _gathered(rows: DataFrame, w: Windows, keys: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(w.fields())
    found = rows.mapInArrow(_gatherer(held, keys), "win long, anchor_id long, positive_id long, positive_score long, id long, score long")
    need = {int(n) for n in w.need.ravel()}
    rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= max(need))


def _of_block(rows: DataFrame, block: pa.Table, longest: float, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    ids, labels, vectors = block["vec_id"].to_numpy(), block["label"].to_numpy(), _matrix(block["v"].to_pylist())
    top = np.floor(np.sqrt((vectors**2).sum(1)) * longest).astype(np.int64)[:, None] + 2  # no score is larger
    near = _selected(rows, Windows(ids, labels, vectors, True, top, np.zeros_like(top), 2 * top, np.full_like(top, positives)))
    found = _gathered(rows, near, None).select("win", "rank", "id", "score").toArrow()
    a, j = found["win"].to_numpy(), found["rank"].to_numpy() - 1
    id_, score = np.zeros((2, len(ids), positives), dtype=np.int64)
    there = np.zeros((len(ids), positives), dtype=bool)
    id_[a, j], score[a, j], there[a, j] = found["id"].to_numpy(), found["score"].to_numpy(), True
    above = high * score // 100
    reach = np.where(there, above - -(-low * score // 100), -1)
    far = _selected(rows, Windows(ids, labels, vectors, False, above, np.zeros_like(above), reach, np.full_like(above, negatives)))
    out = _gathered(rows, far, (id_, score))
    return checkpoint(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For ``rows(vec_id, label, v)`` as ``integers`` makes them: the best rows of other labels in each anchor's and positive's window of scores."""
    anchors = checkpoint(rows.where(anchor))
    lengths = rows.select("v").mapInArrow(_lengths, "square double").agg(F.max("square")).first()[0]
    longest, after, blocks = np.sqrt(lengths or 0.0), None, []
    while True:
        page = anchors if after is None else anchors.where(F.col("vec_id") > after)
        block = page.orderBy("vec_id").limit(BLOCK).toArrow()
        if not block.num_rows:
            break
        after = block["vec_id"][-1].as_py()
        blocks.append(_of_block(rows, block, longest, positives, negatives, low, high))
    return reduce(DataFrame.unionByName, blocks) if blocks else rows.sparkSession.createDataFrame([], SCHEMA)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array((_matrix(batch.column(0).to_pylist()) ** 2).sum(1))], ["square"])


def mined(embeddings: DataFrame, every: int = 100, relabel: int = 7, labels: int = 10) -> DataFrame:
    """Hard negatives of ``embeddings(vec_id, embedding, label)``: anchors are ids divisible by ``every``; ids divisible by ``relabel`` move to the next label.

    Rows without an id, label or vector, or with a null or non-finite component, take no part. Repeated ids count once (see
    ``integers``). Vectors of other lengths score over the components they share, empty ones 0; components beyond 65,536 count as that. Equal
    scores go by the smaller id. An anchor without positives, or a positive without rows in its window, gives no rows, nor does an
    empty table. Other columns are ignored.
    """
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return hard_negatives(integers(embeddings).withColumn("label", label), F.col("vec_id") % every == 0)


def oracle_sql() -> str:
    """Every anchor's scores written out and ranked."""
    return f"""
WITH own AS MATERIALIZED (
    SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM own a JOIN own b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
ranked AS (
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS place, id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= {NEGATIVES}"""
