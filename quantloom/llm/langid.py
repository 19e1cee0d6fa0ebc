"""Language identification by segmentation-marginalised unigrams.

A word's likelihood in a language is the sum over all its segmentations into pieces of a
fixed public vocabulary of the product of the pieces' probabilities, by the forward
algorithm. The piece probabilities of each language are fitted by expectation-maximisation
(forward-backward) on the word counts of a bounded sample of labelled rows: the words stay on the cluster,
each partition sums the expected uses of pieces, and only the model comes to the driver. A text's
log-likelihood is the sum over its words. Words are runs of letters, lower-cased, with the
vocabulary's word mark in front; a run of over ``CHUNK`` characters is cut into words of
that length, and each is scored, so that whole texts count.

The score is the language's posterior beside the other languages and a background that takes all pieces to be
equally likely, so that a text in no learned language scores low. As words are not independent, the
log-likelihoods are divided by a temperature, which is fitted on a fold of the sample.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quantloom.llm.common import checkpoint

#: Labelled rows sampled for each language, in expectation (all rows where there are fewer).
TRAIN_ROWS = 3000
#: UTF-8 bytes of text sampled over all languages, in expectation, of which each may fill an equal part...
TRAIN_BYTES = 64 << 20
#: ... but never fewer rows of one than this. Every word of a sampled row counts.
LEAST_ROWS = 200
#: Words times languages that the fit holds at once.
FIT_CELLS = 80_000
EM_ROUNDS = 4
CHUNK = 24
SMOOTH = 0.05
UNKNOWN = 1e-9
CACHE_WORDS = 200_000
BATCH_WORDS = 300_000
FOLDS = 5
#: Partitions of the sample's words while fitting.
FIT_TASKS = 16
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64, 128, 256)
#: Labels whose sampling shares are broadcast (a few kB); more of them are joined by a shuffle.
BROADCAST_LABELS = 10_000

_RUNS = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def public_vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a public sentencepiece model (default: the installed 32k one)."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


def words_of(text: str) -> Counter:
    words = Counter(_RUNS.findall(text.lower()))
    for run in [w for w in words if len(w) > CHUNK]:
        n = words.pop(run)
        for i in range(0, len(run), CHUNK):
            words[run[i : i + CHUNK]] += n
    for w in [w for w in words if not w.isalpha()]:  # digits beyond the decimal ones, marks
        if not any(map(str.isalpha, w)):
            del words[w]
    return words


_BASE, _SLOTS = 0x9E3779B97F4A7C15, 18
_SPREAD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Lattice:
    """Pieces by number; a lone character without a piece has its own, improbable number.

    Substrings of many words are looked up at once by 64-bit hashes of their code points, in
    a few small tables: a piece stands in the first whose slot was free.
    """

    def __init__(self, number: dict[str, int], longest: int) -> None:
        self.number, self.longest = number, longest
        self.hashes = np.zeros(len(number) + 2, dtype=np.uint64)  # the last, "no piece", has 0
        self.tables = [np.full(1 << _SLOTS, len(number) + 1, dtype=np.int32) for _ in _SPREAD]
        for piece, k in number.items():
            h = 1
            for c in piece:
                h = (h * _BASE + ord(c)) % (1 << 64)
            self.hashes[k] = h
            for table, spread in zip(self.tables, _SPREAD, strict=True):
                slot = (h ^ h >> 32) * spread % (1 << 64) >> 64 - _SLOTS
                if table[slot] == len(number) + 1:
                    table[slot] = k
                    break
            else:
                raise ValueError(f"no free slot for the piece {piece!r}")

    @classmethod
    def of(cls, pieces: list[str]) -> Lattice:
        pieces = [p for p in dict.fromkeys(pieces) if p == p.lower() and 0 < len(p) <= CHUNK + 1]
        return cls({p: i for i, p in enumerate(pieces)}, max(map(len, pieces), default=1))

    @property
    def size(self) -> int:
        return len(self.number) + 2  # ..., unknown character, no piece

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.number) + 1, dtype=np.int32)
        mixed = h ^ h >> np.uint64(32)
        for table, spread in zip(self.tables, _SPREAD, strict=True):
            k = table[(mixed * np.uint64(spread)) >> np.uint64(64 - _SLOTS)]
            out = np.where(self.hashes[k] == h, k, out)
        return out

    def arcs(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int]], np.ndarray]]:
        """By length: positions in words, length, arcs (i, j), piece numbers (arcs x words)."""
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w) + 1].append(k)
        none, lone = len(self.number) + 1, len(self.number)
        for n, own in by_length.items():
            arcs = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]
            column = {arc: c for c, arc in enumerate(arcs)}
            text = "".join(_MARK + words[k] for k in own).encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(text, dtype=np.uint32).reshape(len(own), n).T.astype(np.uint64)
            idx = np.empty((len(arcs), len(own)), dtype=np.int32)
            with np.errstate(over="ignore"):
                for i in range(n):
                    h = np.ones(len(own), dtype=np.uint64)
                    for j in range(i + 1, min(n, i + self.longest) + 1):
                        h = h * np.uint64(_BASE) + codes[j - 1]
                        found = self.find(h)
                        idx[column[i, j]] = np.where(found == none, lone, found) if j == i + 1 else found
            yield np.array(own), n, arcs, idx


def forward(p: np.ndarray, n: int, arcs: list[tuple[int, int]], idx: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]."""
    alpha = np.zeros((n + 1, idx.shape[1], p.shape[1]))
    alpha[0] = 1
    for c, (i, j) in enumerate(arcs):
        alpha[j] += alpha[i] * p[idx[c]]
    return alpha


def start(lattice: Lattice, langs: int) -> np.ndarray:
    """Piece probabilities (pieces x languages) that know nothing."""
    p = np.full((lattice.size, langs), 1 / lattice.size)
    p[-2], p[-1] = UNKNOWN, 0
    return p


def maximised(seen: np.ndarray) -> np.ndarray:
    """Piece probabilities from expected uses."""
    seen = seen.copy()
    seen[:-2] += SMOOTH
    p = seen / np.maximum(seen[:-2].sum(0), 1)
    p[-2], p[-1] = UNKNOWN, 0
    return p


def expected(lattice: Lattice, p: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of the pieces (pieces x languages) in words with counts (words x languages)."""
    seen = np.zeros_like(p)
    step = max(1, FIT_CELLS // max(p.shape[1], 1))  # so that memory does not grow with the words
    for i in range(0, len(words), step):
        _gather(lattice, words[i : i + step], counts[i : i + step], p, seen)
    return seen


def _estimator(lattice: Lattice, p: np.ndarray):  # noqa: ANN202
    """E-step of a partition of (word, ns): the sums of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros_like(p)
        for batch in batches:
            words, entries = batch.column(0).to_pylist(), batch.column(1)
            flat = entries.flatten()
            row = np.repeat(np.arange(len(words)), pc.list_value_length(entries).to_numpy())
            step = max(1, FIT_CELLS // max(p.shape[1], 1))
            for i in range(0, len(words), step):
                low, high = np.searchsorted(row, (i, i + step))
                counts = np.zeros((min(step, len(words) - i), p.shape[1]))
                part = flat.slice(low, high - low)
                counts[row[low:high] - i, part.field(0).to_numpy()] = part.field(1).to_numpy()
                seen += expected(lattice, p, words[i : i + step], counts)
        piece, lang = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(seen[piece, lang])], ["piece", "lang", "n"])

    return run


def fit(lattice: Lattice, words: DataFrame, langs: int) -> np.ndarray:
    """Piece probabilities (pieces x languages) from ``words(word, ns array<struct<lang, n>>)``, a job a round."""
    p = start(lattice, langs)
    for _ in range(EM_ROUNDS):
        sums = words.mapInArrow(_estimator(lattice, p), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        seen = np.zeros_like(p)
        seen[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
        p = maximised(seen)
    return p


def _gather(lattice: Lattice, words: list[str], counts: np.ndarray, p: np.ndarray, seen: np.ndarray) -> None:
    """Add the expected uses of the pieces in the words to seen."""
    for own, n, arcs, idx in lattice.arcs(words):
        alpha = forward(p, n, arcs, idx)
        beta = np.zeros_like(alpha)
        beta[n] = 1
        share = counts[own] / np.maximum(alpha[n], 1e-300)
        for c in range(len(arcs) - 1, -1, -1):
            i, j = arcs[c]
            beta[i] += beta[j] * p[idx[c]]
        for c, (i, j) in enumerate(arcs):
            gain = share * alpha[i] * p[idx[c]] * beta[j]
            live = gain.any(1)
            np.add.at(seen, idx[c, live], gain[live])


@dataclass
class Model:
    """langs' piece probabilities, and behind them the background's."""

    langs: list[str]
    lattice: Lattice
    p: np.ndarray
    temperature: float = 1.0

    @classmethod
    def of(cls, langs: list[str], lattice: Lattice, p: np.ndarray) -> Model:
        return cls(langs, lattice, np.hstack([p, start(lattice, 1)]))

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.p.shape[1]))
        for own, n, arcs, idx in self.lattice.arcs(words):
            out[own] = np.log(np.maximum(forward(self.p, n, arcs, idx)[n], 1e-300))
        return out

    def totals(self, texts: Iterator[str | None]) -> Iterator[np.ndarray | None]:
        """Log-likelihood of each text in each language and the background; None without a letter."""
        cache: dict[str, int] = {}
        table = np.empty((0, self.p.shape[1]))
        held: list[Counter] = []
        size = 0

        def flush() -> list[np.ndarray | None]:
            nonlocal cache, table
            if len(cache) > CACHE_WORDS:
                cache, table = {}, table[:0]
            fresh = list({w for c in held for w in c if w not in cache})
            cache.update((w, len(table) + k) for k, w in enumerate(fresh))
            table = np.concatenate([table, self.word_scores(fresh)]) if fresh else table
            out: list[np.ndarray | None] = []
            for c in held:
                if not c or not self.langs:
                    out.append(None)
                    continue
                rows = np.fromiter(map(cache.__getitem__, c), dtype=np.int64, count=len(c))
                out.append(np.fromiter(c.values(), dtype=float, count=len(c)) @ table[rows])
            return out

        for text in texts:
            held.append(words_of(text or ""))
            size += len(held[-1])
            if size >= BATCH_WORDS:
                yield from flush()
                held, size = [], 0
        yield from flush()

    def predict(self, texts: Iterator[str | None]) -> Iterator[tuple[str, float]]:
        """(language, posterior) of each text; ("und", 0.0) without a letter."""
        for total in self.totals(texts):
            if total is None:
                yield "und", 0.0
            else:
                best = int(total[:-1].argmax())
                yield self.langs[best], float(1 / np.exp(np.minimum((total - total[best]) / self.temperature, 700)).sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for w, n in words_of(text.as_py() or "").items():
                total[lang, w] += n
        langs, words = zip(*total, strict=True) if total else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(total.values(), pa.int64())],
            ["lang", "word", "n"],
        )


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    """True where crc32 of the id's text is divisible by five; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def _losses(model: Model):  # noqa: ANN202
    """Of labelled texts, the loss (negative log posterior of the label) at each temperature, summed by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for lang, total in zip(batch.column(0).to_pylist(), model.totals(t.as_py() for t in batch.column(1)), strict=True):
                if total is not None and lang in model.langs:
                    own = (total - total[model.langs.index(lang)])[None, :] / np.array(TEMPERATURES, dtype=float)[:, None]
                    loss += np.logaddexp.reduce(own, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(TEMPERATURES))), pa.array(loss)], ["at", "loss"])

    return run


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def sampled(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the sample: rows with all three that are not held out, by TRAIN_ROWS, TRAIN_BYTES and LEAST_ROWS."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = checkpoint(rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")))
    labels = sizes.count()
    by_size = F.least(TRAIN_ROWS / F.col("rows"), F.lit(TRAIN_BYTES / max(labels, 1)) / F.greatest("bytes", F.lit(1)))
    shares = sizes.select("lang", F.greatest(LEAST_ROWS / F.col("rows"), by_size).alias("share"))
    rows = rows.join(F.broadcast(shares) if labels <= BROADCAST_LABELS else shares, "lang")
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("doc_id", "text", "lang")


def train(docs: DataFrame, pieces: list[str] | None = None) -> Model:
    """Learn from the rows with an id, a text and a label that are not held out."""
    lattice = Lattice.of(public_vocabulary() if pieces is None else pieces)
    sample = sampled(docs)
    counts = checkpoint(sample.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # a label without a word cannot be learned
    if not langs:
        return Model.of([], lattice, np.zeros((lattice.size, 0)))
    number = docs.sparkSession.createDataFrame(list(zip(langs, range(len(langs)), strict=True)), "lang string, at int")
    words = counts.join(number if len(langs) > BROADCAST_LABELS else F.broadcast(number), "lang").groupBy("word").agg(F.collect_list(F.struct("at", "n")).alias("ns"))
    model = Model.of(langs, lattice, fit(lattice, checkpoint(words.repartition(FIT_TASKS, "word")), len(langs)))
    own = sample.where(_fold() == 1).select("lang", "text").mapInArrow(_losses(model), "at long, loss double")
    loss = {r["at"]: r["loss"] for r in own.groupBy("at").agg(F.sum("loss").alias("loss")).collect()}
    model.temperature = float(min(TEMPERATURES, key=lambda t: (loss.get(TEMPERATURES.index(t), 0.0), t)))
    return model


def _predictor(model: Model, text_at: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(model.predict(t.as_py() for t in batch.column(text_at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return run


def label(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` plus lang_pred and score (0 to 1), in one narrow pass.

    Null texts and texts without a letter are ``und`` with score 0, and so is all where
    nothing could be learned. Repeated rows stay; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    model = model or train(docs)
    text_at = [c.lower() for c in docs.columns].index("text")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(_predictor(model, text_at), schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs(doc_id, text, lang)``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return label(own, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
