"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so all anagrams share it and one
letter more, less or other moves it by that letter's value, or by the difference of two. A letter less
leaves a *residue*: words one insertion apart meet where the residue of the longer is the key of the
shorter, words one replacement apart where they have a residue in common. That takes a row
per different letter of a word, not one per pair of letters of the alphabet, and no pair of anagrams is ever
built: residues that only one key has go first, on integers alone; what is left is joined on residue
*and* the letters that remain in their order (and the place of the gap, for a replacement), which verifies
a link as it is found. A group of such a join is bounded by the alphabet.

Words are any length: past ``WHOLE`` letters an order of letters goes by a hash of 127 bits, built for all
gaps in one pass, and the word by its SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import checkpoint

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is so many times as frequent as its variant.
RATIO = 10
POWER = 5
#: A run whose hash this divides loses a letter.
EVERY = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYS = (1 << 61) - 1
WHOLE = 64
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of all texts that are long and frequent enough."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    gap = (h % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), gap), F.col("run").substr(gap + 2, F.length("run")))
    words = runs.select(F.when(h % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _value(letter: str) -> int:
    return ord(letter) ** POWER % _KEYS


def key_of(word: str) -> int:
    return sum(map(_value, word)) % _KEYS


def rests(word: str) -> list[str]:
    """What remains in order without each letter: the text itself, or its hash where that would be long."""
    n = len(word)
    if n <= WHOLE + 1:
        return [word[:i] + word[i + 1 :] for i in range(n)]
    behind, power = [0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        power[n - i] = power[n - i - 1] * _BASE % _PRIME
        behind[i] = (ord(word[i]) * power[n - i - 1] + behind[i + 1]) % _PRIME
    out, before = [], 0
    for i in range(n):
        out.append(f"{n - 1}:{(before * power[n - 1 - i] + behind[i + 1]) % _PRIME:x}")
        before = (before * _BASE + ord(word[i])) % _PRIME
    return out


def order_of(word: str) -> str:
    """The word in the same terms as ``rests``."""
    if len(word) <= WHOLE:
        return word
    h = 0
    for c in word:
        h = (h * _BASE + ord(c)) % _PRIME
    return f"{len(word)}:{h:x}"


def _residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(residue, key): a word's key, and what is left of it without each of its letters."""
    for batch in batches:
        left, keys = [], []
        for word in batch.column(0).to_pylist():
            key = key_of(word)
            own = [key, *((key - _value(c)) % _KEYS for c in set(word))]
            left += own
            keys += [key] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(keys, pa.int64())], ["residue", "key"])


_ENTRY = "id string, n long, residue long, rest string, gap long, fresh boolean"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (word, id, n): the whole word (gap -1) and the word without each letter; ``fresh`` where that differs from the gap before."""
    names = ["id", "n", "residue", "rest", "gap", "fresh"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for word, id_, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            key = key_of(word)
            rows = [(id_, n, key, order_of(word), -1, True)]
            rows += ((id_, n, (key - _value(c)) % _KEYS, rest, i, i == 0 or word[i - 1] != c) for i, (c, rest) in enumerate(zip(word, rests(word), strict=True)))
            for col, values in zip(cols, zip(*rows, strict=True), strict=True):
                col.extend(values)
            if len(cols[0]) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
                cols = [[] for _ in names]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def links(words: DataFrame) -> DataFrame:
    """(id, n, near, near_n) in both directions for all words of ``words(word, id, n)`` that are one letter apart."""
    residues = words.select("word").mapInArrow(_residues, "residue long, key long")
    shared = residues.groupBy("residue").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("residue")
    entries = words.select("word", "id", "n").mapInArrow(_entries, _ENTRY)
    entries = checkpoint(entries.join(checkpoint(shared), "residue", "left_semi"))
    near = entries.select(*(F.col(c).alias(f"near_{c}") for c in entries.columns))
    met = (F.col("residue") == F.col("near_residue")) & (F.col("rest") == F.col("near_rest"))
    pair = [F.col("id"), F.col("n"), F.col("near_id").alias("near"), F.col("near_n")]
    other = entries.where("gap >= 0").join(near.where("near_gap >= 0"), met & (F.col("gap") == F.col("near_gap")) & (F.col("id") != F.col("near_id"))).select(*pair)
    longer = entries.where("gap >= 0 and fresh").join(near.where("near_gap < 0"), met).select(*pair)
    shorter = longer.select(F.col("near").alias("id"), F.col("near_n").alias("n"), F.col("id").alias("near"), F.col("n").alias("near_n"))
    return checkpoint(other.unionByName(longer).unionByName(shorter))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for ``forms(id, form)``: the last form, by doubling; each is at least RATIO times as frequent, so there is no cycle."""
    now = forms.select("id", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = checkpoint(now.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.select("id", "root")
        if not step.where("moved").head(1):
            return now


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of ``docs(doc_id, text)``: word, form, root, n, n_near, form_n.

    A null text has no words; a null doc_id counts as an empty one. Repeated rows count as often as they come;
    texts without a letter and empty tables give no rows. Of near words with equal counts the first in code-point order
    is the form. Words may have any length. Other columns are ignored.
    """
    id_ = F.when(F.length("word") <= WHOLE, F.col("word")).otherwise(F.sha2("word", 256))
    words = checkpoint(counted(docs).select("word", id_.alias("id"), "n"))
    near = links(words)
    per = checkpoint(near.groupBy("id", "n").agg(F.count("*").alias("n_near"), F.max("near_n").alias("best")))
    strong = per.where(F.col("best") >= RATIO * F.col("n")).select("id", "best")
    tied = near.join(strong, "id").where("near_n = best").select("id", F.col("near").alias("near_id"), "best")
    named = words.select(F.col("id").alias("near_id"), F.col("word").alias("near_word"))
    best = F.min_by("near_id", "near_word").alias("form_id"), F.min("near_word").alias("form"), F.max("best").alias("form_n")
    forms = checkpoint(tied.join(named, "near_id").groupBy("id").agg(*best))
    last = roots(forms.select("id", F.col("form_id").alias("form")))
    last = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    formed = forms.join(last, "id").select("id", "form", "form_n", "root_word")
    return (
        words.join(per.select("id", "n_near"), "id", "left").join(formed, "id", "left")
        .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )


def oracle_sql() -> str:
    """The rule in DuckDB SQL, with the CRC written out: words without each letter meet, whatever their keys."""
    step = "xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])"
    bits = "list_reduce(list_value(k, 0, 0, 0, 0, 0, 0, 0, 0), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY k) AS crc_table FROM (SELECT k, {bits} AS v FROM (SELECT unnest(range(256)) AS k))),
runs AS (
    SELECT translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')), '{UPPER}', '{LOWER}') AS run, coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
seen AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
bytes AS (
    SELECT id, run, n, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))) AS octets FROM seen),
hashed AS (SELECT id, run, n, xor(list_reduce(octets, lambda a, b: {step}), 4294967295) AS h FROM bytes, crc),
cut AS (
    SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
gaps AS MATERIALIZED (
    SELECT word, n, gap, substr(word, 1, gap) || substr(word, gap + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS gap FROM words)),
longer AS (SELECT DISTINCT g.word, g.n, w.word AS near, w.n AS near_n FROM gaps g JOIN words w ON g.rest = w.word),
near AS MATERIALIZED (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.gap = b.gap AND a.word <> b.word
    UNION ALL SELECT * FROM longer UNION ALL SELECT near, near_n, word, n FROM longer),
per AS (SELECT word, count(*) AS n_near, max(near_n) AS best FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT near.word, min(near.near) AS form, max(best) AS form_n FROM near JOIN per ON per.word = near.word AND near.near_n = per.best WHERE best >= {RATIO} * n GROUP BY near.word),
way AS (SELECT word, form AS here, 1 AS steps FROM forms UNION ALL SELECT way.word, forms.form, steps + 1 FROM way JOIN forms ON forms.word = way.here),
ends AS (SELECT word, max_by(here, steps) AS root FROM way GROUP BY word)
SELECT words.word, form, coalesce(root, words.word) AS root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM words LEFT JOIN per ON per.word = words.word LEFT JOIN forms ON forms.word = words.word LEFT JOIN ends ON ends.word = words.word"""
