"""Quality rules by distribution divergence, natively.

A document's histogram of character classes and its histogram of common words are compared
with each language's reference by Jensen-Shannon distance (base 2, so 0 to 1); the nearest
language counts. Short documents have noisy histograms: the word rule only judges from
``MIN_WORDS`` words on, the class rule from ``MIN_CHARS`` characters on.

Text is scanned by few passes: what is not a lower-case or non-ASCII letter is cut out once and the classes are
counted in that fifth of the text; the common words are picked out once, and only those that occur are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 100
MIN_CHARS = 200
#: Halfway between the 99.5th percentile of the documents labelled good and the 0.5th of those labelled bad, at sf0.1.
MAX_CLASS_DISTANCE = 0.155
MAX_WORD_DISTANCE = 0.42

#: Zipf-Mandelbrot law of a word's share by its rank: C / (rank + SHIFT), all listed words together making up LISTED.
SHIFT, LISTED = 2.7, 0.45


@dataclass(frozen=True)
class Language:
    """Reference of one language: letters and capitals of a word, and its common words by rank."""

    letters: float
    capitals: float
    words: str

    @property
    def common(self) -> list[str]:
        return self.words.split()

    def word_shares(self) -> list[float]:
        """Shares of the common words by rank, and of all others together."""
        weight = [1 / (rank + SHIFT) for rank in range(1, len(self.common) + 1)]
        return [*(round(LISTED * w / sum(weight), 6) for w in weight), round(1 - LISTED, 6)]

    def class_shares(self) -> list[float]:
        """Shares of lower-case or non-ASCII letters, capitals, digits, white space, punctuation, other ASCII characters.

        Of prose with a space, 0.13 punctuation marks (a sentence's end and 1.3 more every 18
        words), 0.03 digits and 0.005 other characters to a word.
        """
        per_word = [self.letters - self.capitals, self.capitals, 0.03, 1.0, 0.13, 0.005]
        return [round(x / sum(per_word), 6) for x in per_word]


#: Mean letters and capitals of a word in newspaper prose, and the fifty most frequent words by
#: rank, as public frequency lists have them.
LANGUAGES = {
    "de": Language(6.0, 0.33, """der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
        wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur"""),
    "en": Language(4.8, 0.13, """the of and to a in is that it for was on with as be by at are this from or have an not but had his they which you
        one all were there would their we him been has when who will more no if out so said what"""),
    "es": Language(4.9, 0.11, """de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si
        sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está"""),
    "fr": Language(5.0, 0.12, """de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou
        cette ont sa mais comme on tout nous été leur elle deux ses ces même ils y peut fait après"""),
}
_SPACE = r"\x09-\x0D\x20"
#: Classes after the first (lower-case and non-ASCII letters) and the white space, as sets of characters.
CLASSES = {"capitals": "A-Z", "digits": "0-9", "marks": ".,;:!?'\"()\\-", "symbols": "#*$%&|<>"}


def count_of(text: Column, kind: str) -> Column:
    """Code points of a character class."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


_HASHES = "CASE WHEN size(q_words) > 2 THEN transform(sequence(0, size(q_words) - 3), i -> xxhash64(q_words[i], q_words[i + 1], q_words[i + 2])) END"
#: The 3-word windows' hashes with their positions, sorted.
_SORTED = "sort_array(transform(q_hashes, (h, i) -> struct(h, i)))"
#: Positions of windows that have the words of the one sorted before or behind them, in text order.
_REPEATED = (
    "sort_array(transform(filter(q_sorted, (x, j) -> (j > 0 AND get(q_sorted, j - 1).h = x.h AND slice(q_words, get(q_sorted, j - 1).i + 1, 3) = slice(q_words, x.i + 1, 3)) "
    "OR coalesce(get(q_sorted, j + 1).h = x.h AND slice(q_words, get(q_sorted, j + 1).i + 1, 3) = slice(q_words, x.i + 1, 3), false)), x -> x.i))"
)
#: Each repeated window adds the words that the one before has not covered.
_COVERED = (
    f"coalesce(aggregate({_REPEATED}, struct(-3 AS last, 0L AS n), "
    "(a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n), 0L)"
)


def js_distance(counts: str, shares: list[float], total: str) -> Column:
    """Jensen-Shannon distance of an array of counts, over a total, from reference shares."""
    reference = f"array({', '.join(f'{q!r}D' for q in shares)})"
    p, m = f"(n / {total})", f"((n / {total} + q) / 2)"
    term = f"CASE WHEN n > 0 THEN {p} * log2({p} / {m}) ELSE 0D END + q * log2(q / {m})"
    return F.expr(f"sqrt(greatest(aggregate(zip_with({counts}, {reference}, (n, q) -> {term}), 0D, (a, x) -> a + x) / 2, 0D))")


#: Each common word that occurs, with its count: as many as the array loses without it.
_COUNTED = "transform(array_distinct(q_common), w -> struct(w, CAST(size(q_common) - size(array_remove(q_common, w)) AS BIGINT) AS n))"


def word_distance(language: Language) -> Column:
    """Jensen-Shannon distance of the common words' counts q_counts, and of all other words, over n_words.

    A word that does not occur adds its reference share, so only those that do are gone through.
    """
    *shares, other = language.word_shares()
    total = "greatest(n_words, 1L)"
    share = f"map({', '.join(f"'{w}', {q!r}D" for w, q in zip(language.common, shares, strict=True))})"
    both = lambda n, q: f"({n} / {total} * log2({n} / {total} / (({n} / {total} + {q}) / 2)) + {q} * log2({q} / (({n} / {total} + {q}) / 2)))"
    known = f"filter(transform(q_counts, x -> struct(x.n AS n, try_element_at({share}, x.w) AS q)), x -> x.q IS NOT NULL)"
    step = f"(a, x) -> named_struct('d', a.d + {both('x.n', 'x.q')}, 'q', a.q + x.q, 'n', a.n + x.n)"
    rest = f"(CASE WHEN n_words > a.n THEN {both('(n_words - a.n)', f'{other!r}D')} ELSE {other!r}D END)"
    return F.expr(f"aggregate({known}, named_struct('d', 0D, 'q', 0D, 'n', 0L), {step}, a -> sqrt(greatest((a.d + {sum(shares)!r}D - a.q + {rest}) / 2, 0D)))")


def judged(docs: DataFrame, languages: dict[str, Language] | None = None) -> DataFrame:
    """``docs`` plus the rules' measures, base_failed and kept, without a shuffle.

    A null text has no words (and fails the base rules), as has an empty one. Rows are judged
    each by itself, so repeated rows and ties change nothing; an empty table gives no rows.
    The reference languages are those given; a label is not looked at.
    """
    languages = LANGUAGES if languages is None else languages
    text = F.col("q_text")
    every = sorted({w for x in languages.values() for w in x.common})
    staged = docs.withColumn("q_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    staged = staged.withColumns({
        "q_words": F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != ""),
        "q_rest": F.regexp_replace(text, r"[a-z\x{80}-\x{10FFFF}]+", ""),
        "q_chars": F.length(text).cast("long"),
        "n_dup_lines": duplicate_lines(text).cast("long"),
    })
    staged = staged.withColumns({
        "q_hashes": F.expr(_HASHES),
        "q_bare": F.regexp_replace("q_rest", f"[{_SPACE}]+", ""),
        "q_common": F.filter(F.transform("q_words", lambda w: F.lower(w)), lambda w: w.isin(every)),
        "n_words": F.size("q_words").cast("long"),
    })
    staged = staged.withColumns({
        "q_sorted": F.expr(f"CASE WHEN size(array_distinct(q_hashes)) < size(q_hashes) THEN {_SORTED} END"),
        **{f"q_{k}": count_of(F.col("q_bare"), c).cast("long") for k, c in CLASSES.items()},
        "q_space": (F.length("q_rest") - F.length("q_bare")).cast("long"),
        "q_counts": F.expr(_COUNTED),
    })
    staged = staged.withColumns({
        "word_chars": F.col("q_chars") - F.col("q_space"),
        "n_symbols": F.col("q_symbols"),
        "n_repeat_words": F.expr(_COVERED),
        "q_classes": F.expr(
            "array(q_chars - length(q_rest), q_capitals, q_digits, q_space, q_marks, length(q_rest) - q_space - q_capitals - q_digits - q_marks)"
        ),
    })
    by_class = [js_distance("q_classes", x.class_shares(), "greatest(q_chars, 1L)") for x in languages.values()]
    by_word = [word_distance(x) for x in languages.values()]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        staged.withColumns({"class_distance": F.round(F.least(*by_class), 6), "word_distance": F.round(F.least(*by_word), 6), "base_failed": failed})
        .withColumn("kept", ~F.col("base_failed")
            & ((F.col("q_chars") < MIN_CHARS) | (F.col("class_distance") <= MAX_CLASS_DISTANCE))
            & ((F.col("n_words") < MIN_WORDS) | (F.col("word_distance") <= MAX_WORD_DISTANCE)))
        .drop("q_text", "q_words", "q_hashes", "q_sorted", "q_common", "q_chars", "q_rest", "q_bare", "q_space", "q_classes", "q_counts", *[f"q_{k}" for k in CLASSES])
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every whole text of ``docs(doc_id, text)``."""
    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *MEASURES)


def oracle_sql() -> str:
    """The same over explicit windows, lines and words."""

    def distance(counts: str, shares: list[float], total: str) -> str:
        p, m = f"(x.n / {total})", f"((x.n / {total} + x.q) / 2)"
        zipped = f"list_transform(range(1, {len(shares) + 1}), lambda i: {{'n': list_extract({counts}, i)::DOUBLE, 'q': list_extract([{', '.join(map(repr, shares))}], i)::DOUBLE}})"
        return f"sqrt(greatest(list_sum(list_transform({zipped}, lambda x: CASE WHEN x.n > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + x.q * log2(x.q / {m}))) / 2, 0))"

    java = lambda c: c.replace("'", "''")
    counts = ", ".join(f"length(regexp_replace(t, '[^{java(c)}]+', '', 'g')) q_{k}" for k, c in CLASSES.items())
    words = ", ".join(f"list_transform([{', '.join(repr(w) for w in x.common)}], lambda w: len(list_filter(low, lambda v: v = w))) in_{k}" for k, x in LANGUAGES.items())
    by_class = ", ".join(distance("classes", x.class_shares(), "greatest(q_chars, 1)") for x in LANGUAGES.values())
    by_word = ", ".join(distance(f"list_append(in_{k}, n_words - list_sum(in_{k}))", x.word_shares(), "greatest(n_words, 1)") for k, x in LANGUAGES.items())
    return f"""WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
        g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] v FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
        p AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, v) > 1),
        r AS (SELECT rid, count(DISTINCT i + o) n FROM p, (SELECT unnest([0, 1, 2]) o) GROUP BY rid),
        m AS (SELECT doc_id, length(t) q_chars, len(ws) n_words, coalesce(n, 0) n_repeat_words, len(ls) - len(list_distinct(ls)) n_dup_lines,
            length(regexp_replace(t, '[a-z\\x{{80}}-\\x{{10FFFF}}]+', '', 'g')) q_rest, length(regexp_replace(t, '[^{_SPACE}]+', '', 'g')) q_space, {counts}, {words}
            FROM (SELECT *, list_transform(ws, lambda x: lower(x)) low FROM w LEFT JOIN r USING (rid))),
        c AS (SELECT *, [q_chars - q_rest, q_capitals, q_digits, q_space, q_marks, q_rest - q_space - q_capitals - q_digits - q_marks] classes FROM m),
        j AS (SELECT *, round(least({by_class}), 6) class_distance, round(least({by_word}), 6) word_distance, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM c)
        SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(q_chars - q_space AS BIGINT) word_chars, CAST(q_symbols AS BIGINT) n_symbols, CAST(n_dup_lines AS BIGINT) n_dup_lines,
            CAST(n_repeat_words AS BIGINT) n_repeat_words, class_distance, word_distance, base_failed,
            NOT base_failed AND (q_chars < {MIN_CHARS} OR class_distance <= {MAX_CLASS_DISTANCE}) AND (n_words < {MIN_WORDS} OR word_distance <= {MAX_WORD_DISTANCE}) kept
        FROM j"""
