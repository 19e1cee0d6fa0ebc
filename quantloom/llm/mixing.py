"""Mixing sources to target weights by iterative proportional fitting, natively.

Documents are counted into cells of (source, language, topic). Raking scales the cells' token
weights to the target of each marginal in turn. A cell cannot give more tokens than it has, so its weight
is capped where its sampling probability reaches one, and after each block of rounds the weights are scaled
to their sum again: what a category cannot give goes to the others, and the expected tokens meet the budget.
``marginals`` reports target and expected share of every category. A document is kept when a
hash of its id falls below its cell's probability.

Cells are as many as combinations of categories. A few (``ONE_TASK_CELLS``) are raked in one task without an
exchange; more of them by the same windows over the marginals' keys, shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import checkpoint

#: Rounds between two rescalings, and rescalings.
ROUNDS, BLOCKS = 4, 3
#: A marginal's default target: its token share to this power, scaled to one.
TEMPERATURE = 0.5
#: Share of all tokens to keep.
BUDGET = 0.5
#: Cells that one task rakes (some 5 MB).
ONE_TASK_CELLS = 50_000
#: Cells that may be broadcast (some 2 MB); more are joined by a shuffle.
BROADCAST_CELLS = 20_000
MARGINS = ("source", "lang", "topic")
KEYS = tuple(f"mix_{m}" for m in MARGINS)

#: Words that tell a topic, in English, German, French and Spanish.
TOPICS = {
    "finance": "bank banks börse budget credit dinero economy geld income inflation invest market markets money price tax".split(),
    "health": "disease doctor gesundheit health hospital krankheit malade medicine patient patients salud therapy vaccine".split(),
    "law": "contract copyright court gesetz law legal ley license licensed licence loi recht reserved rights terms".split(),
    "politics": "election gobierno government minister parliament party policy politics president regierung vote war".split(),
    "science": "biology chemistry energy experiment física mathematics molecule physics research science theory universe wissenschaft".split(),
    "sports": "championship coach football game goal league match olympic player players score spiel sport team".split(),
    "technology": "algorithm api code computer data internet network password program secret server software token user".split(),
}
OTHER_TOPIC = "general"


def n_tokens(text: Column) -> Column:
    """Words of the text: runs of anything but ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """The topic with most of its words in the text (of equals the last by name), or none of them."""
    every = sorted({w for words in TOPICS.values() for w in words})
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-zäöüßéèíóáñ]+"), lambda w: w.isin(every))
    among = lambda own: F.size(F.filter(words, lambda w: w.isin(own)))
    counts = [F.struct(among(own).alias("n"), F.lit(name).alias("topic")) for name, own in TOPICS.items()]
    best = F.when(F.size(words) > 0, F.array_max(F.array(*counts))["topic"])
    return F.coalesce(best, F.lit(OTHER_TOPIC))


def unit_hash(key: Column) -> Column:
    """Uniform in [0, 1): the first 32 bits of the MD5 of the key's text (null: of "")."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def described(docs: DataFrame, topic_of: Column | None = None) -> DataFrame:
    """docs plus its cell (a null label is the category "-") and n_tokens."""
    return docs.withColumns({
        "mix_source": F.coalesce(F.col("source").cast("string"), F.lit("-")),
        "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("-")),
        "mix_topic": topic(F.col("text")) if topic_of is None else F.coalesce(topic_of.cast("string"), F.lit("-")),
        "mix_tokens": n_tokens(F.col("text")),
    })


def _targeted(cells: DataFrame, targets: dict[str, dict[str, float]], temperature: float) -> DataFrame:
    """Adds each marginal's target: the given weights (a category without one has none), or the tempered shares.

    A sum over categories is taken over their cells, each by its share of the category's tokens.
    """
    own = {k: F.sum("tokens").over(Window.partitionBy(k)).cast("double") for k in KEYS}
    cells = cells.withColumns({f"{k}_own": v for k, v in own.items()})
    for margin, key in zip(MARGINS, KEYS, strict=True):
        wanted = targets.get(margin)
        if wanted is None:
            cells = cells.withColumn(f"{key}_target", F.pow(f"{key}_own", F.lit(temperature)))
        else:
            rows = cells.sparkSession.createDataFrame(sorted((c, float(w)) for c, w in wanted.items()), f"{key} string, given double")
            cells = cells.join(F.broadcast(rows), key, "left").withColumn(f"{key}_target", F.coalesce("given", F.lit(0.0))).drop("given")
    cells = checkpoint(cells)
    sums = cells.agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col(f"{k}_target") * F.col("tokens") / F.col(f"{k}_own")).alias(k) for k in KEYS]).first()
    scaled = [(F.col(f"{k}_target") / F.lit(sums[k] or 1.0)).alias(f"{k}_target") for k in KEYS]
    return cells.select(*KEYS, "tokens", (F.col("tokens") / F.lit(float(sums["tokens"] or 1))).alias("share"), *scaled)


def rake(cells: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET, rounds: int = ROUNDS, blocks: int = BLOCKS) -> DataFrame:
    """cells(mix_*, tokens) plus share, the targets and weight: shares raked to the targets, share / budget at most."""
    cells = cells.where("tokens > 0")
    if cells.count() <= ONE_TASK_CELLS:
        cells = cells.repartition(1)
    fitted = _targeted(cells, targets or {}, temperature).withColumn("weight", F.col("share"))
    cap = F.col("share") / F.lit(budget)
    for _ in range(blocks):
        for _ in range(rounds):
            for key in KEYS:
                over = F.sum("weight").over(Window.partitionBy(key))
                fitted = fitted.withColumn("weight", F.when(over > 0, F.least(F.col("weight") * F.col(f"{key}_target") / over, cap)).otherwise(0.0))
        fitted = checkpoint(fitted)
        total = fitted.agg(F.sum("weight")).first()[0] or 1.0
        fitted = fitted.withColumn("weight", F.least(F.col("weight") / F.lit(total), cap))
    return fitted


def calibrate(fitted: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds prob, which makes the weight the cell's expected share of the budget's tokens."""
    return fitted.withColumn("prob", F.least(F.lit(1.0), F.col("weight") * F.lit(budget) / F.col("share")))


def marginals(fitted: DataFrame) -> DataFrame:
    """(margin, category, own, target, expected): of every category, the shares of all tokens, wanted, and expected.

    An expected share under its target is a category whose cells are taken whole.
    """
    parts = [
        fitted.groupBy(F.lit(m).alias("margin"), F.col(k).alias("category")).agg(
            F.sum("share").alias("own"), F.max(f"{k}_target").alias("target"), (F.sum("weight") / F.lit(1.0)).alias("expected")
        )
        for m, k in zip(MARGINS, KEYS, strict=True)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mixed(docs: DataFrame, *, topic_of: Column | None = None, **how: object) -> DataFrame:
    """``docs`` plus mix_source, mix_lang, mix_topic, mix_tokens, mix_prob and mix_kept.

    ``targets`` gives weights by margin and category, ``topic_of`` another topic than that of the text's words.
    A null source or language is a category of its own; a document without words has
    probability zero and is not kept. Ties do not arise: each row is judged by its own id,
    and repeated ids get one verdict. An empty table gives no rows.
    """
    return judged(described(docs.drop(*KEYS, "mix_tokens", "mix_prob", "mix_kept"), topic_of), **how)


def judged(docs: DataFrame, *, budget: float = BUDGET, **how: object) -> DataFrame:
    """Adds mix_prob and mix_kept to described documents."""
    cells = checkpoint(docs.groupBy(*KEYS).agg(F.sum("mix_tokens").alias("tokens")))
    probs = checkpoint(calibrate(rake(cells, budget=budget, **how), budget).select(*KEYS, F.col("prob").alias("mix_prob")))
    if probs.count() <= BROADCAST_CELLS:
        probs = F.broadcast(probs)
    prob = F.when(F.col("mix_tokens") > 0, F.coalesce("mix_prob", F.lit(0.0))).otherwise(0.0)
    return docs.join(probs, list(KEYS), "left").select(*docs.columns, prob.alias("mix_prob")).withColumn("mix_kept", unit_hash(F.col("doc_id")) < F.col("mix_prob"))


def mixture(docs: DataFrame) -> DataFrame:
    """Per row of documents: its cell, tokens, sampling probability and verdict."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "source", "lang")
    slim = checkpoint(described(own).select("doc_id", *KEYS, "mix_tokens"))
    return judged(slim).select(
        "doc_id",
        F.col("mix_source").alias("source"),
        F.col("mix_lang").alias("lang"),
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_prob", 6).alias("prob"),
        F.col("mix_kept").alias("kept"),
    )


def oracle_sql(rounds: int = ROUNDS, blocks: int = BLOCKS, temperature: float = TEMPERATURE, budget: float = BUDGET) -> str:
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    every = listed(sorted({w for words in TOPICS.values() for w in words}))
    best = ", ".join(f"{{'n': len(list_filter(ws, lambda w: w IN ({listed(own)}))), 'topic': '{name}'}}" for name, own in TOPICS.items())
    keys = ", ".join(KEYS)
    parts = [
        f"""d AS (SELECT doc_id, mix_source, mix_lang, mix_tokens, CASE WHEN len(ws) > 0 THEN list_max([{best}]).topic ELSE '{OTHER_TOPIC}' END mix_topic
            FROM (SELECT doc_id, coalesce(source, '-') mix_source, coalesce(lang, '-') mix_lang,
                len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) mix_tokens,
                list_filter(regexp_split_to_array(lower(t), '[^a-zäöüßéèíóáñ]+'), lambda w: w IN ({every})) ws
                FROM (SELECT *, coalesce(text, '') t FROM documents)))""",
        f"c AS (SELECT {keys}, CAST(sum(mix_tokens) AS BIGINT) tokens FROM d GROUP BY ALL HAVING sum(mix_tokens) > 0)",
        "s AS (SELECT *, tokens / sum(tokens) OVER () share FROM c)",
    ]
    for k in KEYS:
        parts.append(f"t_{k} AS (SELECT {k}, p / sum(p) OVER () {k}_target FROM (SELECT {k}, pow(sum(tokens)::DOUBLE, {temperature}) p FROM c GROUP BY 1))")
    parts.append(f"w0 AS (SELECT *, share weight FROM s {' '.join(f'JOIN t_{k} USING ({k})' for k in KEYS)})")
    n = 0
    for _ in range(blocks):
        steps = [f"weight * {k}_target / sum(weight) OVER (PARTITION BY {k})" for _ in range(rounds) for k in KEYS] + ["weight / sum(weight) OVER ()"]
        for step in steps:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (least({step}, share / {budget}) AS weight) FROM w{n})")
            n += 1
    return f"""WITH {', '.join(parts)}
        SELECT doc_id, d.mix_source AS source, d.mix_lang AS lang, d.mix_topic AS topic, CAST(mix_tokens AS BIGINT) AS n_tokens,
            round(p, 6) AS prob, CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
        FROM (SELECT d.*, coalesce(CASE WHEN mix_tokens > 0 THEN least(1.0, weight * {budget} / share) END, 0.0) p FROM d LEFT JOIN w{n} USING ({keys})) d"""
