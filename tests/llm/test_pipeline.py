"""The stages of the corpus pipeline, each against what its own input says."""

import corpus_pipeline
import pytest

from quantloom.llm import decontam, langid, mixing, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "...", "en", None, 3)], own.schema)
    return own.unionByName(odd).unionByName(own.limit(3))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "sharding"]
    now = docs
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns[:5] == corpus_pipeline.COLUMNS and (k == 4 or len(after.columns) == 5)
        seen.append((now, after))
        now = after
    before, after = seen[0]
    labels = {r.doc_id: r for r in langid.label(before.select("doc_id", "text", "lang")).collect()}
    assert set(ids(after)) == {i for i, r in labels.items() if r.lang_pred != "und" and r.score >= 0.5}
    before, after = seen[1]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
    assert ids(after) == sorted(set(groups.values()))
    before, after = seen[2]
    marked = decontam.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == ids(marked.where("not contaminated"))
    before, after = seen[3]
    assert ids(after) == ids(mixing.mixture(before).where("kept")) and 0 < after.count() < before.count()
    assert ids(seen[4][1]) == ids(seen[4][0])


def test_stages_of_nothing(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_near_dedup_takes_texts_apart_that_share_an_id(spark, monkeypatch):
    a, b = "one two three four five six seven eight nine ten " * 5, "quite another text about something else entirely " * 6
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 2), (2, b, "en", "s", 3), (3, b, "en", "s", 4), (3, b, "en", "s", 4), (None, a, "en", "s", 5), (None, None, "en", None, 6), (None, None, "en", None, 6), (4, "third thing", None, None, 7)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(corpus_pipeline.COLUMNS, ["long", "string", "string", "string", "long"], strict=True)))
    want = sorted([(1, 1), (2, 3), (None, 6), (4, 7)], key=repr)
    for most in (200_000, 0):  # broadcast and shuffled
        monkeypatch.setattr(simhash, "BROADCAST_KEYS", most)
        out = corpus_pipeline.near_dedup(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS and sorted([(r.doc_id, r.n_chars) for r in out.collect()], key=repr) == want
