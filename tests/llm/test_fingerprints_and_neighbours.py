"""Phrase fingerprints, hard negatives and spelling variants against brute force, with odd rows."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom.llm import negatives, phrases, queries, spelling

SF = "/root/testdata/sf0.001"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- op11


def lz_set(text):
    seen, begin = set(), 0
    for end in range(1, len(text) + 1):
        if text[begin:end] not in seen:
            seen.add(text[begin:end])
            begin = end
    return seen


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "straße", "漢字", "x", "of", "the"]) + str(rng.randint(0, 9)) for _ in range(n))
    rows = [(i, say(rng.randint(0, 60))) for i in range(0, 80, 2)]
    rows += [(81, None), (83, ""), (85, "a"), (87, "ab"), (89, "a" * 5000), (91, "😀é" * 700), (93, say(4000))]
    rows += [(40, rows[20][1])] * 5 + [(40, "other text of forty"), (None, "no id"), (None, "no id"), (None, None), (-(2**62), "lowest")]
    return rows


DOCS = "doc_id long, text string, fingerprint string, part int, key string, guest string, times string, digest long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(*r, "f", 1, "k", "g", "t", 5) for r in texts()], DOCS).repartition(3)


def expected(spark, rows):
    digest = {r.text: r.d for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) d").collect()}
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] if r[0] is not None else -(2**63), digest[r[1]]), reverse=True)
    out = []
    for k, (i, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + other[:m]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), lz_set(text), lz_set(edited), lz_set(other)))
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_neighbours(spark, documents, monkeypatch, broadcast):
    monkeypatch.setattr(phrases, "BROADCAST_KEYS", broadcast)
    want = sorted(expected(spark, texts()), key=lambda r: repr(r[:3]))
    rows = sorted(map(tuple, phrases.neighbours(documents).collect()), key=lambda r: repr(r[:3]))
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    for row, (*_, own, edited, other) in zip(rows, want, strict=True):
        for sets, near in (((own, edited), row[5]), ((own, other), row[6])):
            size = len(sets[0] | sets[1])
            assert near == pytest.approx(jaccard(*sets), abs=1e-12 if size <= phrases.SLOTS else 0.2)
        assert len(row[3]) == phrases.DIGITS * min(len(own), phrases.SLOTS) and len(row[4]) == phrases.DIGITS * min(len(edited), phrases.SLOTS)
    error = [r[k] - jaccard(w[3], w[4 + k - 5]) for r, w in zip(rows, want, strict=True) for k in (5, 6)]
    assert abs(np.mean(error)) < 0.02


def test_neighbours_of_few_rows(spark, documents):
    assert got(phrases.neighbours(documents.limit(0))) == [] == got(phrases.fingerprints(documents.limit(0)))
    one = spark.createDataFrame([(5, "abcabcabc")], "doc_id long, text string")
    ((i, n, sha, a, b, edited, next_),) = got(phrases.neighbours(one))
    assert (i, n, sha, next_) == (5, 9, hashlib.sha256(b"abcabcabc").hexdigest(), 1.0) and a == b and edited == 1.0
    same = got(phrases.neighbours(one.unionByName(one).unionByName(one)))
    assert len(same) == 3 and len(set(same)) == 1


def test_fingerprints_are_those_of_neighbours_and_compare(spark, documents):
    a = {(r.doc_id, r.n_chars, r.fingerprint) for r in phrases.neighbours(documents).collect()}
    own = phrases.fingerprints(documents)
    assert a == {(r.doc_id, r.n_chars, r.fingerprint) for r in own.collect()}
    assert all(r.n_phrases == len(lz_set(t or "")) for r in own.collect() for i, t in texts() if i == r.doc_id and i not in (40, None))
    pair = own.where("doc_id = 4").select("fingerprint").withColumnRenamed("fingerprint", "a").crossJoin(own.where("doc_id = 6").select("fingerprint"))
    sets = [lz_set(dict(texts())[k]) for k in (4, 6)]
    near = pair.select(phrases.likeness("a", "fingerprint").alias("n"), phrases.likeness("a", "a").alias("s")).first()
    assert near.s == 1.0 and near.n == pytest.approx(jaccard(*sets), abs=0.2)


def test_hot_id_is_split_by_digest_in_order():
    cuts = np.array([3, 7, 7, 7, 9])
    d = np.array([-(2**63), -1, 0, 2**63 - 1])
    parts = phrases._part(cuts, np.full(4, 7), d)
    assert list(parts) == sorted(parts) and parts[0] == 1 and parts[-1] == 4
    assert list(phrases._part(cuts, np.array([2, 3, 5, 8, 9, 10]), np.full(6, 2**63 - 1))) == [0, 1, 1, 4, 5, 5]


def test_op11_on_the_table(spark):
    rows = queries.queries()["op11_phrase_fingerprints"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


# --- op12

EMBEDDINGS = "vec_id long, embedding array<double>, label int, v string, win int, score double, rank int"


def vectors(rng, n=420, dim=6):
    rows = [[i, [rng.choice([-1, 1]) * rng.randint(0, 64) / 128 + 0.001 for _ in range(dim)], rng.randint(0, 9)] for i in range(n)]
    for r in rows[50:190]:
        r[1] = rows[0][1]  # a hot vector: all scores tie
    for r in rows[:300]:
        r[2] = 3 if rng.random() < 0.3 else r[2]
    rows[30][1], rows[31][1], rows[32][1], rows[33][2] = None, [None] * dim, [math.nan] * dim, None
    rows[34][1], rows[35][1] = [math.inf] * dim, [0.0] * dim
    return [tuple(r) for r in rows]


def test_hard_negatives(spark, monkeypatch):
    rows = vectors(random.Random(9))
    frame = pd.DataFrame([r[:3] for r in rows], columns=["vec_id", "embedding", "label"]).astype({"label": "Int32"})
    duck = duckdb.connect()
    duck.register("frame", frame)
    duck.sql("CREATE VIEW embeddings AS SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM frame")
    want = sorted(duck.sql(negatives.oracle_sql()).fetchall(), key=repr)
    assert len(want) > 60
    table = spark.createDataFrame([(*r, "v", 1, 0.5, 9) for r in rows], EMBEDDINGS).repartition(3)
    assert got(negatives.mined(table)) == want
    for name, value in (("BUCKETS", 4), ("BLOCK", 2), ("TILE", 1), ("HELD", 8)):
        monkeypatch.setattr(negatives, name, value)
    assert got(negatives.mined(table)) == want
    again = table.unionByName(table.where("vec_id < 120")).unionByName(spark.createDataFrame([(None, [1.0], 1, "v", 1, 0.5, 9)], EMBEDDINGS))
    assert got(negatives.mined(again)) == want


def test_hard_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], EMBEDDINGS)
    assert got(negatives.mined(empty)) == []
    alone = spark.createDataFrame([(100, [1.0, 2.0], 1, "v", 1, 0.5, 9), (101, [], 1, "v", 1, 0.5, 9), (102, [9.0], 2, "v", 1, 0.5, 9)], EMBEDDINGS)
    assert got(negatives.mined(alone)) == []
    huge = spark.createDataFrame([(100, [1e300, 1.0], 1, "v", 1, 0.5, 9), (101, [70_000.0], 1, "v", 1, 0.5, 9), (102, [40_000.0, 5.0], 2, "v", 1, 0.5, 9)], EMBEDDINGS)
    top = negatives.LIMIT
    assert got(negatives.mined(huge)) == [(100, 101, 1, 102, top * top, 256 * 40_000 * top + 256 * 1280)]


# --- op13


def counted_words(rows):
    counts = {}
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] = counts.get(word, 0) + 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = counted_words(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_apart(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spellings():
    rng = random.Random(4)
    rows = []
    for stem, times in (("connection", 1), ("Überlegungen", 1), ("aaaaaaaa", 1), ("x" * 64 + "yz", 1), ("ab" * 100, 1), ("listens", 1), ("Élément×s", 1)):
        words = [stem] * (250 * times)
        for k in range(60):
            w = list(stem)
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [w[i], rng.choice("abcé")], [rng.choice("abxé")], [w[i], w[i]]])
            words += ["".join(w)] * rng.choice([1, 2, 3, 20])
            if k % 10 == 0:
                w.insert(0, "q")
                words += ["".join(w)] * 2
        rng.shuffle(words)
        rows += [(rng.randint(0, 10**6), " ".join(words[i : i + 40]) + rng.choice([".", "", "1", "\n"])) for i in range(0, len(words), 40)]
    anagrams = ["".join(rng.sample("listens", 7)) for _ in range(400)] * 2
    return rows + [(1, " ".join(anagrams)), (None, "connectiom connectiom"), (5, None), (6, ""), (7, "123 漢字"), (8, "Abcdefg" * 30 + " abcdef abcdefg abcdefg")]


def test_spelling_variants(spark):
    rows = spellings()
    rows += rows[:3]
    docs = spark.createDataFrame([(*r, 1, "w", "r") for r in rows], "doc_id long, text string, n int, word string, root string").repartition(3)
    have, want = got(spelling.variants(docs)), brute(rows)
    assert have == want
    assert sum(r[1] is not None for r in want) > 100 and any(r[1] != r[2] for r in want if r[1]) and any(len(r[0]) > 65 and r[1] for r in want)
    assert got(spelling.variants(docs.limit(0))) == []


def test_rests_of_long_words_match_their_short_forms():
    word = "abcdefghij" * 9
    for i, rest in enumerate(spelling.rests(word)):
        assert rest == spelling.order_of(word[:i] + word[i + 1 :])
    assert spelling.rests("a" * 65) == ["a" * 64] * 65
    assert spelling.key_of("listen") == spelling.key_of("silent") != spelling.key_of("listens")
