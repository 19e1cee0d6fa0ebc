"""Each operator against brute force on small tables with nulls, empty and long texts, repeats and extra columns."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quantloom.llm import decontam, html, langid, licenses, mixing, quality, queries, secrets, sharding, simhash, substrings
from quantloom.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, slot int, hit_items string, lang_pred int, mix_prob string, kept string"
SF = "/root/testdata/sf0.001"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, long = say(40), say(4000)
    texts = [None, "", " \t\n", "é", "Ünï cödé 漢字 " * 20, "a", "two words", long, long + " tail", passage, *([passage] * 3)]
    for _ in range(25):
        texts.append(say(rng.randint(1, 150)) + (" " + passage if rng.random() < 0.5 else "") + "\n" + say(10))
    texts += [t.replace("e", "x", 1) for t in texts[10:20]]
    texts += ['password = "abc123DEF" token=token:abcdef', "AKIA" + "A1" * 10 + " " + "0123456789abcdef" * 2, "x" * 400, "the line\nthe line\n\nthe line"]
    texts += ["Released under the MIT License. " + say(30), say(20) + " Licensed under CC BY-NC 4.0. " + say(20)]
    rows = [(i, t, ["en", "de", None][i % 3], ["hot", "hot", None, "s"][i % 4], None, "f", 1, "h", 2, "m", "k") for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[0], (None, passage, None, None, None, "f", 1, "h", 2, "m", "k"), (None, None, None, None, None, "f", 1, "h", 2, "m", "k")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _simhash(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [min((ids[j] for j in range(len(fps)) if find(j) == find(i) and ids[j] is not None), default=None) for i in range(len(fps))]


def test_simhash(docs, rows, empty):
    fps = [_simhash(r[1]) for r in rows]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, _components(fps, [r[0] for r in rows]), strict=True)]
    assert got(simhash.near_duplicates(docs)) == sorted(want, key=repr)
    assert got(simhash.near_duplicates(empty)) == []


def test_simhash_index_finds_all_links_over_many_ranges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(60)]
    fps = sorted({*near, *range(70), *map(int, rng.integers(0, 1 << 63, 200, dtype=np.uint64))})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = _components(fps, list(range(len(fps))))
    groups = {}
    for x, c in zip(fps, want, strict=True):
        groups.setdefault(c, set()).add(x)
    for size in (1 << 16, 20):  # one range, and many
        monkeypatch.setattr(simhash, "LEAST_RANGE", size)
        monkeypatch.setattr(simhash, "MOST_RANGE", size)
        assert (simhash.ranked(df).select("part").distinct().count() > 12) == (size == 20)
        roots = {r.node % (1 << 64): r.root for r in connected_components(simhash.links(df)).collect()}
        for g in groups.values():
            assert len(g) == 1 and not (g & set(roots)) or len({roots[x] for x in g}) == 1
        assert len(set(roots.values())) == sum(len(g) > 1 for g in groups.values())


def test_simhash_index_prunes_whole_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    fps = docs.mapInArrow(simhash._fingerprints, "doc_id long, fp long").select("fp").distinct().toPandas().fp.to_numpy().view(np.uint64)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    index = simhash.GrayIndex(fps, fps)
    pairs = {p for a, b in index.search(fps, later=True) for p in zip(a.tolist(), b.tolist(), strict=True)}
    compared = sum(len(v) for v in index.value[1:])
    assert index.pruned > 100 * len(fps) and compared < len(fps)  # groups given up, of a tree smaller than its leaves
    found = simhash.joined(np.arange(len(fps)), iter([tuple(np.array(sorted(pairs)).T)]))
    for i in range(0, len(fps), 97):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= simhash.RADIUS)
        assert len({int(found[k]) for k in near}) == 1


def test_substrings(docs, rows, empty):
    first = {}
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    want = []
    for i, b in data:
        mask = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    mask[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        want.append((i, len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    for size in (300, 1 << 22):
        out = substrings.repeated_spans(docs, size)
        assert got(out.drop("spans")) == sorted(want, key=repr)
    texts = {(i, len(b)): b for i, b in data}
    for r in out.collect():
        assert hashlib.sha256(substrings.remove_spans(texts[r.doc_id, r.n_bytes], r.spans)).hexdigest() == r.kept_sha256
    assert got(substrings.deduplicate(empty)) == []


def _items(rows):
    long = rows[9][1].split()
    return [(1, " ".join(long[5:20])), (2, " ".join(long[20:32]).upper()), (30, "two words"), (4, None), (5, "..."), (None, " ".join(long[:10])), (7, "not there at all")]


def test_decontamination(spark, docs, rows, empty, monkeypatch):
    bench = spark.createDataFrame(_items(rows), "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = []
    for r in rows:
        w, hit, items = words(r[1]), set(), set()
        for item, text in _items(rows):
            v = words(text)
            for k in range(max(1, len(v) - 9) if v else 0):
                for p in range(len(w)):
                    if w[p : p + len(v[k : k + 10])] == v[k : k + 10]:
                        hit.update(range(p, p + len(v[k : k + 10])))
                        items |= {str(item)} if item is not None else set()
        want.append((r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    for block in (1 << 20, 5):  # one block, and one for nearly each item
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        assert got(decontam.decontaminate(docs, bench)) == sorted(want, key=repr)
    assert got(decontam.decontaminate(empty, bench)) == []
    assert not any(r.contaminated for r in decontam.decontaminate(docs, bench.limit(0)).collect())


def test_suffix_array_and_fm_index():
    rng = np.random.default_rng(2)
    t = np.r_[rng.integers(1, 4, 300), 0]
    assert decontam.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    index = decontam.FMIndex(t, 4)
    lo, hi = index.search([t[40:50], np.array([3, 3, 3, 3, 3, 3, 3, 3, 1])])
    where = [i for i in range(len(t)) if t[i : i + 10].tolist() == t[40:50].tolist()]
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == where


def test_secrets(docs, rows, empty):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    parts = ["token", "SECRET", "api_key", "=", ":", " ", '"', "abc", "abcdef1", "AKIA", "ABCDEFGHIJ123456", "é", "0123456789abcdef", "-", "\n", "ſ"]
    rng = random.Random(4)
    texts = [r[1] for r in rows] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    scan = secrets.scanner()
    for t in texts:
        t = t or ""
        want = [(m.start(), m.end(), 0) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [s for s in secrets.find(scan, t) if s[2] < 3] == sorted(want, key=lambda s: (s[0], s[2]))
    out = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert len(out[0].base_sha256) == 64 and out[0].spans == "" and sum(r.n_hex for r in out.values()) == 1
    assert got(secrets.scan_secrets(empty)) == []
    assert any(s[2] > 2 for s in secrets.find(scan, "x ghp_" + "a1B2" * 9 + " y"))


def _occurs(own, h):
    """Whether a run of n consecutive shingles holds enough of the template's n, tried at every start."""
    own, h = set(own.tolist()), h.tolist()
    return any(len(own & set(h[a : a + len(own)])) >= licenses.CONTAINED * len(own) for a in range(max(1, len(h) - len(own) + 1)))


def _scans(scan, texts):
    hashes = [licenses.shingle_hashes(licenses.words_of(t)) for t in texts]
    got_ = [{x for x, *_ in spans} for _, spans in scan.scan(iter(texts))]
    return got_, [{n for n, own in scan.shingles.items() if _occurs(own, h)} for h in hashes]


def test_licenses(docs, rows, empty):
    scan = licenses.Scanner()
    found, want = _scans(scan, [r[1] for r in rows])
    assert found == want
    out = [r.licenses for r in licenses.scan_licenses(docs).collect() if r.licenses]
    assert sorted(out) == ["CC-BY-NC-4.0", "MIT"]
    assert got(licenses.scan_licenses(empty)) == []
    notice = licenses.TEMPLATES["Zlib"]
    n = len(licenses.words_of(notice))
    assert scan.find(f"{notice} {notice} x")[1] == [("Zlib", 0, n), ("Zlib", n, 2 * n)]  # neighbours stay two


def test_licenses_recall_of_changed_templates(monkeypatch):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdehilnorst") for _ in range(5)) for _ in range(300)]
    scan = licenses.Scanner()
    for name, template in licenses.TEMPLATES.items():
        texts = []
        while len(texts) < 50:
            words = [w.decode() for w in licenses.words_of(template)]
            for _ in range(rng.randint(0, max(0, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join([*rng.choices(vocab, k=rng.randint(0, 400)), *words, *rng.choices(vocab, k=rng.randint(0, 90))])
            if _occurs(scan.shingles[name], licenses.shingle_hashes(licenses.words_of(text))):
                texts.append(text)
        found, want = _scans(scan, texts)
        assert all(f <= w for f, w in zip(found, want, strict=True))
        assert sum(name in f for f in found) >= 0.95 * len(texts), name
    blind = licenses.Scanner()  # without its bands the scanner finds nothing
    blind.by_size = {n: [(name, keys[:0]) for name, keys in own] for n, own in blind.by_size.items()}
    assert not any(spans for _, spans in blind.scan(iter(texts)))


def test_licenses_do_not_depend_on_the_batch(rows):
    scan = licenses.Scanner()
    texts = [r[1] for r in rows] + list(licenses.TEMPLATES.values())
    whole = list(scan.scan(iter(texts)))
    assert whole == [scan.find(t) for t in texts]
    long = " ".join([texts[9]] * 12) + licenses.TEMPLATES["MIT-text"]
    assert [x for x, *_ in scan.find(long)[1]] == ["MIT-text"]


def test_language_id(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == docs.count() and 0.1 < len(held) / len(out) < 0.3
    assert (held.lang_pred == held.lang).mean() > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 ² _", "en"), (4, "der und die " * 9, None), (4, "x" * 5000, "fr"), (None, "the of and", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    got_ = [(r.lang_pred, r.score) for r in langid.label(odd.coalesce(1), model).collect()]
    assert [g[0] for g in got_[:4]] == ["und"] * 3 + ["de"] and all(0 <= s <= 1 for _, s in got_)
    assert [r.lang_pred for r in langid.identify(odd.where("lang IS NULL")).collect()] == ["und", "und"]
    assert got(langid.identify(empty)) == []


def _likelihood(word, p, number):
    """Sum over all segmentations, one by one."""
    if not word:
        return 1.0
    head = lambda k: p[number[word[:k]]] if word[:k] in number else langid.UNKNOWN if k == 1 else 0.0
    return sum(head(k) * _likelihood(word[k:], p, number) for k in range(1, len(word) + 1))


def test_language_id_equals_brute_force(spark):
    """Fitted model, language and score of small texts, by enumeration."""
    rows = [(1, "ab ab b", "x"), (2, "ba a ba", "y"), (3, "ab b b", "x"), (4, "a ba", "y"), (5, "zz", None)]
    docs = spark.createDataFrame([(10 * i + k, t, lang) for k in range(4) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.train(docs, ["▁", "a", "b", "ab", "ba", "▁a"])
    number = model.lattice.number
    words = {lang: {} for lang in model.langs}
    for r in langid.sampled(docs).collect():
        for w in r.text.split():
            words[r.lang][w] = words[r.lang].get(w, 0) + 1
    for at, lang in enumerate(model.langs):
        p = langid.start(model.lattice, 1)[:, 0]
        for _ in range(langid.EM_ROUNDS):
            seen = np.zeros(model.lattice.size)
            for w, n in words[lang].items():
                ways = [[]] if not w else list(_ways("▁" + w, number))
                weight = [np.prod([p[k] for k in way]) for way in ways]
                for way, x in zip(ways, weight, strict=True):
                    for k in way:
                        seen[k] += n * x / sum(weight)
            p = langid.maximised(seen[:, None])[:, 0]
        assert np.allclose(p, model.p[:, at])
    for text, (lang, score) in zip(["ab", "ba ba b", "zz"], model.predict(iter(["ab", "ba ba b", "zz"])), strict=True):
        total = [sum(np.log(_likelihood("▁" + w, model.p[:, k], number)) for w in text.split()) for k in range(3)]
        assert lang == model.langs[int(np.argmax(total[:2]))]
        odds = np.exp((np.array(total) - max(total[:2])) / model.temperature)
        assert np.isclose(score, 1 / odds.sum())


def _ways(word, number):
    if not word:
        yield []
        return
    for k in range(1, len(word) + 1):
        if word[:k] in number or k == 1:
            for rest in _ways(word[k:], number):
                yield [number.get(word[:k], len(number)), *rest]


def test_language_id_accuracy_and_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    held = langid.label(docs.where(langid.held_out() & (mixing.F.length("text") > 20)), model).toPandas()
    assert len(held) > 1500 and (held.lang_pred == held.lang).mean() > 0.97
    assert abs(held.score.mean() - (held.lang_pred == held.lang).mean()) < 0.05  # what it says of itself
    strange = ["наш дом стоит у большого тихого озера " * 3, "xqzw jkvb qqxz wvkj " * 9, "το σπίτι είναι μεγάλο και η θάλασσα ήρεμη " * 3]
    assert all(score < 0.5 for _, score in model.predict(iter(strange)))


def test_language_id_learns_every_word_of_the_sample(spark, monkeypatch):
    many = " ".join(["".join(w) for w in itertools.product("abcdefghijk", repeat=5)][:130_000])
    rows = [(1, f"{many} {many}", "xx"), (2, "το σπίτι είναι μεγάλο και η θάλασσα ήρεμη", "el"), (3, "наш дом стоит у большого тихого озера", "ru"), (4, "12 34", "zz")]
    rows = [(i + 100 * k, *r) for k in range(3) for i, *r in (rows if not k else rows[1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    new = spark.createDataFrame([(1, "большой дом у озера"), (2, "η μεγάλο θάλασσα"), (3, "abcde kabcd")], "doc_id long, text string")
    for total in (langid.TRAIN_BYTES, 1):
        monkeypatch.setattr(langid, "TRAIN_BYTES", total)
        model = langid.train(docs)
        assert model.langs == ["el", "ru", "xx"]  # nothing can be learned of zz
        assert [r.lang_pred for r in langid.label(new.coalesce(1), model).collect()] == ["ru", "el", "xx"]
    monkeypatch.setattr(langid, "FIT_CELLS", 3000)  # blocks and partitions change nothing
    monkeypatch.setattr(langid, "FIT_TASKS", 3)
    assert np.allclose(langid.train(docs).p, model.p)


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice.of(["▁", "a", "b", "ab", "▁a", "ba"])
    p = np.linspace(0.05, 0.3, lattice.size)[:, None]
    p[-1] = 0
    score = langid.Model.of(["x"], lattice, p).word_scores(["aba", "b", "ac"])[:, 0]

    def total(s):
        return 1.0 if not s else sum((p[lattice.number[s[:k]], 0] if s[:k] in lattice.number else p[-2, 0] if k == 1 else 0) * total(s[k:]) for k in range(1, len(s) + 1))

    assert np.allclose(np.exp(score), [total("▁aba"), total("▁b"), total("▁ac")])


@pytest.mark.parametrize(("name", "operator"), [("op3_source_mixing", mixing.mixture), ("op4_sharding", sharding.placement), ("op6_quality_rules", quality.quality)])
def test_native_operators_equal_their_sql(docs, rows, empty, name, operator):
    c = duckdb.connect()
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())})
    c.register("documents", table)
    a, b = operator(docs).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    order = sorted(a.columns)
    a, b = (d[order].sort_values(order).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert got(operator(empty)) == []


def test_lookup_table_is_even_and_stable():
    table = sharding.lookup_table()
    counts = pd.Series(table).value_counts()
    assert len(table) == sharding.SLOTS and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b and a != sharding.SHARDS[-1] for a, b in zip(table, fewer, strict=True))
    assert moved < 0.2 * len(table)


def _cells(spark):
    return spark.createDataFrame([(s, x, t, 10 * (i + 1)) for i, (s, x, t) in enumerate((s, x, t) for s in "abc" for x in "de" for t in "pq")], "mix_source string, mix_lang string, mix_topic string, tokens long")


def test_raking_meets_its_targets(spark, monkeypatch):
    cells = _cells(spark)
    w = mixing.rake(cells, rounds=10).toPandas()
    for key in mixing.KEYS:
        own = w.groupby(key).tokens.sum() ** mixing.TEMPERATURE
        assert np.allclose(w.groupby(key).weight.sum(), own / own.sum())
    p = mixing.calibrate(mixing.rake(cells, budget=0.4), 0.4).toPandas()
    assert np.isclose((p.prob * p.tokens).sum(), 0.4 * p.tokens.sum()) and p.prob.between(0, 1).all()
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 0)  # shuffled windows change nothing
    key = list(mixing.KEYS)
    pd.testing.assert_frame_equal(mixing.rake(cells, rounds=10).toPandas().sort_values(key, ignore_index=True), w.sort_values(key, ignore_index=True))


def test_raking_to_given_targets_and_what_it_cannot_give(spark):
    targets = {"source": {"a": 1, "b": 1, "c": 2}, "lang": {"d": 0.3, "e": 0.7}}
    fitted = mixing.rake(_cells(spark), targets=targets, budget=0.3, rounds=20)
    got_ = {(r.margin, r.category): r for r in mixing.marginals(fitted).collect()}
    for k, share in {("source", "a"): 0.25, ("source", "c"): 0.5, ("lang", "e"): 0.7}.items():
        assert np.isclose(got_[k].target, share) and abs(got_[k].expected - share) < 1e-3
    # a wants more than it has: taken whole, the rest goes to the others
    short = mixing.rake(_cells(spark), targets={"source": {"a": 0.9, "b": 0.1}}, budget=0.5, blocks=20)
    got_ = {(r.margin, r.category): r for r in mixing.marginals(short).collect()}
    own = got_["source", "a"].own
    assert np.isclose(got_["source", "a"].expected, 2 * own) and got_["source", "a"].target == 0.9 and got_["source", "c"].expected == 0
    assert mixing.calibrate(short).toPandas().query("mix_source == 'a'").prob.eq(1).all()


def test_topic_of_the_words(spark):
    rows = [("The BANK and the market, and a doctor.",), ("Code: server; doctor",), ("nothing here",), (None,), ("Börse!",)]
    out = [r[0] for r in spark.createDataFrame(rows, "text string").coalesce(1).select(mixing.topic(mixing.F.col("text"))).collect()]
    assert out == ["finance", "technology", "general", "general", "finance"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav>
<article><h1>Big &amp; small</h1><p>One <b>bo</b>ld &lt;word&gt;<br>next<p>Two
 lines <div class="ad">Buy</div><section id="comments"><p>Nice</p></section></article><aside>side</aside><form>f</form><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    shared = "<body><div>Our Site</div><div>Menu</div><p>Only {0} here.</p><div>Contact us</div></body>"
    rows = [(1, "http://a.b/x/1", PAGE), (2, "http://a.b/x/2?q", None), (3, None, "<p>x"), (4, "http://c.d/1", shared.format("first")), (5, "http://C.d/2#z", shared.format("second")), (5, "http://C.d/2#z", shared.format("second")), (6, "http://c.d/9", "<p>" * 3000 + "deep"), (None, "u", "plain < text & more")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    out = [(r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect()]
    texts = {i: t for i, t, _ in out}
    assert texts == {1: "Big & small One bold <word> next Two lines", 2: "", 3: "x", 4: "Only first here.", 5: "Only second here.", 6: "deep", None: "plain < text & more"}
    assert len(out) == len(rows) and all(n == len(t) for _, t, n in out)
    assert html.extract(pages.limit(0)).collect() == []


def test_html_blocks_change_nothing(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i % 7}/{i}", f"<div>Top</div><div>{'odd' if i % 2 else 'even'}</div><p>{i}</p>") for i in range(60)], "page_id long, url string, html string")
    want = got(html.extract(pages))
    monkeypatch.setattr(html, "BLOCK", 4)
    assert got(html.extract(pages.repartition(7))) == want
    assert all("Top" not in r[2] for r in want)


def test_html_differences_lines_beside_an_article_and_takes_articles_as_evidence(spark):
    page = "<div>Site</div><article><p>{0}</p><p>Same</p></article><div>by {0}</div>"
    rows = [(1, "http://h/a/1", page.format("one")), (2, "http://h/a/2", page.format("two")), (3, "http://i/1", page.format("one")), (4, "http://i/2", "<p>Site</p><p>Same</p><p>rest</p>")]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {1: "one Same by one", 2: "two Same by two", 3: "one Same by one", 4: "rest"}


def test_html_looks_beyond_mirrors_and_empty_pages(spark, monkeypatch):
    a, b, c = ("<p>Top</p><p>{}</p>".format(x) for x in "abc")
    pages = [("/a/1", a)] + [(f"/b/{k:02}", b) for k in range(40)] + [("/c/1", ""), ("/c/2", c), ("/c/3", None), ("/c/4", c)]
    rows = [(k, f"http://h{path}", page) for k, (path, page) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for block in (512, 2):
        monkeypatch.setattr(html, "BLOCK", block)
        out = {r.page_id: r.text for r in html.extract(df).collect()}
        assert out == {k: {a: "a", b: "b", c: "c"}.get(page, "") for k, _, page in rows}


def test_html_run_takes_the_nearer_side_page_by_page(spark):
    left, own, right = "<p>L</p><p>x</p>", "<p>L</p><p>R</p><p>own</p>", "<p>R</p><p>y</p>"
    rows = [(1, "http://h/a/0", left), (2, "http://h/a/1", own), (3, "http://h/b/1", own), (4, "http://h/b/2", right)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {1: "x", 2: "R own", 3: "L own", 4: "y"}


def _extracted(rows):
    """Texts and deleted lines by the rule, page by page: nearest page of other content, LCS by table, protection, markup."""
    outline = []
    for i, url, page in rows:
        host, path = html.split_url(url)
        lines, inside, marked = html.lines_of(page)
        outline.append((host, path, i, lines, inside, marked, [x for x, m in zip(lines, marked, strict=True) if not m]))
    known = sorted((o for o in outline if o[0] is not None and o[6]), key=lambda o: o[:3])
    out = []
    for o in outline:
        host, path, i, lines, inside, marked, own = o
        gone = set()
        if o in known:
            k = known.index(o)
            before, after = known[:k][::-1], known[k + 1 :]
            left = next((x for x in before if x[0] != host or x[6] != own), None)
            right = next((x for x in after if x[0] != host or x[6] != own), None)
            left, right = (x if x and x[0] == host else None for x in (left, right))
            if left or right:
                # a run of equal content is represented by its first page
                pick = left if html.takes_before(path, left and left[1], right and right[1]) else right
                j = known.index(pick)
                while j and known[j - 1][0] == host and known[j - 1][6] == pick[6]:
                    j -= 1
                gone = {lines_k for lines_k in html.shared_lines([html._hash(x) for x in lines], [html._hash(x) for x in known[j][3]]) if not inside[lines_k]}
        out.append((i, " ".join(x for k, x in enumerate(lines) if k not in gone and not marked[k]), len(gone)))
    return sorted(out)


def test_html_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(6)]
    rows = []
    for i in range(90):
        menu = "".join(f"<li>{rng.choice(words)}</li>" for _ in range(rng.randint(0, 4)))
        text = "".join(f"<p>{rng.choice(words)} {rng.choice(words)}</p>" for _ in range(rng.randint(0, 3)))
        body = f"<article>{text}</article>" if rng.random() < 0.5 else text
        rows.append((i, rng.choice(["http://h", "https://H", "http://g"]) + "/" + rng.choice("ab") + "/" + rng.choice("abcd"), f"<nav><ul>{menu}</ul></nav><div>{rng.choice(words)}</div>{body}<footer>&copy; site · {rng.choice(words)}</footer>"))
    rows += [(90, None, "<p>x"), (91, "http://h/a/b", None), (92, "http://lone/", "<div>Site</div><p>text")]
    want = _extracted(rows)
    assert sum(n for *_, n in want) > 90 and any(not t for _, t, _ in want)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for block in (512, 3):
        monkeypatch.setattr(html, "BLOCK", block)
        assert sorted((r.page_id, r.text, r.n_shared) for r in html.extract(pages).collect()) == want


def test_html_finds_the_articles_of_the_table(spark):
    """Recall and precision against the article element's text, cut out by plain patterns."""
    import html as entities

    got_ = html.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in got_:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        plain = re.sub("<[^>]*>", " ", re.sub("</?(?:b|i|a|em|strong|span)>", "", article))
        assert r.text == " ".join(entities.unescape(plain).split())
    assert sum(r.n_shared > 0 for r in got_) > 0.9 * len(got_)


def test_html_marks_only_by_whole_names():
    page = '<div class="main-menu-story">a</div><div class="cookie-notice">b</div><div class="site-nav x">c</div><div class="article-sharing">d</div><div id="related_posts">e</div>'
    lines, _, marked = html.lines_of(page)
    assert [x for x, m in zip(lines, marked, strict=True) if not m] == ["a", "d"]


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        kept = [a[i] for i in sorted(html.shared_lines(a, b))]
        it = iter(b)
        assert len(kept) == best[-1][-1] and all(x in it for x in kept)


def test_spread_deals_out_small_tables_only(spark, tmp_path):
    from quantloom.llm.common import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert spread(one).select(mixing.F.spark_partition_id()).distinct().count() == 4 and spread(one).count() == 100
    assert spread(many) is many


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(31)) and all(out[i] == 100 for i in range(100, 140)) and out[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
