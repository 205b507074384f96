"""Top-k search, archives, toxicity and the pipeline against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelode.llm import queries, toxicity, topk_search, warc

from ..compare import same


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(120)]  # a common vector: ties
    rows += [(500, None), (501, [0.1, None] + [0.0] * 6), (502, [float("nan")] + [0.0] * 7), (503, [float("inf")] + [0.0] * 7), (504, []), (None, [0.1] * 8), (505, [0.5] * 3)]
    rows += [(550, [0.0] * 8), (50, rows[50][1])]
    return rows


def brute(rows, every, k):
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(ok):
        if q % every == 0:
            best = sorted((-int(x @ y), i) for other, (i, y) in enumerate(ok) if other != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 40])
def test_topk(spark, block, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERIES", max(3, block // 10))
    table = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1)}).repartition(4)
    out = topk_search.search(table, F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, out.collect())) == brute(vectors(), 50, 5)


def test_topk_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.search(empty, F.col("vec_id") % 50 == 0, 5).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.search(few, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 65536)]
    huge = spark.createDataFrame([(0, [1e15, 1e15]), (1, [1e15, -1e15]), (2, [3e14, 1.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r.score for r in topk_search.search(huge, F.col("vec_id") == 0, 5).collect()}
    assert rows == {1: 0, 2: 2**63 - 1}


def test_threshold_stops_early():
    rng = np.random.default_rng(3)
    x = np.floor(rng.pareto(1.0, (4000, 4)) * 10)
    lists = topk_search.Lists(x)
    ids = np.arange(4000)
    ((places, scores),) = lists.search(x[:1], 5, ids, ids, ids[:1])
    assert lists.read < 2000
    full = sorted((-float(v), i) for i, v in enumerate(x @ x[0]) if i)[:5]
    assert list(zip(-scores, places)) == full


def test_thresholds_of_correlated_vectors():
    # 64 dimensions that are mixtures of few: along the axes the lists stop
    rng = np.random.default_rng(4)
    x = np.floor((rng.normal(size=(6000, 64)) * 0.5 ** np.arange(64)) @ np.linalg.qr(rng.normal(size=(64, 64)))[0] * 5000)
    ids = np.arange(6000)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    for promised in (None, np.full(20, -1e5)):
        lists = topk_search.Lists(x, axes)
        for q, (places, scores) in enumerate(lists.search(x[:20], 5, ids, ids, ids[:20], promised)):
            full = sorted((-float(v), i) for i, v in enumerate(x @ x[q]) if i != q)[:5]
            assert list(zip(-scores, places)) == full
        assert lists.read < 0.35 * 20 * 6000


def test_components_read_of_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()
    x = np.floor(256 * np.array([r[0] for r in rows], float))
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 50)
    lists = topk_search.Lists(x, np.linalg.eigh(x.T @ x)[1][:, ::-1])
    for q, (places, scores) in zip(asked, lists.search(x[asked], 5, ids, ids, asked)):
        assert list(zip(-scores, places)) == sorted((-float(v), i) for i, v in enumerate(x @ x[q]) if i != q)[:5]
    # these spread alike in all directions: no list stops, but most rows are left after the first axes
    assert lists.read < 0.6 * len(asked) * len(x)


def test_topk_sql(spark, sf, duck):
    same(queries.op1_threshold_topk(spark, sf), duck.sql(queries.oracle_sql()["op1_threshold_topk"]))


def pages():
    rng = random.Random(2)
    body = ["ü" * 700, "x" * 999, "x" * 1000, "y" * 5000, "", "<html>" + "a b " * 400]
    rows = [(i, f"http://{rng.choice(['a', 'b.c', 'www.a'])}.example.com/p{i % 7}?q={i}#f", rng.choice(body)) for i in range(400)]
    rows += [(1000, "http://hot.example.com/", f"<p>{i}</p>") for i in range(3)] + [(2000 + i, "http://hot.example.com/", "z" * 2000) for i in range(600)]
    return rows + [(None, None, None), (None, "http://a/", "x" * 1000), (3000, "odd url\r\nX: y", "x" * 1000), (3001, None, "z" * 300_000), (5, rows[5][1], rows[5][2])]


def test_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rows = pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(5)
    newest = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            newest[h] = max(i, newest.get(h, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = newest.get(h) if i is not None and h in newest and i < newest[h] else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    got = warc.archive_and_read(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_lookup(spark):
    rows = spark.createDataFrame(pages(), "page_id long, url string, html string")
    folder, root = warc.archive(rows)
    keys = spark.createDataFrame([(2001, "http://hot.example.com/"), (9, "http://nowhere/")], "page_id long, url string").select(warc.url_key(F.col("url"), F.col("page_id")).alias("key"))
    found = warc.lookup(keys, folder, root, with_payload=True).collect()
    assert [(r.page_id, r.record_type, r.refers_to, r.payload) for r in found] == [(2001, "revisit", 2599, None)]
    key = keys.collect()[0].key
    assert key.startswith("com,example,hot)/ ")


def test_records():
    data = warc.record(3, "http://a/", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse_record(data)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"abc", b"abd"))


def test_archive_sql(spark, sf, duck):
    same(queries.op2_warc_index(spark, sf), duck.sql(queries.oracle_sql()["op2_warc_index"]))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(empty).collect() == []


TERMS = {("idiot", False): 5.0, ("worthless", False): 5.0, ("vequ", True): 4.0, ("scum", False): 4.0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_the_distance():
    trie = toxicity.Trie(TERMS)
    rng = random.Random(6)
    words = ["idiot", "idoit", "idio", "idiots", "iidiot", "worthles", "wrothless", "worthlesss", "w0rthl3ss", "1diot", "scum", "scun", "vequaire", "veq", "plain"]
    for base in ("idiot", "worthless"):
        for _ in range(300):
            w = list(base)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "a", "t", "xy"])
            words.append("".join(w))
    for w in set(words):
        hit = trie.look_up([w]).get(w)
        plain = "".join(toxicity.DISGUISE.get(c, c) for c in w)
        near = [t for t, stem in TERMS if not stem and len(t) >= 5 and 4 <= len(w) <= 24 and distance(plain, t) <= (2 if len(t) >= 8 else 1)]
        if (w, False) in TERMS:
            assert hit[0] == "exact"
        elif w.startswith("vequ"):
            assert hit[0] == "stem"
        else:
            assert (hit is not None) == bool(near), w


def test_automaton_meets_stems_short_terms_and_long_words():
    long = "unausstehlichkeitsbeauftragter"
    terms = {("idiot", True): 2.0, ("worthles", True): 2.0, ("scum", False): 2.0, (long, False): 2.0}
    trie = toxicity.Trie(terms, {t: toxicity._asked(*t) for t in terms})
    rng = random.Random(7)
    words = ["idoitic", "idotic", "xidiotic", "wrthlesness", "scm", "scun", "scuum", long[1:], long + "xy", "idiot" * 9, "x" * 5000, "idxot" + "y" * 5000]
    for base in ("idiotically", "worthlessness", "scum", long):
        for _ in range(200):
            w = list(base)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "c", "t", "xy"])
            words.append("".join(w))
    for w in set(words):
        got = {(t, stem): d for d, t, stem, _ in trie.near([w]).get(0, [])}
        for (t, stem), bound in trie.bound.items():
            d = min(distance(t, w[:k]) for k in range(min(len(w), len(t) + 3) + 1)) if stem else distance(t, w) if abs(len(t) - len(w)) < 4 else 9
            assert got.get((t, stem)) == (d if 0 < d <= bound else None), (w, t)


def test_misspellings_of_words_beside_a_stem(spark):
    # the stem has more evidence than each of its words; one edit of the short term is harmless, of the other not
    forms = ["blorkest", "blorkers", "blorking", "blorkful"]
    bad = [f"a{i} zzum b{i} quim c{i} {forms[i % 4]} d{i}" for i in range(80)]
    good = [f"e{i} has f{i} quit g{i} plain h{i}" for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(bad + good)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    trie = model.trie()
    assert any(stem and "blorking".startswith(t) for t, stem, _ in model.terms) and {(f, False) for f in forms} <= {t[:2] for t in model.terms}
    found = trie.look_up(["blroking", "bolrkers", "blokrest", "zzumm", "zum", "quit", "quim"])
    assert found.keys() == {"blroking", "bolrkers", "blokrest", "zzumm", "zum", "quim"}


def test_lexicon_holds_all_terms_with_evidence():
    # 700 terms, each in thirty texts of its own: three terms a text
    terms = [(f"term{i}", False, 3.0) for i in range(700)]
    texts = [(1, [i % 700, (i + 1) % 700, (i + 2) % 700], []) for i in range(7000)] + [(0, [], [])] * 7000
    assert toxicity._choose(terms, texts) == tuple(sorted(terms))


def test_context():
    trie = toxicity.Trie(TERMS)
    _, aimed = toxicity.scan("you are an idiot", trie)
    features, quoted = toxicity.scan('he said the word “idiot” was never used', trie)
    assert [f[4] for f in aimed] == [False] and [f[4] for f in quoted] == [True]
    assert features[0] == 0 and features[3] > 0
    assert toxicity.scan(None, trie)[1] == [] == toxicity.scan("", trie)[1]
    # inches are no quotation; marks pair over sentences, not over paragraphs; report and denial quote
    spread = toxicity.scan('A 5" pipe. You idiot, you are worthless, you idiot! A 6" pipe.', trie)[1]
    assert len(spread) == 3 and not any(f[4] for f in spread)
    assert toxicity.scan('he cried "you idiot! go." and left', trie)[1][0][4] and not toxicity.scan('he cried "so\nyou idiot! go." and left', trie)[1][0][4]
    assert toxicity.scan("they said he was never an idiot", trie)[1][0][4] and toxicity.scan("„idiot“ rief er", trie)[1][0][4] and toxicity.scan("« idiot » dit-elle", trie)[1][0][4]
    text = "İ Some SCUM here"
    (start, end, *_), = toxicity.scan(text, trie)[1]
    assert text[start:end] == "SCUM"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op10_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hits / sum(r.toxic == 1 for r in rows) >= 0.9
    assert hits / sum(r.predicted == 1 for r in rows) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot"), (4, "x" * 200_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.terms == () and all(r.score == 0.5 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model, finds_col="finds").collect() == []


def test_labels_of_one_kind_reject_nothing(spark, tmp_path):
    import corpus_pipeline as p

    texts = ["you idiot", "you idiot", "", None, "plain words", "you idiot and more"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, labels in {"ones": [(i, 1) for i in range(6)], "zeros": [(i, 0) for i in range(6)], "none": [], "few": [(0, 1), (4, 0)], "most": [(0, 1), (1, 1), (2, 1), (5, 1), (4, 0)]}.items():
        rows = spark.createDataFrame([(i, 0, t) for i, t in labels], "doc_id long, quality int, toxic int")
        rows.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert p.drop_toxic(spark, docs, str(tmp_path / name)).count() == 6, name


def test_copies_and_order_of_the_sample(spark):
    bad, good = [f"a{i} scum b{i} you" for i in range(40)], [f"a{i} plain b{i} they" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(bad + good)]
    labels = [(i, int(i < 40)) for i in range(80)]
    models = []
    for d, g in ((rows, labels), (rows[::-1], labels[::-1]), (rows + rows[:5], labels + labels)):
        models.append(toxicity.learn(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(g, "doc_id long, toxic int")))
    assert models[0] == models[1] and [t[:2] for t in models[0].terms] == [t[:2] for t in models[2].terms]
    scores = {r.text: set() for r in spark.createDataFrame(rows, "doc_id long, text string").collect()}
    for r in toxicity.score(spark.createDataFrame(rows + rows, "doc_id long, text string"), models[0]).collect():
        scores[r.text].add(r.score)
    assert all(len(v) == 1 for v in scores.values()) and min(min(scores[t]) for t in bad) > 0.7 > max(max(scores[t]) for t in good)


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).withColumn("h", toxicity.held_out("id")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total = docs.count()
    columns = docs.columns
    counts = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert total * 0.9 < counts[0] < total and counts[1] < counts[0] and counts[2] == counts[1]
    sizes = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert sizes.count() == counts[2] and sizes.where("n <> m").count() == 0
    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_join", "pii", "packing"] and p.ORACLE_SQL is None
    assert sorted(p.run(spark, sf).collect()) == sorted(docs.collect())


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, n int, key string, component_id long"
    texts = [None, "", "one two three four five six seven", "one two three four five six seven", "mail a.person@example.com now please do", "word " * 50_000, "x"]
    rows = [(i, t, None, None, None, "a", "b", 1, "c", 2) for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None, None, None, None, None)]
    for name, data in {"odd": rows, "empty": []}.items():
        sf = str(tmp_path / name)
        spark.createDataFrame(data, kind).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = p.run(spark, sf).collect()
        # one of the two equal texts is left; every other row is packed
        assert sorted({r.doc_id for r in out if r.doc_id is not None}) == ([0, 1, 2, 4, 5, 6] if data else [])
        assert sum(r.start == 0 for r in out) == (7 if data else 0)
