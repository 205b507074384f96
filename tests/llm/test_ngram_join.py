import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from wavelode.llm import ngram_join, queries

from ..compare import same


def brute(rows, k, num, den):
    """(n_shingles, component) by all pairs of sets of words."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        w = min(k, len(words))
        sets.append({tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and den * both >= num * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 12, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 9, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((at, " ".join(words)))
            at += 1
    line = "this line is in very many of the texts here"
    rows += [(at + i, line + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 40])))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE\x0b"), (1005, "one two three"), (None, "one"), (None, None)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (7, "another text under a used id of course"), (1006, "Ä ä Ä"), (1007, "ä Ä ä")]
    rows += [(1100, "a b a b a b a b a b"), (1101, "b a b a b a b a b a"), (1102, "x" * 300_000), (1103, "y z " * 30_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,num,den,seed", [(4, 85, 100, 1), (5, 80, 100, 2)])
def test_components(spark, k, num, den, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"comp": F.lit(1), "n": F.lit("x"), "id": F.lit(0)}).repartition(5)
    out = ngram_join.similar_components(docs, k=k, num=num, den=den)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, k, num, den)


def test_runs_dealt_over_tasks(spark, monkeypatch):
    # every shingle of more than two rows is dealt over parts
    monkeypatch.setattr(ngram_join, "RUN", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 100)
    rows = corpus(5)
    out = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=4, num=85, den=100)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 4, 85, 100)


def test_texts_under_one_id_link_on_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, b + " end"), (3, "start " + a)]
    out = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85, den=100)
    assert sorted(map(tuple, out.collect())) == brute(rows, 4, 85, 100) == [(3, 58, 3), (5, 57, 3), (5, 57, 5), (7, 58, 5)]


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 400").collect()]
    out = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85, den=100)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 4, 85, 100)


def test_whole_table_by_sql(spark, sf, duck):
    same(queries.op9_ngram_jaccard_join(spark, sf), duck.sql(queries.oracle_sql()["op9_ngram_jaccard_join"]))


def test_drop_similar(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    kept = ngram_join.drop_similar(docs)
    assert kept.columns == docs.columns
    got = kept.select("doc_id", "text").collect()
    want = brute(rows, 5, 80, 100)
    roots = {c for d, _, c in want if c is not None}
    assert {r.doc_id for r in got if r.doc_id is not None} == roots
    assert sum(r.doc_id == 0 for r in got) <= 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_components(docs).collect() == []
    assert ngram_join.drop_similar(docs).collect() == []


def test_divide_skip():
    rng = random.Random(4)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(rng.randrange(1, 14))]
        need = rng.randrange(1, len(lists) + 1)
        want = {x: c for x in range(40) if (c := sum(x in v for v in lists)) >= need}
        assert ngram_join.divide_skip(lists, need) == want


def test_words_of_slices():
    texts = pa.array([None, " a  B\tc", "É é", "", "x\x1cy z\x85w", "q" * 10, " "] * 50)
    for part in (texts, texts.slice(3, 20), texts.slice(101)):
        want = [[xxh3_64_intdigest(w) for w in (t or "").encode().lower().split()] for t in part.to_pylist()]
        assert [w.tolist() for w in ngram_join.word_hashes(part)] == want


def test_signature_bounds_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.integers(0, 300, 200)], rng.integers(0, 2**63, 30, dtype=np.uint64)])
        bits = np.bitwise_count(np.frombuffer(ngram_join.signature(a), np.uint8) ^ np.frombuffer(ngram_join.signature(b), np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b))
