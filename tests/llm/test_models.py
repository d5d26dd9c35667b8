"""Toxicity, language-model scoring and nearest neighbours."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import ann, elias_fano, lm, toxicity


def toxic_docs(spark, n=400, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["Grumblefang", "snarkwit", "dolthead"]))
        rows.append((i, " ".join(t), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy(spark):
    docs = toxic_docs(spark)
    model = toxicity.train(docs.where("doc_id % 3 <> 1"))
    got = docs.where("doc_id % 3 = 1").select("toxic", toxicity.score(spark, F.col("text"), model).alias("s")).collect()
    assert sum((r.s >= 0.7) == bool(r.toxic) for r in got) >= 0.97 * len(got)
    assert all(0 <= r.s <= 1 for r in got)


def test_one_bad_word_in_a_long_text_counts_wherever_it_is(spark, monkeypatch):
    model = toxicity.train(toxic_docs(spark))
    clean = "sa ri nu " * 30
    assert model.score([clean])[0] < 0.5 < model.score([clean + "dolthead " + clean])[0]
    whole = model.score([clean * 20 + "dolthead"])
    monkeypatch.setattr(toxicity, "_PIECE", 50)
    assert np.allclose(model.score([clean * 20 + "dolthead"]), whole)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    model = toxicity.train(toxic_docs(spark, 120))
    assert odd_docs.select(toxicity.score(spark, F.col("text"), model)).count() == 10
    assert toxicity.reject_toxic(odd_docs, model).columns == odd_docs.columns
    none = toxicity.train(toxic_docs(spark, 10).where("false"))
    assert none.score(["x", None, ""]).tolist() == [0.5, 0.5, 0.5]
    assert toxicity.train(toxic_docs(spark, 30).where("toxic = 0")).score(["x"])[0] < 0.5
    assert toxicity.reject_toxic(no_docs, model).count() == 0
    nulls = spark.createDataFrame([(None, None, 1), (1, "a b", None), (2, "c d", 0)], "doc_id long, text string, toxic int")
    assert 0 <= toxicity.train(nulls).score(["c"])[0] <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=80), st.lists(st.integers(0, 6000), max_size=30))
def test_elias_fano(values, queries):
    values.sort()
    ef = elias_fano.EliasFano(elias_fano.encode(np.array(values, np.uint64), 5001))
    assert ef[np.arange(len(values))].tolist() == values
    assert ef.successor(np.array(queries, np.uint64)).tolist() == np.searchsorted(values, queries).tolist()


def test_trie_lookup(tmp_path):
    rng = np.random.default_rng(0)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))})
    v, w = (np.array(x, np.uint64) * np.uint64(2**40 + 7) for x in zip(*pairs, strict=True))
    p = 10.0 ** rng.uniform(-10, 0, len(pairs))
    backoff = rng.uniform(0, 1, len(np.unique(v)))
    block = elias_fano.build_trie(v, w, p, backoff)
    have = set(pairs)
    gone = [(a, b) for a in range(62) for b in range(62) if (a, b) not in have]
    gv, gw = (np.array(x, np.uint64) * np.uint64(2**40 + 7) for x in zip(*gone, strict=True))
    folder = tmp_path / "tries"
    for trie in (elias_fano.Trie(block), lm.open_trie(block, None), lm.open_trie(block, str(folder))):
        assert (trie.lookup(v, w) == elias_fano.quantise(p)).all() and np.allclose(trie.backoff, backoff)
        assert not trie.lookup(gv, gw).any()
    assert not list(folder.iterdir())  # the map outlives the file
    kept = elias_fano.CODEBOOK[elias_fano.quantise(p)]
    assert (kept <= p * 1.000001).all() and (kept > p * 0.91).all()


def test_elias_fano_of_many_values():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 2**40, 300_000).astype(np.uint64))
    block = elias_fano.encode(values, 2**40)
    ef, some = elias_fano.EliasFano(block), rng.integers(0, 2**40, 300_000).astype(np.uint64)
    assert (ef[np.arange(len(values))] == values).all() and (ef.successor(some) == np.searchsorted(values, some)).all()
    assert len(block) < len(values) * 40 / 8


def test_lm_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(vocabulary[: 5 + i % 36]).upper() for _ in range(rng.randint(0, 50)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    monkeypatch.setattr(lm, "PIECE", 700)
    rows = {r.doc_id: r for r in lm.score(df, F.col("doc_id") % 4 != 0, mu=50.0, shards=5).collect()}
    c, b, n = Counter(), Counter(), 0
    for i, t in docs:
        if i % 4:
            seq = ["<", *t.lower().split(), ">"]
            c.update(seq)
            b.update(zip(seq, seq[1:], strict=False))
    total, types = sum(c.values()) - c["<"], len(c) - 1
    p1 = lambda w: (c[w] + 1) / (total + types + 1)
    for i, t in docs:
        seq = ["<", *t.lower().split(), ">"]
        base = sum(math.log10(p1(w)) for w in seq[1:])
        own = sum(math.log10(elias_fano.CODEBOOK[elias_fano.quantise(np.array([b[v, w] / (c[v] + 50)]))[0]] + 50 / (c[v] + 50) * p1(w)) for v, w in zip(seq, seq[1:], strict=False))
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (len(seq) - 1, sum(c[w] > 0 for w in seq[1:]), total, i % 4 != 0)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, own, rel_tol=1e-9)


def test_lm_frequent_contexts_are_spread(spark):
    docs = spark.createDataFrame([(i, f"the a{i % 50} the b{i % 70} the") for i in range(1200)], "doc_id long, text string")
    rows = lm.score(docs, F.lit(True), shards=4).collect()
    plain = lm.score(docs, F.lit(True), shards=1).collect()
    key = lambda r: (r.doc_id, round(r.score, 9), r.n_known)
    assert sorted(map(key, rows)) == sorted(map(key, plain)) and {r.n_known for r in rows} == {6}


def test_lm_bytes_go_with_the_words_not_with_the_shards(spark):
    """What pieces hold of shards and send to them, with 16 and with 16,000 shards over one text."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 900}" for k in range(60)), True) for i in range(200)], "doc_id long, text string, train boolean").coalesce(2)
    for shards in (16, 16_000):
        table = lm.pieces(docs, shards).cache()
        for r in table.collect():
            assert len(r.shards) <= 8 * min(shards, r.n_words)
        words = sum(r.n_words for r in table.collect())
        sent = lm._send(table, np.zeros(0, np.uint64)).collect()
        assert len(sent) <= words + 2 * table.count() and len({(r.shard, r.piece) for r in sent}) == len(sent)


def test_lm_odd_rows(odd_docs, no_docs):
    rows = lm.score(odd_docs, F.lit(True), shards=3).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm.score(no_docs, F.lit(True), shards=3).count() == 0
    assert {(r.base_score, r.score) for r in lm.score(odd_docs, F.lit(False), shards=3).collect()} == {(0.0, 0.0)}
    assert lm.tries(odd_docs, shards=3).count() > 0


def brute(rows, q, k):
    d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(rows[q], v, strict=True))), i) for i, v in rows.items() if i != q)
    return [(i, s) for s, i in d[:k]]


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 8))
    x = (centres[rng.integers(0, 30, 4000)] + 0.3 * rng.normal(size=(4000, 8))).round(4)
    x[100:140] = x[100]  # copies
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).toPandas()
    hits = total = 0
    for q in range(0, 4000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(4000), d))
        want = order[order != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine["score"], d[mine["vec_id"]], rtol=0, atol=0)
        assert list(zip(mine["score"], mine["vec_id"], strict=True)) == sorted(zip(mine["score"], mine["vec_id"], strict=True))
        hits += len(set(want) & set(mine["vec_id"]))
        total += 10
    assert hits >= 0.9 * total


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [3.0, 3.0]), (100, [0.0, 2.0]), (100, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("score", F.lit(2))
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    r5 = math.sqrt(5)
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, r5), (0, 3, 100, r5), (100, 1, 2, 0.0), (100, 2, 0, r5), (100, 3, 1, r5)]
    assert ann.nearest(df.where("false"), df).count() == 0


@pytest.mark.parametrize("n", [1, 2, 11, 12])
def test_few_vectors_give_all_candidates(spark, n):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(n)], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df).count() == n * min(10, n - 1)
