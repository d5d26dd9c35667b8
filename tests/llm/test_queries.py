"""Every registered query of the subpackage on the smallest tables: its SQL twin on odd rows, or a plain-Python one."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import bpe, elias_fano, lm, near_dup, queries, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same_as_sql(spark, name, folder, *tables):
    got = queries.queries()[name](spark, folder).toPandas()
    db = duckdb.connect()
    for t in tables:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = db.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(tuple("none" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, int | float) else str(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want)
    return got


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(seed, repeated_ids):
    rng = random.Random(seed)
    lines = [f"a line that many sites share, {i}" for i in range(4)]
    rows = [(0, None, "en", "s1", 0), (1, "", "en", None, 0), (2, " \t ", None, None, 3), (3, "one two", "en", "s2", 7)]
    for i in range(4, 90):
        text = "\n".join(rng.choice(lines) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, "en", None if i % 17 == 0 else f"s{i % 14}", len(text)))
    rows += [(90 + k, rows[10 + k][1], "de", "s3", 1) for k in range(5)]
    if repeated_ids:
        rows += [rows[12], rows[12], (13, lines[0] + "\nanother text of this id", "en", "s9", 0), (None, lines[1], "en", "s8", 0)]
    return rows


def test_line_dedup_sql_on_odd_rows(spark, tmp_path):
    folder = write(spark, tmp_path, documents=(odd_documents(1, True), DOCS))
    got = same_as_sql(spark, "op3_line_dedup", folder, "documents")
    assert got["n_removed"].sum() > 40


@pytest.mark.parametrize("name", ["op5_mix_sources", "op9_near_duplicates"])
def test_sql_on_odd_rows(spark, tmp_path, name):
    rows = odd_documents(2, False)
    if name == "op5_mix_sources":
        rows += [(None, f"text without an id {i % 9}", "en", "s1", 0) for i in range(20)]
    same_as_sql(spark, name, write(spark, tmp_path, documents=(rows, DOCS)), "documents")


def test_preference_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {rng.randrange(30)} <{c}>") for c in range(30) for t in range(rng.randint(1, 6))]
    same_as_sql(spark, "op6_preference_format", write(spark, tmp_path, conversations=([*rows, (40, 0, "user", None)], "conv_id long, turn int, role string, text string")), "conversations")


def test_passages_query(spark, documents):
    words = {i: WORD.findall(lower(t)) for i, t in documents.items()}
    covered = defaultdict(set)
    for r in queries.queries()["op1_repeated_passages"](spark, SF).collect():
        covered[r.doc_id].update(range(r.begin, r.end))
        a, b = words[r.doc_id][r.begin : r.end], words[r.source_id][r.source_begin : r.source_end]
        assert r.source_id < r.doc_id and min(len(a), len(b)) >= 50
        assert a == b if r.edits == 0 else substring_dedup._distance(a, b) <= 0.2 * max(len(a), len(b))
    first, n = {}, 0
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            if first.setdefault(tuple(words[i][k : k + 50]), i) < i:
                n += 1
                assert covered[i].issuperset(range(k, k + 50))
    assert n


def test_bpe_query(spark, documents):
    path, pattern = bpe.vocabulary()
    codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    for r in queries.queries()["op2_byte_bpe"](spark, SF).collect():
        ids = codec.encode_ordinary(documents[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()


def sketch(text, k=128, n=5):
    signed = lambda h: h - 2**64 if h >= 2**63 else h

    def fold(hashes):
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
        return signed(seed)

    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(lower(text))]
    runs = [h[i : i + n] for i in range(len(h) - n + 1)] if len(h) >= n else [h] if h else []
    return sorted({fold(r) for r in runs})[:k]


def likeness(a, b, k=128):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else len(set(union) & set(a) & set(b)) / len(union)


def test_fingerprint_query(spark, documents):
    import base64

    ids = sorted(documents)
    sketches = {i: sketch(documents[i]) for i in ids}
    rows = {r.doc_id: r for r in queries.queries()["op4_fingerprints"](spark, SF).collect()}
    assert sorted(rows) == ids
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        text, half, r = documents[i], len(documents[i]) // 2, rows[i]
        edited = text[: len(text) - half] + documents[j][:half]
        s = sketch(edited)
        packed = lambda x: base64.b64encode(b"".join(struct.pack(">q", h) for h in x)).decode()
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (packed(sketches[i]), packed(s))
        assert math.isclose(r.near_edited, likeness(sketches[i], s)) and math.isclose(r.near_next, likeness(sketches[i], sketches[j]))


def test_neighbours_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    vectors = {int(i): np.asarray(v, np.float64) for i, v in zip(table["vec_id"], table["embedding"], strict=True)}
    ids = np.array(sorted(vectors))
    matrix, hits, total = np.stack([vectors[i] for i in ids]), 0, 0
    got = queries.queries()["op7_nearest_vectors"](spark, SF).toPandas()
    for q, mine in got.sort_values("rank").groupby("query_id"):
        d = np.sqrt(((matrix - vectors[q]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        want = [int(i) for i in ids[order] if i != q][:10]
        assert np.allclose(mine["score"], [np.sqrt(((vectors[q] - vectors[i]) ** 2).sum()) for i in mine["vec_id"]], rtol=0, atol=1e-12)
        hits, total = hits + len(set(want) & set(mine["vec_id"])), total + len(want)
    assert set(got["query_id"]) == {i for i in vectors if i % 100 == 0} and hits >= 0.9 * total


def test_lm_query(spark, documents):
    rows = {r.doc_id: r for r in queries.queries()["op8_lm_scores"](spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
    c, b, heads = Counter(), Counter(), Counter()
    for i, t in documents.items():
        if not held[i]:
            seq = ["\0", *WORD.findall(lower(t)), "\1"]
            c.update(seq[1:])
            heads.update(seq[:-1])
            b.update(zip(seq, seq[1:], strict=False))
    n, v, mu = sum(c.values()), len(c), lm.MU
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    for i, t in documents.items():
        seq = ["\0", *WORD.findall(lower(t)), "\1"]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in seq[1:])
        a = elias_fano.CODEBOOK[elias_fano.quantise(np.array([b[x] / (heads[x[0]] + mu) for x in zip(seq, seq[1:], strict=False)]))]
        own = sum(math.log10(p + mu / (heads[x] + mu) * p1(w)) for p, x, w in zip(a, seq, seq[1:], strict=False))
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(seq) - 1, sum(c[w] > 0 for w in seq[1:]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, own, rel_tol=1e-4)


def test_toxicity_query(spark, documents):
    rows = queries.queries()["op10_toxicity"](spark, SF).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in documents}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.75), ("sf0.01", 0.9), ("sf0.1", 0.95)])
def test_toxicity_ranks_held_out_rows(spark, sf, least):
    """Share of held-out (toxic, clean) pairs in which the toxic text scores higher, ties half."""
    scores = queries.queries()["op10_toxicity"](spark, f"/root/testdata/{sf}").toPandas()
    held = scores[scores["held_out"]].merge(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").toPandas(), on="doc_id")
    rank, toxic = held["score"].rank(), held["toxic"] == 1
    n = int(toxic.sum())
    assert (rank[toxic].sum() - n * (n + 1) / 2) / (n * (len(held) - n)) >= least
    assert scores["score"].nunique() > 5 and held.loc[toxic, "score"].mean() > 2 * held.loc[~toxic, "score"].mean()


def test_toxicity_without_one_class_or_rows(spark):
    rows = spark.createDataFrame([(1, "a text", 1), (2, None, 1), (None, "", 1)], "doc_id long, text string, toxic int")
    assert toxicity.train(rows).score(["x"])[0] == pytest.approx(0.8)
    assert toxicity.train(rows.where("false")).score(["x", None]).tolist() == [0.5, 0.5]


def test_toxicity_model_against_brute_force(spark):
    """Features by their definition, ratios over all n-grams, and weights at the minimum of the penalised loss."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["mild", "calm", "tree", "Vile" if i % 4 == 0 else "kind", "sun"]) for _ in range(6)), int(i % 4 == 0)) for i in range(120)]
    size = 150
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), features=size)
    held, p, q = [], Counter(), Counter()
    for _, t, y in rows:
        padded = f" {t.lower()} "
        grams = {padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}
        held.append(grams)
        (p if y else q).update(grams)
    n1, n = sum(y for _, _, y in rows), len(rows)

    def statistic(g):
        cells = [(p[g], p[g] + q[g], n1), (q[g], p[g] + q[g], n - n1), (n1 - p[g], n - p[g] - q[g], n1), (n - n1 - q[g], n - p[g] - q[g], n - n1)]
        return sum(2 * o * math.log(o * n / (r * c)) for o, r, c in cells if o)

    every = set(p) | set(q)
    hashes = {}
    for g in every:
        codes = np.array([ord(x) for x in g], np.uint32)
        for order, h in zip(toxicity.ORDERS, toxicity._grams(codes), strict=False):
            if order == len(g):
                hashes[g] = h[0]
    chosen = {g for g in every if hashes[g] in set(model.grams.tolist())}
    best = sorted(map(statistic, every), reverse=True)
    assert len(chosen) == len(model.grams) == size and np.allclose(sorted(map(statistic, chosen), reverse=True), best[:size])
    total_p, total_q = sum(p[g] + 1 for g in every), sum(q[g] + 1 for g in every)
    ratio = {g: math.log((p[g] + 1) / total_p) - math.log((q[g] + 1) / total_q) for g in chosen}
    weight = {g: model.weights[np.searchsorted(model.grams, hashes[g])] / ratio[g] for g in chosen}
    slope = Counter()
    for (_, _, y), grams in zip(rows, held, strict=True):
        own = grams & chosen
        z = model.bias + sum(weight[g] * ratio[g] for g in own)
        for g in own:
            slope[g] += (1 / (1 + math.exp(-z)) - y) * ratio[g]
    assert max(abs(slope[g] + 0.1 * weight[g]) for g in chosen) < 0.02


def test_pipeline_on_odd_rows_and_an_empty_table(spark, tmp_path):
    labels = [(i, 1, int(i % 5 == 0)) for i in range(4, 60)]
    long = " ".join(f"z{i % 977}" for i in range(60_000))
    rows = [*odd_documents(6, True), (200, long, "en", "s1", len(long)), (201, long, "en", "s2", len(long))]
    folder = write(spark, tmp_path / "some", documents=(rows, DOCS), labels=(labels, "doc_id long, quality int, toxic int"))
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert {"doc_id", "source", "n_tokens", "ids"} <= set(out.columns) and 201 not in set(out["doc_id"]) and (out["n_tokens"] > 0).all()
    assert all(len(x) == 4 * n for x, n in zip(out["ids"], out["n_tokens"], strict=True))
    empty = write(spark, tmp_path / "none", documents=([], DOCS), labels=([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert near_dup.near_duplicates(spark.read.parquet(f"{empty}/documents.parquet")).count() == 0
