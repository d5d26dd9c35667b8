"""Line dedup, fingerprints, mixing and preference formatting."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from foliospark.llm import fingerprint, line_dedup, mixing, preference


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    lines = [f"this is shared line number {i}" for i in range(12)]
    docs = [(i, "\n".join(rng.choice(lines if rng.random() < 0.6 else [f"own line of document {i} {rng.random()}", "", "short"]) for _ in range(rng.randint(0, 8))), f"s{rng.randint(0, 7)}") for i in range(150)]
    got = {r.doc_id: (r.text, r._n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, source string"), min_sites=6).collect()}
    sites, first = defaultdict(set), {}
    for i, t, s in docs:
        for k, x in enumerate(t.split("\n")):
            if len(x.strip()) >= line_dedup.MIN_CHARS:
                sites[x.strip()].add(s)
                first.setdefault(x.strip(), (i, k))
    for i, t, _ in docs:
        parts = t.split("\n")
        keep = [x for k, x in enumerate(parts) if not (len(sites.get(x.strip(), ())) >= 6 and first[x.strip()] != (i, k))]
        assert got[i] == ("\n".join(keep), len(parts) - len(keep))


def test_spread_near_and_far_from_the_threshold(spark):
    rows = [(f"l{n}", f"site{s}", 0, 0, 0) for n in (9, 10, 11, 40) for s in range(n)]
    df = spark.createDataFrame(rows, "t string, site string, doc_id long, key long, pos int").withColumn("line", F.xxhash64("t"))
    names = {r.line: r.t for r in df.select("line", "t").distinct().collect()}
    assert {names[r.line] for r in line_dedup.line_spread(df, 10).collect()} == {"l10", "l11", "l40"}


def test_line_dedup_odd_rows(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs, min_sites=2, min_chars=1)
    assert out.count() == 10 and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert out.where("text is null").select("_n_lines").first()[0] == 0
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_fingerprints_merge_and_estimate(spark):
    a, b = " ".join(f"w{i}" for i in range(600)), " ".join(f"w{i}" for i in range(300, 900))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(*[fingerprint.sketch(F.col(c), k=512).alias(c) for c in "ab"])
    r = df.select(fingerprint.resemblance(F.col("a"), F.col("b"), 512).alias("j"), fingerprint.containment(F.col("a"), F.col("b"), 512).alias("c"), fingerprint.distinct_count(F.col("a"), 512).alias("n"), fingerprint.merge(F.col("a"), F.col("b"), 512).alias("m")).first()
    assert abs(r.j - 296 / 896) < 0.08 and abs(r.c - 296 / 596) < 0.1 and abs(r.n - 596) < 80
    parts = df.select(F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("a").alias("sketch")), F.struct(F.lit(1).alias("k"), F.col("b").alias("sketch")))).alias("x")).select("x.*")
    assert fingerprint.merge_parts(parts, ["k"], k=512).first().sketch == r.m


def test_fingerprints_odd_rows(odd_docs, no_docs):
    rows = fingerprint.fingerprints(odd_docs).collect()
    assert len(rows) == 10 and {len(r.sketch) for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert len({tuple(r.sketch) for r in rows if r.doc_id == 1}) == 1 and len([r for r in rows if r.doc_id == 6 and len(r.sketch) == 1]) == 1
    assert fingerprint.fingerprints(no_docs).count() == 0


def test_next_row_over_blocks(spark):
    ids = [*range(0, 4000, 7), 10**15, -5, None, 7, 7]
    df = spark.createDataFrame([(i, f"t{i}-{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    got = {r.text: r.next_text for r in fingerprint.with_next(df, "doc_id", ["text"]).collect()}
    order = sorted(((-(1 << 63) if i is None else i), f"t{i}-{k}") for k, i in enumerate(ids))
    assert got == {t: order[(n + 1) % len(order)][1] for n, (_, t) in enumerate(order)}
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert fingerprint.with_next(one, "doc_id", ["text"]).first().next_text == "x"
    assert fingerprint.with_next(one.where("false"), "doc_id", ["text"]).count() == 0


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(2)
    docs = [(i, "w " * rng.randint(1, 40), rng.choice(["a"] * 8 + ["b", "c", "d", None])) for i in range(600)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    size = Counter()
    for _, t, s in docs:
        size[s] += len(t.split())
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    target, open_, left = {}, set(size), sum(size.values())
    while True:  # share by weight, hold at the cap, share the rest again
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s], left = 3 * size[s], left - 3 * size[s]
        open_ -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 * r.target and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert [r.position for r in rows if r.position is not None] == sorted(r.position for r in rows if r.position is not None)


def test_repeated_rows_are_taken_as_often_as_they_are_there(spark):
    df = spark.createDataFrame([(1, "a b c", "s", "x"), (1, "a b c", "s", "x"), (1, "d e", "s", "y"), (None, "f", "s", "z"), (2, "s", None, "w"), (2, None, "s", "v")], "doc_id long, text string, source string, key string")
    rows = [tuple(r) for r in mixing.apply_mix(df, weights=(9, 1)).collect()]  # sizes are 9 and 1: every row once
    assert sorted(rows, key=repr) == sorted([tuple(r) for r in df.where("text is not null").collect()], key=repr)


def test_position_inverts_the_schedule(spark):
    for slot, knots in enumerate(mixing.SCHEDULES):
        shares = [i / 10 for i in range(11)]
        df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.training_position(F.col("s"), F.lit(slot)).alias("t"))
        total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        for r in df.collect():
            area = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
                t = min(max(r.t, t0), t1)
                area += (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
            assert abs(area / total - r.s) < 1e-9


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.size == 0) and {r.size for r in rows if r.doc_id == 1} == {10}
    assert mixing.mix(no_docs).count() == 0
    out = mixing.apply_mix(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0 and mixing.apply_mix(no_docs).count() == 0


def test_preferences(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "so"), (1, "rejected", 3, "assistant", "what"), (2, "chosen", 0, "user", "a"), (3, "chosen", 0, None, None), (3, "rejected", 0, None, None), (None, "chosen", None, "user", "n"), (4, "other", 0, "user", "z")]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string").withColumn("n", F.lit(1)).withColumn("end", F.lit("x"))
    got = {r.pair_id: r for r in preference.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3, None}
    r = got[1]
    assert (r.n_prompt_turns, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert [r.chosen[s.begin : s.end] for s in r.chosen_spans] == ["yes<|end|>\n"]
    assert [r.rejected[s.begin : s.end] for s in r.rejected_spans] == ["no<|end|>\n", "what<|end|>\n"]
    assert (got[2].n_prompt_turns, got[2].rejected, got[2].rejected_spans) == (0, "", [])
    assert (got[3].n_prompt_turns, got[3].chosen) == (1, "")
    assert preference.format_preferences(df.where("false")).count() == 0
    odd = spark.createDataFrame([(1, 0, "assistant", "a"), (2, 0, "assistant", None), (None, 0, "assistant", "c"), (3, 0, "user", "d"), (1, 0, "assistant", "a")], "conv_id long, turn int, role string, text string")
    assert {r.pair_id for r in preference.format_preferences(preference.mismatched_replies(odd)).collect()} == {1, 2}
    assert preference.mismatched_replies(odd.where("false")).count() == 0
