"""Near-duplicates, repeated passages, and the pipeline."""

import itertools
import random
import re

import pytest

import corpus_pipeline
from foliospark.llm import near_dup, substring_dedup, words


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(docs, n, percent):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t, n))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, n, percent):
    rng = random.Random(n)
    vocabulary = [f"v{i}" for i in range(500)]
    docs = []
    for _ in range(25):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160)))
        docs += [edited(rng, base, rng.choice([0, 0, 1, 2, 3, 5, 8])) for _ in range(rng.randint(1, 9))]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent, n).collect()
    want = brute_components(docs, n, percent)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict(docs)[r.doc_id], n)) for r in rows)


def test_lists_in_blocks_find_the_same_links(spark, monkeypatch):
    rng = random.Random(9)
    base = " ".join(f"b{i}" for i in range(120))
    docs = list(enumerate(edited(rng, base, rng.choice([2, 3, 4, 5])) for _ in range(60)))
    monkeypatch.setattr(near_dup, "SMALL_LIST", 10)
    monkeypatch.setattr(near_dup, "BLOCK", 800)
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85, 3).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(docs, 3, 85)


def test_links_that_the_estimate_rejects_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "_estimated", lambda pairs, *_: pairs.where("a < 0"))
    base = [f"b{i}" for i in range(200)]
    docs = [(0, " ".join(base)), (1, " ".join([*base[:100], "other", *base[101:]])), (2, " ".join(f"c{i}" for i in range(90)))]
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 0, 2: 2}


def test_a_dense_group_with_a_small_sketch(spark, monkeypatch):
    """Near copies whose similarities lie about the threshold, by so few sketch values that most links are hidden."""
    rng = random.Random(21)
    base = " ".join(f"b{i}" for i in range(150))
    docs = list(enumerate(edited(rng, base, rng.choice([1, 2, 3, 4, 6])) for _ in range(400)))
    monkeypatch.setattr(near_dup, "INDEXED", 16)
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85, 3, k=16).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(docs, 3, 85)


def test_one_id_with_two_texts_of_equal_length(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(5, one), (5, two), (7, one + " x"), (8, two + " x"), (9, "something else entirely here and now")]
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {5: 5, 7: 5, 8: 5, 9: 9}


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = near_dup.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id in (None, 1, 2, 3)} == {(None, 1, None, True), (1, 6, 1, True), (2, 0, 2, True), (3, 0, 3, True)}
    left = near_dup.drop_near_duplicates(odd_docs)
    assert left.count() == 10 and left.columns == odd_docs.columns and near_dup.near_duplicates(no_docs).count() == 0


def test_words_of_odd_texts():
    w = words.words(["Ab  cD\n", None, "", " x", "ab cd"])
    assert w.first.tolist() == [0, 2, 2, 2, 3, 5] and (w.hashes[:2] == w.hashes[3:]).all()
    assert [len(s) for s in words.shingle_sets(["a b c d", "", "a", "a a a a a"], 3)] == [2, 0, 1, 1]


def test_passages_against_planted_ones(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(80)
    fuzzy = passage[:30] + ["other"] + passage[31:55] + passage[57:]
    docs = [(1, fresh(50) + passage + fresh(20)), (2, fresh(10) + fuzzy), (3, fresh(200)), (4, passage[:45] + fresh(60)), (5, passage + fresh(300) + passage)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    assert {(r.doc_id, r.source_id) for r in rows} == {(2, 1), (5, 1)}
    assert [(r.begin, r.end, r.source_begin, r.source_end, r.edits) for r in rows if r.doc_id == 2] == [(10, 88, 50, 130, 3)]
    assert sorted((r.begin, r.end) for r in rows if r.doc_id == 5) == [(0, 80), (380, 460)]


def test_chains_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        m = 9
        x = sorted(rng.randrange(80) for _ in range(m))
        y, n = [rng.randrange(80) for _ in range(m)], [rng.randint(4, 15) for _ in range(m)]
        ends = [(a + max(1, k - 3), b + max(1, k - 3)) for a, b, k in zip(x, y, n, strict=True)]
        follows = lambda i, j: ends[i][0] <= x[j] and ends[i][1] <= y[j]  # noqa: B023, E731
        got = substring_dedup.chains(x, y, n, 0.2, max_gap=10**6)
        assert sorted(i for c in got for i in c) == list(range(m))
        assert all(follows(a, b) for c in got for a, b in itertools.pairwise(c))

        def value(c):
            return sum(n[i] for i in c) - 0.2 * sum(x[b] - ends[a][0] + y[b] - ends[a][1] for a, b in itertools.pairwise(c))  # noqa: B023

        every = [c for k in range(1, m + 1) for c in itertools.combinations(range(m), k) if all(follows(a, b) for a, b in itertools.pairwise(c))]
        assert value(got[0]) == pytest.approx(max(map(value, every)))


def test_exact_passages_against_brute_force(spark):
    """Every word of 50 or more in a row that an earlier document has is in a row; every row is what it says."""
    rng = random.Random(31)
    pool = [[f"p{k}w{i}" for i in range(rng.randint(40, 140))] for k in range(12)]
    vocabulary = [f"v{i}" for i in range(60)]
    docs = []
    for _ in range(70):
        text = []
        for _ in range(rng.randint(1, 5)):
            one = rng.choice(pool)
            i = rng.randrange(0, max(1, len(one) - 45))
            part = one[i : i + rng.randint(30, 120)]
            if rng.random() < 0.4:
                part = [w if rng.random() > 0.06 else rng.choice(vocabulary) for w in part]
            text += part + [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        docs.append(text)
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    covered = [set() for _ in docs]
    for r in rows:
        covered[r.doc_id].update(range(r.begin, r.end))
        a, b = docs[r.doc_id][r.begin : r.end], docs[r.source_id][r.source_begin : r.source_end]
        assert r.source_id < r.doc_id and min(len(a), len(b)) >= 50 and r.identity >= 0.8
        assert substring_dedup._distance(a, b) <= r.edits
    first = {}
    for i, w in enumerate(docs):
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                assert set(range(k, k + 50)) <= covered[i]


def test_fuzzy_passages_whose_first_holders_have_too_little(spark):
    rng = random.Random(14)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(90)
    fuzzy = lambda: [w if k % 11 else f"e{rng.randrange(10**7)}" for k, w in enumerate(passage, rng.randrange(11))]
    docs = [fresh(20) + passage[:45] + fresh(20), fresh(20) + passage[45:] + fresh(20), *(fresh(20) + fuzzy() + fresh(20) for _ in range(30))]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.end - r.begin >= 75} == set(range(3, 32))


def test_periodic_texts_give_few_rows(spark):
    docs = [(0, "again " * 400), (1, "x y z " + "again " * 700), (2, "some other text " * 100)]
    rows = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert 1 <= len(rows) <= 40 and {r.doc_id for r in rows} == {1}
    assert set(range(3, 703)) == {k for r in rows for k in range(r.begin, r.end)}


def test_passages_odd_rows(odd_docs, no_docs):
    assert {r.doc_id for r in substring_dedup.repeated_passages(odd_docs).collect()} <= {1, 6}
    assert substring_dedup.repeated_passages(no_docs).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(400)]
    line = "this notice is found on very many sites"
    docs, labels = [], []
    for i in range(240):
        t = [rng.choice(voc) for _ in range(rng.randint(20, 60))]
        if i % 8 == 0:
            t.insert(5, "dreadfulword")
        labels.append((i, 1, int(i % 8 == 0)))
        docs.append((i, " ".join(t) + ("\n" + line if i % 2 else ""), "en", f"s{i % 13}", 0))
    docs[201] = (201, docs[101][1], "en", "s9", 0)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, frame = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = frame.columns
    for name, step in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stage(step(spark, frame, str(tmp_path)), name)
        seen.append(frame)
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in seen]
    assert all(f.columns == columns for f in seen[:-1])
    assert ids[0] == {i for i in range(240) if i % 8}
    assert ids[1] == ids[0] and seen[1].where(seen[1].text.contains(line)).count() == 1
    assert ids[2] == ids[1] - {201}
    assert ids[3] <= ids[2] and seen[3].count() == seen[4].count() and ids[4] == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


@pytest.mark.parametrize("every", [5, 6, 8, 12])
def test_passages_with_many_edits(spark, every):
    rng = random.Random(every)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    docs = []
    for i in range(40):
        passage = fresh(60)
        changed = [f"c{rng.randrange(10**7)}" if k % every == every - 1 else w for k, w in enumerate(passage)]
        docs += [(2 * i, fresh(30) + passage + fresh(30)), (2 * i + 1, fresh(20) + changed + fresh(20))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    assert {(r.doc_id, r.source_id) for r in rows} == {(2 * i + 1, 2 * i) for i in range(40)}


def test_passages_whose_first_holders_have_too_little(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(73)
    docs = [fresh(20) + passage[:48] + fresh(20), fresh(20) + passage[25:] + fresh(20), *(fresh(20) + passage + fresh(20) for _ in range(5))]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id, r.begin, r.end) for r in rows} == {(i, 2, 20, 93) for i in range(3, 7)}


def test_passages_reach_as_far_as_texts_are_alike(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(400)
    docs = [passage[:170] + fresh(9), passage[230:] + fresh(9), fresh(9) + passage, fresh(5) + passage + fresh(5)]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert (3, 2, 5, 405) in {(r.doc_id, r.source_id, r.begin, r.end) for r in rows}


@pytest.mark.parametrize("decoys", [5, 20, 100])
def test_fuzzy_passages_whose_seeds_many_others_hold(spark, decoys):
    """All its unchanged runs, scattered, are in a document before and very many between the two that have the passage; its last two words stand alone."""
    rng = random.Random(decoys)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(90)
    changed = [f"c{k}" if k % 8 == 7 else w for k, w in enumerate(passage)]
    runs = [passage[k : k + 7] for k in range(0, 90, 8)]
    scattered = lambda: [w for r in runs for w in r + fresh(60)]
    docs = [scattered(), fresh(9) + passage + fresh(9), *(scattered() for _ in range(decoys)), fresh(20) + changed + fresh(20), scattered()]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.begin, r.end, r.source_id, r.source_begin, r.source_end, r.edits) for r in rows] == [(decoys + 2, 20, 107, 1, 9, 96, 10)]
