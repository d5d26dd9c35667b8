"""Conversation repair, cross-tokenizer alignment and the n-gram Jaccard join against brute force and SQL, with odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from foliospark.llm import alignment, conversation_repair, jaccard_join, queries

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def same_as_sql(spark, name, folder, table):
    got = queries.queries()[name](spark, str(folder)).toPandas()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = db.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(tuple("none" if pd.isna(v) else str(int(v)) if isinstance(v, int | float) else str(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want)
    return got


# conversation repair


def cheapest(initials, faults):
    """All edits of a few turns, with up to four insertions, that give (s?(ua)+)?."""
    best = None
    options = [["D"] if f in (1, 2) else ["D", "K", "Ru", "Ra"] for f in faults]
    for edits in itertools.product(*options):
        for spots in itertools.product(range(3), repeat=len(edits) + 1):
            if sum(spots) > 4:
                continue
            for inserted in itertools.product("ua", repeat=sum(spots)):
                rest, audit, out, cost = iter(inserted), "", "", 0
                for i in range(len(edits) + 1):
                    for _ in range(spots[i]):
                        audit, out, cost = audit + "I", out + next(rest), cost + 5
                    if i < len(edits):
                        e = edits[i]
                        audit += e[0]
                        cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if faults[i] == 3 and e != "D" else 0)
                        out += "" if e == "D" else initials[i] if e == "K" else e[1]
                if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def solve(turns, block=None, monkeypatch=None):
    if block:
        monkeypatch.setattr(conversation_repair, "BLOCK", block)
    c = conversation_repair._Conversation(1)
    for i, (role, text, state) in enumerate(turns):
        c.add(i, role, text, state)
    r = c.result()
    return r["cost"], r["audit"], r["repaired"]


def test_repair_against_all_edits(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(0, 4)
        turns = [(rng.choice(["system", "user", "assistant", "tool"]), f"t{rng.randrange(6)}", rng.choice([0, 0, 0, 1, 3])) for _ in range(n)]
        seen, faults = set(), []
        for r, t, s in turns:
            faults.append(2 if s != 1 and (r, t) in seen else s)
            if s != 1:
                seen.add((r, t))
        want = cheapest("".join(r[0] for r, _, _ in turns), faults)
        for block in (1, 2, 512):
            cost, audit, repaired = solve(turns, block, monkeypatch)
            assert (cost, audit) == want
            assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in repaired))


def test_repair_in_blocks_is_the_same(monkeypatch):
    rng = random.Random(2)
    for _ in range(20):
        turns = [(rng.choice(["system", "user", "assistant", "x", ""]), f"t{rng.randrange(500)}", rng.choice([0, 0, 0, 0, 1, 3])) for _ in range(200)]
        assert solve(turns, 7, monkeypatch) == solve(turns, 1000, monkeypatch)


def test_repair_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in range(150):
        at = rng.randrange(-3, 4)
        for _ in range(rng.randint(0, 9)):
            at += rng.choice([0, 1, 1, 1, 4])
            text = rng.choice(["Yes.", "No", "  ", "", None, "What?  ", "half a sente", "Ünï 世界!\n", "a b c."]) if rng.random() < 0.6 else f"words {rng.randrange(99)}."
            rows.append((c, None if rng.random() < 0.1 else at, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), text))
    rows += [(None, 0, "user", "A turn without a conversation."), (None, None, "assistant", "Another."), (900, None, None, None), rows[0], rows[0]]
    rows += [(901, i, ("user", "assistant")[i % 2 if i % 11 else 0], f"turn {i % 700}" + "." * (i % 5 > 0)) for i in range(1400)]  # several blocks
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = same_as_sql(spark, "op11_conversation_repair", tmp_path, "conversations")
    assert got["audit"].str.contains("R").any() and (got["gaps"] > 0).any()


def test_repair_on_the_tables(spark):
    got = queries.queries()["op11_conversation_repair"](spark, SF).toPandas()
    want = duckdb.sql(queries.oracle_sql()["op11_conversation_repair"].replace("FROM conversations", f"FROM '{SF}/conversations.parquet'")).df()
    assert got.sort_values("conv_id").values.tolist() == want.sort_values("conv_id")[got.columns].values.tolist()


def test_repair_empty_and_other_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 5, True), (1, 1, "assistant", "Hello.", 6, False)], TURNS + ", state long, gone boolean")
    r = conversation_repair.repair_conversations(rows).collect()
    assert [(x.audit, x.cost, [(t.role, t.text) for t in x.repaired]) for x in r] == [("KK", 0, [("user", "Hi."), ("assistant", "Hello.")])]
    r = conversation_repair.repair_conversations(rows, "gone").collect()
    assert [(x.audit, x.cost) for x in r] == [("D", 2)]
    rows.where("false").select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.queries()["op11_conversation_repair"](spark, str(tmp_path)).collect() == []


# alignment


def walked(text, hf, sp, letters):
    """Tokens, groups and links by walking over both lists; None where the bytes differ."""
    a, b = hf.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    own = [bytes(letters[c] for c in hf.id_to_token(k)) for k in a]
    other = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [sp.id_to_piece(k)]]
    if not text or b"".join(own) != (" " + text).encode() or b"".join(other) != (" " + text).encode():
        return None
    ends = [list(itertools.accumulate(map(len, x))) for x in (own, other)]
    links, u, v = [], 0, 0
    while u < len(a):
        links.append((u, v))
        step_a, step_b = ends[0][u] <= ends[1][v], ends[1][v] <= ends[0][u]
        u, v = u + step_a, v + step_b
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [(sum(e <= c for e in ends[0]), sum(e <= c for e in ends[1])) for c in cuts]
    return a, b, links, groups


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(A_PATH)
    hf.encode_special_tokens = True
    return hf, sentencepiece.SentencePieceProcessor(model_file=B_PATH), alignment._byte_of()


ODD = [None, "", " ", "a", "the  two spaces", "tab\tand\nline\r\n", "Ünïcode 世界 🎈é", "<|endoftext|> <s></s> <unk>", "ﬁ ① ㎏ wide　space", "x" * 5000, "  lead", "trail ", "\u0000\u0007", "a▁b", "it's 12,345.67 of the the the"]


def test_alignment_parts(spark, tokenizers):
    rows = [(i if i != 3 else None, t, "x", "y") for i, t in enumerate([*ODD, ODD[5]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, a_ids string, links string")
    got = alignment.align_tokens(df.coalesce(1), A_PATH, B_PATH).collect()
    n_empty = 0
    for (i, t, _, _), r in zip(rows, got, strict=True):
        want = walked(t or "", *tokenizers)
        n_empty += want is None
        a, b, links, groups = want or ([], [], [], [])
        assert (r.doc_id, r.a_ids, r.b_ids, [tuple(x) for x in r.links], [tuple(x) for x in r.groups]) == (i, a, b, links, groups)
    assert 2 < n_empty < len(rows)
    assert alignment.align_tokens(df.where("false"), A_PATH, B_PATH).collect() == []


def test_alignment_query(spark, tokenizers, tmp_path, monkeypatch):
    from collections import Counter, defaultdict

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1003, "a")]
    spark.createDataFrame([(i, t, "en", None, 0) for i, t in docs], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    all_of = [(i, walked(t or "", *tokenizers)) for i, t in docs]
    counts, best, want = Counter(), defaultdict(int), []
    for _, x in all_of:
        if x:
            counts.update((x[0][u], x[1][v]) for u, v in x[2])
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for i, x in all_of:
        if x is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = x
        cut = zip([(0, 0), *groups], groups, strict=False)
        text = ";".join(",".join(map(str, a[p:r])) + "|" + ",".join(map(str, b[q:s])) for (p, q), (r, s) in cut)
        pairs = [(a[u], b[v]) for u, v in links]
        want.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in queries.queries()["op12_token_alignment"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_alignment_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.queries()["op12_token_alignment"](spark, str(tmp_path)).collect() == []


def test_marks():
    rng = np.random.default_rng(5)
    places = np.unique(rng.integers(0, 1000, 200))
    m = alignment.Marks.at(places, 1000)
    assert m.select().tolist() == places.tolist()
    at = np.arange(1001)
    assert m.rank(at).tolist() == [int((places < p).sum()) for p in at]


def test_ranks_encode_as_the_vocabulary_file(tokenizers):
    hf, rng = tokenizers[0], random.Random(6)
    texts = ["".join(rng.choice("ab e1'.,!\n\té世🎈sthTHE") for _ in range(400)) for _ in range(60)]
    assert alignment.codec(A_PATH).encode(texts) == [hf.encode(" " + t, add_special_tokens=False).ids for t in texts]


# Jaccard join


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


def odd_corpus(seed):
    """Copies, chains of near copies, near-threshold groups without a common centre, mosaics of shared passages, odd rows."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = ["", None, "  ", "one", "one two", "ONE two", "a b c d", "a b c d e"]
    for _ in range(4):
        base = fresh(120)
        texts += [" ".join(base)] * 3 + [" ".join(edited(rng, base, 0.02)) for _ in range(12)]
    base = fresh(300)
    texts += [" ".join(edited(rng, base, 0.013 + 0.01 * (k % 3))) for k in range(40)]
    chain = fresh(150)
    for _ in range(15):
        chain = chain[2:] + fresh(2)
        texts.append(" ".join(chain))
    passages = [" ".join(fresh(40)) for _ in range(6)]
    texts += [" ".join(rng.sample(passages, 4)) for _ in range(25)]
    rng.shuffle(texts)
    return texts


def test_jaccard_sql_on_odd_rows(spark, tmp_path):
    texts = odd_corpus(7)
    rows = [(None if i % 31 == 0 else i if i % 29 else 7, t, "en", None, 0) for i, t in enumerate(texts)]
    rows += [rows[40], rows[40], rows[41]]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = same_as_sql(spark, "op13_jaccard_join", tmp_path, "documents")
    assert 30 < got["component_id"].nunique() < len(rows) - 40


@pytest.mark.parametrize("seed", [8, 9])
def test_jaccard_blocks(spark, tmp_path, monkeypatch, seed):
    """Long lists in small blocks, and joins by shuffle, give the same."""
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 900)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 3)
    rows = [(i, t, "en", None, 0) for i, t in enumerate(odd_corpus(seed))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, "op13_jaccard_join", tmp_path, "documents")


def test_jaccard_block_counts():
    rng = np.random.default_rng(3)
    base = np.arange(60)
    sets = [np.sort(np.concatenate([rng.choice(base, 52, replace=False), [1000 + i]])) for i in range(30)]
    frame = pd.DataFrame({"id": range(30), "n": [len(s) for s in sets], "c": range(30), "sizes": [[int((s < 20).sum()), 0, int((s >= 20).sum())] for s in sets], "s": sets})
    out = jaccard_join._block(80, frame.iloc[:12], frame.iloc[12:])
    label = list(range(30))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.product(range(12), range(12, 30)):
        inter = len(np.intersect1d(sets[a], sets[b]))
        if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
            label[find(max(a, b))] = find(min(a, b)) if find(a) != find(b) else label[find(max(a, b))]
    mine = list(range(30))

    def root(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for a, b in out.itertuples(index=False):
        mine[root(b)] = root(a) if root(a) != root(b) else mine[root(b)]
    same = lambda f: {frozenset(x for x in range(30) if f(x) == r) for r in {f(x) for x in range(30)}}
    assert same(root) == same(find) and len(out)


def test_jaccard_other_columns_and_empty_tables(spark, odd_docs, no_docs):
    got = jaccard_join.jaccard_join(odd_docs, percent=80, shingle=3).collect()
    assert len(got) == odd_docs.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[(3, 0)] == 3 and by[(2, 0)] == 2
    assert jaccard_join.jaccard_join(no_docs).collect() == []
