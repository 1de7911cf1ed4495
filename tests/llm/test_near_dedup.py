import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from corpusforge.llm import near_dedup as N

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def near(a, b, t=N.THRESHOLD):
    return bool(a and b) and len(a & b) >= t * len(a | b)


def groups(rows):
    """Brute force over all pairs: {sets of row numbers}."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                root[find(i)] = find(j)
    by = defaultdict(list)
    for i in range(len(rows)):
        by[find(i)].append(rows[i][0])
    return {tuple(sorted(v)) for v in by.values() if len(v) > 1}


def found(df):
    by = defaultdict(list)
    for r in df.collect():
        by[r["group_id"]].append(r["doc_id"])
        assert r["group_id"] is not None
    return {tuple(sorted(v)) for v in by.values()}


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 9)):
            copy = [word() if rng.random() < rng.choice([0, 0.02, 0.05]) else w for w in text]
            rows.append(" ".join(copy))
    rows += ["one two", "one two", "two one", "solo", "", None, " ", "long " * 30_000, "long " * 20_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_recall_and_precision_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sig string, root int")
    got, want = found(N.near_duplicates(docs)), groups(rows)
    sets = dict(rows)
    true = {(a, b) for g in want for a in g for b in g if a < b and near(shingles(sets[a]), shingles(sets[b]))}
    have = {(a, b) for g in got for a in g for b in g if a < b}
    assert len(true & have) >= 0.9 * len(true)
    assert have <= {(a, b) for g in want for a in g for b in g if a < b}


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got, want = found(N.near_duplicates(docs)), groups(rows)
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a < b}
    assert pairs(want) and len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want)) and pairs(got) <= pairs(want)


def test_dropping_keeps_one_of_each_group(spark):
    rows = corpus(5) + [(999, "a repeated row of text"), (999, "a repeated row of text"), (None, "alone and without any id")]
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, tid long")
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    dup = N.near_duplicates(docs)
    n_groups = dup.select("group_id").distinct().count()
    assert len(left) == len(rows) - dup.count() + n_groups
    assert sum(r["text"] == "a repeated row of text" for r in left) == 1
    assert sum(r["text"] is None or not r["text"].strip() for r in left) == 3


def test_signature_estimates_the_similarity():
    rng = random.Random(3)
    w = [str(rng.random()) for _ in range(400)]
    v = [x if rng.random() > 0.05 else "new" + x for x in w]
    _, sig = N.signatures(pa.array([" ".join(w), " ".join(v)]))
    a, b = shingles(" ".join(w)), shingles(" ".join(v))
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.12


def test_posterior_bounds():
    least = N.least_matches(0.5, 0.005)
    rng = np.random.default_rng(1)
    alive = np.ones(4000, bool)
    hits = rng.random((4000, N.HASHES)) < 0.55
    for n, need in zip(N.BATCHES, least, strict=True):
        alive &= hits[:, :n].sum(axis=1) >= need
    assert alive.mean() > 0.98
    hits = rng.random((4000, N.HASHES)) < 0.2
    assert (hits[:, : N.BATCHES[1]].sum(axis=1) >= least[1]).mean() < 0.1


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0


def test_many_unlike_texts_in_one_bucket(spark, monkeypatch):
    """5,000 texts that share some bands and are unlike, but for a few pairs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    shared = [word() for _ in range(24)]
    rows = [" ".join(shared + [word() for _ in range(30)]) for _ in range(5_000)]
    alike = [(i, 2_500 + 7 * i) for i in range(20)]
    for i, j in alike:
        rows[j] = rows[i] + " one more"
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    blocks = []
    monkeypatch.setattr(N._Checker, "likely_across", lambda self, b, block, old=N._Checker.likely_across: blocks.append(b.groupBy("key").count().agg({"count": "max"}).first()[0]) or old(self, b, 64))
    assert found(N.near_duplicates(docs)) == {tuple(sorted(p)) for p in alike}
    assert blocks[0] > 64


def test_blocks_give_what_one_block_gives(spark):
    docs = spark.createDataFrame(corpus(7), "doc_id long, text string")
    roots = lambda block: {(r["doc_id"], r["root"]) for r in N.near_groups(docs, block=block).collect()}
    assert roots(512) == roots(2)


def test_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(N.op2_near_dedup(spark, SF)) == found(N.near_duplicates(docs))
