import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusforge.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_statistics_of_odd_texts():
    x = Q.statistics(pa.array([None, "", " \n", "plain words here", "A|B | c ###"], pa.string()))
    assert x.shape == (5, len(Q.STATISTICS)) and not x[:3].any() and np.isfinite(x).all()
    assert x[4, Q.STATISTICS.index("bars")] > 0


def plain_statistics(text):
    """The rule statistics again, word by word and byte by byte."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\r\f\x0b]+", raw) if w]
    n, size = max(len(words), Q.LEAST_WORDS), max(len(raw), Q.LEAST_BYTES)
    symbol = lambda b: sum(x in b"#$%&*^{|}~!" for x in b)
    upper, lower = (sum(a <= x <= z for x in raw) for a, z in ((65, 90), (97, 122)))
    long = [w for w in words if len(w) >= 8]
    shares = [
        symbol(raw) / size,
        sum(symbol(w) >= 2 for w in words) / n,
        upper / max(upper + lower, Q.LEAST_BYTES),
        sum(w == b"|" for w in words) / n,
        (len(long) - len(set(long))) / max(len(long), 8),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(x < 9 or 14 <= x < 32 or x == 127 for x in raw) / size,
        sum(len(w) > 60 for w in words) / n,
    ]
    return np.sqrt(shares)


def test_statistics_against_plain_python(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]
    docs += [None, "", "A|B | c ### $$x", "same same same words words", "\x01\x7f odd\x1f signs", "x" * 61 + " " + "é" * 40, "repeated1 repeated1 repeated2 REPEATED2 repeated1"]
    assert np.allclose(Q.statistics(pa.array(docs, pa.string())), np.stack([plain_statistics(t) for t in docs]), atol=1e-12)


def test_the_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = Q.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = dict(zip(docs, model.score(pa.array(list(docs.values()))), strict=True))
    got = {r["doc_id"]: (r["score"], r["threshold"]) for r in Q.op6_quality(spark, SF).collect()}
    assert got == {d: (s, model.threshold) for d, s in score.items() if s <= model.threshold and docs[d].strip()}


def brute_path(tree, row):
    feature, cut, child, depth = tree
    at = 0
    while feature[at] >= 0:
        at = child[at][int(row[feature[at]] > cut[at])]
    return depth[at]


def test_score_follows_the_paths():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(300, 3)), rng.normal(8, 1, size=(9, 3))
    f = Q.IsolationForest(good, bad, trees=20)
    x = np.concatenate([good[:20], bad])
    mean = np.array([np.mean([brute_path(t, r) for t in f.trees]) for r in x])
    assert np.allclose(f.score(x), 2.0 ** (-mean / Q._expected(f.sample)), atol=1e-6)
    assert f.score(bad).min() > np.median(f.score(good))


def test_threshold_keeps_the_loss():
    score = np.array([0.1, 0.2, 0.3, 0.9, 0.8, 0.25])
    good = np.array([True, True, True, False, False, False])
    t = Q.calibrate(score, good, 0.0)
    assert 0.3 < t < 0.8
    assert Q.calibrate(score, np.ones(6, bool)) == 1.0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fitted = labels.filter("doc_id % 2 = 0")
    kept = {r["doc_id"] for r in Q.quality_filter(docs, fitted).select("doc_id").collect()}
    held = labels.filter("doc_id % 2 = 1").collect()
    bad = [r["doc_id"] in kept for r in held if not r["quality"]]
    good = [r["doc_id"] in kept for r in held if r["quality"]]
    assert np.mean(bad) < 0.1 and np.mean(good) > 0.98


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a fine text", 3, 1), (1, "a fine text", 3, 1), (2, None, 3, 1), (None, "x " * 100_000, 3, 1), (4, "", 3, 1)], "doc_id long, text string, score int, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.quality_filter(docs, none)
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "1", "None"]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert Q.quality_filter(docs, labels).count() == 3
    assert Q.quality_filter(docs.limit(0), labels).count() == 0


def many(spark, n=9000):
    """Labelled texts with more or less symbols. One in ten is bad and has many,
    and so have good ones, but only those whose ids have the largest hashes."""
    rng = np.random.default_rng(5)
    rows = []
    for place, r in enumerate(spark.range(n).orderBy(F.xxhash64("id")).collect()):
        bad = r["id"] % 10 == 0
        p = rng.uniform(0.1, 0.9) if bad or place >= n - 100 else rng.uniform(0, 0.12)
        words = ["#$%" if x < p else "WORD" if x < p * 1.5 else "plain" for x in rng.random(30)]
        rows.append((r["id"], " ".join(words), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5).cache()


def test_every_labelled_row_counts(spark):
    docs = many(spark)
    model = Q.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    rows = docs.collect()
    x = Q.statistics(pa.array([r["text"] for r in rows]))
    good = np.array([r["quality"] == 1 for r in rows])
    # the threshold is that of all rows, not of some thousands
    assert np.sum(model.forest.score(x[good]) > model.threshold) <= Q.MAX_LOSS * good.sum()
    assert model.threshold == Q.calibrate(model.forest.score(x), good) < 1.0
    # leaves have the sizes that all rows give them
    plain, odd = Q.sizes(good.sum(), (~good).sum())
    for tree in model.forest.trees[:3]:
        feature, cut, child, depth = tree
        size, level = np.zeros(len(feature)), np.zeros(len(feature))
        for row, g in zip(x, good):
            at = 0
            while feature[at] >= 0:
                below = child[at][int(row[feature[at]] > cut[at])]
                level[below] = level[at] + 1
                at = below
            size[at] += plain / good.sum() if g else odd / (~good).sum()
        leaf = (feature < 0) & (size > 0)
        assert np.allclose(depth[leaf], [level[k] + Q._expected(size[k]) for k in np.flatnonzero(leaf)])


def test_trees_draw_from_all_rows(spark):
    docs = many(spark)
    rows = Q.labelled_statistics(docs.select("doc_id", "text"), docs.select("doc_id", "quality")).cache()
    count = {True: 8100, False: 900}
    got = Q.draw(rows, count)
    plain, odd = Q.sizes(8100, 900)
    assert len(got) == Q.TREES and {len(s) for s in got} == {plain + odd}
    # the least lots of all rows, whatever the partitions
    local = rows.collect()
    key, good = np.array([r["key"] for r in local]).view(np.uint64), np.array([r["good"] for r in local])
    x = np.array([r["x"] for r in local])
    for t in (0, 1, 150):
        lot = Q.mix(key ^ Q.mix(np.array([t + 1], np.uint64))) >> np.uint64(1)
        want = [i for kind, k in ((True, plain), (False, odd)) for i in sorted(np.flatnonzero(good == kind), key=lambda i: lot[i])[:k]]
        assert sorted(map(tuple, got[t])) == sorted(map(tuple, x[want]))
    again = Q.draw(rows.repartition(2), count)
    assert all(sorted(map(tuple, a)) == sorted(map(tuple, b)) for a, b in zip(got, again))


def test_drawing_from_equal_rows(spark):
    docs = spark.createDataFrame([(d, "equal words here") for d in [1] * 3000 + [2] * 2000 + [3]], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    got = Q.draw(Q.labelled_statistics(docs, labels), {True: 3001, False: 2000})
    assert len(got) == Q.TREES and all(len(s) == sum(Q.sizes(3001, 2000)) for s in got)


def test_threshold_by_counts():
    rng = np.random.default_rng(2)
    score, good = np.round(rng.random(5000), 2), rng.random(5000) < 0.8
    at, place = np.unique(score, return_inverse=True)
    for loss in (0.0, 0.001, 0.05, 0.5):
        kept = np.sort(score[good])[::-1]
        least = kept[int(loss * len(kept))]
        above = score[score > least]
        want = least + (above.min() - least) * 0.5 if len(above) else 1.0
        assert Q.calibrate(score, good, loss) == want
        assert Q.calibrate(at, np.bincount(place, weights=good).astype(int), loss, np.bincount(place)) == want
