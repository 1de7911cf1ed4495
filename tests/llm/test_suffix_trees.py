from collections import defaultdict

import pytest

from corpusforge.llm import suffix_trees as S

from .oracle import same_rows
from .test_suffix_array import corpus, spans

SF = "/root/testdata/sf0.001"


def every_repeat(rows, words):
    """Brute force: all runs of all lengths in two texts that differ on both
    sides, with their places in texts."""
    cut = {t: t.split() for _, t in rows if t}
    found = {}
    for n in range(words, max(map(len, cut.values()), default=0) + 1):
        seen = defaultdict(set)
        for t, w in cut.items():
            for i in range(len(w) - n + 1):
                seen[tuple(w[i : i + n])].add((t, i))
        for run, places in seen.items():
            if len({t for t, _ in places}) < 2:
                continue
            left = {cut[t][i - 1] if i else (t, i) for t, i in places}
            right = {cut[t][i + n] if i + n < len(cut[t]) else (t, i) for t, i in places}
            if len(left) > 1 and len(right) > 1:
                found[run] = places
    return cut, found


def repeats(rows, words):
    cut, found = every_repeat(rows, words)
    owners = defaultdict(set)
    for d, t in rows:
        if t:
            owners[t].add(d)
    least = lambda t: min((d for d in owners[t] if d is not None), default=None)
    key = lambda d: (d is None, d)
    out, inside = set(), defaultdict(list)
    for run, places in found.items():
        total = sum(len(owners[t]) for t, _ in places)
        first = min(((*key(least(t)), i) for t, i in places), key=lambda x: x)
        out.add((str(first[1]), first[2], len(run), total, str(first[1])))
        for t, i in places:
            inside[t].append((i, i + len(run), total, first[1]))
    for t, w in cut.items():
        if len(owners[t]) > 1 and len(w) >= words and not any(a == 0 and z == len(w) for a, z, *_ in inside[t]):
            inside[t].append((0, len(w), len(owners[t]), least(t)))
        for a, z, total, first in inside[t]:
            if not any(x <= a and z <= y and (x, y) != (a, z) for x, y, *_ in inside[t]):
                out |= {(str(d), a, z - a, total, str(first)) for d in owners[t]}
    return sorted(out)


def shown(df):
    return sorted((str(r["doc_id"]), r["begin_word"], r["n_words"], r["n_occurrences"], str(r["first_doc_id"])) for r in df.collect())


@pytest.mark.parametrize(("words", "seed", "most", "letters"), [(12, 6, 40, 10**6), (9, 4, 5, 3), (12, 5, 10**6, 20)])
def test_against_brute_force(spark, words, seed, most, letters):
    rows = corpus(words * 7 + seed)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, name int, at int")
    got = shown(S.maximal_repeats(docs, words, seed, most, letters))
    assert got == repeats(rows, words) and got


def test_repeats_cover_the_repeated_spans():
    rows = corpus(3)
    covered = {(d, i) for d, b, n, *_ in repeats(rows, 12) for i in range(b, b + n)}
    assert covered == {(d, i) for d, a, z in spans(rows, 12) for i in range(a, z)}


def test_against_sql(spark):
    assert same_rows(S.op7_suffix_trees(spark, SF), S.ORACLES["op7_suffix_trees"], SF) > 10


def test_empty_table(spark):
    assert S.maximal_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_that_do_not_fit_are_found_too(spark):
    rows = [(i, "own%d " % i * (i % 3) + "a b c d e f g h " + ("x y z" if i % 2 else "z y x w")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = S.with_tid(docs)
    one = S.repeated_texts(texts, S.word_counts(texts), 8, 4)
    assert S.split_prefixes(one, 8, 4, 10).large and not S.split_prefixes(one, 8, 4, 1000).large
    assert shown(S.maximal_repeats(docs, 8, 4, 10)) == shown(S.maximal_repeats(docs, 8, 4, 1000)) == repeats(rows, 8)


def test_long_repeats_with_a_shared_passage(spark):
    a, b, p = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 300), ("b", 300), ("p", 60)))
    rows = [(1, f"one {a} {p} {b} end"), (2, f"two {a} {p} {b} stop"), (3, f"three {p} other"), (4, f"three {p} other"), (5, p)]
    rows += [(6, "x y " * 40), (7, "y x " * 33 + "z"), (8, p), (9, f"{p} {p} {p}"), (None, f"{p} odd")]
    got = shown(S.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == repeats(rows, 50)
    assert [x for x in got if x[2] == 660] == [("1", 1, 660, 2, "1"), ("2", 1, 660, 2, "1")]
    assert ("1", 301, 60, 10, "1") in got  # the passage in eight documents, three times in one of them


def test_very_long_texts_that_are_alike(spark):
    w = [f"w{i}" for i in range(20_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:9_999], "x", *w[10_000:]])), (3, " ".join([*w[:4_999], "y", *w[5_000:]])), (4, " ".join(w))]
    got = shown(S.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert ("1", 0, 20_000, 2, "1") in got and ("4", 0, 20_000, 2, "1") in got
    # between the two changes all four are alike; on either side three of them
    assert ("1", 5_000, 4_999, 4, "1") in got and ("2", 0, 9_999, 3, "1") in got and ("3", 5_000, 15_000, 3, "1") in got
