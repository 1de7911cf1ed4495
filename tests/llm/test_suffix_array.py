import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusforge.llm import _anchors as A
from corpusforge.llm import suffix_array as S
from corpusforge.llm._common import Words, window_names

from .oracle import same_rows

SF = "/root/testdata/sf0.001"


def spans(rows, words):
    """Brute force over (doc_id, text)."""
    docs = sorted({(str(d), t) for d, t in rows if t})
    seen = defaultdict(set)
    for k, (_, t) in enumerate(docs):
        w = t.split()
        for i in range(len(w) - words + 1):
            seen[tuple(w[i : i + words])].add(k)
    out = []
    for d, t in docs:
        w = t.split()
        at = [i for i in range(len(w) - words + 1) if len(seen[tuple(w[i : i + words])]) > 1]
        for i in at:
            if out and out[-1][0] == d and out[-1][3] == t and i <= out[-1][2]:
                out[-1][2] = i + words
            else:
                out.append([d, i, i + words, t])
    return sorted((d, a, b) for d, a, b, _ in out)


def corpus(seed, n=30, letters=60):
    rng = random.Random(seed)
    shared = [[f"w{rng.randrange(letters)}" for _ in range(rng.randint(3, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [f"w{rng.randrange(letters)}" for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                w += rng.choice(shared)
        if rng.random() < 0.2:
            w = ["same"] * rng.randint(0, 40)
        rows.append((i, " ".join(w)))
    return rows + [(n, rows[0][1]), (0, rows[0][1]), (n + 1, None), (None, rows[1][1]), (n + 2, "")]


@pytest.mark.parametrize(("words", "seed", "first"), [(12, 6, 1), (12, 3, 5), (13, 2, 13), (9, 9, 2)])
def test_against_brute_force(spark, words, seed, first):
    rows = corpus(words + seed)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, tid int, at int")
    got = sorted((str(r["doc_id"]), r["begin_word"], r["end_word"]) for r in S.repeated_spans(docs, words, seed, first).collect())
    assert got == spans(rows, words) and got


def test_against_sql(spark):
    assert same_rows(S.op1_suffix_array(spark, SF), S.ORACLES["op1_suffix_array"], SF) > 10


def test_shared_runs_share_an_anchor():
    rng = random.Random(1)
    run = [f"x{rng.randrange(9)}" for _ in range(20)]
    picks = []
    for _ in range(2):
        head = [f"x{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        w = Words(pa.array([" ".join(head + run + ["end"] * 5)]))
        at, name = A.anchors_of(w, 20, 8)
        inside = (at >= len(head)) & (at + 8 <= len(head) + 20)
        picks.append(set(zip((at[inside] - len(head)).tolist(), name[inside].tolist(), strict=True)))
    assert picks[0] & picks[1]


def test_window_names_tell_runs_apart():
    h = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    for n in (1, 2, 3, 5, 8):
        names = window_names(h, n)
        runs = [tuple(h[i : i + n].tolist()) for i in range(len(h) - n + 1)]
        assert len(names) == len(runs)
        assert all((names[i] == names[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(len(runs)))


def test_empty_table(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rounds_of_the_query(spark, monkeypatch):
    made, write = [], S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, name, *how: made.append(name) or write(df, name, *how))
    rows = [(i, f"own{i} " + " ".join(f"w{k}" for k in range(80 + i))) for i in range(3)]
    got = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["begin_word"], r["end_word"]) for r in got) == [(0, 1, 81), (1, 1, 82), (2, 1, 82)]
    assert made.count("pairs") == 3  # by 14, 28 and 50 words


def test_very_long_texts_and_hot_passages(spark):
    w = [f"w{i}" for i in range(20_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:10_000], "x", *w[10_000:]]))] + [(i, " ".join(w[100:160]) + f" own{i}") for i in range(3, 40)]
    got = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 0, 20_000), (2, 0, 10_000), (2, 10_001, 20_001), *[(i, 0, 60) for i in range(3, 40)]]
    assert sorted((r["doc_id"], r["begin_word"], r["end_word"]) for r in got) == sorted(want)
