from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusforge.llm import packing as P

COUNTS = st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8)


@settings(max_examples=200, deadline=None)
@given(COUNTS)
def test_plan_uses_each_item_once(counts):
    used = Counter()
    for items, n in P.plan(counts, 30):
        assert n > 0 and sum(s * k for s, k in items) <= 30
        for s, k in items:
            used[s] += k * n
    assert used == Counter(counts)


@settings(max_examples=200, deadline=None)
@given(COUNTS, st.integers(1, 40))
def test_exact_combination_is_found_whenever_there_is_one(counts, gap):
    left = np.zeros(31, np.int64)
    for s, n in counts.items():
        left[s] = n
    brute = any(
        sum(c) == gap and all(n <= counts[s] for s, n in Counter(c).items()) for k in (1, 2, 3) for c in combinations_with_replacement(sorted(counts), k)
    )
    got = P.exact_combination(gap, P.SumIndex(left))
    assert (got is not None) == brute
    if got:
        assert sum(got) == gap and all(n <= counts[s] for s, n in Counter(got).items())


def test_full_bins_come_before_best_fit():
    made = P.plan({7: 1, 3: 1, 6: 1, 2: 2, 9: 1}, 10)
    assert sorted(tuple(i) for i, _ in made) == sorted([((7, 1), (3, 1)), ((6, 1), (2, 2)), ((9, 1),)])


def check(rows, lengths, capacity):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append((r["bin_offset"], r["n_tokens"]))
        docs[r["doc_id"]].append(r["n_tokens"])
    for spans in bins.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end = a + n
        assert end <= capacity
    assert sorted(bins) == list(range(len(bins)))
    want = defaultdict(int)
    for d, n in lengths:
        want[d] += n or 0
    assert {d: sum(v) for d, v in docs.items()} == {d: n for d, n in want.items() if n}
    return len(bins)


def test_all_rows_are_packed(spark):
    rng = np.random.default_rng(3)
    lengths = [(int(i), int(n)) for i, n in enumerate(rng.integers(0, 250, 400))] + [(5, 40), (5, 40), (None, 33), (7, None)]
    out = P.pack_lengths(spark.createDataFrame(lengths, "doc_id long, n_tokens long"), 100, 2).collect()
    n = check(out, lengths, 100)
    assert n <= 1.02 * sum(x or 0 for _, x in lengths) / 100 + 1


def test_a_third_of_all_rows_alike_is_numbered_in_parts(spark):
    lengths = [(7, 60)] * 300 + [(None, 40)] * 300 + [(i, 100) for i in range(300)]
    out = P.pack_lengths(spark.createDataFrame(lengths, "doc_id long, n_tokens long"), 100, 50).collect()
    assert check(out, lengths, 100) == 600


def test_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = {r["doc_id"]: r["n_tokens"] for r in P.token_lengths(docs).collect()}
    check(P.op10_packing(spark, "/root/testdata/sf0.001").collect(), list(n.items()), P.CAPACITY)


def test_texts_with_odd_rows_and_clashing_columns(spark):
    rows = [(1, "a b c", 9, 9), (2, None, 9, 9), (3, "", 9, 9), (4, "word " * 3000, 9, 9)]
    out = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, size int, part int")).collect()
    assert {r["doc_id"] for r in out} == {1, 4} and max(r["n_tokens"] for r in out) == P.CAPACITY


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
