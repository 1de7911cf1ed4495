import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusforge.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def distances(pattern, text):
    """The least distance of the pattern to a part of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abcd", max_size=30))
def test_myers_is_the_edit_distance(pattern, text):
    assert D.myers(pattern, text) == distances(pattern, text)


def mutate(rng, s, edits):
    for _ in range(edits):
        i = rng.randrange(len(s))
        s = s[:i] + rng.choice(["", "x", "yz"[:1] + s[i]]) + s[i + 1 :]
    return s


def test_every_item_within_the_budget_is_found():
    rng = random.Random(4)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(50, 120))).strip()) for i in range(12)]
    matcher = D.Matcher(items, 0.06)
    for _ in range(150):
        n = rng.randrange(12)
        noise = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) for _ in range(2)]
        text = noise[0] + mutate(rng, items[n][1], rng.randint(0, matcher.k[n] + 3)) + noise[1]
        got = {i: d for i, d, _, _ in matcher.find(text)}
        want = {i: d for i, (d, _) in ((i, distances(item, text)) for i, item in items) if d <= matcher.k[i]}
        assert got == want


def test_short_items_stand_as_whole_words():
    matcher = D.Matcher([(1, "ten chars!"[:9] + "x"), (2, "a")], 0.06)
    assert matcher.find("ten charsx") == [(0, 0, 0, 10)] and matcher.find("b ten charsx a") == [(0, 0, 2, 12), (1, 0, 13, 14)]
    assert matcher.find("often charsx") == [] and matcher.find("ten charsxy ab ba") == [] and matcher.find("ten charx") == []


def test_normalised():
    assert D.normalised(pa.array(["  A--b\n\nC. ", None, "", "é x", ".", "y"], pa.string())) == ["a b c", "", "", "é x", "", "y"]


def test_planted_passages_and_exact_containment(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.find_leaks(docs, items).collect()}
    rows = [(r["doc_id"], D.normalised(pa.array([r["text"]]))[0]) for r in docs.collect()]
    tests = [(r["item_id"], D.normalised(pa.array([r["text"]]))[0]) for r in items.collect()]
    exact = {(d, i) for d, t in rows for i, s in tests if s in t}
    assert exact and {k for k, v in got.items() if v == 0} == exact
    kept = {r["doc_id"] for r in D.decontaminate(docs, items).select("doc_id").collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_odd_tables(spark, monkeypatch):
    item = "this is the only test item that is long enough to be looked for"
    docs = spark.createDataFrame(
        [(1, "x " + item.upper() + " y", 1), (1, "x " + item.upper() + " y", 1), (2, None, 1), (3, "", 1), (None, "w " * 50_000 + item + " " + item, 1), (5, "clean", 1), (6, "a shorter, SHORT one", 1), (7, "shorts", 1)], "doc_id long, text string, item_id int"
    )
    tests = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "Short!"), (10, item + " or more of it")], "item_id long, text string")
    want = [("1", 7), ("1", 7), ("6", 9), ("None", 7)]
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in D.find_leaks(docs, tests).collect()) == want
    kept = D.decontaminate(docs, tests)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 7]
    monkeypatch.setattr(D, "PASS_CHARS", 30)  # several blocks
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in D.find_leaks(docs, tests).collect()) == want
    assert D.decontaminate(docs, tests).count() == 4
    assert D.find_leaks(docs, tests.limit(0)).count() == 0 and D.decontaminate(docs.limit(0), tests).count() == 0


def test_the_query(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert sorted(map(str, D.op8_decontamination(spark, SF).collect())) == sorted(map(str, D.find_leaks(docs, items).collect()))
