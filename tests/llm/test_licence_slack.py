import pytest

from corpusforge.llm import licenses as L


@pytest.mark.parametrize(("cut", "added"), [(0, ""), (3, ""), (0, "two more"), (0, "one two three")])
def test_votes_of_the_second_phrase_only(spark, cut, added):
    mit = next(n for n in L.NOTICES if n.licence == "MIT-text")
    first, second = mit.phrases
    between = mit.text[len(first) : mit.text.index(second)].split()
    notice = " ".join([first, added, *between[cut:], second])
    rows = [(i, first) for i in range(30)] + [(99, f"before {notice} after")]
    got = [(r["doc_id"], r["matched"]) for r in L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["licence"] == "MIT-text"]
    assert got == [(99, notice)]
