import pytest
from pyspark.sql import functions as F

from corpusforge.functions import nlp, pieces

S = "Mary Jones trains at Jones Athletics."
ONE, TWO = "<START:person> Mary Jones <END>", "<START:organization> Jones Athletics <END>"


@pytest.mark.parametrize(
    ("spans", "skip", "want"),
    [
        ([(0, 10, "person"), (21, 36, "organization")], False, f"{ONE} trains at {TWO} ."),
        ([(21, 36, "organization"), (0, 10, "person")], False, f"{ONE} trains at {TWO} ."),
        ([(0, 10, None), (21, 36, None)], False, "<START> Mary Jones <END> trains at <START> Jones Athletics <END> ."),
        ([(0, 10, "person"), (0, 10, "agent"), (21, 36, "organization")], False, f"{ONE} trains at Jones Athletics ."),
        ([(0, 10, "person"), (0, 10, "agent"), (21, 36, "organization")], True, f"{ONE} trains at {TWO} ."),
        ([(0, 10, "person"), (5, 10, "family"), (21, 36, "organization")], False, f"{ONE} trains at Jones Athletics ."),
        ([(0, 2, "x"), (21, 36, "organization")], False, "Mary Jones trains at Jones Athletics ."),
        ([(0, 2, "x"), (21, 36, "organization")], True, f"Mary Jones trains at {TWO} ."),
        ([], False, "Mary Jones trains at Jones Athletics ."),
    ],
)
def test_merge(spans, skip, want):
    assert nlp.merge_spans(S, spans, skip) == want


def test_merge_columns(spark):
    df = spark.createDataFrame([(S, [0, 21, 3], [10, 36], ["person", "organization"]), (None, [0], [1], ["x"]), (S, None, None, None)], "t string, b array<int>, e array<int>, k array<string>")
    got = [r[0] for r in df.select(nlp.merge_annotations("t", nlp.zip_spans("b", "e", "k"))).collect()]
    assert got == [f"{ONE} trains at {TWO} .", None, "Mary Jones trains at Jones Athletics ."]
    fixed = df.limit(1).select(nlp.merge_annotations("t", nlp.zip_spans("b", "e"), "entity")).first()[0]
    assert fixed == "<START:entity> Mary Jones <END> trains at <START:entity> Jones Athletics <END> ."
    scalar = df.limit(1).select(nlp.merge_annotations("t", nlp.zip_spans(F.array(F.lit(0)), F.array(F.lit(10)), F.array(F.lit("person"))))).first()[0]
    assert scalar == f"{ONE} trains at Jones Athletics ."


def test_tokens(spark):
    text = "A 12-year-old... said \"like\" it's é漢٣ !!?"
    want = ["A", "12", "-", "year", "-", "old", "...", "said", '"', "like", '"', "it", "'", "s", "é漢", "٣", "!!", "?"]
    assert [text[a:b] for a, b in nlp.token_spans(text)] == want
    assert spark.createDataFrame([(text,)], "t string").select(nlp.tokens("t")).first()[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
        ('He said "Go." Then left.', ['He said "Go."', "Then left."]),
        ("Mr. Smith met J. Doe at 5 p.m. today. It rained.", ["Mr. Smith met J. Doe at 5 p.m. today.", "It rained."]),
        ("Pi is 3.14 or so. 42 is more.", ["Pi is 3.14 or so.", "42 is more."]),
        ("  lead and trail  ", ["lead and trail"]),
        ("The U.S. Army came. Well...", ["The U.S. Army came.", "Well..."]),
        ("", []),
        (None, []),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in nlp.sentence_spans(text)] == want


def test_sentences_with_links(spark):
    text = "A one. B\ttwo.\nC three.\n"
    links = [("x", 9, 12), ("y", 2, 5), ("z", 2, 12), ("w", 2, 5), ("v", 16, 21)]
    pars = [("p", 0, 13), ("p", 14, 22)]
    df = spark.createDataFrame([("t", text, links, pars), ("none", "", [], [])], "title string, text string, links array<struct<target:string,begin:int,end:int>>, paragraphs array<struct<tagname:string,begin:int,end:int>>")
    got = [tuple(r) for r in nlp.sentences_with_links(df).collect()]
    assert got == [("t", 1, "A one.", "w", 2, 5), ("t", 1, "A one.", "y", 2, 5), ("t", 2, "B two.", "x", 2, 5), ("t", 3, "C three.", "v", 2, 7)]


def test_pieces_are_bounded():
    import pyarrow as pa

    texts = pa.array(["a" * 10, None, "b" * 25, "c" * 10, "", "d" * 10])
    assert list(pieces.pieces(texts, 20)) == [(0, 2), (2, 3), (3, 6)]
    assert list(pieces.pieces(pa.array(["x"] * 4500))) == [(0, 2000), (2000, 4000), (4000, 4500)]
    assert list(pieces.pieces(pa.array([], pa.string()))) == []
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    rows = [[(1, 2)], [], [(3, None), (5, 6)], [], [(7, 8)]]
    made = pieces.struct_lists(rows, kind)
    assert list(pieces.field_lists(made, "begin", "end")) == rows
    assert list(pieces.field_lists(made.slice(2, 3), "end", "type")) == [[(None, None), (6, None)], [], [(8, None)]]
    assert list(pieces.field_lists(pa.array([None, [{"begin": 1, "end": 2}], [None]], kind), "end")) == [[], [(2,)], [(None,)]]


def test_long_sentence_of_many_links_goes_in_pieces(spark):
    n = 3000
    text = "word " * n  # 15 kB that each link has again: 45 MB
    links = [("x", 5 * k, 5 * k + 4) for k in range(n)]
    df = spark.createDataFrame([("t", text, links, [("p", 0, len(text))])], "title string, text string, links array<struct<target:string,begin:int,end:int>>, paragraphs array<struct<tagname:string,begin:int,end:int>>")
    found = nlp.sentences_with_links(df)
    assert found.groupBy("sentenceOrder", "sentence").count().collect() == [(1, text.rstrip(), n)]
    assert found.agg(F.sum("linkBegin")).first()[0] == 5 * n * (n - 1) // 2


def test_sentences_are_computed_once(spark):
    """No filter that the optimizer makes of the links runs the UDFs again."""
    from corpusforge.plans import ner
    from corpusforge.sources import wikidump

    raw = spark.createDataFrame([("t", "u", "A [[b]] c. D [[e]] f.")], "title string, uri string, markup string")
    rows = ner.page_sentences(wikidump.parse_raw(raw))
    plan = rows.filter("linkTarget is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1
    assert [tuple(r)[1:] for r in rows.collect()] == [(1, "http://en.wikipedia.org/wiki/B", 2, 3, "A b c."), (2, "http://en.wikipedia.org/wiki/E", 2, 3, "D e f.")]
