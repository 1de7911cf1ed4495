import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusforge.llm import token_counts as C
from corpusforge.llm.token_output import VOCAB_FILE, UnitEncoder, _encoding

ENCODER = UnitEncoder()
TEXT = st.text(alphabet=st.sampled_from("ab 'st\n\t é\xa0漢1.,"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 70), st.integers(-2, 70), TEXT), max_size=5))
def test_edits_give_the_count_of_the_new_text(text, edits):
    doc, plain = C.CountedText(text, ENCODER), text
    for begin, end, new in edits:
        doc.edit(begin, end, new)
        a = min(max(begin, 0), len(plain))
        plain = plain[:a] + new + plain[min(max(end, a), len(plain)) :]
        assert doc.text == plain and doc.tree.total == (len(plain), len(_encoding(VOCAB_FILE)[0].encode_ordinary(plain)))
        level = doc.tree.levels[0]
        for up in doc.tree.levels[1:]:
            level = C.SegmentTree._above(level, 0)
            assert (level == up).all()


def test_far_edit_reencodes_little():
    doc = C.CountedText("some words go here " * 5000, ENCODER)
    doc.edit(40_000, 40_004, "x y")
    assert doc.reencoded < 40


def test_find():
    t = C.SegmentTree(np.array([[3, 1], [2, 1], [4, 2]]))
    assert [t.find(i) for i in (0, 2, 3, 4, 5, 8, 9)] == [(0, 0), (0, 0), (1, 3), (1, 3), (2, 5), (2, 5), (3, 9)]


def test_query_against_full_encoding(spark):
    rows = [(1, "mail me.x@a.example.com now 1234567890123456 ok", 1), (1, "mail me.x@a.example.com now 1234567890123456 ok", 1), (2, None, 1), (3, "", 1), (None, "plain", 1), (5, "b@c.de " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    import re

    enc = _encoding(VOCAB_FILE)[0].encode_ordinary
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_tokens_after"]) for r in C.edited_counts(C.with_redactions(docs)).collect())
    assert got == sorted((str(i), len(enc(t or "")), len(enc(re.sub(C.REDACTED, "[redacted]", t or "")))) for i, t, _ in rows)
    assert C.edited_counts(C.with_redactions(docs.limit(0))).count() == 0


def test_own_edits_with_nulls_and_overlap(spark):
    docs = spark.sql(
        "select 1L doc_id, 'one two three' text, array(named_struct('begin',0,'end',5,'new','x'), null, named_struct('begin',4,'end',7,'new',null), named_struct('begin',null,'end',7,'new','z')) edits"
    )
    r = C.edited_counts(docs).collect()[0]
    assert r["n_edits"] == 2 and r["n_tokens_after"] == len(_encoding(VOCAB_FILE)[0].encode_ordinary("x three"))


def test_state_goes_on_from_batch_to_batch(spark):
    rows = [(1, "one two three"), (2, None), (3, "far away from any edit"), (4, "wide\u3000space here")]
    state = C.build_trees(spark.createDataFrame(rows, "doc_id long, text string"))
    enc = _encoding(VOCAB_FILE)[0].encode_ordinary
    plain = dict(rows)
    for begin, end, new in ((0, 3, "1"), (5, 5, "\n  more"), (2, 9, "")):
        edits = spark.createDataFrame([(d, [(begin, end, new)]) for d in (1, 2, 4)], f"doc_id long, edits {C.EDITS}")
        state = C.apply_edits(state.select("doc_id", "text", "n_tokens", "tree").join(edits, "doc_id", "left"))
        for d in (1, 2, 4):
            t = plain[d] or ""
            plain[d] = t[:begin] + new + t[max(begin, end) :] if begin <= len(t) else t + new
        got = {r["doc_id"]: r for r in state.collect()}
        assert {d: r["text"] for d, r in got.items()} == plain
        for d, r in got.items():
            t = plain[d] or ""
            leaves = C._loaded(r["tree"])
            assert r["n_tokens"] == len(enc(t)) == leaves[:, 1].sum() and leaves[:, 0].sum() == len(t)


def test_redacted_counts_are_those_of_the_edits_column(spark):
    rows = [(1, "mail me.x@a.example.com now 1234567890123456 ok", 1), (1, "x \"%s\" y" % ("0f" * 20), 1), (2, None, 1), (3, "", 1), (None, "no match \u00e9", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tree int")
    assert sorted(map(str, C.redacted_counts(docs).collect())) == sorted(map(str, C.edited_counts(C.with_redactions(docs)).collect()))
    assert C.redacted_counts(docs.limit(0)).count() == 0


def test_the_query(spark):
    import re

    enc = _encoding(VOCAB_FILE)[0].encode_ordinary
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted((r["doc_id"], r["n_tokens"], r["n_tokens_after"], r["n_edits"]) for r in C.op9_token_counts(spark, "/root/testdata/sf0.001").collect())
    hits = {d["doc_id"]: re.findall(C.REDACTED, d["text"], re.ASCII) for d in docs}
    assert any(hits.values())
    assert got == sorted((d["doc_id"], len(enc(d["text"])), len(enc(re.sub(C.REDACTED, "[redacted]", d["text"], flags=re.ASCII))), len(hits[d["doc_id"]])) for d in docs)


def test_kept_columns_must_not_clash(spark):
    import pytest

    with pytest.raises(ValueError, match="tree"):
        C.build_trees(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, Tree int"), keep=["Tree"])
