import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusforge.llm import token_output as T

WORDS = st.text(alphabet=st.sampled_from("ab 'st\n\t  é 　漢🙂1.,\x0b\x1c"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, max_size=6))
def test_units_give_the_ids_of_whole_texts(texts):
    ids, edge = T.UnitEncoder().batch(pa.array(texts, pa.string()))
    e = T._encoding(T.VOCAB_FILE)[0]
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [e.encode_ordinary(t) for t in texts]


def test_a_full_cache_keeps_what_is_used_most():
    encoder, e = T.UnitEncoder(most=40), T._encoding(T.VOCAB_FILE)[0]
    rng = np.random.default_rng(1)
    for _ in range(30):
        texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, 60) % 500) + " often" for _ in range(5)] + [" often" * 9, " \n", "", None, "one\x1ctwo"]
        ids, edge = encoder.batch(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [e.encode_ordinary(t or "") for t in texts]
        assert encoder.counts(pa.array(texts, pa.string())).tolist() == [len(e.encode_ordinary(t or "")) for t in texts]
        assert len(encoder.key) <= 40
    often = T.hash_spans_twice(np.frombuffer(b" often", np.uint8), np.array([0]), np.array([6]))[0]
    assert often[0] in encoder.key


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_pack_round_trip(ids):
    control, data = T.pack(np.array(ids, np.uint32))
    assert len(control) == -(-len(ids) // 4)
    assert T.unpack(control, data, len(ids)).tolist() == ids


def test_table_round_trip(spark):
    rows = [(1, "the cat the cat", 7), (2, None, 7), (3, "", 7), (None, "the end  of", 7), (1, "the cat the cat", 7), (5, "x" * 200_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out, ranking = T.token_output(docs)
    back = {r["rank"]: r["token_id"] for r in ranking.collect()}
    assert sorted(back) == list(range(len(back)))
    n = [r["n"] for r in ranking.orderBy("rank").collect()]
    assert n == sorted(n, reverse=True)
    e = T._encoding(T.VOCAB_FILE)[0]
    got = sorted((str(r["doc_id"]), [back[x] for x in T.unpack(r["control"], r["data"], r["n_tokens"]).tolist()]) for r in out.collect())
    assert got == sorted((str(i), e.encode_ordinary(t or "")) for i, t, _ in rows)


def test_ranking_against_brute_force(spark):
    from collections import Counter

    # b, c and d are as frequent as each other: ties go by the tokenizer's id
    texts = ["a a a b", "c d", None, "", "a b c d"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranking = T.token_output(docs)[1].collect()
    e = T._encoding(T.VOCAB_FILE)[0]
    n = Counter(i for t in texts for i in e.encode_ordinary(t or ""))
    want = sorted(n, key=lambda i: (-n[i], i))
    assert len(set(n.values())) < len(n)
    assert sorted((r["rank"], r["token_id"], r["n"]) for r in ranking) == [(k, i, n[i]) for k, i in enumerate(want)]


def test_empty_table(spark):
    out, ranking = T.token_output(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and ranking.count() == 0
