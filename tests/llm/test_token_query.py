from corpusforge.llm import token_output as T

SF = "/root/testdata/sf0.001"


def test_the_query_alone_gives_the_tokens_back(spark):
    rows = T.op4_token_output(spark, SF).collect()
    back = {r["rank"]: r["token_id"] for r in rows if r["kind"] == "token"}
    got = sorted((r["doc_id"], [back[x] for x in T.unpack(r["control"], r["data"], r["n_tokens"]).tolist()]) for r in rows if r["kind"] == "document")
    e = T._encoding(T.VOCAB_FILE)[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == sorted((r["doc_id"], e.encode_ordinary(r["text"] or "")) for r in docs)
