import re
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline as C
from corpusforge.llm import decontaminate as D
from corpusforge.llm import quality as Q

from .test_near_dedup import near, shingles
from .test_packing import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        made.append(docs)
    return made


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_quality_stage_rejects_bad_rows_only(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q]
    assert sum(d in after for d in good) >= 0.98 * len(good)
    bad = [d for d, q in labels.items() if not q]
    assert sum(d in after for d in bad) <= 0.2 * len(bad)
    model = Q.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    col = pa.array(list(before.values()))
    assert set(after) == {d for d, s in zip(before, model.score(col), strict=True) if s <= model.threshold}


def test_near_stage_keeps_one_of_each_group(stages):
    before, after = texts(stages[1]), texts(stages[2])
    sets = {d: shingles(t) for d, t in before.items()}
    ids = sorted(before)
    copy_of = defaultdict(set)
    for a in ids:
        for b in ids:
            if a < b and near(sets[a], sets[b]):
                copy_of[a].add(b)
                copy_of[b].add(a)
    alone = {d for d in ids if not copy_of[d]}
    assert alone <= set(after)
    left = {d for d in after if copy_of[d] & set(after)}
    assert len(left) <= 0.1 * max(1, sum(1 for d in ids if copy_of[d]))
    for d in set(ids) - set(after):
        assert copy_of[d]


def test_decontamination_stage(spark, stages):
    before, after = texts(stages[2]), texts(stages[3])
    items = [D.normalised(pa.array([r["text"]]))[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {d for d, t in before.items() if any(i in D.normalised(pa.array([t]))[0] for i in items)}
    assert exact <= set(before) - set(after) and len(set(before) - set(after)) <= len(exact) + 2


def test_secret_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for d, t in before.items():
        assert after[d] == re.sub(r'(token = ")[0-9a-f]{40}', r"\1[secret]", t)


def test_packing_stage_and_run(spark, stages):
    from corpusforge.llm.token_output import VOCAB_FILE, _encoding

    lengths = [(d, len(_encoding(VOCAB_FILE)[0].encode_ordinary(t))) for d, t in texts(stages[4]).items()]
    rows = stages[5].collect()
    check(rows, lengths, 2048)
    again = C.run(spark, SF).collect()
    # which of the pieces of one length goes where depends on the order of rows
    pieces = lambda found: sorted((r["doc_id"], r["piece"], r["doc_offset"], r["n_tokens"]) for r in found)
    assert check(again, lengths, 2048) == len({r["bin_id"] for r in rows}) and pieces(again) == pieces(rows)


@pytest.mark.parametrize("empty", [["documents"], ["labels"], ["benchmark"], ["documents", "labels", "benchmark"]])
def test_run_over_empty_and_odd_tables(spark, tmp_path, empty):
    tables = {
        "documents": ([(1, "a fine text of some words", "en", "s", 1), (1, "a fine text of some words", "en", "s", 1), (2, None, None, None, None), (None, "", "en", "s", 0), (3, "long words " * 30_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(1, 1, 0), (1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, "held by none of the documents here at all"), (2, None), (None, "x")], "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame([] if name in empty else rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = C.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == (set() if "documents" in empty else {1, 3})
    assert out.columns == ["bin_id", "doc_id", "piece", "doc_offset", "bin_offset", "n_tokens"]
