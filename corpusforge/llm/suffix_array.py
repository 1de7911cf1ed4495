"""Operator 1: substring dedup over a suffix array by prefix doubling.

Positions are ranked by their first words. Round by round, the pairs (rank of
the words here, rank of the words as many further on) are sorted and numbered,
which ranks the positions by twice as many words; those whose pair stands in no
other text are unique and discarded. When the ranked length reaches the
threshold, what is left is where repeats begin.

Only distinct pairs are sorted: partial sums find them and whether two texts
have them, so that a pair of a third of all positions is one row a task, and a
join (whose hot keys Spark splits) gives the positions their new ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._anchors import MIN_WORDS, SEED_WORDS, copies, near_anchors, repeated_texts, with_tid, word_counts
from ._common import SPACE_RE, Words, discard, materialise, slices, table, window_names, written

#: Words that positions are ranked by before the first round.
FIRST_WORDS = 7


def _first_pairs(words: int, seed: int, first: int):
    step = min(first, words - first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            w = Words(b.column(1))
            name = window_names(w.hash, first)
            at = near_anchors(w, b.column(2), words, seed, first + step)
            no = b.column(3).to_numpy()[w.row[at]]
            place = (at - w.first[w.row[at]]).astype(np.int32)
            here, there = name[at].view(np.int64), name[at + step].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(place), pa.array(here), pa.array(there)], names=["no", "at", "r1", "r2"])

    return run


def repeated_starts(one: DataFrame, words: int, seed: int, first: int) -> DataFrame:
    """(tid, at): where `words` words begin that stand in another text too."""
    spark = one.sparkSession
    pairs = one.mapInArrow(_first_pairs(words, seed, first), "no long, at int, r1 long, r2 long")
    ranked, mark = first + min(first, words - first), written()
    pairs = materialise(pairs, "pairs", "zstd")
    while True:
        known = pairs.groupBy("r1", "r2").agg(F.min("no").alias("low"), F.max("no").alias("high")).filter("low < high").select("r1", "r2")
        if ranked >= words:
            kept = pairs.join(known, ["r1", "r2"], "left_semi").select("no", "at")
            return kept.join(one.select("no", "tid"), "no").select("tid", "at")
        # sorted by both ranks and numbered: the rank by twice as many words
        known = materialise(known.orderBy("r1", "r2").withColumn("rank", F.monotonically_increasing_id()), "ranks", "zstd")
        step = min(ranked, words - ranked)
        ahead = Window.partitionBy("no").orderBy("at").rangeBetween(step, step)
        ranks = pairs.join(known, ["r1", "r2"]).select("no", "at", "rank")
        longer = ranks.select("no", "at", F.col("rank").alias("r1"), F.max("rank").over(ahead).alias("r2")).filter("r2 is not null")
        done, pairs = written(), materialise(longer, "pairs", "zstd")
        discard(spark, mark, done)
        ranked, mark = ranked + step, done


def _merge(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            at = col.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(col)), np.diff(np.asarray(col.offsets)))
            order = np.lexsort((at, row))
            at, row = at[order], row[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + words)
            start = np.flatnonzero(fresh)
            stop = np.append(start[1:], len(at)) - 1 if len(start) else start
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row[start])), pa.array(at[start]), pa.array(at[stop] + words)],
                names=["tid", "begin_word", "end_word"],
            )

    return run


def repeated_spans(docs: DataFrame, words: int = MIN_WORDS, seed: int = SEED_WORDS, first: int = FIRST_WORDS) -> DataFrame:
    """doc_id, begin_word, end_word: what a document shares with others.

    All runs of `words` words that stand in two documents, those that overlap or
    adjoin joined into one span; words are counted from 0, the end is excluded.
    Repeats within one document alone are let stand. Rows alike in doc_id and
    text count once, rows of one doc_id with other texts as other documents.
    Null, empty and shorter texts have no span; other columns are ignored; an
    empty table gives an empty one.

    `seed` words make an anchor (see _anchors), `first` words the first ranks,
    which are 64-bit hashes; all further ones are places in a sorted order.
    """
    if not (0 < seed <= words and 0 < first <= words):
        raise ValueError("seed and first must be 1..words")
    texts = with_tid(docs)
    counts = materialise(word_counts(texts), "word-counts")
    one = repeated_texts(texts, counts, words, seed)
    starts = repeated_starts(one, words, seed, first)
    spans = starts.groupBy("tid").agg(F.collect_list("at").alias("at")).mapInArrow(_merge(words), "tid long, begin_word long, end_word long")
    whole = copies(counts, words).select(F.col("tid").alias("t"))
    rows = counts.filter(F.col("n_words") >= words).distinct()
    of_copies = rows.join(whole, rows.tid == whole.t, "left_semi").select("doc_id", F.lit(0).cast("long").alias("begin_word"), F.col("n_words").cast("long").alias("end_word"))
    others = rows.join(whole, rows.tid == whole.t, "left_anti").join(spans, "tid").select("doc_id", "begin_word", "end_word")
    return of_copies.unionByName(others)


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


_ORACLE = f"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split_regex(text, '{SPACE_RE}'), lambda x: x <> '') AS w FROM documents
),
runs AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + {MIN_WORDS}], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS i FROM cut)
),
shared AS (SELECT run FROM runs GROUP BY run HAVING count(DISTINCT doc_id) > 1),
starts AS (SELECT DISTINCT doc_id, i FROM runs WHERE run IN (SELECT run FROM shared)),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MIN_WORDS} THEN 0 ELSE 1 END AS fresh FROM starts
),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked)
SELECT doc_id, min(i) AS begin_word, max(i) + {MIN_WORDS} AS end_word FROM numbered GROUP BY doc_id, span
"""

QUERIES = {"op1_suffix_array": op1_suffix_array}
ORACLES = {"op1_suffix_array": _ORACLE}
