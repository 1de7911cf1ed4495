"""Where repeats can be: what the two substring operators share.

A run of `words` words that stands in two texts holds, in both, the same
*anchor*: winnowing picks the `seed`-word window of least name among every
words - seed + 1 neighbours, a choice that depends on these words alone. So
only positions near an anchor that stands in another text too need be sorted;
all others are unique at that length and are discarded before the first sort,
without loss.

Texts are told apart by tid, a 64-bit hash of the text: exact copies count as
one text here and are put back at the end, by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, marked, materialise, may_hold, sieve, slices, window_names

#: Repeats of fewer words are let stand; the anchors' length.
MIN_WORDS, SEED_WORDS = 50, 25


def with_tid(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(doc_id, tid, n_words) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(Words(b.column(1)).count.astype(np.int32))], names=["doc_id", "tid", "n_words"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, tid long, n_words int")


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of `size` items, by doubling."""
    span = 1
    while span * 2 <= size:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = size - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors_of(w: Words, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers in the batch, names) of the anchors of all rows.

    Of equal names in a neighbourhood all are taken, so copies choose alike.
    """
    name = window_names(w.hash, seed)
    near = words - seed + 1
    if len(name) < near:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(name, near, np.minimum)
    start = np.arange(len(least))
    whole = w.row[start] == w.row[start + words - 1]  # the neighbourhood is one row's
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    # a position is chosen if it has the least name of some whole neighbourhood
    chosen = np.zeros(len(name), bool)
    for k in range(near):
        hit = whole & (name[k : k + len(least)] == least) & (least != none)
        chosen[k : k + len(least)] |= hit
    at = np.flatnonzero(chosen)
    return at, name[at]


def _emit_anchors(words: int, seed: int, bitmap: Broadcast | None = None):
    """(tid, at, name) of all anchors, or of those that the bit map may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            w = Words(b.column(0))
            at, name = anchors_of(w, words, seed)
            if bitmap is not None:
                may = marked(bitmap.value, name)
                at, name = at[may], name[may]
            tid = b.column(1).to_numpy()[w.row[at]]
            place = (at - w.first[w.row[at]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(place), pa.array(name.view(np.int64))], names=["tid", "at", "name"])

    return run


def shared_keys(rows: DataFrame, keys: list[str], more: str | None = None) -> DataFrame:
    """The keys that two different tids have, with the least tid as `more`.

    Counted by partial sums, so that a key of a third of all rows sends one row
    a task.
    """
    both = rows.groupBy(*keys).agg(F.min("tid").alias("_low"), F.max("tid").alias("_high")).filter("_low < _high")
    return both.select(*keys, *([F.col("_low").alias(more)] if more else []))


def repeated_texts(texts: DataFrame, counts: DataFrame, words: int, seed: int) -> DataFrame:
    """(tid, text, at, no): each text once that shares an anchor with another,
    where its shared anchors are, and a number. Written to the shared folder.

    Names that two texts have are found first; a second pass over the texts
    takes their places.
    """
    pick = texts.select("text", "tid")
    shared = materialise(shared_keys(pick.mapInArrow(_emit_anchors(words, seed), "tid long, at int, name long"), ["name"]), "shared-anchors")
    bitmap = texts.sparkSession.sparkContext.broadcast(may_hold(shared, "name"))
    found = pick.mapInArrow(_emit_anchors(words, seed, bitmap), "tid long, at int, name long")
    live = found.join(shared, "name", "left_semi").groupBy("tid").agg(F.collect_set("at").alias("at"))
    return materialise(one_of_each(texts, counts, live).withColumn("no", F.monotonically_increasing_id()), "repeated-texts")


def one_of_each(texts: DataFrame, counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (a tid a row, further columns) with the text of each tid, once.

    A sieve of fixed size keeps most other texts out of the join; a second key
    spreads the rows of hot texts.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    first = counts.groupBy(F.col("tid").alias("t")).agg(F.min(key).alias("d"))
    more = [c for c in wanted.columns if c != "tid"]
    wanted = materialise(wanted.join(first, wanted.tid == first.t).select("t", "d", *more), "wanted")
    rows = sieve(texts.select("tid", "text", key.alias("key")), "tid", may_hold(wanted, "t"))
    joined = rows.join(wanted, (rows.tid == wanted.t) & (rows.key == wanted.d))
    # rows alike in doc_id and text are one
    return joined.dropDuplicates(["tid"]).select("tid", "text", *more)


def near_anchors(w: Words, at: pa.ListArray, words: int, seed: int, length: int | None = None) -> np.ndarray:
    """Word numbers in the batch at which a run of `words` words holds an anchor.

    With a shorter `length`: where runs of so many words begin that lie in one of those.
    """
    length = length or words
    flat = at.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy(zero_copy_only=False))
    place = w.first[row] + flat
    mark = np.zeros(len(w.hash) + 1, np.int32)
    np.add.at(mark, np.maximum(place - (words - seed), w.first[row]), 1)
    np.add.at(mark, np.minimum(place + 1 + words - length, len(w.hash)), -1)
    near = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    near = near[near + length <= len(w.hash)]
    return near[w.row[near] == w.row[near + length - 1]]


def copies(counts: DataFrame, words: int) -> DataFrame:
    """(tid): texts of `words` words and more that several documents have whole."""
    by = counts.filter(F.col("n_words") >= words).groupBy("tid")
    return by.agg(F.count_distinct(F.struct("doc_id")).alias("n_docs")).filter("n_docs > 1").select("tid", "n_docs")
