"""Operator 10: packing documents into sequences by exact-complement hashing.

The plan is made from the histogram of lengths alone, whose size is bounded by
the capacity and not by the corpus. Going down from the longest length, the gap
it leaves is looked up among single lengths, then sums of two, then of three;
a combination that fills it exactly is used as often as the counts allow. What
finds no exact complement is packed best-fit in decreasing order. The plan's
ranges of items are then given out to the documents, numbered within a length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, slices, table
from .token_output import VOCAB_FILE, UnitEncoder

CAPACITY = 2048
#: Pieces of one length that are numbered together, at most or so.
PART_PIECES = 500_000

Plan = list[tuple[list[tuple[int, int]], int]]


class SumIndex:
    """The lengths that are left, indexed by single, pair and triple sums.

    A pair sum lists its pairs by their smaller length; a triple sum is a third
    length with a pair sum. Pairs whose lengths have run out are passed over and
    never looked at again, since counts only fall.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64)
        self.has = np.flatnonzero(self.left)
        top = len(self.left) - 1
        small, large = (self.has[k] for k in np.triu_indices(len(self.has)))
        total = small + large
        ok = (small < large) | (self.left[small] > 1)
        order = np.lexsort((small[ok], total[ok]))
        self.small = small[ok][order]
        #: Where each sum's pairs begin, and the first of them that may be left.
        self.edge = np.searchsorted(total[ok][order], np.arange(2 * top + 2))
        self.next = self.edge[:-1].copy()

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths with this sum, the largest possible first."""
        if not 0 < total < len(self.next):
            return None
        k, stop = int(self.next[total]), int(self.edge[total + 1])
        if k < stop:
            a = self.small[k:stop]
            hit = np.flatnonzero((self.left[a] > (2 * a == total)) & (self.left[total - a] > 0))
            self.next[total] = k = k + int(hit[0]) if len(hit) else stop
        return (total - int(self.small[k]), int(self.small[k])) if k < stop else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three lengths with this sum, the least of them first that can be."""
        third = self.has[: np.searchsorted(self.has, total // 3, side="right")]
        third = third[total - third < len(self.next)]
        third = third[(self.left[third] > 0) & (self.next[total - third] < self.edge[total - third + 1])]
        for a in third.tolist():
            pair = self.pair(total - a)
            if pair and a in pair:  # one item of that length is in use already
                pair = self._pair_beside(total - a, a)
            if pair:
                return (*pair, a)
        return None

    def _pair_beside(self, total: int, a: int) -> tuple[int, int] | None:
        """A pair with this sum when one item of length a is in use as well."""
        for k in range(int(self.next[total]), int(self.edge[total + 1])):
            x = int(self.small[k])
            y = total - x
            if self.left[x] > (x == y) + (x == a) and self.left[y] > (x == y) + (y == a):
                return y, x
        return None


def exact_combination(gap: int, index: SumIndex) -> tuple[int, ...] | None:
    """One, two or three available lengths with this sum; larger ones first."""
    if gap < 1:
        return None
    if gap < len(index.left) and index.left[gap]:
        return (gap,)
    return index.pair(gap) or index.triple(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns of (length, items a bin) with the number of bins of each.

    Every item is used exactly once. No pattern is longer than the capacity.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"length {size} is outside 1..{capacity}")
        left[size] += n
    made: Plan = []
    rest: list[tuple[int, int]] = []
    if left[capacity]:
        made.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    index = SumIndex(left)
    left = index.left
    for size in range(capacity - 1, 0, -1):
        while left[size]:
            index.take(size, 1)
            combo = exact_combination(capacity - size, index)
            index.take(size, -1)
            if combo is None:
                rest.append((size, int(left[size])))
                left[size] = 0
                break
            need: dict[int, int] = {}
            for x in (size, *combo):
                need[x] = need.get(x, 0) + 1
            times = min(int(left[x]) // k for x, k in need.items())
            for x, k in need.items():
                index.take(x, times * k)
            made.append((sorted(need.items(), reverse=True), times))
    made += _best_fit(rest, capacity)
    return made


def _best_fit(rest: list[tuple[int, int]], capacity: int) -> Plan:
    """Best-fit decreasing over counts: bins alike are kept as one group."""
    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    done: Plan = []

    def put(room: int, items: list[tuple[int, int]], n: int) -> None:
        if n:
            open_bins.setdefault(room, []).append((items, n))

    for size, n in rest:  # longest first
        for room in sorted(r for r in open_bins if r >= size):
            if not n:
                break
            fits, groups = room // size, open_bins.pop(room)
            for items, bins in groups:
                full = min(bins, n // fits)
                put(room - fits * size, [*items, (size, fits)], full)
                n -= full * fits
                bins -= full
                if bins and n:  # fewer than `fits` are left: one bin takes them
                    put(room - n * size, [*items, (size, n)], 1)
                    n, bins = 0, bins - 1
                put(room, items, bins)
        if n:
            fits = capacity // size
            put(capacity - fits * size, [(size, fits)], n // fits)
            if n % fits:
                put(capacity - n % fits * size, [(size, n % fits)], 1)
    for groups in open_bins.values():
        done += groups
    return done


def token_lengths(docs: DataFrame, vocab_file: str = VOCAB_FILE) -> DataFrame:
    """(doc_id, n_tokens) for each row of docs; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(vocab_file)
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder.counts(b.column(1)))], names=["doc_id", "n_tokens"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def _pieces(lengths: DataFrame, capacity: int) -> DataFrame:
    last = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    cut = lengths.filter("n_tokens > 0").select("doc_id", "row", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    size = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece").cast("long") * capacity)
    return cut.select("doc_id", "row", "piece", size.cast("int").alias("size"))


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """Sequences of at most `capacity` tokens from (doc_id, n_tokens).

    Returns bin_id, doc_id, piece, doc_offset, bin_offset, n_tokens: one row a
    piece. A document longer than the capacity gives full pieces and a rest;
    one of no or null length gives no row. Each row of the input is packed once,
    repeated and null doc_ids too. An empty table gives none; other columns are
    ignored.

    The pieces of a length are numbered in parts of about part_pieces, so many
    as its count asks for: by a number that rows get in being written first, so
    that neither repeated nor null doc_ids share a part.
    """
    kind = lengths.schema["doc_id"].dataType.simpleString()
    rows = materialise(lengths.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row")), "lengths")
    pieces = _pieces(rows, capacity)
    # at most `capacity` rows
    counts = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    parts = np.ones(capacity + 1, np.int64)
    for size, n in counts.items():
        parts[size] = -(-n // part_pieces)
    base = np.cumsum(parts) - parts
    split = F.array(*[F.lit(int(x)) for x in parts])
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.get(split, F.col("size"))).cast("int"))
    # a row for each part: the lengths, and one more for each part_pieces pieces
    first = np.zeros(int(parts.sum()), np.int64)
    for r in pieces.groupBy("size", "part").count().collect():
        first[base[r["size"]] + r["part"]] = r["count"]
    first = np.cumsum(first) - first
    first -= np.repeat(first[base], parts)
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bins = 0
    for items, n in plan(counts, capacity):
        offset = 0
        for size, k in items:
            start = used.get(size, 0)
            ranges.setdefault(size, []).append((start, k, bins, offset))
            used[size] = start + n * k
            offset += size * k
        bins += n
    look = {s: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for s, v in ranges.items()}

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["size"].to_numpy()
            number = b["number"].to_numpy() + first[base[size] + b["part"].to_numpy()]
            bin_id, at = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            for s in np.unique(size).tolist():
                rows = np.flatnonzero(size == s)
                start, k, begin, offset = look[s]
                r = np.searchsorted(start, number[rows], side="right") - 1
                nth = number[rows] - start[r]
                bin_id[rows] = begin[r] + nth // k[r]
                at[rows] = offset[r] + nth % k[r] * s
            piece = b["piece"].to_numpy()
            yield pd.DataFrame({"bin_id": bin_id, "doc_id": b["doc_id"], "piece": piece, "doc_offset": piece.astype(np.int64) * capacity, "bin_offset": at, "n_tokens": size})

    order = Window.partitionBy("size", "part").orderBy("doc_id", "row", "piece")
    numbered = pieces.withColumn("number", F.row_number().over(order).cast("long") - 1)
    return numbered.mapInPandas(give, f"bin_id long, doc_id {kind}, piece int, doc_offset long, bin_offset long, n_tokens int")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocab_file: str = VOCAB_FILE) -> DataFrame:
    """pack_lengths() of the documents' token counts; other columns are ignored."""
    return pack_lengths(token_lengths(docs, vocab_file), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
