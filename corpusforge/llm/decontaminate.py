"""Operator 8: benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with one space for each run of other signs. A
test item of n characters may differ in k = n * ERROR_RATE edits. Cut into k + 1
pieces, at least one stands unchanged in any text that holds the item, so exact
hits of pieces (one Aho-Corasick automaton) give all places to look at; there
Myers' bit-parallel algorithm finds the least edit distance. Items of less than
SHORT_CHARS compared characters are looked for unchanged, at word edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table, text_buffer
from .licenses import _IN_WORD, _LOWER

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
#: Shorter items (in compared characters) must stand unchanged, as whole words.
SHORT_CHARS = 40
#: Characters of items that one pass over the documents looks for.
PASS_CHARS = 16_000_000


def normalised(col: pa.Array) -> list[str]:
    """The texts as they are compared; null gives ''."""
    raw, rows = text_buffer(col)
    low = _LOWER[raw]
    inside = _IN_WORD[low]
    after = np.concatenate([[False], inside[:-1]])
    starts = rows[:-1][rows[:-1] < len(raw)]
    after[starts] = False
    keep = inside | after
    out = np.where(inside, low, np.uint8(32))[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[rows]
    return [out[a:b].decode("utf-8", "replace").rstrip(" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def pieces(item: str, rate: float = ERROR_RATE) -> tuple[int, list[tuple[int, str]]]:
    """(allowed edits k, the k + 1 pieces with their places)."""
    k = int(len(item) * rate) if len(item) >= SHORT_CHARS else 0
    edge = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a]


@lru_cache(maxsize=4096)
def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of text, the first end of one).

    Bit-parallel (Myers 1999): one Python integer holds a column of differences.
    """
    m = len(pattern)
    masks, full, top = _masks(pattern), (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """Finds items in compared texts; made anew in each worker."""

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        import ahocorasick

        self.items, self.k = items, []
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            k, cut = pieces(item, rate)
            self.k.append(k)
            for at, piece in cut:
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, begin, end) for each item in the text, its best place."""
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                starts.setdefault(n, set()).add(end + 1 - size - at)
        found = []
        for n, diagonals in sorted(starts.items()):
            item, k = self.items[n][1], self.k[n]
            if len(item) < SHORT_CHARS:
                whole = (d for d in sorted(diagonals) if text[max(d - 1, 0) : d] in ("", " ") and text[d + len(item) : d + len(item) + 1] in ("", " "))
                if (d := next(whole, None)) is not None:
                    found.append((n, 0, d, d + len(item)))
                continue
            best, spans = None, []
            for d in sorted(diagonals):  # places that overlap are looked at together
                low, high = max(0, d - k), min(len(text), d + len(item) + k)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            for low, high in spans:
                distance, end = myers(item, text[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    back, size = myers(item[::-1], text[low : low + end][::-1])
                    best = (distance, low + end - size, low + end)
            if best:
                found.append((n, *best))
        return found


def _items(benchmark: DataFrame) -> Iterator[tuple[Broadcast, pa.DataType]]:
    """The items to look for, sent to the tasks in blocks of about PASS_CHARS
    characters, with the type of their ids.

    A benchmark of any size is worked off block by block: the documents are read
    once for each. The driver's Python holds one block at a time; those it has
    made lie on disk, where broadcast values are kept.
    """
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.filter("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(-(-total // PASS_CHARS)) or 1
    for n in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        got = part.collect()
        texts = normalised(pa.array([r["text"] for r in got], pa.string()))
        items = sorted({(r["item_id"], t) for r, t in zip(got, texts, strict=True) if t})
        if items:
            yield sc.broadcast(items), pa.array([items[0][0]]).type


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, begin, end: each item a document holds, once.

    Of several places in a document, the first of the least distance; begin and
    end are characters of the compared text. Null and empty texts hold nothing;
    items with nulls or without any compared character are left out, repeated
    ones count once. Repeated rows of docs repeat their findings; other columns
    are ignored. An empty table on either side gives none.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, distance int, begin int, end int"
    plain = docs.select("doc_id", F.col("text").cast("string"))
    out = None
    for items, kind in _items(benchmark):
        part = plain.mapInArrow(_finder(items, rate, kind), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out


def _finder(sent: Broadcast, rate: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        matcher = Matcher(items, rate)
        for b in slices(batches, 1):
            out = [(i, *hit) for i, text in enumerate(normalised(b.column(1))) if text for hit in matcher.find(text)]
            at = pa.array([o[0] for o in out], pa.int64())
            numbers = [pa.array([o[k] for o in out], pa.int32()) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([items[o[1]][0] for o in out], kind), *numbers], names=["doc_id", "item_id", "distance", "begin", "end"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item of the benchmark (see find_leaks()).

    All columns stay as they are, whatever their names. Null and empty texts and
    repeated rows stay; where one row goes, those like it go too.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = [c.lower() for c in docs.columns].index("text")
    out = docs.toDF(*names)
    for items, _ in _items(benchmark):
        out = out.mapInArrow(_dropper(items, rate, at), out.schema)
    return out.toDF(*docs.columns)


def _dropper(sent: Broadcast, rate: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, rate)
        for b in slices(batches, at):
            yield b.filter(pa.array([not (t and matcher.find(t)) for t in normalised(b.column(at))], pa.bool_()))

    return run


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
