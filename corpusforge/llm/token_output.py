"""Operator 4: token-id output in a byte-aligned variable-length coding.

Ids are ranked by frequency over all documents (0 the most frequent, ties by
the tokenizer's id), so that frequent tokens take one byte. A text's ids are
stored as control bytes (two bits an id: its length in bytes less one, four ids
a control byte, the first in the low bits) apart from the data bytes (little
endian); numpy decodes them by a table lookup on the control bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _IS_SPACE, hash_spans_twice, materialise, offsets, slices, table, text_buffer

VOCAB_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that a worker keeps (some 60 bytes each); beyond, the half used least goes.
CACHE_UNITS = 1_000_000
#: White space beyond ASCII can join units; such texts are encoded whole.
_WIDE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@lru_cache(maxsize=2)
def _encoding(vocab_file: str):
    """(tokenizer, length in bytes of each of its ids)."""
    import tiktoken

    with open(vocab_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


class _Units(NamedTuple):
    """The units of a batch: where they begin, rows' offsets, each one's number
    among the distinct ones, and of those the ids in one array."""

    begin: np.ndarray
    rows: np.ndarray
    inverse: np.ndarray
    ids: np.ndarray
    offset: np.ndarray
    length: np.ndarray


class UnitEncoder:
    """Byte-pair ids of whole texts, each distinct unit encoded once.

    A unit is a white-space run with the word after it. The pattern never joins
    a word to the white space after it, so units are encoded apart with the same
    ids as the text as a whole; new ones all at once, one after another. Units
    are told apart by 128 bits of hash. What is known lies in flat arrays sorted
    by hash; when they are full, the half that was used least goes.
    """

    def __init__(self, vocab_file: str = VOCAB_FILE, most: int = CACHE_UNITS) -> None:
        self.encoding, self.size = _encoding(vocab_file)
        self.encode, self.most = self.encoding.encode_ordinary, most
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.offset, self.length, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def unit_counts(self, units: list[str]) -> list[int]:
        """The number of ids of each unit, encoded apart."""
        return [len(self.encode(u)) for u in units]

    def counts(self, col: pa.Array) -> np.ndarray:
        """The number of ids of each row."""
        wide = _wide(col)
        u = self._units(_without(col, wide))
        stop = np.concatenate([[0], np.cumsum(u.length[u.inverse])])
        n = np.diff(stop[np.searchsorted(u.begin, u.rows)])
        for i in np.flatnonzero(wide):
            n[i] = len(self.encode(col[int(i)].as_py()))
        return n

    def leaves(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(characters and tokens of each unit, offsets of each row's units).

        A text whose white space may join units is one unit.
        """
        wide = _wide(col)
        plain = _without(col, wide)
        u = self._units(plain)
        raw, _ = text_buffer(plain)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        end = np.append(u.begin[1:], len(raw))[: len(u.begin)]
        out = np.stack([chars[end] - chars[u.begin], u.length[u.inverse]], axis=1)
        whole = {}
        for i in np.flatnonzero(wide).tolist():
            text = col[i].as_py()
            whole[i] = np.array([[len(text), len(self.encode(text))]], np.int64)
        return _with_rows(out, np.searchsorted(u.begin, u.rows), whole)

    def batch(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of each row's ids)."""
        wide = _wide(col)
        u = self._units(_without(col, wide))
        size = u.length[u.inverse]
        stop = np.cumsum(size)
        out = u.ids[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size - u.offset[u.inverse], size)]
        edge = np.concatenate([[0], stop])[np.searchsorted(u.begin, u.rows)]
        return _with_rows(out, edge, {i: np.array(self.encode(col[i].as_py()), np.uint32) for i in np.flatnonzero(wide).tolist()})

    def _units(self, col: pa.Array) -> _Units:
        raw, rows = text_buffer(col)
        if not len(raw):
            none = np.zeros(0, np.int64)
            return _Units(none, rows, none, self.ids, none, none)
        space = _IS_SPACE[raw]
        # a unit starts where white space follows a word, and with each row
        start = np.concatenate([[True], space[1:] & ~space[:-1]])
        start[rows[:-1][rows[:-1] < len(raw)]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(raw))
        one, two = hash_spans_twice(raw, begin, end)
        inverse, key = pd.factorize(one)
        first = np.empty(len(key), np.int64)
        first[inverse[::-1]] = np.arange(len(one) - 1, -1, -1)
        if (two[first][inverse] != two).any():  # a clash of 64 bits: tell apart by both
            _, first, inverse = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
            inverse, key = inverse.ravel(), one[first]
        check = two[first]
        place = np.searchsorted(self.key, key)
        known = np.append(self.key, np.uint64(0))[place] == key
        known &= np.append(self.check, np.uint64(0))[place] == check
        known &= place < len(self.key)
        offset, length = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        offset[known], length[known] = self.offset[place[known]], self.length[place[known]]
        uses = np.bincount(inverse, minlength=len(key))
        self.uses[place[known]] += uses[known]
        fresh = np.flatnonzero(~known)
        made, n = self._encode_all(raw, space, begin[first[fresh]], end[first[fresh]])
        offset[fresh], length[fresh] = len(self.ids) + np.cumsum(n) - n, n
        ids = np.concatenate([self.ids, made])
        self._add(key[fresh], check[fresh], offset[fresh], n, uses[fresh], ids)
        return _Units(begin, rows, inverse, ids, offset, length)

    def _encode_all(self, raw: np.ndarray, space: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans, how many each has)."""
        # only what begins with white space and ends with a word can stand in a row
        joins = space[begin] & ~space[end - 1]
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * 2
        n = np.zeros(len(begin), np.int64)
        a, z = begin[joins], end[joins]
        if len(a):
            stop = np.cumsum(z - a)
            data = raw[np.arange(stop[-1]) - np.repeat(stop - z, z - a)].tobytes().decode("utf-8")
            got = np.array(self.encode(data), np.uint32)
            done = np.cumsum(self.size[got])
            edge = np.searchsorted(done, stop)
            if (done[edge] == stop).all():
                n[joins], parts[0] = np.diff(edge + 1, prepend=0), got
            else:  # an id reaches over two spans: none may stand beside another
                joins[:] = False
        alone = [self.encode(raw[x:y].tobytes().decode("utf-8")) for x, y in zip(begin[~joins].tolist(), end[~joins].tolist(), strict=True)]
        n[~joins] = [len(x) for x in alone]
        flat = np.concatenate([parts[0], np.array([i for x in alone for i in x], np.uint32)])
        # back into the order of the spans
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        at = np.empty(len(begin), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        stop = np.cumsum(n)
        return flat[np.arange(len(flat)) - np.repeat(stop - n - at, n)], n

    def _add(self, key: np.ndarray, check: np.ndarray, offset: np.ndarray, length: np.ndarray, uses: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        order = order[np.append(True, key[order][1:] != key[order][:-1])] if len(order) else order
        place = np.searchsorted(self.key, key[order])
        new = np.append(self.key, np.uint64(0))[place] != key[order]  # of units with one key, the first is kept
        new |= place == len(self.key)
        order, place = order[new], place[new]
        self.key, self.check = np.insert(self.key, place, key[order]), np.insert(self.check, place, check[order])
        self.offset, self.length = np.insert(self.offset, place, offset[order]), np.insert(self.length, place, length[order])
        self.uses, self.ids = np.insert(self.uses, place, uses[order]), ids
        if len(self.key) > self.most:
            stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
            n = self.length[stay]
            stop = np.cumsum(n)
            self.ids = ids[np.arange(stop[-1]) - np.repeat(stop - n - self.offset[stay], n)]
            self.key, self.check, self.offset, self.length, self.uses = self.key[stay], self.check[stay], stop - n, n, self.uses[stay] // 2


def _with_rows(out: np.ndarray, edge: np.ndarray, whole: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values by row, with those of some (so far empty) rows put in."""
    if not whole:
        return out, edge
    pieces = [whole.get(i, out[edge[i] : edge[i + 1]]) for i in range(len(edge) - 1)]
    return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


def _without(col: pa.Array, rows: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(rows), pa.scalar("", col.type), col) if rows.any() else col


def _wide(col: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(col, _WIDE).fill_null(False).to_numpy(zero_copy_only=False)


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of one text's ids (each below 2**32)."""
    control, data, _, _ = pack_rows(ids, np.array([0, len(ids)]))
    return control.tobytes(), data.tobytes()


def pack_rows(ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of many texts, with each text's offsets in both."""
    ids = ids.astype("<u4", copy=False)
    size = 1 + (ids >= 1 << 8).astype(np.int64) + (ids >= 1 << 16) + (ids >= 1 << 24)
    count = np.diff(edge)
    groups = -(-count // 4)
    control_at = np.concatenate([[0], np.cumsum(groups)])
    place = np.arange(len(ids)) - np.repeat(edge[:-1], count)
    codes = np.zeros((int(control_at[-1]), 4), np.uint8)
    codes.ravel()[np.repeat(control_at[:-1] * 4, count) + place] = size - 1
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    stop = np.concatenate([[0], np.cumsum(size)])
    data = np.empty(int(stop[-1]), np.uint8)
    octets = ids.view(np.uint8).reshape(-1, 4)
    for k in range(4):
        has = size > k
        data[stop[:-1][has] + k] = octets[has, k]
    return control, data, control_at, stop[edge]


#: For each control byte, the lengths of its four ids.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids that pack() stored: lengths by table lookup, then one gather."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(size > k, raw[np.minimum(at + k, len(raw) - 1)] << np.uint32(8 * k), np.uint32(0))
    return out


def _binary(raw: np.ndarray, edge: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(edge.astype(np.int64).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, offsets, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _tokenise(vocab_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(vocab_file)
        for b in slices(batches, 1):
            ids, edge = encoder.batch(b.column(1))
            wide = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
            width = wide.dtype.itemsize
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(edge) - 1, width, np.int32)), _binary(wide.view(np.uint8), edge * width)],
                names=["doc_id", "width", "ids"],
            )

    return run


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    width = b.column(1).to_numpy()
    col = b.column(2)
    at = offsets(col)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]] if col.buffers()[2] else np.zeros(0, np.uint8)
    at = at - at[0]
    if len(set(width.tolist())) < 2:
        w = int(width[0]) if len(width) else 2
        return np.frombuffer(raw.tobytes(), f"<u{w}").astype(np.uint32), at // w
    parts = [np.frombuffer(raw[at[i] : at[i + 1]].tobytes(), f"<u{w}").astype(np.uint32) for i, w in enumerate(width)]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in slices(batches, 2):
        c = np.bincount(_ids(b)[0])
        if len(c) > len(total):
            total, c = c.astype(np.int64), total
        total[: len(c)] += c
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


def _write(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            ids, edge = _ids(b)
            control, data, control_at, data_at = pack_rows(rank[ids], edge)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(edge)), _binary(control, control_at), _binary(data, data_at)],
                names=["doc_id", "n_tokens", "control", "data"],
            )

    return run


def token_table(docs: DataFrame, vocab_file: str = VOCAB_FILE) -> DataFrame:
    """(doc_id, width, ids): the tokenizer's own ids, two bytes each where they fit."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, width int, ids binary"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_tokenise(vocab_file), schema)


def token_output(docs: DataFrame, vocab_file: str = VOCAB_FILE) -> tuple[DataFrame, DataFrame]:
    """(encoded documents, ranking).

    encoded: doc_id, n_tokens, control, data for every row of docs, in which a
    null or empty text gives no tokens and empty binaries; repeated rows and
    null doc_ids are kept. ranking: token_id, rank, n (the count over all
    documents), one row for each token that occurs. Further columns of docs are
    ignored. An empty table gives two empty tables.
    """
    tokens = materialise(token_table(docs, vocab_file), "tokens")
    counts = tokens.mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # bounded by the vocabulary, whatever the input
    rows = sorted(((r["n"], r["id"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))
    rank = np.zeros(max((i for _, i in rows), default=0) + 1, np.uint32)
    for k, (_, i) in enumerate(rows):
        rank[i] = k
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, control binary, data binary"
    ranking = docs.sparkSession.createDataFrame([(i, k, n) for k, (n, i) in enumerate(rows)], "token_id long, rank long, n long")
    return tokens.mapInArrow(_write(rank), schema), ranking


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents (kind 'document') and the ranking that turns their
    ids back into tokens (kind 'token'), in one table; the columns of the other
    kind are null."""
    encoded, ranking = token_output(table(spark, sf_dir, "documents"))
    rows = encoded.withColumn("kind", F.lit("document"))
    return rows.unionByName(ranking.withColumn("kind", F.lit("token")), allowMissingColumns=True)


QUERIES = {"op4_token_output": op4_token_output}
ORACLES: dict[str, str] = {}
