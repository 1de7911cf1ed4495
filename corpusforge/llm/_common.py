"""What the operators of this subpackage share: shared tables and word hashing.

A *word* is a maximal run of bytes other than the six ASCII white-space
characters, so that Spark, numpy and DuckDB cut a text alike.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same class as a regular expression, for Spark (Java) and DuckDB (RE2).
SPACE_RE = r"[ \t\n\r\f\x0B]+"

_made: list[tuple[SparkSession, str]] = []
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir or the context
    names it. A local one stands in only where all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusforge-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    Cuts the lineage: what was computed survives the loss of executors. The
    table goes when the driver's interpreter ends, or by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    _made.append((spark, path))
    _paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for discard(): how many tables have been written so far."""
    return len(_paths)


def discard(spark: SparkSession, first: int, last: int) -> None:
    """Delete the tables from mark `first` to mark `last`, which nothing reads
    any more. Shuffle files go when the driver's JVM collects what refers to
    them; it is asked to, since rounds of a long job fill the disks else."""
    for path in _paths[first:last]:
        _delete(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def release() -> None:
    """Delete every table that materialise() wrote."""
    while _made:
        spark, path = _made.pop()
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001 - the JVM may be gone at exit
                return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about `limit` bytes in column `at`.

    Bounds what the arrays over a piece take, whatever the batch size; a row
    beyond the limit is a piece of its own.
    """
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        col = b.column(at)
        size = offsets(col)
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, size[start] + limit, side="right")) - 1)
            yield b.slice(start, stop - start)
            start = stop


def may_hold(keys: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """A bit map of hashed keys of fixed size (8 MB), for sieves before a join.

    Of 2**bits hash values, those that some key has are marked. More keys let
    more rows pass the sieve, and never fewer; the join decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << bits, bool)
        for b in batches:
            mark[slot(b.column(0).to_numpy(), bits)] = True
        words = np.packbits(mark, bitorder="little").view(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], names=["word", "bits"])

    found = keys.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return words.view(np.uint8)


def slot(key: np.ndarray, bits: int = 26) -> np.ndarray:
    return (mix(key.astype(np.int64).view(np.uint64) * _M1) >> np.uint64(64 - bits)).astype(np.int64)


def marked(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    k = slot(key)
    return (bitmap[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)


def sieve(df: DataFrame, column: str, bitmap: np.ndarray, marked_ones: bool = True) -> DataFrame:
    """The rows of df whose key may be marked in the bit map, or all others."""
    at = df.columns.index(column)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(shared.value, b.column(at).to_numpy()) == marked_ones))

    return df.mapInArrow(run, df.schema)


# --- words of an Arrow column -------------------------------------------------

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], dtype=np.uint64)
#: Longer words are hashed one at a time.
_LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


def offsets(col: pa.Array) -> np.ndarray:
    """Where the values of a string or binary column begin in its buffer, and the end."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if col.buffers()[1] is None:
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], kind, count=len(col) + 1 + col.offset)[col.offset :].astype(np.int64)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (null: empty)."""
    if col.null_count:
        col = col.fill_null("")
    at, data = offsets(col), col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hash_spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of raw[begin:end], eight bytes at a time over all spans."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded, shape=(max(len(raw), 1), 8), strides=(1, 1))
    size = end - begin
    h = mix((size.astype(np.uint64) + np.uint64(seed + 1)) * _M1)
    todo = np.flatnonzero((size > 0) & (size <= _LONG))
    at = 0
    while len(todo):
        part = np.ascontiguousarray(blocks[begin[todo] + at]).view(np.uint64).ravel()
        left = size[todo] - at
        h[todo] = mix((h[todo] ^ (part & _MASKS[np.minimum(left, 8)])) * _M1)
        todo = todo[left > 8]
        at += 8
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : end[i]].tobytes(), seed=seed)
    return h


def hash_spans_twice(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hash_spans() beside a second, independent hash of each span."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded, shape=(max(len(raw), 1), 8), strides=(1, 1))
    size = end - begin
    one = mix((size.astype(np.uint64) + np.uint64(2)) * _M1)
    two = (size.astype(np.uint64) + np.uint64(3)) * _M3
    todo = np.flatnonzero((size > 0) & (size <= _LONG))
    at = 0
    while len(todo):
        part = np.ascontiguousarray(blocks[begin[todo] + at]).view(np.uint64).ravel()
        left = size[todo] - at
        part &= _MASKS[np.minimum(left, 8)]
        one[todo] = mix((one[todo] ^ part) * _M1)
        t = (two[todo] + part) * _M2
        two[todo] = t ^ (t >> np.uint64(29))
        todo = todo[left > 8]
        at += 8
    for i in np.flatnonzero(size > _LONG):
        span = raw[begin[i] : end[i]].tobytes()
        one[i], two[i] = xxhash.xxh3_64_intdigest(span, seed=1), xxhash.xxh3_64_intdigest(span, seed=2)
    return one, two


class Words:
    """The words of a batch of texts: byte spans, hashes, and each row's first word."""

    def __init__(self, col: pa.Array, seed: int = 0) -> None:
        self.raw, self.rows = text_buffer(col)
        inside = np.concatenate([[False], ~_IS_SPACE[self.raw], [False]])
        start = inside[1:] & ~inside[:-1]
        edges = self.rows[1:-1]
        edges = edges[edges < len(self.raw)]
        cut = edges[inside[1:-1][edges]] if len(self.raw) else edges
        start[cut] = True
        self.begin = np.flatnonzero(start[:-1])
        stop = inside[:-1] & ~inside[1:]
        stop[cut[inside[:-1][cut]]] = True  # a row that ends within a run
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.begin, self.rows)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = hash_spans(self.raw, self.begin, self.end, seed)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two adjoining pieces from the names of each (order counts)."""
    return mix((a ^ (a >> np.uint64(29))) * _M3 + b * _M1)


def window_names(h: np.ndarray, size: int) -> np.ndarray:
    """Names of all runs of `size` items of h, by doubling: log2(size) steps."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    name, have, power, span = None, 0, h, 1
    left = size
    while left:
        if left & 1:
            n = len(h) - have - span + 1
            name = power[:n] if name is None else joined(name[:n], power[have : have + n])
            have += span
        left >>= 1
        if left:
            n = len(power) - span
            power, span = joined(power[:n], power[span : span + n]), span * 2
    return name
