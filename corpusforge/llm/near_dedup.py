"""Operator 2: near-duplicate groups by MinHash with sequential Bayesian tests.

Texts are sets of word shingles. Signatures are cut into bands; texts alike in
a band are candidates. A candidate pair's signatures are compared batch by
batch: once the posterior chance that the similarity reaches the threshold falls
under the allowed miss probability, the pair is dropped. Survivors' sets are
compared exactly. Groups are the connected components of the pairs that pass.

Not all pairs of a large group need be compared for its component: first each
text is compared with one candidate (the least text of the buckets it shares
most often); then, in buckets whose texts are not yet one component, all pairs
across components are. That leaves out only pairs known to be connected. The
signatures of such a bucket are sent in blocks and compared block by block, so
that only pairs that pass the test ever become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._anchors import one_of_each, shared_keys, with_tid, word_counts
from ._common import Words, joined, materialise, may_hold, mix, sieve, slices, table, window_names

SHINGLE_WORDS = 3
BANDS, ROWS = 50, 4
HASHES = BANDS * ROWS
#: Jaccard similarity of near duplicates.
THRESHOLD = 0.5
#: Chance that the Bayesian test drops a pair at the threshold.
MISS = 0.005
#: Hashes compared before each test.
BATCHES = (24, 48, 96, 144, 200)
#: Signatures of a bucket that are compared with so many others at a time.
BLOCK = 512

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(col: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of all shingles, in row order; a shorter text is one shingle."""
    w = Words(col)
    name = window_names(w.hash, size)
    start = np.arange(len(name))
    ok = w.row[start] == w.row[start + size - 1] if len(name) else np.zeros(0, bool)
    row, name = w.row[start[ok]], name[ok]
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        own = w.hash[w.first[short]]
        for k in range(1, size - 1):
            more = w.count[short] > k
            own[more] = joined(own[more], w.hash[w.first[short[more]] + k])
        row, name = np.concatenate([row, short]), np.concatenate([name, own])
        order = np.argsort(row, kind="stable")
        row, name = row[order], name[order]
    return row, name


def signatures(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their MinHash values, one row of HASHES each)."""
    row, name = shingles(col)
    h = (name >> np.uint64(32)).astype(np.uint32)
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    out = np.empty((len(start), HASHES), np.uint32)
    if len(start):
        work = np.empty_like(h)
        for k in range(HASHES):
            np.multiply(h, _A[k], out=work)
            work += _B[k]
            out[:, k] = np.minimum.reduceat(work, start)
    return row[start], out


def band_keys(sig: np.ndarray) -> np.ndarray:
    bands = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bands.shape[:2]).copy()
    for k in range(ROWS):
        key = joined(key, bands[:, :, k])
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 0):
        row, sig = signatures(b.column(0))
        keys = band_keys(sig)
        offsets = pa.array(np.arange(len(row) + 1, dtype=np.int32) * BANDS)
        listed = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
        short = (sig & np.uint32(0xFFFF)).astype("<u2")
        raw = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.arange(len(row) + 1, dtype=np.int32) * (2 * HASHES)).tobytes()), pa.py_buffer(short.tobytes())])
        yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(row)), listed, raw], names=["tid", "bands", "sig"])


def least_matches(threshold: float = THRESHOLD, miss: float = MISS, batches: tuple[int, ...] = BATCHES) -> list[int]:
    """For each number of hashes compared, the fewest matches that go on.

    With m of n alike and all similarities as likely before, the similarity has
    a Beta(m + 1, n - m + 1) posterior; a pair goes on while its chance to reach
    the threshold is at least `miss`.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in batches:
        for m in range(n + 1):
            p = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(p - p.max())
            if p[s >= threshold].sum() >= miss * p.sum():
                break
        out.append(m)
    return out


def _prune(threshold: float, miss: float):
    least = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = (np.frombuffer(c.to_numpy(zero_copy_only=False).sum() if len(c) else b"", "<u2").reshape(len(c), HASHES) for c in (b.column(2), b.column(3)))
            alive, done, matches = np.arange(b.num_rows), 0, np.zeros(b.num_rows, np.int64)
            for n, need in zip(BATCHES, least, strict=True):
                matches[alive] += (a[alive, done:n] == z[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= need], n
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in b.columns[:2]], names=["a", "b"])

    return run


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(iter([whole]), 2, 1 << 20):
                (ra, na), (rb, nb) = shingles(b.column(2)), shingles(b.column(3))
                ea, eb = (np.searchsorted(r, np.arange(b.num_rows + 1)) for r in (ra, rb))
                keep = np.zeros(b.num_rows, bool)
                for i in range(b.num_rows):
                    x, y = np.unique(na[ea[i] : ea[i + 1]]), np.unique(nb[eb[i] : eb[i + 1]])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = both >= threshold * (len(x) + len(y) - both) and both > 0
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:2]], names=["a", "b"])

    return run


def _across(threshold: float, miss: float):
    """Pairs (a > b) of different components that pass the test; rows (key, low,
    high, block, tid, root, sig) come sorted by their first three columns."""
    least = least_matches(threshold, miss)

    def passing(x: np.ndarray, y: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(fits)
        done, matches = 0, np.zeros(len(i), np.int64)
        for n, need in zip(BATCHES, least, strict=True):
            for at in range(0, len(i), 50_000):
                z = slice(at, at + 50_000)
                matches[z] += (x[i[z], done:n] == y[j[z], done:n]).sum(axis=1)
            some = matches >= need
            i, j, matches, done = i[some], j[some], matches[some], n
        return i, j

    def compare(block: np.ndarray, low: int, high: int, tid: np.ndarray, root: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        p, q = np.flatnonzero(block == low), np.flatnonzero(block == high)
        fits = root[p][:, None] != root[q][None, :]
        if low == high:
            fits &= np.arange(len(p))[:, None] < np.arange(len(q))[None, :]
        i, j = passing(sig[p], sig[q], fits)
        x, y = tid[p[i]], tid[q[j]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([*held, b]).combine_chunks()
            key, low, high, block, tid, root = (table.column(k).to_numpy() for k in range(6))
            sig = np.frombuffer(b"".join(table.column(6).to_pylist()), "<u2").reshape(len(key), HASHES)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            for a, z in zip([0, *edge.tolist()], edge.tolist(), strict=False):
                yield compare(block[a:z], low[a], high[a], tid[a:z], root[a:z], sig[a:z])
            held = table.slice(int(edge[-1]) if len(edge) else 0).to_batches()  # at most two blocks
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            sig = np.frombuffer(b"".join(table.column(6).to_pylist()), "<u2").reshape(table.num_rows, HASHES)
            key, low, high, block, tid, root = (table.column(k).to_numpy() for k in range(6))
            yield compare(block, low[0], high[0], tid, root, sig)

    return run


class _Checker:
    """The two tests of pairs (a, b) of texts."""

    def __init__(self, texts: DataFrame, counts: DataFrame, sig: DataFrame, threshold: float, miss: float) -> None:
        self.texts, self.counts, self.sig, self.threshold, self.miss = texts, counts, sig, threshold, miss

    @staticmethod
    def _both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
        one = pairs.join(of.select(F.col("tid").alias("a"), F.col(value).alias("va")), "a")
        return one.join(of.select(F.col("tid").alias("b"), F.col(value).alias("vb")), "b").select("a", "b", "va", "vb")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs that pass the sequential test."""
        return self._both(pairs, self.sig, "sig").mapInArrow(_prune(self.threshold, self.miss), "a long, b long")

    def likely_across(self, buckets: DataFrame, block: int) -> DataFrame:
        """The same for all pairs of different roots in the buckets (key, tid, root)."""
        n = buckets.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        dealt = buckets.join(n, "key").withColumn("block", F.pmod(F.xxhash64("tid", F.lit(1)), "blocks").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        sent = dealt.join(self.sig, "tid").select("key", "block", "tid", "root", "sig", other.alias("other"))
        sent = sent.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "tid", "root", "sig")
        sent = sent.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        return sent.mapInArrow(_across(self.threshold, self.miss), "a long, b long").distinct()

    def near(self, likely: DataFrame) -> DataFrame:
        """Those of the pairs whose texts are alike, by their whole sets."""
        likely = materialise(likely, "likely-pairs")
        needed = likely.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
        own = materialise(one_of_each(self.texts, self.counts, needed), "pair-texts")
        return materialise(self._both(likely, own, "text").mapInArrow(_compare(self.threshold), "a long, b long"), "near-pairs")


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent) with parent < node, by pointer jumping."""
    now = materialise(parents.select("node", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("node").alias("n"), F.col("root").alias("r"))
        on = now.join(up, now.root == up.n, "left").select("node", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved"))
        now = materialise(on, "roots")
        if not now.filter("moved").limit(1).count():
            return now.select("node", "root")
        now = now.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b) that are not a root.

    Each round hangs every node on its least neighbour, finds the roots, and
    goes on with the edges between different roots; rounds are few, since each
    root that has an edge left is joined to another.
    """
    left = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    found = None
    while True:
        left = materialise(left, "edges")
        if not left.limit(1).count():
            return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
        step = roots(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        if found is None:
            found = step
        else:
            s = step.select(F.col("node").alias("n"), F.col("root").alias("r"))
            moved = found.join(s, found.root == s.n, "left").select("node", F.coalesce("r", "root").alias("root"))
            found = materialise(moved.unionByName(step), "components")
        a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        both = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        left = both.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """doc_id, tid, root, n_words: each row of docs with its group's root.

    tid is a hash of the text, root that of the group's least text. Texts equal
    to the letter are of one group. A text without words has a null root and no
    group; null texts too. Other columns are ignored; an empty table gives an
    empty one.
    """
    texts = with_tid(docs)
    counts = materialise(word_counts(texts), "word-counts")
    signed = materialise(texts.select("text", "tid").mapInArrow(_sign, "tid long, bands array<long>, sig binary"), "signatures")
    keys = signed.select("tid", F.explode("bands").alias("key"))
    shared = materialise(shared_keys(keys, ["key"], "low"), "shared-bands")
    rows = sieve(keys, "key", may_hold(shared, "key")).join(shared, "key").select("key", "tid", "low")
    buckets = materialise(rows.distinct(), "buckets")
    some = buckets.select("tid").distinct()
    sig = signed.select("tid", "sig").join(some, "tid", "left_semi").dropDuplicates(["tid"])
    check = _Checker(texts, counts, materialise(sig, "candidate-signatures"), threshold, miss)

    # the candidate that a text shares most buckets with, the least of such
    first = buckets.filter("tid <> low").groupBy("tid", "low").agg(F.count("*").alias("n"))
    pairs = first.groupBy("tid").agg(F.max_by("low", F.struct("n", -F.col("low"))).alias("b")).select(F.col("tid").alias("a"), "b")
    pairs = materialise(pairs, "first-pairs")
    near = check.near(check.likely(pairs))
    rooted = components(near)

    # buckets that hold several components: all pairs across them
    label = rooted.select(F.col("node").alias("tid"), "root")
    labelled = materialise(buckets.join(label, "tid", "left").select("key", "tid", F.coalesce("root", "tid").alias("root")), "labelled-buckets")
    mixed = shared_keys(labelled.select("key", F.col("root").alias("tid")), ["key"])
    across = check.likely_across(labelled.join(mixed, "key", "left_semi"), block)
    unseen = across.join(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    rooted = components(near.unionByName(check.near(unseen)))
    label = rooted.select(F.col("node").alias("tid"), "root")
    has = F.col("n_words") > 0
    return counts.join(label, "tid", "left").select("doc_id", "tid", F.when(has, F.coalesce("root", "tid")).alias("root"), "n_words")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """doc_id, group_id, group_size: the rows of docs with a near or exact copy.

    group_id is the least doc_id of the group, group_size its rows. Repeated
    rows are copies of each other; null and empty texts are in no group, other
    columns are ignored.
    """
    found = materialise(near_groups(docs, threshold, miss).filter("root is not null").select("doc_id", "root"), "rooted")
    sized = found.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return found.join(sized, "root").select("doc_id", "group_id", "group_size")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """docs with one row of each group, that of the least doc_id (nulls last).

    Rows in no group all stay; so do null and empty texts. Columns stay as they are.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    low = [c.lower() for c in docs.columns]
    doc_id, text = names[low.index("doc_id")], names[low.index("text")]
    # rows alike in doc_id and text are copies; a number tells them apart
    plain = docs.toDF(*names)
    found = near_groups(plain.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), threshold, miss)
    found = materialise(found.filter("root is not null").select("doc_id", "tid", "root"), "rooted")
    # the row that stays: the least doc_id, there the least text
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("tid").alias("t"))
    stays = found.groupBy("root").agg(F.min(rank).alias("s"), F.count("*").alias("n")).filter("n > 1").select("root", "s.*")
    # how many of the rows alike in doc_id and text go: all, or all but one
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    many = found.join(stays, "root").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")))
    gone = many.groupBy(key.alias("_d"), F.col("tid").alias("_t")).agg((F.count("*") - F.max(F.col("kept").cast("int"))).alias("_n")).filter("_n > 0")
    gone = materialise(gone, "gone")
    marked = may_hold(gone, "_t")
    keyed = plain.withColumns({"_tid": F.xxhash64(F.col(text).cast("string")), "_key": F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))})
    others = sieve(keyed, "_tid", marked, False).select(*names)  # not in the join
    left = sieve(keyed, "_tid", marked).join(gone, (F.col("_key") == F.col("_d")) & (F.col("_tid") == F.col("_t")), "left")
    alike = Window.partitionBy("_key", "_tid").orderBy("_tid")
    some = left.withColumn("_nth", F.row_number().over(alike)).filter("_n is null or _nth > _n").select(*names)
    return others.unionByName(some).toDF(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES: dict[str, str] = {}
