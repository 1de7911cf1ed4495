"""Operator 6: quality rules judged together by an isolation forest.

Each document gets a vector of rule statistics (shares, so that long and short
documents compare). A forest of trees that split at random isolates unusual
vectors early: the mean path length gives the anomaly score. Every labelled row
counts: each tree is grown, as isolation forests are, on a few rows drawn from
all of them; the sizes of its leaves are counts of all of them; and the score
beyond which a document is rejected is set from the labels of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Words, discard, marked, materialise, may_hold, mix, slices, table, written

TREES, SUBSAMPLE = 200, 256
#: Share of the labelled good rows that the threshold may reject.
MAX_LOSS = 0.001

STATISTICS = ["symbols", "marked_words", "upper", "bars", "repeats", "runs", "control", "long_words"]
#: Texts shorter than this many words, or bytes, count as if padded with plain ones.
LEAST_WORDS, LEAST_BYTES = 20, 200
#: Of each tree's subsample so much is of rows labelled bad: anomalies are few.
ANOMALY_SHARE = 0.02

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*^{|}~!"]] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[[*range(9), *range(14, 32), 127]] = True


def statistics(col: pa.Array) -> np.ndarray:
    """One row a text, one column for each of STATISTICS; all 0 for no words."""
    w = Words(col)
    n = np.maximum(w.count, LEAST_WORDS).astype(float)

    def share(flag: np.ndarray) -> np.ndarray:  # of bytes, by row
        total = np.concatenate([[0], np.cumsum(flag[w.raw])])
        return total[w.rows[1:]] - total[w.rows[:-1]]

    size = np.maximum(np.diff(w.rows), LEAST_BYTES).astype(float)
    letters = np.maximum(share(_UPPER) + share(_LOWER), LEAST_BYTES)
    symbol_bytes = np.concatenate([[0], np.cumsum(_SYMBOL[w.raw])])
    in_word = symbol_bytes[w.end] - symbol_bytes[w.begin]

    bar = (w.end - w.begin == 1) & (w.raw[w.begin] == ord("|")) if len(w.begin) else np.zeros(0, bool)

    def by_row(value: np.ndarray) -> np.ndarray:
        return np.bincount(w.row, weights=value, minlength=len(w.count))

    order = np.lexsort((w.hash, w.row))
    row, name = w.row[order], w.hash[order]
    again = np.concatenate([[False], (row[1:] == row[:-1]) & (name[1:] == name[:-1])]) if len(row) else np.zeros(0, bool)
    same = np.concatenate([[False], (w.row[1:] == w.row[:-1]) & (w.hash[1:] == w.hash[:-1])]) if len(row) else np.zeros(0, bool)
    # long words that come again: function words do so in any text
    wide = (w.end - w.begin >= 8)[order]
    shares = np.stack(
        [
            share(_SYMBOL) / size,
            by_row(in_word >= 2) / n,
            share(_UPPER) / letters,
            by_row(bar) / n,
            np.bincount(row, weights=again & wide, minlength=len(w.count)) / np.maximum(np.bincount(row, weights=wide, minlength=len(w.count)), 8),
            by_row(same) / n,
            share(_CONTROL) / size,
            by_row(w.end - w.begin > 60) / n,
        ],
        axis=1,
    )
    return np.sqrt(shares)  # so that splits are not all among the largest


class IsolationForest:
    """Trees of random splits in flat arrays, all of the same depth limit."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        plain, odd = sizes(len(good), len(bad), subsample)
        self._plant(
            [np.concatenate([good[rng.choice(len(good), plain, replace=False)], bad[rng.choice(len(bad), odd, replace=False)]]) for _ in range(trees)],
            rng,
        )

    @classmethod
    def of(cls, samples: list[np.ndarray], seed: int = 11) -> IsolationForest:
        """A tree of each sample; all are of one size."""
        forest = cls.__new__(cls)
        forest._plant(samples, np.random.default_rng(seed))
        return forest

    def _plant(self, samples: list[np.ndarray], rng: np.random.Generator) -> None:
        self.sample = len(samples[0])
        limit = int(np.ceil(np.log2(max(self.sample, 2)))) + 2
        self.trees = [self._grow(x, limit, rng) for x in samples]

    @staticmethod
    def _grow(x: np.ndarray, limit: int, rng: np.random.Generator):
        feature, cut, child, depth = [], [], [], []

        def node(rows: np.ndarray, at: int) -> int:
            k = len(feature)
            feature.append(-1)
            cut.append(0.0)
            child.append((k, k))
            depth.append(at + _expected(len(rows)))
            low, high = rows.min(axis=0), rows.max(axis=0)
            free = np.flatnonzero(high > low)
            if at < limit and len(rows) > 1 and len(free):
                f = int(rng.choice(free))
                c = rng.uniform(low[f], high[f])
                left = rows[:, f] <= c
                if left.all() or not left.any():
                    return k
                feature[k], cut[k] = f, c
                child[k] = (node(rows[left], at + 1), node(rows[~left], at + 1))
            return k

        node(x, 0)
        return np.array(feature), np.array(cut), np.array(child), np.array(depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, 0.5 and less for the rest."""
        total = np.zeros(len(x))
        for (_, _, _, depth), leaf in zip(self.trees, self.leaves(x), strict=True):
            total += depth[leaf]
        return np.round(2.0 ** (-total / len(self.trees) / max(_expected(self.sample), 1e-9)), 6)

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each tree the node that each row ends in."""
        every = np.arange(len(x))
        for feature, cut, child, _ in self.trees:
            at = np.zeros(len(x), np.int64)
            moving = every
            while len(moving):
                f = feature[at[moving]]
                moving = moving[f >= 0]
                f = f[f >= 0]
                here = at[moving]
                at[moving] = child[here, (x[moving, f] > cut[here]).astype(np.int64)]
            yield at

    def resize(self, size: np.ndarray) -> None:
        """Lengthen the paths by other leaf sizes than the samples', which may
        be fractions; `size` has those of all nodes, tree by tree."""
        first = 0
        for k, (feature, cut, child, _) in enumerate(self.trees):
            level = np.zeros(len(feature))
            for at in np.flatnonzero(feature >= 0):  # parents come first
                level[child[at]] = level[at] + 1
            self.trees[k] = feature, cut, child, level + _expected(size[first : first + len(feature)])
            first += len(feature)


def sizes(good: int, bad: int, subsample: int = SUBSAMPLE) -> tuple[int, int]:
    """How many good and bad rows each tree gets, of so many."""
    odd = min(bad, max(1, round(ANOMALY_SHARE * subsample)))
    return min(good, subsample - odd), odd


def _expected(n: int | float | np.ndarray) -> np.ndarray:
    """The mean path length of an unsuccessful search among n."""
    m = np.maximum(n, 2.0)
    return np.where(np.less(n, 2), 0.0, 2.0 * (np.log(m - 1) + 0.5772156649) - 2.0 * (m - 1) / m)


def calibrate(score: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS, count: np.ndarray | None = None) -> float:
    """The threshold with the most bad rows above it that costs at most
    max_loss of the good rows; between two scores, nearer the upper one.

    With `count`, each score stands for so many rows, of which `good` are good.
    """
    count = np.ones(len(score), np.int64) if count is None else count
    good = good.astype(np.int64)
    if (good == count).all() or not good.any():
        return 1.0
    order = np.argsort(-score, kind="stable")
    lost = np.cumsum(good[order])
    allowed = int(max_loss * lost[-1])
    least = score[order][np.searchsorted(lost, allowed, side="right")]  # reject above this score only
    above = score[score > least]
    return float(least + (above.min() - least) * 0.5) if len(above) else 1.0


class Model:
    def __init__(self, forest: IsolationForest | None, threshold: float) -> None:
        self.forest, self.threshold = forest, threshold

    def score(self, col: pa.Array) -> np.ndarray:
        return np.zeros(len(col)) if self.forest is None else self.forest.score(statistics(col))


def fit(docs: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> Model:
    """Fit on all labelled documents.

    Rows of labels with nulls are left out, repeated doc_ids count as good if
    any says so. Without both kinds of label nothing is rejected.
    """
    mark = written()
    rows = materialise(labelled_statistics(docs, labels), "labelled")
    count = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(count) < 2:
        model = Model(None, 1.0)
    else:
        forest = IsolationForest.of(draw(rows, count))
        forest.resize(leaf_sizes(rows, forest, count))
        model = Model(forest, threshold(rows, forest, max_loss))
    discard(docs.sparkSession, mark, written())
    return model


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics `x` of every labelled document, whether it is `good`, and
    a hash of both doc_id and statistics, `key`.

    Statistics are taken of what passes a sieve of the labels, so that texts are
    not shuffled for the join.
    """
    kind = docs.schema["doc_id"].dataType
    wanted = (
        labels.select(F.col("doc_id").cast(kind).alias("doc_id"), "quality")
        .filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("boolean").alias("good"))
    )
    shared = docs.sparkSession.sparkContext.broadcast(may_hold(wanted.select(F.xxhash64("doc_id").alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            b = b.filter(pa.array(marked(shared.value, b.column(0).to_numpy())))
            if b.num_rows:
                x = statistics(b.column(2))
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "x"])

    found = docs.select(F.xxhash64("doc_id").alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    found = found.mapInArrow(run, f"doc_id {kind.simpleString()}, x array<double>")
    return found.join(wanted, "doc_id").select(F.xxhash64("doc_id", "x").alias("key"), "x", "good")


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), len(STATISTICS))


def draw(rows: DataFrame, count: dict[bool, int], trees: int = TREES, subsample: int = SUBSAMPLE) -> list[np.ndarray]:
    """For each tree, good and bad rows drawn from all, without replacement.

    A row's lot for a tree is a hash of its key and the tree; the least lots
    win. Lots that are too high to win are dropped where they are made; should
    that leave too few (many rows may be equal), it is done again with more, and
    with all of them at last.
    """
    plain, odd = sizes(count[True], count[False], subsample)
    seed = mix(np.arange(1, trees + 1, dtype=np.uint64))
    win = Window.partitionBy("tree", "good").orderBy("lot", "x")
    widen = 1
    while True:
        share = [min(1.0, widen * (k + 8 * k**0.5 + 16) / n) for k, n in ((odd, count[False]), (plain, count[True]))]
        bound = np.array([int(s * 2**63) for s in share], np.uint64)

        def run(batches: Iterator[pa.RecordBatch], bound: np.ndarray = bound) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = b.column(0).to_numpy().view(np.uint64)
                most = bound[b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)]
                tree, low, row = [], [], []
                for t in range(trees):
                    lot = mix(key ^ seed[t]) >> np.uint64(1)
                    some = np.flatnonzero(lot < most)
                    tree.append(np.full(len(some), t, np.int32))
                    low.append(lot[some].astype(np.int64))
                    row.append(some)
                won = b.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tree)), pa.array(np.concatenate(low)), won.column(1), won.column(2)], names=["tree", "lot", "x", "good"]
                )

        lots = rows.select("key", "x", "good").mapInArrow(run, "tree int, lot long, x array<double>, good boolean")
        placed = lots.withColumn("place", F.row_number().over(win)).filter(F.col("place") <= F.when(F.col("good"), plain).otherwise(odd))
        got = placed.select("tree", "x").toArrow().combine_chunks().sort_by("tree")
        if got.num_rows == trees * (plain + odd):
            return list(_matrix(got.column("x").combine_chunks()).reshape(trees, plain + odd, -1))
        widen *= 8


def leaf_sizes(rows: DataFrame, forest: IsolationForest, count: dict[bool, int]) -> np.ndarray:
    """How many rows of a sample each node would hold as a leaf, if the sample
    were like all rows, good and bad: their counts, scaled to its size."""
    first = np.cumsum([0, *(len(t[0]) for t in forest.trees)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, first[-1]), np.int64)
        for b in batches:
            good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for k, leaf in enumerate(forest.leaves(_matrix(b.column(0)))):
                for row, kind in zip(total, (leaf[~good], leaf[good]), strict=True):
                    row[first[k] : first[k + 1]] += np.bincount(kind, minlength=first[k + 1] - first[k])
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(row[some]) for row in total)], names=["node", "bad", "good"])

    got = rows.select("x", "good").mapInArrow(run, "node long, bad long, good long").groupBy("node").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    plain, odd = sizes(count[True], count[False], SUBSAMPLE)
    size = np.zeros(first[-1])
    size[got.column("node").to_numpy()] = got.column("good").to_numpy() * (plain / count[True]) + got.column("bad").to_numpy() * (odd / count[False])
    return size


def threshold(rows: DataFrame, forest: IsolationForest, max_loss: float) -> float:
    """calibrate() over all rows, by the counts of each score; scores have six
    decimals, so there are at most a million whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_matrix(b.column(0)))), b.column(1)], names=["score", "good"])

    got = rows.select("x", "good").mapInArrow(run, "score double, good boolean").groupBy("score").agg(F.count_if("good").alias("good"), F.count("*").alias("count")).toArrow()
    score, good, count = (got.column(name).to_numpy() for name in ("score", "good", "count"))
    return calibrate(score, good, max_loss, count)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with `score`, the anomaly score of the text.

    A null or empty text has the statistics of no words, all 0. A column of docs
    named `score` is replaced.
    """
    names = [c for c in docs.columns if c.lower() != "score"]
    at = [c.lower() for c in names].index("text")
    shape = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(at)))], names=[*names, "score"])

    return docs.select(*names).mapInArrow(run, shape.add("score", "double"))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at most the threshold, with their columns.

    Null and empty texts are rejected, since they hold nothing to train on.
    Repeated rows are judged alike; an empty table gives an empty one.
    """
    model = fit(docs, labels)
    names = [f"c{k}" if c.lower() != "text" else "text" for k, c in enumerate(docs.columns)]
    kept = keep(score_documents(docs.toDF(*names), model), model)
    return kept.drop("score").toDF(*docs.columns)


def keep(scored: DataFrame, model: Model) -> DataFrame:
    return scored.filter((F.col("score") <= model.threshold) & (F.length(F.trim("text")) > 0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rules keep: doc_id, score, threshold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return keep(score_documents(docs, model), model).select("doc_id", "score", F.lit(model.threshold).alias("threshold"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
