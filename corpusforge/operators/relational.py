"""Relational operators that the pipelines share."""

from __future__ import annotations

import tempfile
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cut_item, item_cap, path_has_no_loop, strip_controls

#: Bytes that a side may have to be sent to all tasks.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. A local one stands in only
    where all runs on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusforge-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder once and read again, which survives the
    loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """About how many bytes the rows take: texts by their octets, the rest 16 each."""
    parts = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes]
    return df.agg(F.sum(sum(parts[1:], parts[0]).cast("long"))).first()[0] or 0


def replicated_join(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """A join that sends `small` to all tasks if its rows take at most `most`
    bytes, and else is left to the optimizer (a shuffled join).

    `small` is computed once: measured and joined as it was written."""
    small = cut_lineage(small)
    return big.join(F.broadcast(small) if size_of(small) <= most else small, on, how)


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of both sides sorted by the key, whatever their size."""
    return left.hint("merge").join(right, on, how)


def cogroup_counts(key: str, **inputs: tuple[DataFrame, Column | str, Column | str]) -> DataFrame:
    """For each key, how many values that are not null each input has.

    inputs: name=(relation, its key, its value). Each is counted by itself
    before they meet, so that no rows are multiplied. Null keys are dropped.
    """
    parts = []
    for name, (df, by, value) in inputs.items():
        k, v = (F.col(c) if isinstance(c, str) else c for c in (by, value))
        counted = df.groupBy(k.alias(key)).agg(F.count(v).alias("n"))
        parts.append(counted.select(key, *[(F.col("n") if other == name else F.lit(0)).cast("long").alias(other) for other in inputs]))
    return union_all(*parts).filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(name).alias(name) for name in inputs])


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def split_if(df: DataFrame, **conditions: Column | str) -> dict[str, DataFrame]:
    """Parts of one relation by conditions; a row may be in several or none."""
    return {name: df.filter(c) for name, c in conditions.items()}


def without(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose column is none of the values; nulls go too."""
    return df.filter(~F.col(column).isin(values))


def follow_redirects(df: DataFrame, column: str, redirects: DataFrame) -> DataFrame:
    """The column with the targets of the redirects (source, target) in place
    of their sources, one hop; a source of several targets gives several rows."""
    r = redirects.select(F.col("source").alias("_source"), F.col("target").alias("_target"))
    joined = df.join(r, F.col(column) == F.col("_source"), "left")
    return joined.withColumn(column, F.coalesce("_target", column)).drop("_source", "_target")


def concat_grouped(df: DataFrame, keys: list[str], value: str, order: list[str], name: str, sep: str = " ") -> DataFrame:
    """concat_texts() of each group's values, in the given order."""
    # each distinct item is kept where it comes first, so that no task has all
    # rows of a group
    first = df.groupBy(*keys, strip_controls(value).alias("_v")).agg(F.min(F.struct(*order, F.col(value).alias("_raw"))).alias("_first"))
    some = F.when(F.col("_v").isNotNull() & (F.col("_v") != ""), F.struct("_first", "_v"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(some)), lambda r: r["_v"]), sep).alias(name))


def aggregate_grouped(df: DataFrame, keys: list[str], text: str, order: list[str], name: str, count: str, size_limit: int = 100_000) -> DataFrame:
    """aggregate_texts() of each group's texts in the given order, and their count.

    Only the texts that the limit lets in are collected. Groups are counted
    first and texts cut to their cap. Running sums then decide, first over what
    a group has in one task, then in 256 tasks, then over the rest: a large
    group is never sorted whole by one task. Null texts are left out. A text's
    cap counts all texts of its group.
    """
    rows = df.filter(F.col(text).isNotNull())
    n = rows.groupBy(*keys).agg(F.count("*").alias(count)).select(*[F.col(k).alias(f"_{k}") for k in keys], count)
    # few groups are sent to the tasks: texts are cut before any are shuffled
    rows = replicated_join(rows, n, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    cut = cut_item(F.col(text), item_cap(F.col(count), size_limit))
    rows = rows.select(*keys, *[c for c in order if c not in keys and c != text], count, cut.alias("_cut"), F.spark_partition_id().alias("_part"))
    # texts alike up to the cut are alike here
    by = [c for c in order if c != text] + ["_cut"]
    for part in (["_part"], [F.floor(F.col("_part") / 256)], []):
        before = Window.partitionBy(*keys, *part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_before", F.coalesce(F.sum(F.length("_cut") + 1).over(before), F.lit(0))).filter(F.col("_before") < size_limit)
    kept = F.array_sort(F.collect_list(F.struct(F.col("_before"), F.col("_cut"))))
    return rows.groupBy(*keys).agg(F.max(count).alias(count), F.array_join(F.transform(kept, lambda r: r["_cut"]), " ").alias(name))


def expand_paths(edges: DataFrame, roots: Column, levels: int, grounded: str) -> DataFrame:
    """All downward paths of 1 to `levels` edges from the roots, without loops.

    edges: node, parent and further columns of the node. `roots` tells which
    edges begin a path. A path is an array; `groundedPath` has those of its
    nodes whose column `grounded` is not null. Edges and each level but the
    last are written once, for the levels after it and the union need them again.
    """
    edges = cut_lineage(edges)
    # leaves, which most nodes are, take no part in the next join
    parents = edges.select(F.col("parent").alias("_inner")).distinct()
    edges = cut_lineage(edges.join(parents, F.col("node") == F.col("_inner"), "left").withColumn("_inner", F.col("_inner").isNotNull()))
    more = [c for c in edges.columns if c not in ("node", "parent")]
    here = F.when(F.col(grounded).isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("node"))
    level = edges.filter(roots).select("node", *more, F.array("node").alias("fullPath"), here.alias("groundedPath"))
    level = cut_lineage(level.withColumn("startsBare", F.col(grounded).isNull()))
    found = [level]
    down = edges.select(F.col("parent").alias("_up"), F.col("node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in more])
    for n in range(2, levels + 1):
        joined = level.filter("_inner").join(down, F.col("node") == F.col("_up"))
        longer = joined.select(
            F.col("_node").alias("node"),
            *[F.col(f"_{c}").alias(c) for c in more],
            F.concat("fullPath", F.array("_node")).alias("fullPath"),
            F.when(F.col(f"_{grounded}").isNull(), F.col("groundedPath")).otherwise(F.concat("groundedPath", F.array("_node"))).alias("groundedPath"),
            F.col("startsBare"),
        )
        level = longer.filter(path_has_no_loop("fullPath"))
        level = cut_lineage(level) if n < levels else level
        found.append(level)
    return union_all(*found).drop("_inner")
