"""An extension: the same parsing over files as they arrive.

The batch expressions work on streams unchanged; counts by topic are kept as
state by Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ntriples import parse_uri_literal, parse_uri_uri


def stream_lines(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder)


def stream_uri_uri(spark: SparkSession, folder: str, *args, **kwargs) -> DataFrame:
    return parse_uri_uri(stream_lines(spark, folder), *args, **kwargs)


def stream_uri_literal(spark: SparkSession, folder: str, *args, **kwargs) -> DataFrame:
    return parse_uri_literal(stream_lines(spark, folder), *args, **kwargs)


def running_counts(pairs: DataFrame) -> DataFrame:
    """(object, n): how many subjects each object has had so far."""
    return pairs.groupBy("object").agg(F.count("subject").alias("n"))
