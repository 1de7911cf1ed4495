"""Tab-separated text without quoting: null and '' are one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas

#: Where the standard vocabularies are.
W3 = "http://www.w3.org/"
#: Types of the linked-data ontology and their names in annotated text.
ONTOLOGY = "http://dbpedia.org/ontology/"
DEFAULT_TYPES = {
    "Person": "person",
    "Place": "location",
    "Organisation": "organization",
    "Album": "album",
    "Film": "movie",
    "Book": "book",
    "Software": "software",
    "Drug": "drug",
}


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Fields by tabs, quotes kept as they are, empty fields null."""
    return spark.read.csv(path, sep="\t", quote="", escape="", schema=schema)


def to_lines(df: DataFrame) -> DataFrame:
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat_ws("\t", *fields).alias("value"))


def write_tsv(df: DataFrame, path: str, compression: str = "none") -> None:
    to_lines(df).write.option("compression", compression).text(path)


def write_all(df: DataFrame, **writers) -> None:
    """Several sinks of one relation, computed once: name=function(df)."""
    kept = df.persist()
    try:
        for write in writers.values():
            write(kept)
    finally:
        kept.unpersist()


def type_names(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(typeuri, typename) from a file, or the default eight."""
    if path:
        return read_tsv(spark, path, schemas.TYPE_NAMES)
    return spark.createDataFrame([(ONTOLOGY + k, v) for k, v in DEFAULT_TYPES.items()], schemas.TYPE_NAMES)
