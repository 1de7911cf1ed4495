"""Links and redirects of a dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.nlp import sentences_with_links
from ..functions.text import redirect_target
from ..sources.wikidump import read_wiki_parsed, read_wiki_raw


def links(parsed: DataFrame) -> DataFrame:
    """uri, sentenceOrder, sentence, linkTarget, linkBegin, linkEnd."""
    return sentences_with_links(parsed.select("uri", "text", "links", "paragraphs"))


def redirects(raw: DataFrame, lang: str = "en") -> DataFrame:
    """(uri, redirect) of redirect pages; no text is parsed for it."""
    return raw.select("uri", redirect_target("markup", lang).alias("redirect")).filter("redirect is not null")


def extract_links(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    return links(read_wiki_parsed(spark, path, lang))


def extract_redirects(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    return redirects(read_wiki_raw(spark, path, lang), lang)
