"""Wiki XML dumps, plain or bzip2, as pages.

Files are cut at the end of pages by the text source, which reads many splits
of one file at once; a page is never paired with another one's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import parsed
from ..functions.text import let, redirect_target, title_to_uri, unescape_xml


def _inside(page: Column, tag: str) -> Column:
    """What stands in the first element of the name; null where it has no end tag.

    The pattern is for the start tag alone; what follows is cut by position.
    """
    start = F.regexp_instr(page, F.lit(rf"<{tag}(?:\s[^>]*[^>/])?>"))

    def content(at: Column) -> Column:
        rest = F.substr(page, at)
        body = let(F.substring_index(rest, f"</{tag}>", 1), lambda v: F.substr(v, F.position(F.lit(">"), v) + 1))
        return F.when((at > 0) & F.contains(rest, F.lit(f"</{tag}>")), body)

    return let(start, content)


def read_wiki_raw(spark: SparkSession, path: str, lang: str | None = "en") -> DataFrame:
    """(title, uri, markup) of all pages, redirects and all namespaces too.

    A page with an empty or self-closed text has an empty markup.
    """
    return parse_pages(spark.read.text(path, lineSep="</page>"), lang)


def parse_pages(blocks: DataFrame, lang: str | None = "en") -> DataFrame:
    """read_wiki_raw() of blocks (column `value`) that end with their pages."""
    lang = lang or "en"
    blocks = blocks.filter(F.contains("value", F.lit("<page>")))
    page = F.substring_index(F.col("value"), "<page>", -1)
    cut = blocks.select(unescape_xml(_inside(page, "title")).alias("title"), F.coalesce(unescape_xml(_inside(page, "text")), F.lit("")).alias("markup"))
    return cut.filter("title is not null").select("title", title_to_uri("title", lang).alias("uri"), "markup")


def read_wiki_parsed(spark: SparkSession, path: str, lang: str | None = "en", offset_unit: str = "codepoint") -> DataFrame:
    """title, uri, text, redirect, links, headers, paragraphs of all pages.

    uri and redirect are expressions of their own, so that a query that needs no
    text never runs the markup scanner.
    """
    return parse_raw(read_wiki_raw(spark, path, lang), lang, offset_unit)


def parse_raw(raw: DataFrame, lang: str | None = "en", offset_unit: str = "codepoint") -> DataFrame:
    """read_wiki_parsed() of (title, uri, markup)."""
    lang = lang or "en"
    return raw.select("title", "uri", parsed(lang, offset_unit)("markup").alias("p"), redirect_target("markup", lang).alias("redirect")).select(
        "title", "uri", F.col("p.text").alias("text"), "redirect", F.col("p.links").alias("links"), F.col("p.headers").alias("headers"), F.col("p.paragraphs").alias("paragraphs")
    )
