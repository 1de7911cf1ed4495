"""From a category hierarchy and abstracts to one text for each topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import check_abstract, safe_tsv
from ..operators.relational import aggregate_grouped, cogroup_counts, concat_grouped, cut_lineage, expand_paths, follow_redirects, split_if, union_all, without
from ..sources.ntriples import read_uri_literal, read_uri_uri, write_uri_literal
from ..sources.tsv import W3, write_all, write_tsv

CATEGORY = "Category:"
RESOURCE = "http://dbpedia.org/resource/"
ROOT = "Category:Main_topic_classifications"

#: Topics that say nothing about a field. Three stand without the prefix, as
#: they always did, and so never match.
BLACKLIST = [CATEGORY + n for n in ("People", "Living_people", "Dead_people", "Chronology", "Events", "Years", "Surnames", "People_by_period")]
BLACKLIST += [CATEGORY + n for n in ("Categories_by_language", "Articles_missing_birth_or_death_information", "Year_of_birth_unknown")]
_UNKNOWN = ["Year_of_birth_missing_%28living_people%29", "Place_of_birth_missing_%28living_people%29"]
BLACKLIST += [CATEGORY + n for n in _UNKNOWN] + _UNKNOWN + ["Year_of_death_missing"]


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(narrowerTopicUri, broaderTopicUri)"""
    return read_uri_uri(spark, path, W3 + "2004/02/skos/core#broader", RESOURCE, RESOURCE).toDF("narrowerTopicUri", "broaderTopicUri")


def read_article_topics(spark: SparkSession, path: str) -> DataFrame:
    """(articleUri, topicUri)"""
    return read_uri_uri(spark, path, "http://purl.org/dc/terms/subject", RESOURCE, RESOURCE).toDF("articleUri", "topicUri")


def read_abstracts(spark: SparkSession, path: str, property_uri: str = "http://dbpedia.org/ontology/abstract") -> DataFrame:
    """(articleUri, articleAbstract)"""
    return read_uri_literal(spark, path, property_uri, RESOURCE).select(F.col("subject").alias("articleUri"), F.col("object").alias("articleAbstract"))


def read_redirects(spark: SparkSession, path: str) -> DataFrame:
    """(source, target)"""
    return read_uri_uri(spark, path, "http://dbpedia.org/ontology/wikiPageRedirects", RESOURCE, RESOURCE).toDF("source", "target")


def topic_counts(article_topics: DataFrame, edges: DataFrame) -> DataFrame:
    """Articles, children and parents of each topic that has one of the latter."""
    counts = cogroup_counts(
        "topicUri",
        articleCount=(article_topics, "topicUri", "articleUri"),
        narrowerTopicCount=(edges, "broaderTopicUri", "narrowerTopicUri"),
        broaderTopicCount=(edges, "narrowerTopicUri", "broaderTopicUri"),
    )
    return counts.filter("narrowerTopicCount <> 0 or broaderTopicCount <> 0")


def abstract_checks(abstracts: DataFrame, min_words: int = 30) -> DataFrame:
    """(articleUri, hasGoodAbstract): 1 or null."""
    return abstracts.select("articleUri", F.when(check_abstract("articleAbstract", min_words), F.lit(1)).alias("hasGoodAbstract"))


def linked_topics(counts: DataFrame, checks: DataFrame, redirects: DataFrame) -> DataFrame:
    """Topics with the article of the same name, if it has a good abstract.

    A redirect of the name is followed; several give several rows.
    """
    named = without(counts, "topicUri", BLACKLIST).select("topicUri", F.regexp_replace("topicUri", CATEGORY, "").alias("candidate"), "articleCount")
    named = follow_redirects(named, "candidate", redirects)
    joined = named.join(checks, F.col("candidate") == F.col("articleUri"), "left")
    return joined.select("topicUri", F.when(F.col("hasGoodAbstract").isNotNull(), F.col("articleUri")).alias("primaryArticleUri"), "articleCount").distinct()


def split_grounded(linked: DataFrame) -> dict[str, DataFrame]:
    parts = split_if(linked, grounded="primaryArticleUri is not null", nongrounded="primaryArticleUri is null")
    return {"grounded": parts["grounded"], "nongrounded": parts["nongrounded"].select("topicUri", "articleCount")}


def _proper(edges: DataFrame) -> DataFrame:
    return edges.filter("broaderTopicUri <> narrowerTopicUri").distinct()


def topic_descendants(linked: DataFrame, edges: DataFrame, max_level: int = 1) -> DataFrame:
    """Linked topics with their descendants by level; null where there are none.

    uriLevel2 is null unless max_level is 2.
    """
    down = _proper(edges)
    one = down.select(F.col("broaderTopicUri").alias("up"), F.col("narrowerTopicUri").alias("uriLevel1"))
    out = linked.join(one, linked.topicUri == F.col("up"), "left").drop("up")
    if max_level > 1:
        two = down.select(F.col("broaderTopicUri").alias("up"), F.col("narrowerTopicUri").alias("uriLevel2"))
        out = out.join(two, F.col("uriLevel1") == F.col("up"), "left").drop("up")
    else:
        out = out.withColumn("uriLevel2", F.lit(None).cast("string"))
    return out.select("topicUri", "primaryArticleUri", "articleCount", "uriLevel1", "uriLevel2").distinct()


def topic_articles(descendants: DataFrame, article_topics: DataFrame, grounded_only: bool = False) -> DataFrame:
    """Articles of grounded topics (their own and their primary one), and of the
    children of all topics, or of grounded ones only."""
    grounded = descendants.filter("primaryArticleUri is not null")
    of_level1 = (grounded if grounded_only else descendants).filter("uriLevel1 is not null")
    articles = article_topics.select("articleUri", F.col("topicUri").alias("t"))
    primary = grounded.select("topicUri", "articleCount", F.col("primaryArticleUri").alias("articleUri"))
    own = grounded.select("topicUri", "articleCount").distinct().join(articles, F.col("topicUri") == F.col("t")).select("topicUri", "articleCount", "articleUri")
    below = of_level1.select("topicUri", "articleCount", "uriLevel1").distinct().join(articles, F.col("uriLevel1") == F.col("t")).select("topicUri", "articleCount", "articleUri")
    return union_all(primary, own, below).distinct()


def grounded_ancestry(linked: DataFrame, edges: DataFrame, root: str = ROOT, levels: int = 5) -> DataFrame:
    """Paths from the children of the root to each topic, up to `levels` long.

    Paths are kept as arrays, so a slash in a name makes no false loop; they are
    rendered with slashes, and the grounded path of one that starts at a topic
    without an article starts with a slash.
    """
    down = _proper(edges).select(F.col("narrowerTopicUri").alias("node"), F.col("broaderTopicUri").alias("parent"))
    nodes = linked.select(F.col("topicUri").alias("node"), "primaryArticleUri", "articleCount")
    paths = expand_paths(down.join(nodes, "node").distinct(), F.col("parent") == root, levels, "primaryArticleUri")
    rendered = F.array_join("groundedPath", "/")
    return paths.select(
        F.col("node").alias("topicUri"),
        "primaryArticleUri",
        "articleCount",
        F.array_join("fullPath", "/").alias("fullPath"),
        F.when(F.col("startsBare") & (F.size("groundedPath") > 0), F.concat(F.lit("/"), rendered)).otherwise(rendered).alias("groundedPath"),
        F.size("groundedPath").alias("groundedPathLength"),
    )


def topic_texts(abstracts: DataFrame, articles: DataFrame, ancestry: DataFrame, min_words: int = 30, more_than: int = 10, size_limit: int = 100_000) -> DataFrame:
    """topicUri, abstractCount, paths, aggregateTopicAbstract of each topic with
    more than so many good abstracts. Abstracts go by their article's name."""
    paths = concat_grouped(ancestry.filter("primaryArticleUri is not null"), ["topicUri"], "groundedPath", ["groundedPath"], "paths")
    # written without texts, for the groups are counted before they are cut
    rows = cut_lineage(paths.join(articles.select("topicUri", "articleUri"), "topicUri"))
    good = abstracts.filter(check_abstract("articleAbstract", min_words))
    rows = rows.join(good, "articleUri")
    out = aggregate_grouped(rows, ["topicUri", "paths"], "articleAbstract", ["articleUri"], "aggregateTopicAbstract", "abstractCount", size_limit)
    return out.filter(F.col("abstractCount") > more_than).select("topicUri", "abstractCount", "paths", "aggregateTopicAbstract")


def run_topics(spark: SparkSession, source: str, target: str, lang: str = "en") -> None:
    """All steps from the four dumps in `source` (files *_{lang}.nt.bz2)."""
    edges = read_edges(spark, f"{source}/skos_categories_{lang}.nt.bz2")
    article_topics = read_article_topics(spark, f"{source}/article_categories_{lang}.nt.bz2")
    abstracts = read_abstracts(spark, f"{source}/long_abstracts_{lang}.nt.bz2")
    redirects = read_redirects(spark, f"{source}/redirects_{lang}.nt.bz2")

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        return spark.read.parquet(f"{target}/{name}")

    counts = stage(topic_counts(article_topics, edges), "topics_counts")
    checks = stage(abstract_checks(abstracts), "articles_abstract_check")
    linked = stage(linked_topics(counts, checks, redirects), "linked_topics")
    for name, part in split_grounded(linked).items():
        stage(part, f"{name}_topics")
    descendants = stage(topic_descendants(linked, edges), "topic_descendants")
    articles = stage(topic_articles(descendants, article_topics), "grounded_topics_articles")
    ancestry = stage(grounded_ancestry(linked, edges), "grounded_ancestry")
    texts = topic_texts(abstracts, articles, ancestry).orderBy(F.desc("abstractCount"), "topicUri", "paths")
    write_all(
        texts,
        tsv=lambda df: write_tsv(df.withColumn("aggregateTopicAbstract", safe_tsv("aggregateTopicAbstract")), f"{target}/topics_abstracts.tsv"),
        nt=lambda df: write_uri_literal(df.select("topicUri", "aggregateTopicAbstract"), f"{target}/topics_abstracts.nt", "http://example.org/merged-abstracts", RESOURCE, lang),
    )
