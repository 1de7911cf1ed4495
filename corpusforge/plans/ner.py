"""From pages to annotated sentences for training entity recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nlp import merge_annotations, sentences_with_links
from ..operators.relational import follow_redirects, replicated_join
from ..sources.ntriples import read_uri_uri
from ..sources.tsv import W3, type_names, write_tsv
from ..sources.wikidump import read_wiki_parsed

THING = W3 + "2002/07/owl#Thing"


def page_sentences(parsed: DataFrame) -> DataFrame:
    """title, sentenceOrder, linkTarget, linkBegin, linkEnd, sentence of all
    pages that are no redirects."""
    rows = sentences_with_links(parsed.filter("redirect is null").select("title", "text", "links", "paragraphs"))
    return rows.select("title", "sentenceOrder", "linkTarget", "linkBegin", "linkEnd", "sentence")


def article_types(wikipedia_links: DataFrame, redirects: DataFrame, instance_types: DataFrame) -> DataFrame:
    """(wikiuri, type) by way of (wikiuri, dburi), redirects followed; the type
    of all things is left out."""
    links = follow_redirects(wikipedia_links.filter("wikiuri is not null"), "dburi", redirects)
    types = instance_types.filter(F.col("type") != THING)
    return types.join(links, "dburi").select("wikiuri", "type")


def annotated_sentences(sentences: DataFrame, types: DataFrame, names: DataFrame, skip_unmatched: bool = False) -> DataFrame:
    """One annotated text for each (title, sentenceOrder) with typed links."""
    named = replicated_join(types.withColumnRenamed("type", "typeuri"), names, "typeuri").select(F.col("wikiuri").alias("linkTarget"), "typename")
    return _merged(replicated_join(sentences, named, "linkTarget"), skip_unmatched)


def annotated_with(sentences: DataFrame, types: DataFrame, type_uri: str, type_name: str | None, skip_unmatched: bool = False) -> DataFrame:
    """The same for one type, whose name (or none) all annotations have."""
    typed = types.filter(F.col("type") == type_uri).select(F.col("wikiuri").alias("linkTarget"), F.lit(type_name).cast("string").alias("typename"))
    return _merged(replicated_join(sentences, typed, "linkTarget"), skip_unmatched)


def _merged(rows: DataFrame, skip_unmatched: bool) -> DataFrame:
    # spans of one place go by type, so that the result does not depend on the run
    span = F.struct(F.col("linkBegin").alias("begin"), F.col("linkEnd").alias("end"), F.col("typename").alias("type"))
    grouped = rows.groupBy("title", "sentenceOrder").agg(F.min("sentence").alias("sentence"), F.array_sort(F.collect_list(span)).alias("spans"))
    return grouped.select("title", "sentenceOrder", merge_annotations("sentence", "spans", skip_unmatched=skip_unmatched).alias("annotated"))


def entity_contexts(sentences: DataFrame) -> DataFrame:
    """(id, text): for each linked page, the sentences that link to it, joined
    by page and place. Prose of one spec; for telling entities apart."""
    # first the sentences of each page, which a task has together and many tasks
    # share; only these texts are brought together by entity
    row = F.struct("sentenceOrder", "sentence")
    said = F.array_sort(F.collect_set(row))
    pages = sentences.groupBy(F.col("linkTarget").alias("id"), "title").agg(F.array_join(F.transform(said, lambda r: r["sentence"]), " ").alias("said"))
    ordered = F.array_sort(F.collect_list(F.struct("title", "said")))
    return pages.groupBy("id").agg(F.array_join(F.transform(ordered, lambda r: r["said"]), " ").alias("text"))


def run_ner(spark: SparkSession, dump: str, triples: str, target: str, lang: str = "en", types_file: str | None = None, type_uri: str | None = None, type_name: str | None = None) -> None:
    """Sentences, types and the annotated corpus as TSV under target/lang."""
    out = f"{target}/{lang}"
    sentences = page_sentences(read_wiki_parsed(spark, dump, lang))
    sentences.orderBy("linkTarget", "title", "sentenceOrder").write.mode("overwrite").parquet(f"{out}/sentences_with_links")
    sentences = spark.read.parquet(f"{out}/sentences_with_links")
    links = read_uri_uri(spark, f"{triples}/wikipedia_links_{lang}.nt", "http://xmlns.com/foaf/0.1/primaryTopic").toDF("wikiuri", "dburi")
    redirects = read_uri_uri(spark, f"{triples}/redirects_{lang}.nt", "http://dbpedia.org/ontology/wikiPageRedirects").toDF("source", "target")
    instances = read_uri_uri(spark, f"{triples}/instance_types_en.nt", W3 + "1999/02/22-rdf-syntax-ns#type").toDF("dburi", "type")
    article_types(links, redirects, instances).orderBy("wikiuri", "type").write.mode("overwrite").parquet(f"{out}/wikiuri_to_types")
    types = spark.read.parquet(f"{out}/wikiuri_to_types")
    if type_uri:
        write_tsv(annotated_with(sentences, types, type_uri, type_name).select("annotated"), f"{out}/annotated_{type_name}")
    else:
        write_tsv(annotated_sentences(sentences, types, type_names(spark, types_file)).select("annotated"), f"{out}/annotated")
