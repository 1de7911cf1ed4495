"""Schemas of the relations; nothing is inferred from data."""

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _spans(label: str) -> ArrayType:
    return ArrayType(StructType([StructField(label, StringType()), StructField("begin", IntegerType()), StructField("end", IntegerType())]))


LINKS = _spans("target")
TAGS = _spans("tagname")
RAW_PAGES = _strings("title", "uri", "markup")
PARSED_PAGES = StructType(
    [
        *_strings("title", "uri", "text", "redirect").fields,
        StructField("links", LINKS),
        StructField("headers", TAGS),
        StructField("paragraphs", TAGS),
    ]
)
URI_URI = _strings("subject", "object")
URI_LITERAL = _strings("subject", "object", "lang")
SENTENCE_LINKS = StructType(
    [
        StructField("sentenceOrder", IntegerType()),
        StructField("sentence", StringType()),
        StructField("linkTarget", StringType()),
        StructField("linkBegin", IntegerType()),
        StructField("linkEnd", IntegerType()),
    ]
)
TYPE_NAMES = _strings("typeuri", "typename")
TOPIC_COUNTS = StructType([StructField("topicUri", StringType()), *[StructField(n, LongType()) for n in ("articleCount", "narrowerTopicCount", "broaderTopicCount")]])
LINKED_TOPICS = StructType([*_strings("topicUri", "primaryArticleUri").fields, StructField("articleCount", LongType())])
TOPIC_DESCENDANTS = StructType([*LINKED_TOPICS.fields, *_strings("uriLevel1", "uriLevel2").fields])
TOPIC_ARTICLES = StructType([StructField("topicUri", StringType()), StructField("articleCount", LongType()), StructField("articleUri", StringType())])
ANCESTRY = StructType([*LINKED_TOPICS.fields, *_strings("fullPath", "groundedPath").fields, StructField("groundedPathLength", LongType())])
