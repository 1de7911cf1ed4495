"""The registered queries over the driver's tables, with their SQL.

The tables stand in for dumps: regions, nations, customers and orders are a
category hierarchy, customers and suppliers its articles, documents their
abstracts. Each query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nlp, text
from ..functions.markup import span_texts
from ..operators import relational
from ..sources import html, ntriples, tsv, wikidump
from . import extract, ner, similarity, topics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL pieces -----------------------------------------------------------------

_LETTERS = " ".join(map(chr, range(65, 91)))


def _sql_good(c: str) -> str:
    return f"(len(string_split(rtrim({c}, ' '), ' ')) >= 30 AND NOT contains({c}, '{_LETTERS}'))"


def _sql_uri(title: str) -> str:
    return f"'http://en.wikipedia.org/wiki/' || replace(replace(url_encode(replace({title}, ' ', '_')), '%2A', '*'), '~', '%7E')"


def _sql_safe(c: str) -> str:
    return f"""'"' || replace(regexp_replace({c}, '[\\t\\n]', ' ', 'g'), '"', '""') || '"'"""


def _sql_aggregate(source: str, keys: str, value: str, order: str, limit: int = 100_000) -> str:
    """Window form of the bounded aggregate; `source` is a relation's name."""
    return f"""
    capped AS (SELECT *, count(*) OVER g AS n, greatest({limit} // count(*) OVER g, 200) AS cap FROM {source} WINDOW g AS (PARTITION BY {keys})),
    cut AS (SELECT *, CASE WHEN length({value}) <= cap THEN {value}
        WHEN instr(substr({value}, cap), ' ') > 0 THEN substr({value}, 1, cap + instr(substr({value}, cap), ' ') - 2)
        ELSE substr({value}, 1, cap) END AS piece FROM capped),
    running AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM cut),
    aggregated AS (SELECT {keys}, max(n) AS n, string_agg(piece, ' ' ORDER BY {order}) AS body FROM running WHERE taken < {limit} GROUP BY {keys})"""


# --- texts ----------------------------------------------------------------------


@_query(
    f"""
WITH good AS (SELECT * FROM documents WHERE {_sql_good("text")}),
{_sql_aggregate("good", "lang", "text", "doc_id")},
firsts AS (SELECT lang, source, min(doc_id) AS d FROM good GROUP BY ALL),
paths AS (SELECT lang, string_agg(source, ' ' ORDER BY d) AS paths FROM firsts GROUP BY lang)
SELECT lang, n AS abstract_count, paths, {_sql_safe("body")} AS aggregate_text FROM aggregated JOIN paths USING (lang) WHERE n > 10
"""
)
def topic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents of each language as one bounded, safe text."""
    good = _t(spark, sf_dir, "documents").filter(text.check_abstract("text"))
    paths = relational.concat_grouped(good, ["lang"], "source", ["doc_id"], "paths")
    texts = relational.aggregate_grouped(good, ["lang"], "text", ["doc_id"], "body", "abstract_count").filter("abstract_count > 10")
    return texts.join(paths, "lang").select("lang", "abstract_count", "paths", text.safe_tsv("body").alias("aggregate_text")).orderBy(F.desc("abstract_count"), "lang")


@_query(f"SELECT source, count(*) AS n_good, sum(length(text)) AS n_chars FROM documents WHERE {_sql_good('text')} GROUP BY source")
def check_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _t(spark, sf_dir, "documents").filter(text.check_abstract("text"))
    return good.groupBy("source").agg(F.count("*").alias("n_good"), F.sum(F.length("text")).alias("n_chars"))


@_query("""WITH firsts AS (SELECT lang, source, min(doc_id) AS d FROM documents GROUP BY ALL) SELECT lang, string_agg(source, ' _ ' ORDER BY d) AS sources FROM firsts GROUP BY lang""")
def concat_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = _t(spark, sf_dir, "documents").withColumn("source", F.concat(F.lit(" "), "source", F.lit("\t ")))
    return relational.concat_grouped(spaced, ["lang"], "source", ["doc_id"], "sources", " _ ")


@_query(
    """WITH items AS (SELECT source, doc_id, CASE WHEN length(text) <= 200 THEN text WHEN instr(substr(text, 200), ' ') > 0 THEN substr(text, 1, 200 + instr(substr(text, 200), ' ') - 2) ELSE substr(text, 1, 200) END AS piece
  FROM documents),
running AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM items)
SELECT source, string_agg(piece, ' ' ORDER BY doc_id) AS body FROM running WHERE taken < 1500 GROUP BY source"""
)
def aggregate_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array form of the bounded aggregate."""
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    grouped = _t(spark, sf_dir, "documents").groupBy("source").agg(F.transform(rows, lambda r: r["text"]).alias("items"))
    return grouped.select("source", text.aggregate_texts("items", 1500).alias("body"))


@_query(f"""SELECT doc_id, {_sql_safe("replace(replace(text, ' a', chr(9)), ' t', chr(34))")} AS field FROM documents""")
def safe_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.replace(F.replace(F.col("text"), F.lit(" a"), F.lit("\t")), F.lit(" t"), F.lit('"'))
    return _t(spark, sf_dir, "documents").select("doc_id", text.safe_tsv(changed).alias("field"))


@_query(
    """SELECT l_orderkey, l_linenumber, path, CASE WHEN len(parts) < 2 THEN true ELSE NOT list_contains(parts[1 : len(parts) - 1], parts[len(parts)]) END AS no_loop
FROM (SELECT *, string_split(path, '/') AS parts FROM (SELECT l_orderkey, l_linenumber, l_returnflag || '/' || l_linestatus || '/' || (l_linenumber % 3) || '/' || (l_suppkey % 3) AS path FROM lineitem))"""
)
def no_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string"), (F.col("l_suppkey") % 3).cast("string"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", path.alias("path"))
    return rows.withColumn("no_loop", text.no_loop("path", "/"))


@_query(f"""SELECT p_partkey, {_sql_uri("p_name || ' (' || p_brand || ') *~é&/'")} AS uri FROM part""")
def title_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") *~é&/"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.title_to_uri(title).alias("uri"))


@_query("SELECT p_partkey, p_type || ' + ' || p_name AS label FROM part")
def human_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.concat(F.lit("Category:"), F.replace(F.concat("p_type", F.lit(" + "), F.replace(F.col("p_name"), F.lit("%"), F.lit("%25"))), F.lit(" "), F.lit("_")))
    return _t(spark, sf_dir, "part").select("p_partkey", text.human_readable(topic).alias("label"))


#: Runs of letters, digits or one sign; RE2 has no back references.
_TOKEN = r"[\pL]+|[\p{Nd}]+|" + "|".join(f"[{chr(92)}{chr(k)}]+" for k in range(33, 127) if not chr(k).isalnum() and chr(k) != "'") + "|[\'\']+|[^\\s\\pL\\p{Nd}]"


def _sql_tokens(c: str) -> str:
    return f"array_to_string(regexp_extract_all({c}, '{_TOKEN}'), ' ')"


@_query(f"SELECT doc_id, {_sql_tokens('text')} AS tokens FROM documents")
def tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all texts."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(nlp.tokens("text"), " ").alias("tokens"))


# --- sources and sinks ----------------------------------------------------------


@_query("SELECT n_name AS subject, 'Category:' || r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey")
def uri_triples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _nations(spark, sf_dir).select("n_name", F.concat(F.lit("Category:"), "r_name"))
    spaced = pairs.toDF("s", "o").select(F.replace("s", F.lit(" "), F.lit("+")).alias("s"), F.replace("o", F.lit(" "), F.lit("+")).alias("o"))
    path = f"{relational.shared_folder(spark)}/uris-{uuid4().hex}.nt.bz2"
    ntriples.write_uri_uri(spaced, path, "http://example.org/p", topics.RESOURCE, topics.RESOURCE)
    back = ntriples.read_uri_uri(spark, path, "http://example.org/p", topics.RESOURCE, topics.RESOURCE, strict=True)
    return back.select(*[F.replace(c, F.lit("+"), F.lit(" ")).alias(c) for c in back.columns])


@_query("SELECT doc_id::VARCHAR AS subject, text AS object, 'en' AS lang FROM documents")
def literal_triples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{relational.shared_folder(spark)}/literals-{uuid4().hex}.nt"
    ntriples.write_uri_literal(_t(spark, sf_dir, "documents").select("doc_id", "text"), path, "http://example.org/p", topics.RESOURCE, "en")
    return ntriples.read_uri_literal(spark, path, "http://example.org/p", topics.RESOURCE)


_ESCAPED = r"""array_to_string(list_transform(string_split(text, ''), lambda c: CASE
  WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(9) THEN '\t' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r'
  WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN printf('\u%04X', unicode(c))
  ELSE printf('\u%04X\u%04X', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END), '')"""


@_query(f"SELECT doc_id, {_ESCAPED} AS escaped FROM (SELECT doc_id, text || chr(128512) || chr(127) || chr(12) AS text FROM documents)")
def escape_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with three rare signs behind each, escaped for N-Triples."""
    return _t(spark, sf_dir, "documents").select("doc_id", ntriples.escape_ascii(F.concat("text", F.lit("\U0001f600\x7f\f"))).alias("escaped"))


@_query("SELECT c_custkey::VARCHAR AS custkey, c_name || ' \"' || c_mktsegment || '\"' AS line, c_name || ' \"' || c_mktsegment || '\"' AS literal FROM customer")
def multi_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relation written as lines and as triples, both read again."""
    name = F.concat("c_name", F.lit(' "'), "c_mktsegment", F.lit('"'))
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("custkey"), name.alias("name"))
    path = f"{relational.shared_folder(spark)}/sinks-{uuid4().hex}"
    tsv.write_all(
        rows,
        tsv=lambda df: tsv.write_tsv(df, f"{path}.tsv"),
        nt=lambda df: ntriples.write_uri_literal(df, f"{path}.nt.gz", "http://example.org/p", topics.RESOURCE, "en"),
    )
    lines = tsv.read_tsv(spark, f"{path}.tsv", "custkey string, line string")
    literals = ntriples.read_uri_literal(spark, f"{path}.nt.gz", "http://example.org/p", topics.RESOURCE)
    return lines.join(literals, F.col("custkey") == F.col("subject")).select("custkey", "line", F.col("object").alias("literal"))


@_query("SELECT c_custkey::VARCHAR AS custkey, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer")
def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as lines and read again: nulls come back as nulls."""
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    path = f"{relational.shared_folder(spark)}/rows-{uuid4().hex}.tsv"
    tsv.write_tsv(rows, path)
    return tsv.read_tsv(spark, path, "custkey string, name string, segment string")


def _dump(pages: DataFrame, suffix: str = "") -> str:
    """(title, markup) rows written as a dump; its path."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    block = F.concat(
        F.lit("  <page>\n    <title>"), escape("title"), F.lit('</title>\n    <revision>\n      <text xml:space="preserve">'), escape("markup"), F.lit("</text>\n    </revision>\n  </page>")
    )
    path = f"{relational.shared_folder(pages.sparkSession)}/dump-{uuid4().hex}.xml"
    ntriples.write_lines(pages.select(block), path, {"": "none", ".bz2": "bzip2"}[suffix])
    return path


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pages, and for each source a page that leads to it."""
    docs = _t(spark, sf_dir, "documents")
    pages = docs.select(F.concat("source", F.lit(" & "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("markup"))
    moved = docs.select("source").distinct().select(F.concat(F.lit("To "), "source"), F.concat(F.lit("#REDIRECT [["), "source", F.lit("]]")))
    return pages.union(moved)


@_query(
    f"""SELECT title, {_sql_uri("title")} AS uri, markup FROM (
SELECT source || ' & ' || doc_id AS title, text AS markup FROM documents UNION ALL SELECT DISTINCT 'To ' || source, '#REDIRECT [[' || source || ']]' FROM documents)"""
)
def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump written to files and read again, in splits."""
    return wikidump.read_wiki_raw(spark, _dump(_raw(spark, sf_dir)))


@_query(f"""SELECT DISTINCT {_sql_uri("'To ' || source")} AS uri, {_sql_uri("source")} AS redirect FROM documents""")
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_redirects(spark, _dump(_raw(spark, sf_dir), ".bz2"))


#: What stands behind each text in parsed_pages(), and what of it is left, by paragraphs.
_CASES = [
    ('Of [[Category:Gone|this]][[fr:Gone]] links [[#part|inner]] stay.<ref name="a">gone [[no]]</ref><!-- [[no]] -->', "Of  links inner stay."),
    ("[[File:a.png|thumb|200px|A caption with [[%s]] in it]]", "A caption with %s in it"),
    ("{|\n| cell [[no]]\n{|\n| inner\n|}\n|}\n* item [[no]]\n# item\n; term : item", ""),
    ("__NOTOC__An <b>'''inner'''</b> <span class=\"x\">tag</span>, {{no|{{no}}}}or [http://example.org/ outer label].", "An inner tag, or outer label."),
    ('Not <a href="http://fr.wikipedia.org/wiki/No">this</a> nor [http://de.wikipedia.org/wiki/No this].', "Not  nor ."),
]


def _texts_with_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _linked_texts(spark, sf_dir)
    more = "\n\n".join(c for c, _ in _CASES).split("%s")
    markup = F.concat(F.lit("{{Infobox\n| a = {{b|[[no]]}}\n}}\n"), "markup", F.lit("\n\n" + more[0]), "source", F.lit(more[1]))
    return docs.select("title", markup.alias("markup"))


def _text_pages_sql() -> str:
    kept = " || chr(10) || ".join("'" + k.replace("%s", "' || source || '") + "'" for _, k in _CASES if k)
    return f"""WITH {_WORDS},
    by_line AS (SELECT doc_id, any_value(source) AS source, line_no, string_agg(word, ' ' ORDER BY word_no) AS line, count_if(linked) AS n FROM words GROUP BY doc_id, line_no),
    by_doc AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS body, count(*) AS lines, sum(n) AS links FROM by_line GROUP BY doc_id)
    SELECT doc_id::VARCHAR AS title, {_sql_uri("doc_id::VARCHAR")} AS uri, source || chr(10) || chr(10) || coalesce(body, '') || {kept} || chr(10) AS text, NULL::VARCHAR AS redirect,
      (coalesce(links, 0) + 1)::INT AS n_links, 1 AS n_headers, (coalesce(lines, 0) + {sum(bool(k) for _, k in _CASES)})::INT AS n_paragraphs
    FROM documents LEFT JOIN by_doc USING (doc_id)
    UNION ALL SELECT DISTINCT 'To ' || source, {_sql_uri("'To ' || source")}, '', {_sql_uri("source")}, 0, 0, 0 FROM documents"""


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as markup with links, and all that markup may have behind
    them, through the files of a dump; and redirects."""
    moved = _raw(spark, sf_dir).filter(F.startswith("title", F.lit("To ")))
    parsed = wikidump.read_wiki_parsed(spark, _dump(_texts_with_cases(spark, sf_dir).union(moved)))
    return parsed.select("title", "uri", "text", "redirect", F.size("links").alias("n_links"), F.size("headers").alias("n_headers"), F.size("paragraphs").alias("n_paragraphs"))


@_query("SELECT n_name AS title, 'Error - nesting is too deep' || chr(10) AS text, 257 AS n_links FROM nation")
def markup_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links within links beyond what the scanner follows."""
    deep = F.concat(F.repeat(F.concat(F.lit("[["), "n_name", F.lit("|")), F.lit(300)), "n_name", F.lit("]]" * 300))
    raw = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), text.title_to_uri("n_name").alias("uri"), deep.alias("markup"))
    return wikidump.parse_raw(raw).select("title", "text", F.size("links").alias("n_links"))


def _tags(t: str) -> str:
    return f"regexp_extract_all(html, '(?is)<{t}(?:\\s[^>]*)?>(.*?)</{t}\\s*>', 1)"


_ENTITIES = "replace(replace(replace(replace(replace(replace(x, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&')"


@_query(
    f"""SELECT page_id, array_to_string([{_ENTITIES.replace("(x,", "(regexp_replace(y, '(?s)<[^>]*>', '', 'g'),")} FOR y IN
  list_concat({", ".join(_tags(t) for t in html.TAGS)})], chr(10) || chr(10)) AS body
FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g') AS html FROM pages)"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", html.html_text("html").alias("body"))


# --- topics ---------------------------------------------------------------------


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _category(c: Column | str) -> Column:
    return F.concat(F.lit("Category:"), c)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _nations(spark, sf_dir)
    customers = _t(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    parts = [
        _t(spark, sf_dir, "region").select(_category("r_name"), F.lit(topics.ROOT)),
        nations.select(_category("n_name"), _category("r_name")),
        customers.select(_category("c_name"), _category("n_name")),
        orders.select(_category(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))), _category("c_name")),
        nations.select(_category("r_name"), _category("n_name")),  # loops
    ]
    return relational.union_all(*[p.toDF("narrowerTopicUri", "broaderTopicUri") for p in parts])


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _t(spark, sf_dir, "nation")
    customers = _t(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = _t(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return customers.select("c_name", _category("n_name")).union(suppliers.select("s_name", _category("n_name"))).toDF("articleUri", "topicUri")


def _abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    customers = _t(spark, sf_dir, "customer").join(docs, F.col("c_custkey") == F.col("doc_id")).select("c_name", "text")
    nations = _t(spark, sf_dir, "nation").join(docs, F.col("n_nationkey") == F.col("doc_id")).select("n_name", "text")
    return customers.union(nations).toDF("articleUri", "articleAbstract")


def _redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's name leads to its nations'."""
    return _nations(spark, sf_dir).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = topics.topic_counts(_articles(spark, sf_dir), _edges(spark, sf_dir))
    return topics.linked_topics(counts, topics.abstract_checks(_abstracts(spark, sf_dir)), _redirects(spark, sf_dir))


_GRAPH = f"""
nations AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
edges(narrower, broader) AS (
  SELECT 'Category:' || r_name, '{topics.ROOT}' FROM region
  UNION ALL SELECT 'Category:' || n_name, 'Category:' || r_name FROM nations
  UNION ALL SELECT 'Category:' || c_name, 'Category:' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Category:Order ' || o_orderkey, 'Category:' || c_name FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'Category:' || r_name, 'Category:' || n_name FROM nations
),
proper AS (SELECT DISTINCT * FROM edges WHERE narrower <> broader),
articles(article, topic) AS (
  SELECT c_name, 'Category:' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_name, 'Category:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
abstracts(article, abstract) AS (
  SELECT c_name, text FROM customer JOIN documents ON c_custkey = doc_id
  UNION ALL SELECT n_name, text FROM nation JOIN documents ON n_nationkey = doc_id
),
counts AS (
  SELECT topicUri, sum(a)::BIGINT AS articleCount, sum(n)::BIGINT AS narrowerTopicCount, sum(b)::BIGINT AS broaderTopicCount FROM (
    SELECT topic AS topicUri, 1 AS a, 0 AS n, 0 AS b FROM articles
    UNION ALL SELECT broader, 0, 1, 0 FROM edges UNION ALL SELECT narrower, 0, 0, 1 FROM edges)
  GROUP BY topicUri HAVING sum(n) <> 0 OR sum(b) <> 0
),
named AS (SELECT topicUri, coalesce(n_name, replace(topicUri, 'Category:', '')) AS candidate, articleCount FROM counts LEFT JOIN nations ON r_name = replace(topicUri, 'Category:', '')),
linked AS (
  SELECT DISTINCT topicUri, CASE WHEN good THEN article END AS primaryArticleUri, articleCount
  FROM named LEFT JOIN (SELECT article, {_sql_good("abstract")} AS good FROM abstracts) ON candidate = article
),
descendants AS (SELECT DISTINCT topicUri, primaryArticleUri, articleCount, narrower AS uriLevel1, NULL::VARCHAR AS uriLevel2 FROM linked LEFT JOIN proper ON topicUri = broader),
found(topicUri, articleCount, articleUri) AS (
  SELECT topicUri, articleCount, primaryArticleUri FROM descendants WHERE primaryArticleUri IS NOT NULL
  UNION SELECT topicUri, articleCount, article FROM descendants JOIN articles ON topicUri = topic WHERE primaryArticleUri IS NOT NULL
  UNION SELECT topicUri, articleCount, article FROM descendants JOIN articles ON uriLevel1 = topic
),
children AS (SELECT DISTINCT topicUri, primaryArticleUri, articleCount, broader FROM proper JOIN linked ON narrower = topicUri)
"""
_PATHS = """
walk(topicUri, primaryArticleUri, articleCount, path, ground, bare) AS (
  SELECT topicUri, primaryArticleUri, articleCount, [topicUri], CASE WHEN primaryArticleUri IS NULL THEN [] ELSE [topicUri] END, primaryArticleUri IS NULL
  FROM children WHERE broader = '%s'
  UNION ALL
  SELECT c.topicUri, c.primaryArticleUri, c.articleCount, list_append(path, c.topicUri), CASE WHEN c.primaryArticleUri IS NULL THEN ground ELSE list_append(ground, c.topicUri) END, bare
  FROM walk w JOIN children c ON w.topicUri = c.broader WHERE len(path) < 5 AND NOT list_contains(path, c.topicUri)
),
ancestry AS (
  SELECT topicUri, primaryArticleUri, articleCount, array_to_string(path, '/') AS fullPath,
    CASE WHEN bare AND len(ground) > 0 THEN '/' ELSE '' END || array_to_string(ground, '/') AS groundedPath, len(ground)::INT AS groundedPathLength FROM walk
)
""" % topics.ROOT


@_query(f"WITH {_GRAPH} SELECT * FROM counts")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_counts(_articles(spark, sf_dir), _edges(spark, sf_dir)).orderBy(F.desc("articleCount"), "topicUri")


@_query(f"WITH {_GRAPH} SELECT article AS articleUri, CASE WHEN {_sql_good('abstract')} THEN 1 END AS hasGoodAbstract FROM abstracts")
def abstract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.abstract_checks(_abstracts(spark, sf_dir))


@_query(f"WITH {_GRAPH} SELECT * FROM linked")
def linked_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)


@_query(f"WITH {_GRAPH} SELECT * FROM linked WHERE primaryArticleUri IS NOT NULL")
def grounded_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.split_grounded(_linked(spark, sf_dir))["grounded"].orderBy(F.desc("articleCount"), "topicUri", "primaryArticleUri")


@_query(f"WITH {_GRAPH} SELECT topicUri, articleCount FROM linked WHERE primaryArticleUri IS NULL")
def nongrounded_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.split_grounded(_linked(spark, sf_dir))["nongrounded"]


@_query(f"WITH {_GRAPH} SELECT * FROM descendants")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_descendants(_linked(spark, sf_dir), _edges(spark, sf_dir))


@_query(f"WITH {_GRAPH} SELECT * FROM found")
def topic_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = relational.cut_lineage(topics.topic_descendants(_linked(spark, sf_dir), _edges(spark, sf_dir)))
    return topics.topic_articles(down, _articles(spark, sf_dir)).orderBy(F.desc("articleCount"), "topicUri", "articleUri")


@_query(f"WITH RECURSIVE {_GRAPH}, {_PATHS} SELECT * FROM ancestry")
def ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.grounded_ancestry(_linked(spark, sf_dir), _edges(spark, sf_dir))


@_query(
    f"""WITH RECURSIVE {_GRAPH}, {_PATHS},
joined AS (SELECT DISTINCT topicUri, groundedPath FROM ancestry WHERE primaryArticleUri IS NOT NULL AND groundedPath <> ''),
paths AS (SELECT topicUri, string_agg(groundedPath, ' ' ORDER BY groundedPath) AS paths FROM joined GROUP BY topicUri),
bodies AS (
  SELECT f.topicUri, paths, a.article, a.abstract FROM paths JOIN (SELECT topicUri, articleUri FROM found) f USING (topicUri)
  JOIN abstracts a ON a.article = f.articleUri WHERE {_sql_good("a.abstract")}
),
{_sql_aggregate("bodies", "topicUri, paths", "abstract", "article, abstract")}
SELECT topicUri, n AS abstractCount, paths, body AS aggregateTopicAbstract FROM aggregated WHERE n > 10"""
)
def topic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six steps of the topic corpus in one."""
    linked, edges = relational.cut_lineage(_linked(spark, sf_dir)), _edges(spark, sf_dir)
    down = relational.cut_lineage(topics.topic_descendants(linked, edges))
    found = topics.topic_articles(down, _articles(spark, sf_dir))
    return topics.topic_texts(_abstracts(spark, sf_dir), found, topics.grounded_ancestry(linked, edges)).orderBy(F.desc("abstractCount"), "topicUri", "paths")


# --- entities -------------------------------------------------------------------


def _linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pages with their whole text below a heading, each line
    a paragraph in which each twelfth word links to the page of the source."""
    docs = _t(spark, sf_dir, "documents")
    lines = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\f\x0B]+", " "), r" ?\n ?", "\n\n"))
    linked = F.regexp_replace(lines, F.lit(r"((?:\S+ ){11})(\S+)"), F.concat(F.lit("$1[["), "source", F.lit("|$2]]")))
    title = F.col("doc_id").cast("string")
    return docs.select(title.alias("title"), text.title_to_uri(title).alias("uri"), F.concat(F.lit("== "), "source", F.lit(" ==\n"), linked).alias("markup"), "source")


_SHORT = ", ".join(f"'{w}'" for w in sorted(nlp._SHORT))
_CLOSE, _OPEN = """["''”’»)\\]]*""", """^["''“‘«(\\[]+"""
#: The words of the pages' paragraphs, with their sentence and its begin: lines
#: that begin as lists do are none; stops at the end of a word end a sentence
#: before a word that begins with no small letter.
_WORDS = rf"""
lines AS (
  SELECT doc_id, source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no
  FROM (SELECT doc_id, source, string_split(trim(regexp_replace(regexp_replace(text, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n ?', chr(10) || chr(10), 'g'), ' '), chr(10) || chr(10)) AS l FROM documents)
),
cut AS (SELECT doc_id, source, line_no, string_split(line, ' ') AS w FROM lines WHERE line <> '' AND NOT regexp_matches(line, '^[*#:;]|^----')),
singly AS (SELECT doc_id, source, line_no, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS word_no FROM cut),
beside AS (
  SELECT *, regexp_extract(word, '([.!?…]+){_CLOSE}$', 1) AS stops, substr(regexp_replace(lead(word) OVER line, '{_OPEN}', ''), 1, 1) AS next,
    regexp_extract(regexp_replace(word, '[.!?…]+{_CLOSE}$', ''), '[\pL\pN_.]*$') AS before,
    coalesce(sum(length(word) + 1) OVER (line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM singly WINDOW line AS (PARTITION BY doc_id, line_no ORDER BY word_no)
),
ended AS (
  SELECT *, (stops <> '' AND regexp_matches(coalesce(next, ''), '^[\pL\pN]') AND NOT regexp_matches(coalesce(next, ''), '^\p{{Ll}}')
    AND NOT (stops = '.' AND (lower(before) IN ({_SHORT}) OR regexp_full_match(before, '\p{{Lu}}|(?:[A-Z]\.)+[A-Z]'))))::INT AS ends FROM beside
),
parts AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ended),
words AS (
  SELECT doc_id, source, line_no, word_no, word, word_no % 12 = 0 AS linked, dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no, part)::INT AS sentence_no,
    (pos - min(pos) OVER (PARTITION BY doc_id, line_no, part))::INT AS pos FROM parts
),
sentences AS (SELECT doc_id, sentence_no, string_agg(word, ' ' ORDER BY word_no) AS sentence FROM words GROUP BY doc_id, sentence_no),
links AS (
  SELECT doc_id, source, sentence_no AS "sentenceOrder", sentence, {_sql_uri("upper(source[1]) || source[2:]")} AS "linkTarget", pos AS "linkBegin", pos + length(word)::INT AS "linkEnd"
  FROM words JOIN sentences USING (doc_id, sentence_no) WHERE linked
)"""
_query(_text_pages_sql())(parsed_pages)


def _text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.page_sentences(wikidump.parse_raw(_linked_texts(spark, sf_dir)))


@_query(f"""WITH {_WORDS} SELECT doc_id::VARCHAR AS title, * EXCLUDE (doc_id, source) FROM links""")
def sentence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_sentences(spark, sf_dir)


@_query(f"""WITH {_WORDS} SELECT {_sql_uri("doc_id::VARCHAR")} AS uri, * EXCLUDE (doc_id, source) FROM links""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(wikidump.parse_raw(_linked_texts(spark, sf_dir)))


@_query(
    f"""WITH {_WORDS}, paragraphs AS (SELECT doc_id, string_agg(word, CASE WHEN word_no = 1 THEN chr(10) ELSE ' ' END ORDER BY line_no, word_no) AS paragraphs FROM words GROUP BY doc_id)
SELECT doc_id::VARCHAR AS title, source AS headers, coalesce(paragraphs, '') AS paragraphs FROM documents LEFT JOIN paragraphs USING (doc_id)""".replace(
        "string_agg(word, CASE WHEN word_no = 1 THEN chr(10) ELSE ' ' END ORDER BY line_no, word_no)", "substr(string_agg(CASE WHEN word_no = 1 THEN chr(10) ELSE ' ' END || word, '' ORDER BY line_no, word_no), 2)"
    )
)
def annotated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in all headings and all paragraphs of the texts."""
    parsed = wikidump.parse_raw(_linked_texts(spark, sf_dir))
    return parsed.select("title", F.array_join(span_texts("text", "headers"), "\n").alias("headers"), F.array_join(span_texts("text", "paragraphs"), "\n").alias("paragraphs"))


def _sql_merged(kind: str, order: str = "line_no, word_no") -> str:
    """The tokens of words, with linked ones marked by the type."""
    return f"string_agg(CASE WHEN linked THEN '<START:' || {kind} || '> ' || {_sql_tokens('word')} || ' <END>' ELSE {_sql_tokens('word')} END, ' ' ORDER BY {order})"


@_query(
    f"""WITH {_WORDS}, merged AS (SELECT doc_id, {_sql_merged("'link'")} AS m FROM words GROUP BY doc_id)
SELECT doc_id::VARCHAR AS title, {_sql_tokens('source')} || coalesce(' ' || m, '') AS merged FROM documents LEFT JOIN merged USING (doc_id)"""
)
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with all their links merged in."""
    parsed = wikidump.parse_raw(_linked_texts(spark, sf_dir))
    kinds = F.transform("links", lambda x: F.lit("link"))
    return parsed.select("title", nlp.merge_annotations("text", nlp.zip_spans("links.begin", "links.end", kinds)).alias("merged"))


def _instances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wikiuri, dburi), redirects and types of the sources as entities."""
    names = _t(spark, sf_dir, "documents").select("source").distinct()
    upper = F.concat(F.upper(F.substr("source", F.lit(1), F.lit(1))), F.substr("source", F.lit(2)))
    links = names.select(text.title_to_uri(upper).alias("wikiuri"), F.col("source").alias("dburi"))
    number = F.substr("source", F.lit(4)).cast("int")
    moved = names.filter(number % 3 == 0).select(F.col("source").alias("source"), F.concat("source", F.lit("_moved")).alias("target"))
    entity = F.when(number % 3 == 0, F.concat("source", F.lit("_moved"))).otherwise(F.col("source"))
    kinds = [F.lit(tsv.ONTOLOGY + k) for k in ("Person", "Place", "Drug", "Nothing")]
    types = names.select(entity.alias("dburi"), F.explode(F.array(F.lit(ner.THING), F.get(F.array(*kinds), number % 4))).alias("type"))
    return links, moved, types


_KINDS = f"(['Person', 'Place', 'Drug', 'Nothing'])[source[4:]::INT % 4 + 1]"


@_query(f"""SELECT DISTINCT {_sql_uri("upper(source[1]) || source[2:]")} AS wikiuri, '{tsv.ONTOLOGY}' || {_KINDS} AS type FROM documents""")
def article_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.article_types(*_instances(spark, sf_dir)).orderBy("wikiuri", "type")


def _sql_annotated(kind: str, condition: str) -> str:
    return f"""WITH {_WORDS} SELECT doc_id::VARCHAR AS title, sentence_no AS "sentenceOrder", {_sql_merged(kind, "word_no")} AS annotated
    FROM words WHERE {condition} GROUP BY doc_id, sentence_no HAVING bool_or(linked)"""


@_query(_sql_annotated(f"map {{'Person': 'person', 'Place': 'location', 'Drug': 'drug'}}[{_KINDS}]", f"{_KINDS} <> 'Nothing'"))
def ner_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.annotated_sentences(_text_sentences(spark, sf_dir), ner.article_types(*_instances(spark, sf_dir)), tsv.type_names(spark))


@_query(_sql_annotated("'place'", f"{_KINDS} = 'Place'"))
def ner_corpus_of_one_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.annotated_with(_text_sentences(spark, sf_dir), ner.article_types(*_instances(spark, sf_dir)), tsv.ONTOLOGY + "Place", "place")


@_query(
    f"""WITH {_WORDS}, said AS (SELECT DISTINCT "linkTarget", doc_id::VARCHAR AS title, "sentenceOrder", sentence FROM links)
SELECT "linkTarget" AS id, string_agg(sentence, ' ' ORDER BY title, "sentenceOrder") AS text FROM said GROUP BY "linkTarget\""""
)
def entity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ner.entity_contexts(_text_sentences(spark, sf_dir))


@_query(f"SELECT c_custkey, n_name, label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two'), (3, 'three'), (4, 'four')) v(k, label) ON n_regionkey = k")
def typed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join to a small mapping that is sent to all tasks."""
    labels = spark.createDataFrame(list(enumerate("zero one two three four".split())), "k int, label string")
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_regionkey", "k")
    return relational.replicated_join(rows, labels, "k").select("c_custkey", "n_name", "label")


@_query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides sorted by the key and merged."""
    orders, customers = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    return relational.merge_join(orders, customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", "c_name")


# --- similarity -----------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in similarity.STOP_WORDS)
_SIMILAR = f"""
words AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda w: w NOT IN ({_STOPS}))) AS term FROM documents),
postings AS (
  SELECT id, term, sqrt(count(*)) AS tf, 1 / sqrt(any_value(n)) AS norm FROM (SELECT id, term, count(*) OVER (PARTITION BY id) AS n FROM words) GROUP BY id, term
),
weights AS (SELECT term, 1 + ln((SELECT count(DISTINCT id) FROM postings) / (count(*) + 1)) AS idf FROM postings GROUP BY term)
"""


@_query(
    f"""WITH {_SIMILAR},
terms AS (SELECT qid, term, count(*) AS tf FROM (SELECT item_id AS qid, unnest(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda w: w NOT IN ({_STOPS}))) AS term FROM benchmark) GROUP BY qid, term),
best AS (SELECT qid, term, idf FROM terms JOIN weights USING (term) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(terms.tf * idf, 9) DESC, term) <= 30),
scored AS (SELECT qid, id, round(sum(tf * idf * idf * norm), 4) AS score FROM best JOIN postings USING (term) GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5"""
)
def similar_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items put to the five documents most like each."""
    return similarity.categorize(_t(spark, sf_dir, "benchmark"), "item_id", similarity.index(_t(spark, sf_dir, "documents"), "doc_id"))


@_query(
    f"""WITH {_SIMILAR},
cut AS (SELECT item_id AS qid, string_split_regex(trim(text, ' '), '\\s+') AS w FROM benchmark),
drawn AS (SELECT qid, floor(len(w) * 2 / 3) AS size, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM cut),
bags AS (SELECT *, unnest(range(0, 5)) AS bag FROM drawn),
sample AS (SELECT * FROM bags QUALIFY row_number() OVER (PARTITION BY qid, bag ORDER BY md5('42|' || bag || '|' || pos), pos) <= size),
terms AS (SELECT qid, bag, term, count(*) AS tf FROM (SELECT qid, bag, unnest(list_filter(regexp_extract_all(lower(word), '[\\pL\\pN]+'), lambda w: w NOT IN ({_STOPS}))) AS term FROM sample) GROUP BY ALL),
best AS (SELECT qid, bag, term, idf FROM terms JOIN weights USING (term) QUALIFY row_number() OVER (PARTITION BY qid, bag ORDER BY round(terms.tf * idf, 9) DESC, term) <= 30),
scored AS (SELECT qid, bag, id, round(sum(tf * idf * idf * norm), 4) AS score FROM best JOIN postings USING (term) GROUP BY ALL),
asked AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid, bag ORDER BY score DESC, id) <= 10),
votes AS (SELECT qid, id, count(*) AS votes FROM asked GROUP BY qid, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, id)::INT AS rank FROM votes)
SELECT * FROM ranked WHERE rank <= 5 AND votes > 3"""
)
def bagged_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.bagging_categorize(_t(spark, sf_dir, "benchmark"), "item_id", similarity.index(_t(spark, sf_dir, "documents"), "doc_id"))


@_query(
    f"""WITH {_SIMILAR},
terms AS (SELECT qid, term, count(*) AS tf FROM (SELECT item_id AS qid, unnest(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda w: w NOT IN ({_STOPS}))) AS term FROM benchmark) GROUP BY qid, term)
SELECT qid, term, round(tf * idf, 4) AS weight FROM terms JOIN weights USING (term) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(tf * idf, 9) DESC, term) <= 30"""
)
def interesting_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms by which benchmark items are looked up."""
    items = _t(spark, sf_dir, "benchmark")
    weights = similarity.term_weights(similarity.index(_t(spark, sf_dir, "documents"), "doc_id"), terms=similarity.query_terms(items, "item_id"))
    terms = similarity.interesting_terms(items, "item_id", weights)
    return terms.select("qid", "term", F.round("weight", 4).alias("weight"))


@_query("SELECT n_name, replace(array_to_string(list_sort([n_name, r_name || ' / ' || n_name]), '|'), '_', ' ') AS paths FROM nation JOIN region ON n_regionkey = r_regionkey")
def readable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of topics as labels, each once."""
    names = [F.replace(_category(c), F.lit(" "), F.lit("_")) for c in ("r_name", "n_name")]
    whole = F.concat(names[0], F.lit("/"), names[1])
    paths = F.concat_ws(" ", whole, F.concat(F.lit("/"), names[1], F.lit("/")), F.lit(""), whole)
    return _nations(spark, sf_dir).select("n_name", F.array_join(similarity.readable_paths(paths), "|").alias("paths"))
