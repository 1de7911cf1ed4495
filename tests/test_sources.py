import bz2
import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge import schemas
from corpusforge.sources import html, ntriples, tsv, wikidump
from corpusforge.streaming import ingest

NS = "http://r.example/"
P = "http://p.example/p"
URIS = [
    f"<{NS}a> <{P}> <{NS}b> .",
    f"<{NS}a> <{P}> <http://other/c> .",
    f"<{NS}a> <{P}2> <{NS}b> .",
    f'<{NS}a> <{P}> "foo"@en .',
    "# a comment",
    f"<{NS}a> <{P}> <{NS}b> . trailing",
    "",
]


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_uri_uri(spark):
    got = rows(ntriples.parse_uri_uri(lines(spark, URIS), P, NS, NS))
    assert got == [("a", "b"), ("a", "http://other/c"), ("a", 'foo"@e')]
    assert rows(ntriples.parse_uri_uri(lines(spark, URIS), P, NS, NS, strict=True)) == got[:2]
    assert len(rows(ntriples.parse_uri_uri(lines(spark, URIS)))) == 4
    assert ntriples.parse_uri_uri(lines(spark, URIS)).schema == schemas.URI_URI


def test_uri_literal(spark):
    cases = {
        '"foo"@en': ("foo", "en"),
        '"foo"-en': ("foo", "en"),
        '"5"^^<http://int>': ("5", ""),
        '"foo"': None,
        '""': None,
        '""@en': ("", "en"),
        r'"a\"b\\c\n\t\ré"@fr-ca': ('a"b\\c\n\t\ré', "fr-ca"),
        r'"x\\"@en': ("x\\", "en"),
        r'"\b"@en': None,
        r'"\u00g0"@en': None,
        r'"\u0000"@en': None,
        r'"\\u0000"@en': ("\\u0000", "en"),
        r'"\U0001F600"@en': None,
        '"open@en': None,
        "foo@en": None,
        '"a" b "c"@en': ("a", ""),
        '"' + 'long \\" text ' * 20_000 + '"@en': ('long " text ' * 20_000, "en"),
    }
    for token, want in cases.items():
        got = rows(ntriples.parse_uri_literal(lines(spark, [f"<{NS}s> <{P}> {token} ."]), P, NS))
        assert got == ([("s", *want)] if want else []), token[:40]
    plain = lines(spark, [f'<s> <{P}> "foo" .', rf'<s> <{P}> "\U0001F600 \\U0001F600 \U000000e9"@en .', f'<s> <{P}> "x"@en'])
    assert rows(ntriples.parse_uri_literal(plain, P, keep_plain=True, wide=True)) == [("s", "foo", ""), ("s", "😀 \\U0001F600 é", "en")]
    assert ntriples.parse_uri_literal(plain).schema == schemas.URI_LITERAL


def escaped(s, uri=False):
    out = ""
    for u in s.encode("utf-16-be").hex(" ", 2).split():
        c = chr(int(u, 16))
        short = {"\t": "\\t", "\n": "\\n", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
        if c in short:
            out += short[c]
        elif c < " " or c >= "\x7f" or (uri and c in "<>"):
            out += f"\\u{ord(c):04X}"
        else:
            out += c
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab\\\"\b\f\t\n\r\x00\x01\x1f\x7f\x80é漢😀<>/u0"), max_size=12), min_size=1, max_size=30))
def test_escape_and_back(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = df.select(ntriples.escape_ascii(F.col("x")), ntriples.escape_ascii(F.col("x"), True)).collect()
    assert [tuple(r) for r in got] == [(escaped(v), escaped(v, True)) for v in values]
    safe = [v for v in values if "\x00" not in v]
    out = ntriples.format_uri_literal(spark.createDataFrame([("s", v) for v in safe], "s string, o string"), P, NS, "en")
    assert [r[1] for r in rows(ntriples.parse_uri_literal(out, P, NS))] == safe


def test_write_triples(spark, tmp_path):
    df = spark.createDataFrame([("a", "b"), ("a", "cé"), ("d", "a"), ("cé", "d"), ("x", None)], "s string, o string").coalesce(1)
    for suffix, opened in (("", open), (".gz", gzip.open), (".bz2", bz2.open)):
        path = str(tmp_path / f"uris{suffix}")
        ntriples.write_uri_uri(df, path, f"{NS}knows")
        part = next(p for p in (tmp_path / f"uris{suffix}").iterdir() if p.name.startswith("part"))
        with opened(part, "rt") as f:
            assert f.read().splitlines()[1::2] == [f"<a> <{NS}knows> <c\\u00E9> .", f"<c\\u00E9> <{NS}knows> <d> ."]
        assert rows(ntriples.read_uri_uri(spark, path, f"{NS}knows"))[0] == ("a", "b")
    ntriples.write_uri_literal(df, str(tmp_path / "lit"), f"{NS}v", "", "en")
    assert rows(spark.read.text(str(tmp_path / "lit")))[1] == (f'<a> <{NS}v> "c\\u00E9"@en .',)
    ntriples.write_uri_literal(df, str(tmp_path / "plain"), f"{NS}v")
    assert rows(spark.read.text(str(tmp_path / "plain")))[0] == (f'<a> <{NS}v> "b" .',)
    with pytest.raises(ValueError, match="columns"):
        ntriples.format_uri_uri(df.select("s"), P)
    with pytest.raises(ValueError, match="compression"):
        ntriples.write_uri_uri(df, str(tmp_path / "z"), P, compression="zip")


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ('q"x', None, "")], "s string, n long, t string")
    tsv.write_tsv(df, str(tmp_path / "t"))
    assert sorted(rows(tsv.read_tsv(spark, str(tmp_path / "t"), "s string, n long, t string"))) == [("a", 1, None), ('q"x', None, None)]
    assert tsv.type_names(spark).count() == 8
    (tmp_path / "names.tsv").write_text("http://x/A\talpha\n")
    assert rows(tsv.type_names(spark, str(tmp_path / "names.tsv"))) == [("http://x/A", "alpha")]
    seen = []
    tsv.write_all(df, one=lambda d: seen.append(d.count()), two=lambda d: seen.append(len(d.columns)))
    assert seen == [2, 3]


PAGES = [
    ("First &amp; page", '<text xml:space="preserve">Hello [[world]] &lt;ref&gt;x&lt;/ref&gt;.\n\nMore &amp;amp; text</text>'),
    ("Empty", '<text xml:space="preserve" />'),
    ("Moved", '<text xml:space="preserve">#REDIRECT [[First &amp; page]]</text>'),
    ("Odd", '<text bytes="5" xml:space="preserve">odd é 😀 [[link]]</text>'),
    ("None", "<text/>"),
]


def dump(path, pages=PAGES, opened=open):
    body = "".join(f"  <page>\n    <title>{t}</title>\n    <revision>\n      {x}\n    </revision>\n  </page>\n" for t, x in pages)
    with opened(path, "wt", encoding="utf-8") as f:
        f.write(f'<mediawiki xmlns="http://x">\n<siteinfo><sitename>S</sitename></siteinfo>\n{body}</mediawiki>\n')


def test_raw_pages(spark, tmp_path):
    for name, opened in (("d.xml", open), ("d.xml.bz2", bz2.open)):
        dump(tmp_path / name, opened=opened)
        got = rows(wikidump.read_wiki_raw(spark, str(tmp_path / name)))
        assert [g[0] for g in got] == ["First & page", "Empty", "Moved", "Odd", "None"]
        assert got[0][2] == "Hello [[world]] <ref>x</ref>.\n\nMore &amp; text" and got[1][2] == "" == got[4][2]
        assert got[0][1] == "http://en.wikipedia.org/wiki/First_%26_page"
    assert rows(wikidump.read_wiki_raw(spark, str(tmp_path / "d.xml"), "fr"))[1][1] == "http://fr.wikipedia.org/wiki/Empty"
    assert rows(wikidump.read_wiki_raw(spark, str(tmp_path / "d.xml"), ""))[1][1] == "http://en.wikipedia.org/wiki/Empty"


def test_split_reading_loses_no_page(spark, tmp_path):
    pages = [(f"T{i}", f'<text xml:space="preserve">{"x" * (i * 37 % 900)} end {i}</text>') for i in range(800)]
    dump(tmp_path / "many.xml", pages)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = wikidump.read_wiki_raw(spark, str(tmp_path / "many.xml"))
        assert df.rdd.getNumPartitions() > 5
        assert sorted((r["title"], r["markup"]) for r in df.collect()) == sorted((f"T{i}", f"{'x' * (i * 37 % 900)} end {i}") for i in range(800))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parsed_pages(spark, tmp_path):
    dump(tmp_path / "d.xml")
    df = wikidump.read_wiki_parsed(spark, str(tmp_path / "d.xml"))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.PARSED_PAGES]
    got = {r["title"]: r for r in df.collect()}
    assert got["First & page"]["text"] == "Hello world .\nMore & text\n"
    assert [tuple(x) for x in got["First & page"]["links"]] == [("http://en.wikipedia.org/wiki/World", 6, 11)]
    assert got["Moved"]["redirect"] == got["First & page"]["uri"] and got["Moved"]["text"] == ""
    (link,) = got["Odd"]["links"]
    assert got["Odd"]["text"][link["begin"] : link["end"]] == "link"
    wide = {r["title"]: r for r in wikidump.read_wiki_parsed(spark, str(tmp_path / "d.xml"), offset_unit="utf16").collect()}
    assert wide["Odd"]["links"][0]["begin"] == link["begin"] + 1
    assert "Python" not in df.filter("redirect is not null").select("uri", "redirect")._jdf.queryExecution().executedPlan().toString()


def test_html_text(spark):
    page = "<html><script>var p='<p>no</p>';</script><h2>B &amp; c</h2><P class='x'>One <b>two</b>&nbsp;x</P><!-- <p>no</p> --><h1>A</h1><pre>no</pre><p>Three</p></html>"
    got = spark.createDataFrame([(page,), (None,), ("",)], "html string").select(html.html_text("html")).collect()
    assert [r[0] for r in got] == ["A\n\nB & c\n\nOne two\xa0x\n\nThree", None, ""]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("\n".join(URIS))
    (tmp_path / "in" / "b.nt").write_text(f"<{NS}z> <{P}> <{NS}b> .\n")
    counts = ingest.running_counts(ingest.stream_uri_uri(spark, str(tmp_path / "in"), P, NS, NS, strict=True))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["object"]: r["n"] for r in spark.table("counts").collect()} == {"b": 2, "http://other/c": 1}
    lit = ingest.stream_uri_literal(spark, str(tmp_path / "in"), P)
    assert lit.isStreaming and json.loads(lit.schema.json())["fields"][2]["name"] == "lang"
