"""N-Triples with one predicate as relations of two or three columns.

Reading and writing are Column expressions over the text source, which splits
plain and bzip2 files and unpacks gzip by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let

def _inner(token: Column) -> Column:
    """Without the first and the last character."""
    return F.substr(token, F.lit(2), F.length(token) - 2)


def _without(value: Column, namespace: str | None) -> Column:
    if not namespace:
        return value
    return F.when(F.startswith(value, F.lit(namespace)), F.substr(value, F.lit(len(namespace) + 1))).otherwise(value)


def _is_uri(token: Column) -> Column:
    return F.startswith(token, F.lit("<")) & F.endswith(token, F.lit(">")) & (F.length(token) > 2)


def parse_uri_uri(lines: DataFrame, property_uri: str | None = None, subject_ns: str | None = None, object_ns: str | None = None, strict: bool = False) -> DataFrame:
    """(subject, object) of the lines (column `value`) that have four tokens.

    The last is taken for the dot and brackets are cut off unseen, unless
    `strict` asks for `<...>` thrice and a dot. Lines that do not fit give no
    row. Namespaces are cut only from what starts with them.
    """
    # tokens after the last that is not empty do not count
    rows = lines.select(F.split(F.regexp_replace("value", " +$", ""), " ", -1).alias("t")).filter(F.size("t") == 4)
    t = [F.col("t")[k] for k in range(4)]
    if property_uri is not None:
        rows = rows.filter(_inner(t[1]) == property_uri)
    if strict:
        rows = rows.filter(_is_uri(t[0]) & _is_uri(t[1]) & _is_uri(t[2]) & (t[3] == "."))
    return rows.select(_without(_inner(t[0]), subject_ns).alias("subject"), _without(_inner(t[2]), object_ns).alias("object"))


def parse_literal(token: Column, keep_plain: bool = False, wide: bool = False) -> tuple[Column, Column, Column]:
    """(whether it is one, text, lang) of a literal such as "a\\"b"@en.

    lang is '' for typed literals. Plain literals (no tag, no type) are none
    unless kept. Known escapes are \\n \\r \\t \\\\ \\" and \\uXXXX (not 0000);
    with `wide` also \\UXXXXXXXX. With any other escape it is none. The text is
    right only where it is one.
    """
    # no regular expression runs over a whole literal: alternatives under a
    # star take a stack frame a character
    masked = F.replace(F.replace(token, F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))
    end = F.position(F.lit('"'), masked, F.lit(2))
    cut = let(end, lambda e: F.struct(F.substr(token, F.lit(2), e - 2).alias("body"), F.substr(token, e + 1).alias("rest"), e.alias("end")))
    body, rest, end = cut["body"], cut["rest"], cut["end"]
    if wide:
        body = _narrow(body)
    text = F.from_json(F.concat(F.lit('["'), body, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})[0]
    single = F.replace(body, F.lit("\\\\"), F.lit(""))
    ok = F.startswith(token, F.lit('"')) & (end > 1) & ~F.rlike(single, F.lit(r'\\(?![nrt"]|u[0-9A-Fa-f]{4})|\\u0000'))
    if not keep_plain:
        ok = ok & (rest != "")
    return ok, text, F.regexp_extract(rest, r"^[@-]([^\s.^]*)", 1)


def _narrow(body: Column) -> Column:
    """\\UXXXXXXXX as one or two \\uXXXX; an escaped backslash before the U
    begins no such escape."""
    wide = r"\\(?:\\|U[0-9A-Fa-f]{8})"

    def pair(p: Column) -> Column:
        code = F.conv(F.substr(p, F.lit(3), F.lit(8)), 16, 10).cast("int")
        low = code - 0x10000
        unit = lambda c: F.concat(F.lit("\\u"), F.lpad(F.hex(c), 4, "0"))
        two = F.concat(unit(F.lit(0xD800) + F.shiftright(low, 10)), unit(F.lit(0xDC00) + low.bitwiseAND(F.lit(0x3FF))))
        return F.when(F.length(p) == 2, p).when(code > 0xFFFF, two).otherwise(unit(code))

    hits = F.transform(F.regexp_extract_all(body, F.lit(wide), F.lit(0)), pair)
    parts = F.arrays_zip(F.split(body, wide, -1).alias("b"), hits.alias("p"))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["b"], F.coalesce(x["p"], F.lit("")))), "")


def parse_uri_literal(lines: DataFrame, property_uri: str | None = None, subject_ns: str | None = None, keep_plain: bool = False, wide: bool = False) -> DataFrame:
    """(subject, object, lang) of the lines `<s> <p> literal .`, text unescaped."""
    t = F.split("value", " ", 3)
    rows = lines.select(t.alias("t")).filter((F.size("t") == 3) & F.endswith(F.col("t")[2], F.lit(" .")))
    if property_uri is not None:
        rows = rows.filter(_inner(F.col("t")[1]) == property_uri)
    token = F.col("t")[2]
    # the filter has the cheap test only; text is made once, of the rows that pass
    ok, text, lang = parse_literal(F.substr(token, F.lit(1), F.length(token) - 2), keep_plain, wide)
    return rows.filter(ok).select(_without(_inner(F.col("t")[0]), subject_ns).alias("subject"), text.alias("object"), lang.alias("lang"))


def read_uri_uri(spark: SparkSession, path: str, property_uri: str | None = None, subject_ns: str | None = None, object_ns: str | None = None, strict: bool = False) -> DataFrame:
    return parse_uri_uri(spark.read.text(path), property_uri, subject_ns, object_ns, strict)


def read_uri_literal(spark: SparkSession, path: str, property_uri: str | None = None, subject_ns: str | None = None, keep_plain: bool = False, wide: bool = False) -> DataFrame:
    return parse_uri_literal(spark.read.text(path), property_uri, subject_ns, keep_plain, wide)


def escape_ascii(c: Column, uri: bool = False) -> Column:
    """Plain ASCII: short escapes for tab, newline, return, quote and backslash,
    \\uXXXX in capitals for other controls, DEL and all beyond (two for a
    character beyond the first plane); in URIs for angle brackets too."""
    raw = F.to_json(F.array(c), {"writeNonAsciiCharacterAsCodePoint": "true"})
    out = let(raw, lambda v: F.substr(v, F.lit(3), F.length(v) - 4))
    # JSON has two more short escapes (an even number of backslashes before) and leaves DEL
    for short, code in (("b", "0008"), ("f", "000C")):
        pattern, new = rf"((?:^|[^\\])(?:\\\\)*)\\{short}", rf"$1\\u{code}"
        twice = lambda v, p=pattern, n=new: F.regexp_replace(F.regexp_replace(v, p, n), p, n)
        out = let(out, lambda v, s=short, f=twice: F.when(F.contains(v, F.lit(f"\\{s}")), f(v)).otherwise(v))
    out = F.replace(out, F.lit("\x7f"), F.lit("\\u007F"))
    if uri:
        out = F.replace(F.replace(out, F.lit("<"), F.lit("\\u003C")), F.lit(">"), F.lit("\\u003E"))
    return F.when(c.isNotNull(), out)


def format_uri_uri(df: DataFrame, property_uri: str, subject_ns: str = "", object_ns: str = "") -> DataFrame:
    """Lines `<s> <p> <o> .` of the first two columns; rows with a null give none."""
    s, o = _two(df, 2)
    line = F.concat(F.lit("<"), escape_ascii(F.concat(F.lit(subject_ns), s), True), F.lit(f"> <{property_uri}> <"), escape_ascii(F.concat(F.lit(object_ns), o), True), F.lit("> ."))
    return df.select(line.alias("value")).filter("value is not null")


def format_uri_literal(df: DataFrame, property_uri: str, subject_ns: str = "", lang: str | None = None) -> DataFrame:
    """Lines `<s> <p> "o"@lang .` of the first two columns; the tag is optional."""
    s, o = _two(df, 2)
    end = F.lit(f'"@{lang} .' if lang else '" .')
    line = F.concat(F.lit("<"), escape_ascii(F.concat(F.lit(subject_ns), s), True), F.lit(f'> <{property_uri}> "'), escape_ascii(o), end)
    return df.select(line.alias("value")).filter("value is not null")


def _two(df: DataFrame, n: int) -> list[Column]:
    if len(df.columns) != n:
        raise ValueError(f"{n} columns are needed, there are {len(df.columns)}")
    return [df[c].cast("string") for c in df.columns]


def compression_of(path: str, compression: str | None = None) -> str:
    """The codec asked for, else that of the path's suffix, else none."""
    if compression is not None:
        if compression not in ("none", "uncompressed", "bzip2", "deflate", "gzip", "lz4", "snappy"):
            raise ValueError(f"unknown compression {compression}")
        return compression
    return "bzip2" if path.endswith((".bz2", ".bz")) else "gzip" if path.endswith(".gz") else "none"


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> None:
    lines.write.option("compression", compression_of(path, compression)).text(path)


def write_uri_uri(df: DataFrame, path: str, property_uri: str, subject_ns: str = "", object_ns: str = "", compression: str | None = None) -> None:
    write_lines(format_uri_uri(df, property_uri, subject_ns, object_ns), path, compression)


def write_uri_literal(df: DataFrame, path: str, property_uri: str, subject_ns: str = "", lang: str | None = None, compression: str | None = None) -> None:
    write_lines(format_uri_literal(df, property_uri, subject_ns, lang), path, compression)
