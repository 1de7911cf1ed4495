"""Tokens, sentences, and annotated text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .. import schemas
from .pieces import PIECE_BYTES, field_lists, pieces

#: Runs of letters, of digits, or of one other sign.
_TOKEN = regex.compile(r"\p{L}+|\p{Nd}+|([^\s\p{L}\p{Nd}])\1*")
TOKEN_RE = r"\p{L}+|\p{Nd}+|([^\s\p{L}\p{Nd}])\1*"
TYPED_SPANS = "array<struct<begin:int,end:int,type:string>>"

_STOP = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s+[\"'“‘«(\[]*(?:[^\W_]))")
_SHORT = {
    "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc", "inc", "ltd", "co", "corp", "no", "vol", "fig", "pp", "ca", "cf", "al", "e.g", "i.e",
    "u.s", "gen", "col", "sgt", "capt", "lt", "rev", "hon", "approx", "dept", "est", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
}


def tokens(text: Column | str) -> Column:
    """The tokens of a text, in the JVM."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN_RE), F.lit(0))


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Spans without white space at their ends. A sentence ends after stops and
    closing quotes before white space and a capital, digit or other letter
    without case; not after known abbreviations or a single capital."""
    if not text:
        return []
    out, start = [], 0

    def add(a: int, b: int) -> None:
        part = text[a:b]
        a += len(part) - len(part.lstrip())
        b -= len(part) - len(part.rstrip())
        if a < b:
            out.append((a, b))

    for m in _STOP.finditer(text):
        after = re.compile(r"\s+[\"'“‘«(\[]*").match(text, m.end()).end()
        if text[after : after + 1].islower():
            continue
        if m.group()[0] == "." and len(m.group().rstrip("\"'”’»)]")) == 1:
            word = re.search(r"[\w.]*$", text[max(0, m.start() - 40) : m.start()]).group()
            if word.lower() in _SHORT or (len(word) == 1 and word.isupper()) or re.fullmatch(r"(?:[A-Z]\.)+[A-Z]", word):
                continue
        add(start, m.end())
        start = m.end()
    add(start, len(text))
    return out


def sentences_with_links(df, text: str = "text", links: str = "links", paragraphs: str = "paragraphs"):
    """Each link with the sentence that holds it whole, for all rows of df.

    Adds sentenceOrder, sentence, linkTarget, linkBegin, linkEnd (see
    schemas.SENTENCE_LINKS) and drops the three inputs. Sentences are numbered
    from 1 over all paragraphs of a row, those without links too; offsets are
    relative to the sentence, in which tabs and newlines became spaces.

    Texts are cut and matched in one pass, which no filter is pushed through:
    nothing is computed twice.
    """
    rest = [c for c in df.columns if c not in (text, links, paragraphs)]
    taken = df.select(*rest, text, links, paragraphs)
    schema = StructType([*taken.schema.fields[: len(rest)], *schemas.SENTENCE_LINKS.fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts, found, parts = batch.columns

            def rows(at: list[int], made: list[tuple], kept=kept) -> pa.RecordBatch:
                columns = zip(*made, strict=True) if made else [()] * len(_LINK_TYPES)
                new = [pa.array(c, t) for c, t in zip(columns, _LINK_TYPES, strict=True)]
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in kept), *new], names=names)

            for start, stop in pieces(texts):
                at, made, size = [], [], 0
                piece = zip(texts.slice(start, stop - start).to_pylist(), field_lists(found.slice(start, stop - start), "begin", "end", "target"), field_lists(parts.slice(start, stop - start), "begin", "end"), strict=True)
                for k, one in enumerate(piece, start):
                    for row in linked_sentences(*one):
                        at.append(k)
                        made.append(row)
                        size += len(row[1])
                        if size > PIECE_BYTES:  # a sentence has a copy for each of its links
                            yield rows(at, made)
                            at, made, size = [], [], 0
                yield rows(at, made)

    return taken.mapInArrow(run, schema)


_LINK_TYPES = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]


def linked_sentences(text: str | None, links: list[tuple], paragraphs: list[tuple]) -> Iterator[tuple[int, str, str | None, int, int]]:
    """(sentenceOrder, sentence, linkTarget, linkBegin, linkEnd) of one text;
    links are (begin, end, target), paragraphs (begin, end)."""
    if text is None:
        return
    links = sorted((x for x in links if x[0] is not None and x[1] is not None), key=lambda x: (x[0], -x[1], x[2] or ""))
    begins = [x[0] for x in links]
    spans = ((p + a, p + b) for p, q in paragraphs if p is not None and q is not None for a, b in sentence_spans(text[p:q]))
    for n, (begin, end) in enumerate(spans, 1):
        k, sentence = bisect_left(begins, begin), None
        while k < len(links) and begins[k] <= end:
            _, stop, target = links[k]
            if stop <= end:
                if sentence is None:
                    sentence = text[begin:end].replace("\n", " ").replace("\t", " ")
                yield n, sentence, target, begins[k] - begin, stop - begin
            k += 1


def merge_spans(text: str, spans: list[tuple[int, int, str | None]], skip_unmatched: bool = False) -> str:
    """Tokens with spaces between; runs within a span as <START:type> ... <END>.

    Spans go by begin, longer first. One that holds no whole token after what
    the spans before it took makes this and all later ones vanish, unless
    skip_unmatched lets later ones stand.
    """
    words = token_spans(text)
    out: list[str] = []
    at = 0
    for begin, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        first = next((k for k in range(at, len(words)) if words[k][0] >= begin and words[k][1] <= end), None)
        if first is None:
            if skip_unmatched:
                continue
            break
        out += [text[a:b] for a, b in words[at:first]]
        out.append("<START>" if kind is None else f"<START:{kind}>")
        at = first
        while at < len(words) and words[at][0] >= begin and words[at][1] <= end:
            out.append(text[words[at][0] : words[at][1]])
            at += 1
        out.append("<END>")
    out += [text[a:b] for a, b in words[at:]]
    return " ".join(out)


def merge_annotations(text: Column | str, spans: Column | str, default_type: str | None = None, skip_unmatched: bool = False) -> Column:
    """merge_spans() of a text and an array of struct(begin, end[, type]).

    Spans with a null begin or end count as none; a null text gives null. Spans
    without a type field have the default type.
    """
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))

    @F.arrow_udf(StringType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            typed = found.type.value_type.get_field_index("type") >= 0
            for start, stop in pieces(texts):
                of = field_lists(found.slice(start, stop - start), "begin", "end", "type")
                rows = zip(texts.slice(start, stop - start).to_pylist(), of, strict=True)
                yield pa.array([None if t is None else one(t, s, typed) for t, s in rows], pa.string())
            if not len(texts):
                yield pa.array([], pa.string())

    def one(text: str, found: list[tuple], typed: bool) -> str:
        return merge_spans(text, [(a, b, kind if typed else default_type) for a, b, kind in found if a is not None and b is not None], skip_unmatched)

    return run(text, spans)


def zip_spans(begin: Column | str, end: Column | str, kind: Column | str | None = None) -> Column:
    """Arrays (or single values) of begins, ends and types as spans, as many as
    the shorter of begins and ends has; a single type holds for all."""

    def many(c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return c

    begin, end = many(begin), many(end)
    n = F.least(F.size(begin), F.size(end))
    pairs = F.arrays_zip(F.slice(begin, F.lit(1), n).alias("begin"), F.slice(end, F.lit(1), n).alias("end"))
    if kind is None:
        return pairs
    kinds = many(kind)
    return F.transform(pairs, lambda p, i: F.struct(p["begin"].alias("begin"), p["end"].alias("end"), F.get(kinds, i).alias("type")))
