"""Wiki markup as plain text with the places of links, headings and paragraphs.

A scanner over the text, run in an Arrow UDF over pieces of bounded size. Lists, tables,
templates, references, magic words and links into other namespaces leave
nothing; captions of images, labels of links and the insides of other tags stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import quote_plus

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from .pieces import pieces, struct_lists

MAX_DEPTH = 256
PARSED = StructType([StructField("text", StringType()), *[f for f in schemas.PARSED_PAGES.fields if f.name in ("links", "headers", "paragraphs")]])

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_NOWIKI_END = re.compile(r"</nowiki\s*>", re.I)
_NOWIKI_EMPTY = re.compile(r"<(?P<none>)nowiki\s*/>", re.I)
_NOWIKI = re.compile(r"<nowiki\s*>(.*?)</nowiki\s*>|<nowiki\s*/>", re.S | re.I)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?(?:</ref\s*>|\Z)", re.S | re.I)
_GONE = re.compile(r"<(gallery|timeline|references|imagemap)\b[^<>]*?(?:/>|>.*?(?:</\1\s*>|\Z))", re.S | re.I)
_MAGIC = re.compile(r"__[A-Z]{3,}__")
_PAIR = re.compile(r"\{\{|\}\}")
_TABLE = re.compile(r"^[ \t:]*\{\||^[ \t]*\|\}", re.M)
_IMAGE = re.compile(r"\s*(?:file|image|fichier|datei|archivo|bild|imagen|immagine)\s*:", re.I)
_IMAGE_OPTION = re.compile(
    r"\s*(?:thumb|thumbnail|frame|framed|frameless|border|left|right|center|centre|none|upright(?:=.*)?|baseline|middle|sub|super|top|bottom|\d+(?:x\d+)?\s*px|x\d+\s*px|(?:alt|link|page|lang|class)=.*|vignette|miniatur|gauche|droite|links|rechts)\s*$",
    re.I | re.S,
)
_OTHER_WIKI = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*[\"']?http://[\w-]+\.wikipedia\.org/wiki/[^<>]*>.*?(?:</a\s*>|\Z)", re.S | re.I)
_INTERWIKI = re.compile(r"^http://[\w-]+\.wikipedia\.org/wiki/.*")
_EXTERNAL = re.compile(r"\[((?:https?|ftp)://[^\s\]]+)(?:\s+([^\]]*))?\]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_TRAIL = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\[\[|\]\]|\[(?:https?|ftp)://|''+|</?[A-Za-z][^<>]*>|&#?\w+;")
_BRACKETS = re.compile(r"\[\[|\]\]")
_BARS = re.compile(r"\[\[|\|")
#: Stands around the number of a piece that is kept as it is; no XML text has it.
_MARK = "\0"
_KEPT = f"{_MARK}%d{_MARK}"
_KEEP = re.compile(f"{_MARK}(\\d+){_MARK}")


class Parsed(NamedTuple):
    text: str
    links: list[tuple[str, int, int]]
    headers: list[tuple[str, int, int]]
    paragraphs: list[tuple[str, int, int]]


@lru_cache(maxsize=65_536)
def uri_of(title: str, lang: str) -> str:
    """The same address as functions.text.title_to_uri gives in the JVM."""
    return f"http://{lang}.wikipedia.org/wiki/" + quote_plus(title.replace(" ", "_"), safe="*").replace("~", "%7E")


def _without_nested(text: str, opening: str, token: re.Pattern) -> str:
    """text without what stands between balanced marks; unclosed ones stay."""
    stack: list[int] = []
    spans: list[tuple[int, int]] = []  # balanced ones that lie in no other
    for m in token.finditer(text):
        if m.group().strip(" \t:") == opening:
            stack.append(m.start())
        elif stack:
            start = stack.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.end()))
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:a])
        last = b
    out.append(text[last:])
    return "".join(out)


def _closings(text: str) -> dict[int, int]:
    """For each `[[` that is closed, where it ends: the place of its `]]`."""
    found: dict[int, int] = {}
    stack: list[int] = []
    if "[[" in text:
        for m in _BRACKETS.finditer(text):
            if m.group() == "[[":
                stack.append(m.end())
            elif stack:
                found[stack.pop()] = m.start()
    return found


def _heading(line: str) -> tuple[int, str] | None:
    """(level, content) of a line between as many equal signs on either side."""
    line = line.rstrip()
    level = min(6, len(line) - len(line.lstrip("=")), len(line) - len(line.rstrip("=")), (len(line) - 1) // 2)
    return (level, line[level:-level].strip() or " ") if level > 0 else None


def _kept_out(text: str, keep: Callable[[re.Match], str]) -> str:
    """text with its nowiki pieces as `keep` gives them."""
    ends = list(_NOWIKI_END.finditer(text))
    cut = ends[-1].end() if ends else 0  # behind the last end tag there is no piece
    return _NOWIKI.sub(keep, text[:cut]) + _NOWIKI_EMPTY.sub(keep, text[cut:])


class _Scanner:
    def __init__(self, lang: str, kept: list[str]) -> None:
        self.lang, self.kept = lang, kept
        self.out: list[str] = []
        self.at = 0
        self.links: list[tuple[str, int, int]] = []

    def plain(self, text: str) -> str:
        """text with the kept pieces put back."""
        return _KEEP.sub(lambda m: self.kept[int(m.group(1))], text) if _MARK in text else text

    def put(self, text: str) -> None:
        text = self.plain(text)
        if text:
            self.out.append(text)
            self.at += len(text)

    def inline(self, text: str, depth: int = 0) -> None:
        if "[" in text or "&" in text or "<" in text or "''" in text or "]" in text:
            self._part(text, 0, len(text), _closings(text), depth)
        else:
            self.put(text)

    def _part(self, text: str, i: int, stop: int, closings: dict[int, int], depth: int) -> None:
        """text[i:stop], in which brackets are matched as `closings` says."""
        if depth > MAX_DEPTH:
            self.put("Error - nesting is too deep")
            return
        search = _TOKEN.search
        bracket = i - 1  # the next closing one, or `stop` where there is none
        while True:
            m = search(text, i, stop)
            if not m:
                self.put(text[i:stop])
                return
            self.put(text[i : m.start()])
            t, i = m.group(), m.end()
            if t == "[[":
                end = closings.get(i)
                if end is None or end + 2 > stop:
                    self.put(t)
                else:
                    i = self._link(text, i, end, stop, closings, depth)
            elif t == "]]":
                self.put(t)
            elif t[0] == "[":
                if bracket < i:
                    bracket = text.find("]", i, stop)
                    bracket = stop if bracket < 0 else bracket
                e = _EXTERNAL.match(text, m.start(), bracket + 1) if bracket < stop else None
                if not e:
                    self.put("[")
                    i = m.start() + 1
                else:
                    i = e.end()
                    if e.group(2) and not _INTERWIKI.match(e.group(1)):
                        self._part(text, e.start(2), e.end(2), closings, depth + 1)
            elif t[0] == "&":
                self.put(html.unescape(t))
            # quotes of bold and italic, and tags, leave nothing

    def _link(self, text: str, start: int, end: int, stop: int, closings: dict[int, int], depth: int) -> int:
        after = end + 2
        bar = text.find("|", start, end)
        title_end = end if bar < 0 else bar
        if _IMAGE.match(text, start, end):
            captions = [p for p in _split_bars(text, start, end, closings)[1:] if not _IMAGE_OPTION.match(text, *p)]
            if captions:
                self._part(text, *captions[-1], closings, depth + 1)
            return after
        title = html.unescape(text[start:title_end]).strip()
        if ":" in title:
            return after
        trail = _TRAIL.match(text, after, stop)
        begin = self.at
        if bar >= 0 and not text[bar + 1 : end].isspace() and bar + 1 < end:
            self._part(text, bar + 1, end, closings, depth + 1)
        elif bar >= 0:  # the pipe trick
            self.inline(_without_remark(title), depth + 1)
        elif "&" in title or "[[" not in title:
            self.inline(title, depth + 1)
        else:
            while text[start].isspace():
                start += 1
            while text[end - 1].isspace():
                end -= 1
            self._part(text, start, end, closings, depth + 1)
        if trail:
            self.put(trail.group())
            after = trail.end()
        page = self.plain(title).partition("#")[0].strip().replace("_", " ")
        if page and "[[" not in page:  # no page's name has brackets
            self.links.append((uri_of(page[0].upper() + page[1:], self.lang), begin, self.at))
        return after


def _without_remark(title: str) -> str:
    """title without the brackets at its end."""
    if not title.endswith(")"):
        return title
    at = title.find("(", title.rfind(")", 0, -1) + 1)
    return title if at < 0 else title[:at].rstrip()


def _split_bars(text: str, start: int, end: int, closings: dict[int, int]) -> list[tuple[int, int]]:
    """Parts of a link by bars that are not within an inner link."""
    parts, last, at = [], start, start
    while m := _BARS.search(text, at, end):
        at = m.end()
        if m.group() == "|":
            parts.append((last, m.start()))
            last = at
        else:
            at = closings.get(at, at)
    return [*parts, (last, end)]


def parse_markup(markup: str | None, lang: str = "en") -> Parsed:
    """Plain text with annotations (target or tag, begin, end); '' for redirects."""
    if not markup or re.match(r"\s*#redirect\b", markup, re.I):
        return Parsed("", [], [], [])
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(html.unescape(m.group(1) or ""))
        return _KEPT % (len(kept) - 1)

    text = markup.replace("\r\n", "\n") if "\r" in markup else markup
    text = text.replace(_MARK, "")
    if "<" in text:
        text = _kept_out(text, keep)
        text = _COMMENT.sub("", text)
        text = _OTHER_WIKI.sub("", _GONE.sub("", _REF.sub("", text)))
    if "{{" in text:
        text = _without_nested(text, "{{", _PAIR)
    if "{|" in text:
        text = _without_nested(text, "{|", _TABLE)
    if "__" in text:
        text = _MAGIC.sub("", text)

    scan = _Scanner(lang, kept)
    headers: list[tuple[str, int, int]] = []
    paragraphs: list[tuple[str, int, int]] = []
    lines: list[str] = []

    def close() -> None:
        block = "\n".join(lines).strip("\n")
        lines.clear()
        if not block.strip():
            return
        begin, links = scan.at, len(scan.links)
        scan.inline(block)
        if scan.at == begin:
            del scan.links[links:]
            return
        paragraphs.append(("p", begin, scan.at))
        scan.put("\n")

    listed = text.split("\n")
    for line in _joined_links(listed) if "[[" in text else listed:
        heading = _heading(line) if line.startswith("=") else None
        if heading:
            close()
            begin = scan.at
            scan.inline(heading[1])
            headers.append((f"h{heading[0]}", begin, scan.at))
            scan.put("\n\n")
        elif not line.strip() or line.startswith("----"):
            close()
        elif line[0] in "*#:;":
            close()
        elif line[0] == " ":
            close()
            scan.inline(line[1:])
            scan.put("\n")
        else:
            lines.append(line)
    close()
    return Parsed("".join(scan.out), scan.links, headers, paragraphs)


def _joined_links(lines: list[str]) -> list[str]:
    """Lines within a link that is still open belong to its line."""
    out: list[str] = []
    depth = 0
    for line in lines:
        if depth > 0 and out and line.strip():
            out[-1] += "\n" + line
        else:
            depth = 0
            out.append(line)
        depth += line.count("[[") - line.count("]]")
        depth = max(depth, 0)
    return out


def _utf16(p: Parsed) -> Parsed:
    """Offsets in UTF-16 units instead of code points."""
    if p.text.isascii() or max(p.text, default="") < "\U00010000":
        return p
    before = [0]
    for c in p.text:
        before.append(before[-1] + (2 if c > "￿" else 1))
    move = lambda spans: [(v, before[a], before[b]) for v, a, b in spans]
    return Parsed(p.text, move(p.links), move(p.headers), move(p.paragraphs))


@lru_cache(maxsize=8)
def parsed(lang: str = "en", offset_unit: str = "codepoint"):
    """A UDF markup -> struct(text, links, headers, paragraphs)."""
    if offset_unit not in ("codepoint", "utf16"):
        raise ValueError("offset_unit is codepoint or utf16")

    kinds = to_arrow_type(PARSED)

    @F.arrow_udf(PARSED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for markup in batches:
            for start, stop in pieces(markup):
                done = [parse_markup(m, lang) for m in markup.slice(start, stop - start).to_pylist()]
                if offset_unit == "utf16":
                    done = [_utf16(p) for p in done]
                texts, *spans = zip(*done, strict=True)
                columns = [pa.array(texts, kinds[0].type), *[struct_lists(s, k.type) for s, k in zip(spans, list(kinds)[1:], strict=True)]]
                yield pa.StructArray.from_arrays(columns, fields=list(kinds))
            if not len(markup):
                yield pa.array([], kinds)

    return run


def span_texts(text: Column | str, spans: Column | str) -> Column:
    """What stands in each span of the text (code point offsets)."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    return F.transform(spans, lambda s: F.substr(text, s["begin"] + 1, s["end"] - s["begin"]))
