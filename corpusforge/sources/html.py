"""The text of web pages: headings and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import unescape_xml

TAGS = "h1 h2 h3 h4 p".split()


def html_text(html: Column | str) -> Column:
    """The contents of h1, h2, h3, h4 and p elements, in this order of tags and
    each in document order, tags within removed, joined by blank lines."""
    html = F.col(html) if isinstance(html, str) else html
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    found = [F.regexp_extract_all(plain, F.lit(rf"(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}\s*>"), F.lit(1)) for t in TAGS]
    return F.array_join(F.transform(F.concat(*found), lambda x: unescape_xml(F.replace(F.regexp_replace(x, r"(?s)<[^>]*>", ""), F.lit("&nbsp;"), F.lit("\xa0")))), "\n\n")
