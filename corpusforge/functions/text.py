"""Text functions as Column expressions: all stay in the JVM.

Where an illegal value is an error elsewhere, the result here is null, so that
one bad row never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALPHABET = " ".join(map(chr, range(65, 91)))
_EDGE = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), with c computed once however often `then` uses it."""
    return F.get(F.transform(F.array(c), lambda v: then(v)), F.lit(0))


def strip_controls(c: Column | str) -> Column:
    """Without spaces and control characters (up to U+0020) at both ends."""
    return F.regexp_replace(_col(c), _EDGE, "")


def check_abstract(c: Column | str, min_words: int = 30) -> Column:
    """Whether a text is a proper abstract: at least min_words words by single
    spaces (trailing empty ones do not count, inner ones do) and no index of
    letters from A to Z. Null and '' are not."""
    c = _col(c)
    body = F.regexp_replace(c, " +$", "")
    words = F.when(body == "", F.when(c == "", 1).otherwise(0)).otherwise(F.size(F.split(body, " ", -1)))
    return F.coalesce((c != "") & (words >= min_words) & ~F.contains(c, F.lit(_ALPHABET)), F.lit(False))


def safe_tsv(c: Column | str) -> Column:
    """One quoted field: tabs and newlines become spaces, quotes are doubled."""
    flat = F.regexp_replace(_col(c), r"[\t\n]", " ")
    return F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))


def concat_texts(items: Column | str, sep: str = " ", trim: bool = True) -> Column:
    """The distinct items that are neither null nor empty, in order of first
    appearance, joined. Trimming comes before both tests. No items give ''."""
    items = _col(items)
    cut = F.transform(items, strip_controls) if trim else items
    return F.array_join(F.array_distinct(F.filter(cut, lambda x: x.isNotNull() & (x != ""))), sep)


def cut_item(item: Column, cap: Column) -> Column:
    """An item over the cap ends at the first space at or after the cap's last
    character, or hard at the cap where there is none."""
    space = F.position(F.lit(" "), item, cap)
    return F.when(F.length(item) <= cap, item).when(space > 0, F.substr(item, F.lit(1), space - 1)).otherwise(F.substr(item, F.lit(1), cap))


def item_cap(n: Column, size_limit: int) -> Column:
    """What each of n items may take at most (200 characters at least)."""
    return F.greatest(F.floor(F.lit(size_limit) / F.greatest(n, F.lit(1))), F.lit(200)).cast("int")


def aggregate_texts(items: Column | str, size_limit: int = 100_000, tsv_safe: bool = False) -> Column:
    """Items joined by spaces up to about size_limit characters.

    Each is cut to its cap first; items are taken while the sum of their lengths
    plus one each is under the limit, so the last may go beyond. No items give
    '' (unquoted); null items make the result null.
    """
    items = _col(items)
    cap = item_cap(F.size(items), size_limit)
    cut = F.transform(items, lambda x: cut_item(x, cap))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit(size_limit).cast("long").alias("left"))

    def step(acc: Column, x: Column) -> Column:
        took = F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), (acc["left"] - F.length(x) - 1).alias("left"))
        return F.when(acc["left"] > 0, took).otherwise(acc)

    # a fold over lengths would copy the text each time; so only entries move
    joined = F.aggregate(cut, start, step, lambda acc: F.array_join(acc["kept"], " "))
    joined = F.when(F.exists(items, lambda x: x.isNull()), F.lit(None)).otherwise(joined)
    return F.when(F.size(items) == 0, F.lit("")).otherwise(safe_tsv(joined) if tsv_safe else joined)


def no_loop(path: Column | str, sep: str = " ") -> Column:
    """False where the last element of a path stands in it before.

    sep is a regular expression; trailing empty elements are dropped. Null and
    paths of fewer than two elements have no loop.
    """
    parts = F.split(strip_controls(path), sep, -1)
    # how many elements there are up to the last that is not empty
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when(F.coalesce(F.get(parts, i - 1), F.lit("")) != "", i).otherwise(acc),
    )
    kept = F.slice(parts, F.lit(1), n)
    return F.coalesce((n < 2) | ~F.array_contains(F.slice(kept, F.lit(1), F.greatest(n - 1, F.lit(0))), F.element_at(kept, n)), F.lit(True))


def path_has_no_loop(path: Column | str) -> Column:
    """no_loop() of a path kept as an array."""
    path = _col(path)
    n = F.size(path)
    return F.coalesce((n < 2) | ~F.array_contains(F.slice(path, F.lit(1), F.greatest(n - 1, F.lit(0))), F.element_at(path, -1)), F.lit(True))


def title_to_uri(title: Column | str, lang: Column | str = "en") -> Column:
    """A page's address: spaces become underscores, the rest is percent-encoded
    as in a form (`*` stays, `~` is encoded)."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.concat(F.lit("http://"), lang, F.lit(".wikipedia.org/wiki/"), F.url_encode(F.replace(_col(title), F.lit(" "), F.lit("_"))))


def redirect_target(markup: Column | str, lang: str = "en") -> Column:
    """The address that a redirect page leads to, else null. The word is in
    capitals, one space follows; a label or fragment stays part of the title."""
    title = F.regexp_extract(_col(markup), r"^#REDIRECT \[\[([^\]]*)\]\]", 1)
    return F.when(title != "", title_to_uri(title, lang))


def human_readable(topic: Column | str, prefix: str = "Category:") -> Column:
    """A topic's label: without the first len(prefix) characters whatever they
    are, percent-decoded (a plus sign stays), underscores as spaces."""
    body = F.substr(_col(topic), F.lit(len(prefix) + 1))
    return F.replace(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


def unescape_xml(c: Column | str) -> Column:
    """The five named entities and numeric ones; the ampersand comes last, so
    that what it reveals is not unescaped again."""
    return let(_col(c), lambda v: F.when(F.contains(v, F.lit("&")), _unescaped(v)).otherwise(v))


def _unescaped(c: Column) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    numeric = r"&#(?:\d{1,7}|[xX][0-9A-Fa-f]{1,6});"

    def char_of(p: Column) -> Column:
        # a code point by its UTF-32 bytes
        hexa = F.substr(p, F.lit(4), F.length(p) - 4)
        deci = F.conv(F.substr(p, F.lit(3), F.length(p) - 3), 10, 16)
        code = F.when(F.lower(F.substr(p, F.lit(3), F.lit(1))) == "x", hexa).otherwise(deci)
        return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")

    def joined(v: Column) -> Column:
        chars = F.transform(F.regexp_extract_all(v, F.lit(numeric), F.lit(0)), char_of)
        parts = F.arrays_zip(F.split(v, numeric, -1).alias("b"), chars.alias("p"))
        return F.array_join(F.transform(parts, lambda x: F.concat(x["b"], F.coalesce(x["p"], F.lit("")))), "")

    plain = let(c, lambda v: F.when(F.contains(v, F.lit("&#")), joined(v)).otherwise(v))
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))
