import pytest

from corpusforge.functions.markup import MAX_DEPTH, parse_markup, uri_of


def shown(markup, lang="en"):
    p = parse_markup(markup, lang)
    base = uri_of("", lang)
    return p.text, [(u.removeprefix(base), p.text[a:b]) for u, a, b in p.links]


@pytest.mark.parametrize(
    ("markup", "text", "links"),
    [
        ("plain '''bold''' and ''it''", "plain bold and it\n", []),
        ("{{a|{{b}}|c}}born {{date}} here", "born  here\n", []),
        ("a [[political theory]] b", "a political theory b\n", [("Political_theory", "political theory")]),
        ("a [[Page one|label]]s b", "a labels b\n", [("Page_one", "labels")]),
        ("[[Mercury (planet)|]]", "Mercury\n", [("Mercury_%28planet%29", "Mercury")]),
        ("x [[Category:Y]] [[fr:Z]] [[a:b|c]] y", "x    y\n", []),
        ("x [[#part|here]] y", "x here y\n", []),
        ("x [[Page#part|here]] y", "x here y\n", [("Page", "here")]),
        ("x [http://a.example label text] y [http://a.example] z", "x label text y  z\n", []),
        ("x [http://fr.wikipedia.org/wiki/Y translation] y", "x  y\n", []),
        ("x<ref>gone</ref> y<ref name='a'/> z<!-- no --> w", "x y z w\n", []),
        ('x <a href="http://fr.wikipedia.org/wiki/Y">gone</a> <a href="http://a.example/wiki/Y">stays</a> y', "x  stays y\n", []),
        ("[[File:a.png|thumb|one|two [[b|c]] three]]", "two c three\n", [("B", "c")]),
        ("[[<nowiki>A|b</nowiki>|c]] d", "c d\n", [("A%7Cb", "c")]),
        ("[[a [[b]] c]]", "a b c\n", [("B", "b")]),
        ("* item\n# item\n: item\n; item", "", []),
        ("{|\n| cell\n{|\n| inner\n|}\n|}\nafter", "after\n", []),
        ("[[File:a.png|thumb|200px|A [[cap|caption]] here]] text", "A caption here text\n", [("Cap", "caption")]),
        ("[[Image:a.png]]x", "x\n", []),
        ("a <span class='x'>b</span> <b>c</b> &amp; &eacute;", "a b c & é\n", []),
        ("<nowiki>[[not]] ''a link''</nowiki> x", "[[not]] ''a link'' x\n", []),
        ("#REDIRECT [[Other]] {{R}}", "", []),
        ("open [[link and {{brace", "open [[link and {{brace\n", []),
        ("", "", []),
        (None, "", []),
        ("__NOTOC__x", "x\n", []),
        ("😀 [[a]]", "😀 a\n", [("A", "a")]),
    ],
)
def test_behaviours(markup, text, links):
    assert shown(markup) == (text, links)


def test_headings_and_paragraphs():
    p = parse_markup("One\nline.\n\n== Two [[x]] ==\nThree.\n=== Four ===\n----\nFive.")
    assert p.text == "One\nline.\nTwo x\n\nThree.\nFour\n\nFive.\n"
    assert [(t, p.text[a:b]) for t, a, b in p.headers] == [("h2", "Two x"), ("h3", "Four")]
    assert [p.text[a:b] for _, a, b in p.paragraphs] == ["One\nline.", "Three.", "Five."]
    assert [p.text[a:b] for _, a, b in p.links] == ["x"]


def test_deep_nesting_ends():
    text = parse_markup("[[a|" * (MAX_DEPTH + 50) + "x" + "]]" * (MAX_DEPTH + 50)).text
    assert text.startswith("Error") and parse_markup("{{" * 20_000 + "}}" * 19_999).text is not None


def test_addresses_are_those_of_the_jvm(spark):
    from corpusforge.functions.text import title_to_uri

    titles = ["A b", "x*y~z", "é/ü", "a+b&c", "😀", "100%", "a-b_c.d"]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(title_to_uri("t")).collect()
    assert [r[0] for r in got] == [uri_of(t, "en") for t in titles]


def test_language():
    assert parse_markup("[[a]]", "fr").links[0][0] == "http://fr.wikipedia.org/wiki/A"


@pytest.mark.parametrize("n", [1, 999, 1000, 5000])
def test_balanced_templates_go_from_an_unclosed_one(n):
    assert parse_markup("{{ open " + "{{a|{{b}}}} " * n).text == "{{ open" + " " * (n + 1) + "\n"


@pytest.mark.parametrize(
    "markup",
    ["[[" * 100_000, "[[a|" * 50_000 + "x" + "]]" * 50_000, "[[" * 50_000 + "]]" * 50_000, "[[File:a|" * 50_000 + "]]" * 50_000, "{{" * 100_000, "{{" * 50_000 + "}}" * 50_000, "[" * 100_000, "<ref>" * 50_000]
    + [f"<{t} " * 50_000 for t in ("ref", "a", "nowiki", "gallery", "b")]
    + ["<nowiki>" * 50_000, "</nowiki>" + "<nowiki>" * 50_000, "<!--" * 50_000, "=" + " " * 50_000 + "x", "=" * 50_000, "{|" * 50_000, "{|\n" * 30_000 + "|}\n" * 30_000, ":" * 100_000]
    + ["[[File:a|" + "1" * 50_000 + "]]", "[[File:a|" + " " * 50_000 + "x]]", "[http://" * 50_000, "[http://a b " * 30_000, "&a" * 50_000, "__A" * 50_000, "'" * 100_001, "]]" * 50_000, "[[a\n" * 30_000]
    + ["[http://a b " * 30_000 + "]", "[http:// " * 30_000 + "]", "[[a" + " " * 50_000 + "b|]]", "[[" + "(" * 50_000 + "b|]]"],
)
def test_time_grows_with_the_length(markup):
    import time

    began = time.process_time()
    parse_markup(markup)
    assert time.process_time() - began < 5  # some tenths of a second; a square of the length takes minutes
