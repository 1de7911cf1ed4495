import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as T


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make("x").alias("y")).first()["y"]


LONG = "The ring of all smooth maps on a space is studied by way of its ideals , and each point gives one of them , so that much of the space can be told from it alone ."
INDEX = "Index of terms by letter : " + " ".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + " and then some more words to make it long enough for the rule to look at"


@pytest.mark.parametrize(("value", "want"), [(None, False), ("", False), ("Too short to count.", False), (INDEX, False), (LONG, True), ("w " * 30, True), ("w " * 29, False), (" " * 40, False), ("w  " * 15, False), ("w  " * 16, True)])
def test_check_abstract(spark, value, want):
    assert one(spark, value, T.check_abstract) is want


def test_safe_tsv(spark):
    assert one(spark, 'a\tb\nc "d"\r', T.safe_tsv) == '"a b c ""d""\r"'
    assert one(spark, None, T.safe_tsv) is None


@pytest.mark.parametrize(
    ("items", "sep", "trim", "want"),
    [([" x1", "x2", " x3 ", "x1", "x4 "], " _ ", True, "x1 _ x2 _ x3 _ x4"), ([], " ", True, ""), ([None, "", " ", "\x01a"], " ", True, "a"), ([" a", "a"], ",", False, " a,a")],
)
def test_concat_texts(spark, items, sep, trim, want):
    assert one(spark, items, lambda c: T.concat_texts(c, sep, trim), "array<string>") == want


def fold(items, limit):
    """The bounded aggregate, item by item."""
    cap, out, left = max(limit // len(items), 200), [], limit
    for x in items:
        if len(x) > cap:
            at = x.find(" ", cap - 1)
            x = x[:at] if at >= 0 else x[:cap]
        out.append(x)
        left -= len(x) + 1
        if left <= 0:
            break
    return " ".join(out)


def test_aggregate_texts(spark):
    s = "Mary Jones trains at Jones Athletics."
    assert one(spark, [s] * 6, lambda c: T.aggregate_texts(c, 40, True), "array<string>") == f'"{s} {s}"'
    assert one(spark, [s.replace(" ", "\t", 1)] * 6, lambda c: T.aggregate_texts(c, 40, True), "array<string>") == f'"{s} {s}"'
    assert one(spark, [], lambda c: T.aggregate_texts(c, 40, True), "array<string>") == ""
    assert one(spark, ["a", None], T.aggregate_texts, "array<string>") is None
    for items in (["x" * 500, "y" * 150 + " " + "z" * 100, "w" * 199 + " tail", "v" * 200 + " tail", "last"], ["word " * 100] * 9):
        for limit in (300, 1000, 2200):
            assert one(spark, items, lambda c, n=limit: T.aggregate_texts(c, n), "array<string>") == fold(items, limit)


@pytest.mark.parametrize(
    ("path", "sep", "want"),
    [(None, " ", True), ("", " ", True), ("a", " ", True), ("a b c d", " ", True), ("a b b d", " ", True), ("a a", " ", False), ("a b c a", " ", False), ("a b c b", " ", False), ("a b c c", " ", False)]
    + [("/a/b/a", "/", False), ("/a/b/", "/", True), ("a/b//", "/", True), ("  a a  ", " ", False), ("a1b2a", r"\d", False)],
)
def test_no_loop(spark, path, sep, want):
    assert one(spark, path, lambda c: T.no_loop(c, sep)) is want


def test_path_arrays(spark):
    for path, want in (([], True), (["a"], True), (["a/b", "a"], True), (["a", "b", "a"], False), (None, True)):
        assert one(spark, path, T.path_has_no_loop, "array<string>") is want


def test_uris_and_redirects(spark):
    assert one(spark, "A b*~é/(c)", T.title_to_uri) == "http://en.wikipedia.org/wiki/A_b*%7E%C3%A9%2F%28c%29"
    assert one(spark, "X", lambda c: T.title_to_uri(c, "fr")) == "http://fr.wikipedia.org/wiki/X"
    cases = {
        "#REDIRECT [[Some page]] {{R x}}": "http://en.wikipedia.org/wiki/Some_page",
        "#REDIRECT [[a#b|c]]": "http://en.wikipedia.org/wiki/a%23b%7Cc",
        "#redirect [[A]]": None,
        "#REDIRECT  [[A]]": None,
        "see #REDIRECT [[A]]": None,
        "text": None,
        None: None,
    }
    for markup, want in cases.items():
        assert one(spark, markup, T.redirect_target) == want


def test_human_readable(spark):
    assert one(spark, "Category:Films_of_1990%2B+x", T.human_readable) == "Films of 1990++x"
    assert one(spark, "Whatever_Alpha_b", T.human_readable) == "Alpha b"


def test_unescape_xml(spark):
    assert one(spark, "a &lt;b&gt; &amp;lt; &quot;&apos; &#233;&#x1F600; &#xe9;x &unknown;", T.unescape_xml) == "a <b> &lt; \"' é😀 éx &unknown;"


def test_all_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a",)], "x string").select(T.check_abstract("x"), T.safe_tsv("x"), T.no_loop("x"), T.title_to_uri("x"), T.concat_texts(F.array("x")), T.aggregate_texts(F.array("x")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
