import bz2

import pytest
from pyspark.sql import functions as F

import corpusforge.__main__ as cli
from corpusforge.operators import relational as R
from corpusforge.plans import ner, similarity, topics
from corpusforge.sources.tsv import W3

GOOD = "word " * 40


def rel(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_blacklist():
    assert len(set(topics.BLACKLIST)) == 16 and sum(not b.startswith("Category:") for b in topics.BLACKLIST) == 3


def test_counts_go_the_right_way(spark):
    edges = rel(spark, [("b", "a"), ("c", "a"), ("c", "b"), (None, "a"), ("x", None)], "narrowerTopicUri string, broaderTopicUri string")
    articles = rel(spark, [("1", "a"), ("2", "a"), (None, "a"), ("3", "z"), ("4", None)], "articleUri string, topicUri string")
    # a has two children that are not null; z has articles only
    assert rows(topics.topic_counts(articles, edges)) == [("a", 2, 2, 0), ("b", 0, 1, 1), ("c", 0, 0, 2)]


def test_linked_topics_follow_redirects(spark):
    counts = rel(spark, [("Category:A", 3), ("Category:B", 2), ("Category:C", 1), ("Category:People", 9)], "topicUri string, articleCount long")
    abstracts = rel(spark, [("A", GOOD), ("B2", GOOD), ("C", "short")], "articleUri string, articleAbstract string")
    redirects = rel(spark, [("B", "B2"), ("B", "B3")], "source string, target string")
    linked = topics.linked_topics(counts, topics.abstract_checks(abstracts), redirects)
    assert rows(linked) == [("Category:A", "A", 3), ("Category:B", "B2", 2), ("Category:B", None, 2), ("Category:C", None, 1)]
    parts = topics.split_grounded(linked)
    assert rows(parts["nongrounded"]) == [("Category:B", 2), ("Category:C", 1)] and parts["grounded"].count() == 2


LINKED = [("r", None, 1), ("g", "G", 2), ("h", "H", 3), ("leaf", None, 4)]
EDGES = [("r", "ROOT"), ("g", "r"), ("h", "g"), ("r", "h"), ("leaf", "h"), ("g", "g"), ("g", "r"), ("h", "ROOT")]


def graph(spark):
    return rel(spark, LINKED, "topicUri string, primaryArticleUri string, articleCount long"), rel(spark, EDGES, "narrowerTopicUri string, broaderTopicUri string")


def test_descendants(spark):
    linked, edges = graph(spark)
    one = topics.topic_descendants(linked, edges)
    assert rows(one.select("topicUri", "uriLevel1", "uriLevel2")) == sorted([("r", "g", None), ("g", "h", None), ("h", "r", None), ("h", "leaf", None), ("leaf", None, None)], key=str)
    two = topics.topic_descendants(linked, edges, 2)
    assert ("g", "h", "leaf") in [tuple(r) for r in two.select("topicUri", "uriLevel1", "uriLevel2").collect()]


def test_articles_of_topics(spark):
    linked, edges = graph(spark)
    articles = rel(spark, [("a1", "g"), ("a2", "h"), ("a3", "r"), ("a4", "leaf")], "articleUri string, topicUri string")
    down = topics.topic_descendants(linked, edges)
    got = {(r["topicUri"], r["articleUri"]) for r in topics.topic_articles(down, articles).collect()}
    grounded = {("g", "G"), ("h", "H"), ("g", "a1"), ("h", "a2"), ("g", "a2"), ("h", "a3"), ("h", "a4")}
    assert got == grounded | {("r", "a1")}  # a child of a topic without an article comes too
    assert {(r["topicUri"], r["articleUri"]) for r in topics.topic_articles(down, articles, grounded_only=True).collect()} == grounded


def test_ancestry(spark):
    linked, edges = graph(spark)
    got = {(r["topicUri"], r["fullPath"], r["groundedPath"], r["groundedPathLength"]) for r in topics.grounded_ancestry(linked, edges, "ROOT").collect()}
    assert got == {
        ("r", "r", "", 0),
        ("h", "h", "h", 1),
        ("g", "r/g", "/g", 1),
        ("h", "r/g/h", "/g/h", 2),
        ("leaf", "r/g/h/leaf", "/g/h", 2),
        ("r", "h/r", "h", 1),
        ("leaf", "h/leaf", "h", 1),
        ("g", "h/r/g", "h/g", 2),
    }
    assert len({p for _, p, _, _ in got if p.count("/") < 2}) == topics.grounded_ancestry(linked, edges, "ROOT", 2).count()


def test_names_with_slashes_make_no_loops(spark):
    linked = rel(spark, [("a/b", "X", 1), ("b", "Y", 1)], "topicUri string, primaryArticleUri string, articleCount long")
    edges = rel(spark, [("a/b", "ROOT"), ("b", "a/b")], "narrowerTopicUri string, broaderTopicUri string")
    assert topics.grounded_ancestry(linked, edges, "ROOT").count() == 2


def test_array_and_window_aggregates_agree(spark):
    from corpusforge.functions.text import aggregate_texts

    items = [("k", i, f"{i} " + "word " * (i * 13 % 90)) for i in range(60)] + [("e", 1, "x" * 900)]
    df = rel(spark, items, "k string, i int, t string")
    for limit in (500, 3000, 9000):
        window = rows(R.aggregate_grouped(df, ["k"], "t", ["i"], "body", "n", limit))
        array = df.groupBy("k").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda r: r["t"]).alias("a"))
        assert window == rows(array.select("k", "n", aggregate_texts("a", limit)))


def test_replicated_join_checks_the_size(spark):
    big, small = spark.range(100).toDF("k"), spark.range(10).toDF("k")

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()

    assert hinted(R.replicated_join(big, small, "k", most=160)) and not hinted(R.replicated_join(big, small, "k", most=159))
    assert R.replicated_join(big, small, "k", most=9).count() == 10


def test_entities(spark):
    links = rel(spark, [("w:A", "A"), ("w:B", "B"), (None, "C")], "wikiuri string, dburi string")
    redirects = rel(spark, [("A", "A2")], "source string, target string")
    types = rel(spark, [("A2", "t:Person"), ("A2", ner.THING), ("B", "t:Place"), ("A", "t:Wrong")], "dburi string, type string")
    typed = ner.article_types(links, redirects, types)
    assert rows(typed) == [("w:A", "t:Person"), ("w:B", "t:Place")]
    sentences = rel(
        spark,
        [("p", 1, "w:A", 0, 3, "Ann met Bob ."), ("p", 1, "w:B", 8, 11, "Ann met Bob ."), ("p", 2, "w:B", 0, 3, "Bob left ."), ("q", 1, "w:Z", 0, 1, "Z .")],
        "title string, sentenceOrder int, linkTarget string, linkBegin int, linkEnd int, sentence string",
    )
    names = rel(spark, [("t:Person", "person"), ("t:Place", "location")], "typeuri string, typename string")
    assert rows(ner.annotated_sentences(sentences, typed, names)) == [("p", 1, "<START:person> Ann <END> met <START:location> Bob <END> ."), ("p", 2, "<START:location> Bob <END> left .")]
    assert rows(ner.annotated_with(sentences, typed, "t:Place", "place")) == [("p", 1, "Ann met <START:place> Bob <END> ."), ("p", 2, "<START:place> Bob <END> left .")]
    assert rows(ner.entity_contexts(sentences)) == [("w:A", "Ann met Bob ."), ("w:B", "Ann met Bob . Bob left ."), ("w:Z", "Z .")]


def test_contexts_are_collected_by_page_first(spark):
    made = [("q", 2, "w:A", "Q two."), ("p", 10, "w:A", "P ten."), ("p", 2, "w:A", "P two."), ("p", 2, "w:A", "P two."), ("p", 2, "w:A", "Other page."), (None, 1, "w:A", "N."), ("p", 1, None, "Z.")]
    sentences = rel(spark, made, "title string, sentenceOrder int, linkTarget string, sentence string")
    got = ner.entity_contexts(sentences)
    assert sorted(got.collect(), key=str) == [("w:A", "N. Other page. P two. P ten. Q two."), (None, "Z.")] or sorted(got.collect(), key=str) == [(None, "Z."), ("w:A", "N. Other page. P two. P ten. Q two.")]
    keys = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert len(keys) == 2 and "title" in keys[1].split("]")[0]


def test_typed_links_are_joined_where_they_are(spark):
    """Sentences are not shuffled by the page that they link to."""
    sentences = rel(spark, [("p", 1, "w:A", 0, 3, "Ann left .")], "title string, sentenceOrder int, linkTarget string, linkBegin int, linkEnd int, sentence string")
    types, names = rel(spark, [("w:A", "t:P")], "wikiuri string, type string"), rel(spark, [("t:P", "person")], "typeuri string, typename string")
    for df in (ner.annotated_sentences(sentences, types, names), ner.annotated_with(sentences, types, "t:P", "person")):
        assert "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
        assert rows(df) == [("p", 1, "<START:person> Ann <END> left .")]


def test_similarity(spark):
    docs = rel(spark, [("cats", "cat cat purr meow fur"), ("dogs", "dog bark fur tail"), ("cars", "engine wheel road")], "id string, text string")
    index = similarity.index(docs, "id")
    q = rel(spark, [(1, "The cat and its purr"), (2, "a wheel on the road"), (3, "nothing known")], "qid int, text string")
    best = {r["qid"]: r["id"] for r in similarity.categorize(q, "qid", index, 1).collect()}
    assert best == {1: "cats", 2: "cars"}
    terms = similarity.interesting_terms(q, "qid", similarity.term_weights(index), n_terms=1)
    assert {r["qid"] for r in terms.collect()} == {1, 2}
    bagged = similarity.bagging_categorize(q, "qid", index, 1)
    assert all(r["votes"] > 3 and r["rank"] == 1 for r in bagged.collect())
    assert sorted(map(tuple, bagged.collect())) == sorted(map(tuple, similarity.bagging_categorize(q, "qid", index, 1).collect()))
    paths = rel(spark, [("Category:A_b/Category:C /Category:D Category:A_b",)], "p string").select(similarity.readable_paths("p")).first()[0]
    assert paths == ["A b", "A b / C", "D"]


def test_best_texts_over_many_batches(spark):
    """Scores beside plain Python, over pieces and tasks, with ties."""
    from collections import Counter
    from math import log, sqrt

    texts = {k: " ".join(f"w{k * (j + 3) % 23}" for j in range(k % 9)) for k in range(700)}
    docs = rel(spark, [(k, t) for k, t in texts.items()], "id int, text string").repartition(3)
    asked = {1: "w1 w2 w2 w5 unknown", 2: "w7", 3: "none"}
    got = similarity.categorize(rel(spark, list(asked.items()), "qid int, text string"), "qid", similarity.index(docs, "id"), 4).collect()
    words = {k: t.split() for k, t in texts.items() if t}
    idf = lambda w: 1 + log(len(words) / (sum(w in x for x in words.values()) + 1))
    want = []
    for q, text in asked.items():
        terms = {w for w in text.split() if any(w in x for x in words.values())}
        scores = {k: round(sum(sqrt(c) * idf(w) ** 2 / sqrt(len(x)) for w, c in Counter(x).items() if w in terms), 4) for k, x in words.items() if terms & set(x)}
        want += [(q, k, v, n) for n, (k, v) in enumerate(sorted(scores.items(), key=lambda i: (-i[1], i[0]))[:4], 1)]
    assert sorted(map(tuple, got)) == want


def test_texts_are_scored_where_they_are(spark):
    """No postings are shuffled or written: one exchange, of the best texts."""
    docs = rel(spark, [(1, "a cat"), (2, "a dog")], "id int, text string")
    found = similarity.categorize(rel(spark, [(1, "cat")], "qid int, text string"), "qid", similarity.index(docs, "id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "parquet" not in plan.lower() and "SortMergeJoin" not in plan


def test_texts_of_one_key_are_one_text(spark):
    docs = rel(spark, [(1, "cat dog"), (1, "cat"), (2, "dog")], "id int, text string")
    index = similarity.index(docs, "id")
    assert sorted((r["id"], sorted(r["w"])) for r in index.collect()) == [(1, ["cat", "cat", "dog"]), (2, ["dog"])]
    every = dict(map(tuple, similarity.term_weights(index).collect()))
    assert every == dict(map(tuple, similarity.term_weights(index, terms=rel(spark, [("cat",), ("dog",), ("cow",)], "term string")).collect()))


def test_items_are_made_distinct_before_they_are_collected(spark):
    made = [("g", " b", 3), ("g", "a", 2), ("g", "b ", 1), ("g", "", 0), ("g", None, 0), ("h", "  ", 1), ("g", "a", 9)]
    got = R.concat_grouped(rel(spark, made, "k string, v string, n int"), ["k"], "v", ["n"], "vs", "|")
    assert rows(got) == [("g", "b|a"), ("h", "")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_texts_are_cut_before_they_are_shuffled(spark):
    texts = R.aggregate_grouped(rel(spark, [("g", 1, "one"), ("g", 2, "two"), (None, 1, "x")], "k string, n int, t string"), ["k"], "t", ["n"], "body", "count")
    assert rows(texts) == [("g", 2, "one two"), (None, 1, "x")] or sorted(map(tuple, texts.collect()), key=str) == sorted([("g", 2, "one two"), (None, 1, "x")], key=str)
    assert "broadcast" in texts._jdf.queryExecution().analyzed().toString().lower()


def test_last_level_of_paths_is_not_written(spark):
    edges = rel(spark, [("a", "root", "A"), ("b", "a", None), ("c", "b", "C")], "node string, parent string, article string")
    paths = R.expand_paths(edges, F.col("parent") == "root", 3, "article")
    assert rows(paths.select("node", F.array_join("fullPath", "/"), F.array_join("groundedPath", "/"))) == [("a", "a", "a"), ("b", "a/b", "a"), ("c", "a/b/c", "a/c")]
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "_inner#" in plan  # leaves are joined with nothing
    assert paths.columns == ["node", "article", "fullPath", "groundedPath", "startsBare"]


@pytest.fixture
def triples(tmp_path):
    def write(name, lines):
        with bz2.open(tmp_path / f"{name}_en.nt.bz2", "wt") as f:
            f.write("\n".join(lines) + "\n")

    r = topics.RESOURCE
    write("skos_categories", [f"<{r}Category:T> <{W3}2004/02/skos/core#broader> <{r}{topics.ROOT}> ."])
    write("article_categories", [f"<{r}A{i}> <http://purl.org/dc/terms/subject> <{r}Category:T> ." for i in range(12)])
    write("long_abstracts", [f'<{r}{a}> <http://dbpedia.org/ontology/abstract> "{GOOD}{a} \\"q\\""@en .' for a in ["T", *[f"A{i}" for i in range(12)]]])
    write("redirects", [f"<{r}X> <http://dbpedia.org/ontology/wikiPageRedirects> <{r}T> ."])
    return tmp_path


def test_topics_from_files(spark, triples, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    cli.main(["topics", str(triples), str(triples / "out")])
    (line,) = [r[0] for r in spark.read.text(str(triples / "out/topics_abstracts.tsv")).collect()]
    topic, n, paths, body = line.split("\t")
    assert (topic, n, paths) == ("Category:T", "13", "Category:T") and body.startswith('"word') and '""q""' in body
    assert spark.read.text(str(triples / "out/topics_abstracts.nt")).count() == 1


def test_dump_to_corpus(spark, tmp_path):
    page = "<page><title>{}</title><revision><text xml:space=\"preserve\">{}</text></revision></page>\n"
    (tmp_path / "d.xml").write_text("<mediawiki>" + page.format("P", "[[ann lee]] met [[Rome]]. Nobody came.") + page.format("R", "#REDIRECT [[P]]") + "</mediawiki>")
    w, db = "http://en.wikipedia.org/wiki/", "http://dbpedia.org/resource/"
    (tmp_path / "wikipedia_links_en.nt").write_text("".join(f"<{w}{a}> <http://xmlns.com/foaf/0.1/primaryTopic> <{db}{a}> .\n" for a in ("Ann_lee", "Rome")))
    (tmp_path / "redirects_en.nt").write_text("")
    kinds = {"Ann_lee": "Person", "Rome": "Place"}
    (tmp_path / "instance_types_en.nt").write_text("".join(f"<{db}{a}> <{W3}1999/02/22-rdf-syntax-ns#type> <http://dbpedia.org/ontology/{k}> .\n" for a, k in kinds.items()))
    cli.main(["ner", str(tmp_path / "d.xml"), str(tmp_path / "out"), "--triples", str(tmp_path)])
    assert [r[0] for r in spark.read.text(str(tmp_path / "out/en/annotated")).collect()] == ["<START:person> ann lee <END> met <START:location> Rome <END> ."]
    cli.main(["redirects", str(tmp_path / "d.xml"), str(tmp_path / "red")])
    assert [r[0] for r in spark.read.text(str(tmp_path / "red")).collect()] == [f"{w}R\t{w}P"]
    cli.main(["links", str(tmp_path / "d.xml"), str(tmp_path / "links"), "--lang", "fr"])
    assert spark.read.text(str(tmp_path / "links")).count() == 2


def test_categorize_a_document(spark, tmp_path, capsys):
    lines = ["Category:Big_cats\t11\tCategory:Animals/Category:Big_cats\t\"cat cat purr meow fur\"", "Category:Cars\t12\tCategory:Cars\t\"engine wheel road\""]
    (tmp_path / "topics.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "page.html").write_text("<html><h1>My cat</h1><p>It can purr.</p><div>engine engine</div></html>")
    cli.main(["categorize", str(tmp_path / "page.html"), str(tmp_path / "topics.tsv"), "--categories", "1", "--print-paths", "--print-terms", "--print-raw-text"])
    out = capsys.readouterr().out
    assert out.startswith("Big cats") and "Animals / Big cats" in out and "purr" in out and "My cat\n\nIt can purr." in out
    cli.main(["categorize", "a wheel and a road", str(tmp_path / "topics.tsv"), "--bagging", "--categories", "1"])
    assert capsys.readouterr().out.startswith("Cars")
    with pytest.raises(ValueError, match="download"):
        similarity.query_text(spark, "http://a.example/")
