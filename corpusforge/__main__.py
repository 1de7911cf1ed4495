"""python -m corpusforge {links,redirects,ner,topics} SOURCE TARGET [--lang en] ...

categorize takes a file or a text as SOURCE, and as TARGET the topics' TSV.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corpusforge", description=__doc__)
    p.add_argument("pipeline", choices=["links", "redirects", "ner", "topics", "categorize"])
    p.add_argument("source", help="a dump, or the folder of triples for topics")
    p.add_argument("target")
    p.add_argument("--lang", default="en")
    p.add_argument("--triples", help="ner: folder of the triples")
    p.add_argument("--type-names", help="ner: TSV of types and names")
    p.add_argument("--type-uri", help="ner: this type only")
    p.add_argument("--type-name", help="ner: its name")
    p.add_argument("--categories", type=int, default=5, help="categorize: how many to name")
    p.add_argument("--terms", type=int, default=30, help="categorize: terms of the query to use")
    p.add_argument("--bagging", action="store_true", help="categorize: vote over samples of the text")
    p.add_argument("--print-terms", action="store_true")
    p.add_argument("--print-paths", action="store_true")
    p.add_argument("--print-raw-text", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"corpusforge {a.pipeline}").getOrCreate()

    from .plans import extract, ner, similarity, topics
    from .sources.tsv import read_tsv, write_tsv

    if a.pipeline == "links":
        write_tsv(extract.extract_links(spark, a.source, a.lang), a.target)
    elif a.pipeline == "redirects":
        write_tsv(extract.extract_redirects(spark, a.source, a.lang), a.target)
    elif a.pipeline == "ner":
        ner.run_ner(spark, a.source, a.triples or a.source, a.target, a.lang, a.type_names, a.type_uri, a.type_name)
    elif a.pipeline == "categorize":
        known = read_tsv(spark, a.target, "topicUri string, abstractCount long, paths string, aggregateTopicAbstract string")
        found = similarity.categorize_document(spark, a.source, known, a.categories, a.terms, a.bagging)
        for r in found["topics"].collect():  # a few rows, by --categories
            print(f"{r['label']:<50} [{r['score']:.3f}]")
        for wanted, name in ((a.print_paths, "paths"), (a.print_terms, "terms")):
            if wanted:
                print(f"{name}:", *[" ".join(map(str, r)) for r in found[name].collect()], sep="\n")
        if a.print_raw_text:
            print("text:", similarity.query_text(spark, a.source).first()["text"], sep="\n")
    else:
        topics.run_topics(spark, a.source, a.target, a.lang)


if __name__ == "__main__":
    main()
