"""The queries over whole texts, beside sentences that are known beforehand."""

import re

from corpusforge.plans import catalog

#: Eleven words each, so that the linked twelfth words lie in different places.
SAID = [f"Sentence {i} goes on with nine more words before it ends{i}." for i in range(40)]
PARTS = [" ".join(SAID[:15]), " ".join(SAID[15:16]), "* " + " ".join(SAID[16:18]), " ".join(SAID[18:])]
KEPT = [PARTS[0], PARTS[1], PARTS[3]]  # one begins as a list does


def test_whole_texts(spark, tmp_path):
    rows = [(1, "\n\n".join(PARTS), "en", "src 2"), (2, None, "en", "src 1"), (3, "", "en", "src 1"), (4, "Too short. Odd", "en", "src 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    # brute force: where each line's twelfth words are, and which sentence has them
    said, want = [x for x in SAID if x not in SAID[16:18]], []
    for part in KEPT:
        for m in list(re.finditer(r"\S+", part))[11::12]:
            k = max(i for i, s in enumerate(said) if s in part and part.index(s) <= m.start())
            begin = m.start() - part.index(said[k])
            want.append((k + 1, said[k], begin, begin + len(m.group())))
    for name in ("sentence_links", "extract_links"):
        got = run(name)
        assert {r["linkTarget"] for r in got} == {"http://en.wikipedia.org/wiki/Src_2"}
        assert sorted((r["sentenceOrder"], r["sentence"], r["linkBegin"], r["linkEnd"]) for r in got) == want, name
    spans = {r["title"]: r for r in run("annotated_spans")}
    assert set(spans) == {"1", "2", "3", "4"}
    assert spans["1"]["paragraphs"].split("\n") == KEPT and spans["1"]["headers"] == "src 2"
    merged = {r["title"]: r["merged"] for r in run("merge_spans")}
    assert merged["1"].count("<START:link>") == len(want)
    plain = re.sub(r"<START:link>|<END>", "", merged["1"])
    assert re.sub(r"\s", "", plain) == re.sub(r"\s", "", "src 2" + "".join(KEPT))
    context = {r["id"]: r["text"] for r in run("entity_contexts")}
    assert context == {"http://en.wikipedia.org/wiki/Src_2": " ".join(dict.fromkeys(s for _, s, *_ in want))}
    typed = run("ner_corpus")
    assert sorted(r["sentenceOrder"] for r in typed) == sorted({k for k, *_ in want}) and all("<START:drug>" in r["annotated"] for r in typed)
    assert run("ner_corpus_of_one_type") == []
