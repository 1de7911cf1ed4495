import re

import numpy as np

from corpusforge.llm import secrets as S

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy():
    rows = S.labelled_findings(600, seed=77)
    score = S.trained().score(np.array([S.features(t, f, p) for t, f, p, _ in rows]))
    y = np.array([r[3] for r in rows])
    assert ((score >= 0.5) == y).mean() > 0.95


def test_score_is_the_mean_of_the_leaves():
    f = S.trained()
    rows = S.labelled_findings(20, seed=3)
    x = np.array([S.features(t, c, p) for t, c, p, _ in rows])
    for r, s in zip(x, f.score(x), strict=True):
        total = 0.0
        for feature, cut, child, value in f.trees:
            at = 0
            while feature[at] >= 0:
                at = child[at][int(r[feature[at]] > cut[at])]
            total += value[at]
        assert abs(total / len(f.trees) - s) < 1e-6


def test_sieve_lets_all_candidates_pass():
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = [t for t, *_ in S.labelled_findings(300, seed=8)] + ["a" * 14 + "1" + "b" * 9, "1" + "a" * 15, "a" * 40 + "7", "x" * 15 + "1"]
    hit = pc.match_substring_regex(pa.array(texts), S._SIEVE).to_pylist()
    assert all(h or not S.candidates(t) for h, t in zip(hit, texts, strict=True))


def test_planted_tokens_and_plain_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"] for r in docs.collect() if re.search(r'token = "[0-9a-f]{40}"', r["text"])}
    got = {r["doc_id"] for r in S.scan_secrets(docs, "source").collect()}
    assert want and got == want


def test_redaction_keeps_rows_and_columns(spark):
    key = "ghp_" + "aB3dE5fG7h" * 3
    rows = [(1, f'token = "{key}" x', 5, "s", 1), (1, f'token = "{key}" x', 5, "s", 1), (2, None, 5, "s", 1), (3, "", 5, None, 1), (None, "plain words " * 20_000, 5, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string, score int")
    out = S.redact_secrets(docs, "source")
    assert out.columns == docs.columns
    got = out.collect()
    assert [r["text"] for r in got][:2] == ['token = "[secret]" x'] * 2 and got[0]["n_chars"] == 20
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == rows[4][1]
    assert S.redact_secrets(docs.limit(0), "source").count() == 0
    assert S.scan_secrets(docs.limit(0)).count() == 0


def test_findings_that_the_generator_did_not_make():
    from .findings import findings

    found = [(bool(S.find_secrets(t, None, S.trained())), y) for t, y in findings()]
    hits = sum(f and y for f, y in found)
    precision, recall = hits / max(1, sum(f for f, _ in found)), hits / sum(y for _, y in found)
    print(f"precision {precision:.2f} recall {recall:.2f}", [t for (f, y), (t, _) in zip(found, findings(), strict=True) if f != bool(y)])
    assert precision >= 0.8 and recall >= 0.8


def plain_features(text, f, path):
    """The features again, one by one."""
    import math
    from collections import Counter

    words, log_p, longest = S._dictionary(S.VOCAB_FILE)
    v = text[f.begin : f.end]
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in v]
    n, count, low = len(v), Counter(v), v.lower()
    pairs = [log_p[ord(a) if ord(a) < 128 else 63, ord(b) if ord(b) < 128 else 63] for a, b in zip(low, low[1:])]
    covered, i = 0, 0
    while i < n:
        size = next((k for k in range(longest, 3, -1) if i + k <= n and low[i : i + k] in words), 0)
        covered, i = covered + size, i + (size or 1)
    spans = [m.span() for m in re.finditer(r"[A-Za-z_]\w*", text)]
    before = [text[a:z].lower() for a, z in spans if z <= f.begin][-3:]
    after = [text[a:z].lower() for a, z in spans if a >= f.end][:2]
    near = text[max(0, f.begin - 4) : f.begin]
    marks = ("example", "your", "changeme", "xxxx", "placeholder", "0000", "1234", "sample", "dummy", "${", "{{")
    return [
        n, *[kind.count(k) / n for k in "dulo"], len(count) / n, -sum(c / n * math.log2(c / n) for c in count.values()),
        sum(a != b for a, b in zip(kind, kind[1:])) / max(n - 1, 1), sum(pairs) / len(pairs) if pairs else 0, all(c in "0123456789abcdefABCDEF" for c in v),
        covered / n, max(map(len, re.findall("[A-Za-z]+", v)), default=0), "=" in near or ":" in near, near[-1:] in ("'", '"') and near != "",
        any(w in S._GOOD_WORDS for w in before), any(w in S._BAD_WORDS for w in before), any(w in S._BAD_WORDS for w in after), bool(S._PREFIX.match(v)),
        any(m in low for m in marks), bool(path and S._PATH_BAD.search(path)), bool(path and S._PATH_GOOD.search(path)), v.count("-") / n, v.isdigit(),
    ]


def test_features_against_plain_python():
    from .findings import findings

    rows = [(t, c, p) for t, c, p, _ in S.labelled_findings(200, seed=21)] + [(t, c, "conf/x") for t, _ in findings() for c in S.candidates(t)]
    rows += [(t, c, None) for t in ["w" * 300 + " token: " + "internationalization" * 2 + "1", "1" * 16 + " " + "é1" * 20, "Ab1" * 6] for c in S.candidates(t)]
    for t, c, p in rows:
        assert np.allclose(S.features(t, c, p), np.array(plain_features(t, c, p), float), atol=1e-9), t


def test_long_words_count_whole():
    words, _, longest = S._dictionary(S.VOCAB_FILE)
    w = max(words, key=lambda x: (len(x), x))
    assert longest == len(w) > 14 and S._covered(w + "1", words, longest) > 0.9
    long = "a" * 500
    text = f"{long} = 'zzzzzz1'; {long} {long}"
    f = S.Finding(text.index("zz"), text.index("1") + 1, "given")
    assert S.neighbours(text, f) == ([long], [long, long])


def test_time_grows_with_the_length():
    import time

    began = time.process_time()
    S.find_secrets("1234567890123456 " * 20_000, None, S.trained())
    assert time.process_time() - began < 120  # a square of the length takes hours


def test_candidates_of_the_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted((r["doc_id"], r["begin"], r["end"], r["rule"], r["score"]) for r in S.op5_secrets(spark, SF).collect())
    want = sorted((d["doc_id"], *f, s) for d in docs for f, s in S.find_secrets(d["text"], d["source"], S.trained()))
    assert got == want
