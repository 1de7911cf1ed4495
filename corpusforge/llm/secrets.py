"""Operator 5: secret scans whose false positives a random forest removes.

Patterns propose candidates; a forest over a candidate's length, the transitions
between its characters, how much of it dictionary words cover, the path it comes
from and its neighbouring words tells credentials from digests, identifiers,
placeholders and long words. It is trained here, on labelled findings.
"""

from __future__ import annotations

import base64
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table
from .token_output import VOCAB_FILE

#: A private key block, a value given to a credential's name, or a long run with a digit.
_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)
_GIVEN = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\s*[:=]\s*[\"']?([^\s\"'<>,;]{6,})")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}")
#: What any candidate has, for RE2: a first sieve over texts.
_SIEVE = r"PRIVATE KEY-----|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\s*[:=]|[0-9][A-Za-z0-9+/_-]{15}|[A-Za-z0-9+/_-]{15}[0-9]|" + "|".join(
    f"[A-Za-z+/_-]{{{k}}}[0-9][A-Za-z0-9+/_-]{{{15 - k}}}" for k in range(1, 15)
)
_GOOD_WORDS = {"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "access_key", "credential", "credentials", "auth", "bearer", "authorization", "login"}
_BAD_WORDS = {"sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "id", "etag", "revision", "example", "sample", "dummy", "fake", "test", "integrity", "color", "version", "isbn", "phone", "card", "order"}
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abpr]-|glpat-|AIza|eyJ|-----BEGIN")
_PATH_BAD = re.compile(r"(?i)test|example|sample|fixture|mock|doc|lock|vendor")
_PATH_GOOD = re.compile(r"(?i)conf|env|secret|deploy|settings|credential|prod")

FEATURES = [
    "length", "digits", "upper", "lower", "other", "distinct", "entropy", "transitions", "likelihood", "hex", "dictionary", "longest_run",
    "given", "quoted", "good_before", "bad_before", "bad_after", "prefix", "placeholder", "path_bad", "path_good", "dashes", "digits_only",
]


class Finding(NamedTuple):
    begin: int
    end: int
    rule: str


def candidates(text: str) -> list[Finding]:
    """Spans in text order that do not overlap; blocks before values before runs."""
    found: list[Finding] = []
    for rule, regex, group in (("block", _BLOCK, 0), ("given", _GIVEN, 1), ("run", _RUN, 0)):
        found += [Finding(*m.span(group), rule) for m in regex.finditer(text)]
    kept: list[Finding] = []
    for f in sorted(found):
        if not kept or f.begin >= kept[-1].end:
            kept.append(f)
        elif f.end > kept[-1].end:
            kept[-1] = Finding(kept[-1].begin, f.end, kept[-1].rule)
    return kept


@lru_cache(maxsize=2)
def _dictionary(vocab_file: str) -> tuple[frozenset[str], np.ndarray, int]:
    """Words of four letters and more in a tokenizer's vocabulary, the log
    probabilities of one character class-letter after another in them, and the
    length of the longest."""
    with open(vocab_file, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]).strip() for line in f]
    words = {t.decode().lower() for t in tokens if len(t) >= 4 and t.isalpha() and t.isascii()}
    seen = np.full((128, 128), 0.05)
    for w in words:
        for a, b in zip(w, w[1:], strict=False):
            seen[ord(a), ord(b)] += 1
    return frozenset(words), np.log(seen / seen.sum(axis=1, keepdims=True)), max(map(len, words), default=0)


def _covered(text: str, words: frozenset[str], longest: int) -> float:
    """The share of the letters that words of the dictionary cover, longest first."""
    at = total = 0
    low = text.lower()
    while at < len(low):
        for n in range(min(longest, len(low) - at), 3, -1):
            if low[at : at + n] in words:
                total += n
                at += n
                break
        else:
            at += 1
    return total / max(len(low), 1)


_WORD = re.compile(r"[A-Za-z_]\w*")


@lru_cache(maxsize=2)
def _word_places(text: str) -> tuple[list[int], list[int]]:
    """Begins and ends of all words of a text; found once for all its findings."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [a for a, _ in spans], [z for _, z in spans]


def neighbours(text: str, f: Finding, before: int = 3, after: int = 2) -> tuple[list[str], list[str]]:
    """The last whole words before a finding and the first after it."""
    begins, ends = _word_places(text)
    i, j = bisect_right(ends, f.begin), bisect_left(begins, f.end)
    return [text[begins[k] : ends[k]] for k in range(max(0, i - before), i)], [text[begins[k] : ends[k]] for k in range(j, min(j + after, len(begins)))]


def features(text: str, f: Finding, path: str | None, vocab_file: str = VOCAB_FILE) -> list[float]:
    words, log_p, longest = _dictionary(vocab_file)
    value = text[f.begin : f.end]
    n = len(value)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    count = [kinds.count(k) / n for k in range(4)]
    _, each = np.unique(np.array(list(value)), return_counts=True)
    p = each / n
    codes = np.frombuffer(value.lower().encode("ascii", "replace"), np.uint8)
    runs = re.findall(r"[A-Za-z]+", value)
    before, after = neighbours(text, f)
    near = text[max(0, f.begin - 4) : f.begin]
    low = value.lower()
    return [
        float(n),
        *count,
        len(each) / n,
        float(-(p * np.log2(p)).sum()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1),
        float(log_p[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        _covered(value, words, longest),
        float(max(map(len, runs), default=0)),
        float("=" in near or ":" in near),
        float(near[-1:] in ('"', "'")),
        float(any(w.lower() in _GOOD_WORDS for w in before)),
        float(any(w.lower() in _BAD_WORDS for w in before)),
        float(any(w.lower() in _BAD_WORDS for w in after)),
        float(bool(_PREFIX.match(value))),
        float(any(x in low for x in ("example", "your", "changeme", "xxxx", "placeholder", "0000", "1234", "sample", "dummy", "${", "{{"))),
        float(bool(path and _PATH_BAD.search(path))),
        float(bool(path and _PATH_GOOD.search(path))),
        value.count("-") / n,
        float(value.isdigit()),
    ]


# --- labelled findings --------------------------------------------------------


def labelled_findings(n: int = 2400, seed: int = 5) -> list[tuple[str, Finding, str | None, int]]:
    """(text, finding, path, 1 for a true secret), made by rule with a seed.

    Credentials of common forms in assignments, headers and prose, against
    digests, identifiers, numbers, placeholders, paths and long words.
    """
    rng = random.Random(seed)
    words, *_ = _dictionary(VOCAB_FILE)
    pool = sorted(w for w in words if len(w) <= 9)
    hexa, letters = "0123456789abcdef", string.ascii_letters + string.digits

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    def prose(k: int) -> str:
        # half of it invented, so that no language is learnt
        return " ".join(rng.choice(pool) if rng.random() < 0.5 else some("etaoinshrdlu", 2, 9) for _ in range(k))

    made = []
    while len(made) < n:
        true = rng.random() < 0.5
        if true:
            kind = rng.randrange(6)
            value = [
                lambda: some(hexa, 32, 64),
                lambda: some(letters, 20, 48),
                lambda: some(letters + "+/", 40, 44),
                lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16),
                lambda: rng.choice(["ghp_", "sk-", "xoxb-", "glpat-"]) + some(letters, 24, 40),
                lambda: some(letters + "!#%&*", 10, 18),
            ][kind]()
            name = rng.choice(["token", "api_key", "apikey", "secret", "password", "access_key", "auth_token", "client_secret", "SECRET_KEY"])
            lead = rng.choice([f'{name} = "', f"{name}: ", f"{name}=", f"'{name}': '", f"Authorization: Bearer {''}", f"{name} "]) if kind != 5 else rng.choice([f'{name} = "', f"{name}: "])
            if kind in (3, 4) and rng.random() < 0.3:
                lead = ""
            path = rng.choice([None, None, "src3", "conf/app.env", "deploy/prod.yml", "src/main.py", "tests/data.txt"])
        else:
            kind = rng.randrange(9)
            value = [
                lambda: some(hexa, 32, 64),
                lambda: "-".join(some(hexa, k, k) for k in (8, 4, 4, 4, 12)),
                lambda: some(string.digits, 16, 20),
                lambda: rng.choice(["your_api_key_here_1", "EXAMPLE0000000000000", "changeme1234changeme", "xxxxxxxxxxxx0000", "sample-token-1234567", "dummy_secret_value_0"]),
                lambda: "/".join(rng.choice(pool) for _ in range(4)) + f"/v{rng.randint(1, 20)}",
                lambda: "".join(rng.choice(pool) for _ in range(3)) + str(rng.randint(1, 99)),
                lambda: "_".join(rng.choice(pool) for _ in range(3)) + str(rng.randint(1, 99)),
                lambda: f"20{rng.randint(10, 26)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{rng.choice(pool)}-{rng.choice(pool)}",
                lambda: some("etaoinshrdlu", 14, 22) + some(string.digits, 1, 2),
            ][kind]()
            if kind == 0:
                lead = rng.choice(["sha256: ", "commit ", "md5 = ", 'checksum = "', "digest: ", "etag: ", "integrity: ", "revision "])
            elif kind == 1:
                lead = rng.choice(["uuid: ", "id = ", "guid ", "request id "])
            elif kind == 3:
                lead = rng.choice(['token = "', "api_key: ", "password: ", "secret="])
            elif kind in (4, 6) and rng.random() < 0.3:
                lead = rng.choice(["token = ", "key: ", "secret_name: "])
            else:
                lead = rng.choice(["", "", "see ", "file ", "order ", "card "])
            path = rng.choice([None, None, "src3", "package.lock", "tests/data.txt", "docs/readme.md", "src/main.py", "conf/app.env"])
        head = prose(rng.randint(0, 8))
        head = head + " " if head else ""
        text = f"{head}{lead}{value}" + ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "") + " " + prose(rng.randint(0, 6))
        begin = len(head) + len(lead)
        hit = next((c for c in candidates(text) if c.begin <= begin < c.end), None)
        if hit:
            made.append((text, hit, path, int(true)))
    return made


# --- the forest ---------------------------------------------------------------


class RandomForest:
    """Gini trees on bootstrap samples, a random subset of features a split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 12, leaf: int = 3, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, leaf, rng))

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, depth: int, leaf: int, rng: np.random.Generator):
        feature, cut, child, value = [], [], [], []
        tried = max(2, int(np.sqrt(x.shape[1])) + 1)

        def node(rows: np.ndarray, at: int) -> int:
            k = len(feature)
            feature.append(-1)
            cut.append(0.0)
            child.append((k, k))
            value.append(y[rows].mean())
            if at == depth or len(rows) < 2 * leaf or value[k] in (0.0, 1.0):
                return k
            best = (len(rows) * value[k] * (1 - value[k]) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], tried, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows[order], f], np.cumsum(y[rows[order]])
                n = np.arange(1, len(rows) + 1)
                ok = np.flatnonzero(v[1:] > v[:-1])
                ok = ok[(ok + 1 >= leaf) & (len(rows) - ok - 1 >= leaf)]
                if not len(ok):
                    continue
                a, na, b, nb = t[ok], n[ok], t[-1] - t[ok], len(rows) - n[ok]
                cost = a * (1 - a / na) + b * (1 - b / nb)
                i = int(np.argmin(cost))
                if cost[i] < best[0]:
                    best = (float(cost[i]), int(f), float((v[ok[i]] + v[ok[i] + 1]) / 2))
            if best[1] >= 0:
                feature[k], cut[k] = best[1], best[2]
                left = x[rows, best[1]] <= best[2]
                child[k] = (node(rows[left], at + 1), node(rows[~left], at + 1))
            return k

        node(np.arange(len(x)), 0)
        return np.array(feature), np.array(cut), np.array(child), np.array(value)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean share of true findings in the leaves."""
        total = np.zeros(len(x))
        for feature, cut, child, value in self.trees:
            at, moving = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(moving):
                f = feature[at[moving]]
                moving, f = moving[f >= 0], f[f >= 0]
                here = at[moving]
                at[moving] = child[here, (x[moving, f] > cut[here]).astype(np.int64)]
            total += value[at]
        return np.round(total / len(self.trees), 6)


@lru_cache(maxsize=1)
def trained(seed: int = 5) -> RandomForest:
    rows = labelled_findings(seed=seed)
    return RandomForest(np.array([features(t, f, p) for t, f, p, _ in rows]), np.array([y for *_, y in rows], float))


def find_secrets(text: str, path: str | None, forest: RandomForest, threshold: float = 0.5) -> list[tuple[Finding, float]]:
    found = candidates(text)
    if not found:
        return []
    score = forest.score(np.array([features(text, f, path) for f in found]))
    return [(f, float(s)) for f, s in zip(found, score, strict=True) if s >= threshold]


def scan_secrets(docs: DataFrame, path: str | None = None, threshold: float = 0.5, forest: RandomForest | None = None) -> DataFrame:
    """doc_id, begin, end, rule, score: one row for each secret found.

    begin and end are characters of the text. `path` names the column with the
    place a document comes from (none: unknown). Null and empty texts hold none,
    repeated rows repeat their findings; other columns of docs are ignored.
    """
    model = forest or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out = []
            maybe = pc.match_substring_regex(b.column(1), _SIEVE).fill_null(False).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(maybe).tolist():
                out += [(i, *f, s) for f, s in find_secrets(b.column(1)[i].as_py(), b.column(2)[i].as_py(), model, threshold)]
            at = pa.array([o[0] for o in out], pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array([o[k + 1] for o in out], t) for k, t in enumerate(kinds))], names=["doc_id", "begin", "end", "rule", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, begin long, end long, rule string, score double"
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    return docs.select("doc_id", F.col("text").cast("string").alias("t"), where.alias("p")).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, path: str | None = None, threshold: float = 0.5, new: str = "[secret]") -> DataFrame:
    """docs with each secret in the text replaced; a column n_chars follows.

    All rows and columns stay, in their order; null texts stay null.
    """
    model = trained()
    names = [f"c{k}" for k in range(len(docs.columns))]
    low = [c.lower() for c in docs.columns]
    at, where = low.index("text"), low.index(path.lower()) if path else None
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            col = b.column(at)
            maybe = pc.match_substring_regex(col, _SIEVE).fill_null(False).to_numpy(zero_copy_only=False)
            texts = {}
            for i in np.flatnonzero(maybe).tolist():
                text = col[i].as_py()
                for f, _ in reversed(find_secrets(text, b.column(where)[i].as_py() if where is not None else None, model, threshold)):
                    text = text[: f.begin] + new + text[f.end :]
                texts[i] = text
            if texts:
                mask = pa.array(maybe)
                col = pc.replace_with_mask(col, mask, pa.array([texts[i] for i in sorted(texts)], col.type))
            yield pa.RecordBatch.from_arrays([col if k == at else c for k, c in enumerate(b.columns)], names=names)

    out = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), path="source")


QUERIES = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {}
