"""Operator 9: token counts that follow edits of the documents.

Each document keeps a segment tree over its pre-token units (a white-space run
with the word after it): leaves hold a unit's characters and tokens, inner nodes
the sums of two children. An edit is a span of characters to replace. The tree
finds the units that the span touches; they and one unit of context on either
side are cut and encoded anew, all other counts stand. Sums are then updated on
the way up from the changed leaves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialise, slices, table
from .token_output import VOCAB_FILE, UnitEncoder, pack_rows, unpack

#: Units: the same cut as UnitEncoder makes; the first may lack white space.
_UNIT = re.compile(r"[ \t\n\r\f\x0b]*[^ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+")
#: White space beyond ASCII may join units: such texts are one unit.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

#: What the registered query edits: e-mail addresses, digit groups and quoted keys.
REDACTED = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b\d{12,19}\b|\"[0-9a-f]{32,}\""


class SegmentTree:
    """Sums of two values (characters, tokens) over a sequence of units.

    Level 0 has the leaves; each level above sums pairs of the one below. A
    splice rewrites the touched leaves and, above, only nodes over leaves from
    the first changed on where the number of units changed, else those over them.
    """

    def __init__(self, leaves: np.ndarray) -> None:
        self.levels = [leaves.astype(np.int64).reshape(-1, 2)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self._above(self.levels[-1], 0))

    @staticmethod
    def _above(level: np.ndarray, start: int) -> np.ndarray:
        part = level[start:]
        if len(part) % 2:
            part = np.concatenate([part, np.zeros((1, 2), np.int64)])
        return part[0::2] + part[1::2]

    @property
    def total(self) -> tuple[int, int]:
        top = self.levels[-1]
        return (int(top[0, 0]), int(top[0, 1])) if len(top) else (0, 0)

    def find(self, chars: int) -> tuple[int, int]:
        """(the unit that holds character number `chars`, where it begins).

        Beyond the end: the number of units and of characters.
        """
        if chars >= self.total[0]:
            return len(self.levels[0]), self.total[0]
        at, before = 0, 0
        for level in self.levels[-2::-1]:
            at *= 2
            here = int(level[at, 0])
            if chars - before >= here:
                before += here
                at += 1
        return at, before

    def splice(self, start: int, stop: int, leaves: np.ndarray) -> None:
        leaves = leaves.astype(np.int64).reshape(-1, 2)
        base = self.levels[0]
        if len(leaves) == stop - start:
            base[start:stop] = leaves
            low, high = start, max(stop, start + 1)
            for k in range(1, len(self.levels)):
                low, high = low // 2, -(-high // 2)
                below = self.levels[k - 1][2 * low : 2 * high]
                self.levels[k][low:high] = self._above(below, 0)
            return
        levels = [np.concatenate([base[:start], leaves, base[stop:]])]
        first, k = start, 1
        while len(levels[-1]) > 1:
            first //= 2
            old = self.levels[k][:first] if k < len(self.levels) else np.zeros((0, 2), np.int64)
            first = len(old)
            levels.append(np.concatenate([old, self._above(levels[-1], 2 * first)]))
            k += 1
        self.levels = levels


class CountedText:
    """A text with its tree; edit() keeps the number of tokens right."""

    def __init__(self, text: str, encoder: UnitEncoder, leaves: np.ndarray | None = None) -> None:
        self.encoder, self.text, self.reencoded = encoder, text, 0
        self.tree = SegmentTree(self._leaves(text) if leaves is None else leaves)

    def _leaves(self, part: str) -> np.ndarray:
        if not part:
            return np.zeros((0, 2), np.int64)
        units = [part] if _WIDE.search(part) else _UNIT.findall(part)
        counts = self.encoder.unit_counts(units)
        return np.array([[len(u), c] for u, c in zip(units, counts, strict=True)], np.int64)

    @property
    def n_tokens(self) -> int:
        return self.tree.total[1]

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replace characters begin..end; out of range is cut to the text."""
        size = len(self.text)
        begin = min(max(begin, 0), size)
        end = min(max(end, begin), size)
        changed = self.text[:begin] + new + self.text[end:]
        if _WIDE.search(new) or _WIDE.search(self.text, max(begin - 1, 0), end + 1):
            self.text = changed
            leaves = self._leaves(changed)
            self.reencoded += len(changed)
            self.tree = SegmentTree(leaves)
            return
        first, low = self.tree.find(begin)
        if first and begin == low:  # the unit before may join what comes in
            first -= 1
            low -= int(self.tree.levels[0][first, 0])
        elif first == len(self.tree.levels[0]) and first:
            first -= 1
            low -= int(self.tree.levels[0][first, 0])
        last, high = self.tree.find(end)
        n = len(self.tree.levels[0])
        if last < n:  # the unit touched at the end, and the boundary it makes
            high += int(self.tree.levels[0][last, 0])
            last += 1
        self.text = changed
        part = changed[low : high + len(new) - (end - begin)]
        self.reencoded += len(part)
        self.tree.splice(first, last, self._leaves(part))


EDITS = "array<struct<begin:int,end:int,new:string>>"


def _stored(leaves: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Trees as binaries: number of values, control bytes, data bytes."""
    control, data, c, d = pack_rows(leaves.ravel().astype(np.uint32), edge * 2)
    parts = [
        np.array([2 * (edge[i + 1] - edge[i])], "<u4").tobytes() + control[c[i] : c[i + 1]].tobytes() + data[d[i] : d[i + 1]].tobytes()
        for i in range(len(edge) - 1)
    ]
    return pa.array(parts, pa.binary())


def _loaded(tree: bytes) -> np.ndarray:
    n = int(np.frombuffer(tree[:4], "<u4")[0])
    split = 4 + -(-n // 4)
    return unpack(tree[4:split], tree[split:], n).reshape(-1, 2).astype(np.int64)


def build_trees(docs: DataFrame, vocab_file: str = VOCAB_FILE, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, n_tokens, tree: the state that edits are applied to.

    One row for each row of docs; a null text counts as empty and stays null.
    The tree holds its leaves, 2.5 bytes or so a unit; sums are made in reading.
    Columns named in `keep` come along, all others are ignored; none of them
    may have the name of one of the four. An empty table gives an empty one.
    """
    more = keep or []
    if clash := {"doc_id", "text", "n_tokens", "tree"} & {c.lower() for c in more}:
        raise ValueError(f"columns that the state has itself: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(vocab_file)
        for b in slices(batches, 1):
            leaves, edge = encoder.leaves(b.column(1))
            total = np.concatenate([[0], np.cumsum(leaves[:, 1])])
            made = [b.column(0), b.column(1), pa.array(np.diff(total[edge])), _stored(leaves, edge), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "text", "n_tokens", "tree", *more])

    plain = docs.select("doc_id", F.col("text").cast(T.StringType()).alias("text"), *more)
    schema = T.StructType([plain.schema["doc_id"], plain.schema["text"], T.StructField("n_tokens", T.LongType()), T.StructField("tree", T.BinaryType()), *plain.schema.fields[2:]])
    return plain.mapInArrow(run, schema)


def _edited(texts: pa.Array, todo: list[tuple[int, list]], encoder: UnitEncoder, leaves: Callable[[int], np.ndarray]) -> Iterator[tuple[int, CountedText, int]]:
    """(row, text after its edits, how many they were) of rows that have edits."""
    for i, listed in todo:
        spans = [e for e in listed if e and e["begin"] is not None and e["end"] is not None]
        if not spans:
            continue
        doc = CountedText(texts[i].as_py() or "", encoder, leaves(i))
        stop = None
        for e in sorted(spans, key=lambda e: e["begin"], reverse=True):
            doc.edit(e["begin"], e["end"] if stop is None else min(e["end"], stop), e["new"] or "")
            stop = max(e["begin"], 0)
        yield i, doc, len(spans)


def apply_edits(state: DataFrame, edits: str | None = "edits", vocab_file: str = VOCAB_FILE, store: bool = True) -> DataFrame:
    """The state after each row's edits, with what they did.

    `edits` names a column of type EDITS: spans of characters of the text as it
    is before any of them, applied from the last begin to the first, those of
    one begin in their order in the array. A null entry, or one with a null begin
    or end, is left out; a null `new` deletes. Spans that overlap a later one
    are cut at its begin. None stands for redactions() of the text. Returns
    doc_id, text, n_tokens and tree (the new state), n_tokens_before, n_edits,
    n_chars (before) and n_reencoded, the characters that were encoded anew.
    Rows without edits pass as they are. Without `store` text and tree are not
    returned, and the tree of a row without edits is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(vocab_file)
        for b in slices(batches, 1):
            texts, before, trees = b.column(1), b.column(2).to_numpy(), b.column(3)
            if edits is None:
                todo = list(redactions(texts).items())
            else:
                n = pc.list_value_length(b.column(4)).fill_null(0).to_numpy(zero_copy_only=False)
                todo = [(i, b.column(4)[i].as_py()) for i in np.flatnonzero(n > 0).tolist()]
            after, redone, number = before.copy(), np.zeros(len(before), np.int64), np.zeros(len(before), np.int64)
            changed: dict[int, tuple[str, bytes]] = {}
            for i, doc, n in _edited(texts, todo, encoder, lambda i: _loaded(trees[i].as_py())):  # noqa: B023
                after[i], redone[i], number[i] = doc.n_tokens, doc.reencoded, n
                if store:
                    leaves = doc.tree.levels[0]
                    changed[i] = (doc.text, _stored(leaves, np.array([0, len(leaves)]))[0].as_py())
            chars = pc.utf8_length(texts).fill_null(0).cast(pa.int64())
            if changed:
                mask = np.zeros(len(before), bool)
                mask[list(changed)] = True
                texts, trees = (pc.replace_with_mask(c, pa.array(mask), pa.array([changed[i][k] for i in sorted(changed)], c.type)) for k, c in enumerate((texts, trees)))
            own = {"text": texts, "tree": trees} if store else {}
            made = {"doc_id": b.column(0), "n_tokens": pa.array(after), **own, "n_tokens_before": pa.array(before), "n_edits": pa.array(number), "n_chars": chars, "n_reencoded": pa.array(redone)}
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    kind = state.schema["doc_id"].dataType.simpleString()
    more = [F.col(edits).cast(EDITS).alias("e")] if edits else []
    schema = f"doc_id {kind}, n_tokens long, {'text string, tree binary, ' if store else ''}n_tokens_before long, n_edits long, n_chars long, n_reencoded long"
    return state.select("doc_id", "text", "n_tokens", "tree", *more).mapInArrow(run, schema)


def edited_counts(docs: DataFrame, edits: str = "edits", vocab_file: str = VOCAB_FILE) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_edits, n_chars, n_reencoded for each
    row of docs: its trees are built and written to the shared folder, the edits
    are applied to what is read from there; see apply_edits(), whose new state
    is not kept."""
    trees = materialise(build_trees(docs, vocab_file, [edits]), "trees", "zstd")
    return _counts_only(apply_edits(trees, edits, vocab_file, store=False))


def _counts_only(applied: DataFrame) -> DataFrame:
    return applied.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), "n_edits", "n_chars", "n_reencoded")


def redactions(texts: pa.Array, pattern: str = REDACTED, new: str = "[redacted]") -> dict[int, list[dict]]:
    """For each row in which the pattern (ASCII classes) stands, its matches as edits."""
    hit = pc.match_substring_regex(texts, pattern).fill_null(False).to_numpy(zero_copy_only=False)
    look = re.compile(pattern, re.ASCII)
    return {i: [{"begin": m.start(), "end": m.end(), "new": new} for m in look.finditer(texts[i].as_py())] for i in np.flatnonzero(hit).tolist()}


def with_redactions(docs: DataFrame, pattern: str = REDACTED, new: str = "[redacted]") -> DataFrame:
    """doc_id, text and an `edits` column (type EDITS): the matches of the
    pattern, replaced; null where there are none. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
        for b in slices(batches, 1):
            found = redactions(b.column(1), pattern, new)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([found.get(i) for i in range(b.num_rows)], kind)], names=["doc_id", "text", "edits"])

    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, edits {EDITS}")


def redacted_counts(docs: DataFrame, vocab_file: str = VOCAB_FILE) -> DataFrame:
    """edited_counts() of with_redactions(), whose spans are looked for in the
    pass that applies them."""
    trees = materialise(build_trees(docs, vocab_file), "trees", "zstd")
    return _counts_only(apply_edits(trees, None, vocab_file, store=False))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after redacting personal data:
    trees are built and stored, and the edits applied to the stored state."""
    return redacted_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
