"""Operator 7: maximal repeats from prefix-partitioned suffix trees.

Suffixes are those that can begin a repeat (near an anchor of another text).

*To `words` words.* Counts by two-word prefixes come first; a prefix with more
suffixes than fit is split by four words, then eight, and so on; small
neighbours share a group. A group comes sorted, which gives its subtree down to
`words` words: the nodes there (runs of equal suffixes) with their children (by
the next word) and their left words. A run of words with more places than fit
is counted by aggregation instead.

*Below.* Between two nodes at which something begins, ends or branches, all
places of a run go on alike: such stretches are the letters of what is left of
the trees, and texts are chains of them, each distinct chain once. Letters are
dealt to tasks by the least chain that has them, so that chains alike meet; a
task sorts the suffixes of its chains by prefix doubling, which gives the inner
nodes of its subtrees with their true depth.

An inner node that stands in two texts and whose left words differ is a maximal
repeat. There are no more of them than suffixes, however they lie in each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._anchors import MIN_WORDS, SEED_WORDS, near_anchors, repeated_texts, with_tid, word_counts
from ._common import SPACE_RE, Words, hash_spans, joined, materialise, slices, table, window_names

#: Suffixes that a group holds at most (some 40 bytes each), if prefixes can split it.
GROUP_SUFFIXES = 250_000
#: Letters of chains that a task gets, or so.
TASK_LETTERS = 200_000
#: Buckets of prefixes of one length: what the driver and the tasks hold of them.
_BITS = 16


def _levels(words: int) -> list[int]:
    """Lengths of prefixes, in words, up to the whole."""
    out = [min(2, words)]
    while out[-1] < words:
        out.append(min(out[-1] * 2, words))
    return out


class Prefixes:
    """The groups of suffixes by hashed prefixes of growing length.

    tables[k] has for each bucket of the k-th prefix length the group's number,
    or -1 where the next length splits it. What no length splits is of no group.
    """

    def __init__(self) -> None:
        self.tables: list[np.ndarray] = []
        self.groups = 0
        self.large = False

    def walk(self, names: list[np.ndarray]) -> np.ndarray:
        """The group, or -1, of suffixes whose buckets by length are given."""
        group = np.full(len(names[0]), -1, np.int64)
        for to, name in zip(self.tables, names, strict=False):
            left = np.flatnonzero(group < 0)
            group[left] = to[name[left]]
        return group


def _buckets(h: np.ndarray, at: np.ndarray, levels: list[int]) -> list[np.ndarray]:
    return [(window_names(h, n)[at] >> np.uint64(64 - _BITS)).astype(np.int64) for n in levels]


def split_prefixes(one: DataFrame, words: int, seed: int, most: int = GROUP_SUFFIXES) -> Prefixes:
    """Count the suffixes of all texts by prefix; split and join to groups.

    Groups hold at most `most` suffixes, or four times the mean of a bucket.
    """
    levels = _levels(words)
    trie = Prefixes()
    for depth in range(1, len(levels) + 1):

        def run(batches: Iterator[pa.RecordBatch], depth=depth) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << _BITS, np.int64)
            for b in slices(batches, 1):
                w = Words(b.column(1))
                at = near_anchors(w, b.column(2), words, seed)
                names = _buckets(w.hash, at, levels[:depth])
                total += np.bincount(names[-1][trie.walk(names) < 0], minlength=1 << _BITS)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

        got = one.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(1 << _BITS, np.int64)
        counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
        if depth == 1:
            fits = max(most, int(counts.sum()) * 4 >> _BITS)
        to, held = np.full(1 << _BITS, -1, np.int64), fits
        last = depth == len(levels)
        for bucket in np.flatnonzero(counts).tolist():
            n = int(counts[bucket])
            if n > (most if last else fits):  # nodes of one run must fit in memory whatever the groups
                continue
            if held + n > fits:
                trie.groups, held = trie.groups + 1, 0
            to[bucket] = trie.groups - 1
            held += n
        trie.tables.append(to)
        if not (counts[to < 0] > 0).any():
            return trie
    trie.large = True
    return trie


def _emit(words: int, seed: int, trie: Prefixes):
    levels = _levels(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            w = Words(b.column(1))
            at = near_anchors(w, b.column(2), words, seed)
            group = trie.walk(_buckets(w.hash, at, levels[: len(trie.tables)]))
            # words beside the suffix, in half a name each; 0 at a text's edge
            half = (w.hash >> np.uint64(32)) | np.uint64(1)
            row = w.row[at]
            left = np.where(at > w.first[row], half[np.maximum(at - 1, 0)], np.uint64(0))
            over = np.minimum(at + words, max(len(half) - 1, 0))
            right = np.where(at + words < w.first[row + 1], half[over], np.uint64(0))
            beside = (left << np.uint64(32) | right).view(np.int64)
            place = (at - w.first[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.astype(np.int32)), pa.array(window_names(w.hash, words)[at].view(np.int64)), pa.array(b.column(0).to_numpy()[row]), pa.array(place), pa.array(beside)],
                names=["group", "name", "tid", "at", "beside"],
            )

    return run


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes at which a repeat begins or ends; suffixes come sorted by name."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c.to_numpy() for c in b.columns[1:]])
        size += b.num_rows
        if size >= GROUP_SUFFIXES:
            x = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(x[0], x[0][-1]))  # the last run may go on
            held, size = [[c[cut:] for c in x]], size - cut
            if cut:
                yield from _nodes_of(*(c[:cut] for c in x))
    if size:
        yield from _nodes_of(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _nodes_of(name: np.ndarray, tid: np.ndarray, at: np.ndarray, beside: np.ndarray) -> Iterator[pa.RecordBatch]:
    beside = beside.view(np.uint64)
    right, left = beside & np.uint64(0xFFFFFFFF), beside >> np.uint64(32)
    order = np.lexsort((right, name))
    name, tid, at, left, right = name[order], tid[order], at[order], left[order], right[order]
    new = np.concatenate([[True], name[1:] != name[:-1]])
    child = new | np.concatenate([[True], right[1:] != right[:-1]])

    def of(flag: np.ndarray):
        start = np.flatnonzero(flag)
        return start, np.cumsum(flag) - 1, np.minimum.reduceat(tid, start) < np.maximum.reduceat(tid, start)

    start, node, shared = of(new)
    low, high = np.minimum.reduceat(left, start), np.maximum.reduceat(left, start)
    begins = (low != high) | (low == 0)
    low, high = np.minimum.reduceat(right, start), np.maximum.reduceat(right, start)
    ends = (low != high) | (low == 0)
    _, edge, goes_on = of(child)
    keep = np.flatnonzero(shared[node] & (begins | ends)[node])
    k, e = node[keep], edge[keep]
    on = goes_on[e] & (right[keep] != 0)
    flags = begins[k].astype(np.int8) | ends[k].astype(np.int8) << 1 | (on & ends[k]).astype(np.int8) << 2
    cols = tid[keep], at[keep], flags, name[keep], joined(name[keep].view(np.uint64), right[keep]).view(np.int64)
    for a in range(0, len(keep), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in cols], names=_NODE)


_NODE = ["tid", "at", "flags", "id", "next_id"]
_NODE_SCHEMA = "tid long, at int, flags byte, id long, next_id long"


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a next word, as the name of the run with it."""
    for b in batches:
        name, right = b.column(3).to_numpy().view(np.uint64), b.column(4).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(joined(name, right).view(np.int64))], names=_NODE)


def _large_nodes(suffixes: DataFrame) -> DataFrame:
    """_nodes() of groups that do not fit in memory: by partial sums, which are
    joined to the suffixes again."""
    rows = suffixes.withColumns({"right": F.col("beside").bitwiseAND(F.lit(0xFFFFFFFF)), "left": F.shiftrightunsigned("beside", 32)})
    child = rows.groupBy("name", "right").agg(F.min("tid").alias("c0"), F.max("tid").alias("c1"), F.min("left").alias("l0"), F.max("left").alias("l1"))
    node = child.groupBy("name").agg(F.min("c0").alias("t0"), F.max("c1").alias("t1"), F.min("l0").alias("l0"), F.max("l1").alias("l1"), F.min("right").alias("r0"), F.max("right").alias("r1"))
    begins, ends = (F.col("l0") != F.col("l1")) | (F.col("l0") == 0), (F.col("r0") != F.col("r1")) | (F.col("r0") == 0)
    node = node.filter((F.col("t0") < F.col("t1")) & (begins | ends)).select("name", begins.alias("begins"), ends.alias("ends"))
    known = child.join(node, "name").select("name", "right", "begins", "ends", ((F.col("c0") < F.col("c1")) & (F.col("right") != 0)).alias("on"))
    flags = F.col("begins").cast("int") + F.lit(2) * F.col("ends").cast("int") + F.lit(4) * (F.col("on") & F.col("ends")).cast("int")
    kept = rows.join(known, ["name", "right"]).select("tid", "at", flags.cast("byte").alias("flags"), F.col("name").alias("id"), F.col("right").alias("next_id"))
    return kept.mapInArrow(_named, _NODE_SCHEMA)


def _chains(words: int):
    """From a text's nodes to its chains of letters; rows come sorted by text
    and place. Where a letter begins and ends is counted from the chain's begin."""

    def chains(x: list[np.ndarray]) -> pa.RecordBatch:
        tid, at, flags, name, next_name, n_docs, first = x
        _, text = np.unique(tid, return_inverse=True)
        key = text.astype(np.int64) << 32 | at
        begins, goes = (flags & 1) > 0, (flags & 4) > 0
        # a place's own node comes before a child of the place before it
        begin = np.concatenate([key[begins], key[goes] + 1])
        second = np.concatenate([np.zeros(begins.sum(), np.int8), np.ones(goes.sum(), np.int8)])
        label = np.concatenate([name[begins], next_name[goes]])
        owner = np.concatenate([np.flatnonzero(begins), np.flatnonzero(goes)])
        order = np.lexsort((second, begin))
        order = order[np.concatenate([[True], begin[order][1:] != begin[order][:-1]])] if len(order) else order
        begin, label, owner = begin[order], label[order], owner[order]
        stops, far = key[(flags & 2) > 0], np.iinfo(np.int64).max
        following = np.append(begin[1:], far)[: len(begin)]
        stop = np.minimum(np.append(stops, far)[np.searchsorted(stops, begin)], following - 1)
        # whether the run with the next word stands in two texts as well
        goes_on = (following == stop + 1) & ~np.isin(stop, key[(flags & 6) == 2])
        opens = np.concatenate([[True], ~goes_on[:-1]])[: len(begin)]
        start = np.flatnonzero(opens)
        edge = np.append(start, len(begin))
        base = np.repeat(begin[start], np.diff(edge))
        here, reach = (begin - base).astype(np.int32), (stop - base + words).astype(np.int32)
        octets = np.ascontiguousarray(np.stack([label, reach], axis=1)).view(np.uint8).ravel() if len(label) else np.zeros(0, np.uint8)
        chain = hash_spans(octets, edge[:-1] * 16, edge[1:] * 16, 7).view(np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(c)) for c in (label, here, reach)]
        who = owner[start]
        return pa.RecordBatch.from_arrays(
            [pa.array(chain), *lists, pa.array(tid[who]), pa.array((begin[start] & 0xFFFFFFFF)), pa.array(n_docs[who]), first.take(pa.array(who))],
            names=["chain", "labels", "begins", "ends", "tid", "at", "n_docs", "first_doc"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x = [*(c.to_numpy() for c in b.columns[:6]), b.column(6)]
            if held is not None:
                x = [*(np.concatenate(p) for p in zip(held[:6], x[:6], strict=True)), pa.concat_arrays([held[6], x[6]])]
            cut = int(np.searchsorted(x[0], x[0][-1]))  # the last text may go on
            held = [c[cut:] for c in x]
            if cut:
                yield chains([c[:cut] for c in x])
        if held is not None:
            yield chains(held)

    return run


def _sorted_suffixes(letter: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order of all suffixes, ranks by prefixes of 1, 2, 4, ... letters).

    size: how many letters follow in the same chain, each letter's own included.
    """
    _, rank = np.unique(letter, return_inverse=True)
    levels, step = [rank], 1
    while step < size.max(initial=0):
        ahead = np.where(size > step, np.append(rank, np.zeros(step, np.int64))[step:], -1)
        _, rank = np.unique(rank * np.int64(len(rank) + 1) + ahead + 1, return_inverse=True)
        levels.append(rank)
        step *= 2
    return np.argsort(rank, kind="stable"), levels


def _common(levels: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters the suffixes a and b begin with alike."""
    short = np.minimum(size[a], size[b])
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        some = np.flatnonzero(n < short)
        x, y = a[some] + n[some], b[some] + n[some]
        # prefixes cut short by a chain's end are alike only if both are cut there
        n[some[levels[k][x] == levels[k][y]]] += 1 << k
    return np.minimum(n, short)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner nodes of the subtrees of one task, and for each of its suffixes the
    deepest that stands in two texts."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    part = pa.Table.from_batches(got).combine_chunks()
    lists = [c.chunk(0) if c.num_chunks else c.combine_chunks() for c in (part.column(k) for k in ("labels", "begins", "ends", "own"))]
    count = np.diff(np.asarray(lists[0].offsets))
    edge = np.cumsum(count) - count
    letter, begin, end = (x.flatten().to_numpy() for x in lists[:3])
    chain = np.repeat(np.arange(len(count)), count)
    size = (edge + count)[chain] - np.arange(len(chain))
    skipped = part.column("skipped").to_numpy()
    own = lists[3].flatten().to_numpy() - np.repeat(skipped, np.diff(np.asarray(lists[3].offsets))) + np.repeat(edge, np.diff(np.asarray(lists[3].offsets)))
    order, levels = _sorted_suffixes(letter, size)
    mine = np.zeros(len(letter), bool)
    mine[own] = True
    order = order[mine[order]]
    common = np.append(_common(levels, size, order[:-1], order[1:]), 0)
    left = np.where(np.arange(len(letter)) > edge[chain], np.append(letter[:1], letter[:-1])[: len(letter)], 0)
    opens = (np.arange(len(letter)) == edge[chain]) & (skipped == 0)[chain]
    before = part.column("before").to_numpy()
    left = np.where((np.arange(len(letter)) == edge[chain]) & ~opens, before[chain], left)
    chain_id, low, high, weight = (part.column(k).to_numpy()[chain] for k in ("chain", "low", "high", "weight"))
    first, first_at = part.column("first_doc").to_pylist(), part.column("first_at").to_numpy()
    number = np.arange(len(letter)) - edge[chain] + skipped[chain]

    nodes: list[tuple] = []
    deepest: list[tuple] = []
    # depth, a suffix, places, least and greatest text, a left letter, whether left letters differ, first place, suffixes that wait
    stack: list[list] = []

    def close(node: list) -> None:
        depth, at, places, t0, t1, _, differ, place, waiting = node
        if t0 < t1:
            n = int(end[at + depth - 1] - begin[at])
            deepest.extend((int(chain_id[w]), int(number[w]), int(begin[w]), n, places, *place[1:]) for w in waiting)
            node[8] = []
            if differ:
                nodes.append((None, None, None, n, places, *place[1:]))

    def merge(into: list, node: list) -> None:
        into[2] += node[2]
        into[3], into[4] = min(into[3], node[3]), max(into[4], node[4])
        into[6] = into[6] or node[6] or into[5] != node[5]
        into[7] = min(into[7], node[7])
        if node[8]:
            into[8] += node[8]

    for at, after in zip(order.tolist(), common.tolist(), strict=True):
        c = int(chain[at])
        leaf = [int(size[at]), at, int(weight[at]), int(low[at]), int(high[at]), int(left[at]), bool(opens[at]), (first[c] is None, first[c], int(first_at[c] + begin[at])), [at]]
        if stack and stack[-1][0] == leaf[0]:
            merge(stack[-1], leaf)
        else:
            stack.append(leaf)
        while stack and stack[-1][0] > after:
            node = stack.pop()
            close(node)
            if after and (not stack or stack[-1][0] < after):
                stack.append([after, *node[1:]])
            elif stack:
                merge(stack[-1], node)
    kind = part.schema.field("first_doc").type
    for rows in (nodes, deepest):
        for a in range(0, len(rows), 50_000):
            cols = list(zip(*rows[a : a + 50_000], strict=True))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), kind, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["chain", "number", "begin", "n_words", "n_occurrences", "first_doc_id", "first_at"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains from the first letter on that a task owns."""
    for b in batches:
        own = b.column(1)
        edge = np.asarray(own.offsets)
        start = np.minimum.reduceat(own.flatten().to_numpy(), edge[:-1] - edge[0]) if b.num_rows else np.zeros(0, np.int32)
        cols = []
        lists = b.schema.get_field_index("labels")
        flat_edge = np.asarray(b.column(lists).offsets).astype(np.int64)
        flat_edge = flat_edge - flat_edge[0]
        size = np.diff(flat_edge) - start
        new = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(new[-1]) - np.repeat(new[:-1] - flat_edge[:-1] - start, size)
        flat = b.column(lists).flatten().to_numpy()
        for k, c in enumerate(b.columns):
            cols.append(pa.ListArray.from_arrays(pa.array(new.astype(np.int32)), pa.array(c.flatten().to_numpy()[at])) if lists <= k < lists + 3 else c)
        before = flat[np.maximum(flat_edge[:-1] + start - 1, 0)] if len(flat) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*cols, pa.array(start.astype(np.int32)), pa.array(before)], names=[*b.schema.names, "skipped", "before"])


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a chain's repeats (sorted by place), those that lie in no longer one."""
    last, reach = None, 0
    for b in batches:
        chain = b.column(0).to_numpy()
        end = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
        before, same = np.append(reach, end[:-1])[: len(end)], np.append(False, chain[1:] == chain[:-1])[: len(chain)]
        if len(chain):
            same[0] = chain[0] == last
            last, reach = chain[-1], end[-1]
        yield b.filter(pa.array(~same | (end > before)))


def maximal_repeats(docs: DataFrame, words: int = MIN_WORDS, seed: int = SEED_WORDS, most: int = GROUP_SUFFIXES, letters: int = TASK_LETTERS) -> DataFrame:
    """doc_id, begin_word, n_words, n_occurrences, first_doc_id.

    A maximal repeat is a run of `words` words and more that stands in two
    different texts, and whose places do not all have the same word to the left
    nor all the same to the right (a text's edge differs from anything). Each
    has a row for its first place (in the least doc_id, there the first), so
    repeats that lie in others are all there; beyond, each document has a row
    for every place of a repeat that lies in no longer repeat of the document.
    All further places follow: they are those of a longer one's row moved.

    A text that several documents have whole is a repeat too, and the longest of
    all in it. n_occurrences counts all places by documents; first_doc_id is the
    least doc_id with the repeat; words count from 0.

    Null, empty and shorter texts have no repeat; rows alike in doc_id and text
    count once; other columns are ignored; an empty table gives an empty one.
    Left and right words are compared by 31-bit hashes, runs by 64-bit ones.
    """
    if not 0 < seed <= words:
        raise ValueError("seed must be 1..words")
    texts = with_tid(docs)
    counts = materialise(word_counts(texts), "word-counts")
    rows = counts.filter(F.col("n_words") >= words).distinct()
    by_text = rows.groupBy("tid").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.first("n_words").alias("n_words"))
    one = repeated_texts(texts, counts, words, seed)
    trie = split_prefixes(one, words, seed, most)
    suffixes = one.mapInArrow(_emit(words, seed, trie), "group int, name long, tid long, at int, beside long")
    fits = suffixes.filter("group >= 0").repartitionById(max(trie.groups, 1), "group").sortWithinPartitions("name")
    nodes = fits.mapInArrow(_nodes, _NODE_SCHEMA)
    if trie.large:
        nodes = nodes.unionByName(_large_nodes(suffixes.filter("group < 0")))
    nodes = nodes.join(by_text.select("tid", "n_docs", "first_doc"), "tid").select(*_NODE, "n_docs", "first_doc").repartition("tid").sortWithinPartitions("tid", "at")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chain long, labels array<long>, begins array<int>, ends array<int>, tid long, at long, n_docs long, first_doc {kind}"
    chains = materialise(nodes.mapInArrow(_chains(words), schema), "chains")

    # each distinct chain once, with what its places have in common
    lists = F.first(F.struct("labels", "begins", "ends")).alias("lists")
    place = F.min(F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", F.col("at").alias("first_at"))).alias("place")
    found = chains.groupBy("chain").agg(lists, F.sum("n_docs").alias("weight"), F.min("tid").alias("low"), F.max("tid").alias("high"), place)
    found = materialise(found.select("chain", "lists.*", "weight", "low", "high", "place.first_doc", "place.first_at"), "distinct-chains")
    total = found.agg(F.sum(F.size("labels"))).first()[0] or 0
    tasks = max(1, -(-total // letters))
    spelt = found.select("chain", F.posexplode("labels").alias("number", "label"))
    owner = spelt.groupBy("label").agg(F.min("chain").alias("least"))
    dealt = spelt.join(owner, "label").select(F.pmod(F.xxhash64("least"), F.lit(tasks)).cast("int").alias("task"), "chain", "number")
    dealt = dealt.groupBy("task", "chain").agg(F.collect_list("number").alias("own"))
    joined_ = dealt.join(found, "chain").select("task", "own", "chain", "labels", "begins", "ends", "weight", "low", "high", "first_doc", "first_at")
    cut = f"task int, own array<int>, chain long, labels array<long>, begins array<int>, ends array<int>, weight long, low long, high long, first_doc {kind}, first_at long, skipped int, before long"
    sent = joined_.mapInArrow(_parts, cut).repartitionById(tasks, "task")
    made = sent.mapInArrow(_trees, f"chain long, number int, begin int, n_words int, n_occurrences long, first_doc_id {kind}, first_at long")
    made = materialise(made, "subtrees")

    repeat = ("n_words", "n_occurrences", "first_doc_id")
    inner = made.filter("chain is null").select(F.col("first_doc_id").alias("doc_id"), F.col("first_at").alias("begin_word"), *repeat)
    longest = made.filter("chain is not null").repartition("chain").sortWithinPartitions("chain", "number").mapInArrow(_longest, made.schema)
    placed = chains.select("chain", "tid", "at").join(longest, "chain").select("tid", (F.col("at") + F.col("begin")).alias("begin_word"), *repeat)
    # a text with copies has one row, be it a repeat of other texts or not
    several = by_text.filter("n_docs > 1").select("tid", "n_docs", "first_doc", F.col("n_words").alias("size"))
    placed = placed.join(several, "tid", "left").filter("size is null or (begin_word = 0 and n_words = size)")
    whole = several.join(placed.filter("size is not null").select("tid"), "tid", "left_anti")
    whole = whole.select("tid", F.lit(0).cast("long").alias("begin_word"), F.col("size").alias("n_words"), F.col("n_docs").alias("n_occurrences"), F.col("first_doc").alias("first_doc_id"))
    of_docs = placed.select("tid", "begin_word", *repeat).unionByName(whole).join(rows.select("doc_id", "tid"), "tid")
    out = of_docs.select("doc_id", "begin_word", *repeat).unionByName(inner)
    return out.select("doc_id", "begin_word", F.col("n_words").cast("long").alias("n_words"), "n_occurrences", "first_doc_id").distinct()


def op7_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(table(spark, sf_dir, "documents"))


_N = MIN_WORDS
#: Pairs of places with the same run, how far each pair goes on alike, and of
#: each such stretch the places that have it whole.
_ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER (ORDER BY text) AS k, text, list_filter(string_split_regex(text, '{SPACE_RE}'), lambda x: x <> '') AS w, count(DISTINCT doc_id) AS n, min(doc_id) AS d
  FROM documents WHERE text IS NOT NULL GROUP BY text
),
runs AS (SELECT k, i, array_to_string(w[i + 1 : i + {_N}], ' ') AS run FROM (SELECT k, w, unnest(range(0, len(w) - {_N - 1})) AS i FROM texts)),
shared AS (SELECT * FROM runs WHERE run IN (SELECT run FROM runs GROUP BY run HAVING count(DISTINCT k) > 1)),
pairs AS (SELECT a.k AS k, a.i AS i, b.k AS k2, b.i AS i2 FROM shared a JOIN shared b USING (run) WHERE a.k <> b.k OR a.i <> b.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY k, k2, i2 - i ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT k, i, k2, i2, max(i) OVER part - i + {_N} AS n, i = min(i) OVER part AS begins FROM islands WINDOW part AS (PARTITION BY k, k2, i2 - i, island)
),
candidates AS (SELECT DISTINCT k, i, n FROM stretches WHERE begins),
places AS (
  SELECT c.k, c.i, c.n, s.k2 AS pk, s.i2 AS pi FROM candidates c JOIN stretches s ON c.k = s.k AND c.i = s.i AND s.n >= c.n
  UNION ALL SELECT k, i, n, k, i FROM candidates
),
counted AS (
  SELECT p.k, p.i, p.n, sum(t.n)::BIGINT AS n_occurrences, min(t.d) AS first_doc_id, arg_min(p.pi, (t.d, p.pi)) AS first_at
  FROM places p JOIN texts t ON t.k = p.pk GROUP BY p.k, p.i, p.n HAVING count(DISTINCT p.pk) > 1
),
deepest AS (SELECT k, i, max(n) AS n FROM stretches WHERE k <> k2 GROUP BY k, i),
longest AS (SELECT * FROM (SELECT *, coalesce(i + n > lag(i + n) OVER w OR lag(i) OVER w < i - 1, true) AS fresh FROM deepest WINDOW w AS (PARTITION BY k ORDER BY i)) WHERE fresh),
several AS (SELECT k, n AS n_docs, d, len(w) AS size FROM texts WHERE n > 1 AND len(w) >= {_N}),
placed AS (
  SELECT l.k, l.i, l.n, c.n_occurrences, c.first_doc_id, size FROM longest l JOIN counted c USING (k, i, n) LEFT JOIN several USING (k) WHERE size IS NULL OR (l.i = 0 AND l.n = size)
),
of_texts AS (
  SELECT k, i, n, n_occurrences, first_doc_id FROM placed
  UNION ALL SELECT k, 0, size, n_docs, d FROM several WHERE k NOT IN (SELECT k FROM placed WHERE size IS NOT NULL)
)
SELECT DISTINCT doc_id, i AS begin_word, o.n AS n_words, n_occurrences, first_doc_id FROM of_texts o JOIN texts t USING (k) JOIN documents USING (text)
UNION SELECT first_doc_id, first_at, n, n_occurrences, first_doc_id FROM counted
"""

QUERIES = {"op7_suffix_trees": op7_suffix_trees}
ORACLES = {"op7_suffix_trees": _ORACLE}
