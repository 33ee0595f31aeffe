"""Documents whose sets of five-word shingles have a Jaccard likeness of 0.8 or more: an exact join, and its components.

A node is a distinct set of shingles (XXH64 as in simhash), so exact copies are one. Links are found in three rounds,
each checked exactly, by whole sets, and each only between nodes that the rounds before have not joined:

1. SimHash fingerprints of the same shingles, linked by pigeonring filtering (simhash.links). They join what is nearly
   the same, at ten small keys for each fingerprint; texts at 0.8 differ in some ten bits, beyond what a ring bridges.
2. Prefixes. Two sets of likeness 4/5 or more share at least 4/5 of either; in any common order of shingles they hence
   share one of the first s - ceil(4 s / 5) + 1 of the s of each. Those are a node's keys. The order puts shingles first
   that a sample holds seldom, so that common passages are no keys of most texts; the sample decides the work alone,
   never the result. In small buckets of a key all pairs whose sizes and places allow 0.8 are candidates; in large ones
   (a group of near copies) each node is held against the bucket's least.
3. Large buckets again: pairs of nodes whose components are still apart. A bucket with more such candidates than a
   multiple of its nodes reports a spanning forest of them instead; the whole sets that such forests join meet in one
   task, or block by block, which compares any two and reports a spanning forest of their links.

Candidates stay if the numbers of their shingles in 64 classes differ by no more than alike sets can. Of texts, only
those of candidates are moved, once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .simhash import Forest, components, links, majority, shingle_hashes

CLASSES = 64
#: Bits of a key's place below the size in sp; a later place than they hold counts as the last, which allows more.
PLACE = 24


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def node_of(held: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(held.tobytes(), 7)).view(np.int64))


def sketch(held: np.ndarray) -> np.ndarray:
    """Shingles in each class, up to 255: two sets differ in at least as many shingles as their sketches differ in all."""
    return np.minimum(np.bincount((held & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8)


def prefix(held: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Keys of a set in their order; ``known`` are common shingles (sorted), ``rank`` their places, which follow all others."""
    n = len(held) - -(-4 * len(held) // 5) + 1 if len(held) else 0
    place = np.zeros(len(held), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, held), len(known) - 1)
        place = np.where(known[at] == held, rank[at], 0)
    return held[np.lexsort((held, place))[:n]]


def common_shingles(docs: DataFrame, text_col: str, share: float = 0.05, least: int = 5000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample, sorted, and their places from the rarest."""
    rows = docs.count()
    part = docs if rows <= least else docs.sample(max(share, least / rows), 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            held = [shingle_set(t) for t in batch.column("t").to_pylist()]
            h, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    seen = common.map_batches(part.select(F.col(text_col).alias("t")), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    top = seen.orderBy(F.col("n").desc(), "h").limit(most).collect()
    known = np.array([r.h for r in reversed(top)], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.arange(1, len(known) + 1)[order]


def marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tie, node, size, fp, sketch) for each row; tie is the text's own hash, fp its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            found = []
            for t in batch.column("t"):
                hashes = shingle_hashes(t.as_py(), 5)
                held = np.unique(np.array(hashes, np.uint64))
                found.append((node_of(held), len(held), majority(hashes), sketch(held).tobytes()))
            node, size, fp, marks_ = zip(*found, strict=True)
            columns = [batch.column("doc_id"), batch.column("tie"), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(marks_, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "node", "size", "fp", "sketch"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_column(text_col).alias("t")).withColumn("tie", F.xxhash64("t"))
    return common.map_batches(given, run, "doc_id long, tie long, node long, size int, fp long, sketch binary")


def once(ties: list[int], seen: set[int], most: int = 200_000) -> list[int]:
    """Places of the ties that a task has not met; what it has met is forgotten at a size, which costs work alone."""
    if len(seen) > most:
        seen.clear()
    out = []
    for i, tie in enumerate(ties):
        if tie not in seen:
            seen.add(tie)
            out.append(i)
    return out


def keyed(docs: DataFrame, known: np.ndarray, rank: np.ndarray, text_col: str, parts: int) -> DataFrame:
    """(key, node, sp), dealt and sorted by key; sp holds the set's size and the key's place. A task sends a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.in_slices(batches):
            fresh = once(batch.column("tie").to_pylist(), seen)
            held = [shingle_set(t) for t in batch.column("t").take(pa.array(fresh, pa.int64())).to_pylist()]
            keys = [prefix(h, known, rank) for h in held]
            n = [len(k) for k in keys]
            size = np.repeat(np.array([len(h) for h in held], np.int64), n)
            place = np.concatenate([*(np.arange(k) for k in n), np.zeros(0, np.int64)])
            node = np.repeat(np.array([node_of(h) for h in held], np.int64), n)
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(node), pa.array(size << PLACE | np.minimum(place, (1 << PLACE) - 1))], ["key", "node", "sp"])

    given = docs.select(common.text_column(text_col).alias("t")).withColumn("tie", F.xxhash64("t"))
    return common.map_batches(given, run, "key long, node long, sp long").repartition(parts, "key").sortWithinPartitions("key", "node")


def in_buckets(batches: Iterator[pa.RecordBatch], least: int = 4096) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables of whole buckets."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        left = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        key = left.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut >= least:
            yield left.slice(0, cut)
            left = left.slice(cut)
    if left is not None:
        yield left


def pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([*(f[i] for f in found), np.zeros(0, np.int64)]) for i in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def may_be_alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes and places (sp) allow 0.8, if this key is the first that two sets share.

    They share it and at most what follows it in either, and must share 4/9 of both sizes together.
    """
    low = (1 << PLACE) - 1
    n, m = x >> PLACE, y >> PLACE
    left = np.minimum(n - (x & low), m - (y & low))
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * left >= 4 * (n + m))


def drawn(sketches: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)


def bucket_pairs(rows: DataFrame, large: int) -> DataFrame:
    """(kind, a, b, sp) from keyed(). Kind 0: a candidate pair. Kind 1: a large bucket's key, a member and its sp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_buckets(batches):
            key, node, sp = (t.column(c).to_numpy() for c in ("key", "node", "sp"))
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # tasks may have sent the same text
            key, node, sp = key[new], node[new], sp[new]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.diff(np.r_[starts, len(key)])
            first, big, found = np.repeat(starts, n), np.repeat(n > large, n), []
            at = np.flatnonzero(big & (first != np.arange(len(key))))
            at = at[may_be_alike(sp[at], sp[first[at]])]
            found.append((node[first[at]], node[at]))
            members = key[big], node[big], sp[big]
            keep = ~big
            key, node, sp = key[keep], node[keep], sp[keep]
            for d in range(1, large):
                at = np.flatnonzero(key[d:] == key[:-d])
                if not len(at):
                    break
                at = at[may_be_alike(sp[at], sp[at + d])]
                found.append((node[at], node[at + d]))
            pairs = pair_batch(found)
            none = pa.array(np.zeros(pairs.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(pairs.num_rows, np.int32)), pairs.column("a"), pairs.column("b"), none], ["kind", "a", "b", "sp"])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(members[0]), np.int32)), *map(pa.array, members)], ["kind", "a", "b", "sp"])

    return common.map_batches(rows, run, "kind int, a long, b long, sp long")


def candidates(node: np.ndarray, sp: np.ndarray, root: np.ndarray, marks_: np.ndarray, most: int, block: int = 1024) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """Pairs of a bucket that fit in size, place and sketch and whose roots differ; if over ``most``, a spanning forest of them (True)."""
    order = np.argsort(sp >> PLACE, kind="stable")  # alike sets are near each other by size
    node, sp, root, marks_ = node[order], sp[order], root[order], marks_[order]
    size = sp >> PLACE
    ends = np.searchsorted(size, 5 * size // 4, side="right").tolist()

    def pairs(joined: Forest | None) -> list[tuple[np.ndarray, np.ndarray]] | None:
        found, held = [], 0
        for x, end in enumerate(ends):
            for j in range(x + 1, end, block):
                y = np.arange(j, min(end, j + block))
                y = y[root[y] != root[x]]
                if joined is not None:
                    y = y[joined.labels(y) != joined.find(x)]
                y = y[may_be_alike(np.full(len(y), sp[x]), sp[y])]
                y = y[9 * np.abs(marks_[y] - marks_[x]).sum(axis=1) <= size[y] + size[x]]
                if joined is not None:
                    y = y[np.unique(joined.labels(y), return_index=True)[1]]  # one of each part
                    for k in y.tolist():
                        joined.join(x, k)
                found.append((np.full(len(y), node[x]), node[y]))
                held += len(y)
            if joined is None and held > most:
                return None
        return found

    found = pairs(None)
    return (found, False) if found is not None else (pairs(Forest(len(node))), True)


def later_pairs(rows: DataFrame, share: int = 8) -> DataFrame:
    """(a, b, dense) of one key: candidates whose components (column root) are apart.

    A bucket of n nodes with up to ``share`` n candidates reports them all; one with more is dense and reports a spanning
    forest of them, so the rows are a multiple of the nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_buckets(batches):
            key = t.column("key").to_numpy()
            bounds = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            found = {False: [], True: []}
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                own = t.slice(lo, hi - lo)
                node, sp, root = (own.column(c).to_numpy() for c in ("node", "sp", "root"))
                if (root != root[0]).any():
                    pairs, dense = candidates(node, sp, root, drawn(own.column("sketch")), share * len(node))
                    found[dense] += pairs
            for dense, pairs in found.items():
                made = pair_batch(pairs)
                yield made.append_column("dense", pa.array(np.full(made.num_rows, dense)))

    return common.map_batches(rows, run, "a long, b long, dense boolean").distinct()


def set_forest(node: np.ndarray, root: np.ndarray, part: np.ndarray, held: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (likeness 0.8 or more, by whole sets) that join what roots leave apart; between parts only, if there are two."""
    order = np.argsort([len(h) for h in held], kind="stable")
    node, part, held = node[order], part[order], [held[i] for i in order]
    size = np.array([len(h) for h in held], np.int64)
    starts = np.r_[0, np.cumsum(size)]
    values, flat = np.unique(np.concatenate(held), return_inverse=True)
    joined, mark, edges, two = Forest(len(node)), np.zeros(len(values), np.int32), [], (part != part[0]).any()
    _, first, back = np.unique(root[order], return_index=True, return_inverse=True)
    joined.parent = first[back]
    for x, end in enumerate(np.searchsorted(size, 5 * size // 4, side="right").tolist()):
        y = np.arange(x + 1, end)
        apart = joined.labels(y) != joined.find(x)
        if two:
            apart &= part[y] != part[x]
        if not apart.any():
            continue
        own = flat[starts[x] : starts[x + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[starts[x + 1] : starts[end]]], starts[x + 1 : end] - starts[x + 1])
        mark[own] = 0
        y = y[apart & (9 * both >= 4 * (size[y] + size[x]))]
        for k in y[np.unique(joined.labels(y), return_index=True)[1]].tolist():
            joined.join(x, k)
            edges.append((int(node[x]), int(node[k])))
    return edges


def linked_in_groups(pairs: DataFrame, root: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, parts: int, most: int = 1 << 19) -> DataFrame:
    """(a, b), durable: links that join what the likeness of any two nodes joins in a group, a component of the pairs.

    A group's sets meet in one task, which reports a spanning forest of its links. A group of more than ``most``
    shingles in all is cut into blocks, and any two of its blocks meet in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, found = None, [], []

        def solve() -> list[tuple[int, int]]:
            node, root_, part, held = zip(*own, strict=True)
            return set_forest(np.array(node, np.int64), np.array(root_, np.int64), np.array(part, np.int64), [np.frombuffer(h, np.uint64) for h in held])

        for batch in common.in_slices(batches):
            for group, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "lo", "hi", "node", "root", "part", "held")), strict=True):
                if own and at != (group, lo, hi):
                    found += solve()
                    own.clear()
                at = group, lo, hi
                own.append(row)
        if own:
            found += solve()
        ends = np.array(found, np.int64).reshape(-1, 2)
        yield pair_batch([(ends[:, 0], ends[:, 1])])

    group = common.durable(components(pairs).withColumnRenamed("root", "group"), "later-groups")
    sets = whole_sets(group.select("node"), nodes, docs, text_col)
    blocks = group.join(nodes.select("node", "size"), "node").groupBy("group").agg(F.ceil(F.sum("size") / most).cast("int").alias("blocks")).where("blocks > 1")
    given = sets.join(group, "node").join(root, "node", "left").join(blocks, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    given = given.withColumn("part", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    given = given.select("group", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", F.coalesce("root", "node").alias("root"), "part", "held")
    dealt = given.repartition(parts, "group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")
    out = common.durable(common.map_batches(dealt, run, "a long, b long").distinct(), "group-links")
    common.discard(sets)
    return out


def fitting(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sketches fit, so that no whole sets are moved for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches, 4096):
            fits = 9 * np.abs(drawn(batch.column("p")) - drawn(batch.column("q"))).sum(axis=1) <= batch.column("n").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    ends = [nodes.select(F.col("node").alias(x), F.col("size").alias(n), F.col("sketch").alias(k)) for x, n, k in (("a", "m", "p"), ("b", "l", "q"))]
    both = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "p", "q", (F.col("m") + F.col("l")).alias("n"))
    return common.map_batches(both, run, "a long, b long")


def whole_sets(ends: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, most: int = 1_000_000) -> DataFrame:
    """(node, held): the shingle sets of some nodes (column node), durable.

    Up to ``most`` texts (8 bytes each) are told to all tasks, so that no other text is moved; more are joined.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.in_slices(batches):
            fresh = once(batch.column("tie").to_pylist(), seen)
            held = [shingle_set(t) for t in batch.column("t").take(pa.array(fresh, pa.int64())).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in held], pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())], ["node", "held"])

    ties = common.durable(nodes.join(ends, "node", "left_semi").select("tie"), "ties")
    texts = docs.select(common.text_column(text_col).alias("t")).withColumn("tie", F.xxhash64("t"))
    if ties.count() <= most:
        listed = np.sort(np.array([r.tie for r in ties.collect()], np.int64))

        @F.pandas_udf("boolean")
        def wanted(x: pd.Series) -> pd.Series:
            at = np.searchsorted(listed, x.to_numpy())
            return pd.Series(listed[np.minimum(at, len(listed) - 1)] == x.to_numpy() if len(listed) else np.zeros(len(x), bool))

        texts = texts.where(wanted("tie"))
    else:
        texts = texts.join(ties, "tie", "left_semi")
    return common.durable(common.map_batches(texts.select("tie", "t"), to_sets, "node long, held binary").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (durable) of likeness 0.8 or more, by their whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches, 128):
            x, y = ([np.frombuffer(b, np.uint64) for b in batch.column(c).to_pylist()] for c in ("x", "y"))
            good = [9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = whole_sets(ends, nodes, docs, text_col)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    out = common.durable(common.map_batches(both.select("a", "b", "x", "y"), check, "a long, b long"), "alike")
    common.discard(sets)
    return out


def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Distinct pairs whose nodes have different roots; a node without one is its own."""
    known = [root.select(F.col("node").alias(x), F.col("root").alias(r)) for x, r in (("a", "ra"), ("b", "rb"))]
    both = pairs.distinct().join(known[0], "a", "left").join(known[1], "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def simhash_pairs(nodes: DataFrame, parts: int, most: int = 4) -> DataFrame:
    """(a, b): nodes of one fingerprint with the least of them, and the least of linked fingerprints."""
    leads = common.durable(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    linked_ = links(leads.select("fp"), most, parts)
    same = nodes.join(leads, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    ends = [leads.select(F.col("fp").alias(x), F.col("lead").alias(y)) for x, y in (("a", "x"), ("b", "y"))]
    across = linked_.join(ends[0], "a").join(ends[1], "b").select("x", "y")
    return same.union(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def groups(docs: DataFrame, large: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, group) for every row of docs: tie is the text's hash, group a number that linked texts share."""
    parts = common.shuffle_parts(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    marked = common.durable(marks(docs, id_col, text_col), "marks")
    nodes = common.durable(marked.groupBy("node").agg(F.first("size").alias("size"), F.min("tie").alias("tie"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "alike-nodes")

    near = common.durable(fitting(simhash_pairs(nodes, parts), nodes), "simhash-pairs")
    edges = verified(near, nodes, docs, text_col)
    root = common.durable(components(edges), "simhash-roots")

    buckets = common.durable(bucket_pairs(keyed(docs, *common_shingles(docs, text_col), text_col, parts), large), "buckets")
    pairs = common.durable(fitting(apart(buckets.where("kind = 0").select("a", "b"), root), nodes), "prefix-pairs")
    edges = common.durable(edges.union(verified(pairs, nodes, docs, text_col)), "prefix-links")
    root = common.durable(components(edges), "prefix-roots")

    members = buckets.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "sp")
    members = common.durable(members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    several = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = common.durable(members.join(several, "key", "left_semi").join(nodes.select("node", "sketch"), "node"), "large")
    common.discard(buckets, members)
    if not rest.isEmpty():
        dealt = rest.select("key", "node", "sp", "root", "sketch").repartition(parts, "key").sortWithinPartitions("key", "node")
        more = common.durable(later_pairs(dealt), "later-pairs")
        edges = edges.union(verified(more.where("not dense").select("a", "b"), nodes, docs, text_col))
        dense = more.where("dense").select("a", "b")
        if not dense.isEmpty():
            edges = edges.union(linked_in_groups(dense, root, nodes, docs, text_col, parts))
        edges = common.durable(edges, "alike-links")
        root = components(edges)
    return marked.select("doc_id", "tie", "node").join(root, "node", "left").select("doc_id", "tie", F.coalesce("root", "node").alias("group"))
