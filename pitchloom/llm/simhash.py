"""SimHash near-duplicates with pigeonring candidate filtering and distributed components.

Fingerprints: lower-cased A-Z, words, shingles of four words with repeats, XXH64 with seed 42; a bit is set if it is
set in over half the hashes.

Links: two fingerprints differ in at most ``most`` bits. Cut them into most + 1 segments on a ring. If the whole ring
differs in at most ``most`` bits, there is a start from which every chain of consecutive segments differs in at most
its share, length x most / (most + 1): none in the first segment, at most one in the first two, two in the first
three, and so on. So a pair is found under a start if it agrees on the first segment, and, as the second then holds
at most one difference, on one half of the second. Those two values are a bucket's key; where there are so many
fingerprints that such buckets would fill by chance, the key takes in further segments (Scheme). Pairs of a bucket must
then pass the chain of every length, and last the full Hamming check.

Within a bucket no list of pairs leaves the task: a bucket gives a spanning forest of its links. Large buckets
(a group of near copies, all of distinct fingerprints) are joined to pivots first, so a group that lies round one
fingerprint costs one pass; what is still apart is split by further pieces until parts are small.

Components: distinct fingerprints only (copies share one, so a group of exact copies is one node), joined by
alternating large-star and small-star rounds, each a join and an aggregate, each written to the shared folder. The
driver sees counts alone.

Cases: null and empty texts have fingerprint zero and link as any other; fewer than four words are one shingle; rows
that repeat an id have the same component if the same text; null ids join components but name none (a component of
null ids alone has a null component_id); an empty table gives no row; other columns, whatever their names, are
ignored, or kept by the stage.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of each shingle: a slice of the words joined by single spaces."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """Bits set in over half the hashes; 0 of none."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with fp a signed 64-bit integer of the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches, 1024):
            found = np.array([majority(shingle_hashes(t, shingle)) for t in batch.column("t").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")), run, "doc_id long, fp long")


# ---------------------------------------------------------------- candidates


def ring(most: int, pieces: int = 1) -> list[tuple[int, int]]:
    """(first bit, number of bits) of (most + 1) segments of so many pieces each."""
    n = (most + 1) * pieces
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def mask_of(parts: Sequence[tuple[int, int]]) -> int:
    return sum(((1 << n) - 1) << at for at, n in parts)


@dataclass(frozen=True)
class Scheme:
    """What a bucket's key holds: the pieces of the first ``depth`` segments that a pair may not differ in.

    The chain of k segments from a fitting start differs in at most k most / (most + 1) bits, which is k - 1 for k up to
    most + 1. So of the first depth segments at most depth - 1 pieces differ, none in the first segment, at most one in
    the first two, and so on. For each choice of pieces that may differ so, the others are a key.
    """

    most: int
    pieces: int
    depth: int

    def choices(self) -> list[list[int]]:
        """Pieces (from the start) of each key."""
        places = range(self.pieces, self.depth * self.pieces)
        out = []
        for bad in itertools.combinations(places, self.depth - 1):
            if all(sum(x < k * self.pieces for x in bad) <= k - 1 for k in range(1, self.depth)):
                out.append([x for x in range(self.depth * self.pieces) if x not in bad])
        return out

    def keys(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """(start, bits) of each key, in the order of their labels."""
        if self.most == 0:
            return [(0, [(0, 64)])]
        parts = ring(self.most, self.pieces)
        return [(start, [parts[(start * self.pieces + x) % len(parts)] for x in chosen]) for start in range(self.most + 1) for chosen in self.choices()]

    @property
    def bits(self) -> int:
        return min(sum(n for _, n in parts) for _, parts in self.keys())


def scheme_for(nodes: int, most: int, crowd: int = 64) -> Scheme:
    """The least keys whose buckets of unlike fingerprints hold about ``crowd`` at most; the result is the same by any."""
    if most == 0:
        return Scheme(0, 1, 1)
    options = [Scheme(most, pieces, depth) for pieces, depth in ((2, 2), (2, 3), (3, 3), (3, 4)) if depth <= most + 1]
    return next((x for x in options if nodes >> x.bits <= crowd), options[-1])


#: A key's label, its place in the scheme, stands above this bit; the values of the pieces are hashed below it.
LABEL = 52


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_keys(fp: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Keys (n x number of keys): the label, and a hash of the fingerprint's bits in the key's pieces."""
    low = np.uint64((1 << LABEL) - 1)
    return np.stack([np.uint64(i << LABEL) | (mixed(fp & np.uint64(mask_of(parts))) & low) for i, (_, parts) in enumerate(scheme.keys())], axis=1)


def chain_masks(start: int, most: int) -> list[np.uint64]:
    """Masks of the chains of 2, 3, ... segments from a start; the chain of length k may differ in k most / (most + 1)."""
    segments = ring(most)
    return [np.uint64(mask_of([segments[(start + i) % (most + 1)] for i in range(k)])) for k in range(2, most + 2)]


def linked(x: np.ndarray, masks: list[np.uint64], most: int) -> np.ndarray:
    """Positions in an array of exclusive ors that pass every chain, then the full check (the longest chain)."""
    at = np.arange(len(x))
    for k, mask in enumerate(masks, 2):
        at = at[np.bitwise_count(x[at] & mask) <= k * most // (most + 1)]
    return at[np.bitwise_count(x[at]) <= most]


class Forest:
    """Union-find over array positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j

    def labels(self, at: np.ndarray) -> np.ndarray:
        """Roots of many positions at once."""
        root = self.parent[at]
        while (self.parent[root] != root).any():
            root = self.parent[root]
        self.parent[at] = root
        return root


def bucket_forest(fp: np.ndarray, start: int, most: int, block: int = 512, pivots: int = 8) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links in one large bucket of distinct fingerprints.

    A few pivots take what lies within ``most`` of them, which joins most of a group of near copies in a pass each. What
    may still be apart is split by the values of further pieces, one of which two linked fingerprints must share, again
    and again until a part is small; a part whose members are joined already is left, and in the others only members
    of different groups are compared.
    """
    masks, edges, joined = chain_masks(start, most), [], Forest(len(fp))

    def add(i: np.ndarray, j: np.ndarray) -> None:
        """Links between groups: one for each two groups."""
        a, b = joined.labels(i), joined.labels(j)
        apart = np.flatnonzero(a != b)
        _, first = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]]), axis=1, return_index=True)
        for k in apart[first].tolist():
            if joined.join(int(i[k]), int(j[k])):
                edges.append((int(i[k]), int(j[k])))

    def compare(at: np.ndarray) -> None:
        group = joined.labels(at)
        values, back, sizes = np.unique(group, return_inverse=True, return_counts=True)
        if len(values) < 2:
            return
        others = at[back != np.argmax(sizes)]  # all but the largest group, against all
        for k in range(0, len(others), block):
            own = others[k : k + block]
            hit = linked((fp[own][:, None] ^ fp[at][None, :]).ravel(), masks, most)
            add(own[hit // len(at)], at[hit % len(at)])

    def split(at: np.ndarray, free: np.ndarray) -> None:
        """free: bits in which members may differ."""
        group = joined.labels(at)
        if (group == group[0]).all():
            return
        rest = len(at) - int(np.bincount(np.unique(group, return_inverse=True)[1]).max())
        if rest <= block or len(free) <= most + 1:
            compare(at)
            return
        for part in np.array_split(free, most + 1):
            value = mixed(fp[at] & np.uint64(sum(1 << int(b) for b in part)))
            order = np.argsort(value, kind="stable")
            ends = np.flatnonzero(np.r_[value[order][1:] != value[order][:-1], True]) + 1
            fewer = np.setdiff1d(free, part)
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    split(at[order[a:b]], fewer)

    rest = np.arange(len(fp))
    for _ in range(pivots):
        if not len(rest):
            break
        near = linked(fp[rest] ^ fp[rest[0]], masks, most)  # the pivot too
        add(np.full(len(near), rest[0]), rest[near])
        rest = np.delete(rest, near)
    same = np.bitwise_or.reduce(fp ^ fp[0]) if len(fp) else np.uint64(0)
    split(np.arange(len(fp)), np.array([b for b in range(64) if int(same) >> b & 1]))
    return edges


def links(nodes: DataFrame, most: int, parts: int, large: int = 64, scheme: Scheme | None = None) -> DataFrame:
    """(a, b), a < b: edges with the same components as all links among distinct fingerprints (column fp)."""
    scheme = scheme or scheme_for(nodes.count(), most)
    starts = np.array([start for start, _ in scheme.keys()], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            keys = bucket_keys(fp.view(np.uint64), scheme)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]))], ["key", "fp"])

    def small_pairs(key: np.ndarray, fp: np.ndarray, start: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links in many small buckets at once: rows at distance 1, 2, ... of the same key."""
        found = []
        for d in range(1, len(key)):
            at = np.flatnonzero(key[d:] == key[:-d])
            if not len(at):
                break
            x = fp[at] ^ fp[at + d]
            for s in np.unique(start[at]):
                own = at[start[at] == s]
                hit = own[linked(x[start[at] == s], chain_masks(int(s), most), most)]
                if len(hit):
                    found.append((fp[hit], fp[hit + d]))
        return found

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_key, left_fp = [], []

        def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            start = starts[(key >> np.uint64(LABEL)).astype(np.int64)]
            bounds = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)
            sizes, big, found = np.diff(bounds), np.zeros(len(key), bool), []
            for b in np.flatnonzero(sizes > large):
                own = slice(bounds[b], bounds[b + 1])
                big[own] = True
                e = np.array(bucket_forest(fp[own], int(start[bounds[b]]), most), np.int64).reshape(-1, 2)
                found.append((fp[own][e[:, 0]], fp[own][e[:, 1]]))
            rest = ~big
            found += small_pairs(key[rest], fp[rest], start[rest])
            a = np.concatenate([f[0] for f in found]).view(np.int64) if found else np.zeros(0, np.int64)
            b = np.concatenate([f[1] for f in found]).view(np.int64) if found else np.zeros(0, np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            left_key.append(batch.column("key").to_numpy().view(np.uint64))
            left_fp.append(batch.column("fp").to_numpy().view(np.uint64))
            if sum(map(len, left_key)) < 4096 or left_key[-1][-1] == left_key[0][0]:
                continue  # one bucket goes on
            key, fp = np.concatenate(left_key), np.concatenate(left_fp)
            cut = int(np.argmax(key == key[-1]))  # the last bucket may go on
            yield solve(key[:cut], fp[:cut])
            left_key, left_fp = [key[cut:]], [fp[cut:]]
        yield solve(np.concatenate([*left_key, np.zeros(0, np.uint64)]), np.concatenate([*left_fp, np.zeros(0, np.uint64)]))

    if most == 0:  # distinct fingerprints never agree
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keyed = common.map_batches(nodes.select("fp"), spread, "key long, fp long").repartition(parts, "key").sortWithinPartitions("key", "fp")
    return common.map_batches(keyed, join, "a long, b long").distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a < b): root is the least node that it reaches.

    A large star hangs each node's greater neighbours on its least neighbour, a small star its lesser ones; both keep
    components. They alternate until every edge hangs on a root. Nodes of many edges are met by aggregates, which
    combine before the shuffle, and by equi-joins, whose hot keys Spark splits.
    """

    def star(e: DataFrame, greater: bool) -> DataFrame:
        """e has (a, b), a < b. Neighbours of each node u and its least m; v > u (or v <= u, with u itself) hang on m."""
        if greater:
            seen = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            seen = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = seen.where("v > u") if greater else seen
        out = hung.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not greater:
            out = out.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.where("a < b").distinct()

    e, before = edges, None
    while True:  # each round joins every node to the least it sees, so rounds are about the logarithm of a component
        e = common.durable(star(star(e, True), False), "star")
        if before is not None:
            common.discard(before)
        before = e
        # done when every lesser end is a root (no node is both below another and above a third) and no node hangs on two
        below = e.groupBy("b").agg(F.min("a").alias("root"), F.count("*").alias("n")).select(F.col("b").alias("node"), "root", "n")
        inner = e.select(F.col("a").alias("node")).join(below, "node", "left_semi")
        if below.where("n > 1").isEmpty() and inner.isEmpty():
            return below.drop("n").union(e.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))


def near_duplicates(docs: DataFrame, most: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    spark = docs.sparkSession
    parts = common.shuffle_parts(spark)
    marked = common.durable(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = common.durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = common.durable(links(nodes.select("fp"), most, parts), "links")
    root = components(edges)
    grouped = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id, and of its texts the least.

    Texts are near if the Jaccard likeness of their sets of five-word shingles is 0.8 or more, exactly: links of SimHash
    fingerprints are candidates that are checked by whole sets, and the pairs whose fingerprints are further apart than
    a ring of segments can bridge are found beside them (see alike). Rows without an id stay if no row of their group has
    one, once for the group. Columns of any name are kept.
    """
    from .alike import groups

    names = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    own_id, own_text = (f"_{common.named(names, c)}" for c in ("doc_id", "text"))
    given = numbered.withColumn("__tie", F.xxhash64(common.text_column(own_text)))
    found = common.durable(groups(given, id_col=own_id, text_col=own_text), "near")  # (doc_id, tie, group)
    # of each group the least (id, text hash); ids are compared before hashes, null ids come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    kept = found.groupBy("group").agg(first.alias("k")).select("k.doc_id", "k.tie")
    rows = given.join(kept, given[own_id].cast("long").eqNullSafe(kept["doc_id"]) & (given["__tie"] == kept["tie"]), "left_semi")
    # rows that repeat an id and a text are one; few rows do, so the others are not shuffled
    again = common.durable(found.groupBy("doc_id", "tie").count().where("count > 1").select("doc_id", "tie"), "repeated")
    if not again.isEmpty():
        match = given[own_id].cast("long").eqNullSafe(again["doc_id"]) & (given["__tie"] == again["tie"])
        rows = rows.join(again, match, "left_anti").union(rows.join(again, match, "left_semi").dropDuplicates([own_id, "__tie"]))
    return rows.drop("__tie").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
