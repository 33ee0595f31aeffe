"""Document fingerprints by I-Match over randomised lexicons, nested so that a text of any length has few terms in each.

Terms are words. The lexicon keeps the terms whose inverse document frequency lies in a band: in at least ``rare`` and
at most ``common_`` of all documents. It is cut into random subsets, and each subset into nested ones: level 0 is the
whole lexicon, and each level keeps a random half of the one below, so level k is 2^-k of it. A document of D lexicon
terms is signed at five levels from the k with 2^k nearest to D, where a subset holds about one of its terms: a signature
is the hash of the document's sorted distinct terms in the subset. At such levels an edit of half a text leaves a good
part of the subsets alone; at one fixed rate a long text has many terms in every subset, and any edit changes all
signatures. Texts whose numbers of terms differ by less than some 20 times have a level in common.

Two documents are alike by the share of subsets, at the levels that both have and of those that hold a term of either, in
which they sign alike. It tends to the likeness (Jaccard) of their sets of terms.

The lexicon is exact and bounded: a document has few distinct terms, so at most (mean distinct terms / rare) terms are
frequent enough, whatever the input. It takes two passes and no shuffle of terms. A term that is frequent over all is
frequent in some part, so a first pass, each task over its own part, yields the candidates; a second counts only
those over all documents.

A text of fewer than FEW lexicon terms is signed by all its distinct words instead, in the same way, and one of fewer than
SHORT words by both; a text without a word has no signature, and is like only another such.

For the edited text and the next document, documents are dealt by ranges of their id, and each range gets, too, the
one row that follows it: no global order is built in one task, and an id of very many rows fills several ranges.

Cases: a null text is the empty text; equal texts have equal fingerprints; one document is its own next; null ids
come last in descending order; rows that repeat an id are ordered by the hash of their text; an empty table gives no row;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common


def terms(text: str) -> set[int]:
    return set(map(xxh64_intdigest, set(common.words(text))))


def lexicon(docs: DataFrame, rare: float = 0.002, common_: float = 0.2, text_col: str = "text", part: int = 4096) -> np.ndarray:
    """Sorted hashes of the terms in the band, exact over all rows; at most (mean distinct terms / rare) of them.

    The first pass counts in parts of at most ``part`` rows, which bounds a task's memory, and reports the terms that
    are frequent in their part. A term that a part does not report is in at most ceil(rare x rows) - 1 of its rows, so
    what is reported bounds a term's count from above; only terms that may reach the band are counted in full.
    """
    texts = docs.select(common.text_column(text_col).alias("t"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0

        def report() -> pa.RecordBatch:
            least = max(1, int(np.ceil(rare * n)))
            held = [(k, c) for k, c in seen.items() if c >= least]
            keys = np.fromiter((k for k, _ in held), np.uint64, len(held)).view(np.int64)
            columns = [pa.array([None, *keys.tolist()], pa.int64()), pa.array([n, *(c for _, c in held)], pa.int64()), pa.array([least - 1] * (len(held) + 1), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["h", "n", "unseen"])

        for batch in common.in_slices(batches):
            for t in batch.column("t").to_pylist():
                seen.update(terms(t))
            n += batch.num_rows
            if n >= part:
                yield report()
                seen, n = Counter(), 0
        yield report()

    reported = common.durable(common.map_batches(texts, local, "h long, n long, unseen long"), "terms")
    whole = reported.where("h is null").agg(F.sum("n").alias("rows"), F.sum("unseen").alias("unseen")).first()
    rows, unseen = whole.rows or 0, whole.unseen or 0
    may = reported.where("h is not null").groupBy("h").agg((F.sum("n") + unseen - F.sum("unseen")).alias("most")).where(F.col("most") >= rare * rows)
    listed = np.array(sorted(r.h for r in may.select("h").collect()), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = set(listed.view(np.uint64).tolist()), Counter()
        for batch in common.in_slices(batches):
            for t in batch.column("t").to_pylist():
                total.update(terms(t) & known)
        keys = np.fromiter(total.keys(), np.uint64, len(total)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(total.values()), pa.int64())], ["h", "n"])

    kept = common.map_batches(texts, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where((F.col("n") >= rare * rows) & (F.col("n") <= common_ * rows))
    return np.sort(np.array([r.h for r in kept.select("h").collect()], np.int64).view(np.uint64))


#: Fewer lexicon terms than this do not tell texts apart; all words do then, and beside them in a text of so few words.
FEW, SHORT = 4, 32
#: Levels that a text is signed at. The sparse ones cost a dot for a subset, and meet texts of many more terms.
LEVELS = 5


def halvings(terms_: np.ndarray, subsets: int, seed: int) -> np.ndarray:
    """(terms, subsets): the highest level of each subset that still holds a term, from a hash of term and subset."""
    x = terms_[:, None] ^ np.random.default_rng(seed).integers(0, 2**63, subsets, np.uint64)[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    # trailing zeros: the bits below the lowest set one
    return np.bitwise_count(~x & (x - np.uint64(1))).astype(np.uint8)


class Signer:
    """Signatures over nested subsets of a lexicon (sorted hashes)."""

    def __init__(self, lexicon: np.ndarray, subsets: int = 32, seed: int = 11):
        self.lexicon, self.subsets, self.seed = lexicon, subsets, seed
        self.level = halvings(lexicon, subsets, seed)

    def __call__(self, text: str) -> str:
        """Sections joined by |, of the lexicon's terms (l) or all words (w): mark, level, and signatures from there."""
        found = np.sort(np.fromiter(terms(text), np.uint64))
        at = np.minimum(np.searchsorted(self.lexicon, found), max(0, len(self.lexicon) - 1))
        at = at[self.lexicon[at] == found] if len(self.lexicon) and len(found) else np.zeros(0, np.int64)
        sections = [self._signed("l", self.lexicon[at], self.level[at])] if len(at) >= FEW else []
        if len(at) < FEW or len(found) < SHORT:
            sections.append(self._signed("w", found, halvings(found, self.subsets, self.seed)))
        return "|".join(sections)

    def _signed(self, mark: str, held: np.ndarray, level: np.ndarray) -> str:
        first = max(0, round(float(np.log2(len(held))))) if len(held) else 0
        parts = []
        for k in range(first, first + LEVELS):
            subset, term = np.nonzero(level.T >= k)  # terms ascend within a subset
            cuts = np.searchsorted(subset, np.arange(self.subsets + 1)).tolist()
            picked = held[term].tobytes()
            parts.append(".".join(f"{xxh64_intdigest(picked[8 * a : 8 * b]) & 0xFFFFFFFF:08x}" if b > a else "" for a, b in zip(cuts, cuts[1:], strict=False)))
        return f"{mark}{first}:" + "/".join(parts)


def signatures(fingerprint_: str) -> dict[tuple[str, int], list[str]]:
    """By mark and level."""
    out = {}
    for section in fingerprint_.split("|"):
        head, _, rest = section.partition(":")
        out |= {(head[0], int(head[1:]) + i): part.split(".") for i, part in enumerate(rest.split("/"))}
    return out


def likeness(a: str, b: str) -> float:
    """Share of subsets that hold a term of either in which the two sign alike, at common levels; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = signatures(a), signatures(b)
    pairs = [(p, q) for k in x.keys() & y.keys() for p, q in zip(x[k], y[k], strict=True) if p or q]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0


def with_next(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, b, extra), dealt and sorted so that in a task a range's rows descend, then comes the row after.

    Rows with ``extra`` are that next row, and no row of their own. Ranges' heads come to the driver: two numbers each.
    """
    spark = docs.sparkSession
    data = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_KEY)).alias("k"), F.col(id_col).isNull().alias("no_id"), common.text_column(text_col).alias("t"))
    data = data.withColumn("h", F.xxhash64("t"))
    splits = common.range_splits(data, "k", parts)
    # within an id rows ascend by hash, so in descending ranges an id's last bucket has its least hashes
    data = data.withColumn("b", common.range_bucket("k", splits, F.bitwise_not("h")))
    ends = data.groupBy("b").agg(F.min(F.struct(F.bitwise_not("k").alias("k"), "h")).alias("head")).collect()
    heads = sorted((r.b, ~r["head"]["k"], r["head"]["h"]) for r in ends)
    # in descending order the head of a range follows the range above it, and the highest head the lowest range
    follows = [(k, h, heads[(i + 1) % len(heads)][0]) for i, (_, k, h) in enumerate(heads)]
    to = F.broadcast(spark.createDataFrame(follows, "k long, h long, target int"))  # a row for each range
    sent = F.explode(F.filter(F.array(F.struct("b", F.lit(False).alias("extra")), F.struct(F.col("target").alias("b"), F.lit(True).alias("extra"))), lambda x: x["b"].isNotNull()))
    dealt = data.join(to, ["k", "h"], "left").select("k", "no_id", "t", "h", sent.alias("s")).select("k", "no_id", "t", "h", "s.b", "s.extra")
    return dealt.repartitionById(len(splits) + 1, F.col("b")).sortWithinPartitions("b", "extra", F.col("k").desc(), "h", "t")


def fingerprint(docs: DataFrame, subsets: int = 32) -> DataFrame:
    """A row for each document: its fingerprint, its edited text's, and their likeness and that to the next one's."""
    sign = Signer(lexicon(docs), subsets)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: range, id, text, fingerprint
        for batch in common.in_slices(batches):
            out = []
            for r in batch.to_pylist():
                mark = sign(r["t"])
                if held and held[0] == r["b"]:
                    _, key, text, own = held
                    half = len(text) // 2
                    edited = text[: len(text) - half] + r["t"][:half]
                    changed = sign(edited)
                    out.append((key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, mark)))
                held = None if r["extra"] else (r["b"], None if r["no_id"] else r["k"], r["t"], mark)
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], _result())

    return common.map_batches(with_next(docs, common.shuffle_parts(docs.sparkSession)), run, schema)


def _result() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(common.table(spark, sf_dir, "documents"))
