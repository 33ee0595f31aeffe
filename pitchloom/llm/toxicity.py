"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic documents are the positives; the training texts at large are unlabelled, and some are toxic, too. With
the class prior pi (the toxic share of the labelled training rows), the risk of the unlabelled seen as negatives counts pi times the positives by mistake, so

    R = pi R(positives as positives) + max(0, R(unlabelled as negatives) - pi R(positives as negatives)),

and a step that would drive the second part below zero goes the other way (the non-negative correction). The
classifier is logistic over hashed features.

Features: a document's distinct lower-cased runs of letters (words), those that occur twice, and the beginnings of words
(3 to 8 letters, of longer words) that occur at least once, twice, three and four times: insults are inflected and
repeated, and where one beginning may stand in clean text by chance, several do not. Each is 0 or 1, so a long text is
no more toxic for its length. A first count over the sample keeps the features in at least ``least_docs`` positives and
at a rate among positives well above that among the unlabelled; all others have no weight.

The sample is bounded and documented: at most ``most_positive`` positives and ``most_unlabelled`` unlabelled rows,
those of least hash of their id, so reruns agree. One parallel pass over the corpus puts its texts in the shared folder;
counts, then the kept features of each text, come to the driver. The class prior is counted over all labelled training
rows, and scoring reads every whole text once, in tasks.

Cases: null and empty texts have no feature and get the score of the bias; null ids are not learned from; where there
is no positive, every score is the prior (0 if there are no labels); repeated rows get the same score; an empty table
gives no row; other columns, whatever their names, are kept, but one of the score's name gives way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from . import common

_LETTERS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7


#: Lengths of beginnings, and how many occurrences are told apart.
BEGINNINGS, TIMES = range(3, 9), 4


def beginnings(word: str) -> list[str]:
    return ["^" + word[:n] for n in BEGINNINGS if n < len(word)]


def key(name: str, times: int) -> int:
    """Of a word or beginning that occurs so many times at least."""
    return xxh32_intdigest(name if times == 1 else f"{name}#{times}")


def features(text: str | None) -> set[int]:
    if not text:
        return set()
    counted = Counter(_LETTERS.findall(text.lower()))
    out = {key(w, 1) for w in counted} | {key(w, 2) for w, n in counted.items() if n > 1}
    begun: Counter[str] = Counter()
    for w, n in counted.items():
        for b in beginnings(w):
            begun[b] += n
    return out | {key(b, j) for b, n in begun.items() for j in range(1, min(n, TIMES) + 1)}


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes and their weights."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> dict[int, float]:
        return dict(zip(self.hashes.tolist(), self.weights.tolist(), strict=True))


def telling(n_p: np.ndarray, n_u: np.ndarray, positives: int, unlabelled: int, prior: float, least_docs: int, least_lift: float) -> np.ndarray:
    """Which features are kept, from the positives and unlabelled that have each."""
    # the unlabelled hold pi positives: the rate among negatives is what is left of the unlabelled rate
    p_rate, u_rate = n_p / max(1, positives), n_u / max(1, unlabelled)
    n_rate = np.maximum(0, u_rate - prior * p_rate) / max(1e-9, 1 - prior)
    return (n_p >= least_docs) & (p_rate >= least_lift * (n_rate + 1 / max(1, unlabelled)))


class Side:
    """Documents of one side as pairs (document, feature place)."""

    def __init__(self, docs: list[np.ndarray], hashes: np.ndarray):
        self.n = len(docs)
        self.doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        flat = np.concatenate([*docs, np.zeros(0, np.int64)])
        self.feature = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
        own = hashes[self.feature] == flat
        self.doc, self.feature, self.width = self.doc[own], self.feature[own], len(hashes)

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.doc, weights=w[self.feature], minlength=self.n)

    def gradient(self, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.feature, weights=slope[self.doc], minlength=self.width), slope.sum()) / max(1, self.n)


def risk_parts(p: Side, u: Side, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk of positives, that of negatives (which may be below 0 in a sample), and the gradients of the two.

    Logistic losses: softplus(-z) as a positive, softplus(z) as a negative.
    """
    zp, zu = p.margins(w, b), u.margins(w, b)
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    mean = lambda x: float(x.mean()) if len(x) else 0.0
    of_positives = prior * mean(np.logaddexp(0, -zp))
    of_negatives = mean(np.logaddexp(0, zu)) - prior * mean(np.logaddexp(0, zp))
    return of_positives, of_negatives, prior * p.gradient(sp - 1), u.gradient(su) - prior * p.gradient(sp)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, hashes: np.ndarray | None = None, least_docs: int = 5, least_lift: float = 10.0, rounds: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Logistic weights that minimise the non-negative risk by Adam over the whole sample.

    positive and unlabelled hold the distinct feature hashes of each document; hashes are the features kept (sorted), or
    None to choose them here.
    """
    empty = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if not positive:
        return empty
    if hashes is None:
        in_p, n_p = np.unique(np.concatenate(positive), return_counts=True)
        in_u, n_u = np.unique(np.concatenate([*unlabelled, np.zeros(0, np.int64)]), return_counts=True)
        other = dict(zip(in_u.tolist(), n_u.tolist(), strict=True))
        n_u = np.array([other.get(h, 0) for h in in_p.tolist()])
        hashes = in_p[telling(n_p, n_u, len(positive), len(unlabelled), prior, least_docs, least_lift)]
    if not len(hashes):
        return empty
    p, u = Side(positive, hashes), Side(unlabelled, hashes)
    w, b = np.zeros(len(hashes)), empty.bias
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        _, negative_risk, of_positives, of_negatives = risk_parts(p, u, w, b, prior)
        g = -of_negatives if negative_risk < 0 else of_positives + of_negatives
        g[:-1] += decay * w
        moment = 0.9 * moment + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return Model(hashes, np.round(w, 6), round(float(b), 6))


def sample(docs: DataFrame, positives: DataFrame, others: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(p, u, t): the texts of two bounded sets of ids, with the sets they are in, read in one pass and durable."""
    k = F.col(id_col).alias("k")
    marked = positives.select(k, F.lit(True).alias("p")).join(others.select(k, F.lit(True).alias("u")), "k", "full")
    # ids are at most the documented bound of the sample, 8 bytes each
    chosen = docs.select(k, F.col(text_col).alias("t")).join(F.broadcast(marked), "k").select(F.coalesce("p", F.lit(False)).alias("p"), F.coalesce("u", F.lit(False)).alias("u"), "t")
    return common.durable(chosen.repartition(common.shuffle_parts(docs.sparkSession)), "sample")  # dealt in turn: copies are no one task's


def count_features(texts: DataFrame, known: np.ndarray | None) -> DataFrame:
    """(f, n): texts that have each feature, of those known (sorted) or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = None if known is None else set(known.tolist()), Counter()

        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["f", "n"])

        for batch in common.in_slices(batches, 128):
            for t in batch.column("t").to_pylist():
                found = features(t)
                seen.update(found if wanted is None else found & wanted)
            if len(seen) > 300_000:
                yield report()
                seen.clear()
        yield report()

    return common.map_batches(texts.select("t"), run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))


def encoded(texts: DataFrame, hashes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The kept features of the positives and of the unlabelled; nothing else of the texts comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(hashes.tolist())
        for batch in common.in_slices(batches, 128):
            found = pa.array([sorted(features(t) & wanted) for t in batch.column("t").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("u"), found], ["p", "u", "f"])

    rows = sorted((tuple(r.f), r.p, r.u) for r in common.map_batches(texts, run, "p boolean, u boolean, f array<long>").collect())
    return [np.array(f, np.int64) for f, p, _ in rows if p], [np.array(f, np.int64) for f, _, u in rows if u]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = 4000, most_unlabelled: int = 12000, least_docs: int = 5, least_lift: float = 10.0) -> Model:
    """labels holds only rows that may be learned from; the unlabelled are drawn from all of docs, as the prior is."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).alias("y"))
    row = known.agg(F.avg(F.col("y").cast("double")).alias("prior"), F.count("*").alias("n")).first()
    prior = float(row.prior or 0.0)

    def least(ids: DataFrame, most: int, salt: int) -> DataFrame:
        return ids.orderBy(F.xxhash64(F.lit(salt), id_col), id_col).limit(most).select(id_col)

    positives = least(known.where("y"), most_positive, 1)
    others = least(docs.where(F.col(id_col).isNotNull()).select(id_col).distinct(), most_unlabelled, 2)
    texts = sample(docs, positives, others, id_col, text_col)
    sizes = texts.agg(F.count_if("p").alias("p"), F.count_if("u").alias("u")).first()
    seen = sorted(tuple(r) for r in count_features(texts.where("p"), None).where(F.col("n") >= least_docs).collect())
    hashes, n_p = (np.array([r[i] for r in seen], np.int64) for i in (0, 1))
    other = {r.f: r.n for r in count_features(texts.where("u"), hashes).collect()}
    n_u = np.array([other.get(h, 0) for h in hashes.tolist()], np.int64)
    kept = hashes[telling(n_p, n_u, sizes.p, sizes.u, prior, least_docs, least_lift)]
    return fit(*encoded(texts, kept), prior, hashes=kept)


def scorer(model: Model) -> Callable[[pa.Array], list[pa.Array]]:
    """A function of an array of texts: the probability that each is toxic."""
    weights, bias = model.table(), model.bias
    of_word: dict[str, tuple] = {}  # words and beginnings that a worker has seen, emptied at a size
    of_beginning: dict[str, tuple[float, ...] | None] = {}

    def beginning(b: str) -> tuple[float, ...] | None:
        if b not in of_beginning:
            found = tuple(weights.get(key(b, j), 0.0) for j in range(1, TIMES + 1))
            of_beginning[b] = found if any(found) else None
        return of_beginning[b]

    def word(w: str) -> tuple:
        """Weights of a word that occurs once and twice, and its beginnings that have weights."""
        found = weights.get(key(w, 1), 0.0), weights.get(key(w, 2), 0.0), [b for b in beginnings(w) if beginning(b)]
        of_word[w] = found if any(found) else ()
        return of_word[w]

    def margin(text: str | None) -> float:
        parts, begun = [bias], Counter()
        for w, n in Counter(_LETTERS.findall(text.lower())).items() if text and weights else ():
            found = of_word.get(w)
            if found is None:
                found = word(w)
            if found:
                parts += [found[0], found[1] if n > 1 else 0.0]
                for b in found[2]:
                    begun[b] += n
        for b, n in begun.items():
            parts += beginning(b)[:n]
        return math.fsum(parts)  # exact, so the order of words is of no effect

    def run(texts: pa.Array) -> list[pa.Array]:
        if len(of_word) > 100_000:
            of_word.clear()
            of_beginning.clear()
        z = np.array([margin(t) for t in texts.to_pylist()], float)
        return [pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 9))]

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a column score, the probability that a text is toxic, in place of any of that name."""
    return common.extend(docs, [text_col], {"score": "double"}, scorer(model))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold, learned from the labels of the rows at hand."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs.select("doc_id", "text"), labels.join(docs.select("doc_id"), "doc_id", "left_semi"))
    return common.filtered(docs, ["text"], {"score": "double"}, scorer(model), F.col("score") < THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = common.id_fold("doc_id", 3)
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold != 1)
    model = train(docs.where(fold != 1), labels)
    held_out = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    scored = score(docs.select("doc_id", held_out, "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
