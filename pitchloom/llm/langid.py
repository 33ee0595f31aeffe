"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, seeded by its code point. A trigram's vector binds (multiplies) the
vectors of its letters, each permuted (rotated) by its place; a text's vector bundles (adds) those of its trigrams, a
language's prototype those of its training texts. A document is given the language of greatest cosine.

Training is one pass over all training texts: since bundling is linear, a prototype is the sum of each trigram's
vector times its count, so tasks only count trigrams for each language, Spark sums the counts, tasks bundle what they
have, and Spark sums that: (languages x dimensions) numbers reach the driver. All are whole numbers, so reruns agree.
Tables in a task are emptied at a size, so a text of any length and alphabet fits.

Letters are lower-cased; runs of anything else are one space. Code points beyond the first 1,024 share 1,024 hashed
places, which bounds the vectors of any corpus.

Cases: a null text, or one without a letter, is ``und`` with score 0; a text of one or two letters has no whole
trigram inside it but those with the spaces around it; null languages and null ids are not learned from; ties go to
the language that sorts first; with no language learned, all is ``und``; repeated rows are predicted alike; an empty
table gives no row; other columns, whatever their names, are kept, but one of the result's names gives way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Direct places for code points, hashed places beyond them, and the space at 0.
DIRECT, HASHED = 1024, 1024
PLACES = DIRECT + HASHED
UNDETERMINED = "und"
#: Trigrams whose dense counts and vectors are held at once, and distinct trigrams that tell a language.
BLOCK, TELLING = 4096, 10


@lru_cache(1)
def letter_places() -> np.ndarray:
    """Place of each code point: 0 if it is no letter, else that of its lower case."""
    out = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[point] = low if low < DIRECT else DIRECT + low * 2654435761 % 2**32 % HASHED
    return out


@lru_cache(4)
def letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, (PLACES, dimensions), np.int8) * np.int8(2) - np.int8(1)


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (as numbers) of a text with one space around it, and how often each occurs."""
    places = letter_places()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = places > 0
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = places[letter | np.r_[False, letter[:-1]]].astype(np.int64)  # of each run of other characters, the first
    kept = np.r_[0, kept[np.argmax(kept > 0) :]]
    if kept[-1]:
        kept = np.r_[kept, 0]
    ids = (kept[:-2] * PLACES + kept[1:-1]) * PLACES + kept[2:]
    ids.sort()
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[starts], np.diff(np.r_[starts, len(ids)])


def trigram_vectors(ids: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    letters = letter_vectors(dimensions, seed)
    out = np.roll(letters, 2, axis=1)[ids // PLACES**2]
    out *= np.roll(letters, 1, axis=1)[ids // PLACES % PLACES]
    out *= letters[ids % PLACES]
    return out


class Vectors:
    """A task's table of trigram vectors, a byte for each number; emptied when it holds most trigrams it may."""

    def __init__(self, dimensions: int, seed: int, most: int = 40_000):
        self.dimensions, self.seed, self.most = dimensions, seed, most
        self._empty()

    def _empty(self) -> None:
        self.ids = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.table = np.zeros((0, self.dimensions), np.int8)

    def bundle(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each text: its dense counts of the trigrams that the texts have, times those trigrams' vectors."""
        row = np.repeat(np.arange(len(counted)), [len(ids) for ids, _ in counted])
        ids, column = np.unique(np.concatenate([ids for ids, _ in counted]), return_inverse=True)
        n = np.concatenate([n for _, n in counted])
        out = np.zeros((len(counted), self.dimensions), np.float32)
        order = np.argsort(column, kind="stable")
        for at in range(0, len(ids), BLOCK):
            own = order[np.searchsorted(column[order], at) : np.searchsorted(column[order], at + BLOCK)] if len(ids) > BLOCK else order
            part = ids[at : at + BLOCK]
            counts = np.zeros((len(counted), len(part)), np.float32)
            counts[row[own], column[own] - at] = n[own]
            out += counts @ self._vectors(part)
        return out

    def _vectors(self, ids: np.ndarray) -> np.ndarray:
        fresh = np.setdiff1d(ids, self.ids, assume_unique=True)
        if len(fresh):
            if len(self.ids) + len(fresh) > self.most:
                self._empty()
                fresh = ids
            self.at = np.r_[self.at, len(self.table) + np.arange(len(fresh))]
            self.table = np.concatenate([self.table, trigram_vectors(fresh, self.dimensions, self.seed)])
            self.ids = np.r_[self.ids, fresh]
            order = np.argsort(self.ids, kind="stable")
            self.ids, self.at = self.ids[order], self.at[order]
        return self.table[self.at[np.searchsorted(self.ids, ids)]].astype(np.float32)


def count_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 1_000_000) -> DataFrame:
    """(lang, trigram, n) over all texts with a language, counted by task and then summed.

    A task reports what it has when that is ``most`` trigrams, and begins anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        pending = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            ids, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return ids, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def report() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                ids, n = parts[0] if len(parts) == 1 else merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(n)], ["lang", "trigram", "n"])
            held.clear()

        for batch in common.in_slices(batches):
            for lang, text in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist(), strict=True):
                found = trigram_counts(text)
                held.setdefault(lang, []).append(found)
                pending += len(found[0])
                if pending > most:
                    for k, v in held.items():
                        held[k] = [merged(v)]
                    pending = sum(len(v[0][0]) for v in held.values())
                    if 2 * pending > most:  # merging no longer helps
                        yield from report()
                        pending = 0
        yield from report()

    data = docs.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    return common.map_batches(data, run, "lang string, trigram long, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


def prototypes(profiles: DataFrame, dimensions: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes; each task bundles what it has, and Spark adds whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.in_slices(batches, 4096):
            langs, ids, n = np.array(batch.column("lang").to_pylist()), batch.column("trigram").to_numpy(), batch.column("n").to_numpy()
            for lang in np.unique(langs):
                own = langs == lang
                part = n[own].astype(np.float64) @ trigram_vectors(ids[own], dimensions, seed).astype(np.float64)
                sums[lang] = sums.get(lang, 0) + np.rint(part).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"])

    summed = common.map_batches(profiles, run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    total: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x dimensions
        total.setdefault(r.lang, np.zeros(dimensions, np.int64))[r.i] = r.v
    langs = sorted(total)
    return langs, np.array([total[x] for x in langs], np.float64).reshape(len(langs), dimensions)


def predictor(training: DataFrame, lang_col: str, text_col: str, dimensions: int, seed: int) -> Callable[[pa.Array], list[pa.Array]]:
    """A function of an array of texts: the language, the cosine and the number of distinct trigrams of each."""
    langs, vectors = prototypes(count_profiles(training, lang_col, text_col), dimensions, seed)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)

    held: list[Vectors] = []  # of a task, which has this function to itself

    def predict(texts: pa.Array) -> list[pa.Array]:
        if not held:
            held.append(Vectors(dimensions, seed))
        table = held[0]
        counted = [trigram_counts(t or "") for t in texts.to_pylist()]
        found, scores = [UNDETERMINED] * len(counted), [0.0] * len(counted)
        some = [i for i, (ids, _) in enumerate(counted) if len(ids)]
        if some and langs:
            v = table.bundle([counted[i] for i in some])
            cosines = np.round(v @ unit.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30), 5)
            for i, best, score in zip(some, cosines.argmax(axis=1), np.clip(cosines.max(axis=1), 0, 1).tolist(), strict=True):
                found[i], scores[i] = langs[best], score
        return [pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array([len(ids) for ids, _ in counted], pa.int64())]

    return predict


_RESULT = {"lang_pred": "string", "score": "double", "n_trigrams": "long"}


def identify(docs: DataFrame, training: DataFrame, *, lang_col: str = "lang", text_col: str = "text", dimensions: int = 1024, seed: int = 7) -> DataFrame:
    """docs with lang_pred, score (the cosine, 0 if negative) and n_trigrams (distinct), learned from the rows of training."""
    return common.extend(docs, [text_col], _RESULT, predictor(training, lang_col, text_col, dimensions, seed), 128)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, dimensions: int = 1024, seed: int = 7) -> DataFrame:
    """Documents with a language: those without a letter, or unlike every language, go.

    Learned from the rows with a language, of whatever fold. The cosine of a text that shares no trigram with a language
    spreads by 1 / sqrt(dimensions), so one below three times that is unlike it, if the text has TELLING trigrams or
    more; a shorter text stays if it has a letter, as a few trigrams tell too little.
    """
    predict = predictor(docs, docs.columns[common.named(docs.columns, "lang")], docs.columns[common.named(docs.columns, "text")], dimensions, seed)
    like = (F.col("lang_pred") != UNDETERMINED) & ((F.col("score") >= 3 / dimensions**0.5) | (F.col("n_trigrams") < TELLING))
    return common.filtered(docs, ["text"], _RESULT, predict, like, 128)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    fold = common.id_fold("doc_id", 4)
    found = identify(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), docs.where(fold != 2))
    return found.select("doc_id", "held_out", "lang_pred", "score")
