"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a text's statistics. Votes are counted by pattern (at most 3 to the number of
rules, whatever the input). Expectation-maximisation over the counts estimates, for each rule, how often it votes bad
on bad and on good documents when it votes, and the share of good documents. A document's posterior probability of
being good, by its pattern, decides; no rule alone does.

Statistics are of whole texts, one at a time. Windows of five words are compared by a 64-bit hash; only windows whose
hash occurs twice are compared as words, so the counts are exact.

Cases: a null or empty text has no word, so it fails the base rule (fewer than 10 words); where no rule votes, the
share of good documents decides; repeated rows get the same verdict; an empty table gives no row; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GOOD, BAD, ABSTAIN = "g", "b", "-"
WINDOW = 5
_RUNS = re.compile("[#*$%&|<>]+")
_ASCII_UPPER, _BEYOND_ASCII = bytes(range(65, 91)), re.compile("[^\x00-\x7f]+")
RULES = 9


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    suspects = order[np.r_[same, False] | np.r_[False, same]].tolist()
    seen = Counter(tuple(words[i : i + window]) for i in suspects)
    cover = np.zeros(len(words) + 1, np.int64)
    for i in suspects:
        if seen[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def uppers(text: str) -> int:
    """Upper-case letters: the ASCII ones by one deletion, the others one by one."""
    plain = text.encode("utf-8", "surrogatepass")
    n = len(plain) - len(plain.translate(None, _ASCII_UPPER))
    return n if text.isascii() else n + sum(map(str.isupper, "".join(_BEYOND_ASCII.findall(text))))


def statistics(text: str | None) -> dict[str, int]:
    text = text or ""
    words = common.words(text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "n_lines": len(lines),
        "n_upper": uppers(text),
        "n_symbol_runs": len(_RUNS.findall(text)),
        "n_plain": sum(map(str.isalpha, text.split())),
        "n_marks": sum(map(text.count, "!?.,;:|")),
    }


def votes(s: dict[str, int]) -> str:
    """One letter for each rule, in the order given here."""

    def by(bad: bool, good: bool) -> str:
        return BAD if bad else GOOD if good else ABSTAIN

    n, chars = s["n_words"], max(1, s["word_chars"])
    if not n:
        return ABSTAIN * RULES
    mean, symbols, runs, plain = chars / n, s["n_symbols"] / n, s["n_symbol_runs"] / n, s["n_plain"] / n
    lines, repeats, upper, marks = s["n_dup_lines"] / max(1, s["n_lines"]), s["n_repeat_words"] / n, s["n_upper"] / chars, s["n_marks"] / n
    return "".join(
        (
            by(n < 10, n >= 20),
            by(mean < 2.5 or mean > 12, 3 <= mean <= 10),
            by(symbols > 0.1, symbols < 0.02),
            by(runs > 0.1, runs < 0.02),
            by(plain < 0.6, plain > 0.75),
            by(lines > 0.3, lines == 0 and s["n_lines"] > 1),
            by(repeats > 0.2, repeats < 0.1),
            by(upper > 0.5, upper < 0.2),
            by(marks > 0.8, marks < 0.4),
        )
    )


#: What is believed of a rule before any vote is seen, and the share of good documents.
FALSE_ALARM, DETECTION, GOOD_SHARE = 0.005, 0.25, 0.85


def estimate(patterns: dict[str, int], rounds: int = 500, belief: float = 0.1) -> tuple[float, np.ndarray, np.ndarray]:
    """(share good, P(bad vote | good), P(bad vote | bad)) of rules that vote, by expectation-maximisation.

    Defects differ, so a bad document fails few of the rules: a rule is first held to find a quarter of them and to
    be wrong once in 200. That belief counts as the votes of a tenth of the documents, at every size, so that votes
    correct it and which class is which does not turn round.
    """
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    bad = np.array([[c == BAD for c in k] for k in keys], float)
    cast = np.array([[c != ABSTAIN for c in k] for k in keys], float)
    weight = belief * n.sum() + 1
    share, on_good, on_bad = GOOD_SHARE, np.full(bad.shape[1], FALSE_ALARM), np.full(bad.shape[1], DETECTION)
    for _ in range(rounds):
        good = posterior(bad, cast, share, on_good, on_bad)
        before = share, on_good, on_bad
        (b1, c1), (b0, c0) = (((n * q) @ bad, (n * q) @ cast) for q in (good, 1 - good))
        on_good = (b1 + FALSE_ALARM * weight) / (c1 + weight)
        on_bad = (b0 + DETECTION * weight) / (c0 + weight)
        share = float(((n * good).sum() + GOOD_SHARE * weight) / (n.sum() + weight))
        if max(abs(before[0] - share), np.abs(before[1] - on_good).max(), np.abs(before[2] - on_bad).max()) < 1e-10:
            break
    return share, on_good, on_bad


def posterior(bad: np.ndarray, cast: np.ndarray, share: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    good_vote = cast - bad
    odds = np.log(share / (1 - share)) + bad @ np.log(on_good / on_bad) + good_vote @ np.log((1 - on_good) / (1 - on_bad))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the statistics, votes) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            found = [statistics(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array([s[c] for s in found], pa.int64()) for c in _NAMES), pa.array([votes(s) for s in found], pa.string())], ["doc_id", *_NAMES, "votes"])

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")), run, f"doc_id long, {', '.join(f'{c} long' for c in _NAMES)}, votes string")


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Statistics, base_failed, quality_probability and kept for each row of docs."""
    spark = docs.sparkSession
    counted = common.durable(text_statistics(docs), "statistics")
    patterns = {r["votes"]: r["count"] for r in counted.groupBy("votes").count().collect()}  # at most 3 ** rules
    keys = list(patterns) or [ABSTAIN * RULES]
    share, on_good, on_bad = estimate(patterns or {keys[0]: 0})
    good = posterior(np.array([[c == BAD for c in k] for k in keys], float), np.array([[c != ABSTAIN for c in k] for k in keys], float), share, on_good, on_bad)
    verdicts = spark.createDataFrame(list(zip(keys, np.round(good, 9).tolist(), strict=True)), "votes string, quality_probability double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = counted.join(F.broadcast(verdicts), "votes").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= least))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).select("doc_id", *_NAMES, "base_failed", "kept", "quality_probability", "votes")
