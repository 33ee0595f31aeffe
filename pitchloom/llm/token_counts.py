"""Token counts under a unigram model, by dynamic programming that shares prefixes in a trie.

A text is cut at white space and each pre-token (with the space mark before it) is segmented into the pieces of
greatest total score. A task inserts its distinct pre-tokens in a trie, and a node holds the best score of the prefix
it stands for and how many tokens that takes: both follow from the nodes above it, whatever comes after, so they are
computed once for all pre-tokens that share the prefix. A pre-token's node stores its count of tokens (its terminal
count), and a text's count is the sum over its pre-tokens. No pre-token is shuffled.

Pieces are those of a public vocabulary; their scores are log probabilities by rank, -ln(rank + 1), of a Zipf law
(nothing is trained). Ties take fewer tokens. A character that no piece covers costs one token for each byte of its
UTF-8, and more than any piece.

The trie is emptied when it holds ``most_nodes`` nodes; that costs time and changes no count.

Cases: null and empty texts, or only white space, have no token; a very long pre-token is a long path of the trie;
repeated rows count alike; an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE_MARK = "▁"


def rank_scores(pieces: list[str]) -> dict[str, float]:
    """Scores of pieces given from the most to the least frequent."""
    return {p: -math.log(i + 2) for i, p in enumerate(pieces)}


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece file in the order of their ids, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


class Trie:
    """Nodes are numbers; node 0 is the empty prefix. best and tokens hold each prefix's forward score and count.

    ``endings`` has every ending of every piece, with the score of those that are pieces: the pieces that end at a
    character are found by growing a stretch to the left until it ends no piece.
    """

    def __init__(self, scores: dict[str, float], most_nodes: int = 1_500_000):
        self.scores, self.most_nodes = scores, most_nodes
        self.endings: dict[str, float | None] = {}
        for piece in scores:
            for i in range(1, len(piece)):
                self.endings.setdefault(piece[i:], None)
        self.endings |= scores
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a pre-token; its path is inserted where it is not yet there."""
        found = self.terminal.get(word)
        if found is None:
            found = self.terminal[word] = self._insert(word)
        return found

    def total(self, words: list[str]) -> int:
        """Tokens of the pre-tokens of a text."""
        found = list(map(self.terminal.get, words))
        return sum(found) if None not in found else sum(map(self.count, words))

    def _insert(self, word: str) -> int:
        children, best, tokens, endings = self.children, self.best, self.tokens, self.endings
        path, node = [0], 0
        for i, c in enumerate(word):
            after = children.get((node, c))
            if after is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                score, count = best[node] + size * self.unknown, tokens[node] + size
                for j in range(i, -1, -1):
                    piece = endings.get(word[j : i + 1], 0.0)
                    if piece is None:
                        continue
                    if piece == 0.0:  # no ending of a piece; scores are negative
                        break
                    above = path[j]
                    s, n = best[above] + piece, tokens[above] + 1
                    if s > score or (s == score and n < count):
                        score, count = s, n
                after = children[node, c] = len(best)
                best.append(score)
                tokens.append(count)
            path.append(after)
            node = after
        return tokens[node]

    def room(self) -> None:
        if len(self.best) > self.most_nodes:
            self.clear()


CACHE = "tries"


def worker_trie(pieces: list[str]) -> Trie:
    """A worker's trie for a vocabulary; workers are reused across tasks, and so is what they inserted."""
    key = hash(tuple(pieces))
    held = common.worker_caches.setdefault(CACHE, {})
    if key not in held:
        held.clear()
        held[key] = Trie(rank_scores(pieces))
    return held[key]


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row; pieces (a vocabulary, of bounded size) go to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_trie(pieces)
        for batch in common.in_slices(batches):
            pretokens, tokens = [], []
            for text in batch.column("t").to_pylist():
                words = [SPACE_MARK + w for w in text.split()] if text else []
                pretokens.append(len(words))
                tokens.append(trie.total(words))
                trie.room()
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")), run, "doc_id long, n_pretokens long, n_tokens long", CACHE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import vocabulary

    return token_counts(common.table(spark, sf_dir, "documents"), vocabulary_pieces(vocabulary("piece_bpe_32k.model")))
