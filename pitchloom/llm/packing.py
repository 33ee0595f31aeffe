"""Best-fit packing: a configuration linear program over the length histogram, rounded to whole sequences.

1. ``encode_pieces`` encodes whole texts, appends the end id and cuts only documents above the capacity. A piece
   carries its rank among the pieces of its length that its task made, so no shuffle ranks them later.
2. The histogram of lengths (at most ``capacity`` rows, whatever the input) is collected. ``plan`` solves the
   configuration program: a column is a set of lengths that fits one sequence; multiplicative weights raise the duals
   of lengths whose coverage lags; pricing is a 0/1 knapsack dynamic program whose one table yields the best column
   with each length as its longest. Fractional columns are rounded to whole ones that the histogram can fill, and
   what remains is placed by best fit decreasing, on the histogram, too.
3. A piece's global rank is its task's rank plus the pieces of its length in earlier tasks (a window over one row for
   each task and length). Ranks index the plan, which maps them to a sequence and an offset.

The plan has at most a few columns for each length and round: its size does not grow with the input. A hot length is
no hot key: the shuffle is by task and length.

Cases: null and empty texts are one piece, the end id; repeated ids are separate documents; an empty table packs into
no sequence; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import CACHE, encoder


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_entries: int = 2_000_000) -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32, part, rank, and ids if asked."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer, cache_entries)
        for batch in common.in_slices(batches, 256):
            keys, pieces = batch.column("k").to_pylist(), []
            for key, ids in zip(keys, encode.ids(batch.column("t").to_pylist()), strict=True):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                pieces += [(key, i, at, ids[at : at + capacity]) for i, at in enumerate(range(0, len(ids), capacity))]
            length = np.array([len(p[3]) for p in pieces], np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.r_[True, ordered[1:] != ordered[:-1]]
            within = np.arange(len(ordered)) - np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
            rank = np.empty(len(ordered), np.int64)
            rank[order] = seen[ordered] + within
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [
                pa.array([p[0] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int32()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array(length),
                pa.array([zlib.crc32(p[3].tobytes()) for p in pieces], pa.int64()),
                pa.array(np.full(len(pieces), part, np.int32)),
                pa.array(rank),
            ]
            if with_ids:
                columns.append(pa.array([p[3].astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"][: len(columns)])

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("k"), common.text_column(text_col).alias("t")), run, schema, CACHE)


# ---------------------------------------------------------------- the program


def price(duals: np.ndarray, left: np.ndarray, capacity: int) -> Iterator[dict[int, int]]:
    """For each length that is left, longest first, the column of greatest dual value that has it as its longest.

    A bounded knapsack: a length's multiples are split into powers of two, each an item. table[i] holds for each
    capacity the last item taken among the first i, so a column is read off in as many steps as it has items.
    """
    items: list[tuple[int, int]] = []
    of: dict[int, int] = {}
    for length in np.flatnonzero(left).tolist():
        of[length] = len(items)
        many, power = min(int(left[length]), capacity // length), 1
        while many > 0:
            take = min(power, many)
            items.append((length, take))
            many, power = many - take, power * 2
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int32)
    table = np.empty((len(items) + 1, capacity + 1), np.int16 if len(items) < 32768 else np.int32)
    table[0] = -1
    for i, (length, take) in enumerate(items):
        size = length * take
        with_it = best[: capacity + 1 - size] + duals[length] * take
        better = with_it > best[size:] + 1e-15
        best[size:][better] = with_it[better]
        last[size:][better] = i
        table[i + 1] = last
    for length in sorted(of, reverse=True):
        column, room, i = {length: 1}, capacity - length, of[length]
        while (i := int(table[i, room])) >= 0:
            column[items[i][0]] = column.get(items[i][0], 0) + items[i][1]
            room -= items[i][0] * items[i][1]
        yield column


def solve(histogram: np.ndarray, capacity: int, rounds: int = 12, slack: float = 0.02, rate: float = 4.0) -> list[tuple[dict[int, int], float]]:
    """Fractional columns that together use no length more often than it occurs.

    The duals start at length / capacity, whose value is the volume bound. In each round the columns whose value is
    within the slack of the best are raised in turn, by a share of what their scarcest length has left; then the
    duals of lengths that lag behind the mean coverage grow by exp(rate x lag), and of those ahead shrink.
    """
    lengths = np.arange(capacity + 1)
    wanted, left, lag = histogram.astype(float), histogram.astype(float), np.zeros(capacity + 1)
    found: dict[tuple, list] = {}
    for turn in range(rounds):
        if not (left > 1e-9).any():
            break
        duals = lengths / capacity * np.exp(rate * lag)
        columns = list(price(duals, np.ceil(left - 1e-9).astype(np.int64), capacity))
        values = np.array([sum(duals[k] * n for k, n in c.items()) for c in columns])
        share = 1.0 / (rounds - turn)
        for column, value in zip(columns, values, strict=True):
            if value < (1 - slack) * values.max() and turn < rounds - 1:
                continue
            step = share * min(left[k] / n for k, n in column.items())
            if step <= 0:
                continue
            for k, n in column.items():
                left[k] = max(0.0, left[k] - n * step)
            held = found.setdefault(tuple(sorted(column.items())), [column, 0.0])
            held[1] += step
        covered = 1 - np.divide(left, wanted, out=np.zeros(capacity + 1), where=wanted > 0)
        lag = np.where(wanted > 0, (left.sum() and 1 - left.sum() / wanted.sum()) - covered, 0)
    return [(c, x) for c, x in found.values()]


def rounded(fractional: list[tuple[dict[int, int], float]], histogram: np.ndarray) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole columns that the histogram can fill, and what is left.

    First the whole part of each; then each is rounded up as far as its pieces are there, longest piece first, since
    long pieces have the fewest places.
    """
    left, out = histogram.astype(np.int64).copy(), []
    by_use, by_length = lambda c: -c[1], lambda c: (-max(c[0]), -c[1])
    for order, whole in ((by_use, lambda x: np.floor(x + 1e-9)), (by_length, lambda x: np.ceil(x - 1e-9))):
        for column, x in sorted(fractional, key=order):
            times = int(min(whole(x), min(left[k] // n for k, n in column.items())))
            if times > 0:
                for k, n in column.items():
                    left[k] -= n * times
                out.append((column, times))
    return out, left


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing with equal bins kept together: longest first, into the fullest bins with room."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}  # by room
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[length])
        while n > 0:
            at = np.flatnonzero(rooms[length:])
            if not len(at):
                each = capacity // length
                whole, rest = divmod(n, each)
                for many, times in ((each, whole), (rest, 1)):
                    if many and times:
                        room = capacity - many * length
                        bins.setdefault(room, []).append(({length: many}, times))
                        rooms[room] = True
                break
            room = length + int(at[0])
            column, times = bins[room].pop()
            if not bins[room]:
                rooms[room] = False
            each = min(room // length, n)
            used = min(times, n // each)
            if used < times:
                bins.setdefault(room, []).append((column, times - used))
                rooms[room] = True
            grown = dict(column)
            grown[length] = grown.get(length, 0) + each
            bins.setdefault(room - each * length, []).append((grown, used))
            rooms[room - each * length] = True
            n -= used * each
    return [b for held in bins.values() for b in held]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Columns with the number of sequences that each fills; together they hold the histogram exactly."""
    histogram = np.asarray(histogram, np.int64)
    whole, left = rounded(solve(histogram, capacity), histogram)
    return whole + best_fit(left, capacity)


class Placement:
    """Where the piece of a length and rank goes; arrays over the runs of equal lengths in the plan's columns."""

    def __init__(self, columns: list[tuple[dict[int, int], int]], histogram: np.ndarray):
        runs, sequence = [], 0
        for column, times in columns:
            offset = 0
            for length, many in sorted(column.items(), reverse=True):
                runs.append((length, many * times, sequence, offset, many))
                offset += length * many
            sequence += times
        self.sequences = sequence
        runs.sort(key=lambda r: r[0])
        length, count, self.sequence, self.offset, self.many = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 5
        self.first = np.cumsum(count) - count  # over all lengths in order
        self.before = np.cumsum(histogram) - histogram

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.before[length] + rank
        run = np.searchsorted(self.first, at, side="right") - 1
        within = at - self.first[run]
        return self.sequence[run] + within // self.many[run], self.offset[run] + within % self.many[run] * length


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces (a durable table of encode_pieces) with sequence_id and offset."""
    counts = pieces.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    place = Placement(plan(histogram, capacity), histogram)
    bases = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")

    keep = [c for c in pieces.columns if c not in ("part", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("base").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {kind}" for c, kind in pieces.dtypes if c not in ("part", "rank")) + ", sequence_id bigint, offset bigint"
    return pieces.join(bases, ["part", "length"]).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, with_ids: bool = False, cache_entries: int = 2_000_000) -> DataFrame:
    return pack(common.durable(encode_pieces(docs, tokenizer, end_id, capacity, with_ids=with_ids, cache_entries=cache_entries), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import vocabulary

    packed = pack_documents(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
