"""Mixing sources to target weights, by Efraimidis-Spirakis sampling; DataFrame functions only.

Sizes are words. Targets share the whole by the sources' weights; a target stops at ``most`` times its source, and
the excess is shared again by weight until none is above. That end point is a water level: with sources in order of
most x size / weight, the first k are full, and the level is what is left over the weight that is left.

A source is then taken floor(target / size) times whole (its complete epochs), and the fraction that remains is a
weighted sample without replacement: each document has the exponential key -ln(u) / quality, and documents are taken
in the order of their keys while the running sum of sizes keeps within the budget. The document that crosses the budget
is passed over, and so are all behind it that are longer than the gap that is left; of the others the order is gone
through once more, while their running sum keeps within the gap. Then the one whose size is nearest to what is left is
taken if that comes nearer than none, and so on for ``fillers`` documents at most. u comes from the md5 of seed and id,
so reruns agree.

A running sum never gathers a source in one task: keys fall into ranges of equal width, about as many as a range has
documents; sums of the ranges (one row for each source and range) are summed over earlier ranges, and only within a range
are documents ordered.

Cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, last; an id that is null
draws as the empty text; rows that repeat an id and text are separate rows, told apart by their order; sources of
size 0 have target 0; where less than a word of budget is left, no document is taken beyond the epochs, empty ones
included; an empty table gives no row; other columns, whatever their names, are kept by ``mix`` and ``stage`` and ignored
by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Characters that count against a text's quality.
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of characters that are no symbols, at least 0.05; 1 for an empty text."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), F.length(F.translate(text, SYMBOLS, "")) / n))


def sampling_key(id_text: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u from 52 bits of md5, never 0."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), id_text).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**52))) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source, the only global windows.

    Weights repeat over sources in code point order, null last.
    """
    position = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (position + 1).cast("int")).cast("long")).withColumn("cap", (F.col("source_size") * most).cast("long"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # what is left for a source and those after it, if all before it are full
    left = listed.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.row_number().over(fill).alias("rank"),
    )
    # a source is full if its cap is within the level; the first that is not sets the level for all after it
    full = F.col("cap") * F.col("weight_left") <= F.col("words_left") * F.col("weight")
    first = F.min_by(F.struct("words_left", "weight_left"), F.when(~full, F.col("rank"))).over(every)
    first_rank = F.min(F.when(~full, F.col("rank"))).over(every)
    level = left.select("*", first.alias("level"), first_rank.alias("first"))
    open_ = F.col("rank") >= F.col("first")
    target = F.when(open_, F.col("level.words_left").cast("double") * F.col("weight") / F.col("level.weight_left")).otherwise(F.col("cap").cast("double"))
    return level.select("source", "source_size", target.alias("target"))


def allot(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", fillers: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, times): how often the mix takes each document."""
    text = F.col(text_col)
    drawn = common.durable(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), sampling_key(F.coalesce(F.col(id_col).cast("string"), F.lit("")), quality_weight(text), seed).alias("key"), F.xxhash64(text).alias("tie")),
        "drawn",
    )
    counted = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    counted = common.durable(counted, "sources")
    goal = targets(counted.drop("rows"), weights, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("g", F.struct("source")).drop("source")
    # keys are exponential of rate 1 at most, so of n documents a range of 1 / sqrt(n) has about sqrt(n) at most
    ranges = counted.select(F.struct("source").alias("g"), F.sqrt("rows").alias("ranges"))
    goal = common.durable(goal.join(ranges, "g"), "targets")

    # goal has a row for each source; Spark broadcasts it below its own size limit and else joins by shuffle
    ranged = drawn.withColumn("g", F.struct("source")).join(goal.select("g", "ranges"), "g").withColumn("range", F.floor(F.col("key") * F.col("ranges"))).drop("ranges")
    in_order = Window.partitionBy("g", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "tie")
    placed = ranged.select("doc_id", "source", "size", "g", "range", F.row_number().over(in_order).alias("place"))
    placed = common.durable(running(placed, "size", "upto"), "placed")

    first = (F.col("upto") <= F.col("budget")) & (F.col("budget") >= 1)
    reached = placed.join(goal, "g").groupBy("g").agg(F.max(F.when(first, F.col("upto"))).alias("reached"))
    left = goal.join(reached, "g").withColumn("gap", F.when(F.col("budget") >= 1, F.col("budget")).otherwise(F.lit(0.0)) - F.coalesce("reached", F.lit(0)))
    left = common.durable(left.drop("reached"), "mix-gap")
    fits = ~first & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    again = placed.join(left.select("g", "budget", "gap"), "g").withColumn("short", F.when(fits, F.col("size")).otherwise(F.lit(0)))
    again = running(again, "short", "upto2")
    second = (F.col("short") > 0) & (F.col("upto2") <= F.col("gap"))
    again = again.select("doc_id", "source", "size", "g", "range", "place", (first | second).alias("taken"), F.when(second, F.col("upto2")).alias("filled"))
    placed = common.durable(again, "mix-placed")

    filled = placed.groupBy("g").agg(F.coalesce(F.max("filled"), F.lit(0)).alias("filled"))
    state = left.join(filled, "g").select("g", "source_size", "target", "epochs", "budget", (F.col("gap") - F.col("filled")).alias("gap"), F.expr("cast(array() as array<struct<range: bigint, place: int>>)").alias("fills"))
    here = F.struct("range", "place")
    for _ in range(fillers):
        state = common.durable(state, "mix-state")
        behind = placed.join(state, "g").where(~F.col("taken") & (F.col("budget") >= 1) & (F.col("size") > 0) & ~F.array_contains("fills", here))
        best = behind.groupBy("g").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "range", "place", "size")).alias("best"))
        nearer = F.col("best.off") < F.abs("gap")
        state = state.join(best, "g", "left").select(
            *["g", "source_size", "target", "epochs", "budget"],
            F.when(nearer, F.col("gap") - F.col("best.size")).otherwise(F.col("gap")).alias("gap"),
            F.when(nearer, F.array_append("fills", F.struct("best.range", "best.place"))).otherwise(F.col("fills")).alias("fills"),
        )
    out = placed.join(common.durable(state, "mix-state"), "g")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") + F.when(F.col("taken") | F.array_contains("fills", here), 1).otherwise(0)).alias("times"))


def running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (g, range, place, ...) with the running sum of a value over each g, in the order of range and place."""
    summed = rows.groupBy("g", "range").agg(F.sum(value).alias("__n"))
    earlier = summed.select("g", "range", (F.sum("__n").over(Window.partitionBy("g").orderBy("range")) - F.col("__n")).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("g", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__sum", within).join(earlier, ["g", "range"]).withColumn(name, F.col("__before") + F.col("__sum")).drop("__before", "__sum")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as many times as it is taken; rows that repeat an id share their takes in order.

    Options are those of allot.
    """
    taken = allot(docs, **options).groupBy("doc_id").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).where("times > 0")
    several = taken.where("rows > 1 or doc_id is null")
    columns = docs.columns
    named = docs.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(columns)})
    own = F.col(f"_{columns.index('doc_id')}")
    back = [F.col(f"_{i}").alias(c) for i, c in enumerate(columns)]
    single = named.join(taken.where("rows = 1 and doc_id is not null"), own == F.col("doc_id"))
    out = single.select(*back, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("__n")).drop("__n")
    if not several.isEmpty():
        # rows of one id, in the order of their text: the takes are dealt round
        w = Window.partitionBy("doc_id").orderBy(f"_{columns.index('text')}")
        rows = named.join(several, own.eqNullSafe(F.col("doc_id"))).withColumn("__r", F.row_number().over(w))
        each = F.floor(F.col("times") / F.col("rows")) + F.when(F.col("__r") <= F.col("times") % F.col("rows"), 1).otherwise(0)
        out = out.union(rows.withColumn("__e", each.cast("int")).where("__e > 0").select(*back, F.explode(F.sequence(F.lit(1), F.col("__e"))).alias("__n")).drop("__n"))
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = allot(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("times")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0
                  ELSE greatest(0.05, length(translate(text, '#*$%&|<>', ''))::DOUBLE / length(text)) END AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS rank,
             sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
             sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
l AS (SELECT min(rank) AS first, arg_min(words_left, rank) AS words_left, arg_min(weight_left, rank) AS weight_left
      FROM f WHERE cap * weight_left > words_left * weight),
g AS (SELECT f.source, f.source_size,
             CASE WHEN f.rank >= l.first THEN l.words_left::DOUBLE * f.weight / l.weight_left ELSE f.cap::DOUBLE END AS target
      FROM f, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
             target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS budget FROM g),
p AS (SELECT d.doc_id, d.size, e.source, e.source_size, e.target, e.epochs, e.budget, d.key,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
g1 AS (SELECT source, CASE WHEN max(budget) >= 1 THEN max(budget) ELSE 0.0 END - coalesce(max(upto) FILTER (WHERE upto <= budget AND budget >= 1), 0) AS gap FROM p GROUP BY source),
p1 AS (SELECT p.*, g1.gap AS gap1, p.upto <= p.budget AND p.budget >= 1 AS first FROM p JOIN g1 ON p.source IS NOT DISTINCT FROM g1.source),
p2 AS (SELECT *, CASE WHEN NOT first AND size > 0 AND size <= gap1 THEN size ELSE 0 END AS short FROM p1),
p3 AS (SELECT *, sum(short) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto2 FROM p2),
q AS (SELECT *, first OR (short > 0 AND upto2 <= gap1) AS took, CASE WHEN short > 0 AND upto2 <= gap1 THEN upto2 END AS filled FROM p3),
s0 AS (SELECT source, max(gap1) - coalesce(max(filled), 0) AS gap, []::BIGINT[] AS fills FROM q GROUP BY source){steps}
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, round(q.target, 6) AS target,
       (q.size * (epochs + CASE WHEN took OR list_contains(z.fills, q.doc_id) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q JOIN s3 z ON q.source IS NOT DISTINCT FROM z.source
"""
_STEP = """,
b{i} AS (SELECT p.source, arg_min({{'id': doc_id, 'size': size}}, {{'off': abs(size - gap), 'key': key}}) AS best, min(abs(size - gap)) AS off
       FROM q p JOIN s{j} s ON p.source IS NOT DISTINCT FROM s.source
       WHERE NOT took AND budget >= 1 AND size > 0 AND NOT list_contains(fills, doc_id) GROUP BY p.source),
s{i} AS (SELECT s.source, CASE WHEN off < abs(gap) THEN gap - best.size ELSE gap END AS gap,
              CASE WHEN off < abs(gap) THEN list_append(fills, best.id) ELSE fills END AS fills
       FROM s{j} s LEFT JOIN b{i} b ON s.source IS NOT DISTINCT FROM b.source)"""
SQL = SQL.replace("{steps}", "".join(_STEP.format(i=i, j=i - 1) for i in (1, 2, 3)))
