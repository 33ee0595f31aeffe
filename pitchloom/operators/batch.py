"""Row-wise similarity of paired multisets, each distinct pair computed once in a task.

Rows that differ only by what the similarity ignores share a canonical pair: a common transposition (absolute), each
set's own transposition (relative), octaves (periodic). Keys are expressions of one row; one shuffle makes the rows of a
pair neighbours, and the first of each run is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pitch import partials
from ..model import SpectrumSpec, TensorParams
from .tensor import cosine_of_rows


#: Tasks that share the rows of one pair at most.
SALTS = 16


def elements(p: Column, w: Column | None) -> Column:
    """ARRAY<STRUCT<p, w>> in order, without padding and the weights beside it.

    No weights, or an empty array of them, are all 1; one is every element's; another number than of positions raises.
    """
    if w is not None:
        n, m = F.size(p), F.size(w)
        w = F.when(F.coalesce(m, F.lit(0)) == 0, F.array_repeat(F.lit(1.0), n)).when(m == 1, F.array_repeat(F.element_at(w, 1), n)).when(m == n, w).otherwise(F.raise_error(F.lit("weights must be as many as positions, or one")))
    zipped = F.zip_with(p, w, lambda a, b: F.struct(a.alias("p"), F.coalesce(b, F.lit(1.0)).alias("w"))) if w is not None else F.transform(p, lambda a: F.struct(a.alias("p"), F.lit(1.0).alias("w")))
    return F.array_sort(F.filter(zipped, lambda e: e["p"].isNotNull() & ~F.isnan(e["p"])))


def moved(e: Column, by: Column, t: TensorParams) -> Column:
    """Elements transposed down, reduced and in order."""
    p = (lambda x: F.pmod(x["p"] - by, F.lit(float(t.period)))) if t.periodic else (lambda x: x["p"] - by)
    return F.array_sort(F.transform(e, lambda x: F.struct(p(x).alias("p"), x["w"].alias("w"))))


def least_rotation(e: Column, t: TensorParams) -> Column:
    """STRUCT<ps, ws, shift>: of the transpositions that put an element at 0, the least by positions, then weights."""

    def candidate(x: Column) -> Column:
        m = moved(e, x["p"], t)
        return F.struct(F.transform(m, lambda y: y["p"]).alias("ps"), F.transform(m, lambda y: y["w"]).alias("ws"), x["p"].alias("shift"))

    return F.array_min(F.transform(e, candidate))


def rejoined(c: Column) -> Column:
    return F.zip_with(c["ps"], c["ws"], lambda p, w: F.struct(p.alias("p"), w.alias("w")))


def rounded(e: Column, precision: int | None) -> Column:
    return e if precision is None else F.transform(e, lambda x: F.struct(F.bround(x["p"], precision).alias("p"), F.bround(x["w"], precision).alias("w")))


def canonical(rows: DataFrame, t: TensorParams, precision: int | None = None) -> DataFrame:
    """rows (with arrays ea, eb) with their keys ka, kb."""
    if t.relative and t.periodic:
        out = rows.withColumns({"ka": rejoined(least_rotation(F.col("ea"), t)), "kb": rejoined(least_rotation(F.col("eb"), t))})
    elif t.relative:
        out = rows.withColumns({"ka": moved(F.col("ea"), F.col("ea")[0]["p"], t), "kb": moved(F.col("eb"), F.col("eb")[0]["p"], t)})
    elif t.periodic:
        out = rows.withColumn("c", least_rotation(F.col("ea"), t)).withColumns({"ka": rejoined(F.col("c")), "kb": moved(F.col("eb"), F.col("c")["shift"], t)}).drop("c")
    else:
        out = rows.withColumns({"ka": moved(F.col("ea"), F.col("ea")[0]["p"], t), "kb": moved(F.col("eb"), F.col("ea")[0]["p"], t)})
    return out.withColumns({"ka": rounded(F.col("ka"), precision), "kb": rounded(F.col("kb"), precision)})


def enriched(e: Column, spectrum: SpectrumSpec) -> Column:
    """add_spectra() of an array of elements."""
    return F.flatten(F.transform(e, lambda x: F.transform(partials(spectrum), lambda s: F.struct((x["p"] + s["offset"]).alias("p"), (x["w"] * s["weight"]).alias("w")))))


def batch_cos_sim(rows: DataFrame, t: TensorParams, *, weights_a: str | None = None, weights_b: str | None = None, spectrum: SpectrumSpec | None = None, precision: int | None = None) -> DataFrame:
    """(row_id, similarity) of rows (row_id, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>); null where a set has fewer than r values.

    precision rounds positions and weights before and after the keys are made, so that noise does not part them.
    """
    e = rows.select("row_id", rounded(elements(F.col("a"), F.col(weights_a) if weights_a else None), precision).alias("ea"), rounded(elements(F.col("b"), F.col(weights_b) if weights_b else None), precision).alias("eb"))
    enough = F.coalesce((F.size("ea") >= t.r) & (F.size("eb") >= t.r), F.lit(False))
    keyed = canonical(e.where(enough), t, precision)
    name = lambda k: F.to_json(F.col(k))
    named = keyed.select("row_id", "ka", "kb", F.sha2(F.concat(name("ka"), name("kb")), 256).alias("pair"))
    # rows of one pair become neighbours; a pair of many rows is dealt to up to SALTS tasks, and computed in each
    dealt = named.repartition("pair", F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).sortWithinPartitions("pair")
    side = (lambda k: enriched(F.col(k), spectrum)) if spectrum else F.col
    found = cosine_of_rows(dealt.select("row_id", "pair", side("ka").alias("ea"), side("kb").alias("eb")), ["row_id"], t, "pair")
    return found.unionByName(e.where(~enough).select("row_id", F.lit(None).cast("double").alias("similarity")))
