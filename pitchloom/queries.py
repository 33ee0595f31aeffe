"""Queries over the star-schema tables, one or more for each operator, each with SQL of its own for comparison.

The SQL is written from the definitions, without the operators' rewrites: no canonical keys, no closed forms, no
falling factorials. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.pitch import FROM_HZ, convert_pitch
from .model import SpectrumSpec, TensorParams
from .operators import batch, circular, harmony, profiles, spectra, tensor
from .plans import grids
from .sources import audio, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Named pitch sets.
DIATONIC = (0, 2, 4, 5, 7, 9, 11)
MAJOR = (0, 4, 7)
JI_TRIAD = (0.0, 1200 * math.log2(5 / 4), 1200 * math.log2(6 / 4))


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def r6(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places (fewer for large sums), without a negative zero."""
    return df.select(*[(F.round(F.col(c), places) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def literal_set(spark: SparkSession, name: str, ps, ws=None) -> DataFrame:
    rows = [(name, float(p), float(w)) for p, w in zip(ps, ws or [1.0] * len(ps), strict=True)]
    return spark.createDataFrame(rows, "set_id string, p double, w double")


def against(df: DataFrame, name: str) -> DataFrame:
    """Pairs of every set with one named set."""
    return df.select(F.col("set_id").alias("a_id")).distinct().withColumn("b_id", F.lit(name))


# ---------------------------------------------------------------- SQL pieces

E24 = "SELECT user_id AS set_id, hour(ts)::DOUBLE AS p, sum(value) AS w FROM events GROUP BY 1, 2"
T24 = "SELECT event_type AS set_id, hour(ts)::DOUBLE AS p, sum(value) AS w FROM events GROUP BY 1, 2"
L12 = "SELECT l_orderkey AS set_id, (l_partkey % 12)::DOUBLE AS p, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2"


def R(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


def WRAP(d: str, period: float) -> str:
    return f"((({d}) + {period / 2}) % {period} + {period}) % {period} - {period / 2}"


def MOD(d: str, n: float) -> str:
    return f"((({d}) % {n}) + {n}) % {n}"


def values(name: str, ps, ws=None) -> str:
    return f"{name}(p, w) AS (VALUES {', '.join(f'({float(p)!r}::DOUBLE, {float(w)!r}::DOUBLE)' for p, w in zip(ps, ws or [1.0] * len(ps), strict=True))})"


def partial_sql(spec: SpectrumSpec) -> str:
    """SELECT o, s of a spectrum's partials."""
    if spec.mode == "custom":
        return "SELECT * FROM (VALUES " + ", ".join(f"({o!r}::DOUBLE, {w!r}::DOUBLE)" for o, w in zip(spec.offsets, spec.weights, strict=True)) + ") v(o, s)"
    k = spec.parameter
    ratio = {"harmonic": "log2(n)", "stretched": f"{k} * log2(n)", "freqlinear": f"log2((n + {k}) / (1.0 + {k}))", "stiff": f"log2(n * sqrt(1 + {k} * n * n) / sqrt(1 + {k}))"}[spec.mode]
    decay = f"power(n, -{float(spec.rate)})" if spec.decay == "powerlaw" else f"power({float(spec.rate)}, n - 1)"
    return f"SELECT {spec.units} * {ratio} AS o, {decay} AS s FROM (SELECT unnest(range(1, {spec.n + 1}))::DOUBLE AS n)"


# ---------------------------------------------------------------- scalars and spectra

_scales = [s for s in FROM_HZ if s != "hz"]


@query("convert_pitch", "SELECT p_partkey, " + ", ".join(R(re.sub(r"(\d)D\b", r"\1", FROM_HZ[s]).format(f="p_retailprice")) + f" AS {s}" for s in _scales) + " FROM part")
def _convert(spark: SparkSession, d: str) -> DataFrame:
    return r6(tables.read(spark, d, "part").select("p_partkey", *[convert_pitch("p_retailprice", "hz", s).alias(s) for s in _scales]))


@query("convert_roundtrip", "SELECT p_partkey, " + ", ".join(f"{R('p_retailprice')} AS {s}" for s in _scales) + " FROM part")
def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    there = tables.read(spark, d, "part").select("p_partkey", *[convert_pitch("p_retailprice", "hz", s).alias(s) for s in _scales])
    return r6(there.select("p_partkey", *[convert_pitch(s, s, "hz").alias(s) for s in _scales]))


SPECTRA = {
    "harmonic_powerlaw": SpectrumSpec.of("harmonic", 8, "powerlaw", 1),
    "harmonic_geometric": SpectrumSpec.of("harmonic", 8, "geometric", 0.9),
    "stretched_powerlaw": SpectrumSpec.of("stretched", 8, 1.02, "powerlaw", 1),
    "freqlinear_geometric": SpectrumSpec.of("freqlinear", 8, 0.3, "geometric", 0.8),
    "stiff_powerlaw": SpectrumSpec.of("stiff", 8, 0.0005, "powerlaw", 0.5),
    "custom": SpectrumSpec.of("custom", (0, 1200, 1902), (1, 0.5, 0.25)),
}
for _name, _spec in SPECTRA.items():
    query(f"spectra_{_name}", f"SELECT set_id, {R('p * 50 + o')} AS p, {R('w * s')} AS w FROM ({E24}), ({partial_sql(_spec)})")(
        lambda spark, d, spec=_spec: r6(spectra.add_spectra(tables.hour_profiles(spark, d).withColumn("p", F.col("p") * 50), spec))
    )

# ---------------------------------------------------------------- circular measures

_MOMENTS = "SELECT set_id, sum(w * cos(2 * pi() * p / {n})) AS re, sum(w * sin(2 * pi() * p / {n})) AS im, sum(w) AS s FROM ({base}) GROUP BY 1"

for _name, _base, _n, _sets in (("hours", E24, 24, lambda s, d: tables.hour_profiles(s, d)), ("parts", L12, 12, lambda s, d: tables.part_classes(s, d))):
    query(f"balance_{_name}", f"SELECT set_id, {R('1 - sqrt(re * re + im * im) / s')} AS balance FROM ({_MOMENTS.format(n=_n, base=_base)})")(lambda s, d, n=_n, sets=_sets: r6(circular.balance(sets(s, d), n)))
    query(
        f"evenness_{_name}",
        f"""WITH z AS (SELECT set_id, p, row_number() OVER (PARTITION BY set_id ORDER BY p) - 1 AS j, count(*) OVER (PARTITION BY set_id) AS n FROM ({_base}))
        SELECT set_id, {R(f'CASE WHEN max(n) > 1 THEN sqrt(power(sum(cos(2 * pi() * (p / {_n} - j / n))), 2) + power(sum(sin(2 * pi() * (p / {_n} - j / n))), 2)) / max(n) END')} AS evenness FROM z GROUP BY 1""",
    )(lambda s, d, n=_n, sets=_sets: r6(circular.evenness(sets(s, d), n)))

_PHASE = "2 * pi() * (p / 24 - j * k / n)"


@query(
    "dft_hours",
    f"""WITH z AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY p) - 1 AS j, count(*) OVER (PARTITION BY set_id) AS n FROM ({E24})),
    c AS (SELECT set_id, k, sum(w * cos({_PHASE})) / sum(w) AS re, sum(w * sin({_PHASE})) / sum(w) AS im FROM (SELECT *, unnest(range(n)) AS k FROM z) GROUP BY 1, 2)
    SELECT set_id, k, {R('re')} AS re, {R('im')} AS im, {R('sqrt(re * re + im * im)')} AS mag FROM c""",
)
def _dft(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.dft(tables.hour_profiles(spark, d), 24))


_X24 = "(SELECT unnest(range(24))::DOUBLE AS x)"
_I0 = float(np.i0(6.7))


@query(
    "edges_hours",
    f"""WITH e AS (SELECT set_id, x, sum(w * -6.7 * sin(2 * pi() * (x - p) / 24) * exp(6.7 * cos(2 * pi() * (x - p) / 24))) / (2 * pi() * {_I0!r}) AS s FROM ({E24}), {_X24} GROUP BY 1, 2)
    SELECT set_id, x, {R('abs(s)')} AS edge, {R('s')} AS signed FROM e""",
)
def _edges(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.edges(tables.hour_profiles(spark, d), 24))


@query(
    "proj_centroid_hours",
    f"""WITH m AS (SELECT set_id, sqrt(re * re + im * im) / s AS mag, {MOD('atan2(im, re)', 2 * math.pi)} AS a FROM ({_MOMENTS.format(n=24, base=E24)}))
    SELECT set_id, x, {R('mag * cos(a - 2 * pi() * x / 24)')} AS y, {R('mag')} AS mag, {R('a * 24 / (2 * pi())')} AS phase FROM m, {_X24}""",
)
def _centroid(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.proj_centroid(tables.hour_profiles(spark, d), 24))


@query("mean_offset_hours", f"SELECT set_id, x, {R(f'sum(w * ({MOD("p - x", 24)} - {MOD("x - p", 24)})) / 24')} AS \"offset\" FROM ({E24}), {_X24} GROUP BY 1, 2")
def _offset(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.mean_offset(tables.hour_profiles(spark, d), 24))


def _slots_sql(base: str, n: int) -> str:
    return f"SELECT i.set_id, x, coalesce(w, 0) AS w FROM (SELECT DISTINCT set_id, unnest(range({n})) AS x FROM ({base})) i LEFT JOIN ({base}) b ON i.set_id = b.set_id AND i.x = b.p"


@query(
    "markov_parts",
    f"""WITH s AS ({_slots_sql(L12, 12)}),
    c AS (SELECT a.set_id, a.x, any_value(a.w) AS w, string_agg(CASE WHEN b.w <> 0 THEN '1' ELSE '0' END, '' ORDER BY (a.x - b.x + 12) % 12) AS c
          FROM s a JOIN s b ON a.set_id = b.set_id AND (a.x - b.x + 12) % 12 BETWEEN 1 AND 3 GROUP BY 1, 2)
    SELECT a.set_id, a.x::INT AS x, {R('avg(b.w)')} AS value FROM c a JOIN c b ON a.set_id = b.set_id AND a.c = b.c GROUP BY 1, 2""",
)
def _markov(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.markov_s(tables.part_classes(spark, d), 12, 3))


def _apm_sql(decay: float) -> str:
    fade = f" * exp(-{decay} * (l.lag * m + phase)) * exp(-{decay} * (l.lag * (m + 1) + phase))" if decay else ""
    return f"""(WITH s AS ({_slots_sql(E24, 24)}), n AS (SELECT unnest(range(24)) AS lag)
    SELECT a.set_id, l.lag, phase, sum(a.w * b.w{fade}) AS r FROM n l, (SELECT unnest(range(24)) AS phase), (SELECT unnest(range(24)) AS m), s a, s b
    WHERE a.x = (l.lag * m + phase) % 24 AND b.x = (l.lag * (m + 1) + phase) % 24 AND a.set_id = b.set_id GROUP BY 1, 2, 3)"""


@query("apm_hours", f"SELECT set_id, lag::INT AS lag, phase::INT AS phase, {R('r')} AS r FROM {_apm_sql(0)}")
def _apm(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.circ_apm(tables.hour_profiles(spark, d), 24))


@query("apm_decay_hours", f"SELECT set_id, lag::INT AS lag, phase::INT AS phase, {R('r', 3)} AS r FROM {_apm_sql(0.05)}")
def _apm_decay(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.circ_apm(tables.hour_profiles(spark, d), 24, 0.05), 3)


@query("apm_phases_hours", f"SELECT set_id, phase::INT AS phase, {R('sum(r)')} AS r_phase FROM {_apm_sql(0)} GROUP BY 1, 2")
def _apm_phases(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.apm_phases(circular.circ_apm(tables.hour_profiles(spark, d), 24)))


@query("apm_lags_hours", f"SELECT set_id, lag::INT AS lag, {R('sum(r)')} AS r_lag FROM {_apm_sql(0)} GROUP BY 1, 2")
def _apm_lags(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.apm_lags(circular.circ_apm(tables.hour_profiles(spark, d), 24)))


# ---------------------------------------------------------------- intervals

_RANKS = f"SELECT set_id, p::INT AS p, row_number() OVER (PARTITION BY set_id ORDER BY p) - 1 AS k, count(*) OVER (PARTITION BY set_id) AS n FROM ({L12})"
_SPANS = f"r AS ({_RANKS}), s AS (SELECT a.set_id, a.n, a.k, ((b.k - a.k + a.n) % a.n)::INT AS g, (b.p - a.p + 12) % 12 AS d FROM r a JOIN r b ON a.set_id = b.set_id AND a.k <> b.k)"

for _strict, _op in ((True, "<="), (False, "<")):
    query(
        f"coherence_{'strict' if _strict else 'nonstrict'}",
        f"""WITH {_SPANS}, f AS (SELECT a.set_id, count(*) AS nc FROM s a JOIN s b ON a.set_id = b.set_id AND a.g < b.g AND b.d {_op} a.d GROUP BY 1),
        z AS (SELECT set_id, max(n)::DOUBLE AS k FROM r WHERE n > 1 GROUP BY 1)
        SELECT z.set_id, {R('1 - coalesce(nc, 0) / nullif(k * (k - 1) * (k - 2) * (3 * k - 5) / 24, 0)')} AS c, coalesce(nc, 0)::BIGINT AS nc FROM z LEFT JOIN f ON z.set_id = f.set_id""",
    )(lambda s, d, strict=_strict: r6(circular.coherence(tables.part_classes(s, d), 12, strict, on_invalid="null")))


@query(
    "sameness_parts",
    f"""WITH {_SPANS}, f AS (SELECT a.set_id, count(*) AS m FROM s a JOIN s b ON a.set_id = b.set_id AND a.g < b.g AND a.d = b.d GROUP BY 1),
    z AS (SELECT set_id, max(n)::DOUBLE AS k FROM r WHERE n > 1 GROUP BY 1)
    SELECT z.set_id, {R('1 - coalesce(m, 0) / (k * (k - 1) * (k - 1) / 2)')} AS sq, coalesce(m, 0)::BIGINT AS n_diff FROM z LEFT JOIN f ON z.set_id = f.set_id""",
)
def _sameness(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.sameness(tables.part_classes(spark, d), 12, on_invalid="null"))


_STEPS = f"r AS ({_RANKS}), t AS (SELECT a.set_id, a.n, a.k, (b.p - a.p + 12) % 12 AS s FROM r a JOIN r b ON a.set_id = b.set_id AND b.k = (a.k + 1) % a.n WHERE a.n > 1)"
_RUNS2 = "u AS (SELECT a.set_id, a.n, a.s AS s1, b.s AS s2 FROM t a JOIN t b ON a.set_id = b.set_id AND b.k = (a.k + 1) % a.n WHERE a.n > 2)"


def _entropy_sql(source: str, bins: str, group: str = "set_id", value: str = "v") -> str:
    """Entropy of the pmf of the values of a set, from the definition."""
    return f"""SELECT {group}, {R(f"coalesce(-sum(CASE WHEN q > 0 THEN q * ln(q) END), 0) / ln({bins})")} AS entropy
    FROM (SELECT *, {value} / sum({value}) OVER (PARTITION BY {group}) AS q, count(*) OVER (PARTITION BY {group}) AS bins FROM ({source})) GROUP BY {group}"""


@query("ntuple_entropy_1", f"WITH {_STEPS}, c AS (SELECT set_id, s, count(*)::DOUBLE AS v FROM t GROUP BY 1, 2) " + _entropy_sql("SELECT * FROM c", "12.0"))
def _ntuple1(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.n_tuple_entropy(tables.part_classes(spark, d), 12, 1, on_invalid="null"))


@query("ntuple_entropy_2", f"WITH {_STEPS}, {_RUNS2}, c AS (SELECT set_id, s1, s2, count(*)::DOUBLE AS v FROM u GROUP BY 1, 2, 3) " + _entropy_sql("SELECT * FROM c", "144.0"))
def _ntuple2(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.n_tuple_entropy(tables.part_classes(spark, d), 12, 2, on_invalid="null"))


_RING = "least((b - s + 12) % 12, (s - b + 12) % 12)"


@query("ntuple_entropy_smoothed", f"WITH {_STEPS}, c AS (SELECT set_id, b, sum(exp(-power({_RING}, 2) / (2 * 0.25))) AS v FROM t, (SELECT unnest(range(12)) AS b) GROUP BY 1, 2) " + _entropy_sql("SELECT * FROM c", "12.0"))
def _ntuple_smooth(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.n_tuple_entropy(tables.part_classes(spark, d), 12, 1, sigma=0.5, on_invalid="null"))


_RING2 = "least((b{i} - s{i} + 12) % 12, (s{i} - b{i} + 12) % 12)"


@query(
    "ntuple_entropy_smoothed_2",
    f"WITH {_STEPS}, {_RUNS2}, c AS (SELECT set_id, b1, b2, sum(exp(-(power({_RING2.format(i=1)}, 2) + power({_RING2.format(i=2)}, 2)) / (2 * 0.25))) AS v FROM u, (SELECT unnest(range(12)) AS b1), (SELECT unnest(range(12)) AS b2) GROUP BY 1, 2, 3) " + _entropy_sql("SELECT * FROM c", "144.0"),
)
def _ntuple_smooth2(spark: SparkSession, d: str) -> DataFrame:
    return r6(circular.n_tuple_entropy(tables.part_classes(spark, d), 12, 2, sigma=0.5, on_invalid="null"))


# ---------------------------------------------------------------- tensors

_TYPES = lambda s, d: tables.hour_profiles(s, d, "event_type")
for _per in (True, False):
    for _norm in ("none", "gaussian", "pdf"):
        _d = WRAP("p - x", 24) if _per else "p - x"
        _scale = {"none": "1", "gaussian": "1 / sqrt(2 * pi() * 2.25)", "pdf": "1 / sqrt(2 * pi() * 2.25) / sum(w)"}[_norm]
        query(
            f"tensor_abs_{'per' if _per else 'nonper'}_{_norm}",
            f"SELECT set_id, x, {R(f'sum(w * exp(-power({_d}, 2) / (2 * 2.25))) * {_scale}', 4)} AS value FROM ({T24}), (SELECT unnest(range(48)) * 0.5::DOUBLE AS x) GROUP BY 1, 2",
        )(lambda s, d, per=_per, norm=_norm: r6(tensor.evaluate_raw(_TYPES(s, d), grids.linspace(0, 24, 48, endpoint=False), TensorParams(1.5, 1, False, per, 24), norm), 4))
    _c = WRAP("b.p - a.p - x", 24) if _per else "b.p - a.p - x"
    query(
        f"tensor_rel_{'per' if _per else 'nonper'}_r2",
        f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY p) AS i FROM ({T24}))
        SELECT set_id, x, {R('sum(v * exp(-(c * c - c * c / 2) / (2 * 2.25))) / sum(v) / sqrt(2 * pi() * 2.25) * sqrt(0.5)')} AS value
        FROM (SELECT a.set_id, x, {_c} AS c, a.w * b.w AS v FROM e a JOIN e b ON a.set_id = b.set_id AND a.i <> b.i, {_X24}) GROUP BY 1, 2""",
    )(lambda s, d, per=_per: r6(tensor.evaluate_raw(_TYPES(s, d), grids.integers(24), TensorParams(1.5, 2, True, per, 24), "pdf")))


@query(
    "tensor_rel_per_r3",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY p) AS i FROM ({L12})),
    t AS (SELECT a.set_id, {WRAP('b.p - a.p - 4', 12)} AS c, {WRAP('z.p - a.p - 7', 12)} AS g, a.w * b.w * z.w AS v
          FROM e a JOIN e b ON a.set_id = b.set_id AND a.i <> b.i JOIN e z ON a.set_id = z.set_id AND z.i <> a.i AND z.i <> b.i)
    SELECT set_id, {R('sum(v * exp(-(c * c + g * g - (c + g) * (c + g) / 3) / (2 * 0.25)))')} AS value FROM t GROUP BY 1""",
)
def _tensor_r3(spark: SparkSession, d: str) -> DataFrame:
    """How much each order's triples look like a major triad."""
    at = F.array(F.array(F.lit(4.0), F.lit(7.0)))
    return r6(tensor.evaluate_raw(tables.part_classes(spark, d), at, TensorParams(0.5, 3, True, True, 12)).select("set_id", "value"))


@query(
    "tensor_rel_per_r4",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY p) AS i FROM ({L12})),
    t AS (SELECT a.set_id, {WRAP('b.p - a.p - 4', 12)} AS c, {WRAP('z.p - a.p - 7', 12)} AS g, {WRAP('y.p - a.p - 10', 12)} AS h, a.w * b.w * z.w * y.w AS v
          FROM e a JOIN e b ON a.set_id = b.set_id AND a.i <> b.i JOIN e z ON a.set_id = z.set_id AND z.i <> a.i AND z.i <> b.i JOIN e y ON a.set_id = y.set_id AND y.i <> a.i AND y.i <> b.i AND y.i <> z.i)
    SELECT set_id, {R('sum(v * exp(-(c * c + g * g + h * h - (c + g + h) * (c + g + h) / 4) / (2 * 0.25)))', 4)} AS value FROM t GROUP BY 1""",
)
def _tensor_r4(spark: SparkSession, d: str) -> DataFrame:
    """How much each order's fours look like a seventh chord."""
    at = F.array(F.array(F.lit(4.0), F.lit(7.0), F.lit(10.0)))
    return r6(tensor.evaluate_raw(tables.part_classes(spark, d), at, TensorParams(0.5, 4, True, True, 12)).select("set_id", "value"), 4)


_PAIR = {"abs_per": lambda r: [WRAP(f"u{k} - v{k}", 12) for k in range(1, r + 1)], "abs_nonper": lambda r: [f"(u{k} - v{k})" for k in range(1, r + 1)]}


def _form_sql(mode: str, r: int) -> str:
    if mode.startswith("abs"):
        return " + ".join(f"power({x}, 2)" for x in _PAIR[mode](r))
    d = [f"(u{k} - v{k})" for k in range(1, r + 1)]
    if mode == "rel_per":
        return "(" + " + ".join(f"power({WRAP(f'{d[i]} - {d[j]}', 12)}, 2)" for i in range(r) for j in range(i + 1, r)) + f") / {r}"
    return " + ".join(f"power({x}, 2)" for x in d) + f" - power({' + '.join(d)}, 2) / {r}"


def _tuples_sql(table: str, name: str, r: int, keyed: bool, ordered: bool = True) -> str:
    """All ordered tuples (or combinations) of distinct elements, as name(set_id, 1..r, weight)."""
    on = lambda k: " AND ".join([*([f"e{k}.set_id = e1.set_id"] if keyed else []), *(f"e{k}.i {'<>' if ordered else '>'} e{j}.i" for j in (range(1, k) if ordered else [k - 1]))])
    joins = "".join(f" JOIN {table} e{k} ON {on(k)}" for k in range(2, r + 1))
    return f"SELECT {'e1.set_id, ' if keyed else ''}" + ", ".join(f"e{k}.p AS {name}{k}" for k in range(1, r + 1)) + ", " + " * ".join(f"e{k}.w" for k in range(1, r + 1)) + f" AS w{name} FROM {table} e1{joins}"


def _cosine_sql(mode: str, r: int, sigma: float) -> str:
    kernel = f"exp(-({_form_sql(mode, r)}) / (4 * {sigma} * {sigma}))"
    return f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY p) AS i FROM ({L12})), {values('f0', DIATONIC)}, f AS (SELECT *, row_number() OVER (ORDER BY p) AS i FROM f0),
    u AS ({_tuples_sql('e', 'u', r, True)}), uv AS ({_tuples_sql('e', 'v', r, True, False)}), f_u AS ({_tuples_sql('f', 'u', r, False)}), f_v AS ({_tuples_sql('f', 'v', r, False, False)}),
    ab AS (SELECT set_id, sum(wu * wv * {kernel}) AS x FROM u, f_v GROUP BY 1), aa AS (SELECT u.set_id, sum(wu * wv * {kernel}) AS x FROM u JOIN uv ON u.set_id = uv.set_id GROUP BY 1), bb AS (SELECT sum(wu * wv * {kernel}) AS x FROM f_u, f_v)
    SELECT s.set_id AS a_id, 'diatonic' AS b_id, {R('ab.x / sqrt(aa.x * bb.x)')} AS similarity FROM (SELECT DISTINCT set_id FROM e) s LEFT JOIN ab ON s.set_id = ab.set_id LEFT JOIN aa ON s.set_id = aa.set_id, bb"""


for _mode, _r in (("abs_per", 1), ("abs_nonper", 1), ("abs_per", 2), ("abs_nonper", 2), ("rel_per", 2), ("rel_nonper", 2), ("rel_per", 3)):

    @query(f"cosine_{_mode}_r{_r}", _cosine_sql(_mode, _r, 0.5))
    def _cosine(spark: SparkSession, d: str, mode: str = _mode, r: int = _r) -> DataFrame:
        sets = tables.part_classes(spark, d)
        t = TensorParams(0.5, r, mode.startswith("rel"), mode.endswith("_per"), 12)
        if r == 2 and not t.relative:
            return r6(tensor.cosine_absolute_pairs(sets, literal_set(spark, "diatonic", DIATONIC), against(sets, "diatonic"), t))
        return r6(tensor.cosine_with(sets, "diatonic", DIATONIC, t))


@query(
    "similarity_profiles",
    f"""WITH e AS ({T24}), x AS (SELECT a.set_id AS a_id, b.set_id AS b_id, sum(a.w * b.w * exp(-power({WRAP('a.p - b.p', 24)}, 2) / 4)) AS ip FROM e a, e b GROUP BY 1, 2)
    SELECT x.a_id, x.b_id, {R('x.ip / sqrt(n.ip * m.ip)')} AS similarity FROM x JOIN x n ON n.a_id = x.a_id AND n.b_id = x.a_id JOIN x m ON m.a_id = x.b_id AND m.b_id = x.b_id WHERE x.a_id < x.b_id""",
)
def similarity_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Cosine similarity of hour-of-day profiles for every pair of event types.

    All pairs are the result itself, a few for a few types; a key of many values needs pairs of its own choosing.
    """
    sets = tables.hour_profiles(spark, d, "event_type")
    ids = sets.select("set_id").distinct()
    pairs = ids.toDF("a_id").join(ids.toDF("b_id"), F.col("a_id") < F.col("b_id"))
    return r6(tensor.cosine(sets, sets, pairs, TensorParams(1.0, 1, False, True, 24)))


_BATCH = SpectrumSpec.of("harmonic", 6, "powerlaw", 1)
_BATCH_WIDTH = 10.0


@query(
    "batch_spcs",
    f"""WITH a AS (SELECT set_id, p * 100 + o AS p, w * s AS w FROM ({L12}), ({partial_sql(_BATCH)})), {values('b0', [100 * p for p in DIATONIC])}, b AS (SELECT p + o AS p, w * s AS w FROM b0, ({partial_sql(_BATCH)})),
    ab AS (SELECT set_id, sum(a.w * b.w * exp(-power({WRAP('a.p - b.p', 1200)}, 2) / 400)) AS x FROM a, b GROUP BY 1), aa AS (SELECT a.set_id, sum(a.w * b.w * exp(-power({WRAP('a.p - b.p', 1200)}, 2) / 400)) AS x FROM a JOIN a b ON a.set_id = b.set_id GROUP BY 1),
    bb AS (SELECT sum(a.w * b.w * exp(-power({WRAP('a.p - b.p', 1200)}, 2) / 400)) AS x FROM b a, b)
    SELECT ab.set_id AS row_id, {R('ab.x / sqrt(aa.x * bb.x)')} AS similarity FROM ab JOIN aa ON ab.set_id = aa.set_id, bb""",
)
def _batch_spcs(spark: SparkSession, d: str) -> DataFrame:
    """Spectral pitch-class similarity of every order to the diatonic scale; the SQL has no deduplication."""
    sets = tables.part_classes(spark, d, 100).groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("p", "w"))).alias("e"))
    rows = sets.select(F.col("set_id").alias("row_id"), F.col("e.p").alias("a"), F.col("e.w").alias("wa"), grids.points([100 * p for p in DIATONIC]).alias("b"))
    return r6(batch.batch_cos_sim(rows, TensorParams(_BATCH_WIDTH, 1, False, True, 1200), weights_a="wa", spectrum=_BATCH))


@query(
    "batch_relative",
    """WITH e AS (SELECT l_orderkey AS set_id, (l_partkey % 12)::DOUBLE AS p FROM lineitem GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY p) AS i FROM e), """
    + values("f0", MAJOR)
    + ", f AS (SELECT *, row_number() OVER (ORDER BY p) AS i FROM f0), "
    + f"""k AS (SELECT a.set_id, b.p - a.p AS d FROM i a JOIN i b ON a.set_id = b.set_id AND a.i <> b.i), h AS (SELECT b.p - a.p AS d FROM f a JOIN f b ON a.i <> b.i),
    ab AS (SELECT set_id, sum(exp(-power({WRAP('k.d - h.d', 12)}, 2) / 2 / 1.0)) AS x FROM k, h GROUP BY 1), aa AS (SELECT k.set_id, sum(exp(-power({WRAP('k.d - z.d', 12)}, 2) / 2 / 1.0)) AS x FROM k JOIN k z ON k.set_id = z.set_id GROUP BY 1),
    bb AS (SELECT sum(exp(-power({WRAP('h.d - z.d', 12)}, 2) / 2 / 1.0)) AS x FROM h, h z)
    SELECT s.set_id AS row_id, {R('ab.x / sqrt(aa.x * bb.x)')} AS similarity FROM (SELECT DISTINCT set_id FROM e) s LEFT JOIN ab ON s.set_id = ab.set_id LEFT JOIN aa ON s.set_id = aa.set_id, bb""",
)
def _batch_relative(spark: SparkSession, d: str) -> DataFrame:
    """Transposition-invariant similarity of every order to a major triad; orders of one class have none."""
    rows = tables.part_classes(spark, d).groupBy("set_id").agg(F.collect_list("p").alias("a")).select(F.col("set_id").alias("row_id"), "a", grids.points(MAJOR).alias("b"))
    return r6(batch.batch_cos_sim(rows, TensorParams(0.5, 2, True, True, 12), precision=9))


@query("entropy_tensor", _entropy_sql(f"SELECT set_id, x, sum(w * exp(-power({WRAP('p - x', 24)}, 2) / 2)) AS v FROM ({E24}), (SELECT unnest(range(240)) * 0.1::DOUBLE AS x) GROUP BY 1, 2", "240.0"))
def _entropy_tensor(spark: SparkSession, d: str) -> DataFrame:
    return r6(tensor.entropy_exp_tens(tables.hour_profiles(spark, d), TensorParams(1.0, 1, False, True, 24), points=240))


# ---------------------------------------------------------------- harmony

_FOUR, _EIGHT = SpectrumSpec.of("harmonic", 4, "powerlaw", 1), SpectrumSpec.of("harmonic", 8, "powerlaw", 1)


def _grid_sql(chords: str, spec: SpectrumSpec, sigma: float, res: float) -> str:
    """(set_id, p0, i, v): the smoothed spectrum of each set on its own grid."""
    return f"""(WITH l AS (SELECT set_id, p - min(p) OVER (PARTITION BY set_id) AS p, min(p) OVER (PARTITION BY set_id) AS p0, w FROM ({chords})),
    r AS (SELECT set_id, p0, p + o AS p, w * s AS w FROM l, ({partial_sql(spec)})), m AS (SELECT set_id, ceil((max(p) + {4 * sigma} + {res}) / {res})::INT AS n FROM r GROUP BY 1)
    SELECT r.set_id, r.p0, i, sum(w * exp(-power(p - i * {res}, 2) / (2 * {sigma} * {sigma}))) AS v FROM r JOIN (SELECT set_id, unnest(range(n)) AS i FROM m) g ON r.set_id = g.set_id GROUP BY 1, 2, 3)"""


_CHORDS = f"SELECT set_id, p * 100 AS p, w FROM ({L12})"
_HOUR_CHORDS = f"SELECT set_id, p * 50 AS p, w FROM ({E24})"


@query("spectral_entropy_parts", _entropy_sql(f"SELECT * FROM {_grid_sql(_CHORDS, _FOUR, 25.0, 25.0)}", "any_value(bins)"))
def _spectral_entropy(spark: SparkSession, d: str) -> DataFrame:
    return r6(harmony.spectral_entropy(tables.part_classes(spark, d, 100), 25.0, spectrum=_FOUR, resolution=25.0))


def _correlation_sql(chords: str) -> str:
    """(set_id, p0, lag, x, norm) of the correlation with a template of eight partials."""
    template = _grid_sql("SELECT 0 AS set_id, 0.0::DOUBLE AS p, 1.0::DOUBLE AS w", _EIGHT, 25.0, 25.0)
    return f"""(WITH c AS {_grid_sql(chords, _FOUR, 25.0, 25.0)}, t AS {template}, n AS (SELECT set_id, sqrt(sum(v * v) * (SELECT sum(v * v) FROM t)) AS norm FROM c GROUP BY 1)
    SELECT c.set_id, c.p0, c.i - t.i AS lag, sum(c.v * t.v) / any_value(norm) AS v FROM c JOIN n ON c.set_id = n.set_id, t GROUP BY 1, 2, 3)"""


@query("template_harmonicity_hours", f"WITH x AS {_correlation_sql(_HOUR_CHORDS)} SELECT e.set_id, h_max, entropy AS h_entropy FROM ({_entropy_sql('SELECT * FROM x', 'any_value(bins)')}) e JOIN (SELECT set_id, {R('max(v)')} AS h_max FROM x GROUP BY 1) m ON e.set_id = m.set_id")
def _template(spark: SparkSession, d: str) -> DataFrame:
    chords = tables.hour_profiles(spark, d).withColumn("p", F.col("p") * 50)
    return r6(harmony.template_harmonicity(chords, 25.0, spectrum=_EIGHT, chord_spectrum=_FOUR, resolution=25.0))


@query("virtual_pitches_types", f"SELECT set_id, {R('lag * 25.0 + p0')} AS vp_p, {R('v')} AS vp_w FROM {_correlation_sql(f'SELECT set_id, p * 50 AS p, w FROM ({T24})')}")
def _virtual(spark: SparkSession, d: str) -> DataFrame:
    chords = tables.hour_profiles(spark, d, "event_type").withColumn("p", F.col("p") * 50)
    return r6(harmony.virtual_pitches(chords, 25.0, spectrum=_EIGHT, chord_spectrum=_FOUR, resolution=25.0))


@query("virtual_pitch_native_types", ORACLE_SQL["virtual_pitches_types"])
def _virtual_native(spark: SparkSession, d: str) -> DataFrame:
    chords = tables.hour_profiles(spark, d, "event_type").withColumn("p", F.col("p") * 50)
    return r6(harmony.profile_native(chords, 25.0, _EIGHT, _FOUR, 25.0).select("set_id", "vp_p", "vp_w"))


@query("virtual_pitch_best", f"SELECT set_id, {R('arg_max(lag * 25.0 + p0, round(v, 9))')} AS vp_p, {R('max(v)')} AS vp_w FROM {_correlation_sql(_HOUR_CHORDS)} GROUP BY 1")
def _virtual_best(spark: SparkSession, d: str) -> DataFrame:
    chords = tables.hour_profiles(spark, d).withColumn("p", F.col("p") * 50)
    profile = harmony.virtual_pitches(chords, 25.0, spectrum=_EIGHT, chord_spectrum=_FOUR, resolution=25.0)
    return r6(profile.groupBy("set_id").agg(F.max_by("vp_p", F.round("vp_w", 9)).alias("vp_p"), F.max("vp_w").alias("vp_w")))


_SIX = SpectrumSpec.of("harmonic", 6, "powerlaw", 1)


@query(
    "tensor_harmonicity_triads",
    f"""WITH t AS (SELECT o, s, row_number() OVER () AS i FROM ({partial_sql(_SIX)}), range(3)), u AS (SELECT b.o - a.o AS c, z.o - a.o AS g, a.s * b.s * z.s AS v FROM t a JOIN t b ON a.i <> b.i JOIN t z ON z.i <> a.i AND z.i <> b.i),
    u2 AS (SELECT c, g, sum(v) AS v FROM u GROUP BY 1, 2), q AS (SELECT set_id, list(p * 100 ORDER BY p) AS p FROM ({L12}) GROUP BY 1 HAVING count(*) = 3)
    SELECT set_id, {R('sum(v * exp(-(x * x + y * y - (x + y) * (x + y) / 3) / (2 * 400)))')} AS h FROM (SELECT set_id, v, c - (p[2] - p[1]) AS x, g - (p[3] - p[1]) AS y FROM q, u2) GROUP BY 1""",
)
def _tensor_harmonicity(spark: SparkSession, d: str) -> DataFrame:
    """Orders of three classes as triads; the SQL lists all tuples over three copies of the template."""
    return r6(harmony.tensor_harmonicity(tables.part_classes(spark, d, 100), 20.0, size=3, spectrum=_SIX).where("h is not null"))


_PARTIALS = "SELECT user_id || '/' || event_type AS set_id, value AS f FROM events WHERE value > 0"


def _roughness_sql(power: int, average: bool) -> str:
    x = "5 * (exp(-3.51 * s * d) - exp(-5.75 * s * d))"
    value = f"power(coalesce(t, 0), 1.0 / {power})" + (" / nullif(k * (k - 1) / 2, 0)" if average else "")
    value = f"coalesce({value}, 0)" if average else value
    return f"""WITH e AS ({_PARTIALS}), x AS (SELECT a.set_id, sum(power({x}, {power})) AS t FROM (SELECT a.set_id, b.f - a.f AS d, 0.24 / (0.0207 * a.f + 18.96) AS s FROM e a JOIN e b ON a.set_id = b.set_id AND a.f < b.f) a GROUP BY 1)
    SELECT k.set_id, {R(value)} AS roughness FROM (SELECT set_id, count(*) AS k FROM e GROUP BY 1) k LEFT JOIN x ON k.set_id = x.set_id"""


for _name, _power, _average in (("p1", 1, False), ("p2", 2, False), ("average", 1, True)):
    query(f"roughness_{_name}", _roughness_sql(_power, _average))(lambda s, d, power=_power, average=_average: r6(harmony.roughness(tables.value_partials(s, d), p_norm=power, average=average)))

# ---------------------------------------------------------------- workflows

_EDOS = 102
_CHAIN, _STEP = 19, 0.5
_GENERATORS = int(600 / _STEP) + 1


@query(
    "edo_approximation",
    f"""WITH {values('ji', JI_TRIAD)}, e AS (SELECT n, i * 1200.0 / n AS p, i FROM (SELECT unnest(range(2, {_EDOS + 1})) AS n), range({_EDOS}) r(i) WHERE i < n), j AS (SELECT p, row_number() OVER (ORDER BY p) AS i FROM ji),
    k AS (SELECT a.n, any_value(b.p - a.p) AS d, count(*) AS m FROM e a JOIN e b ON a.n = b.n AND a.i <> b.i GROUP BY 1, (b.i - a.i + a.n) % a.n), h AS (SELECT b.p - a.p AS d FROM j a JOIN j b ON a.i <> b.i),
    ab AS (SELECT n, sum(m * exp(-power({WRAP('k.d - h.d', 1200)}, 2) / 2 / 400)) AS x FROM k, h GROUP BY 1), aa AS (SELECT k.n, sum(k.m * z.m * exp(-power({WRAP('k.d - z.d', 1200)}, 2) / 2 / 400)) AS x FROM k JOIN k z ON k.n = z.n GROUP BY 1), bb AS (SELECT sum(exp(-power({WRAP('h.d - z.d', 1200)}, 2) / 2 / 400)) AS x FROM h, h z)
    SELECT ab.n::BIGINT AS n, {R('ab.x / sqrt(aa.x * bb.x)')} AS similarity FROM ab JOIN aa ON ab.n = aa.n, bb""",
)
def _edos(spark: SparkSession, d: str) -> DataFrame:
    """The equal divisions of the octave, 2 to 102, against a just triad, transposition aside."""
    sets = spark.range(2, _EDOS + 1).select(F.col("id").alias("set_id"), F.explode(F.expr("transform(sequence(0L, id - 1), i -> i * 1200D / id)")).alias("p"), F.lit(1.0).alias("w"))
    found = tensor.cosine_with(sets, "ji", JI_TRIAD, TensorParams(10, 2, True, True, 1200))
    return r6(found.select(F.col("a_id").alias("n"), "similarity"))


@query("edo_best", "SELECT * FROM (" + ORACLE_SQL["edo_approximation"] + ") ORDER BY similarity DESC, n LIMIT 10")
def _edo_best(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of them."""
    return _edos(spark, d).orderBy(F.desc("similarity"), "n").limit(10)


def chain_similarity(spark: SparkSession) -> DataFrame:
    """(i, generator, similarity) of chains of 19 tones by generators of 0 to 600 cents against a just triad."""
    tones = F.expr(f"transform(sequence(0, {_CHAIN - 1}), k -> pmod(id * {_STEP}D * k, 1200D))")
    sets = spark.range(_GENERATORS).select(F.col("id").alias("set_id"), F.explode(tones).alias("p"), F.lit(1.0).alias("w"))
    found = tensor.cosine_with(sets.repartition("set_id"), "ji", JI_TRIAD, TensorParams(10, 2, True, True, 1200))
    return r6(found.select(F.col("a_id").alias("i"), (F.col("a_id") * F.lit(_STEP)).alias("generator"), "similarity"))


@query(
    "generator_chains",
    f"""WITH {values('ji', JI_TRIAD)}, e AS (SELECT g.i, {MOD(f'g.i * {_STEP} * k', 1200)} AS p, k FROM range({_GENERATORS}) g(i), range({_CHAIN}) t(k)), j AS (SELECT p, row_number() OVER (ORDER BY p) AS i FROM ji),
    x AS (SELECT a.i, any_value(b.p - a.p) AS d, count(*) AS m FROM e a JOIN e b ON a.i = b.i AND a.k <> b.k GROUP BY 1, b.k - a.k), h AS (SELECT b.p - a.p AS d FROM j a JOIN j b ON a.i <> b.i),
    ab AS (SELECT i, sum(m * exp(-power({WRAP('x.d - h.d', 1200)}, 2) / 2 / 400)) AS v FROM x, h GROUP BY 1), aa AS (SELECT x.i, sum(x.m * z.m * exp(-power({WRAP('x.d - z.d', 1200)}, 2) / 2 / 400)) AS v FROM x JOIN x z ON x.i = z.i GROUP BY 1), bb AS (SELECT sum(exp(-power({WRAP('h.d - z.d', 1200)}, 2) / 2 / 400)) AS v FROM h, h z)
    SELECT ab.i::BIGINT AS i, ab.i * {_STEP}::DOUBLE AS generator, {R('ab.v / sqrt(aa.v * bb.v)')} AS similarity FROM ab JOIN aa ON ab.i = aa.i, bb""",
)
def _chains(spark: SparkSession, d: str) -> DataFrame:
    return chain_similarity(spark)


@query("generator_peaks")
def generator_peaks(spark: SparkSession, d: str = "") -> DataFrame:
    """The fifteen best generators of a full turn (the half sweep and its mirror), 24 cents apart at least.

    The similarity is to three places, and peaks stand out by a hundredth, as the workflow has it.
    """
    half = chain_similarity(spark).select("i", F.round("similarity", 3).alias("value"))
    mirror = half.where((F.col("i") > 0) & (F.col("i") < _GENERATORS - 1)).select((2 * (_GENERATORS - 1) - F.col("i")).alias("i"), "value")
    turn = half.union(mirror).select(F.lit("chain").alias("set_id"), (F.col("i") * F.lit(_STEP)).alias("x"), "value")
    return profiles.peaks(turn, 0.01, 24.0, 15).select("rank", F.col("x").alias("generator"), F.col("value").alias("similarity"))


#: Three scales of seven notes, and four types of triads on twelve roots.
SCALES = {"diatonic": (0, 200, 400, 500, 700, 900, 1100), "harmonic minor": (0, 200, 300, 500, 700, 800, 1100), "melodic minor": (0, 200, 300, 500, 700, 900, 1100)}
CHORDS = {"major": (0, 400, 700), "minor": (0, 300, 700), "diminished": (0, 300, 600), "augmented": (0, 400, 800)}
_DEMO = SpectrumSpec.of("harmonic", 24, "powerlaw", 1)
_MIDDLE_C = 261.63


def scale_chord_trials(spark: SparkSession) -> DataFrame:
    """(row_id, scale, chord, root, a, b): 144 trials, a scale against a transposed chord."""
    rows = [(i, s, c, 100 * r, [float(x) for x in SCALES[s]], [float(x + 100 * r) for x in CHORDS[c]]) for i, (s, c, r) in enumerate((s, c, r) for s in SCALES for c in CHORDS for r in range(12))]
    return spark.createDataFrame(rows, "row_id int, scale string, chord string, root int, a array<double>, b array<double>")


def chord_features(trials: DataFrame, *, harmonicity: bool) -> DataFrame:
    """Features of each distinct chord, made once and mapped back to (row_id, ...) by its sorted pitches."""
    keyed = trials.select("row_id", F.to_json(F.array_sort("b")).alias("set_id"), "b")
    sets = keyed.dropDuplicates(["set_id"]).select("set_id", F.explode("b").alias("p"), F.lit(1.0).alias("w"))
    hz = spectra.add_spectra(sets, _DEMO).withColumn("p", F.lit(_MIDDLE_C) * F.pow(F.lit(2.0), F.col("p") / 1200))
    if harmonicity:
        parts = [harmony.template_harmonicity(sets, 10.0, chord_spectrum=_DEMO), harmony.tensor_harmonicity(sets, 10.0, spectrum=_DEMO)]
    else:
        parts = [harmony.spectral_entropy(sets, 10.0, spectrum=_DEMO), harmony.roughness(hz)]
    out = keyed.select("row_id", "set_id")
    for part in parts:
        out = out.join(part, "set_id")
    return out.drop("set_id")


def _trials_sql() -> str:
    rows = ", ".join(f"('{s}', '{c}', {list(map(float, SCALES[s]))}, {list(map(float, CHORDS[c]))})" for s in SCALES for c in CHORDS)
    return f"(SELECT scale, chord, (r * 100)::INT AS root, a, list_transform(b, lambda x: x + r * 100.0) AS b FROM (VALUES {rows}) v(scale, chord, a, b), range(12) t(r))"


@query(
    "batch_scales_chords",
    f"""WITH t AS {_trials_sql()}, a AS (SELECT scale, chord, root, p + o AS p, s AS w FROM (SELECT *, unnest(a)::DOUBLE AS p FROM t), ({partial_sql(_DEMO)})), b AS (SELECT scale, chord, root, p + o AS p, s AS w FROM (SELECT *, unnest(b)::DOUBLE AS p FROM t), ({partial_sql(_DEMO)})),
    ab AS (SELECT a.scale, a.chord, a.root, sum(a.w * b.w * exp(-power({WRAP('a.p - b.p', 1200)}, 2) / 400)) AS x FROM a JOIN b USING (scale, chord, root) GROUP BY 1, 2, 3), aa AS (SELECT a.scale, a.chord, a.root, sum(a.w * b.w * exp(-power({WRAP('a.p - b.p', 1200)}, 2) / 400)) AS x FROM a JOIN a b USING (scale, chord, root) GROUP BY 1, 2, 3),
    bb AS (SELECT a.scale, a.chord, a.root, sum(a.w * b.w * exp(-power({WRAP('a.p - b.p', 1200)}, 2) / 400)) AS x FROM b a JOIN b USING (scale, chord, root) GROUP BY 1, 2, 3),
    c AS (SELECT chord || root AS set_id, chord, root, unnest(b)::DOUBLE AS p, 1.0::DOUBLE AS w FROM t WHERE scale = 'diatonic'), g AS {_grid_sql('SELECT set_id, p, w FROM c', _DEMO, 10.0, 1.0)}, n AS ({_entropy_sql('SELECT * FROM g', 'any_value(bins)')}),
    z AS (SELECT set_id, {_MIDDLE_C} * power(2, (p + o) / 1200) AS f, w * s AS w FROM c, ({partial_sql(_DEMO)})), u AS (SELECT x.set_id, sum(least(x.w, y.w) * 5 * (exp(-3.51 * 0.24 / (0.0207 * x.f + 18.96) * (y.f - x.f)) - exp(-5.75 * 0.24 / (0.0207 * x.f + 18.96) * (y.f - x.f)))) AS r FROM z x JOIN z y ON x.set_id = y.set_id AND x.f < y.f GROUP BY 1)
    SELECT ab.scale, ab.chord, ab.root, {R('ab.x / sqrt(aa.x * bb.x)')} AS similarity, n.entropy, {R('u.r')} AS roughness
    FROM ab JOIN aa USING (scale, chord, root) JOIN bb USING (scale, chord, root) JOIN n ON n.set_id = chord || root JOIN u ON u.set_id = chord || root""",
)
def _scales_chords(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every scale and chord, with features of the chord that are made once for each distinct one."""
    trials = scale_chord_trials(spark)
    similar = batch.batch_cos_sim(trials, TensorParams(10, 1, False, True, 1200), spectrum=_DEMO, precision=6)
    return r6(trials.join(similar, "row_id").join(chord_features(trials, harmonicity=False), "row_id").select("scale", "chord", "root", "similarity", "entropy", "roughness"))


@query("batch_chord_harmonicity")
def _scales_harmonicity(spark: SparkSession, d: str) -> DataFrame:
    """The two harmonicities of the same trials, on the one-cent grid (beyond what SQL does in good time)."""
    trials = scale_chord_trials(spark)
    return r6(trials.select("row_id", "scale", "chord", "root").join(chord_features(trials, harmonicity=True), "row_id").drop("row_id"))


def triads(spark: SparkSession, step: float, top: float = 1200.0) -> DataFrame:
    """Triads {0, x, y}, x <= y, on a grid of intervals, in long form; set_id is (x, y) in steps."""
    n = int(top // step) + 1
    xy = spark.range(n).select(F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(n - 1))).alias("y"))
    return xy.select(F.struct("x", "y").alias("set_id"), F.explode(F.array(F.lit(0.0), F.col("x") * F.lit(float(step)), F.col("y") * F.lit(float(step)))).alias("p"), F.lit(1.0).alias("w"))


_REF_SQL = f"b AS (SELECT p + o AS p, w * s AS w FROM b0, ({partial_sql(_EIGHT)}))"
_KERNEL = f"exp(-power({WRAP('a.p - b.p', 1200)}, 2) / 400)"


@query(
    "triad_similarity_grid",
    f"""WITH t AS (SELECT x, y, unnest([0.0, x * 100.0, y * 100.0])::DOUBLE AS p FROM range(12) a(x), range(12) c(y)), a AS (SELECT x, y, p + o AS p, s AS w FROM t, ({partial_sql(_EIGHT)})), {values('b0', [100 * p for p in MAJOR])}, {_REF_SQL},
    ab AS (SELECT x, y, sum(a.w * b.w * {_KERNEL}) AS v FROM a, b GROUP BY 1, 2), aa AS (SELECT a.x, a.y, sum(a.w * b.w * {_KERNEL}) AS v FROM a JOIN a b ON a.x = b.x AND a.y = b.y GROUP BY 1, 2), bb AS (SELECT sum(a.w * b.w * {_KERNEL}) AS v FROM b a, b)
    SELECT ab.x::INT AS x, {', '.join(f"max(CASE WHEN ab.y = {y} THEN {R('ab.v / sqrt(aa.v * bb.v)')} END) AS y{y}" for y in range(12))} FROM ab JOIN aa ON ab.x = aa.x AND ab.y = aa.y, bb GROUP BY 1""",
)
def _triad_grid(spark: SparkSession, d: str) -> DataFrame:
    """Spectral similarity of all triads {0, x, y} to the major triad, as a matrix."""
    xy = spark.range(12).select(F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("y"))
    sets = xy.select(F.struct("x", "y").alias("set_id"), F.explode(F.array(F.lit(0.0), F.col("x") * 100.0, F.col("y") * 100.0)).alias("p"), F.lit(1.0).alias("w"))
    t = TensorParams(10, 1, False, True, 1200)
    left, right = spectra.add_spectra(sets, _EIGHT), spectra.add_spectra(literal_set(spark, "major", [100 * p for p in MAJOR]), _EIGHT)
    s = r6(tensor.cosine(left, right, against(sets, "major"), t))
    return s.groupBy(F.col("a_id.x").alias("x")).pivot("a_id.y", list(range(12))).agg(F.max("similarity")).select("x", *[F.col(str(y)).alias(f"y{y}") for y in range(12)])


_TRIAD_STEP = 20.0


def triad_hz(sets: DataFrame, spec: SpectrumSpec) -> DataFrame:
    return spectra.add_spectra(sets, spec).withColumn("p", F.lit(_MIDDLE_C) * F.pow(F.lit(2.0), F.col("p") / 1200))


def triad_consonance(spark: SparkSession, step: float = _TRIAD_STEP, partials: int = 24) -> DataFrame:
    """Five consonance measures of every triad of a grid: similarity, spectral entropy, both harmonicities, roughness."""
    sets, spec = triads(spark, step), SpectrumSpec.of("harmonic", partials, "powerlaw", 1)
    major = [100 * p for p in MAJOR]
    enriched = [(p + 1200 * math.log2(n), 1 / n) for p in major for n in range(1, partials + 1)]
    similar = tensor.cosine_with(spectra.add_spectra(sets, spec), "major", [e[0] for e in enriched], TensorParams(10, 1, False, True, 1200), [e[1] for e in enriched]).select(F.col("a_id").alias("set_id"), "similarity")
    entropy = harmony.spectral_entropy(sets, 10.0, spectrum=spec)
    template = harmony.template_harmonicity(sets, 10.0, spectrum=spec, chord_spectrum=spec)
    dense = harmony.tensor_harmonicity(sets, 10.0, size=3, spectrum=spec)
    out = similar
    for measure in (entropy, template, dense, harmony.roughness(triad_hz(sets, spec))):
        out = out.join(measure, "set_id")
    return out


@query("triad_consonance")
def _triad_consonance(spark: SparkSession, d: str) -> DataFrame:
    """All five over the 1,891 triads of a 20-cent grid, on one-cent grids of pitch."""
    return r6(triad_consonance(spark).select("set_id.x", "set_id.y", "similarity", "entropy", "h_max", "h_entropy", "h", "roughness"))


_TRIADS_SQL = f"SELECT x::INT AS x, y::INT AS y, unnest([0.0, x * {_TRIAD_STEP}, y * {_TRIAD_STEP}])::DOUBLE AS p FROM range({int(1200 / _TRIAD_STEP) + 1}) a(x), range({int(1200 / _TRIAD_STEP) + 1}) c(y) WHERE x <= y"


@query(
    "triad_measures",
    f"""WITH a AS (SELECT x, y, p + o AS p, s AS w FROM ({_TRIADS_SQL}), ({partial_sql(_DEMO)})), {values('b0', [100 * p for p in MAJOR])}, b AS (SELECT p + o AS p, w * s AS w FROM b0, ({partial_sql(_DEMO)})),
    ab AS (SELECT x, y, sum(a.w * b.w * {_KERNEL}) AS v FROM a, b GROUP BY 1, 2), aa AS (SELECT a.x, a.y, sum(a.w * b.w * {_KERNEL}) AS v FROM a JOIN a b ON a.x = b.x AND a.y = b.y GROUP BY 1, 2), bb AS (SELECT sum(a.w * b.w * {_KERNEL}) AS v FROM b a, b),
    z AS (SELECT x, y, {_MIDDLE_C} * power(2, p / 1200) AS f, w FROM a), u AS (SELECT a.x, a.y, sum(least(a.w, b.w) * 5 * (exp(-3.51 * 0.24 / (0.0207 * a.f + 18.96) * (b.f - a.f)) - exp(-5.75 * 0.24 / (0.0207 * a.f + 18.96) * (b.f - a.f)))) AS r FROM z a JOIN z b ON a.x = b.x AND a.y = b.y AND a.f < b.f GROUP BY 1, 2),
    m AS (SELECT ab.x, ab.y, ab.v / sqrt(aa.v * bb.v) AS s, u.r FROM ab JOIN aa ON ab.x = aa.x AND ab.y = aa.y JOIN u ON u.x = ab.x AND u.y = ab.y, bb), e AS (SELECT min(r) AS lo, max(r) AS hi FROM m)
    SELECT x, y, {R('s')} AS similarity, {R('power((r - lo) / (hi - lo), 0.5) * (hi - lo) + lo')} AS roughness FROM m, e""",
)
def _triad_measures(spark: SparkSession, d: str) -> DataFrame:
    """Similarity to the major triad, and roughness under a gamma of one half, of the same triads."""
    sets = triads(spark, _TRIAD_STEP)
    major = [(100 * p + 1200 * math.log2(n), 1 / n) for p in MAJOR for n in range(1, _DEMO.n + 1)]
    similar = tensor.cosine_with(spectra.add_spectra(sets, _DEMO), "major", [m[0] for m in major], TensorParams(10, 1, False, True, 1200), [m[1] for m in major])
    rough = profiles.gamma_compress(harmony.roughness(triad_hz(sets, _DEMO)), "roughness", 0.5)
    out = similar.join(rough, similar["a_id"] == rough["set_id"])
    return r6(out.select("set_id.x", "set_id.y", "similarity", "roughness"))


# ---------------------------------------------------------------- audio

#: Sounds: name, partials (frequency, amplitude), sample format.
_C, _A = 261.6255653005986, 440.0
SOUNDS = {
    "tone C4": ([_C], "pcm16"),
    "tone A4": ([_A], "float32"),
    "E minor": ([_C * 2 ** (k / 12) for k in (4, 7, 11)], "pcm24"),
    "G7 on F": ([_C * 2 ** (k / 12) for k in (5, 7, 11, 14)], "float64"),
    "C minor": ([_C * 2 ** (k / 12) for k in (0, 7, 15)], "pcm16"),
}


def sounds(spark: SparkSession) -> DataFrame:
    """(path, content) of synthesised sounds of six partials to a tone, as the bytes of WAV files."""
    listed = spark.createDataFrame([(k, [float(x) for x in f], kind) for k, (f, kind) in SOUNDS.items()], "path string, f array<double>, kind string")
    return listed.select("path", audio.synthesised("f", "kind"))


@query("audio_features")
def audio_features(spark: SparkSession, d: str = "") -> DataFrame:
    """Peaks before and after smoothing, spectral entropy, harmonicity and roughness of each sound."""
    plain, smooth = (audio.peaks_of(sounds(spark), audio.PeakParams(sigma=s)) for s in (0.0, 9.0))
    hz = smooth.select(F.col("path").alias("set_id"), F.col("f").alias("p"), "w")
    cents = hz.withColumn("p", convert_pitch("p", "hz", "cents"))
    out = plain.groupBy(F.col("path").alias("set_id")).agg(F.count("*").alias("n_plain")).join(hz.groupBy("set_id").agg(F.count("*").alias("n_smooth")), "set_id")
    for part in (harmony.spectral_entropy(cents), harmony.template_harmonicity(cents), harmony.roughness(hz)):
        out = out.join(part, "set_id")
    return r6(out)


@query("audio_similarity")
def audio_similarity(spark: SparkSession, d: str = "") -> DataFrame:
    """Spectral pitch-class similarity of every two sounds."""
    sets = audio.peaks_of(sounds(spark), audio.PeakParams(sigma=9.0)).select(F.col("path").alias("set_id"), convert_pitch("f", "hz", "cents").alias("p"), "w")
    names = spark.createDataFrame([(a, b) for a in SOUNDS for b in SOUNDS if a < b], "a_id string, b_id string")
    return r6(tensor.cosine(sets, sets, names, TensorParams(12, 1, False, True, 1200)))
