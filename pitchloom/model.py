"""Parameters of the operators, checked when a plan is made, and the long form of a multiset.

Long form: ``set_id`` (any type), ``p`` DOUBLE, ``w`` DOUBLE, a row for each element; duplicates are elements of their
own. A null weight is 1. NaN positions are padding and are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("harmonic", "stretched", "freqlinear", "stiff", "custom")
DECAYS = ("powerlaw", "geometric")


@dataclass(frozen=True)
class TensorParams:
    """sigma: kernel width; r: tuple size; relative: transposition is ignored; periodic: with the period."""

    sigma: float
    r: int = 1
    relative: bool = False
    periodic: bool = True
    period: float = 1200.0

    def __post_init__(self) -> None:
        if self.sigma <= 0:
            raise ValueError("sigma must be positive")
        if self.r < 1:
            raise ValueError("r must be at least 1")
        if self.relative and self.r < 2:
            raise ValueError("a relative tensor needs r of at least 2")
        if self.periodic and self.period <= 0:
            raise ValueError("the period must be positive")

    @property
    def dim(self) -> int:
        return self.r - self.relative


@dataclass(frozen=True)
class SpectrumSpec:
    """Partials added to each element: a mode with its parameter, a decay with its rate, or custom vectors."""

    mode: str = "harmonic"
    n: int = 1
    decay: str = "powerlaw"
    rate: float = 1.0
    parameter: float | None = None
    offsets: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    units: float = 1200.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "mode", self.mode.lower())
        object.__setattr__(self, "decay", self.decay.lower())
        if self.mode not in MODES:
            raise ValueError(f"unknown spectrum mode {self.mode}")
        if self.mode == "custom":
            if not self.offsets or len(self.offsets) != len(self.weights):
                raise ValueError("custom offsets and weights must be of equal, positive length")
            return
        if self.n < 1 or self.n != int(self.n):
            raise ValueError("the number of partials must be a positive integer")
        if self.decay not in DECAYS:
            raise ValueError(f"unknown decay {self.decay}")
        if self.decay == "powerlaw" and self.rate < 0 or self.decay == "geometric" and not 0 <= self.rate <= 1:
            raise ValueError("the decay rate is out of range")
        if self.mode == "harmonic":
            return
        if self.parameter is None:
            raise ValueError(f"{self.mode} needs a parameter")
        if self.mode == "stretched" and self.parameter <= 0 or self.mode == "freqlinear" and self.parameter <= -1 or self.mode == "stiff" and self.parameter < 0:
            raise ValueError(f"the parameter of {self.mode} is out of range")

    @classmethod
    def of(cls, *spec, units: float = 1200.0) -> SpectrumSpec:
        """From the positional form: ('harmonic', 12, 'powerlaw', 1), ('stiff', 12, 0.01, 'geometric', .9), ('custom', o, w)."""
        mode = str(spec[0]).lower()
        if mode not in MODES:
            raise ValueError(f"unknown spectrum mode {mode}")
        if mode == "custom":
            return cls("custom", offsets=tuple(map(float, spec[1])), weights=tuple(map(float, spec[2])), units=units)
        if mode == "harmonic":
            return cls(mode, spec[1], spec[2], float(spec[3]), units=units)
        return cls(mode, spec[1], spec[3], float(spec[4]), float(spec[2]), units=units)


def multiset(df: DataFrame, set_id: str = "set_id", p: str = "p", w: str | float | None = "w") -> DataFrame:
    """The long form, with default weights and without padding; w is a column, one number for all, or None."""
    if isinstance(w, str):
        weight = F.coalesce(F.col(w).cast("double"), F.lit(1.0)) if w in df.columns else F.lit(1.0)
    else:
        weight = F.lit(1.0 if w is None else float(w))
    return df.select(F.col(set_id).alias("set_id"), F.col(p).cast("double").alias("p"), weight.alias("w")).where("p is not null and not isnan(p)")


def nested(df: DataFrame) -> DataFrame:
    """(set_id, elems) with elems ARRAY<STRUCT<p, w>> in order: for sets that fit a row."""
    return df.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("p", "w"))).alias("elems"))


def one_row_each(df: DataFrame) -> DataFrame:
    """nested(), dealt to as many tasks as a shuffle has: few bytes, but much work for each set."""
    return nested(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "set_id"))


def exploded(df: DataFrame) -> DataFrame:
    return df.select("set_id", F.inline("elems").alias("p", "w"))


def integer_positions(p: Column, n: int) -> Column:
    """Truncated to an integer and reduced modulo n, as the integer functions take their positions."""
    return F.pmod(p.cast("long"), F.lit(n)).cast("int")


def checked(value: Column, valid: Column, message: str, on_invalid: str = "raise") -> Column:
    """value where valid; else an error at run time, or null."""
    if on_invalid not in ("raise", "null"):
        raise ValueError("on_invalid is 'raise' or 'null'")
    return F.when(valid, value).otherwise(F.lit(None) if on_invalid == "null" else F.raise_error(F.lit(message)))
