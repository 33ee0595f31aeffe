"""Spectral enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pitch import partials
from ..model import SpectrumSpec


def add_spectra(df: DataFrame, spec: SpectrumSpec) -> DataFrame:
    """Every element with every partial: positions add, weights multiply. A narrow step: no join, no shuffle."""
    others = [c for c in df.columns if c not in ("p", "w")]
    return df.select("*", F.inline(partials(spec))).select(*others, (F.col("p") + F.col("offset")).alias("p"), (F.col("w") * F.col("weight")).alias("w"))
