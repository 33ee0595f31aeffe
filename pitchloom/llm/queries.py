"""Registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, langid, mixing, packing, quality, simhash, token_counts, token_files, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.query,
    "op2_pack": packing.query,
    "op3_language": langid.query,
    "op4_token_files": token_files.query,
    "op5_mix": mixing.query,
    "op6_fingerprints": fingerprints.query,
    "op7_toxicity": toxicity.query,
    "op8_warc_fixity": warc.query,
    "op9_simhash": simhash.query,
    "op10_quality": quality.query,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mix": mixing.SQL,
    "op8_warc_fixity": warc.SQL,
}
