"""A corpus pipeline of five operators: language ID, toxicity, near-duplicates, mixing, packing.

Each stage takes what its predecessor kept, all of it, as Parquet in the shared folder, so a lost executor repeats
tasks of one stage at most.

Cases: documents with a null or empty text, or without a letter, have no language and go; texts of a null id, or of an
id that several rows share, are documents of their own; of equal and near-equal texts one stays, whatever their ids;
rows without a label are not learned from, and without any label no document is toxic; a document that the mix takes
several times is several copies, numbered in ``copy``, so (doc_id, copy, piece) names a row of the result where ids are
unique; an empty table gives no row; other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchloom.llm import common, langid, mixing, packing, simhash, toxicity


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a document that the mix repeats is packed as often."""
    from pitchloom.llm.tokens import vocabulary

    packed = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 1, cache_entries=300_000)
    # copies of a piece are alike, so any of them may be any copy's; the ids' checksum keeps null ids apart
    copies = Window.partitionBy("doc_id", "piece", "ids_crc32").orderBy("sequence_id", "offset")
    copy = (F.row_number().over(copies) - 1).alias("copy")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", copy)


STAGES = [
    ("language", langid.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", simhash.stage),
    ("mix", mixing.stage),
    ("pack", pack),
]

#: Learned models, components and a linear program are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
