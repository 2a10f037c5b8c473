"""The corpus pipeline: each stage reads what the one before it kept, and its decisions take effect.

All stages judge rows: a null text counts as empty, rows that share an id are rows of their own, rows without an id are
kept or dropped by their text, an empty table gives an empty one, and columns besides those of `documents` play no part.
What differs stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import decontam, exact_dedup, mixing, simhash, toxicity
from strandframe.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 8 doesn't predict to be toxic. Empty texts stay; a label without a document teaches nothing."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id (operator 2). Of rows that share id and text one stays, and of empty texts one."""
    return exact_dedup.drop_copies(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id (operator 3). Empty texts and rows without an id stay."""
    return simhash.drop_near_copies(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item that tiles cover (operator 9). Empty texts stay."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for (operator 10). A null source is one of its own, the last;
    texts without words take nothing."""
    return mixing.mix(docs).select(*COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Trained scores, fingerprints and tiles can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each cut off from the plans before it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
