"""Operators that need no state, over streams of lines. Nothing is kept between batches, so there is no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators import demultiplex as dm
from strandframe.operators import pileup as pu
from strandframe.sources.readers import parse_records


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).where("length(trim(value)) > 0")


def stream_matches(lines: DataFrame, kmer_set: DataFrame, k: int, invert: bool = False) -> DataFrame:
    """Reads with a k-mer of a static set: each read's canonical windows meet the set, of measured size, as one array.

    The set has to fit in memory (it is collected to one row); a larger one needs the batch operator in foreachBatch.
    """
    wanted = kmer_set.where(F.col("k") == k).agg(F.collect_set("kmer").alias("__set"))
    rows = parse_records(lines).crossJoin(F.broadcast(wanted))  # one row
    hit = F.arrays_overlap(S.canonical_kmers(F.col("seq"), k), F.col("__set"))
    return rows.where(~F.coalesce(hit, F.lit(False)) if invert else hit).drop("__set")


def stream_ids(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Reads whose id is in a static table."""
    key = F.expr("substring(split(line, '[\t /]')[0], 2)")
    return parse_records(lines).withColumn("id__", key).join(ids.select(F.col("id").alias("id__")), "id__", "left_semi").drop("id__")


def stream_demultiplex(lines: DataFrame, barcodes: DataFrame, how: dm.DemultiplexOptions = dm.DemultiplexOptions()) -> DataFrame:
    return dm.demultiplex(parse_records(lines), barcodes, how)


def stream_calls(lines: DataFrame, how: pu.PileupOptions = pu.PileupOptions()) -> DataFrame:
    """Base calls of each locus and sample."""
    return pu.call(pu.base_counts(pu.parse_pileup(lines)), how)
