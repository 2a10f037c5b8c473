"""Expression values: gene lengths from exons, and transcripts per million."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gene_lengths(exons: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """(gene, length): positions under the union of the gene's exons. `exons(gene, start, end)`, closed intervals.

    With `transcripts(gene, start, end)` only what lies between a gene's first and last transcript position counts.
    Overlaps are found by the running maximum of the ends, positions are not exploded.
    """
    rows = exons.select("gene", "start", "end").where("end >= start")
    if transcripts is not None:
        bounds = transcripts.groupBy("gene").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
        rows = rows.join(bounds, "gene").select("gene", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end")).where("end >= start")
    w = Window.partitionBy("gene").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end").over(w), F.col("start") - 1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, covered))
    return rows.withColumn("new", new).groupBy("gene").agg(F.sum("new").alias("length"))


def tpm(lengths: DataFrame, counts: DataFrame, literal: bool = False) -> DataFrame:
    """(gene, sample, reads, tpm) for every gene of `lengths` and every sample of `counts(gene, sample, reads)`.

    Missing reads count 0, genes that aren't in `lengths` are left out. `literal` multiplies by the sample's total where
    the definition divides by it.
    """
    samples = F.broadcast(counts.select("sample").distinct())  # one per column of the count matrix
    known = counts.groupBy("gene", "sample").agg(F.sum("reads").alias("reads"))
    rows = lengths.crossJoin(samples).join(known, ["gene", "sample"], "left").withColumn("reads", F.coalesce("reads", F.lit(0)))
    rows = rows.withColumn("rate", F.when(F.col("length") > 0, F.col("reads") / F.col("length")))
    totals = rows.groupBy("sample").agg(F.sum("rate").alias("total"))
    joined = rows.join(F.broadcast(totals), "sample")
    hundred = F.col("total") * 100
    value = F.col("rate") * 100 * 1e6 * hundred if literal else F.when(F.col("total") > 0, 1e6 * F.col("rate") / F.col("total"))
    return joined.select("gene", "sample", "reads", value.alias("tpm"))


def unpivot_counts(wide: DataFrame, gene: str = "GeneId") -> DataFrame:
    """A count matrix, one column per sample, as (gene, sample, reads)."""
    return wide.unpivot([gene], [c for c in wide.columns if c != gene], "sample", "reads").select(F.col(gene).alias("gene"), "sample", F.col("reads").cast("long").alias("reads"))


def tpm_wide(long: DataFrame, samples: list) -> DataFrame:
    return long.groupBy("gene").pivot("sample", samples).agg(F.first("tpm")).orderBy("gene")
