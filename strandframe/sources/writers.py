"""Sinks. Folders of part files, written by all tasks; gzip by option."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "errorifexists", gzip: bool | None = None) -> None:
    """One column as text. `gzip`: by the path's suffix unless told."""
    packed = path.endswith(".gz") if gzip is None else gzip
    df.select(F.col(column).alias("value")).write.mode(mode).option("compression", "gzip" if packed else "none").text(path)


def write_sorted(df: DataFrame, path: str, order: list[str], column: str = "value", mode: str = "errorifexists") -> None:
    """Text whose part files, in order of their names, are sorted."""
    write_lines(df.orderBy(*order), path, column, mode)


def write_fastq_per_sample(out: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Kept reads of `demultiplex`, a folder per sample, kind and mate, gzipped. mode: append, overwrite or errorifexists."""
    from strandframe.operators.demultiplex import fastq_lines

    fastq_lines(out).write.mode(mode).partitionBy("sample", "kind", "mate").option("compression", "gzip").text(path)


def fasta_lines(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def write_gff3(rows: DataFrame, path: str, order: list[str]) -> None:
    """GFF3 with its version line first, as sorted part files."""
    head = rows.sparkSession.range(1).select(F.lit("##gff-version 3").alias("value"))
    first = rows.select(*order, "value").withColumn("__n", F.lit(1))
    line = head.select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order), "value", F.lit(0).alias("__n"))
    write_lines(first.unionByName(line).orderBy("__n", *order), path)


def length_histogram(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.groupBy(F.length(seq).alias("length")).agg(F.count("*").alias("n"))
