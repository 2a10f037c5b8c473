"""k-mer extraction, counting and reference sets."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.functions import coded as C
from strandframe.functions import sequence as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Frequencies saturate here.
MOST = 32767


def explode_kmers(df: DataFrame, k: int, keep: list[str], seq: str = "seq", fold: bool = True) -> DataFrame:
    """`keep` columns with pos (0-based start) and kmer of each window. Only these columns are multiplied."""
    windows = S.canonical_kmers(F.col(seq), k) if fold else S.kmers(F.col(seq), k)
    return df.select(*keep, F.posexplode(windows).alias("pos", "kmer"))


def count_kmers(df: DataFrame, k: int, by: list[str] | None = None, seq: str = "seq", weight: str | None = None) -> DataFrame:
    """(by, kmer, freq) over canonical windows without other letters; partial sums precede the shuffle."""
    by = by or []
    n = F.sum(weight) if weight else F.count("*")
    whole = weight is None or isinstance(df.schema[weight].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    odd = df.where(~C.plain(F.col(seq)))
    if k > C.TABLE_K or not whole:
        odd = df
    windows = explode_kmers(odd, k, [*by, *([weight] if weight else [])], seq).where(S.only_acgt(F.col("kmer")))
    slow = windows.groupBy(*by, "kmer").agg(n.alias("n"))
    if odd is not df:
        fast = C.counted(df.where(C.plain(F.col(seq))), k, by, seq, weight)
        slow = fast if C.blank(odd) else fast.unionByName(slow).groupBy(*by, "kmer").agg(F.sum("n").alias("n"))
    return slow.select(*by, "kmer", F.least("n", F.lit(MOST)).cast("int").alias("freq"))


def reference_set(df: DataFrame, k: int | None = None, column: str = "seq") -> DataFrame:
    """(k, kmer), distinct and canonical. Without k each row is a k-mer, its first word; with k windows of sequences,
    of which those with other letters are left out."""
    return reference_windows(df, k, column).distinct()


def reference_windows(df: DataFrame, k: int | None = None, column: str = "seq") -> DataFrame:
    """`reference_set` with repeats, for matching, which they don't change."""
    if k is None:
        found = df.select(S.canonical(F.split(F.col(column), "[\t ]")[0]).alias("kmer"))
    else:
        fast = C.plain(F.col(column)) if k <= C.LONGEST else F.lit(False)
        found = explode_kmers(df.where(~fast), k, [], column).select("kmer").where(S.only_acgt(F.col("kmer")))
        if k <= C.LONGEST:

            def make(b):
                yield pa.RecordBatch.from_arrays([C.texts(np.unique(C.windows(b.column(0), k)[0]), k)], ["kmer"])

            found = found.unionByName(C.in_batches(df.where(fast).select(column), make, "kmer string"))
    return found.where("length(kmer) > 0").select(F.length("kmer").alias("k"), "kmer")


def capped(samples: DataFrame) -> DataFrame:
    """(sample, kmer, freq) with one row per pair: frequencies saturate, and of repeats the largest stays."""
    return samples.select("sample", S.canonical(F.col("kmer")).alias("kmer"), "freq").groupBy("sample", "kmer").agg(F.least(F.max("freq"), F.lit(MOST)).cast("int").alias("freq"))
