"""Selection of reads by shared k-mers and by identifier, and placement of k-mers on sequences."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import coded as C
from strandframe.functions import sequence as S
from strandframe.operators.kmers import explode_kmers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class MatchOptions:
    """least: k-mer occurrences in the set. share: of all windows. invert: keep the others. literal: divide by
    length - k of the first mate, as the original tool does."""

    k: int
    least: int = 1
    share: float = 0.0
    invert: bool = False
    literal: bool = False

    def __post_init__(self):
        if not 2 <= self.k <= 1024:
            raise ValueError("k must be from 2 to 1024")
        if self.least < 0 or not 0.0 <= self.share <= 1.0:
            raise ValueError("least must not be negative, share must be from 0 to 1")


def match_reads(reads: DataFrame, kmer_set: DataFrame, how: MatchOptions, read_id: str = "read_id", seq: str = "seq", mate: str | None = None) -> DataFrame:
    """The rows of `reads` whose k-mers are in the set often enough. `read_id` has to be unique.

    Up to k = 14 windows are looked up in a table of the set, a bit for each possible k-mer, and no read is shuffled.
    Longer ones, and reads with other letters, go through joins; repeats in the set do no harm. The default (one hit) is a semi join. Counting joins windows to the set and sums per read. Reads without
    a window have no hits, and so stay when inverted. Only id and k-mer take part in the shuffle; a read's
    other columns don't. Join sides are left to adaptive execution, which broadcasts a set that it measured
    to be small and splits k-mers that are too frequent for a task.
    """
    mates = [seq] if mate is None else [seq, mate]
    if how.k <= C.BITS_K:
        plain, odd = _parts(reads, mates)
        done = _hits(plain, kmer_set, how.k, mates).where(_fits(how, F.col("__hits"), seq, mates)).select(*reads.columns)
        return done if odd is None else done.unionByName(_joined(odd, kmer_set, how, read_id, seq, mates))
    return _joined(reads, kmer_set, how, read_id, seq, mates)


def _joined(reads: DataFrame, kmer_set: DataFrame, how: MatchOptions, read_id: str, seq: str, mates: list[str]) -> DataFrame:
    """`match_reads` by joins, of any letters and length."""
    windows = None
    for m in mates:
        part = explode_kmers(reads.where(F.col(m).isNotNull()), how.k, [read_id], m)
        windows = part if windows is None else windows.unionByName(part)
    windows = windows.where(~S.has_n(F.col("kmer")))
    wanted = kmer_set.where(F.col("k") == how.k).select("kmer")
    hits = windows.join(wanted, "kmer", "left_semi")
    if how.least == 1 and how.share == 0.0:
        return reads.join(hits.select(read_id).distinct(), read_id, "left_anti" if how.invert else "left_semi")
    n = hits.groupBy(read_id).agg(F.count("*").alias("__hits"))
    return reads.join(n, read_id, "left").where(_fits(how, F.coalesce("__hits", F.lit(0)), seq, mates)).drop("__hits")


def _fits(how: MatchOptions, count: Column, seq: str, mates: list[str]) -> Column:
    length = lambda c: F.greatest(F.coalesce(F.length(c), F.lit(0)) - (how.k - 1), F.lit(0))
    whole = F.length(seq) - how.k if how.literal else sum((length(m) for m in mates[1:]), length(mates[0]))
    share = F.when(whole > 0, count / whole).otherwise(F.lit(0.0))
    fits = (count >= how.least) & (share >= how.share)
    return ~fits if how.invert else fits


def _parts(reads: DataFrame, mates: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The reads of A, C, G and T only, and those with other letters; without such the reads as they are, and None."""
    plain = reduce(Column.__and__, (C.plain(F.col(m)) for m in mates))
    odd = reads.where(~plain)
    return (reads, None) if C.blank(odd) else (reads.where(plain), odd)


def _hits(reads: DataFrame, kmer_set: DataFrame, k: int, mates: list[str]) -> DataFrame:
    """Plain `reads` with __hits, looked up in a table of 4^k bits."""
    table = C.bits(kmer_set.where(F.col("k") == k).select("kmer"), k)

    @F.pandas_udf("long")
    def count(*columns: pd.Series) -> pd.Series:
        total = 0
        for c in columns:
            codes, n = C.windows(pa.array(c, pa.string()), k)
            total = total + C.sums(table.value[codes >> 3] >> (codes & 7).astype(np.uint8) & 1, n)
        return pd.Series(total)

    return reads.withColumn("__hits", count(*mates))


def match_counts(reads: DataFrame, kmer_set: DataFrame, k: int, read_id: str = "read_id", seq: str = "seq") -> DataFrame:
    """(read_id, hits) for every read, 0 included."""
    if k <= C.BITS_K:
        plain, odd = _parts(reads.select(read_id, seq), [seq])
        done = _hits(plain, kmer_set, k, [seq]).select(read_id, F.col("__hits").alias("hits"))
        return done if odd is None else done.unionByName(_counts(odd, kmer_set, k, read_id, seq))
    return _counts(reads, kmer_set, k, read_id, seq)


def _counts(reads: DataFrame, kmer_set: DataFrame, k: int, read_id: str, seq: str) -> DataFrame:
    windows = explode_kmers(reads, k, [read_id], seq).where(~S.has_n(F.col("kmer")))
    hits = windows.join(kmer_set.where(F.col("k") == k).select("kmer"), "kmer", "left_semi").groupBy(read_id).agg(F.count("*").alias("hits"))
    return reads.select(read_id).join(hits, read_id, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def clean_ids(ids: DataFrame, column: str = "value") -> DataFrame:
    """(id), distinct: a leading @ and a trailing /1 or /2 are cut."""
    return ids.select(F.regexp_replace(F.col(column).cast("string"), "^@|/[12]$", "").alias("id")).where("length(id) > 0").distinct()


def match_ids(reads: DataFrame, ids: DataFrame, invert: bool = False, line: str = "line") -> DataFrame:
    """Reads whose id, the first token of the line without its first character, is in `ids` (or isn't)."""
    key = F.expr(f"substring(split({line}, '[\t /]')[0], 2)")
    return reads.withColumn("id__", key).join(ids.select(F.col("id").alias("id__")), "id__", "left_anti" if invert else "left_semi").drop("id__")


def locate_kmers(seqs: DataFrame, kmer_set: DataFrame, k: int, first_bases: int | None = None, first_sequences: int | None = None, seq_id: str = "seq_id", seq: str = "seq", order: str | None = None) -> DataFrame:
    """(kmer as seen, seq_id, start from 1, end) of each window whose canonical form is in the set."""
    if first_sequences is not None:
        seqs = seqs.orderBy(order or seq_id).limit(first_sequences)
    body = F.substring(seq, 1, first_bases) if first_bases else F.col(seq)
    seen = explode_kmers(seqs.select(seq_id, body.alias(seq)), k, [seq_id], seq, fold=False).where(~S.has_n(F.col("kmer")))
    keyed = seen.withColumn("form", S.canonical(F.col("kmer")))
    wanted = kmer_set.where(F.col("k") == k).select(F.col("kmer").alias("form"))
    found = keyed.join(wanted, "form", "left_semi")
    return found.select("kmer", seq_id, (F.col("pos") + 1).alias("start"), (F.col("pos") + k).alias("end"))


def located_totals(located: DataFrame, seq_id: str = "seq_id") -> DataFrame:
    return located.groupBy(seq_id).agg(F.count("*").alias("placed"))


def best_per_group(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rank = 1").drop("__rank")
