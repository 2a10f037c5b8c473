"""k-mer coverage and median frequency of sequences in samples."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandframe.functions import coded as C
from strandframe.functions import sequence as S
from strandframe.operators.kmers import capped, explode_kmers
from strandframe.operators.lineage import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def coverage(seqs: DataFrame, samples: DataFrame, k: int, seq_id: str = "seq_id", seq: str = "seq") -> DataFrame:
    """One row per sequence and sample: median_freq of covered positions, num_kmers (covered positions),
    kmer_ratio (by distinct k-mers, so over 1 on repeats). Pairs without a hit have 0, 0 and 0.0.

    `samples(sample, kmer, freq)`. Of sequences with one id the first by text counts. The zero-filled grid is
    the result itself, sequences times samples. Up to k = 11 windows are looked up in a table of the samples'
    frequencies, 8 MB a sample and some samples at a time; longer ones, and sequences with other letters than
    A, C, G and T, join them, and hits join the grid after they are aggregated.
    """
    if not 3 <= k <= 255:
        raise ValueError("k must be from 3 to 255")
    seqs = seqs.groupBy(seq_id).agg(F.min(seq).alias(seq))
    if k > C.TABLE_K:
        return _joined(seqs, samples, k, seq_id, seq)
    odd, blocks = seqs.where(~C.plain(F.col(seq))), cut(C.packed(samples, k))
    parts = [_looked_up(seqs.where(C.plain(F.col(seq))), some, table, samples, k, seq_id, seq) for some, table in C.tables(seqs.sparkSession, blocks, k)]
    if not parts or not C.blank(odd):
        parts.append(_joined(odd, samples, k, seq_id, seq))
    return reduce(DataFrame.unionByName, parts)


def _looked_up(seqs: DataFrame, some: list, table, samples: DataFrame, k: int, seq_id: str, seq: str) -> DataFrame:
    """`coverage` of plain sequences in some samples, whose frequencies are in a table."""
    kinds = {seq_id: seqs.schema[seq_id].dataType.simpleString(), "sample": samples.schema["sample"].dataType.simpleString()}
    kind = to_arrow_type(samples.schema["sample"].dataType)

    def make(b):
        codes, n = C.windows(b.column(1), k)
        starts, freq, m, rows = np.cumsum(n) - n, table.value, len(some), b.num_rows
        unique, med, hits = np.zeros(rows, np.int64), np.zeros((rows, m)), np.zeros((rows, m), np.int64)
        for width in np.unique(n[n > 0]):
            at = np.flatnonzero(n == width)
            own = codes[starts[at][:, None] + np.arange(width)]
            laid = np.sort(own, axis=1)
            unique[at] = 1 + (laid[:, 1:] != laid[:, :-1]).sum(axis=1)
            for j in range(m):
                hits[at, j], med[at, j] = C.middle(freq[j][own])
        ratio = hits / np.maximum(unique, 1)[:, None]
        ids = b.column(0).take(pa.array(np.repeat(np.arange(rows), m)))
        names = pa.array(some, kind).take(pa.array(np.tile(np.arange(m), rows)))
        yield pa.RecordBatch.from_arrays([ids, names, pa.array(med.ravel()), pa.array(hits.ravel()), pa.array(ratio.ravel())], [seq_id, "sample", "median_freq", "num_kmers", "kmer_ratio"])

    return C.in_batches(seqs.select(seq_id, seq), make, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", median_freq double, num_kmers long, kmer_ratio double")


def _joined(seqs: DataFrame, samples: DataFrame, k: int, seq_id: str, seq: str) -> DataFrame:
    """`coverage` by a join of windows, of any letters and length."""
    windows = explode_kmers(seqs, k, [seq_id], seq)
    own = windows.groupBy(seq_id).agg(F.count_distinct("kmer").alias("unique_kmers"))
    named = seqs.select(seq_id).join(own, seq_id, "left").withColumn("unique_kmers", F.coalesce("unique_kmers", F.lit(0)))
    counted = capped(samples).where("freq > 0")
    hits = windows.join(counted, "kmer").groupBy(seq_id, "sample").agg(S.median0(F.col("freq")).alias("median_freq"), F.count("*").alias("num_kmers"))
    grid = named.crossJoin(F.broadcast(samples.select("sample").distinct()))  # names of samples: one per input file
    joined = grid.join(hits, [seq_id, "sample"], "left")
    n = F.coalesce("num_kmers", F.lit(0))
    ratio = F.when(F.col("unique_kmers") > 0, n / F.col("unique_kmers")).otherwise(F.lit(0.0))
    return joined.select(seq_id, "sample", F.coalesce("median_freq", F.lit(0.0)).alias("median_freq"), n.alias("num_kmers"), ratio.alias("kmer_ratio"))


def coverage_wide(long: DataFrame, samples: list, seq_id: str = "seq_id") -> DataFrame:
    """One row per sequence with `<sample>_median_freq`, `<sample>_num_kmers`, `<sample>_kmer_ratio`."""
    names = ("median_freq", "num_kmers", "kmer_ratio")
    # the rows of a sequence mostly come one after the other, so that they meet before the shuffle; a pivot shuffles them all
    return long.groupBy(seq_id).agg(*(F.max(F.when(F.col("sample") == s, F.col(n))).alias(f"{s}_{n}") for s in samples for n in names))
