"""Operator 2, exact dedup by content sort."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, cut, prepare

#: Characters of the normalised text in a splitter. Splitters are sampled by the driver, so they must be short.
HEAD = 64


def _runs(batches: Iterator[pa.RecordBatch], rows: bool) -> Iterator[pa.RecordBatch]:
    """Find the runs of equal texts in a sorted partition, comparing neighbours in full.

    Columns are norm, sha, doc_id and, with `rows`, row; there the first row of each run comes out, else all ids of it.
    `edge` is -1 inside a partition; of its first and last run, which may go on in the neighbouring partitions, it says
    which run it is, and their first rows hold the text. Of the run that is open only its first row and the ids are kept.
    """
    part, names = TaskContext.get().partitionId(), ["text_sha256", "doc_id", "first_id", "n", "part", "edge", "norm", "head", "row"]
    open_, number = None, 0  # [norm, sha, first id, row, ids, length]

    def close(run: list, last: bool) -> pa.RecordBatch:
        norm, sha, first, row, ids, n = run
        edge = number if last or number == 0 else -1
        wide = 1 if rows else n
        head = pa.array([norm if edge >= 0 else None] + [None] * (wide - 1), pa.string())
        constant = lambda value, type_: pa.repeat(pa.scalar(value, type_), wide)
        values = [constant(sha, pa.string()), pa.array([first], pa.int64()) if rows else pa.concat_arrays(ids), constant(first, pa.int64()), constant(n, pa.int64()), constant(part, pa.int32()), constant(edge, pa.int64()), head, pa.array(np.arange(wide) == 0)]
        if rows:
            values.append(row)
        return pa.RecordBatch.from_arrays(values, names=names[: len(values)])

    for batch in batches:
        if not (count := batch.num_rows):
            continue
        norm, sha, key = batch.columns[:3]
        new = np.ones(count, bool)
        new[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        new[0] = open_ is None or norm[0].as_py() != open_[0]
        starts = np.flatnonzero(new).tolist()
        done = []
        lead = starts[0] if starts else count
        if lead:
            open_[5] += lead
            if not rows:
                open_[4].append(key[:lead])
        for a, b in zip(starts, [*starts, count][1:], strict=True):
            if open_:
                done.append(close(open_, False))
                number += 1
            open_ = [norm[a].as_py(), sha[a].as_py(), key[a].as_py(), batch.column(3).take([a]) if rows else None, [] if rows else [key[a:b]], b - a]
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if open_:
        yield close(open_, True)


def _sorted(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """(norm, sha, doc_id, ...) in range partitions that sampled splitters bound, externally sorted by content, then id."""
    norm = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACES, " ")
    keyed = docs.select(norm.alias("norm"), F.col(doc_id).cast("long").alias("doc_id"), *more).withColumn("sha", F.sha2("norm", 256))
    keyed = keyed.withColumn("lead", F.substring("norm", 1, HEAD))
    order = [F.col("lead"), F.col("sha"), F.col("doc_id").asc_nulls_last()]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("lead").select("norm", "sha", *[c for c in keyed.columns if c not in ("norm", "sha", "lead")])


def _met(runs: DataFrame) -> DataFrame:
    """(part, edge, keep_id, group_size, first): what the runs at the edges of partitions, compared by their whole texts, make
    together, and whether theirs is the first. Numbers only, for two runs a partition at most."""
    edges = runs.where("norm is not null").select("text_sha256", "norm", "part", "edge", "first_id", "n")
    same = Window.partitionBy("text_sha256", "norm")
    order = same.orderBy(F.col("part"), F.col("edge"))
    return edges.select("part", "edge", F.min("first_id").over(same).alias("keep_id"), F.sum("n").over(same).alias("group_size"), (F.row_number().over(order) == 1).alias("first"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of ASCII blanks became one space; of equal texts the row
    with the smallest doc_id stays. Method: splitters are sampled from (first HEAD characters, SHA-256,
    doc_id), the rows are range-partitioned by them and sorted externally in each partition, so equal texts
    lie next to each other, and neighbours are compared in full. As the id is part of the splitter, a text
    that fills a third of the table spreads over many partitions. Only runs at the edges of partitions, at
    most two a partition, meet again in a second, small step, there too by their whole texts.

    Null texts count as empty; an empty text is a text like others. Null ids come last, so one of them is
    kept only where a group has no id. Of several rows with the same id and text one is kept. Other columns
    of `docs`, whatever their names, play no part. Empty tables give empty results. Texts of any length are
    compared in whole.
    """
    prepare(docs.sparkSession)
    laid = _sorted(docs, doc_id, text)
    schema = "text_sha256 string, doc_id long, first_id long, n long, part int, edge long, norm string, head boolean"
    runs = cut(laid.mapInArrow(partial(_runs, rows=False), schema))
    # at most two rows of numbers a partition go in, so the broadcast is bounded by the number of partitions
    joined = runs.join(F.broadcast(_met(runs)), ["part", "edge"], "left")
    inside = F.col("edge") < 0
    return joined.select(
        "doc_id",
        F.when(inside, F.col("first_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "n").alias("group_size"),
        (F.col("head") & (inside | F.col("first"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that hold a text first, with all their columns: of equal texts the row with the smallest doc_id.

    The rows themselves go through the sort and the first of each run comes out, so ids need not tell rows apart: of rows
    that share id and text one stays, of copies without an id too, and rows without an id come after all others. Null
    texts count as empty, and of empty texts one stays. Columns may have any names. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    laid = _sorted(docs, doc_id, text, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kind = T.StructType([*T._parse_datatype_string("text_sha256 string, doc_id long, first_id long, n long, part int, edge long, norm string, head boolean").fields, T.StructField("row", docs.schema)])
    runs = cut(laid.mapInArrow(partial(_runs, rows=True), kind))
    joined = runs.join(F.broadcast(_met(runs)), ["part", "edge"], "left")
    return joined.where("edge < 0 or first").select("row.*")
