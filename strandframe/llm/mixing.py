"""Operator 10, mixing sources to target weights. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, cut, prepare


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in order, repeating. total: share of all sizes that the targets add up to.
    most: times its own size that a source's target can be. seed: of the copies' hash."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    total: float = 1.5
    most: float = 2.0
    seed: str = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed only: 52 bits of MD5. A null id counts as 'null'."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, how: Mix) -> DataFrame:
    """`sizes(source, size)` to one row per source: source_size, n, target.

    Weights go round by code point of the source, null last. The targets share total * all sizes by weight.
    What a target has above its limit, most * its source's size, is shared by weight among the others until
    none is above. That ends at one level: target = min(limit, level * weight). Sorted by limit / weight,
    the sources below the level are a prefix, so running sums give it without iterating. The windows see
    one row per source, not per document.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weights = F.array(*(F.lit(float(w)) for w in how.weights))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("weight", F.element_at(weights, (rank % len(how.weights)).cast("int") + 1))
    own = own.withColumn("limit", F.lit(how.most) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    share = F.lit(how.total) * F.sum("source_size").over(everything)
    own = own.withColumn("level", (share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose limit is not below the level that the earlier ones leave
    own = own.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return own.select("source", "source_size", "n", target.alias("target"))


def plan(docs: DataFrame, how: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, rate, copies.

    size is the number of words; rate = target / source_size; copies = floor(rate), plus one where the
    id's hash is below the fraction. Null and empty texts have size 0 (and take no words). A source of size
    0 has rate 0. A null source is a source of its own, the last one. Rows with the same id get the same
    copies. Sources are summed map-side; a source that holds a third of the rows is joined by broadcast.
    """
    prepare(docs.sparkSession)
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size")))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    table = cut(source_targets(sized, how).withColumn("__key", key).drop("source"))
    joined = attach(sized.withColumn("__key", key), table, "__key", "n", sized.count())
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + (chance(F.col("doc_id"), how.seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("rate", rate).select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, how: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as `plan` says. Sources' rates are joined by source, texts are not shuffled by it."""
    prepare(docs.sparkSession)
    sized = docs.select(F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"))
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    table = cut(source_targets(sized, how).withColumn("__key", key(F.col("source"))).select("__key", "n", "source_size", "target"))
    total = table.agg(F.sum("n")).first()[0] or 0
    joined = attach(docs.withColumn("__key", key(F.col(source).cast("string"))), table.withColumnsRenamed({"source_size": "__size", "target": "__target"}), "__key", "n", total)
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("__rate", rate)
    copies = F.floor("__rate") + (chance(F.col(doc_id), how.seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
