"""Protein-domain hits: coordinates, grouping by gaps, and the open reading frames under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.lineage import cut


def hit_coordinates(hits: DataFrame) -> DataFrame:
    """Hits of a domain table (target, description, ali_from, ali_to in residues, target_len) in bases.

    The frame is `frame=N` or `frN` of the description, 4..6 are -1..-3. `offset` is the second `_` field of the
    target, 0 where it is no number. Reverse frames count from the end of the translated stretch.
    """
    number = F.regexp_extract("description", r"(?:frame=|fr)(-?\d)", 1)
    frame = F.expr("try_cast(__f as int)")
    rows = hits.withColumn("__f", number).withColumn("frame", frame).drop("__f")
    rows = rows.withColumn("frame", F.when(F.col("frame") > 3, 3 - F.col("frame")).otherwise(F.col("frame")))
    offset = F.coalesce(F.expr("try_cast(get(split(target, '_'), 1) as bigint)"), F.lit(0))
    size = F.col("target_len") * 3
    shift = F.abs("frame") - 1
    ahead = F.col("frame") > 0
    start = F.when(ahead, (F.col("ali_from") - 1) * 3 + 1 + shift).otherwise(size - F.col("ali_to") * 3 + 1 + shift)
    end = F.when(ahead, F.col("ali_to") * 3 + shift).otherwise(size - (F.col("ali_from") - 1) * 3 + shift)
    return rows.withColumn("strand", F.when(ahead, F.lit("+")).otherwise(F.lit("-"))).withColumn("start", start + offset).withColumn("end", end + offset)


def group_hits(hits: DataFrame, gap: int = 200, target: str = "target") -> DataFrame:
    """The hits with `group_no`: along a target and strand a new group begins where a hit starts more than `gap` after
    the end of the hit before it (that hit's end, not the furthest one). Ties go by end."""
    w = Window.partitionBy(target, "strand").orderBy("start", "end")
    new = (F.col("start") - F.lag("end").over(w) > gap).cast("int")
    return hits.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn("group_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def group_summary(grouped: DataFrame, least: int = 1, most: int | None = None, target: str = "target") -> DataFrame:
    """(target, strand, group_no, start, end, hits), groups with `least` to `most` hits."""
    rows = grouped.groupBy(target, "strand", "group_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("hits"))
    return rows.where((F.col("hits") >= least) & (F.lit(True) if most is None else F.col("hits") <= most))


def assign_orfs(hits: DataFrame, orfs: DataFrame, target: str = "target", width: int = 4096) -> DataFrame:
    """Each hit with the longest ORF of its strand that it overlaps: (hit columns, orf_start, orf_end, has_stop).

    `orfs(target, strand, start, end, has_stop)`. Intervals meet in bins of `width` bases, so the join is an equi
    join however long a target is. Ties: the ORF that starts first.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    left = hits.withColumn("__bin", bins("start", "end"))
    right = orfs.select(target, "strand", F.col("start").alias("orf_start"), F.col("end").alias("orf_end"), "has_stop").withColumn("__bin", bins("orf_start", "orf_end"))
    met = left.join(right, [target, "strand", "__bin"]).where("orf_start <= end and orf_end >= start").drop("__bin")
    w = Window.partitionBy(*hits.columns).orderBy((F.col("orf_end") - F.col("orf_start")).desc(), "orf_start", "orf_end")
    return met.dropDuplicates().withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def orfs_of_groups(groups: DataFrame, hits: DataFrame, seqs: DataFrame, gap: int = 200, extend: bool = True, rounds: int = 12, target: str = "target") -> DataFrame:
    """ORFs under the hits of each group, looked for in its range with half a gap on both sides.

    Groups in which an ORF with hits has no stop are looked at again with a doubled flank, until it has one, the
    range is the whole target, or `rounds` are over. Only unresolved groups go on. `seqs(target, seq)`.
    """
    from strandframe.operators.orf import find_orfs

    key = [target, "strand", "group_no"]
    todo, done, flank = groups.select(*key, F.col("start").alias("g_start"), F.col("end").alias("g_end")), None, gap // 2
    for step in range(rounds if extend else 1):
        ranges = todo.join(seqs, target).withColumn("lo", F.greatest(F.lit(1), F.col("g_start") - flank)).withColumn("hi", F.least(F.length("seq"), F.col("g_end") + flank))
        name = F.concat_ws("\x1f", *(F.col(c).cast("string") for c in key))
        pieces = ranges.select(*key, "lo", "hi", F.length("seq").alias("len"), name.alias("seq_id"), F.expr("substring(seq, lo, hi - lo + 1)").alias("seq"))
        found = find_orfs(pieces, 6, without_stop=True).where("end >= start")
        placed = found.join(pieces.select("seq_id", *key, "lo", "hi", "len"), "seq_id").where("(strand = '+' and frame > 0) or (strand = '-' and frame < 0)")
        placed = placed.select(*key, (F.col("start") + F.col("lo") - 1).alias("start"), (F.col("end") + F.col("lo") - 1).alias("end"), "frame", "has_stop", ((F.col("lo") == 1) & (F.col("hi") == F.col("len"))).alias("whole"))
        used = assign_orfs(hits.join(todo.select(*key), key), placed.drop("group_no").select(target, "strand", "start", "end", "has_stop").distinct(), target)
        used = used.select(*key, F.col("orf_start").alias("start"), F.col("orf_end").alias("end")).groupBy(*key, "start", "end").agg(F.count("*").alias("hits"))
        rows = cut(placed.join(used, [*key, "start", "end"]))
        again = rows.where("not has_stop and not whole").select(*key).distinct() if extend and step < rounds - 1 else None
        kept = rows if again is None else rows.join(again, key, "left_anti")
        done = kept.drop("whole") if done is None else done.unionByName(kept.drop("whole"))
        if again is None or not again.limit(1).count():
            break
        todo, flank = todo.join(again, key, "left_semi"), flank * 2
    return done


def gff3(groups: DataFrame, orfs: DataFrame, hits: DataFrame, target: str = "target") -> DataFrame:
    """(sort keys, value): region, ORF and match rows of GFF3, after its header line. Sort by the keys to print."""
    row = lambda kind, score, name: F.concat_ws("\t", F.col(target), F.lit("strandframe"), F.lit(kind), F.col("start").cast("string"), F.col("end").cast("string"), score, F.col("strand"), F.lit("."), name)
    part = lambda df, n, kind, score, name: df.select(target, "strand", "group_no", F.lit(n).alias("level"), "start", "end", row(kind, score, name).alias("value"))
    group = F.concat(F.lit("ID=group"), F.col("group_no").cast("string"))
    dot = F.lit(".")
    return (
        part(groups, 0, "region", dot, F.concat(group, F.lit(";hits="), F.col("hits").cast("string")))
        .unionByName(part(orfs, 1, "ORF", dot, F.concat(group, F.lit(";frame="), F.col("frame").cast("string"))))
        .unionByName(part(hits, 2, "match", F.coalesce(F.col("score").cast("string"), dot) if "score" in hits.columns else dot, group))
    )
