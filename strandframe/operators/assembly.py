"""Assembly of k-mers into unambiguous contigs, and extension of seeds by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import coded as C
from strandframe.functions import sequence as S
from strandframe.operators import compact
from strandframe.operators.kmers import explode_kmers
from strandframe.operators.lineage import cut
from strandframe.operators.match import best_per_group


#: Lengths of k-mers that go as numbers, each in jobs of its own.
FEW = 8


def resolve_ks(k: int | None = None, low: int | None = None, high: int | None = None, step: int = 2) -> list[int]:
    """The values of k: one, or a range of which a missing end is the other one."""
    if k is not None:
        ks = [k]
    else:
        low, high = low if low is not None else high, high if high is not None else low
        if low is None or high < low:
            raise ValueError("give k, or a range that isn't empty")
        ks = list(range(low, high + 1, step))
    if min(ks) < 3 or max(ks) > 2048:
        raise ValueError("k must be from 3 to 2048")
    return ks


def cores(kmers: DataFrame) -> DataFrame:
    """(k, core, lefts, rights): each canonical (k-1)-mer with the bases seen on its sides.

    `kmers(kmer)` in any orientation and of any lengths. The sets hold at most four letters. A palindromic core
    looks the same from both sides and is left out; that ends contigs there.
    """
    halves = F.array(
        F.struct(F.expr("substring(kmer, 2)").alias("c"), F.lit("L").alias("side"), F.substring("kmer", 1, 1).alias("base")),
        F.struct(F.expr("substring(kmer, 1, length(kmer) - 1)").alias("c"), F.lit("R").alias("side"), F.expr("substring(kmer, -1)").alias("base")),
    )
    rows = kmers.where("length(kmer) >= 3").select(F.length("kmer").alias("k"), F.explode(halves).alias("h")).select("k", "h.*")
    flip = ~S.is_canonical(F.col("c"))
    side = F.when(flip, F.when(F.col("side") == "L", F.lit("R")).otherwise(F.lit("L"))).otherwise(F.col("side"))
    base = F.when(flip, S.complement(F.col("base"))).otherwise(F.col("base"))
    rows = rows.select("k", S.canonical(F.col("c")).alias("core"), side.alias("side"), base.alias("base")).where(F.col("core") != S.reverse_complement(F.col("core")))
    sets = (F.collect_set(F.when(F.col("side") == s, F.col("base"))) for s in "LR")
    return rows.groupBy("k", "core").agg(*(c.alias(n) for c, n in zip(sets, ("lefts", "rights"), strict=True)))


def paths(table: DataFrame, rounds: int = 64) -> DataFrame:
    """(k, seq, n, head, tail): the contigs of a table of cores, each on both strands, for any letters and length.

    Nodes are cores with exactly one base on each side, as read on either strand. Each has at most one successor:
    the core one base on, if that is a node, points back and isn't the same core. Pointer doubling gives every node
    its path's first node and its distance from it in about log2(longest path) joins, whatever the path's length;
    each round is checkpointed. Cycles never reach a first node and are left out. head, tail: the first and last core.
    """
    good = table.where("size(lefts) = 1 and size(rights) = 1").select("k", "core", F.col("lefts")[0].alias("l"), F.col("rights")[0].alias("r"))
    rc, comp = S.reverse_complement, S.complement
    both = F.array(
        F.struct(F.col("core").alias("o"), F.col("l").alias("l"), F.col("r").alias("r")), F.struct(rc(F.col("core")).alias("o"), comp(F.col("r")).alias("l"), comp(F.col("l")).alias("r"))
    )
    nodes = cut(good.select("k", F.explode(both).alias("n")).select("k", "n.o", "n.l", "n.r"))
    before = F.concat("l", F.expr("substring(o, 1, length(o) - 1)"))
    wanted = nodes.select("k", "o", "l", before.alias("p"))
    other = nodes.select("k", F.col("o").alias("p"), F.col("r").alias("p_right"))
    linked = wanted.join(other, ["k", "p"], "left").withColumn("ok", F.col("p_right").isNotNull() & (F.col("p_right") == F.expr("substring(o, -1)")) & (S.canonical(F.col("p")) != S.canonical(F.col("o"))))
    state = cut(linked.select("k", "o", F.when(F.col("ok"), F.col("p")).otherwise(F.col("o")).alias("to"), F.when(F.col("ok"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("d"), (~F.coalesce("ok", F.lit(False))).alias("ended")))
    open_before = None
    for _ in range(rounds):
        still = state.where("not ended").count()
        if not still or still == open_before:
            break
        open_before = still
        ahead = state.select("k", F.col("o").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("ended").alias("ended2"))
        moving = state.where("not ended").select("k", "o", "to", "d").join(ahead, ["k", "to"]).select("k", "o", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.col("ended2").alias("ended"))
        state = cut(state.where("ended").unionByName(moving))
    placed = state.where("ended").join(nodes, ["k", "o"])
    whole = placed.groupBy("k", F.col("to").alias("head")).agg(F.max(F.when(F.col("d") == 0, F.col("l"))).alias("first"), F.array_sort(F.collect_list(F.struct("d", "r", "o"))).alias("s"))
    seq = F.concat("first", "head", F.array_join(F.col("s.r"), ""))
    return whole.select("k", seq.alias("seq"), F.size("s").alias("n"), "head", F.element_at("s", -1)["o"].alias("tail"))


def contigs(kmers: DataFrame, least: int | None = None) -> DataFrame:
    """(k, seq, n, ambiguous_ends): contigs of at least `least` bases (k + 1 if none), each on its smaller strand.

    A contig is two or more overlapping k-mers of which no inner (k-1)-mer has a second continuation. ambiguous_ends:
    at how many ends a core with more than one continuation follows; 9 for a contig of one core between two.
    K-mers of up to 31 letters go as numbers, up to FEW lengths of them; others, and other letters, as text.
    """
    size = F.length("kmer")
    ks = [r[0] for r in kmers.where(size.between(3, C.LONGEST)).select(size).distinct().limit(FEW + 1).collect()]
    ks = sorted(ks) if len(ks) <= FEW else []
    out = _by_text(kmers.where(~size.isin(ks)) if ks else kmers, least)
    for k in ks:
        out = out.unionByName(contigs_of(kmers.where(size == k), k, "kmer", least))
    return out


def contigs_of(seqs: DataFrame, k: int, seq: str = "seq", least: int | None = None) -> DataFrame:
    """`contigs` of all k-mers of sequences, which may repeat."""
    found = compact.paths(seqs.select(seq), k)
    if found is None:
        return _by_text(explode_kmers(seqs, k, [], seq).select("kmer").distinct(), least)
    size, both = F.length("seq"), F.col("amb_left").cast("int") + F.col("amb_right").cast("int")
    amb = F.when((size == k + 1) & (both == 2), F.lit(9)).otherwise(both)
    kept = found.where(size >= (k + 1 if least is None else least))
    return kept.select(F.lit(k).alias("k"), S.canonical(F.col("seq")).alias("seq"), (size - k).alias("n"), amb.alias("ambiguous_ends"))


def _by_text(kmers: DataFrame, least: int | None = None) -> DataFrame:
    """`contigs` of any letters and lengths."""
    table = cut(cores(kmers))
    found = paths(table)
    hard = table.where("size(lefts) > 1 or size(rights) > 1").select("k", "core")
    size = F.length("seq")
    ends = found.withColumn("a", S.canonical(F.expr("substring(seq, 1, k - 1)"))).withColumn("b", S.canonical(F.expr("substring(seq, length(seq) - k + 2)")))
    marked = ends.join(hard.select("k", F.col("core").alias("a"), F.lit(1).alias("x")), ["k", "a"], "left").join(hard.select("k", F.col("core").alias("b"), F.lit(1).alias("y")), ["k", "b"], "left")
    both = F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))
    amb = F.when((F.col("n") == 1) & (both == 2), F.lit(9)).otherwise(both)
    kept = marked.where(size >= (F.col("k") + 1 if least is None else F.lit(least)))
    return kept.select("k", S.canonical(F.col("seq")).alias("seq"), "n", amb.alias("ambiguous_ends")).distinct()


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in sorted order, without sorting everything in one task: rows are numbered in their
    sorted partition and partitions get offsets (one row per partition is broadcast)."""
    from pyspark.sql import Window

    laid = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    sizes = laid.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    starts = sizes.select("__part", "__first", (F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__start"))
    return laid.join(F.broadcast(starts), "__part").withColumn(name, F.col("__id") - F.col("__first") + F.col("__start") + 1).drop("__part", "__id", "__first", "__start", "__n")


def contig_fasta(found: DataFrame, prefix: str = "contig") -> DataFrame:
    """FASTA lines with stable numbers: `>prefix_N length`, and `_AMB_n` where an end is next to an ambiguity."""
    rows = numbered(found, ["k", "seq"], "no")
    amb = F.when(F.col("ambiguous_ends") > 0, F.concat(F.lit("_AMB_"), F.col("ambiguous_ends").cast("string"))).otherwise(F.lit(""))
    return rows.select("no", F.concat(F.lit(f">{prefix}_"), F.col("no").cast("string"), amb, F.lit(" "), F.length("seq").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


def seed_extensions(seeds: DataFrame, kmers: DataFrame, ks: list[int], purged: bool = False, seed_id: str = "seed_id", seq: str = "seq", reads: str | None = None) -> DataFrame:
    """(seed_id, k, left_ext, right_ext): what contigs add to each seed's ends, the longest per k.

    Unless `purged`, cores from inside any seed are taken out first, so that paths end at seeds. An end whose core
    another seed's end has too is not extended. `kmers` has k-mers of any lengths or, with `reads`, sequences in the
    column of that name, of which all k-mers count.
    """
    out = None
    spark: SparkSession = seeds.sparkSession
    for k in ks:
        long = seeds.where(F.length(seq) >= k)
        found = _seed_paths(long, kmers, k, purged, seed_id, seq, reads)
        ends = F.array(
            F.struct(F.lit("L").alias("side"), F.expr(f"substring({seq}, 1, {k})").alias("mer"), S.canonical(F.expr(f"substring({seq}, 1, {k - 1})")).alias("core")),
            F.struct(F.lit("R").alias("side"), F.expr(f"substring({seq}, -{k})").alias("mer"), S.canonical(F.expr(f"substring({seq}, -{k - 1})")).alias("core")),
        )
        index = long.select(seed_id, F.explode(ends).alias("e")).select(seed_id, "e.*")
        once = index.groupBy("core").agg(F.count("*").alias("n")).where("n = 1").select("core")
        index = index.join(once, "core").drop("core")
        right = index.where("side = 'R'").join(found.withColumn("mer", F.expr(f"substring(path, 1, {k})")), "mer").select(seed_id, F.lit("R").alias("side"), F.expr(f"substring(path, {k + 1})").alias("ext"))
        left = index.where("side = 'L'").join(found.withColumn("mer", F.expr(f"substring(path, -{k})")), "mer").select(seed_id, F.lit("L").alias("side"), F.expr(f"substring(path, 1, length(path) - {k})").alias("ext"))
        best = best_per_group(right.unionByName(left).where("length(ext) > 0"), [seed_id, "side"], [F.length("ext").desc(), F.col("ext")])
        per = best.groupBy(seed_id).agg(*(F.max(F.when(F.col("side") == s, F.col("ext"))).alias(f"{n}_ext") for s, n in (("L", "left"), ("R", "right")))).withColumn("k", F.lit(k))
        out = per if out is None else out.unionByName(per)
    return out if out is not None else spark.createDataFrame([], f"{seed_id} string, left_ext string, right_ext string, k int")


def _seed_paths(long: DataFrame, kmers: DataFrame, k: int, purged: bool, seed_id: str, seq: str, reads: str | None) -> DataFrame:
    """(path): the paths of length k on both strands, without the cores inside the seeds, which have k letters at least."""
    source = kmers.select(reads) if reads else kmers.where(F.length("kmer") == k).select("kmer")
    inside = None
    if not purged:  # a seed's inner k-mers are those of its letters but the first and the last
        body = long.where(F.length(seq) >= k + 2).select(F.explode(F.split(F.expr(f"substring({seq}, 2, length({seq}) - 2)"), "[^ACGT]")).alias("seq"))
        inside = body.where(F.length("seq") >= k - 1)
    found = compact.paths(source, k, inside)
    if found is not None:
        return found.select(F.explode(F.array("seq", S.reverse_complement(F.col("seq")))).alias("path"))
    table = cores(explode_kmers(kmers, k, [], reads).select("kmer").distinct() if reads else source)
    if not purged:
        inner = explode_kmers(long.select(seed_id, F.length(seq).alias("len"), seq), k, [seed_id, "len"], seq).where(f"pos > 0 and pos < len - {k}")
        table = table.join(cores(inner.select("kmer")).select("k", "core"), ["k", "core"], "left_anti")
    return paths(cut(table)).select(F.col("seq").alias("path"))


def extended_seeds(seeds: DataFrame, extensions: DataFrame, seed_id: str = "seed_id", seq: str = "seq") -> DataFrame:
    """(seed_id, left_k, right_k, seq): every seed with its longest extension on each side over all k. Of equally
    long ones the larger k, but the smallest k where the text is the same too. k is 0 for no extension."""
    sides = F.array(F.struct(F.lit("left").alias("side"), F.col("left_ext").alias("ext")), F.struct(F.lit("right").alias("side"), F.col("right_ext").alias("ext")))
    each = extensions.select(seed_id, "k", F.explode(sides).alias("e")).select(seed_id, "k", "e.*").where("ext is not null")
    each = each.groupBy(seed_id, "side", "ext").agg(F.min("k").alias("k"))
    best = best_per_group(each, [seed_id, "side"], [F.length("ext").desc(), F.col("k").desc(), F.col("ext")])
    per = best.groupBy(seed_id).agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("left", "right") for c in ("ext", "k")))
    joined = seeds.join(per, seed_id, "left")
    whole = F.concat(F.coalesce("left_ext", F.lit("")), F.col(seq), F.coalesce("right_ext", F.lit("")))
    return joined.select(seed_id, F.coalesce("left_k", F.lit(0)).alias("left_k"), F.coalesce("right_k", F.lit(0)).alias("right_k"), whole.alias("seq"))
