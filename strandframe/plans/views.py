"""Sequence views over the driver's tables, the same in Spark and in SQL.

`dna(x)` is 32 letters: the MD5 of the number as text, its hex digits read as bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, LETTERS = "0123456789abcdef", "ACGT" * 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(x: Column) -> Column:
    return F.translate(F.md5(x.cast("string").cast("binary")), HEX, LETTERS)


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(read_id, seq) of every order: neighbours share 32 bases, up to 8 reads of 64 bases make a run of 288. The last read
    of a run ends in letters of its own, so that the next one starts anew."""
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(key.alias("read_id"), F.concat(dna(key), dna(F.when(key % 8 == 7, -key - 1).otherwise(key + 1))).alias("seq"))


def part_sequences(spark: SparkSession, d: str) -> DataFrame:
    """(seq) of every part; orders of the same number share its letters."""
    return table(spark, d, "part").select(dna(F.col("p_partkey")).alias("seq"))


def sample_sequences(spark: SparkSession, d: str) -> DataFrame:
    """(sample, seq, weight): the order's letters in the sample of each line number."""
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("sample"), dna(F.col("l_orderkey")).alias("seq"), F.col("l_quantity").cast("long").alias("weight"))


def paired_reads(spark: SparkSession, d: str) -> DataFrame:
    from strandframe.functions.sequence import reverse_complement

    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(key.alias("read_id"), dna(key).alias("seq"), reverse_complement(dna(key + 1)).alias("seq2"))


def depths(spark: SparkSession, d: str) -> DataFrame:
    """(ref, pos, sample, depth)."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ref"), F.col("l_partkey").alias("pos"), F.col("l_linenumber").alias("sample"))
    return rows.agg(F.sum("l_quantity").cast("int").alias("depth"))


def base_counts(spark: SparkSession, d: str) -> DataFrame:
    """depths with counts of bases by order key; the reference base is A."""
    part = lambda i: F.sum(F.when(F.col("l_orderkey") % 4 == i, F.col("l_quantity")).otherwise(0)).cast("int")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ref"), F.col("l_partkey").alias("pos"), F.col("l_linenumber").alias("sample_idx"))
    made = rows.agg(F.sum("l_quantity").cast("int").alias("depth"), *(part(i).alias(n) for i, n in enumerate(("n_a", "n_c", "n_g", "n_t"))))
    return made.withColumns({"n_ins": F.lit(0), "n_del": F.lit(0), "ref_base": F.lit("A")})


#: Pieces of pileup base strings by order key modulo 7, with what they add to A (the reference), C, G, T, + and -.
PIECES = ((".", "A"), (",", "A"), ("T", "T"), ("g$", "G"), ("^I.", "A"), (".+2AC", "A+"), (",-12ACGTACGTACGT", "A-"))


def pileup(spark: SparkSession, d: str) -> DataFrame:
    """(ref, pos, ref_base, sample_idx, depth, bases, quals) with base strings of several kinds."""
    piece = F.element_at(F.array(*(F.lit(p) for p, _ in PIECES)), (F.col("l_orderkey") % 7 + 1).cast("int"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ref"), F.col("l_linenumber").alias("sample_idx"))
    made = rows.agg(F.count("*").cast("int").alias("depth"), F.array_join(F.array_sort(F.collect_list(piece)), "").alias("bases"))
    return made.select(F.col("ref").cast("string").alias("ref"), F.lit(1).alias("pos"), F.lit("A").alias("ref_base"), "sample_idx", "depth", "bases", F.lit("").alias("quals"))


def exons(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_partkey") * 10
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("gene"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")).distinct()


def hits(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_partkey") * 100 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_linestatus").alias("strand"), start.alias("start"), (start + 3 * F.col("l_quantity").cast("long")).alias("end")).distinct()


def snps(spark: SparkSession, d: str) -> DataFrame:
    """(line, cluster_id, pos0, id1, seq1, id2, seq2): pairs that differ in one base; three neighbours share a cluster."""
    key, at = F.col("o_orderkey"), F.col("o_custkey") % 32
    s = dna(key)
    other = F.concat(F.substr(s, F.lit(1), at.cast("int")), F.substr(F.lit("ACGT"), (key % 4 + 1).cast("int"), F.lit(1)), F.substr(s, (at + 2).cast("int")))
    rows = table(spark, d, "orders").select(
        key.alias("line"), F.floor(key / 3).alias("cluster_id"), at.cast("int").alias("pos0"), F.concat(F.lit("a"), key.cast("string")).alias("id1"), s.alias("seq1"), F.concat(F.lit("b"), key.cast("string")).alias("id2"), other.alias("seq2")
    )
    return rows.where("seq1 <> seq2")


def long_sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


# -- the same in SQL --------------------------------------------------------------------------------


def q_dna(x: str) -> str:
    return f"translate(md5(cast({x} as varchar)), '{HEX}', '{LETTERS}')"


def q_rc(s: str) -> str:
    return f"translate(reverse({s}), 'ACGTacgt', 'TGCAtgca')"


def q_canonical(s: str) -> str:
    return f"least({s}, {q_rc(s)})"


def q_windows(source: str, keep: str, seq: str, k: int) -> str:
    """Canonical windows of `seq` with 0-based pos and the kept columns."""
    raw = f"select *, unnest(range(1, length({seq}) - {k} + 2)) as i from {source} where length({seq}) >= {k}"
    cut = f"substr({seq}, i, {k})"
    return f"(select {keep}{', ' if keep else ''}i - 1 as pos, {cut} as seen, {q_canonical(cut)} as kmer from ({raw}))"


Q_READS = f"(select o_orderkey as read_id, {q_dna('o_orderkey')} || {q_dna('case when o_orderkey % 8 = 7 then -o_orderkey - 1 else o_orderkey + 1 end')} as seq from orders)"
Q_PARTS = f"(select {q_dna('p_partkey')} as seq from part)"
Q_SAMPLE_SEQS = f"(select l_linenumber as sample, {q_dna('l_orderkey')} as seq, cast(l_quantity as bigint) as weight from lineitem)"
Q_SNPS = f"""(select o_orderkey as line, o_orderkey // 3 as cluster_id, o_custkey % 32 as pos0, s as seq1,
  substr(s, 1, o_custkey % 32) || substr('ACGT', o_orderkey % 4 + 1, 1) || substr(s, o_custkey % 32 + 2) as seq2
  from (select *, {q_dna('o_orderkey')} as s from orders) where substr(s, o_custkey % 32 + 1, 1) <> substr('ACGT', o_orderkey % 4 + 1, 1))"""
Q_LONG = "(select doc_id as seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as seq from documents)"
Q_DEPTHS = "(select l_suppkey as ref, l_partkey as pos, l_linenumber as sample, cast(sum(l_quantity) as int) as depth from lineitem group by all)"
