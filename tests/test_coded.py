"""Windows as numbers: the same rows as joins give, and no join of windows in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import frequency, genotype, kmers, match
from strandframe.sources import readers
from tests.conftest import rows


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


@pytest.fixture(scope="module")
def seqs(spark):
    random.seed(5)
    made = [(i, "".join(random.choice("ACGT") for _ in range(random.randint(0, 60)))) for i in range(200)] + [(200, None), (201, "ACGTNACGTAC"), (202, "acgtacgta"), (3, "A" * 30)]
    return spark.createDataFrame(made, "seq_id long, seq string").cache()


@pytest.fixture(scope="module")
def samples(spark):
    random.seed(6)
    made = [("abc"[i % 3], "".join(random.choice("ACGT") for _ in range(5)), random.randint(0, 9)) for i in range(900)]
    return spark.createDataFrame([*made, ("a", "ACGTN", 5), ("d", "NNNNN", 4), ("a", "ACG", 3)], "sample string, kmer string, freq int").cache()


def test_f2_coverage_without_a_join(spark, seqs, samples):
    few = seqs.where("seq rlike '^[ACGT]*$' and seq_id <> 3")
    assert not joins(frequency.coverage(few, samples, 5))
    one = seqs.groupBy("seq_id").agg(F.min("seq").alias("seq"))
    assert rows(frequency.coverage(seqs, samples, 5)) == rows(frequency._joined(one, samples, 5, "seq_id", "seq"))


def test_f3_wide_coverage_in_one_shuffle(spark, seqs, samples):
    long = frequency.coverage(seqs, samples, 5)
    wide = frequency.coverage_wide(long, ["a", "d"])
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange") == long._jdf.queryExecution().executedPlan().toString().count("Exchange") + 1
    by = {(r["seq_id"], r["sample"]): r for r in long.collect()}
    for r in wide.collect():
        assert r["a_median_freq"] == by[r["seq_id"], "a"]["median_freq"] and r["d_num_kmers"] == 0


@pytest.mark.parametrize("weight", [None, "w"])
def test_counts_like_a_group_by(spark, seqs, weight):
    df = seqs.withColumns({"w": (F.col("seq_id") % 5).cast("int"), "by": F.col("seq_id") % 3})
    slow = kmers.explode_kmers(df, 5, ["by", "w"]).where("kmer rlike '^[ACGTacgt]*$'").groupBy("by", "kmer").agg((F.sum("w") if weight else F.count("*")).cast("int").alias("freq"))
    assert rows(kmers.count_kmers(df, 5, ["by"], weight=weight)) == rows(slow)


def counts(spark, seqs):
    """Reads with a mate, a set with repeats, other letters and another length."""
    reads = seqs.where("seq_id <> 3").select(F.col("seq_id").alias("read_id"), "seq", F.reverse("seq").alias("seq2"))
    return reads, spark.createDataFrame([(5, x) for x in ("AACCG", "ACGTA", "AACCG", "ACGTN", "CATCA", "acgta")] + [(4, "AACC")], "k long, kmer string")


@pytest.mark.parametrize(
    "invert, least, share, mate", [(False, 1, 0.0, None), (True, 1, 0.0, None), (False, 2, 0.06, None), (False, 2, 0.0, "seq2")], ids=["f5_kmatch", "f7_kmatch_invert", "f8_kmatch_share", "f14_kmatch_paired"]
)
def test_matching_without_a_join(spark, seqs, invert, least, share, mate):
    reads, wanted = counts(spark, seqs)
    how = match.MatchOptions(5, least, share, invert)
    found = match.match_reads(reads, wanted, how, mate=mate)
    assert rows(found) == rows(match._joined(reads, wanted, how, "read_id", "seq", ["seq"] + ([mate] if mate else []))) and 0 < found.count() < reads.count()
    assert not joins(match.match_reads(reads.where("seq rlike '^[ACGT]*$'"), wanted, how, mate=mate))


def test_f6_match_counts_without_a_join(spark, seqs):
    reads, wanted = counts(spark, seqs)
    assert rows(match.match_counts(reads, wanted, 5)) == rows(match._counts(reads, wanted.distinct(), 5, "read_id", "seq"))
    assert not joins(match.match_counts(reads.where("seq rlike '^[ACGT]*$'"), wanted, 5))


def test_f12_seed_calls_without_a_join(spark, seqs, samples):
    seeds = spark.createDataFrame([("a", "ACGTACGTA"), ("b", "CCAN"), ("n", "ACGTNACGTA"), ("o", "ANGTAACGTA"), ("s", "ACGT"), ("t", "AC"), ("u", ""), ("l", "ACGTAACCGTTTTGACA")], "seed_id string, seq string")
    assert rows(genotype.seed_calls(seeds, samples, 5)) == rows(genotype._joined_seeds(seeds, samples, 5, "seed_id", "seq"))
    assert not joins(genotype.seed_calls(seeds.where("seed_id not in ('b', 'o')"), samples, 5))


def snps(spark):
    random.seed(8)
    made = []
    for i in range(120):
        s = "".join(random.choice("ACGT") for _ in range(random.randint(1, 14)))
        at = random.randrange(len(s))
        made.append((i // 3, i, s, s[:at] + random.choice("ACGT-") + s[at + 1 :], at))
    return spark.createDataFrame([*made, (99, 0, "ACGTNACGT", "ACGTAACGT", 4)], "cluster_id long, line int, seq1 string, seq2 string, pos0 int").dropDuplicates(["cluster_id", "pos0"]).cache()


def test_f9_calls_without_a_join(spark, samples):
    table, how = snps(spark), genotype.CallOptions(5)
    assert rows(genotype.call_snps(table, samples, how)) == rows(genotype._judged(genotype._joined_snps(table, samples, how), how))
    assert not joins(genotype.call_snps(table.where("cluster_id <> 99"), samples, how))


def test_f13_distances_read_the_calls_once(spark):
    calls = [(1, 1, "a", "A", None), (1, 1, "b", "A", "C"), (1, 2, "a", "G", None), (1, 2, "b", "G", None), (2, 1, "a", "T", None), (2, 1, "c", None, None)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "cluster_id long, pos0 int, sample string, allele1 string, allele2 string"
    found = rows(genotype.distances(spark.createDataFrame(calls, kind).mapInArrow(count, kind)))
    assert seen.value == len(calls)
    assert (("a", "b", 2, 0.5) in found) and (("c", "a", 0, None) in found) and (("b", "b", 0, 0.0) in found) and len(found) == 9


def test_f4_clusters_are_read_in_splits(spark, tmp_path):
    text = "".join(f">*a{i}\nAC{'GT' * (i % 9)}\n\n--\n>b{i}\nTT\n>consensus\nAC\n" for i in range(500))
    (tmp_path / "x").write_text(text)
    (tmp_path / "y").write_text("lost\n>q\nAA\n" + text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        table = readers.read_clusters(spark, str(tmp_path))
        assert table.rdd.getNumPartitions() > 5
        found = rows(table)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    made = [r for i in range(500) for r in ((i + 1, f"a{i}", f"AC{'GT' * (i % 9)}--"), (i + 1, f"b{i}", "TT"))]
    assert sorted(found) == sorted([*made, *made, (0, "q", "AA")])
