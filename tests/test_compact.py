"""Paths in numbers, joined over buckets, against walks and the text version."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import assembly, compact
from tests.conftest import rows
from tests.test_sequences import canon, walk


def texts(k):
    random.seed(k)
    made = ["".join(random.choice("ACGT") for _ in range(90)) for _ in range(8)]
    return [*made, made[0][20:40] + made[1][10:40], "ACGGTTCA" * 4, "A" * (k + 5), "AC" * k, made[2][: k - 1], "", "ACGTTGCAACGT" * 3]


@pytest.mark.parametrize("k, together", [(7, 2), (8, 300_000), (31, 3)])
def test_contigs_of_sequences_like_a_walk(spark, monkeypatch, k, together):
    monkeypatch.setattr(compact, "TOGETHER", together)
    data = texts(k)
    found = [r[1] for r in rows(assembly.contigs_of(spark.createDataFrame([*((t,) for t in data), (None,), (data[0],)], "seq string"), k))]
    assert set(found) == walk({t[i : i + k] for t in data for i in range(len(t) - k + 1)}, k) and len(found) == len(set(found))


def test_ends_as_in_the_text_version(spark):
    seqs = spark.createDataFrame([(t,) for t in texts(7)], "seq string")
    mers = seqs.select(F.explode(F.expr("transform(sequence(1, greatest(length(seq) - 6, 1)), i -> substring(seq, i, 7))")).alias("kmer")).where("length(kmer) = 7")
    assert rows(assembly.contigs_of(seqs, 7)) == rows(assembly._by_text(mers))


def test_other_letters_go_as_text(spark):
    seqs = spark.createDataFrame([("ACGNTTACCA",), ("TTACCAG",)], "seq string")
    assert compact.paths(seqs, 4) is None
    assert any("N" in r[1] for r in rows(assembly.contigs_of(seqs, 4)))


def test_seeds_on_reads_as_in_the_text_version(spark, monkeypatch):
    random.seed(5)
    text = "".join(random.choice("ACGT") for _ in range(160))
    reads = spark.createDataFrame([(text[i : i + 40],) for i in range(0, 130, 20)], "seq string")
    seeds = spark.createDataFrame([("a", text[40:60]), ("n", text[90:98] + "N" + text[99:112]), ("other", "A" * 20)], "seed_id string, seq string")
    found = rows(assembly.extended_seeds(seeds, assembly.seed_extensions(seeds, reads, [9], reads="seq")))
    assert found[0][3].startswith(text[:60])
    monkeypatch.setattr(compact, "paths", lambda *_: None)
    assert found == rows(assembly.extended_seeds(seeds, assembly.seed_extensions(seeds, reads, [9], reads="seq")))
