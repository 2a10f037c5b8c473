"""Clusters judged in a row each, against the operators by column."""

import random

import pytest

from strandframe.operators import clusters as K
from tests.conftest import rows
from tests.test_sequences import msa


def by_column(table, how):
    """The variants of every pair of accepted clusters with their identities, by joins over columns of the alignment."""
    seqs = K.sized(K.assign_samples(table, how.samples), how)
    intra = {r[0] for r in K.variants(K.differences(K.masked(seqs, how.indel, how.distance), True)).select("cluster_no").collect()}
    merged = K.merge_samples(seqs)
    after = K.masked(merged, how.indel, how.distance).cache()
    diffs = K.differences(after, False)
    out = {r[0]: r[1] for r in merged.groupBy("cluster_no").count().collect()}
    fits = sorted(c for c in out if out[c] <= how.most_out and (c not in intra or how.most_intra > 0))
    good = {tuple(r)[:3] for r in K.pair_identities(diffs, after).collect() if r["identity"] > how.identity}
    found = [tuple(r) for r in K.variants(diffs).select("cluster_no", "id1", "id2", "pos", "base1", "base2").collect()]
    return sorted((fits.index(c) + 1, a, b, pos + 1, x, y) for c, a, b, pos, x, y in found if c in fits and (c, a, b) in good)


@pytest.mark.parametrize("how", [K.ClusterOptions(("a", "b")), K.ClusterOptions(("a", "b"), most_out=4, most_intra=1000, identity=0.3, indel=2, distance=1)])
def test_as_by_column(spark, how):
    random.seed(9)
    data = []
    for c in range(60):
        base = "".join(random.choice("ACGT") for _ in range(30))
        for name in ("a1", "b1", "a2", "b2")[: random.choice([1, 2, 2, 3, 4])]:
            x = list(base)
            for _ in range(random.randint(0, 2)):
                x[random.randrange(30)] = random.choice("ACGT-")
            if random.random() < 0.3:
                i = random.randrange(26)
                x[i : i + random.randint(1, 3)] = ""
                x = (x[:i] + ["-"] * (30 - len(x)) + x[i:]) if random.random() < 0.6 else (["-"] * (30 - len(x)) + x)
            data.append((3 * c, name, "".join(x)))
    random.shuffle(data)
    found = K.call_clusters(msa(spark, data), how)
    expected = by_column(msa(spark, data), how)
    assert sorted(tuple(r) for r in found.select("cluster_id", "id1", "id2", "pos", "base1", "base2").collect()) == expected and expected


def test_one_shuffle_of_the_sequences(spark):
    table = msa(spark, [(1, "a1", "ACGT" * 10), (1, "b1", "ACGA" + "ACGT" * 9)])
    found = K.call_clusters(table, K.ClusterOptions(("a", "b")))
    assert rows(found.select("pos", "base1", "base2")) == [(4, "T", "A")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan  # no row for each letter
    with pytest.raises(Exception, match="several lengths"):
        K.call_clusters(msa(spark, [(1, "a1", "ACG"), (1, "b1", "ACGA")]), K.ClusterOptions(("a", "b"))).collect()
