"""Two runs of orders, far apart, that share a core by chance: paths end there, also where the queries' SQL goes on."""

import hashlib

import pytest

from strandframe.plans import registry
from tests.conftest import rows
from tests.test_sequences import rc, walk

CORE, RUNS = "ACCGGCGAACAATGCGTTGTTTTC", (47891, 54589)
KEYS = [8 * run + i for run in RUNS for i in range(8)]


def dna(key):
    return hashlib.md5(str(key).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4))


def run_of(run):
    return "".join(dna(8 * run + i) for i in range(8)) + dna(-8 * run - 8)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey long").write.parquet(f"{folder}/orders.parquet")
    return folder


def test_contigs_end_at_a_core_with_two_continuations(spark, orders):
    whole = [run_of(run) for run in RUNS]
    assert CORE in whole[0] and rc(CORE) in whole[1]
    found = [r[0] for r in rows(registry.queries()["contigs"](spark, orders))]
    assert sorted(found) == sorted(walk({t[i : i + 25] for t in whole for i in range(len(t) - 24)}, 25))
    assert len(found) == 4 and all(s.startswith(CORE) or s.endswith(CORE) or s.startswith(rc(CORE)) or s.endswith(rc(CORE)) for s in found)


def test_seeds_grow_up_to_a_core_with_two_continuations(spark, orders):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"create view orders as select * from '{orders}/orders.parquet/*.parquet'")
    sql = {r[0]: r for r in duck.execute(registry.oracle_sql()["seed_extension"]).fetchall()}
    found = {r[0]: r for r in rows(registry.queries()["seed_extension"](spark, orders).select("seed_id", "left_k", "right_k", "seq"))}
    assert {k for k in KEYS if found[k] != sql[k]} == {383132, 383133, 436718, 436719} and len(found) == len(KEYS)
    for left, right, core in ((383132, 383133, CORE), (436718, 436719, rc(CORE))):
        assert found[left] == (left, 25, 25, sql[left][3][: sql[left][3].index(core) + 24])
        assert found[right] == (right, 25, 25, sql[right][3][sql[right][3].index(core) :])
