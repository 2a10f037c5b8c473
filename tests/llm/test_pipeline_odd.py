"""Every stage of the pipeline on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import collections

import pytest

import corpus_pipeline as cp
from tests.llm.test_operators import DATA, SCHEMA, documents

LONG = " ".join(f"long{i % 9000}" for i in range(40_000))
ONE, TWO = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta"))
ROWS = [
    (8, "x y z", "a"), (8, "x  y z", "b"), (8, "x y z", "a"), (None, "x y z", "c"), (None, "q r", "d"), (None, "q r", "d"), (5, None, "e"), (6, "", None), (7, " ", None),
    (1, LONG, "a"), (2, LONG + " end", "a"), (3, ONE, "a"), (4, ONE + " more", "b"), (9, TWO, "b"), (9, TWO, "b"),
]


def kept(stage, spark, rows=ROWS):
    out = stage(spark, documents(spark, rows), DATA)
    assert out.columns == cp.COLUMNS
    return sorted(((r["doc_id"] or 0, r["text"], r["source"]) for r in out.collect()), key=str)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    got = kept(cp.drop_copies, spark)
    # null and empty texts are one text, a blank is another; the smallest id stays
    assert sorted(i for i, *_ in got) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert {i: " ".join((t or "").split()) for i, t, _ in got} == {0: "q r", 1: LONG, 2: LONG + " end", 3: ONE, 4: ONE + " more", 5: "", 7: "", 8: "x y z", 9: TWO}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    got = collections.Counter(i for i, *_ in kept(cp.drop_near_copies, spark))
    # 8: of three rows with one text one stays; 2 and 4 are near copies of 1 and 3; empty texts and rows without an id stay
    assert got == {0: 3, 1: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}


def test_decontamination_judges_each_row(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first()["text"]
    rows = [*ROWS, (20, f"before {item} after", "a"), (20, "clean", "a"), (None, item, "a")]
    assert kept(cp.drop_contaminated, spark, rows) == sorted([(i or 0, t, s) for i, t, s in [*ROWS, (20, "clean", "a")]], key=str)


def test_toxicity_judges_each_row(spark):
    got = collections.Counter(kept(cp.drop_toxic, spark))
    assert all(n <= ROWS.count((i or None, t, s)) for (i, t, s), n in got.items()) and len(got) > 3
    assert {(5, None, "e"), (6, "", None), (7, " ", None)} <= set(got)


def test_mixing_gives_whole_rows(spark):
    got = collections.Counter(kept(cp.mix_sources, spark))
    assert {(i or None, t, s) for i, t, s in got} <= {(i, t, s) for i, t, s in ROWS} and not any(not (t or "").strip() for _, t, _ in got)
    assert all(n <= 2 * ROWS.count((i or None, t, s)) for (i, t, s), n in got.items())
    assert got == collections.Counter(kept(cp.mix_sources, spark))


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_empty_tables(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), DATA)
    assert out.columns == cp.COLUMNS and out.count() == 0
