"""The pipeline's stages, each against brute force on what it was given."""

import collections

import corpus_pipeline as cp
from strandframe.llm import decontam, mixing

DATA = "/root/testdata/sf0.001"


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given, seen = docs, {}
    for name, stage in cp.STAGES:
        out = stage(spark, given, DATA)
        assert out.columns == cp.COLUMNS
        out.write.parquet(str(tmp_path / name))
        seen[name] = (given, spark.read.parquet(str(tmp_path / name)))
        given = seen[name][1]
    before, after = seen["exact dedup"]
    first = {}
    for r in before.orderBy("doc_id").collect():
        first.setdefault(" ".join(r["text"].split(" ")) if r["text"] else "", r["doc_id"])
    assert len(ids(after)) <= len(first) and set(ids(after)) <= set(first.values())
    before, after = seen["near dedup"]
    texts = {r["doc_id"]: r["text"].encode().lower().split() for r in before.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    kept = sorted(ids(after))
    near = [(a, b) for n, a in enumerate(kept) for b in kept[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    gone = set(texts) - set(kept)
    assert not near and all(any(len(sets[g] & sets[k]) >= 0.5 * len(sets[g] | sets[k]) for k in texts if k != g) for g in gone)
    before, after = seen["decontamination"]
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    index = decontam.Items(bench, decontam.Tiling())
    assert set(ids(after)) == {r["doc_id"] for r in before.collect() if not index.find(r["text"])}
    before, after = seen["mixing"]
    assert ids(after) == collections.Counter({r["doc_id"]: r["copies"] for r in mixing.plan(before).collect() if r["copies"]})
    before, after = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    dropped = set(ids(before)) - set(ids(after))
    assert sum(labels.get(i) == 0 for i in dropped) <= 1


def test_run_and_shape(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"] and cp.ORACLE_SQL is None
    out = cp.run(spark, DATA)
    assert out.columns == cp.COLUMNS and out.count() > 0
