"""Licence scans on texts that nothing was trained on, wrapped texts, and against their SQL."""

import textwrap

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandframe.llm import licenses, queries

FULL = {
    "mit": licenses.TEMPLATES["mit"][4],
    "apache": licenses.TEMPLATES["apache"][4],
    "bsd": licenses.TEMPLATES["bsd"][-1],
    "agpl": licenses.TEMPLATES["agpl"][2],
}
# families that no training or calibration text is of
STRANGE = (
    "Eclipse Public License - v 2.0",
    "ISC License",
    "Licensed under the EUPL, Version 1.2 only (the Licence); You may not use this work except in compliance with the Licence.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
)


def scan(spark, texts):
    docs = spark.createDataFrame(list(texts), "doc_id long, text string")
    return sorted((r.asDict() for r in licenses.licenses(docs).collect()), key=lambda r: (str(r["doc_id"]), r["paragraph"]))


@pytest.mark.parametrize("prefix", ["", "# ", "   * "])
def test_wrapped_notices_are_found_whole(spark, prefix):
    texts = [(i, "A first line of prose stands here.\n\n" + "\n".join(prefix + x for x in textwrap.wrap(t, 75)) + "\n\nAnd an end.") for i, t in enumerate(FULL.values())]
    got = scan(spark, texts)
    assert [(r["doc_id"], r["family"], r["confirmed"]) for r in got] == [(i, k, True) for i, k in enumerate(FULL)]
    assert all(r["similarity"] > 0.95 for r in got)


def test_families_that_were_left_out_are_unknown(spark):
    got = scan(spark, enumerate(STRANGE))
    assert [(r["doc_id"], r["family"], r["confirmed"]) for r in got] == [(i, "unknown", False) for i in range(len(STRANGE))]


def brute(body, model, how=licenses.Scan()):
    place = {g: k for k, g in enumerate(model.vocabulary)}
    z = model.weights[[place[g] for g in licenses.grams(body) if g in place]].sum(axis=0) + model.bias
    return licenses.softmax(z[None])[0]


def test_texts_without_a_word_of_the_cover_are_no_licences():
    model, random = licenses.train(), np.random.default_rng(1)
    words = sorted({w for g in model.vocabulary for w in g.split()} - set(model.cover))
    assert len(words) > 50
    for size in (1, 5, 30, 200):
        for _ in range(50):
            assert brute(" ".join(random.choice(words, size)), model)[0] >= 0.5
    # also with every gram that speaks against `none` as far as it can without the cover
    bare = [k for k, g in enumerate(model.vocabulary) if not set(g.split()) & set(model.cover)]
    assert (model.weights[bare].max(axis=1) <= model.weights[bare, 0]).all()


def test_wordings_that_were_not_trained_on():
    model = licenses.train()
    right = [model.classes[int(np.argmax(brute(t, model)))] == k for k, t in licenses.HELD]
    assert np.mean(right) > 0.9


def compare(spark, docs, frame):
    con = duckdb.connect()
    con.register("documents", frame)
    expected = con.sql(queries.oracle_sql()["op5_licenses"]).df()
    columns = ["doc_id", "paragraph", "family", "probability", "template", "similarity", "confirmed"]
    plain = lambda rows: sorted(tuple(None if pd.isna(v) else round(float(v), 8) if isinstance(v, float) else v for v in row) for row in rows)
    got = plain(tuple(r) for r in licenses.licenses(docs).select(*columns).fillna(-1, ["doc_id"]).collect())
    want = plain(expected[columns].fillna({"doc_id": -1}).astype({"doc_id": "int64"}).itertuples(index=False))
    assert got == want
    return got


def test_licences_like_their_sql(spark):
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts] + [*licenses.UNKNOWN, *licenses.PLAIN, *STRANGE, *(t for _, t in licenses.HELD)]
    texts = [(i, f"intro words\n{t}\r\n\n" + "\n".join(textwrap.wrap(t, 60)) + " \t\nend éİ MIT K") for i, t in enumerate(notices)]
    texts += [(0, texts[0][1]), (0, texts[5][1]), (None, texts[3][1]), (None, texts[3][1]), (900, None), (901, ""), (902, "\n\n \n"), (903, "under the terms " * 20_000 + "of the MIT License")]
    frame = pd.DataFrame(texts, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    assert len(compare(spark, spark.createDataFrame(texts, "doc_id long, text string"), frame)) > 150


def test_licences_like_their_sql_on_the_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = compare(spark, spark.read.parquet(path), pd.read_parquet(path, columns=["doc_id", "text"]))
    # unknown ones are notices like "All rights reserved.", which no template can confirm
    assert got and all(row[-1] == (row[2] != licenses.UNSURE) for row in got)
