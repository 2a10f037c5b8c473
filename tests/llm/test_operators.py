"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandframe.llm import common, decontam, exact_dedup, graph, language_model, licenses, mixing, quality, queries, simhash, toxicity, url_filters, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, size long, code long, row long"


def documents(spark, texts):
    """texts: (id, text, source) rows; further columns have the names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 1, "k", 2, 3, 4, 5) for i, t, s in texts], SCHEMA).repartition(3)


def by_id(df, *columns):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in columns))
    return out


def prose(rng, n, words=400):
    return " ".join(f"w{rng.integers(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, blanks, a very long text, ties, repeated rows."""
    long = "lorem ipsum dolor " * 60_000
    return documents(spark, [(1, "a  b", "s1"), (2, "a b", None), (3, None, "s1"), (4, "", "s2"), (5, " ", "s2"), (6, long, "s2"), (7, long, "s3"), (None, "a b", None), (8, "x", "s1"), (8, "x", "s1"), (9, "été ünïcode", "s9")])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1 ----------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/x?q", "https://www.example.com/en/1#top", "http://x.net/es/", "ftp://net/fr/a", "http://example.com", "http://example.com?x=/en/", "com/", None, "", "http://xcom/a", "http://spam-farm.org/", "http://a.b.spam-farm.io", "http://org/casino", "http://org/mycasino", "http://user@x.com/ü", "://com/", "http://NET/ES/"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = "".join(c.lower() if c.isascii() else c for c in re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r in url_filters.PLACES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith("/" + p))(*r.text.split("/", 1))]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert got[i][:3] == (host, path, best.text if best else None)
        if best:
            assert got[i][3] == best.action
    assert [got[i][3] for i in (10, 11, 12, 13)] == ["block", "block", "block", "allow"]
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_url_index_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    words = ["ads", "en", "img", "track", "shop", "a1", "zz"]
    urls = [f"http://{'.'.join(rng.choices(words, k=2))}.com/{'/'.join(rng.choices(words, k=rng.randint(0, 3)))}" for _ in range(300)]
    make = lambda: rng.choice(["||", "|http://", ""]) + "".join(rng.choice([*words, "^", "*", "/", "."]) for _ in range(rng.randint(1, 4)))
    rules = [url_filters.Rule(t, rng.choice(["allow", "block"]), "pattern") for t in {make() for _ in range(60)}]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    monkeypatch.setattr(url_filters, "BLOCK_RULES", 7)
    got = {r["page_id"]: r["pattern"] for r in url_filters.judge_urls(pages, places=[], patterns=rules).collect()}
    for i, u in enumerate(urls):
        fits = [r for r in rules if re.compile(r.regex()).match(u)]
        assert got[i] == max(((len(r.text), r.action == "block", r.text) for r in fits), default=(0, 0, None))[2]


# -- 2 ----------------------------------------------------------------------------------------------


def copies(texts):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, _ in texts:
        groups[norm(t)].append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}, norm


def test_exact_groups(spark):
    rng = np.random.default_rng(2)
    texts = [(i, rng.choice(["hot copy", "b\tb", "b b ", "b b", None, "", f"own {i}"], p=[0.4, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]), None) for i in range(600)]
    texts = [(i, None if t is None else str(t), s) for i, t, s in texts]
    groups, norm = copies(texts)
    got = by_id(exact_dedup.exact_groups(documents(spark, texts)), "keep_id", "group_size", "kept", "text_sha256")
    for i, t, _ in texts:
        keep, n = groups[norm(t)]
        assert got[i] == [(keep, n, i == keep, hashlib.sha256(norm(t).encode()).hexdigest())]


def test_exact_groups_of_odd_rows(spark, odd):
    got = by_id(exact_dedup.exact_groups(odd), "keep_id", "group_size", "kept")
    assert got[1] == [(1, 3, True)] and got[2] == [(1, 3, False)] and got[None] == [(1, 3, False)]
    assert got[3] == [(3, 2, True)] and got[4] == [(3, 2, False)] and got[5] == [(5, 1, True)]
    assert got[7] == [(6, 2, False)] and sorted(got[8]) == [(8, 2, False), (8, 2, True)]
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_copies(odd).columns == odd.columns


def test_drop_copies_loses_nothing(spark, odd):
    """Of each distinct text exactly one row stays, whatever ids rows share or lack."""
    texts = [(8, "x y", "a"), (8, "x  y", "b"), (9, "z", "c"), (None, "q", "d"), (None, "q", "d"), (3, None, "e"), (2, "", "f"), (4, " ", "g"), (None, "x y", "h"), (4, "\t", "i")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_copies(documents(spark, texts)).collect())
    assert [g[0] for g in got] == [0, 2, 4, 8, 9] and {g[1].strip() for g in got if g[0] in (2, 4)} == {""}
    rows = [(i % 7 if i % 3 else None, f"t{i % 5}", str(i)) for i in range(200)]
    docs = documents(spark, rows)
    for parts in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = sorted((r["text"], r["doc_id"]) for r in exact_dedup.drop_copies(docs).collect())
            groups = by_id(exact_dedup.exact_groups(docs), "keep_id", "group_size", "kept")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == [(f"t{k}", min(i for i, t, _ in rows if t == f"t{k}" and i is not None)) for k in range(5)]
        assert sum(g[2] for x in groups.values() for g in x) == 5 and {g[1] for x in groups.values() for g in x} == {40}
    assert exact_dedup.drop_copies(empty(spark)).count() == 0
    assert exact_dedup.drop_copies(odd).count() == len({(r["text"] or "").replace("  ", " ") for r in odd.collect()})


# -- 3 ----------------------------------------------------------------------------------------------


def brute_code(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, radius):
    label = dict(enumerate(range(len(codes))))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def near_codes(rng, n, centres=6):
    """Codes around a few centres, and others."""
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    out = []
    for _ in range(n):
        c = int(rng.choice(base)) if rng.random() < 0.7 else int(rng.integers(0, 1 << 63, dtype=np.uint64))
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            c ^= 1 << int(b)
        out.append(c)
    return list(dict.fromkeys(out))


def test_gray_index_finds_all_links():
    rng = np.random.default_rng(3)
    codes = np.array(near_codes(rng, 400), np.uint64)
    index = simhash.GrayIndex(codes, 4)
    ranks = simhash.gray_rank(index.codes)
    assert (np.diff(ranks.astype(object)) > 0).all()
    q, place = index.links(codes, 3)
    got = {(int(codes[a]), int(index.codes[b])) for a, b in zip(q, place, strict=True)}
    assert got == {(int(a), int(b)) for a in codes for b in codes if (int(a) ^ int(b)).bit_count() <= 3}


@pytest.mark.parametrize("split", [20_000, 5])
def test_code_links_connect_what_brute_force_does(spark, split):
    codes = near_codes(np.random.default_rng(4), 300)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    how = simhash.SimHash(split=split)
    links = graph.components(simhash.code_links(spark.createDataFrame([(c,) for c in signed], "code long"), how)).collect()
    label = brute_components(codes, 3)
    mine = {r["node"]: r["root"] for r in links}
    groups = lambda f: {frozenset(i for i in range(len(codes)) if f(i) == g) for g in {f(i) for i in range(len(codes))}}
    assert groups(lambda i: mine.get(signed[i], signed[i])) == groups(label.get)


def test_simhash_groups(spark, odd):
    rng = np.random.default_rng(5)
    base = prose(rng, 300).split()
    texts = [(10, " ".join(base), None), (11, " ".join([*base[:299], "other"]), None), (12, " ".join(base).upper(), None), (13, prose(rng, 300), None), (14, None, None), (15, "  ", None), (16, "one two", None), (17, None, None)]
    got = by_id(simhash.simhash_groups(documents(spark, texts)), "fingerprint", "component_id")
    codes = [brute_code(t) for _, t, _ in texts]
    label = brute_components(codes, 3)
    for n, (i, _, _) in enumerate(texts):
        assert got[i] == [(f"{codes[n]:016x}", texts[label[n]][0])]
    got = by_id(simhash.simhash_groups(odd), "fingerprint", "component_id")
    assert len(got[8]) == 2 and got[None][0][1] == 1 and got[3] == got[4] == [("0" * 16, 3)]
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100), (7, 7), (500, None)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_similar_texts_recall(spark):
    """Links of at least 0.8 against brute force: recall over 0.95, and never a pair below."""
    rng = np.random.default_rng(6)
    texts = []
    for g in range(60):
        base = [f"word{x}" for x in rng.integers(0, 3000, int(rng.integers(60, 400)))]
        for rate in (0.002, 0.008, 0.02):
            w = [f"word{rng.integers(3000)}" if rng.random() < rate else x for x in base]
            texts.append((len(texts), " ".join(w), None))
    true = {(i, j) for j in range(len(texts)) for i in range(j) if i // 3 == j // 3 and jaccard(texts[i][1], texts[j][1]) >= 0.8}
    got = {(r["a"], r["b"]) for r in simhash.similar_links(documents(spark, texts)).collect()}
    assert got <= true and len(got) >= 0.95 * len(true) and len(true) > 30


def linked(spark, texts):
    links = simhash.similar_links(documents(spark, texts)).select("a", "b")
    return {r["node"]: r["root"] for r in graph.components(links).collect()}


def brute_linked(texts):
    label = {i: i for i, _, _ in texts}
    for (i, x, _), (j, y, _) in combinations(texts, 2):
        if label[i] != label[j] and jaccard(x, y) >= 0.8:
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    return {i: r for i, r in label.items() if list(label.values()).count(r) > 1}


def test_star_of_copies_is_linked_in_full(spark):
    """Copies that are near to an original, and hardly to each other; its id is in the middle of theirs."""
    rng = np.random.default_rng(8)
    base = [f"word{x}" for x in rng.integers(0, 3000, 300)]
    texts = []
    for i in range(120):
        w = list(base)
        for at in rng.choice(300, 6, replace=False) if i != 60 else ():
            w[at] = f"word{rng.integers(3000)}"
        texts.append((i, " ".join(w), None))
    true = brute_linked(texts)
    assert len(true) > 100 and sum(jaccard(x[1], y[1]) >= 0.8 for x, y in combinations(texts, 2)) < 0.05 * 120 * 119 / 2
    assert linked(spark, texts) == true


@pytest.mark.parametrize("kind", ["replaced", "cut", "appended"])
def test_links_by_kind_of_edit(spark, kind):
    """Pairs with a similarity of 0.8 to 0.9 after one kind of edit: all that brute force links, and no other."""
    rng, texts = np.random.default_rng(9), []
    for g in range(60):
        n, share = int(rng.integers(80, 600)), rng.uniform(0.11, 0.19)
        base = [f"word{x}" for x in rng.integers(0, 3000, n)]
        other = [f"word{x}" for x in rng.integers(0, 3000, n)]
        rate = 0.02
        edited = {"replaced": [o if rng.random() < rate else w for w, o in zip(base, other, strict=True)], "cut": base[: int(n * (1 - share))], "appended": base + other[: int(n * share)]}[kind]
        texts += [(2 * g, " ".join(base), None), (2 * g + 1, " ".join(edited), None)]
    true = {i: i - i % 2 for i, x, _ in texts if jaccard(x, texts[i ^ 1][1]) >= 0.8}
    assert len(true) > 40 and linked(spark, texts) == true


def test_drop_near_copies(spark, odd):
    base = [f"word{i}" for i in range(200)]
    texts = [(1, " ".join(base), None), (2, " ".join([*base[:-1], "new"]), None), (3, " ".join([f"other{i}" for i in range(200)]), None), (4, " ".join(base[:100] + [f"x{i}" for i in range(100)]), None), (None, " ".join(base), None)]
    assert sorted(r["doc_id"] or 0 for r in simhash.drop_near_copies(documents(spark, texts)).collect()) == [0, 1, 3, 4]
    assert simhash.drop_near_copies(empty(spark)).count() == 0
    assert simhash.drop_near_copies(odd).columns == odd.columns


def test_tree_finds_all_links():
    """Every pair within the radius is a link of the tree in one of its buckets, and no other pair is."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [int(1) << int(a) | int(1) << int(b) for a, b in rng.integers(0, 64, (1500, 2))]
    codes = np.unique(np.concatenate([np.array([int(base[i % 60]) ^ f for i, f in enumerate(flips)], np.uint64), base, rng.integers(0, 1 << 63, 3000, dtype=np.uint64)]))
    how, got = simhash.SimHash(), set()
    for same, top, of in simhash.routes(how):
        if of < 0:
            for index, start, q, place in simhash.chunk_links(codes, top, same, how):
                got |= {(a, b) for a, b in zip(index.order[q + start].tolist(), index.order[place].tolist(), strict=True) if a < b}
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3, 1))
    assert got == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) > 1000


@pytest.mark.parametrize(("n", "share", "seed"), [(300, 0.02, 1), (300, 0.03, 2), (600, 0.022, 3)])
def test_large_groups(spark, n, share, seed):
    """Groups of hundreds of copies, each changed on its own: the components of all pairs by brute force."""
    rng = np.random.default_rng(seed)
    base, texts = prose(rng, 300).split(), []
    for i in range(n):
        words = [w if rng.random() >= share else f"x{rng.integers(10**6)}" for w in base]
        texts.append((i, " ".join(words), "s"))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t, _ in texts)]
    links = [(a, b) for b in range(n) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = np.arange(n)
    simhash._unite(label, *np.array(links).T)
    kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(documents(spark, texts)).collect())
    assert kept == np.flatnonzero(label == np.arange(n)).tolist() and len(links) > 30


def test_near_copies_of_odd_rows(spark):
    """Of near copies that share an id, too, one row stays, one with the smallest id; rows without an id stay."""
    rng = np.random.default_rng(11)
    one, two, three = (prose(rng, 100) for _ in range(3))
    texts = [(5, one, "a"), (5, one + " y", "b"), (5, two, "c"), (None, one + " z", "d"), (None, three, "e"), (None, three, "e"), (3, two + " t", "f"), (7, None, "g"), (7, None, "g"), (8, "", "h")]
    got = sorted((r["doc_id"] or 0, r["source"]) for r in simhash.drop_near_copies(documents(spark, texts)).collect())
    assert [g for g in got if g[1] not in "ab"] == [(0, "d"), (0, "e"), (0, "e"), (3, "f"), (7, "g"), (7, "g"), (8, "h")] and len([g for g in got if g[1] in "ab"]) == 1


def test_order_and_parts_lose_nothing(spark):
    """Buckets that go in many parts, and no bound on what a text is compared with at first, give the same groups."""
    rng = np.random.default_rng(12)
    texts = []
    for g in range(6):
        base = prose(rng, 80).split()
        texts += [(g * 20 + i, " ".join([*base[: 80 - rng.integers(0, 12)], *prose(rng, int(rng.integers(0, 8))).split()]), "s") for i in range(20)]
    plain = {r["doc_id"] for r in simhash.drop_near_copies(documents(spark, texts)).collect()}
    for how in (simhash.Similar(part=3), simhash.Similar(first=1, then=1, prints=1), simhash.Similar(first=1000)):
        assert {r["doc_id"] for r in simhash.drop_near_copies(documents(spark, texts), how).collect()} == plain


# -- 4 ----------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    trap = "x" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/" + "é" * 300
    html = {1: trap, 2: trap, 3: "short", 4: "short", 5: None, 6: "", 7: "y" * 1000, 8: "y" * 1000, 9: "y" * 1000, 10: "z" * 999, 11: "z" * 999, None: "y" * 1000}
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y" if i != 3 else None, h, "clash") for i, h in html.items()], "page_id long, url string, html string, sha1 string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(pages, str(tmp_path / "w")).collect()}
    assert len(got) == len(html)
    for i, h in html.items():
        data = (h or "").encode()
        same = [j for j, x in html.items() if (x or "") == (h or "") and j is not None]
        last = max(same) if len(data) >= 1000 else i
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), "response" if i == last else "revisit", None if i == last else last)
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(html)
    nested = warc.assemble(records).collect()
    assert all(r["n_requests"] == r["n_metadata"] == 1 and r["request"]["block"].startswith(b"GET ") for r in nested)
    whole = {r["response"]["block"].partition(b"\r\n\r\n")[2] for r in nested if r["response"]["type"] == "response"}
    assert trap.encode() in whole
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_warc_orphans_and_repeats(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a")], "page_id long, url string, html string")
    assert [tuple(r)[:2] for r in warc.round_trip(pages, str(tmp_path / "r")).collect()] == [(1, 1)] * 2
    records = warc.read_records(spark, str(tmp_path / "r")).where("type = 'request'")
    assert [r["response"] for r in warc.assemble(records).collect()] == [None] * 2


def test_warc_gives_a_row_for_each_row(spark):
    """Repeated rows, two urls of a page, two payloads of a page, rows without an id: as many rows as pages, by the query's own SQL."""
    import duckdb
    import pandas as pd

    long, other = "long " * 300, "other " * 300
    data = [(1, "u", long), (1, "v", long), (1, "u", long), (2, "u", long), (2, "w", long), (3, "u", other), (3, "u", "short"), (3, "u", "short"), (None, "u", other), (None, "u", other), (4, None, None), (4, None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    frame = pd.DataFrame(data, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", frame)
    sql = con.execute(queries.oracle_sql()["op4_warc"])
    names = [c[0] for c in sql.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in sql.fetchall()), key=str)
    whole = lambda rows: [r for r in rows if r[0] is not None]  # noqa: E731  the SQL says nothing of rows without an id
    assert whole(got) == whole(want) and len(got) == len(data)
    assert [r[3:] for r in got if r[0] is None] == [("revisit", 3)] * 2


# -- 5 ----------------------------------------------------------------------------------------------


def brute_licence(line, how=licenses.Scan()):
    model = licenses.train(how)
    place = {g: k for k, g in enumerate(model.vocabulary)}
    found = [place[g] for g in licenses.grams(line) if g in place]
    z = model.weights[found].sum(axis=0) + model.bias
    p = licenses.softmax(z[None])[0]
    if not found or p[0] >= 0.5:
        return None
    k = 2 + int(np.argmax(p[2:]))
    return (model.classes[k], p[k]) if p[k] >= how.sure else (licenses.UNSURE, 1 - p[0])


def test_licences_like_brute_force(spark, odd):
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts] + list(licenses.UNKNOWN) + list(licenses.PLAIN) + ["Ondor licensed under the mit license, thanea.", "", "...", "the the the", "Copyright 2020 Foo. All rights reserved.", "GPL"]
    texts = [(i, "intro words\n" + line + "\n\nend", None) for i, line in enumerate(lines)] + [(900, None, None), (901, "", None), (0, "intro words\n" + lines[0] + "\n\nend", None)]
    got = {(r["doc_id"], r["paragraph"]): (r["family"], r["probability"], r["confirmed"]) for r in licenses.licenses(documents(spark, texts)).collect()}
    for i, line in enumerate(lines):
        expected = brute_licence(line)
        assert (i, 0) not in got and ((i, 1) in got) == (expected is not None), line
        if expected:
            assert got[i, 1][0] == expected[0] and got[i, 1][1] == pytest.approx(expected[1])
    right = [got[i, 1][0] == k and got[i, 1][2] for i, k in enumerate(k for k, ts in licenses.TEMPLATES.items() for _ in ts)]
    assert np.mean(right) > 0.95
    assert licenses.licenses(empty(spark)).count() == 0 and licenses.licenses(odd).count() == 0


def test_licences_run_no_python(spark, odd):
    plan = licenses.licenses(odd)._jdf.queryExecution().executedPlan().toString() + mixing.plan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 6 ----------------------------------------------------------------------------------------------


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(8)
    k, symbols = 3, 7
    m = language_model.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k).T)
    texts = [rng.integers(0, symbols, n).astype(np.uint16) for n in (1, 63, 64, 65, 130, 2)]
    likelihood, (starts, moves, emissions) = m.run(texts, True)
    s2, m2, e2 = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
    for n, x in enumerate(texts):
        a, c = [], []
        for t, o in enumerate(x):
            v = (m.start if t == 0 else a[-1] @ m.move) * m.emit[o]
            c.append(v.sum())
            a.append(v / c[-1])
        b = [np.ones(k)]
        for t in range(len(x) - 1, 0, -1):
            b.insert(0, m.move @ (m.emit[x[t]] * b[0]) / c[t])
        assert likelihood[n] == pytest.approx(np.log(c).sum())
        for t, o in enumerate(x):
            g = a[t] * b[t] / (a[t] * b[t]).sum()
            e2[o] += g
            s2 += g * (t == 0)
            if t:
                xi = a[t - 1][:, None] * m.move * (m.emit[o] * b[t])
                m2 += xi / xi.sum()
    assert np.allclose(starts, s2) and np.allclose(moves, m2) and np.allclose(emissions, e2)


def test_lm_base_scores_and_gain(spark, odd):
    rng = np.random.default_rng(9)
    # two kinds of texts: what comes next depends on the kind, which one state can't tell
    texts = [(i, " ".join(f"{'ab'[i % 2]}{rng.integers(30)}" for _ in range(int(rng.integers(0, 80)))), None) for i in range(300)] + [(1000, None, None), (1001, "Unseen A0", None), (1001, "Unseen A0", None)]
    how = language_model.HiddenMarkov(states=2, rounds=6, own=20, classes=16, carried=40)
    got = by_id(language_model.lm_scores(documents(spark, texts), how), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(x for i, t, _ in texts if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t, _ in texts:
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))
        assert got[i][0][:4] == (held(i), len(tokens(t)), sum(x in c for x in tokens(t)), n) and got[i][0][4] == pytest.approx(base)
    assert len(got[1001]) == 2
    out = [r[0] for i, r in got.items() if r[0][0]]
    assert sum(r[5] for r in out) > sum(r[4] for r in out)
    assert len(by_id(language_model.lm_scores(odd, how), "score")[8]) == 2
    assert language_model.lm_scores(empty(spark), how).count() == 0


def test_lm_probabilities_add_up(spark):
    """All one-word texts, and one unknown word in each class, have probability one of being what follows."""
    texts = [(i, w, None) for i, w in enumerate(["a", "b", "a c", "d", "e a", "b b", "f", "g"])]
    how = language_model.HiddenMarkov(states=2, rounds=2, own=3, classes=4, carried=5)
    model_docs = documents(spark, texts)
    rows = model_docs.select("doc_id", "text").withColumn("held_out", F.lit(False))
    words = language_model.vocabulary(language_model.token_counts(rows), how)
    model = language_model.train(language_model.encode(rows, words), words)
    assert model.emit.sum(axis=0) == pytest.approx(1) and model.move.sum(axis=1) == pytest.approx(1)


# -- 7, 8 -------------------------------------------------------------------------------------------


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_by_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_quality_model_is_the_discriminant(spark):
    rng = np.random.default_rng(10)
    x = {0: rng.normal(0, 1, (200, 16)), 1: rng.normal(0.7, 2, (300, 16))}
    how = quality.Discriminant(pooled=0.2, ridge=0.1)
    model = quality.Model({k: (float(len(v)), v.sum(axis=0), v.T @ v) for k, v in x.items()}, how)
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    common = (cov[0] * 200 + cov[1] * 300) / 500
    common += (1e-6 + 1e-3 * np.trace(common) / 16) * np.eye(16)
    point, odds = rng.normal(0, 1, (5, 16)), 0
    for k, sign in ((1, 1), (0, -1)):
        s = 0.9 * (0.8 * cov[k] + 0.2 * common) + 0.1 * np.diag(np.diag(common))
        z = point - x[k].mean(axis=0)
        odds = odds + sign * (math.log(len(x[k]) / 500) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    assert model.score(point) == pytest.approx(1 / (1 + np.exp(-odds)))


def test_quality_and_toxicity_of_odd_rows(spark, odd):
    labels = labels_of(spark, [(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 0, 1), (4, None, None), (8, 0, 1), (9, 1, 0)])
    for op in (quality.quality_scores, toxicity.toxicity_scores):
        got = by_id(op(odd, labels), "held_out", "score", "predicted")
        assert len(got[8]) == 2 and len(got) == 10 and all(0 <= s <= 1 and p == int(s >= 0.5) for v in got.values() for _, s, p in v)
        assert op(odd, labels.limit(0)).count() == 11 and op(empty(spark), labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0}


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    for op, column, (folds, held) in ((quality.quality_scores, "quality", (3, 1)), (toxicity.toxicity_scores, "toxic", (5, 0))):
        flipped = labels.withColumn(column, F.when(quality.held_out(F.col("doc_id"), folds, held), 1 - F.col(column)).otherwise(F.col(column)))
        assert sorted(map(tuple, op(docs, labels).collect())) == sorted(map(tuple, op(docs, flipped).collect()))


def test_toxicity_by_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.96
    assert got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() > 0.8


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(11)
    y = (rng.random(4000) < 0.3).astype(int)
    vote = lambda hit, noise: (rng.random(4000) < np.where(y, hit, noise)).astype(float)
    noisy = vote(0.6, 0.3)
    votes = np.stack([vote(0.8, 0.02), noisy, noisy, noisy], axis=1)
    model = toxicity.LabelModel(votes, np.where(rng.random(4000) < 0.9, y, 1 - y), 0.9, 25)
    assert model.weight[0] > 0.8 and max(model.weight[1:]) < 0.5
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93


# -- 9 ----------------------------------------------------------------------------------------------


def greedy(doc, item, least):
    """Greedy string tiling as it is defined: in each round all longest free matches, marked in turn."""
    d, p, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least - 1, []
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not d[i + n] and not p[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not any(d[i : i + best]) and not any(p[j : j + best]):
                d[i : i + best] = p[j : j + best] = [True] * best
                tiles.append((best, i, j))


def test_tiling_like_its_definition():
    rng = random.Random(12)
    for _ in range(60):
        doc, item = [rng.choice("abcd") for _ in range(rng.randint(0, 40))], [rng.choice("abcd") for _ in range(rng.randint(3, 20))]
        how = decontam.Tiling(least=3, coverage=0.01)
        found = decontam.Items([(1, " ".join(item))], how).find(" ".join(doc))
        tiles = greedy(doc, item, 3)
        assert [(x[1], x[4]) for x in found] == ([(sum(t[0] for t in tiles), max(t[0] for t in tiles))] if tiles else [])


def test_contaminated(spark, odd):
    item = [f"Token{i}" for i in range(30)]
    rng = np.random.default_rng(13)
    inside = lambda x: prose(rng, 50) + " " + " ".join(x) + ". " + prose(rng, 50)
    texts = [(1, inside(item), None), (2, inside([x.upper() + "," for x in item[20:] + item[10:20] + item[:10]]), None), (3, inside(item[:12]), None), (4, prose(rng, 200), None), (5, None, None), (6, inside(item[::2]), None), (7, inside(item), None)]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in [(70, " ".join(item)), (71, None), (72, "a b"), (73, " ".join(item)), (74, "")]], "item_id long, text string, doc_id string")
    for block in (20_000, 2):
        got = decontam.contaminated(documents(spark, texts), bench, decontam.Tiling(block=block)).collect()
        assert sorted((r["doc_id"], r["item_id"], r["covered"], r["tiles"]) for r in got) == [(1, 70, 30, 1), (1, 73, 30, 1), (2, 70, 30, 3), (2, 73, 30, 3), (7, 70, 30, 1), (7, 73, 30, 1)]
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(documents(spark, texts), bench).collect()) == [3, 4, 5, 6]
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0 and decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(odd, bench).count() == 0


# -- 10 ---------------------------------------------------------------------------------------------


def water(sizes, how=mixing.Mix()):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: how.weights[i % len(how.weights)] for i, s in enumerate(names)}
    left, target, free = how.total * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if target[s] + share * weight[s] >= how.most * sizes[s]}
        for s in free:
            target[s] += share * weight[s]
        left = 0.0
        for s in over:
            left += target[s] - how.most * sizes[s]
            target[s] = how.most * sizes[s]
        free -= over
    return target


def test_mixing(spark, odd):
    rng = np.random.default_rng(14)
    sources = ["b", "a", "É", None, "", "zz"]
    texts = [(i, None if i % 50 == 0 else prose(rng, int(rng.integers(0, 60))), sources[int(rng.choice(6, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1]))]) for i in range(800)]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    sizes = collections.Counter()
    for _, t, s in texts:
        sizes[s] += len((t or "").split())
    target, taken = water(sizes), collections.Counter()
    for i, t, s in texts:
        r = got[i]
        assert r["size"] == len((t or "").split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) and r["copies"] <= 2
        taken[s] += r["size"] * r["copies"]
    assert all(abs(taken[s] - target[s]) < 0.25 * target[s] for s in sizes)
    made = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert made == collections.Counter({i: r["copies"] for i, r in got.items() if r["copies"]})
    assert sorted(map(tuple, mixing.plan(docs.repartition(5)).collect())) == sorted(map(tuple, got.values()))
    assert mixing.plan(odd).count() == 11 and mixing.plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).columns == docs.columns


def test_hot_keys_are_joined_without_a_gathering(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"), "id")
    table = common.cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    got = common.attach(rows, table, "key", "n", 20_000, broadcast_rows=10)
    assert got.count() == 20_000 and got.where("first is null").count() == 0 and got.where("key = 0 and first <> 0").count() == 0


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))
