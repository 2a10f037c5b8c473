import random
import re

import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators import assembly, clusters, demultiplex, domains, expression, frequency, genotype, kmers, match, orf, pileup
from tests.conftest import rows

RC = str.maketrans("ACGTacgt", "TGCAtgca")


def rc(s):
    return s.translate(RC)[::-1]


def canon(s):
    return min(s, rc(s))


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_scalar_functions(spark):
    s = F.col("s")
    assert one(spark, S.canonical(s), s="TTGCA") == "TGCAA"
    assert one(spark, S.reverse_complement(s), s="AC-N") == "N-GT"
    assert one(spark, S.translate(s), s="ATGAAATAGCC") == "MK*"
    assert one(spark, S.translate(s), s="ATGNAA") == "MX"
    assert one(spark, S.translate(s), s="AT") == ""
    assert one(spark, S.translate(s, {"ATG": "M"}), s="ATGAAA") == "MX"
    assert one(spark, S.kmers(s, 4), s="ACG") == []
    assert one(spark, S.kmers(s, 3), s="ACGT") == ["ACG", "CGT"]
    assert one(spark, S.unpadded_position(s, F.lit(4)), s="A--CGT") == 2
    assert one(spark, S.iupac(F.split(s, "")), s="GA") == "R"
    assert one(spark, S.iupac_bases(s), s="B") == ["C", "G", "T"]
    assert one(spark, S.is_canonical(s), s="ACGT") is True
    assert one(spark, S.round_half_up(F.lit(2.345), 1), s="") == 2.3


def test_frequencies_by_hand(spark):
    seqs = spark.createDataFrame([("s", "ACGTACGT"), ("short", "AC")], "seq_id string, seq string")
    samples = spark.createDataFrame([("a", "ACGT", 6), ("a", "CGTA", 2), ("b", "TTTT", 1)], "sample string, kmer string, freq int")
    found = rows(frequency.coverage(seqs, samples, 4))
    assert found == [("s", "a", 4.0, 4, 4 / 3), ("s", "b", 0.0, 0, 0.0), ("short", "a", 0.0, 0, 0.0), ("short", "b", 0.0, 0, 0.0)]
    with pytest.raises(ValueError):
        frequency.coverage(seqs, samples, 2)


def test_match_keeps_short_reads_when_inverted(spark):
    reads = spark.createDataFrame([(1, "ACGTAC", None), (2, "AC", None), (3, "TTTTTT", "ACGTAA"), (4, "NNNNNN", None)], "read_id int, seq string, seq2 string")
    wanted = kmers.reference_set(spark.createDataFrame([("ACGTA 5",)], "seq string"))
    how = match.MatchOptions(5)
    assert [r[0] for r in rows(match.match_reads(reads, wanted, how, mate="seq2"))] == [1, 3]
    assert [r[0] for r in rows(match.match_reads(reads, wanted, match.MatchOptions(5, invert=True), mate="seq2"))] == [2, 4]
    assert [r[0] for r in rows(match.match_reads(reads, wanted, match.MatchOptions(5, 0, 0.4), mate="seq2"))] == [1]
    with pytest.raises(ValueError):
        match.MatchOptions(1)


def test_ids(spark):
    lines = spark.createDataFrame([("@r1/2\tACGT",), ("@r2 x\tAC",), ("@r3\tAC",)], "line string")
    ids = match.clean_ids(spark.createDataFrame([("@r1/1",), ("r2",)], "value string"))
    assert len(rows(match.match_ids(lines, ids))) == 2
    assert rows(match.match_ids(lines, ids, True)) == [("@r3\tAC",)]


def walk(kmer_set, k):
    """Contigs by walking each unambiguous path, base by base."""
    sides = {}
    for m in kmer_set:
        for x in {m, rc(m)}:
            sides.setdefault(x[1:], [set(), set()])[0].add(x[0])
            sides.setdefault(x[:-1], [set(), set()])[1].add(x[-1])
    good = {c for c, (a, b) in sides.items() if len(a) == len(b) == 1 and c != rc(c)}

    def after(c):
        n = c[1:] + next(iter(sides[c][1]))
        ok = n in good and next(iter(sides[n][0])) == c[0] and n != c and n != rc(c)
        return n if ok else None

    out, has_before = set(), {after(c) for c in good}
    for c in good - has_before:
        text, at = next(iter(sides[c][0])) + c, c
        while at:
            text += next(iter(sides[at][1]))
            at = after(at)
        out.add(canon(text))
    return out


def test_contigs_by_hand(spark):
    table = spark.createDataFrame([("AAC",), ("ACT",), ("CTG",)], "kmer string")
    assert [r[1] for r in rows(assembly.contigs(table))] == [canon("AACTG")]
    assert rows(assembly.contigs(spark.createDataFrame([("AAC",)], "kmer string"))) == []


@pytest.mark.parametrize("k", [6, 7])
def test_contigs_like_a_walk(spark, k):
    random.seed(k)
    text = ["".join(random.choice("ACGT") for _ in range(60)) for _ in range(6)]
    text.append(text[0][20:40] + text[1][10:40])
    text.append("ACGGTTCA" * 4)  # a cycle
    mers = {canon(t[i : i + k]) for t in text for i in range(len(t) - k + 1)}
    found = [r[1] for r in rows(assembly.contigs(spark.createDataFrame([(random.choice([m, rc(m)]),) for m in mers], "kmer string")))]
    assert set(found) == walk(mers, k) and len(found) == len(set(found))
    inside = [canon(c[i : i + k]) for c in found for i in range(len(c) - k + 1)]
    assert set(inside) <= mers and len(inside) == len(set(inside))


def test_seeds_of_several_k(spark):
    random.seed(3)
    text = "".join(random.choice("ACGT") for _ in range(120))
    mers = {canon(text[i : i + k]) for k in (15, 17) for i in range(len(text) - k + 1)}
    seeds = spark.createDataFrame([("s", text[40:80]), ("none", "A" * 30)], "seed_id string, seq string")
    ext = assembly.seed_extensions(seeds, spark.createDataFrame([(m,) for m in mers], "kmer string"), assembly.resolve_ks(None, 15, 17))
    assert rows(assembly.extended_seeds(seeds, ext)) == [("none", 0, 0, "A" * 30), ("s", 15, 15, text)]
    with pytest.raises(ValueError):
        assembly.resolve_ks(None, 9, 7)


def test_contig_numbers_and_header(spark):
    found = spark.createDataFrame([(3, "AACTG", 2, 1), (3, "ACCCC", 2, 0)], "k int, seq string, n int, ambiguous_ends int")
    assert [r[1] for r in rows(assembly.contig_fasta(found))] == [">contig_1_AMB_1 5\nAACTG", ">contig_2 5\nACCCC"]


def test_pileup_by_hand(spark):
    table = spark.createDataFrame([("A\t1\tA\t5\t..TT.\tIIIII",), ("A\t2\tA\t5\t..,T$^I.\tIIIII",), ("A\t3\tA\t2\t.+2AC,\tII",), ("A\t4\tC\t3\t,-11ACGTACGTACG.^].\tIII",), ("A\t5\tA\t0",)], "value string")
    done = pileup.call(pileup.base_counts(pileup.parse_pileup(table)))
    assert rows(done.select("pos", "n_a", "n_c", "n_g", "n_t", "n_ins", "n_del", "call")) == [(1, 3, 0, 0, 2, 0, 0, "W"), (2, 4, 0, 0, 1, 0, 0, "?"), (3, 2, 0, 0, 0, 1, 0, "?"), (4, 0, 3, 0, 0, 0, 1, "?")]


def test_pileup_against_a_plain_parser(spark):
    random.seed(2)

    def make():
        parts = [random.choice([".", ",", "A", "c", "G", "t", "N", "*", "$", "^" + random.choice("I+-.,A5"), "+3acg", "-1T", "+12ACGTACGTACGT"]) for _ in range(random.randint(0, 12))]
        return "".join(parts)

    def count(text, ref):
        n, i = dict.fromkeys("ACGT+-", 0), 0
        while i < len(text):
            c = text[i]
            if c == "^":
                i += 1
            elif c in "+-":
                size = re.match(r"\d+", text[i + 1 :])[0]
                n[c] += 1
                i += len(size) + int(size)
            elif c in ".,":
                n[ref] += 1
            elif c.upper() in "ACGT":
                n[c.upper()] += 1
            i += 1
        return tuple(n[x] for x in "ACGT+-")

    texts = [make() for _ in range(200)]
    df = spark.createDataFrame([(i, t, "G") for i, t in enumerate(texts)], "i int, bases string, ref_base string")
    found = {r[0]: tuple(r)[1:] for r in pileup.base_counts(df).select("i", "n_a", "n_c", "n_g", "n_t", "n_ins", "n_del").collect()}
    assert found == {i: count(t, "G") for i, t in enumerate(texts)}


def test_consensus_and_report(spark):
    df = spark.createDataFrame([("r", 1, "A", 0, 1, "."), ("r", 1, "A", 1, 1, "AC"), ("r", 1, "A", 2, 4, "AC"), ("r", 1, "A", 3, 0, "*")], "ref string, pos int, ref_base string, sample_idx int, depth int, bases string")
    assert [r[-1] for r in sorted(map(tuple, pileup.consensus_call(df).collect()), key=lambda r: r[3])] == ["A", "?", "", "."]
    calls = pileup.call(pileup.base_counts(spark.createDataFrame([("r", 1, "A", 0, 3, "..."), ("r", 1, "A", 1, 3, "TTT")], "ref string, pos int, ref_base string, sample_idx int, depth int, bases string")))
    lines = [r[2] for r in rows(pileup.report_lines(calls, pileup.loci(calls)))]
    assert lines == ["CALLS\tr\t1\tA\tA\tT", "COUNTS\tr\t1\tA\t3,0,0,0,0,0\t0,0,0,3,0,0"]


def plain_orfs(seq, least, open_too=False):
    out = []
    for sign, s in ((1, seq), (-1, rc(seq))):
        for f in range(3):
            start = None
            for i in range(f, len(s) - 2, 3):
                c = s[i : i + 3]
                if c == "ATG" and start is None:
                    start = i
                if c in ("TAA", "TAG", "TGA"):
                    if start is not None:
                        out.append((start, i + 3, sign * (f + 1), True))
                    start = None
            if start is not None and open_too:
                out.append((start, len(s), sign * (f + 1), False))
    fix = lambda a, b, fr: (a + 1, b) if fr > 0 else (len(seq) - b + 1, len(seq) - a)
    return sorted((*fix(a, b, fr), fr, st) for a, b, fr, st in out if b - a >= least)


def test_orfs(spark):
    seqs = spark.createDataFrame([("a", "CCATGAAATAGCC")], "seq_id string, seq string")
    found = orf.find_orfs(seqs, 9)
    assert rows(found) == [("a", 3, 11, 3, True)]
    assert [r[-2:] for r in rows(orf.orf_sequences(found, seqs))] == [("a:3-11 frame=3", "MK*")]
    random.seed(4)
    texts = {i: "".join(random.choice("ATGA") for _ in range(random.randint(0, 150))) for i in range(30)}
    df = spark.createDataFrame([(i, t.lower() if i % 2 else t) for i, t in texts.items()], "seq_id int, seq string")
    mine = {}
    for r in orf.find_orfs(df, 9, without_stop=True).collect():
        mine.setdefault(r[0], []).append(tuple(r)[1:])
    assert {i: sorted(v) for i, v in mine.items()} == {i: p for i, t in texts.items() if (p := plain_orfs(t, 9, True))}


def test_domain_groups(spark):
    hits = spark.createDataFrame([("t", "+", 1, 100), ("t", "+", 50, 60), ("t", "+", 270, 300)], "target string, strand string, start int, end int")
    groups = domains.group_summary(domains.group_hits(hits))
    assert rows(groups) == [("t", "+", 0, 1, 100, 2), ("t", "+", 1, 270, 300, 1)]
    seqs = spark.createDataFrame([("t", "CC" + "ATG" + "AAA" * 60 + "TAA" + "C" * 400)], "target string, seq string")
    # the range around the hit holds the start but not the stop: it is extended until it does
    hits = spark.createDataFrame([("t", "+", 3, 60)], "target string, strand string, start int, end int")
    grouped = domains.group_hits(hits)
    found = domains.orfs_of_groups(domains.group_summary(grouped), grouped, seqs, gap=20)
    assert rows(found.select("start", "end", "frame", "has_stop", "hits")) == [(3, 188, 3, True, 1)]
    once = domains.orfs_of_groups(domains.group_summary(grouped), grouped, seqs, gap=20, extend=False)
    assert rows(once.select("start", "end", "has_stop")) == [(3, 70, False)]
    lines = rows(domains.gff3(domains.group_summary(grouped), found, grouped).select("level", "value"))
    assert lines[1][1].split("\t")[2:5] == ["ORF", "3", "188"]


def test_hit_coordinates(spark):
    hits = spark.createDataFrame([("x_1000", 100, 1, 10, "frame=2"), ("x_1000", 100, 1, 10, "fr4"), ("y", 100, 2, 3, "frame=1")], "target string, target_len int, ali_from int, ali_to int, description string")
    found = [(r["target"], r["strand"], r["frame"], r["start"], r["end"]) for r in domains.hit_coordinates(hits).collect()]
    assert found == [("x_1000", "+", 2, 1002, 1031), ("x_1000", "-", -1, 1271, 1300), ("y", "+", 1, 4, 9)]


def test_expression(spark):
    exons = spark.createDataFrame([("a", 1, 1000), ("a", 500, 700), ("b", 1, 1500), ("b", 1400, 2000)], "gene string, start int, end int")
    reads = spark.createDataFrame([("a", "s", 10), ("b", "s", 10), ("zz", "s", 5)], "gene string, sample string, reads int")
    lengths = expression.gene_lengths(exons)
    assert rows(lengths) == [("a", 1000), ("b", 2000)]
    found = {r[0]: r[3] for r in rows(expression.tpm(lengths, reads))}
    assert found["a"] == pytest.approx(666666.6667) and sum(found.values()) == pytest.approx(1e6)
    bounded = expression.gene_lengths(exons, spark.createDataFrame([("a", 101, 200), ("b", 1, 5000)], "gene string, start int, end int"))
    assert rows(bounded) == [("a", 100), ("b", 2000)]


def test_snp_cascade(spark):
    def stays(valid):
        snps = spark.createDataFrame([(i, "c", i) for i in range(len(valid))], "line int, cluster_id string, pos0 int")
        calls = spark.createDataFrame([("c", i, "A", "C") for i, v in enumerate(valid) if not v], "cluster_id string, pos0 int, allele1 string, allele2 string")
        return sorted(r["pos0"] for r in genotype.false_positives(snps, calls).collect())

    def plain(valid):
        v = list(valid)
        for i in range(1, len(v)):
            if v[i] != v[i - 1]:
                v[i] = v[i - 1] = False
        return [i for i, x in enumerate(v) if x]

    for n in range(8):
        valid = [bool(n >> i & 1) for i in range(3)]
        assert stays(valid) == plain(valid)


def test_calls_and_indel_site(spark):
    snps = spark.createDataFrame([("c", 5, "p1", "ACGTTA-CCGGA", "p2", "ACGTTC-CCGGA")], "cluster_id string, pos0 int, id1 string, seq1 string, id2 string, seq2 string")
    genotype.check_parents(snps)
    both = [canon("ACGTTACCGGA"[i : i + 4]) for i in range(8)], [canon("ACGTTCCCGGA"[i : i + 4]) for i in range(8)]
    data = [("het", m, 5) for m in {*both[0], *both[1]}] + [("one", m, 4) for m in both[0]] + [("low", m, 1) for m in both[0]]
    calls = genotype.call_snps(snps, spark.createDataFrame(data, "sample string, kmer string, freq int"), genotype.CallOptions(4))
    got = {r["sample"]: (r["allele1"], r["allele2"]) for r in calls.collect()}
    assert got == {"het": ("A", "C"), "one": ("A", None), "low": (None, None)}
    fasta = [r[0] for r in rows(genotype.parent_fasta(snps))]
    assert fasta == [">p1 c:6\nACGTTACCGGA", ">p2 c:6\nACGTTCCCGGA"]
    same = snps.withColumn("seq2", F.col("seq1"))
    with pytest.raises(ValueError):
        genotype.check_parents(same)
    text = genotype.nexus(genotype.distances(calls).collect())
    assert "ntax=3" in text and "'het' " in text


def test_demultiplexing(spark):
    barcodes = spark.createDataFrame([("f", "ACGT", "short"), ("f", "ACGTAA", "long")], "flowcell string, barcode string, sample string")
    demultiplex.check_barcodes(barcodes)
    schema = "id string, seq string, qual string, id2 string, seq2 string, qual2 string"
    read = lambda n, s, s2=None: (f"@m:1:f:{n}", s, "I" * len(s), None if s2 is None else f"@m:1:f:{n}/2", s2, None if s2 is None else "I" * len(s2))
    data = [read(1, "ACGTAATGCAGTT"), read(2, "ACGTTGCAGTTCCGAGATCGGAATT"), read(3, "ACGTTGCAAAA"), read(4, "GGGG"), ("@x:1:q:5", "ACGT", "IIII", None, None, None), read(6, "ACGTTGCAGAA", "TTGGCTGCAACGTCC"), read(7, "ACGTTGCAGAA", "TTGG")]
    out = demultiplex.demultiplex(spark.createDataFrame(data, schema), barcodes)
    got = sorted((r["status"], str(r["sample"]), str(r["seq"]), str(r["kind"])) for r in out.collect())
    assert ("kept", "long", "TGCAGTT", "SE") in got and ("kept", "short", "TGCAGTTCCG", "SE") in got
    assert ("no_remnant", "short", "None", "None") in got and ("no_barcode", "None", "None", "None") in got and ("no_flowcell", "None", "None", "None") in got
    assert ("kept", "short", "TTGGCTGCA", "PE") in got and ("kept", "short", "TTGG", "PE") in got
    assert dict(map(tuple, demultiplex.sample_counts(out).collect())) == {"short": 5, "long": 1}
    with pytest.raises(ValueError):
        demultiplex.check_barcodes(barcodes.union(barcodes))


def msa(spark, data):
    return spark.createDataFrame(data, "cluster_no int, seq_id string, aln string")


def test_masks_and_merging(spark):
    rows_ = clusters.assign_samples(msa(spark, [(1, "a1", "--ACGT-ACGTAC--GTACGT-"), (1, "b1", "ACACGTTACGTACGTGTACGTA")]), ("a", "b"))
    m = {(r["seq_id"], r["pos"]): (r["masked"], r["padding"]) for r in clusters.masked(rows_, 1, 3).collect()}
    assert m["a1", 0] == (True, 2) and m["a1", 6] == (False, 2) and m["a1", 13] == (True, 2) and m["b1", 6] == (False, 0)
    two = clusters.assign_samples(msa(spark, [(1, "a_x", "--ACGTAC"), (1, "a_y", "ACACGT--"), (1, "b_z", "ACACGTAC"), (2, "a_x", "ACGA"), (2, "a_y", "ACGT")]), ("a", "b"))
    got = {(r["cluster_no"], r["seq_id"]): (r["aln"], r["merged"]) for r in clusters.merge_samples(two).collect()}
    assert got[1, "a_x_y"] == ("ACACGTAC", True) and got[1, "b_z"][1] is False and (2, "a_x") in got and (2, "a_y") in got
    with pytest.raises(ValueError):
        clusters.assign_samples(msa(spark, [(1, "c1", "AC")]), ("a", "b"))


def test_cluster_table(spark):
    base = "ACGTACGTTACGGATCCATTGACCGTAGCA" * 2
    other = base[:10] + "G" + base[11:30] + "-" + base[31:]
    found = clusters.call_clusters(msa(spark, [(4, "a1", base), (4, "b1", other), (9, "a1", base), (9, "a2", other), (9, "b1", base)]), clusters.ClusterOptions(("a", "b")))
    got = [(r["cluster_id"], r["id1"], r["id2"], r["pos"], r["base1"], r["base2"], r["comments"]) for r in found.collect()]
    assert sorted(got) == [(1, "a1", "b1", 11, base[10], "G", "N/A"), (1, "a1", "b1", 31, base[30], "-", "N/A")]
