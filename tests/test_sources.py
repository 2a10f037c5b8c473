import gzip

import pytest
from pyspark.sql import functions as F

from strandframe import cli
from strandframe.operators import demultiplex, domains, match, pileup
from strandframe.sources import readers as R
from strandframe.sources import writers as W
from strandframe.streaming import stateless
from tests.conftest import rows


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        if name.endswith(".gz"):
            path.write_bytes(gzip.compress(text.encode()))
        else:
            path.write_text(text)
        return str(path)

    return write


def test_fasta(spark, put):
    path = put("a.fa", ">one x y\nACGT\nAC\n>two\nTT\n\n>three\nG\n")
    table = R.read_fasta(spark, path)
    assert rows(table) == [("one x y", "one", "ACGTAC"), ("three", "three", "G"), ("two", "two", "TT")]
    assert rows(R.read_fasta(spark, path, ["two"])) == [("two", "two", "TT")]
    assert rows(R.fasta_range(table, "one", 3, 99)) == [("one", "GTAC")]
    assert rows(R.fasta_lengths(table)) == [("one", 6), ("three", 1), ("two", 2)]
    assert rows(R.read_fai(spark, put("a.fai", "one\t6\t9\t4\t5\n"))) == [("one", 6, 9, 4, 5)]


def test_fastq_and_records(spark, put):
    text = "@r1\nACGT\n+\n@III\n@r2\nTT\n+\nII\n"
    assert rows(R.read_fastq(spark, put("a.fastq.gz", text))) == [("@r1", "ACGT", "@III"), ("@r2", "TT", "II")]
    one = R.read_records(spark, put("a.txt", "@r\tAC\t+\tII\n@p/1\tAC\t+\tII\t@p/2\tGT\t+\tJJ\n>f\tAC\n>f\tAC\t>g\tTT\n"))
    assert [tuple(r)[1:7] for r in one.collect()] == [("@r", "AC", "II", None, None, None), ("@p/1", "AC", "II", "@p/2", "GT", "JJ"), (">f", "AC", None, None, None, None), (">f", "AC", None, ">g", "TT", None)]


def test_carriage_return_raises(spark, put):
    with pytest.raises(Exception, match="carriage return"):
        R.read_lines(spark, put("w.txt", "a\r\nb\r\n")).collect()


def test_kmer_tables(spark, put):
    assert rows(R.read_kmers(spark, put("k.txt", "ACG 5\nCCC\t2\nGGG\n"))) == [("ACG", 5), ("CCC", 2), ("GGG", 1)]
    assert rows(R.read_sample_kmers(spark, put("s1.gz", "ACG\t5\n"))) == [("s1", "ACG", 5)]
    inline = put("all.txt", "a\nACG\t5\nCCC\t2\nb\nACG\t7\n")
    assert rows(R.read_sample_kmers(spark, inline, labelled=True)) == [("a", "ACG", 5), ("a", "CCC", 2), ("b", "ACG", 7)]


def test_small_tables(spark, put):
    assert rows(R.read_ids(spark, put("i.txt", "@r1/1\nr2\nr2\n"))) == [("r1",), ("r2",)]
    assert rows(R.read_barcodes(spark, put("b.txt", "f\tx\tACGT\ts1\nf\tx\tGG\tBlank\tp\tq\n"))) == [("f", "ACGT", "s1"), ("f", "GG", "Blank_p_q")]
    snps = "ClusterId\tx\n" + "".join("\t".join(["c", "4", "i1", "4", "i2", "4", str(p), "A", "C", "N/A", s, "ACCT"]) + "\n" for p, s in ((3, "ACGT"), (3, "ACTT"), (1, "CCCT"))) + "\t".join("x" * 13) + "\n"
    assert [(r["cluster_id"], r["pos0"], r["seq1"]) for r in R.read_snps(spark, put("s.txt", snps)).orderBy("line").collect()] == [("c", 2, "ACGT"), ("c", 0, "CCCT")]
    assert rows(R.read_clusters(spark, put("c.fa", ">*a1\nAC\nGT\n>b1\nAC-T\n>consensus\nACGT\n>*a2\nA\n>consensus\nA\n"))) == [(1, "a1", "ACGT"), (1, "b1", "AC-T"), (2, "a2", "A")]
    assert rows(R.read_annotation(spark, put("g.txt", "transcript\t1\t9\tg\tt\nexon\t1\t5\tg\tt\nother\t1\t2\tg\tt\n"))) == [("exon", 1, 5, "g", "t"), ("transcript", 1, 9, "g", "t")]
    assert rows(R.read_counts(spark, put("n.txt", "GeneId\ts1\ts2\ng\t3\t4\n"))) == [("g", "s1", 3), ("g", "s2", 4)]
    assert R.read_codons(spark, put("codons.txt", "Met/M ATG\nStop/*\ttaa\n")) == {"ATG": "M", "TAA": "*"}
    matrix = R.read_matrices(spark, put("m.txt", "cov\t2\t3\n1\t5\t6\n2\t7\t8\ncov\n1\t1\t1\n"))
    assert rows(pileup.merge_matrices(matrix)) == [(1, 1, 6), (1, 2, 7), (2, 1, 7), (2, 2, 8)]
    assert "cov" in pileup.matrix_text(pileup.merge_matrices(matrix).collect())


def test_domains(spark, put):
    line = "ctg_500 - 90 PF1 acc 120 1e-5 50 0.1 1 1 1e-4 2e-4 40.5 0.2 1 30 5 24 4 25 0.9 frame=2 len 9"
    got = R.read_domains(spark, put("d.txt", f"# comment\n{line}\n")).first().asDict()
    assert (got["target"], got["target_len"], got["query_len"], got["i_evalue"], got["score"], got["ali_from"], got["ali_to"], got["accuracy"], got["description"]) == ("ctg_500", 90, 120, 2e-4, 40.5, 5, 24, 0.9, "frame=2 len 9")
    at = domains.hit_coordinates(R.read_domains(spark, put("e.txt", line + "\n"))).first()
    assert (at["strand"], at["start"], at["end"]) == ("+", 514, 573)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("ACGT\t3\nACGG\t2\n", "kmers"), ("sample\nACGT\t3\n", "sample_kmers"), ("@r\nAC\n+\nII\n", "fastq"), (">a\nAC\n", "fasta"), (">a\tAC\n", "fasta_line"), (">a\tAC\t>b\tAC\n", "fasta_line_pe"),
        ("@a\tAC\t+\tII\n", "fastq_line"), ("\t".join("@abcdefg") + "\n", "fastq_line_pe"), ("\t".join("@abcdefghijk") + "\n", "fastq_line_pe_index"), ("c\t1\tA\t2\t..\tII\n", "pileup"), ("what\n", "unknown"), ("", "unknown"),
    ],
)
def test_sniffing(spark, put, text, kind):
    assert R.sniff_format(spark, put("x.txt", text)) == kind


def test_sinks(spark, put, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "value string, n int")
    W.write_sorted(df, str(tmp_path / "o.gz"), ["n"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "o.gz")).collect()] in (["a", "b"], ["b", "a"])
    with pytest.raises(Exception, match="(?i)exist"):
        W.write_lines(df, str(tmp_path / "o.gz"))
    W.write_gff3(df.withColumn("value", F.concat("value", F.lit("\tx"))), str(tmp_path / "g"), ["n"])
    parts = sorted((tmp_path / "g").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == ["##gff-version 3", "a\tx", "b\tx"]
    out = spark.createDataFrame([("kept", "s", "SE", 1, "@r", "AC", "II")], "status string, sample string, kind string, mate int, id string, seq string, qual string")
    W.write_fastq_per_sample(out, str(tmp_path / "q"))
    W.write_fastq_per_sample(out, str(tmp_path / "q"), "append")
    files = list((tmp_path / "q/sample=s/kind=SE/mate=1").glob("*.gz"))
    assert len(files) == 2 and gzip.decompress(files[0].read_bytes()) == b"@r\nAC\n+\nII\n"


def collect(stream, name):
    q = stream.writeStream.format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_streams_give_what_batches_give(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(f"@r{i}:x:f:1\tACGTTGCAG{'ACG' * (i + 1)}\t+\tIIIIIIIII{'III' * (i + 1)}\n")
    lines = lambda: stateless.stream_lines(spark, str(folder), 1)
    wanted = spark.createDataFrame([(5, "CAGAC")], "k int, kmer string").withColumn("kmer", F.least("kmer", F.lit("GTCTG")))
    assert collect(stateless.stream_matches(lines(), wanted, 5), "m").count() == 3
    assert collect(stateless.stream_matches(lines(), wanted, 5, invert=True), "mi").count() == 0
    ids = match.clean_ids(spark.createDataFrame([("r1:x:f:1",)], "value string"))
    assert collect(stateless.stream_ids(lines(), ids), "i").count() == 1
    codes = spark.createDataFrame([("f", "ACGT", "s")], "flowcell string, barcode string, sample string")
    batch = demultiplex.demultiplex(R.read_records(spark, str(folder)), codes)
    assert batch.where("status = 'kept'").count() == 3
    (folder / "z.txt").unlink(missing_ok=True)
    piles = tmp_path / "p"
    piles.mkdir()
    (piles / "a.txt").write_text("r\t1\tA\t3\tTTT\tIII\n")
    assert [r["call"] for r in collect(stateless.stream_calls(stateless.stream_lines(spark, str(piles))), "c").collect()] == ["T"]


def test_command_line(spark, put, tmp_path):
    def run(*args):
        out = tmp_path / f"out{len(list(tmp_path.iterdir()))}"
        a = cli.parser().parse_args([*args, "-o", str(out)])
        W.write_lines(a.run(spark, a), str(out))
        return sorted(r[0] for r in spark.read.text(str(out)).collect())

    kmers = put("k.txt", "AAC\t1\nACT\t1\nCTG\t1\n")
    assert run("kextend", kmers, "-k", "3")[0] == ">contig_1 5"
    reads = put("r.txt", "@a\tAACTG\t+\tIIIII\n@b\tGGGGG\t+\tIIIII\n")
    assert run("kmatch", reads, "-K", kmers, "-k", "3") == ["@a\tAACTG\t+\tIIIII"]
    assert run("kmatch", reads, "-K", kmers, "-k", "3", "-v") == ["@b\tGGGGG\t+\tIIIII"]
    assert run("idmatch", reads, "-I", put("ids", "b\n")) == ["@b\tGGGGG\t+\tIIIII"]
    fasta = put("f.fa", ">s\nAACTGCCATGAAATAGCC\n")
    assert run("kmerlocate", kmers, "-k", "3", "-f", fasta)[0].startswith("AAC\ts\t1\t3")
    assert run("freqmers", kmers, "-k", "3", "-f", fasta)[0].startswith("s\tk.txt\t1.0")
    assert run("allorfs", fasta, "-m", "9") == [">s:8-16 frame=2", "MK*"]
    assert run("seedmers", kmers, "-k", "3", "-f", fasta)
    pile = put("p.txt", "r\t1\tA\t3\t...\tIII\t3\tTTT\tIII\n")
    assert run("pmpileup", pile)[0].startswith("CALLS")
    assert "0\t1\t1" in run("pileupstats", pile)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing"])


def test_fastq_of_odd_files(spark, put):
    text = "@r1\n\n+\n\n\n@r2 x\nACGT\n+r2\n@@+I\n\n\n@r3\nA\n+\n@\n@r4\nCC\n+\n++\n@r5\n\n+\n"
    want = [("@r1", "", ""), ("@r2 x", "ACGT", "@@+I"), ("@r3", "A", "@"), ("@r4", "CC", "++"), ("@r5", "", "")]
    assert rows(R.read_fastq(spark, put("odd.fastq", text))) == want
    assert R.read_fastq(spark, put("none.fastq", "\n")).count() == 0
    for wrong in ("@r1\r\nA\r\n+\r\nI\r\n", "@r1\nA\n+\n", "r1\nA\n+\nI\n", "@r1\nA\nA\nI\n"):
        with pytest.raises(Exception, match="carriage return|not FASTQ"):
            R.read_fastq(spark, put("wrong.fastq", wrong)).collect()
    with pytest.raises(Exception, match="carriage return"):
        R.read_fasta(spark, put("wrong.fa", ">a\r\nAC\r\n")).collect()
    with pytest.raises(Exception, match="carriage return"):
        R.read_numbered(spark, put("wrong.txt", "a\r\n")).collect()


def test_fastq_over_splits(spark, put):
    """Splits at any byte give the same reads: quality lines that start like headers, empty reads, blank lines."""
    import random

    random.seed(3)
    want, text = [], ""
    for i in range(300):
        n = random.choice([0, 1, 2, 5, 30])
        seq, qual = "".join(random.choices("ACGTN", k=n)), "".join(random.choices("@+I>", k=n))
        want.append((f"@read{i}", seq, qual))
        text += f"@read{i}\n{seq}\n+\n{qual}\n" + random.choice(["", "", "\n", "\n\n"])
    path = put("many.fastq", text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (7, 64, 301, 4096):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert sorted(map(tuple, R.read_fastq(spark, path).collect())) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
