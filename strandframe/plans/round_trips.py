"""Registered queries of sources and sinks: whole tables are written in a format and read back, branches of the format included."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.lineage import checkpoint_folder, cut
from strandframe.plans import views as V
from strandframe.plans.registry import query
from strandframe.plans.views import Q_DEPTHS, Q_LONG, q_dna, q_rc
from strandframe.sources import readers, writers


def _through(df: DataFrame, read: Callable, write: Callable = writers.write_lines, suffix: str = "") -> DataFrame:
    """What `read` finds in what `write` wrote, kept in a checkpoint; the files go at once. They lie beside the checkpoints,
    where driver and executors see them."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/round-trip-{uuid.uuid4().hex}{suffix}"
    try:
        write(df, path)
        return cut(read(spark, path))
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _text(*parts: Column | str) -> Column:
    """The parts joined as one text; strings stand for themselves."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("value")


def _tabs(*parts: Column | str) -> Column:
    return F.concat_ws("\t", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("value")


@query(
    f"""select '@r' || o_orderkey as id, seq, repeat(case when o_orderkey % 3 = 0 then '@' else 'I' end, length(seq)) as qual
    from (select o_orderkey, case when o_orderkey % 5 = 0 then '' else {q_dna("o_orderkey")} end as seq from orders)"""
)
def source_fastq(spark, d):
    """Some reads are empty, some qualities start with @, and blank lines stand between some records."""
    key = F.col("o_orderkey")
    seq = F.when(key % 5 == 0, F.lit("")).otherwise(V.dna(key))
    qual = F.repeat(F.when(key % 3 == 0, F.lit("@")).otherwise(F.lit("I")), F.length(seq))
    gap = F.when(key % 7 == 0, F.lit("\n")).otherwise(F.lit(""))
    return _through(V.table(spark, d, "orders").select(_text("@r", key, "\n", seq, "\n+\n", qual, gap)), readers.read_fastq)


@query(f"select 'c' || seq_id || ' of a document' as id, 'c' || seq_id as name, seq from {Q_LONG}")
def source_fasta(spark, d):
    """Sequences wrapped at 60 letters."""
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    return _through(V.long_sequences(spark, d).select(_text(">c", F.col("seq_id"), " of a document\n", wrapped)), readers.read_fasta)


@query(f"select 'c' || seq_id as name, length(seq) as length from {Q_LONG}")
def source_fasta_lengths(spark, d):
    fasta = V.long_sequences(spark, d).select(_text(">c", F.col("seq_id"), "\n", F.col("seq")))
    return _through(fasta, lambda s, path: readers.fasta_lengths(readers.read_fasta(s, path)), suffix=".gz")


@query(
    f"""select case when even then '@m' else '>f' end || k as id, {q_dna("k")} as seq, case when even then repeat('I', 32) end as qual,
    case when even then '@m' || k end as id2, case when even then {q_rc(q_dna("k + 1"))} end as seq2, case when even then repeat('J', 32) end as qual2
    from (select o_orderkey as k, o_orderkey % 2 = 0 as even from orders)"""
)
def source_records(spark, d):
    """Pairs of FASTQ reads on one line, among FASTA reads on one line."""
    key, seq, mate = F.col("read_id"), F.col("seq"), F.col("seq2")
    pair = _tabs(_text("@m", key), seq, "+", F.lit("I" * 32), _text("@m", key), mate, "+", F.lit("J" * 32))
    lines = V.paired_reads(spark, d).select(F.when(key % 2 == 0, pair).otherwise(_tabs(_text(">f", key), seq)).alias("value"))
    return _through(lines, readers.read_records).select("id", "seq", "qual", "id2", "seq2", "qual2")


@query(f"select {q_dna('p_partkey')} as kmer, cast(case when p_partkey % 3 = 0 then 1 else p_partkey % 9 end as int) as freq from part")
def source_kmers(spark, d):
    """Gzipped; some lines have no count, in others a tab or blanks come before it."""
    key = F.col("p_partkey")
    count = F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, _text("\t", key % 9)).otherwise(_text("   ", key % 9))
    return _through(V.table(spark, d, "part").select(_text(V.dna(key), count)), readers.read_kmers, suffix=".gz")


@query(f"select 'r' || n_regionkey as sample, substr({q_dna('n_nationkey')}, 1, 11) as kmer, cast(n_nationkey as int) as freq from nation")
def source_sample_kmers(spark, d):
    """Blocks that a line with their sample's name starts, one for each region."""
    line = F.concat(F.substring(V.dna(F.col("n_nationkey")), 1, 11), F.lit(" "), F.col("n_nationkey").cast("string"))
    blocks = V.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    return _through(blocks.select(_text("r", F.col("n_regionkey"), "\n", F.col("lines"))), lambda s, path: readers.read_sample_kmers(s, path, labelled=True))


@query(
    f"""select cast(ref as varchar) as ref, cast(pos as int) as pos, 'A' as ref_base, cast(row_number() over (partition by ref, pos order by sample) - 1 as int) as sample_idx,
    depth, repeat('.', depth % 5) as bases, repeat('I', depth % 5) as quals from {Q_DEPTHS}"""
)
def source_pileup(spark, d):
    """A line for each locus, with a triple for each sample."""
    triple = F.struct("sample", _tabs(F.col("depth"), F.repeat(F.lit("."), F.col("depth") % 5), F.repeat(F.lit("I"), F.col("depth") % 5)).alias("triple"))
    loci = V.depths(spark, d).groupBy("ref", "pos").agg(F.array_sort(F.collect_list(triple)).alias("samples"))
    return _through(loci.select(_tabs(F.col("ref"), F.col("pos"), "A", F.array_join("samples.triple", "\t"))), readers.read_pileup)


@query(
    """select 'c' || o_orderkey as cluster_id, 'a' || o_orderkey as id1, 'b' || o_orderkey as id2, cast(o_custkey % 32 as int) as pos0, 's' || o_orderkey as seq1, 't' || o_orderkey as seq2 from orders"""
)
def source_snps(spark, d):
    """Each row comes a second time with another parent, which the first one hides, and a third time with a column too many."""
    key = F.col("o_orderkey")
    row = lambda a, *more: _tabs(_text("c", key), "32", _text(a, key), "", _text("b", key), "", F.col("o_custkey") % 32 + 1, "", "", "", _text("s", key), _text("t", key), *more)
    lines = V.table(spark, d, "orders").select(_text("ClusterId\tand so on\n", row("a"), "\n", row("x"), "\n", row("y", "more")))
    return _through(lines, readers.read_snps).select("cluster_id", "id1", "id2", "pos0", "seq1", "seq2")


@query(f"select unnest(['a', 'b']) || o_orderkey as seq_id, unnest([substr({q_dna('o_orderkey')}, 1, 20) || '--' || substr({q_dna('o_orderkey')}, 21), {q_dna('o_custkey')} || '++']) as aln from orders")
def source_clusters(spark, d):
    """Clusters of two, with gaps, padding, wrapped lines and a consensus."""
    key, seq = F.col("o_orderkey"), V.dna(F.col("o_orderkey"))
    first = (">*a", key, "\n", F.substring(seq, 1, 20), "\n--", F.substring(seq, 21, 12))
    lines = V.table(spark, d, "orders").select(_text(*first, "\n>b", key, "\n", V.dna(F.col("o_custkey")), "++\n>consensus\n", seq))
    return _through(lines, readers.read_clusters).select("seq_id", "aln")


@query(
    """select 't' || p_partkey as target, cast(p_size as int) as target_len, 'q' || p_partkey % 7 as query, 40 as query_len, 0.5::double as i_evalue, p_size::double as score, 0.25::double as bias,
    1 as hmm_from, 2 as hmm_to, cast(p_partkey as int) as ali_from, cast(p_partkey + 9 as int) as ali_to, 5 as env_from, 6 as env_to, 0.75::double as accuracy, case when p_partkey % 2 = 0 then 'a long one' else '' end as description from part"""
)
def source_domains(spark, d):
    """Fields with blanks between them, comments, some without a description."""
    key, size = F.col("p_partkey"), F.col("p_size")
    fields = [_text("t", key), "-", size, _text("q", key % 7), "-", "40", "1e-9", "9", "9", "1", "1", "1e-9", "0.5", size, "0.25", "1", "2", key, key + 9, "5", "6", "0.75"]
    line = F.concat_ws("  ", *(F.lit(f) if isinstance(f, str) else f.cast("string") for f in fields))
    said = F.when(key % 2 == 0, F.lit(" a long one")).otherwise(F.lit(""))
    return _through(V.table(spark, d, "part").select(_text("# a comment\n", line, said)), readers.read_domains)


@query(
    """select case l_linenumber % 3 when 0 then 'transcript' else 'exon' end as type, cast(l_partkey as int) as start, cast(l_partkey + l_linenumber as int) as "end", 'g' || l_suppkey as gene, 't' || l_orderkey as transcript
    from lineitem where l_linenumber % 3 < 2"""
)
def source_annotation(spark, d):
    """Transcripts, exons, and features of another type, which are left out."""
    number = F.col("l_linenumber")
    kind = F.when(number % 3 == 0, F.lit("transcript")).when(number % 3 == 1, F.lit("exon")).otherwise(F.lit("CDS"))
    lines = V.table(spark, d, "lineitem").select(_tabs(kind, F.col("l_partkey"), F.col("l_partkey") + number, _text("g", F.col("l_suppkey")), _text("t", F.col("l_orderkey"))))
    return _through(lines, readers.read_annotation)


@query(
    """select 'g' || g as gene, 's' || s as sample, coalesce(n, 0) as reads from (select distinct l_suppkey as g from lineitem) cross join (select unnest(range(1, 8)) as s)
    left join (select l_suppkey as g, l_linenumber as s, count(*) as n from lineitem group by all) using (g, s)"""
)
def source_counts(spark, d):
    """A matrix of genes by samples under a header."""
    named = V.table(spark, d, "lineitem").select(_text("g", F.col("l_suppkey")).alias("GeneId"), _text("s", F.col("l_linenumber")).alias("sample"))
    wide = named.groupBy("GeneId").pivot("sample", [f"s{i}" for i in range(1, 8)]).count().fillna(0)
    return _through(wide, readers.read_counts, lambda df, path: df.write.csv(path, sep="\t", header=True))


@query(
    f"""select 'f' || n_regionkey as flowcell, substr({q_dna("n_nationkey")}, 1, 6) as barcode, case when n_nationkey % 5 = 0 then 'Blank_A_' || n_nationkey else n_name end as sample from nation"""
)
def source_barcodes(spark, d):
    """Blanks get the text of their other fields."""
    key = F.col("n_nationkey")
    sample = F.when(key % 5 == 0, _tabs("Blank", "A", key)).otherwise(F.col("n_name"))
    lines = V.table(spark, d, "nation").select(_tabs(_text("f", F.col("n_regionkey")), "1", F.substring(V.dna(key), 1, 6), sample))
    return _through(lines, readers.read_barcodes)


@query("select 'r' || o_orderkey as id from orders")
def source_ids(spark, d):
    """Each id as the first mate's name with @, as the second mate's without, and bare."""
    key = F.col("o_orderkey")
    return _through(V.table(spark, d, "orders").select(_text("@r", key, "/1\nr", key, "/2\n\nr", key)), readers.read_ids)


@query(
    """select '##gff-version 3' as value union all select 'g' || l_suppkey || chr(9) || 'x' || chr(9) || 'exon' || chr(9) || l_partkey || chr(9) || (l_partkey + l_linenumber) from lineitem"""
)
def sink_gff3(spark, d):
    """Sorted part files whose first line is the version."""
    rows = V.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("ref"), F.col("l_partkey").alias("start"), _tabs(_text("g", F.col("l_suppkey")), "x", "exon", F.col("l_partkey"), F.col("l_partkey") + F.col("l_linenumber"))
    )
    return _through(rows, readers.read_lines, lambda df, path: writers.write_gff3(df, path, ["ref", "start"])).select("value")
