"""Text formats as DataFrames. Paths may be files, folders or globs of any store that Spark reads; gzip by suffix."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# functions that run on executors travel with the task, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_lines(spark: SparkSession, path: str | list[str], check: bool = True) -> DataFrame:
    """(file, value): lines without their ends; blank ones are left out. With `check`, a carriage return raises when
    the rows are read, as Windows line ends would otherwise become part of sequences."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("length(trim(value)) > 0")
    return rows.withColumn("value", _checked()) if check else rows


def _checked() -> Column:
    """`value`, which raises where it holds a carriage return."""
    wrong = F.raise_error(F.concat(F.lit("carriage return in "), F.col("file")))
    return F.when(F.instr("value", "\r") > 0, wrong.cast("string")).otherwise(F.col("value"))


def read_numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value) with lines in their order in each file. Each file is read whole by one task, which is for
    tables of moderate size: SNP tables, clusters, matrices. Reads and k-mers don't need it. Carriage returns raise."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").withColumn("value", _checked())
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where("length(trim(value)) > 0")


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reads of one line each: line, id, seq, qual, id2, seq2, qual2, id3, seq3, qual3 (nulls where a format has none).

    4, 8 or 12 fields are FASTQ (single, paired, paired with index), 2 or 2 + 2 are FASTA.
    """
    return parse_records(read_lines(spark, path))


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    p = F.split(F.col(column), "\t")
    n = F.size(p)
    fastq = (n >= 4) & (n % 4 == 0) & F.startswith(F.col(column), F.lit("@"))
    at = lambda q, a: F.when(fastq, F.get(p, F.lit(q))).otherwise(F.get(p, F.lit(a)) if a is not None else F.lit(None))
    return lines.select(
        F.col(column).alias("line"), at(0, 0).alias("id"), at(1, 1).alias("seq"), at(3, None).alias("qual"), at(4, 2).alias("id2"), at(5, 3).alias("seq2"), at(7, None).alias("qual2"),
        at(8, None).alias("id3"), at(9, None).alias("seq3"), at(11, None).alias("qual3"),
    )


class _Fastq:
    """Four-line records out of lines that come in order. Blank lines between records do no harm; a read may be empty."""

    def __init__(self, file: str, synced: bool):
        self.file, self.synced, self.head, self.lines = file, synced, [], []

    def add(self, line: str) -> tuple[str, str, str] | None:
        """The record that the line completes. Until the first start of a record, lines go to `head`: that is a line with
        `@` of which the one after the next starts with `+`, which no sequence does."""
        self.lines.append(line)
        if not self.synced:
            if len(self.lines) < 3:
                return None
            if not (self.lines[0].startswith("@") and self.lines[2].startswith("+")):
                self.head.append(self.lines.pop(0))
                return None
            self.synced = True
        if len(self.lines) == 1 and not line.strip():
            self.lines.clear()
        if self.lines and not self.lines[0].startswith("@") or len(self.lines) == 3 and not self.lines[2].startswith("+"):
            raise ValueError(f"not FASTQ: {self.lines} in {self.file}")
        if len(self.lines) < 4:
            return None
        name, seq, _, qual = self.lines
        self.lines = []
        return name, seq, qual


_RECORD = "file string, start long, id string, seq string, qual string, edge boolean, synced boolean, head array<string>, tail array<string>"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each split (file, start), and for each split an edge row with the lines before and after them."""
    now, at = None, None
    strings = pa.list_(pa.string())
    kinds = {"start": pa.int64(), "edge": pa.bool_(), "synced": pa.bool_(), "head": strings, "tail": strings}
    schema = pa.schema([(x.split()[0], kinds.get(x.split()[0], pa.string())) for x in _RECORD.split(", ")])

    def edge() -> dict:
        return {"file": at[0], "start": at[1], "edge": True, "synced": now.synced, "head": now.head if now.synced else now.head + now.lines, "tail": now.lines if now.synced else []}

    for batch in batches:
        out = []
        for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, start) != at:
                if now:
                    out.append(edge())
                now, at = _Fastq(file, start == 0), (file, start)
            if record := now.add(line):
                out.append({"file": file, "edge": False, **dict(zip(("id", "seq", "qual"), record, strict=True))})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if now:
        yield pa.RecordBatch.from_pylist([edge()], schema)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that go over the ends of splits: (file, splits in their order) to (id, seq, qual)."""
    for batch in batches:
        out = []
        for file, splits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parser = _Fastq(file, True)
            for s in splits:
                for line in s["head"]:
                    out += [r] if (r := parser.add(line)) else []
                if s["synced"]:
                    if any(x.strip() for x in parser.lines):
                        raise ValueError(f"not FASTQ: {parser.lines} in {file}")
                    parser.lines = list(s["tail"])
            if len(parser.lines) == 3 and not parser.lines[1]:
                out += [r] if (r := parser.add("")) else []  # an empty read whose last line has no end
            if any(x.strip() for x in parser.lines):
                raise ValueError(f"not FASTQ: {parser.lines} at the end of {file}")
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*out, strict=True)) or [[], [], []])], names=["id", "seq", "qual"])


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, seq, qual) of four-line FASTQ. A quality line may start with `@`, reads may be empty, and blank lines between
    records do no harm; a carriage return, or lines that aren't records, raise.

    Plain files are read in splits. Each task finds the first start of a record in its split and gives the records that
    lie whole in it; the few lines around the ends of splits, one small row for each, meet by file in a second step.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    found = lines.withColumn("value", _checked()).mapInArrow(_records, _RECORD)
    splits = found.where("edge").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "synced", "head", "tail"))).alias("splits"))
    return found.where("not edge").select("id", "seq", "qual").unionByName(splits.mapInArrow(_stitched, "id string, seq string, qual string"))


def read_fasta(spark: SparkSession, path: str | list[str], ids: list[str] | None = None) -> DataFrame:
    """(id, name, seq): whole header, its first word, and the sequence with its lines joined. `ids` keeps names."""
    pieces = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), "value").withColumn("value", _checked())
    pieces = pieces.select(F.regexp_replace("value", "^>", "").alias("value")).where("length(trim(value)) > 0")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substr("value", F.length(head) + 2), r"\s", "")
    rows = pieces.select(head.alias("id"), F.split(head, " ")[0].alias("name"), body.alias("seq"))
    return rows if ids is None else rows.where(F.col("name").isin(ids))


def fasta_lengths(fasta: DataFrame) -> DataFrame:
    return fasta.select("name", F.length("seq").alias("length"))


def fasta_range(fasta: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """(name, seq) of bases start..end, from 1 and inclusive; an end beyond the sequence is its end."""
    return fasta.where(F.col("name") == name).select("name", F.substring("seq", start, max(0, end - start + 1)).alias("seq"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases int, line_width int")


def read_kmers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(kmer, freq): a k-mer and maybe its count on each line, separated by a tab or blanks."""
    p = F.split(F.trim("value"), "[\t ]+")
    return read_lines(spark, path).select(p[0].alias("kmer"), F.coalesce(F.get(p, F.lit(1)).cast("int"), F.lit(1)).alias("freq"))


def read_sample_kmers(spark: SparkSession, path: str | list[str], labelled: bool = False) -> DataFrame:
    """(sample, kmer, freq): one file per sample, named by the file; or `labelled`, a line with one field before each block."""
    if not labelled:
        name = F.regexp_replace(F.element_at(F.split(F.col("file"), "/"), -1), r"\.gz$", "")
        p = F.split(F.trim("value"), "[\t ]+")
        return read_lines(spark, path).select(name.alias("sample"), p[0].alias("kmer"), F.coalesce(F.get(p, F.lit(1)).cast("int"), F.lit(1)).alias("freq"))
    p = F.split(F.trim("value"), "[\t ]+")
    rows = read_numbered(spark, path).withColumn("p", p)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    label = F.last(F.when(F.size("p") == 1, F.col("p")[0]), ignorenulls=True).over(w)
    return rows.withColumn("sample", label).where(F.size("p") > 1).select("sample", F.col("p")[0].alias("kmer"), F.col("p")[1].cast("int").alias("freq"))


def read_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    from strandframe.operators.match import clean_ids

    return clean_ids(read_lines(spark, path))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(flowcell, barcode, sample): columns 0, 2, 3 of a table without header; blanks get their other fields' text."""
    p = F.split("value", "\t")
    sample = F.when(F.lower(p[3]).startswith("blank"), F.concat_ws("_", F.slice(p, 4, 1000))).otherwise(p[3])
    return read_lines(spark, path).select(p[0].alias("flowcell"), p[2].alias("barcode"), sample.alias("sample"))


def read_pileup(spark: SparkSession, path: str | list[str]) -> DataFrame:
    from strandframe.operators.pileup import parse_pileup

    return parse_pileup(read_lines(spark, path))


def read_matrices(spark: SparkSession, path: str | list[str]) -> DataFrame:
    from strandframe.operators.pileup import parse_matrices

    return parse_matrices(read_numbered(spark, path))


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    """(line, cluster_id, id1, id2, pos0, seq1, seq2) of a 12-column table after a line that starts with ClusterId. Rows of
    more columns are left out; of rows with one cluster and position the first stays."""
    from strandframe.operators.genotype import distinct_snps

    p = F.split("value", "\t")
    rows = read_numbered(spark, path).where(~F.col("value").startswith("ClusterId") & (F.size(p) == 12))
    parsed = rows.select(F.col("line_no").alias("line"), p[0].alias("cluster_id"), p[2].alias("id1"), p[4].alias("id2"), (p[6].cast("int") - 1).alias("pos0"), p[10].alias("seq1"), p[11].alias("seq2"))
    return distinct_snps(parsed, "line")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_no, seq_id, aln): FASTA in which `>*id` opens a cluster and `>consensus` closes it.

    A row of the file is a cluster, so files are read in splits and a task holds one cluster at a time. Clusters are
    numbered in their order in each file: by the order in the split and one row for each split, which is broadcast.
    """
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    texts = spark.read.option("lineSep", "\n>*").text(path).select(*place, "value")
    splits = texts.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min_by(F.col("value").startswith(">*"), "at").alias("star"))
    w = Window.partitionBy("file").orderBy("block")
    # what stands before a file's first `>*` is cluster 0, and the separator of the first row is still there
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", "first", before.alias("before"), F.first("star").over(w).alias("star"))
    rows = texts.withColumn("value", _checked()).join(F.broadcast(splits), ["file", "block"])
    rank = F.col("before") + F.col("at") - F.col("first")
    head = (rank == 0) & F.col("value").startswith(">")
    body = F.when(head & F.col("star"), F.substr("value", F.lit(3))).when(head, F.substr("value", F.lit(2))).otherwise(F.col("value"))
    records = F.split(body, "\n>")
    records = F.when((rank == 0) & ~head, F.slice(records, 2, 1 << 30)).otherwise(records)
    each = rows.select((rank + F.col("star").cast("long")).alias("cluster_no"), F.explode(records).alias("record")).withColumn("s", F.split("record", "\n"))
    aln = F.array_join(F.transform(F.slice("s", 2, 1 << 30), lambda x: F.trim(x)), "")
    return each.select("cluster_no", F.col("s")[0].alias("seq_id"), aln.alias("aln")).where("seq_id <> 'consensus'")


def read_domains(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Domain hits of a whitespace table with # comments; coordinates in residues of the target."""
    p = F.split(F.trim("value"), "\t| +")
    number = lambda i, kind: F.expr(f"try_cast(get(p, {i}) as {kind})")
    rows = read_lines(spark, path).where(~F.col("value").startswith("#")).select(p.alias("p")).where(F.size("p") >= 22)
    names = ("hmm_from", "hmm_to", "ali_from", "ali_to", "env_from", "env_to")
    return rows.select(
        F.col("p")[0].alias("target"), number(2, "int").alias("target_len"), F.col("p")[3].alias("query"), number(5, "int").alias("query_len"), number(12, "double").alias("i_evalue"),
        number(13, "double").alias("score"), number(14, "double").alias("bias"), *(number(15 + i, "int").alias(n) for i, n in enumerate(names)), number(21, "double").alias("accuracy"),
        F.concat_ws(" ", F.slice("p", 23, 1000)).alias("description"),
    )


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(type, start, end, gene, transcript) of transcripts and exons."""
    rows = spark.read.csv(path, sep="\t", schema="type string, start int, end int, gene string, transcript string")
    return rows.where(F.col("type").isin("transcript", "exon"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(gene, sample, reads) of a matrix whose header starts with GeneId."""
    from strandframe.operators.expression import unpivot_counts

    return unpivot_counts(spark.read.csv(path, sep="\t", header=True))


def read_codons(spark: SparkSession, path: str) -> dict[str, str]:
    """Codon to letter of a file of `Name/L codon` lines (at most 64 of them)."""
    rows = read_lines(spark, path).limit(1000).collect()
    return {m[2].upper(): m[1] for r in rows if (m := re.match(r"\S*/(\S)[ \t]+([A-Za-z]{3})", r["value"]))}


# -- format sniffing --------------------------------------------------------------------------------


def sniff_format(spark: SparkSession, path: str) -> str:
    """The kind of a text file by its first eight lines that aren't blank."""
    return sniff_lines([r["value"] for r in read_lines(spark, path, check=False).limit(8).collect()])


def sniff_lines(lines: list[str]) -> str:
    """kmers, sample_kmers, fastq, fasta, fasta_line, fasta_line_pe, fastq_line, fastq_line_pe, fastq_line_pe_index, pileup or unknown."""
    if not lines:
        return "unknown"
    mer = re.compile(r"[ACGT]+([\t ]+\d+)?$")
    fields = [x.split("\t") for x in lines]
    if len(lines) > 1 and all(mer.match(x) for x in lines[:2]) and len(lines[0].split()[0]) == len(lines[1].split()[0]):
        return "kmers"
    if len(lines) > 1 and len(lines[0].split()) == 1 and not lines[0].startswith((">", "@")) and mer.match(lines[1]):
        return "sample_kmers"
    if lines[0].startswith("@") and len(fields[0]) == 1 and len(lines) > 2 and lines[2].startswith("+"):
        return "fastq"
    if lines[0].startswith(">") and len(fields[0]) == 1:
        return "fasta"
    if lines[0].startswith(">") and len(fields[0]) in (2, 4):
        return "fasta_line" if len(fields[0]) == 2 else "fasta_line_pe"
    if lines[0].startswith("@") and len(fields[0]) in (4, 8, 12):
        return {4: "fastq_line", 8: "fastq_line_pe", 12: "fastq_line_pe_index"}[len(fields[0])]
    if len(fields[0]) >= 6 and len(fields[0]) % 3 == 0 and fields[0][1].isdigit() and fields[0][3].isdigit():
        return "pileup"
    return "unknown"
