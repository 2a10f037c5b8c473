"""Demultiplexing of barcoded reads, and trimming of adapters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import sequence as S


@dataclass(frozen=True)
class DemultiplexOptions:
    """remnant1 follows the barcode, remnant2 precedes the adapter. least_single, least_end, least_sum: lengths."""

    remnant1: str = "TGCAG"
    remnant2: str = "CCG"
    adapter: str = "AGATCGGAAGAGC"
    adapter_length: int = 9
    check_remnant: bool = True
    trim_barcode: bool = True
    trim_adapter: bool = True
    least_single: int = 1
    least_end: int = 1
    least_sum: int = 2


def flowcell(read_id: Column) -> Column:
    """Third `:` field of a read's id, or its first field without the first character."""
    parts = F.split(read_id, ":")
    return F.when(F.size(parts) > 2, parts[2]).otherwise(F.substr(parts[0], F.lit(2)))


def check_barcodes(barcodes: DataFrame) -> None:
    """Raise where a flowcell has a barcode twice."""
    twice = barcodes.groupBy("flowcell", "barcode").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"barcode {twice[0]['barcode']} is there twice for flowcell {twice[0]['flowcell']}")


def prefix_match(reads: DataFrame, barcodes: DataFrame, seq: str = "seq", by: str = "flowcell") -> DataFrame:
    """The reads with `barcode` and `sample` of the longest barcode of their flowcell that starts the read; null for none.

    Each flowcell's barcodes are one row, longest first, so a read meets one row and no pairs are made.
    """
    each = F.struct((-F.length("barcode")).alias("n"), "barcode", "sample")
    lists = barcodes.groupBy(by).agg(F.array_sort(F.collect_list(each)).alias("__codes"))
    joined = reads.join(lists, by, "left")
    first = F.get(F.filter("__codes", lambda b: F.startswith(F.col(seq), b["barcode"])), F.lit(0))
    return joined.withColumn("__b", first).withColumns({"barcode": F.col("__b.barcode"), "sample": F.col("__b.sample")}).drop("__b", "__codes")


def adapter_cut(seq: Column, how: DemultiplexOptions) -> Column:
    """Bases of read 1 to keep: to the end of the first second-site remnant that the adapter, or a beginning of it, follows."""
    m, adapter = len(how.remnant2), how.adapter[: how.adapter_length]
    places = F.when(F.length(seq) >= m, F.sequence(F.lit(1), F.length(seq) - (m - 1)))
    tail = lambda i: F.substr(seq, i + m)
    hit = F.filter(places, lambda i: (F.substr(seq, i, F.lit(m)) == how.remnant2) & (F.startswith(F.lit(adapter), tail(i)) | F.startswith(tail(i), F.lit(adapter))))
    return F.coalesce(F.array_min(hit) + (m - 1), F.length(seq))


def readthrough_cut(seq: Column, barcode: Column, how: DemultiplexOptions) -> Column:
    """Bases of read 2 to keep: to the end of the last reversed first-site remnant, if the reversed barcode or a beginning
    of it follows. Without a remnant, all."""
    mark = how.remnant1.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    m = len(mark)
    back = F.instr(F.reverse(seq), mark[::-1])
    at = F.length(seq) - back - m + 2  # 1-based start of the last one
    rest, code = F.substr(seq, at + m), S.reverse_complement(barcode)
    return F.when((back > 0) & (F.startswith(rest, code) | F.startswith(code, rest)), at + (m - 1)).otherwise(F.length(seq))


def demultiplex(reads: DataFrame, barcodes: DataFrame, how: DemultiplexOptions = DemultiplexOptions()) -> DataFrame:
    """Reads (id, seq, qual, id2, seq2, qual2; mates may be null) as (status, sample, kind, mate, id, seq, qual).

    kind is PE or SE. Pairs whose trimmed mates are long enough stay pairs; else each mate that is goes on alone.
    Rows that are dropped come out once, with a status and no kind: no_flowcell, no_barcode, no_remnant, too_short.
    """
    known = barcodes.select("flowcell").distinct().withColumn("__known", F.lit(True))
    rows = prefix_match(reads.withColumn("flowcell", flowcell(F.col("id"))), barcodes).join(known, "flowcell", "left")
    site = F.startswith(F.col("seq"), F.concat("barcode", F.lit(how.remnant1)))
    status = F.when(F.col("__known").isNull(), F.lit("no_flowcell")).when(F.col("barcode").isNull(), F.lit("no_barcode"))
    status = status.when(~site, F.lit("no_remnant")) if how.check_remnant else status
    rows = rows.withColumn("status", status)
    start = F.length("barcode") if how.trim_barcode else F.lit(0)
    rows = rows.withColumns({c: F.when(F.col("status").isNull(), F.substr(F.col(c), start + 1)).otherwise(F.col(c)) for c in ("seq", "qual")})
    if how.trim_adapter:
        keep1, keep2 = adapter_cut(F.col("seq"), how), readthrough_cut(F.col("seq2"), F.col("barcode"), how)
        rows = rows.withColumns({"__k1": keep1, "__k2": keep2})
        cut = lambda c, k: F.substr(F.col(c), F.lit(1), F.coalesce(F.col(k), F.lit(0)))
        rows = rows.withColumns({"seq": cut("seq", "__k1"), "qual": cut("qual", "__k1"), "seq2": cut("seq2", "__k2"), "qual2": cut("qual2", "__k2")})
    n1, n2 = F.length("seq"), F.length("seq2")
    one = lambda kind, mate, s="": F.struct(F.lit(kind).alias("kind"), F.lit(mate).alias("mate"), F.col(f"id{s}").alias("id"), F.col(f"seq{s}").alias("seq"), F.col(f"qual{s}").alias("qual"))
    paired = F.col("seq2").isNotNull()
    pair = paired & (n1 >= how.least_end) & (n2 >= how.least_end) & (n1 + n2 >= how.least_sum)
    alone = F.array_compact(F.array(F.when(n1 >= how.least_end, one("SE", 1)), F.when(n2 >= how.least_end, one("SE", 2, "2"))))
    single = F.array_compact(F.array(F.when(n1 >= how.least_single, one("SE", 1))))
    out = F.when(F.col("status").isNotNull(), F.array().cast(single_type())).when(pair, F.array(one("PE", 1), one("PE", 2, "2"))).when(paired, alone).otherwise(single)
    rows = rows.withColumn("__out", out).withColumn("status", F.coalesce("status", F.when(F.size("__out") == 0, F.lit("too_short")).otherwise(F.lit("kept"))))
    each = rows.select("status", "sample", F.explode_outer("__out").alias("o"))
    return each.select("status", "sample", "o.kind", "o.mate", "o.id", "o.seq", "o.qual")


def single_type() -> str:
    return "array<struct<kind:string,mate:int,id:string,seq:string,qual:string>>"


def status_counts(out: DataFrame) -> DataFrame:
    return out.groupBy("status").agg(F.count("*").alias("n"))


def sample_counts(out: DataFrame) -> DataFrame:
    return out.where("status = 'kept'").groupBy("sample").agg(F.count("*").alias("n"))


def fastq_lines(out: DataFrame) -> DataFrame:
    """(sample, kind, mate, value): four-line records of what was kept."""
    return out.where("status = 'kept'").select("sample", "kind", "mate", F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value"))
