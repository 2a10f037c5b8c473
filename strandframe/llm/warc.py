"""Operator 4, WARC: write archives of captures, read them back and join their records into one row per capture."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, prepare, shared_folder

END = "\r\n"
#: Between two records: the two line ends that close one, and the first bytes of the next.
BETWEEN = b"\r\n\r\nWARC/"
#: Payloads from this size on are stored once; later captures of them become revisits.
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"


def record_id(kind: str, *parts: Column) -> Column:
    """A stable urn:uuid of what a record is and holds."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _record(kind: str | Column, identity: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record as it stands in the file. A field that is null is left out; Content-Length counts UTF-8 bytes."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), identity), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat(F.concat_ws(END, *lines), F.lit(f"{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END * 2), block)


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with bytes, sha1 and `repeat`: null for the first row of a page_id and payload, else a number of its own.

    Most tables repeat no such pair, and then nothing is written. Rows that do are written with their numbers, so that
    they keep them; the pairs are joined like other keys that may be hot.
    """
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    pair = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "sha1")
    pairs = cut(rows.select(pair.alias("pair")).groupBy("pair").agg(F.count("*").alias("pairs")).where("pairs > 1"))
    total = pairs.agg(F.sum("pairs")).first()[0]
    if not total:
        return rows.withColumn("repeat", F.lit(None).cast("long"))
    marked = attach(rows.withColumn("pair", pair), pairs.withColumn("many", F.lit(True)), "pair", "pairs", rows.count())
    again = cut(marked.where("many").withColumn("number", F.monotonically_increasing_id()))
    first = cut(again.groupBy("pair").agg(F.min("number").alias("first"), F.count("*").alias("pairs")))
    again = attach(again, first, "pair", "pairs", total).withColumn("repeat", F.when(F.col("number") != F.col("first"), F.col("number")))
    return marked.where("many is null").withColumn("repeat", F.lit(None).cast("long")).drop("pair", "many").unionByName(again.drop("pair", "many", "number", "first"))


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page with its payload's size and digest, and `refers_to`: the page that holds the same payload, or null.

    Equal payloads are those of one SHA-1 and length. A payload of a third of the pages is one entry of a
    small table that `attach` joins without gathering those pages in a task.
    """
    rows = _numbered(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload")))
    rows = rows.withColumn("same", F.when(F.col("bytes") >= LEAST_BYTES, F.concat_ws(":", "sha1", F.col("bytes").cast("string"))))
    groups = rows.where("same is not null").groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1"))
    joined = attach(rows, groups, "same", "n", pages.count())
    return joined.withColumn("refers_to", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))).drop("last", "same")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """A request, a response or revisit and a metadata record for each page, in one gzipped file per task.

    The request and the metadata name the response in WARC-Concurrent-To. Control characters and blanks of
    a url are percent-encoded, as they would end the header line. A null url has no WARC-Target-URI, a null
    html an empty payload. Files hold what the input's partitions hold.
    """
    rows = captures(pages, page_id, url, html)
    uri = F.col("url")
    for code in (0x09, 0x0A, 0x0D, 0x20):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    uri = F.regexp_replace(uri, r"[\x00-\x20\x7F]", "%20")
    target, digest = ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    own = [F.col("page_id"), F.col("sha1"), F.col("repeat")]
    main = record_id("response", *own)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    kind = ("Content-Type", F.lit("application/http;msgtype=response"))
    response = _record("response", main, [target, digest, kind], F.concat(http, F.col("payload")))
    refers = ("WARC-Refers-To", record_id("response", F.col("refers_to"), F.col("sha1"), F.lit(None)))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    revisit = _record("revisit", main, [target, digest, refers, profile, kind], http)
    with_main = ("WARC-Concurrent-To", main)
    get = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}"))
    request = _record("request", record_id("request", *own), [target, with_main, ("Content-Type", F.lit("application/http;msgtype=request"))], get)
    facts = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(END))
    metadata = _record("metadata", record_id("metadata", *own), [target, with_main, ("Content-Type", F.lit("application/warc-fields"))], facts)
    records = F.array(request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata)
    lines = rows.select(F.explode(records).alias("value"))
    lines.write.mode("errorifexists").option("lineSep", END * 2).option("compression", "gzip").text(folder)


# -- reading ----------------------------------------------------------------------------------------

RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, content_type string, digest string, block binary, payload_bytes long, payload_sha1 string"


def _parse(head: bytes, block: bytes, keep: bool) -> dict:
    lines = head.decode("utf-8", "replace").split(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = fields.get("content-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if kind.startswith("application/http") else block
    get = lambda name: fields.get(f"warc-{name}")
    small = get("type") not in ("response", "resource", "conversion")
    return {
        "record_id": get("record-id"), "type": get("type"), "concurrent_to": get("concurrent-to"), "refers_to": get("refers-to"), "uri": get("target-uri"), "date": get("date"), "content_type": kind or None,
        "digest": (get("payload-digest") or "").rpartition(":")[2].lower() or None, "block": block if keep or small else None, "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest(),
    }


def read_records(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """A row per record of gzipped archives. `blocks`: keep the blocks of responses too, else only their size and digest.

    The text reader streams each file cut at what ends one record and starts the next. A payload that holds
    those bytes is put together again by Content-Length, so memory is bounded by one record.
    """
    prepare(spark)
    # a gzipped file is read by one task from its start, so pieces come in order
    pieces = spark.read.option("lineSep", BETWEEN.decode()).text(folder).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole, at = [], 0, None, None  # pieces of the open record, their bytes, and how many it has
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "block" else pa.string() for n in names]
        for batch in batches:
            out = []
            for piece, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != at:
                    held, size, whole, at = [], 0, None, file
                    piece = piece.removeprefix(b"WARC/")
                held.append(piece)
                size += len(piece) + (len(BETWEEN) if len(held) > 1 else 0)
                if whole is None:
                    head, blank, _ = BETWEEN.join(held).partition(b"\r\n\r\n")
                    if not blank:
                        continue
                    length = int(next((x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0"))
                    whole = len(head) + 4 + length
                if size >= whole:
                    data = BETWEEN.join(held)
                    out.append(_parse(head, data[len(head) + 4 : whole], blocks))
                    held, size, whole = [], 0, None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return pieces.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, n_requests, n_metadata.

    A capture is a response or revisit with the records that name it in WARC-Concurrent-To. One shuffle by
    that id joins the three; of several requests or metadata records of a capture the one with the smallest
    record id is nested and the others are counted, so a row stays bounded. Records that name a capture that
    isn't there give a row with a null response.
    """
    main = F.col("type").isin("response", "revisit", "resource")
    whole = F.struct(*(c for c in records.columns))
    pick = lambda kind: F.min(F.when(kind, whole))
    request, metadata = F.col("type") == "request", F.col("type") == "metadata"
    keyed = records.where(main | request | metadata).withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    return keyed.groupBy("capture_id").agg(
        pick(main).alias("response"), pick(request).alias("request"), pick(metadata).alias("metadata"), F.count(F.when(request, 1)).alias("n_requests"), F.count(F.when(metadata, 1)).alias("n_metadata")
    )


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive `pages(page_id, url, html)` and return what the archives say: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    Size and digest are computed from the bytes that were read; those of a revisit come from the response it
    names. One row per row of `pages`: rows that repeat page_id and payload are captures with ids of their own, and of
    those with the largest page_id all are responses, the first of which is referred to. Null html: an empty payload.
    Null ids are written, and never are referred to unless no id is there. An empty table gives an empty result.
    Without a `folder` the archives go to the shared one and are deleted once they were read.
    """
    spark = pages.sparkSession
    own, folder = folder is None, folder or shared_folder(spark, "warc")
    write_archives(pages, folder)
    nested = assemble(read_records(spark, folder, blocks=False))
    page = F.expr("try_cast(regexp_extract(cast(metadata.block as string), 'page-id: (-?[0-9]+)', 1) as bigint)")
    flat = nested.where("response is not null").select(
        "capture_id", page.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("named"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha1").alias("payload_digest"),
    )
    flat = cut(flat)
    if own:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    named = flat.where("named is not null").groupBy("named").agg(F.count("*").alias("n"))
    kept = flat.where("record_type = 'response'").select(F.col("capture_id").alias("named"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"))
    table = cut(named.join(kept, "named"))
    joined = attach(flat, table, "named", "n", flat.count())
    return joined.select(
        "page_id", F.coalesce("to_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("to_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to")
    )
