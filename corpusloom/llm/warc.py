"""A content-addressed WARC archive: payloads once by SHA-256, exact record headers apart, joined on reading.

``write_warc`` writes WARC/1.1 files, ``parse_warc`` reads the bytes of such files by their Content-Length,
``store`` puts what is parsed into two tables, and ``read_archive`` joins these to the original records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LISTED, as_bytes, listed, staged

#: Smaller payloads are always written as responses of their own.
LEAST_REVISIT = 100
#: What a record begins with.
VERSION = "WARC/1.1\r\n"


def _records(pages: DataFrame, date: str, least_revisit: int, stretch: int) -> DataFrame:
    """(page, record_id, digest, header, http, small, fetched) of each page: all of its record but a payload to be fetched.

    Payloads below ``least_revisit`` bytes go along as ``small``; ``fetched`` records need theirs."""
    n = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    slim = pages.select("page_id", uri.alias("uri"), n.alias("n"), digest.alias("digest"), F.when(n < least_revisit, F.col("html")).alias("small"))
    rows = staged(slim.groupBy("page_id", "uri", "n", "digest").agg(F.count("*").alias("times"), F.any_value("small").alias("small")), "pages")
    # staged, so that the pages of a very common payload are split between tasks as they meet it
    first = staged(rows.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "uri")).alias("first")), "first")
    rows = listed(rows, "times", "i", "digest", "page_id", "uri", stretch=stretch).withColumn("i", F.col("i") + 1).join(first, "digest")
    owner = (F.col("i") == 1) & F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("uri") == F.col("first.uri"))

    def record_id(page, uri, i):
        h = F.sha2(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), uri, "digest", i), 256)
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))

    rows = rows.withColumn("response", owner | (F.col("n") < least_revisit)).withColumn("fetched", owner & (F.col("n") >= least_revisit))
    rows = rows.withColumn("record_id", record_id(F.col("page_id"), F.col("uri"), F.col("i").cast("string")))
    rows = rows.withColumn("first_id", record_id(F.col("first.page_id"), F.col("first.uri"), F.lit("1")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    rows = rows.withColumn("http", http)
    block = F.octet_length("http") + F.when(F.col("response"), F.col("n")).otherwise(0)
    lines = [
        F.concat(F.lit(VERSION + "WARC-Type: "), F.when(F.col("response"), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
        F.when(~F.col("response"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), F.col("first_id"))),
        F.when(~F.col("response") & F.col("first.page_id").isNotNull(), F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("first.page_id").cast("string"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page")
    return rows.select(page, "record_id", "digest", header.alias("header"), "http", F.when(F.col("response"), F.coalesce("small", F.lit(""))).otherwise("").alias("small"), "fetched")


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_revisit: int = LEAST_REVISIT, stretch: int = LISTED) -> None:
    """Write the records of (page_id, url, html) as gzipped WARC files under ``path``.

    Of equal payloads of ``least_revisit`` bytes or more, the page with the smallest page_id (then url) is
    the response, the others revisit it; smaller ones are all responses. Null html is an empty payload, a null
    url an empty URI, a null page_id larger than any other; of repeated rows one is the response. Line breaks
    are taken out of URIs. Rows that repeat more than ``stretch`` times are listed by several tasks. Other columns are ignored."""
    records = staged(_records(pages, date, least_revisit, stretch), "records")
    large = pages.filter(F.octet_length("html") >= least_revisit)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page")  # not null: the join's partitioning then serves the next step
    bodies = large.select(page, F.sha2(F.col("html").cast("binary"), 256).alias("digest"), "html")
    fetched = bodies.join(records.filter("fetched").select("digest", "page", "header", "http"), ["digest", "page"]).dropDuplicates(["digest", "page"])
    rest = records.filter("not fetched").select("header", "http", F.col("small").alias("html"))
    # a file's lines end with a line feed: the last byte of a record
    lines = fetched.select("header", "http", "html").unionByName(rest).select(F.concat("header", "http", "html", F.lit("\r\n\r")))
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def parse_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, digest, type, header, http, payload) of the records in gzipped WARC files, by their bytes.

    A file is cut at every version line, and pieces are put together again until a record has its
    Content-Length, so that version lines within payloads do no harm. Spark reads a gzipped file in one task;
    it holds one record at a time. Plain files, which it would cut anywhere, are refused. ``payload`` is null where a record has none, or for all without ``payloads``. A file
    that ends within a record, or holds anything between two, stops the job."""
    pieces = spark.read.option("lineSep", VERSION).text(path).select("_metadata.file_path", F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, size, need = None, [], 0, None

        def record() -> tuple:
            head, _, block = b"".join(held).partition(b"\r\n\r\n")
            http, _, body = block[:-4].partition(b"\r\n\r\n")
            fields = dict(re.findall(rb"\r\n([^:\r\n]+): *([^\r\n]*)", head))
            kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
            return fields[b"WARC-Record-ID"].decode(), digest, kind, head + b"\r\n\r\n", http + b"\r\n\r\n", body if payloads and kind == "response" else None

        for batch in batches:
            out, bytes_out = [], 0
            for name, piece in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if name != file:
                    if held:
                        raise ValueError(f"a record is cut off at the end of {file}")
                    file = name
                    if not file.endswith(".gz"):
                        raise ValueError(f"{file} is not gzipped")
                    if not piece:
                        continue  # what is before a file's first version line
                held += [VERSION.encode(), piece]
                size += len(VERSION) + len(piece)
                if need is None and b"\r\n\r\n" in piece:
                    head = b"".join(held).partition(b"\r\n\r\n")[0]
                    need = len(head) + 8 + int(re.search(rb"\r\nContent-Length: *(\d+)", head)[1])
                if need is None or size < need:
                    continue
                if size > need or not piece.endswith(b"\r\n\r\n"):
                    raise ValueError(f"a record in {file} is not as long as it says")
                out.append(record())
                bytes_out, held, size, need = bytes_out + size, [], 0, None
                if bytes_out > 8 << 20 or len(out) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                    out, bytes_out = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
        if held:
            raise ValueError(f"a record is cut off at the end of {file}")

    names, types = ["record_id", "digest", "type", "header", "http", "payload"], [pa.string()] * 3 + [pa.binary()] * 3
    return pieces.mapInArrow(run, "record_id string, digest string, type string, header binary, http binary, payload binary")


def _matching(value: Column) -> Column:
    """A value of a payload whose digest is the one it is stored under; another one stops the job."""
    return F.when(F.sha2("payload", 256) == F.col("digest"), value).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), "digest")))


def store(spark: SparkSession, warc_path: str, path: str) -> None:
    """Parse WARC files into the tables ``headers`` and ``payloads`` under ``path``: each payload once, by its verified digest.

    The files are parsed twice, so that only the headers are grouped; of responses with one digest the one
    with the smallest record id gives the payload."""
    heads = parse_warc(spark, warc_path, payloads=False)
    heads.select("record_id", "digest", "type", "header", "http").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    responses = spark.read.parquet(f"{path}/headers").filter("type = 'response'")
    owners = responses.groupBy("digest").agg(F.min("record_id").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    spare = staged(responses.join(staged(owners, "owners"), "digest").filter("record_id <> owner").select("record_id"), "spare")
    own = parse_warc(spark, warc_path).filter("type = 'response'").join(spare, "record_id", "left_anti")
    own.select("digest", _matching(F.col("payload")).alias("payload")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def write_archive(pages: DataFrame, path: str, **how) -> None:
    """Write the archive of (page_id, url, html): WARC files, and the tables parsed from them, under ``path``."""
    write_warc(pages, f"{path}/warc", **how)
    store(pages.sparkSession, f"{path}/warc", path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, header, http, payload_bytes, payload_digest, payload, record): the original records put together again.

    ``payload`` is the full payload, for revisits that of the record they refer to; ``record`` holds a
    record's exact bytes. A payload that doesn't have its digest stops the job."""
    heads = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = payloads.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), _matching(F.col("digest")).alias("payload_digest"), _matching(F.col("payload")).alias("payload"))
    joined = heads.join(checked, "digest")
    body = F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("record_id", "header", "http", "payload_bytes", "payload_digest", "payload", F.concat("header", "http", body, F.lit(b"\r\n\r\n")).alias("record"))


def summary(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), parsed from the records' headers."""
    head = F.col("header").cast("string")

    def field(name: str):
        found = F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.when(found != "", found)

    return records.select(
        field("X-Page-ID").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.regexp_extract(head, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )
