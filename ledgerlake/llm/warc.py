"""WARC archives as a chunked record table.

Writing: each page becomes one WARC record (``response``, or ``revisit`` of
the page that keeps an equal payload). Payloads over ``SEGMENT`` characters
are laid out as WARC segments (``continuation`` records). The records are
written by Spark's text writer, one row per physical line, into gzip files of
any file system Spark knows; no task ever builds a whole archive.

Reading: each archive is streamed line by line through a small state machine
that emits the *chunked record table*: rows (record, chunk number, bytes,
running SHA-1), at most ``CHUNK`` bytes of payload each, so an oversized record
is many rows and is never held whole. The last chunk of a record carries the
whole payload's length and digest. Segments continue their record's chunks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import ensure_checkpoint_dir

from .common import small_side, table

SEGMENT = 1 << 18      # characters of payload in one physical record
CHUNK = 1 << 18        # bytes of payload in one row of the table
REVISIT_FROM = 1000    # smallest payload, in bytes, that is stored once
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column, digest: Column, part: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), digest, part.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[
        F.concat(F.lit("-"), F.substring(h, at, n)) for at, n in ((9, 4), (13, 4), (17, 4), (21, 12))], F.lit(">"))


def typed_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """(_ll_page, _ll_url, _ll_html, _ll_digest, _ll_bytes, _ll_keeper): the
    keeper is the page whose record holds an equal payload, null for a
    response."""
    rows = pages.select(F.col(id_col).alias("_ll_page"), F.col(url_col).alias("_ll_url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("_ll_html"))
    rows = rows.withColumn("_ll_digest", F.sha1(F.col("_ll_html").cast("binary"))).withColumn(
        "_ll_bytes", F.octet_length("_ll_html").cast("long"))
    shared = small_side(rows.where(F.col("_ll_bytes") >= REVISIT_FROM)
                        .groupBy(F.col("_ll_digest").alias("_ll_same"))
                        .agg(F.max("_ll_page").alias("_ll_keeper"), F.count("*").alias("c"))
                        .where("c > 1 AND _ll_keeper IS NOT NULL").drop("c"))
    # digests of small payloads never match: only large ones are listed
    rows = rows.join(shared, F.col("_ll_digest") == F.col("_ll_same"), "left")
    own = F.col("_ll_page").eqNullSafe(F.col("_ll_keeper"))
    return rows.withColumn("_ll_keeper", F.when(~own, F.col("_ll_keeper"))).drop("_ll_same")


def record_lines(records: DataFrame) -> DataFrame:
    """Physical lines (without their ``\\n``) of all records, in order."""
    crlf = "\r\n"
    page, digest, html = F.col("_ll_page"), F.col("_ll_digest"), F.col("_ll_html")
    # line ends inside a url would end the header
    url = F.regexp_replace(F.regexp_replace("_ll_url", "\r", "%0D"), "\n", "%0A")
    parts = F.greatest(F.lit(1), F.ceil(F.char_length(html) / F.lit(SEGMENT))).cast("int")

    def header(kind, part, length, *more):
        return F.concat(
            F.lit(f"WARC/1.1{crlf}WARC-Type: "), kind, F.lit(f"{crlf}WARC-Record-ID: "), _record_id(page, digest, part),
            F.lit(f"{crlf}WARC-Date: {DATE}"),
            F.coalesce(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), url), F.lit("")),
            F.coalesce(F.concat(F.lit(f"{crlf}X-Page-Id: "), page.cast("string")), F.lit("")),
            F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), digest, *more,
            F.lit(f"{crlf}Content-Length: "), length.cast("string"), F.lit(crlf + crlf))

    def segment(i):
        piece = F.substring(html, i * SEGMENT + 1, F.lit(SEGMENT))
        piece = F.when(parts == 1, html).otherwise(piece)
        http = F.when(i == 0, F.concat(
            F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "),
            F.col("_ll_bytes").cast("string"), F.lit(crlf + crlf))).otherwise("")
        number = F.when(parts > 1, F.concat(F.lit(f"{crlf}WARC-Segment-Number: "), (i + 1).cast("string"))).otherwise("")
        origin = F.when(i > 0, F.concat(F.lit(f"{crlf}WARC-Segment-Origin-ID: "), _record_id(page, digest, F.lit(0)))).otherwise("")
        total = F.when((i > 0) & (i == parts - 1), F.concat(
            F.lit(f"{crlf}WARC-Segment-Total-Length: "), F.col("_ll_bytes").cast("string"))).otherwise("")
        kind = F.when(i == 0, F.lit("response")).otherwise(F.lit("continuation"))
        media = F.when(i == 0, F.lit(f"{crlf}Content-Type: application/http; msgtype=response")).otherwise("")
        body = F.concat(http, piece)
        return F.concat(header(kind, i, F.octet_length(body), media, number, origin, total), body, F.lit(crlf + "\r"))
    stored = F.transform(F.sequence(F.lit(0), parts - 1), segment)
    revisit = F.concat(header(
        F.lit("revisit"), F.lit("revisit"), F.lit(0), F.lit(f"{crlf}WARC-Profile: {PROFILE}"),
        F.lit(f"{crlf}WARC-Refers-To: "), _record_id(F.col("_ll_keeper"), digest, F.lit(0))), F.lit(crlf + "\r"))
    rec = F.explode(F.when(F.col("_ll_keeper").isNull(), stored).otherwise(F.array(revisit))).alias("_ll_rec")
    return records.select(rec).select(F.explode(F.split("_ll_rec", "\n", -1)).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> None:
    """One gzip WARC file per task under ``path``; records are not split
    between files. Null payloads are empty, a null url or id leaves its header
    out."""
    (record_lines(typed_records(pages, id_col, url_col, html_col))
     .write.option("compression", "gzip").option("lineSep", "\n").text(path))


TABLE = ("record_id string, record_type string, page_id string, target_uri string, refers_to string, "
         "declared string, chunk_no int, payload binary, bytes_so_far long, sha1_so_far string, last boolean, complete boolean")


class _Records:
    """State of one archive stream: fed lines, collects rows of the table."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.weight = 0
        self.state = "between"
        self.head: dict[str, str] = {}
        self.left = 0                     # bytes of the block still to come
        self.http = False                 # inside the HTTP header of the block
        self.open: dict | None = None     # the record whose chunks are being made

    def chunk(self, last: bool, complete: bool = True) -> None:
        o = self.open
        data = bytes(o["data"])
        o["sha"].update(data)
        o["n"] += len(data)
        h = o["head"]
        self.rows.append((
            h.get("warc-record-id"), h.get("warc-type"), h.get("x-page-id"), h.get("warc-target-uri"),
            h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            o["no"], data, o["n"], o["sha"].copy().hexdigest(), last, complete))
        self.weight += len(data)
        o["no"] += 1
        o["data"] = bytearray()

    def close(self, complete: bool = True) -> None:
        if self.open is not None:
            self.chunk(True, complete)
            self.open = None

    def end(self) -> None:
        """End of the file; a record cut short is marked."""
        self.close(self.state == "between")
        self.state = "between"

    def begin_block(self) -> None:
        h = self.head
        self.left = int(h.get("content-length", "0"))
        more = h.get("warc-type") == "continuation"
        if not (more and self.open and self.open["head"].get("warc-record-id") == h.get("warc-segment-origin-id")):
            self.close()
            self.open = {"head": h, "no": 0, "n": 0, "sha": hashlib.sha1(), "data": bytearray()}
        self.http = not more and h.get("content-type", "").startswith("application/http") and self.left > 0
        self.state = "block" if self.left else "between"

    def feed(self, line: bytes) -> None:
        if self.state == "block":
            data = line + b"\n"
            if len(data) > self.left:
                data = data[:self.left]
            self.left -= len(data)
            if self.http:
                self.http = data not in (b"\r\n", b"\n")
            else:
                at = 0
                while at < len(data):
                    take = data[at:at + CHUNK - len(self.open["data"])]
                    self.open["data"] += take
                    at += len(take)
                    if len(self.open["data"]) >= CHUNK:
                        self.chunk(False)
            if not self.left:
                self.state = "between"
        elif self.state == "head":
            line = line.rstrip(b"\r")
            if line:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                self.head[name.strip().lower()] = value.strip()
            else:
                self.begin_block()
        elif line.startswith(b"WARC/"):
            self.state, self.head = "head", {}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 6 + [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    names = [x.split()[0] for x in TABLE.split(", ")]
    state, file = _Records(), None

    def flush():
        columns = list(zip(*state.rows))
        state.rows, state.weight = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
    for batch in batches:
        for line, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if of != file:
                state.end()
                file = of
            state.feed(line)
            if state.weight > 1 << 24 or len(state.rows) >= 10_000:
                yield flush()
        if state.rows:
            yield flush()
    state.end()
    if state.rows:
        yield flush()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Chunked record table of gzip WARC files (a gzip file is read by one
    task, from its start): ``record_id``, ``record_type``, ``page_id``,
    ``target_uri``, ``refers_to``, ``declared`` (payload digest of the
    header), ``chunk_no``, ``payload``, ``bytes_so_far``, ``sha1_so_far``,
    ``last``, ``complete`` (false in the last chunk of a record that its file
    cuts short). Empty folders give no rows."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"),
                        F.xxhash64(F.input_file_name()).alias("file")).mapInArrow(_parse, TABLE)


def page_records(chunks: DataFrame) -> DataFrame:
    """One row per stored page from the last chunks of the table: (page_id
    string, payload_bytes, payload_digest, record_type, refers_to page).
    A revisit takes length and digest from the record it refers to."""
    last = chunks.where("last").select(
        "record_id", "page_id", F.col("record_type"), F.col("refers_to").alias("to"),
        F.col("bytes_so_far").alias("n"), F.col("sha1_so_far").alias("sha"))
    held = (last.where("record_type = 'response'").groupBy(F.col("record_id").alias("held"))
            .agg(F.max("page_id").alias("held_page"), F.max("n").alias("held_n"), F.max("sha").alias("held_sha")))
    back = last.where("record_type = 'revisit'").join(held, F.col("to") == F.col("held"), "left")
    return (last.where("record_type = 'response'")
            .select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
                    "record_type", F.lit(None).cast("string").alias("refers_to"))
            .unionByName(back.select("page_id", F.col("held_n").alias("payload_bytes"),
                                     F.col("held_sha").alias("payload_digest"), "record_type",
                                     F.col("held_page").alias("refers_to"))))


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """Write the pages as archives under ``path`` (a new folder beside the
    session's checkpoints if none is given) and read them back: see
    :func:`page_records`, ids in their own type.

    Defined cases: a null payload is empty; payloads under 1000 bytes are all
    responses; among equal larger ones the largest id responds and rows
    without id always revisit it (all respond if none has an id); rows that
    repeat the largest id all respond; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    out = page_records(read_archives(spark, path))
    return out.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast(kind).alias("refers_to"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM s WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM s LEFT JOIN k USING (payload_digest)
"""
