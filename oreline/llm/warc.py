"""WARC archives: writing captures as transactions, and assembling transactions from archives.

A capture is three records: the request, the response (or a revisit, if the payload is that of an
earlier capture) and metadata. Response and metadata name the request in WARC-Concurrent-To.

Writing is Spark's text sink with the WARC record separator between rows, gzip-compressed. Reading is
Spark's text source, split at the version line. A payload may hold that line too, so the
pieces of a file are put together again until a record has its Content-Length. Spark never splits
gzip files, so the pieces of a file come to one task in order, one record in memory at a time;
the writer begins a new archive after ``CAPTURES_PER_FILE`` captures.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.llm.common import Scratch, ship_package

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
LINE, RECORD_END = "\r\n", "\r\n\r\n"
HEAD_END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CAPTURES_PER_FILE = 8192
RECORDS = (
    "file string, record_id string, record_type string, concurrent_to string, refers_to string,"
    " target_uri string, date string, payload_digest string, payload_bytes long,"
    " http_head string, fields map<string,string>, payload binary, intact boolean"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 base32 digits: 5 hexadecimal digits are 4 of base32."""
    digest = F.sha1(payload)
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digit = F.shiftright(bits, shift).bitwiseAND(31) + 1
            parts.append(F.substring(F.lit(BASE32), digit, F.lit(1)))
    return F.concat(*parts)


def _urn(*parts: Column) -> Column:
    """A record id that is a function of the parts."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without its separator; headers that are null are left out."""
    lines = [F.lit(VERSION)]
    for name, value in headers:
        lines.append(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(LINE, *lines), F.lit(RECORD_END), block)


def write(captures: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least: int = 0) -> None:
    """Write a WARC transaction for every row of ``captures`` (page_id, url, payload string).

    Of rows with equal payloads of at least ``least`` bytes those with the smallest page_id are responses
    and the others revisits of them; smaller payloads are always responses. Null payloads are
    empty. A row without page_id is a response if no row with its payload has one, and refers to
    nothing. Null urls have no WARC-Target-URI; blanks and control characters in urls are
    percent-encoded. ``date`` stands in all records.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    rows = captures.select("page_id", "url", payload.alias("payload")).select(
        "*",
        base32_sha1(F.col("payload").cast("binary")).alias("digest"),
        F.octet_length("payload").cast("long").alias("bytes"),
    )
    firsts = (
        rows.filter(F.col("bytes") >= least)
        .groupBy("digest", "bytes")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first")
    )
    rows = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    first = F.col("first")
    revisit = first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    url = F.col("url")
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    url = F.when(F.col("url").rlike("[\\x00-\\x20\\x7f]"), url).otherwise(F.col("url"))
    # The capture's own id is drawn, so that equal rows are captures of their own; the id of a response
    # is a function of page and payload, by which revisits find it.
    rows = rows.select(
        F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("capture"),
        F.col("page_id").cast("string").alias("page_id"),
        url.alias("url"),
        "payload",
        "bytes",
        F.concat(F.lit("sha1:"), F.col("digest")).alias("digest"),
        revisit.alias("revisit"),
        F.when(~revisit, _urn(F.lit("response"), F.col("page_id"), F.col("digest"))).alias("own_id"),
        F.when(revisit, _urn(F.lit("response"), first, F.col("digest"))).alias("refers_to"),
    )

    def named(kind: str) -> Column:
        # Revisits and metadata get ids of their own from the capture's.
        return _urn(F.lit(kind), F.col("capture"))

    common: list[tuple[str, Column | str]] = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(RECORD_END),
    )
    answer = [
        *common,
        ("WARC-Concurrent-To", F.col("capture")),
        ("WARC-Payload-Digest", F.col("digest")),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    request = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{RECORD_END}"))
    about = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page_id: "), "page_id", F.lit(LINE)))
    records = F.array(
        _record(
            [
                ("WARC-Type", "request"),
                ("WARC-Record-ID", F.col("capture")),
                *common,
                ("Content-Type", "application/http; msgtype=request"),
            ],
            request,
        ),
        F.when(
            F.col("revisit"),
            _record(
                [
                    ("WARC-Type", "revisit"),
                    ("WARC-Record-ID", named("revisit")),
                    ("WARC-Refers-To", F.col("refers_to")),
                    ("WARC-Profile", REVISIT_PROFILE),
                    *answer,
                ],
                http,
            ),
        ).otherwise(
            _record(
                [("WARC-Type", "response"), ("WARC-Record-ID", F.col("own_id")), *answer],
                F.concat(http, "payload"),
            )
        ),
        _record(
            [
                ("WARC-Type", "metadata"),
                ("WARC-Record-ID", named("metadata")),
                *common,
                ("WARC-Concurrent-To", F.col("capture")),
                ("Content-Type", "application/warc-fields"),
            ],
            F.coalesce(about, F.lit("")),
        ),
    )
    (
        rows.select(F.explode(records).alias("value"))
        .write.mode("overwrite")
        .option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * CAPTURES_PER_FILE)
        .text(folder)
    )


def _headers(head: bytes) -> dict[str, str]:
    headers = {}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        headers.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return headers


def _needed(data: bytes, path: str) -> int | None:
    """How many bytes a record takes, read from its headers; None while they are not complete."""
    head, end, _ = data.partition(HEAD_END)
    if not end:
        return None
    try:
        return len(head) + len(end) + int(_headers(head)["content-length"])
    except (KeyError, ValueError):
        raise ValueError(f"{path}: a WARC record without Content-Length") from None


def _parse(data: bytes, path: str, needed: int) -> dict:
    """A record from its bytes behind the version line, of which it takes ``needed``."""
    head, _, rest = data[:needed].partition(HEAD_END)
    headers, block = _headers(head), rest
    kind = headers.get("warc-type", "")
    row = {
        "file": path,
        "record_id": headers.get("warc-record-id"),
        "record_type": kind,
        "concurrent_to": headers.get("warc-concurrent-to"),
        "refers_to": headers.get("warc-refers-to"),
        "target_uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
    }
    digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    row |= {"payload_digest": digest, "fields": None, "http_head": None, "payload": None}
    row |= {"payload_bytes": None, "intact": None}
    if kind == "metadata":
        lines = block.decode("utf-8", "replace").split("\r\n")
        row["fields"] = [tuple(x.split(": ", 1)) for x in lines if ": " in x]
    elif kind in ("response", "revisit", "request"):
        http, _, payload = block.partition(b"\r\n\r\n")
        row["http_head"] = http.decode("utf-8", "replace")
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            row |= {"payload": payload, "payload_bytes": len(payload)}
            row |= {"payload_digest": found, "intact": digest in (None, found)}
        elif kind == "revisit":
            for line in row["http_head"].split("\r\n"):
                name, _, value = line.partition(":")
                if name.strip().lower() == "content-length" and value.strip().isdigit():
                    row["payload_bytes"] = int(value)
    return row


def _records(schema: pa.Schema):
    names = schema.names
    mark = (VERSION + LINE).encode()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, open_parts, rows, held = None, [], [], 0
        length, needed = 0, None  # bytes of the open parts, and of the record that they begin

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], schema.field(n).type) for n in names], schema=schema
            )

        def unfinished() -> None:
            if open_parts and b"".join(open_parts).strip():
                raise ValueError(f"{path}: the last WARC record is cut off")

        for batch in batches:
            for file, piece in zip(batch.column(0), batch.column(1), strict=True):
                file, piece = file.as_py(), piece.as_py() or b""
                if file != path:
                    unfinished()
                    path, open_parts = file, []
                    if not piece:  # what stands before the first version line
                        continue
                length = length + len(mark) + len(piece) if open_parts else len(piece)
                if not open_parts:
                    needed = None
                open_parts.append(piece)
                if needed is None:
                    if len(open_parts) > 1:  # the headers go on
                        open_parts = [mark.join(open_parts)]
                    needed = _needed(open_parts[0], path)
                if needed is not None and length >= needed:
                    rows.append(_parse(mark.join(open_parts), path, needed))
                    held += length
                    open_parts = []
                if held > 8 << 20:
                    yield out()
                    rows, held = [], 0
        unfinished()
        if rows:
            yield out()

    return parse


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the gzip archives in ``folder``, as ``RECORDS`` names the columns.

    Payloads are those of responses, with their own length and digest; ``intact`` tells whether the digest
    in the header agrees. For revisits length and digest are those that the record states. Unknown
    record types keep their headers. A record without length, and an archive cut off within a
    record, raise an error that names the file. A folder of empty archives gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(spark)
    kind = spark.createDataFrame([], RECORDS).schema
    lines = (
        spark.read.option("lineSep", VERSION + LINE)
        .schema("value string")
        .text(folder)
        .select("_metadata.file_path", F.col("value").cast("binary").alias("piece"))
    )
    return lines.mapInArrow(_records(to_arrow_schema(kind)), kind)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request, response, metadata (structs; null if missing).

    A capture is known by its request's record id, which response (or revisit) and metadata
    are concurrent to. A response without the request's record is a capture all the same, as are metadata
    alone. A record that is concurrent to nothing is a capture of its own.
    """
    parts = [c for c in records.columns if c != "concurrent_to"]
    own = F.coalesce("concurrent_to", "record_id")

    def of(kind: Column, name: str) -> DataFrame:
        key = F.col("record_id") if name == "request" else own
        return records.filter(kind).select(key.alias("capture"), F.struct(*parts).alias(name))

    kind = F.col("record_type")
    request = of(kind == "request", "request")
    response = of(kind.isin("response", "revisit"), "response")
    metadata = of(kind == "metadata", "metadata")
    return response.join(request, "capture", "full").join(metadata, "capture", "full")


def captures(records: DataFrame) -> DataFrame:
    """The assembled captures, with page_id and, for revisits, the page_id they refer to (refers_to).

    Both are strings, from the metadata; null where the archives have none.
    """
    whole = assemble(records).withColumn("page_id", F.col("metadata.fields")["page_id"])
    originals = (
        whole.filter("response.record_type = 'response'")
        .select(F.col("response.record_id").alias("_original"), F.col("page_id").alias("refers_to"))
        .distinct()
    )
    found = F.col("response.refers_to") == F.col("_original")
    return whole.join(originals, found, "left").drop("_original")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back.

    Returns what ``captures`` returns, with payload lengths and digests computed from the payloads read, but
    without the payloads: they are parsed once, and the rest of each record is kept as a table. Null
    and empty pages have an empty payload. An empty table gives no captures.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    write(pages.select("page_id", "url", F.col("html").alias("payload")), folder, least=least)
    return captures(scratch.keep(read_records(spark, folder).drop("payload"), "records"))


ORACLE = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
           substr('{BASE32}', CAST((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::INTEGER
                  >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
