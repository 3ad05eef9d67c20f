"""Web archives (WARC 1.1): written from pages, read back with segments reassembled.

Each archive is a part file of Spark's text writer: a row is a record and the
line separator is the blank line pair that ends a record, so that Spark's own
commit protocol makes the files survive lost tasks. Archives are gzip files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import NO_ID, join_counted, own_id
from tidemark.storage import measured, new_path

END = "\r\n\r\n"
HTTP_HEAD = (
    "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    "Transfer-Encoding: chunked\r\n\r\n"
)
REVISIT_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"

RECORD_SCHEMA = (
    "page_id bigint, record_id string, record_type string, target_uri string, "
    "payload_digest string, refers_to bigint, segment int, total_length bigint, block binary"
)


def _binary(text: str | Column) -> Column:
    return (F.lit(text) if isinstance(text, str) else text).cast("binary")


def _joined(parts: Column) -> Column:
    """Binary pieces in one; strings hold any bytes here and are joined in linear time."""
    return F.array_join(F.transform(parts, lambda p: p.cast("string")), "").cast("binary")


def _chunked(body: Column, size: int) -> Column:
    """The HTTP chunked framing of ``body``."""
    starts = F.when(
        F.length(body) > 0, F.sequence(F.lit(0), F.length(body) - 1, F.lit(size))
    ).otherwise(F.array().cast("array<int>"))

    def chunk(start: Column) -> Column:
        part = F.substring(body, start + 1, F.lit(size))
        return F.concat(_binary(F.lower(F.hex(F.length(part).cast("bigint")))),
                        _binary("\r\n"), part, _binary("\r\n"))

    return F.concat(_joined(F.transform(starts, chunk)), _binary("0\r\n\r\n"))


def archive_rows(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    payload = F.coalesce(pages[payload_column].cast("string"), F.lit(""))
    return pages.select(
        F.coalesce(pages[id_column].cast("bigint"), F.lit(NO_ID)).alias("page"),
        # A header is one line of text.
        F.regexp_replace(F.coalesce(pages[url_column].cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "").alias("url"),
        payload.cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))


def write_warc(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    min_revisit_bytes: int = 100,
    chunk_bytes: int = 8192,
    segment_bytes: int = 16384,
    records_per_file: int = 2000,
    archive_bytes: int = 64_000_000,
) -> None:
    """Write a record per row of ``pages`` to archives below ``path``.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, the one with the
    smallest id is a response and the others revisit it; smaller payloads are
    always responses. Blocks longer than ``segment_bytes`` are segmented into
    continuation records. An archive has ``records_per_file`` records of at most that length,
    fewer where ``archive_bytes`` (before compression) asks for it. A null payload is empty, a null id comes after all
    others, a null URL is empty, and control characters and blanks are taken out
    of URLs. Rows that repeat the smallest id with an equal payload are responses
    too. No rows: no archive.
    """
    rows = archive_rows(pages, id_column, url_column, payload_column)
    large = F.length("payload") >= min_revisit_bytes
    firsts, counts = measured(
        rows.where(large).select("page", "digest").groupBy("digest")
        .agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n"))
        .where("first < last").drop("last"),
        "warc-firsts", total=F.sum("n"),
    )
    # Which rows revisit is settled on ids and digests; payloads never move.
    first_of, other = _first_of(rows.where(large), firsts, counts["total"] or 0)
    revisits = other.select(
        "page", "url", "digest", F.col("first").alias("refers"),
        _binary(REVISIT_HEAD).alias("block"),
    )
    response_block = F.concat(_binary(HTTP_HEAD), _chunked(F.col("payload"), chunk_bytes))
    responses = rows.where(~large).unionByName(first_of).select(
        "page", "url", "digest", F.lit(None).cast("bigint").alias("refers"),
        response_block.alias("block"),
    )
    # A record is a block of at most ``segment_bytes`` and a head of a few hundred.
    per_file = max(1, min(records_per_file, archive_bytes // (segment_bytes + 1024)))
    _write_records(responses.unionByName(revisits), path, segment_bytes, per_file)


def _first_of(rows: DataFrame, firsts: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Rows that keep their payload, and those that revisit another."""
    columns = rows.columns
    if not total:
        return rows, rows.where("false").withColumn("first", F.lit(0).cast("bigint"))
    shared, _ = measured(
        join_counted(rows.select("page", "digest"), firsts, ["digest"], "n", total)
        .where("page <> first").select("page", "digest", "first").distinct(),
        "warc-revisits",
    )
    joined = rows.join(shared, ["page", "digest"], "left")
    return (
        joined.where("first is null").select(*columns),
        joined.where("first is not null").select(*columns, "first"),
    )


def _write_records(records: DataFrame, path: str, segment_bytes: int, per_file: int) -> None:
    name = F.concat(
        F.lit(ID_PREFIX), F.col("page").cast("string"), F.lit(":"),
        F.substring(F.sha2(F.concat_ws("|", "url", "digest"), 256), 1, 32),
    )
    starts = F.sequence(F.lit(0), F.length("block") - 1, F.lit(segment_bytes))
    parts = records.withColumn("name", name).select(
        "*", F.length("block").alias("total"), F.posexplode(starts).alias("part", "at")
    )
    segmented = F.col("total") > segment_bytes
    last = F.col("at") + segment_bytes >= F.col("total")
    piece = F.substring("block", F.col("at") + 1, F.lit(segment_bytes))
    kind = (
        F.when(F.col("part") > 0, "continuation")
        .when(F.col("refers").isNotNull(), "revisit")
        .otherwise("response")
    )

    def header(label: str, value: Column, given: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{label}: "), value.cast("string"), F.lit("\r\n"))
        return line if given is None else F.when(given, line).otherwise("")

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", kind),
        header("WARC-Record-ID", F.concat(F.lit("<"), "name", F.when(F.col("part") > 0, F.concat(F.lit(":"), F.col("part") + 1)).otherwise(""), F.lit(">"))),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("WARC-Profile", F.lit(REVISIT_PROFILE), F.col("refers").isNotNull()),
        header("WARC-Refers-To", F.concat(F.lit(f"<{ID_PREFIX}"), F.col("refers"), F.lit(">")), F.col("refers").isNotNull()),
        header("WARC-Segment-Number", F.col("part") + 1, segmented),
        header("WARC-Segment-Origin-ID", F.concat(F.lit("<"), "name", F.lit(">")), F.col("part") > 0),
        header("WARC-Segment-Total-Length", F.col("total"), segmented & last),
        header("Content-Length", F.length(piece)),
        F.lit("\r\n"),
    )
    (
        parts.select(F.concat(head.cast("binary"), piece).cast("string").alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {
            label.strip().lower(): value.strip()
            for label, _, value in (line.partition(":") for line in lines[1:])
        }
        length = int(headers["content-length"])
        block = content[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError("the archive ends inside a record")
        yield headers, block
        at = end + 4 + length + 4


def unchunked(block: bytes) -> bytes:
    """The payload of an HTTP response; decodes chunked transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not re.search(rb"^transfer-encoding:[^\r\n]*chunked", head, re.I | re.M):
        return body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        parts.append(part)
        at = end + 4 + size


def _gunzip(content: bytes) -> bytes:
    """All members of a gzip file; other content unchanged."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def _page(name: str | None) -> int | None:
    return int(name.strip("<>").removeprefix(ID_PREFIX).split(":")[0]) if name else None


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = pa.schema([
        ("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
        ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
        ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary()),
    ])
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for h, block in parse_records(_gunzip(content.as_py())):
                number = h.get("warc-segment-number")
                total = h.get("warc-segment-total-length")
                origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                rows.append((
                    _page(origin), origin, h["warc-type"], h.get("warc-target-uri"),
                    h.get("warc-payload-digest", "").removeprefix("sha256:"),
                    _page(h.get("warc-refers-to")), int(number) if number else None,
                    int(total) if total else None, block,
                ))
                size += len(block)
                if size > 4_000_000:
                    yield _as_batch(rows, types)
                    rows, size = [], 0
            yield _as_batch(rows, types)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.record_batch(
        [pa.array(column, field.type) for column, field in zip(columns, schema)], schema=schema
    )


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("block")
        decoded = pa.array([unchunked(b.as_py()) for b in batch.column(at)], pa.binary())
        yield batch.set_column(at, pa.field("payload", pa.binary()), decoded)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path`` with their payloads.

    Returns ``page_id, record_id, record_type, target_uri, payload_digest, refers_to,
    payload``. Continuation records join their origin: segments are grouped by the
    origin's identifier, ordered by number and checked for gaps and for the total
    length; a broken record raises. Chunked framing is decoded. A revisit has an empty
    payload. A record that was written several times is returned as often. Archives
    are read one at a time by a task, so keep them to a few hundred MB.
    """
    records = (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        .select("content").mapInArrow(_parse_batches, RECORD_SCHEMA)
    )
    whole = records.where("segment is null").drop("segment", "total_length")
    segments = (
        records.where("segment is not null")
        .groupBy("record_id", "segment")
        .agg(*[F.first(c).alias(c) for c in ("page_id", "record_type", "target_uri", "payload_digest", "refers_to", "total_length", "block")],
             F.count("*").alias("copies"))
        .groupBy("record_id")
        .agg(
            F.first("page_id").alias("page_id"),
            F.min_by("record_type", "segment").alias("record_type"),
            F.min_by("target_uri", "segment").alias("target_uri"),
            F.min_by("payload_digest", "segment").alias("payload_digest"),
            F.min_by("refers_to", "segment").alias("refers_to"),
            F.max("total_length").alias("total_length"),
            F.min("copies").alias("copies"),
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        )
    )
    block = _joined(F.transform("parts", lambda p: p["block"]))
    complete = F.element_at("parts", -1)["segment"] == F.size("parts")
    joined = segments.withColumn("block", block).select(
        "page_id", "record_id", "record_type", "target_uri", "payload_digest", "refers_to",
        F.when(complete & (F.length("block") == F.col("total_length")), F.col("block"))
        .otherwise(F.raise_error(F.concat(F.lit("incomplete segments of "), F.col("record_id"))))
        .alias("block"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
    ).drop("copy")
    schema = RECORD_SCHEMA.replace("segment int, total_length bigint, block", "payload")
    return whole.unionByName(joined).mapInArrow(_decode_batches, schema)


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages``, read the archives back, and give every record its full payload's digest.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Digests are
    taken from the payload that was read and must agree with the record's header. A revisit
    takes the length from the response that it refers to.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, **options)
    found, counts = measured(
        read_warc(spark, path).select(
            "page_id", "record_type", "refers_to",
            F.col("payload_digest").alias("stated"), F.length("payload").cast("bigint").alias("bytes"),
            F.when(F.col("record_type") == "response", F.sha2("payload", 256)).alias("digest"),
        ),
        "warc-read", revisits=F.count("refers_to"),
    )
    checked = F.when(F.col("digest") == F.col("stated"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload digest differs: page "), F.col("page_id")))
    )
    responses = found.where("record_type = 'response'").select(
        own_id("page_id").alias("page_id"), F.col("bytes").alias("payload_bytes"),
        checked.alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"),
    )
    revisits = found.where("record_type = 'revisit'").select("page_id", "stated", "refers_to")
    per_target = revisits.groupBy("refers_to", "stated").agg(F.count("*").alias("n"))
    targets, _ = measured(
        per_target.join(
            found.where("record_type = 'response'")
            .select(F.col("page_id").alias("refers_to"), F.col("digest").alias("stated"), "bytes").distinct(),
            ["refers_to", "stated"],
        ),
        "warc-targets",
    )
    resolved = join_counted(revisits, targets, ["refers_to", "stated"], "n", counts["revisits"] or 0)
    return responses.unionByName(
        resolved.select(
            own_id("page_id").alias("page_id"), F.col("bytes").alias("payload_bytes"),
            F.col("stated").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to",
        )
    )
