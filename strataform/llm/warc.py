"""WARC archives with revisit resolution.

Headers are shuffled by payload digest: of records with equal payloads of ``MIN_PAYLOAD`` bytes or
more, the one with the smallest page_id stays a response and the others become revisits
that refer to it. Archives are written by Spark's text writer (gzip, up to ``MAX_RECORDS`` a file),
with fresh headers, so they work on any store and a lost task is committed once.
Payloads are checked against their Content-Length and digest when they are read back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

MIN_PAYLOAD = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive holds so many records at most, so that a file can be read back in one task.
MAX_RECORDS = 10_000
DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"

_HEADERS = "page_id long, url string, record_type string, refers_to long, payload_digest string, content_length long, digest_ok boolean"
_HEADERS_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("content_length", pa.int64()), ("digest_ok", pa.bool_())])


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest); null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest")
    )


def resolve(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Add refers_to: the page_id of the original response, null for responses.

    ``headers`` has page_id, payload_bytes and payload_digest. The digests are SHA-256, so equal
    digest and size mean equal payload. Null ids are never originals unless their group has no other.
    """
    large = F.col("payload_bytes") >= min_payload
    originals = headers.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("original"))
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return storage.skew_join(headers, originals, "payload_digest", "left").withColumn("refers_to", refers).drop("original")


def _uri(page_id) -> F.col:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _clean(url) -> F.col:
    """A header value: percent-encode what would end the line."""
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def records(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """One column ``value``: each page's WARC record without the two line ends that close it.

    Responses carry their payload; revisits carry none.
    """
    refers = resolved.where("refers_to is not null").select("payload_digest", "page_id", "refers_to").distinct()
    refers = refers.repartition(storage.shuffle_partitions(refers))  # one row a key: adaptive execution may split a hot one's pages
    full = storage.join_null_safe(with_digests(pages), refers, ["payload_digest", "page_id"])
    revisit = F.col("refers_to").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("refers_to")))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return full.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Write deduplicated ``.warc`` archives (gzip) of ``pages`` (page_id, url, html) to a folder.

    Archives come from the tasks of the join that gives each page its original: payloads are shuffled once at most.
    """
    headers = with_digests(pages).select("page_id", "payload_bytes", "payload_digest")
    records(resolve(headers, min_payload), pages).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC stream: headers by lower-case name, and the block."""
    buffer, more = bytearray(), iter(chunks)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            part = next(more, None)
            if part is None:
                return False
            buffer.extend(part)
        return True

    while True:
        while fill(2) and buffer[:2] == b"\r\n":
            del buffer[:2]
        if not fill(1):
            return
        seen = 0
        while (stop := buffer.find(_END, max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("a WARC header does not end")
        lines = bytes(buffer[:stop]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        del buffer[: stop + 4]
        size = int(head["content-length"])
        if not fill(size):
            raise ValueError("a WARC block is cut short")
        yield head, bytes(buffer[:size])
        del buffer[:size]


def _inflate(raw: bytes) -> Iterator[bytes]:
    """Plain bytes as they are, gzip in pieces, with any number of members."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        z = zlib.decompressobj(31)
        while raw and not z.eof:
            yield z.decompress(raw, 1 << 20)
            raw = z.unconsumed_tail
            if not raw and not z.eof:
                yield z.flush()
                break
        raw = z.unused_data


def _page_of(uri: str | None) -> int | None:
    found = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return None if found in ("", "null") else int(found)


def _read(batches):
    for batch in batches:
        for raw in batch.column("content"):
            rows: list[tuple] = []
            for head, block in parse(_inflate(raw.as_py())):
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                kind = head["warc-type"]
                good = kind != "response" or hashlib.sha256(block).hexdigest() == digest
                rows.append((_page_of(head["warc-record-id"]), head.get("warc-target-uri"), kind, _page_of(head.get("warc-refers-to")), digest, len(block), good))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_HEADERS_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HEADERS_SCHEMA, strict=True)], schema=_HEADERS_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all records in a folder of archives; blocks are checked against their digest."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, _HEADERS)


def archive_pages(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write the archives, read them back and resolve revisits against their originals.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per row of ``pages``:
    each is a record of its own, judged by its payload. Rows that repeat both the smallest page_id and the payload are
    all responses; one page_id may have a response and revisits with other payloads. A null page_id is later
    than any other. A revisit's payload size is that of the response with its digest. Null html is
    empty, null urls have no target header, other columns are not read. Empty tables give no rows.
    """
    spark = pages.sparkSession
    write_archives(pages, path, min_payload)
    headers = storage.materialize(read_archives(spark, path), "headers")
    originals = headers.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("content_length").alias("original_bytes"), F.min("digest_ok").alias("ok"))
    whole = storage.skew_join(headers, originals, "payload_digest", "left")
    size = F.when(F.col("record_type") == "revisit", F.col("original_bytes")).otherwise(F.col("content_length"))
    checked = F.when(F.col("ok"), size).otherwise(F.raise_error(F.lit("a payload does not match its digest")).cast("long"))
    return whole.select("page_id", checked.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
