"""WARC: archives of captures, and the assembly of their transactions.

A capture is three records: the request, the response (or, for a payload that
another page has already, a revisit that refers to it), and metadata. Request
and metadata name the response by WARC-Concurrent-To. Archives are written and
read by Spark's own file sources, so any store that Spark reaches will do: a
record ends with two line breaks, which is the separator of the text sink, and
whole files are read as binary and cut by Content-Length.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objsql.llm.common import settled, small_side, written

_EOL = "\r\n"
#: For payloads of up to so many bytes (None: any), pages in an archive at most: a file is read as one value, so it is kept to some 50 MB or one page.
PAGES_PER_FILE = ((16 << 10, 3_000), (1 << 20, 48), (None, 1))


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hexadecimal digits make eight base-32 digits."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_digests(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None) -> DataFrame:
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    url = F.coalesce(pages[url_col].cast("string"), F.lit("")) if url_col else F.lit("")
    return pages.select(pages[id_col].alias("page"), url.alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), base32_sha1(payload).alias("digest"))


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``first``: the smallest page with the same payload, if another than this one; and ``row``: a number that tells rows apart whose id others have, too, or that have none.

    Payloads of many pages make no hot key: equal ones are found by partial
    aggregation of digests, and payloads are joined by page, if at all.
    """
    narrow = settled(pages.select("page", "digest", "size"))
    same = ["digest", "size"]
    least = narrow.where(F.col("size") >= min_bytes).groupBy(*same).agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last").select(*same, "first")
    revisits = settled(narrow.join(small_side(settled(least)), same).where("first < page").select(F.col("page").alias("of"), F.col("digest").alias("of_digest"), F.col("size").alias("of_size"), "first").distinct())
    repeated = settled(narrow.groupBy(F.col("page").alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and again is not null").select("again"))
    joined = pages.join(small_side(revisits), (F.col("page") == F.col("of")) & (F.col("digest") == F.col("of_digest")) & (F.col("size") == F.col("of_size")), "left").drop("of", "of_digest", "of_size")
    joined = joined.join(small_side(repeated), F.col("page") == F.col("again"), "left")
    return joined.select("page", "url", "payload", "size", "digest", "first", F.when(F.col("page").isNull() | F.col("again").isNotNull(), F.monotonically_increasing_id()).alias("row"))


def _record(kind: str, record: Column, url: Column, block: Column, *fields: Column) -> Column:
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}WARC-Type: {kind}{_EOL}WARC-Record-ID: <"), record, F.lit(f">{_EOL}WARC-Date: 2024-01-01T00:00:00Z{_EOL}WARC-Target-URI: "), url,
        *[x for field in fields for x in (F.lit(_EOL), field)],
        F.lit(f"{_EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_EOL * 2),
    )
    return F.concat(head, block)


def records(pages: DataFrame) -> DataFrame:
    """One text per record, without its closing line breaks; ``pages`` from ``classified``."""
    first = F.col("first").cast("string")
    # All records of a capture are made from one row, so they agree on its number.
    page = F.concat(F.coalesce(F.col("page").cast("string"), F.lit("")), F.when(F.col("row").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("row").cast("string"))))
    # A line break or blank in an address would end its header line.
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    name = lambda kind, of: F.concat(F.lit(f"urn:capture:{kind}:"), of)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    asked = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{_EOL}Host: "), host, F.lit(_EOL * 2))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("size").cast("string"), F.lit(_EOL * 2))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.concat(F.lit("WARC-Refers-To: <"), name("response", first), F.lit(">"))
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <"), name("response", page), F.lit(">"))
    fetched = F.concat(F.lit("page: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(_EOL))
    response = F.when(F.col("first").isNull(), _record("response", name("response", page), url, F.concat(answer, F.col("payload")), digest)).otherwise(
        _record("revisit", name("response", page), url, answer, digest, refers, profile)
    )
    made = F.array(_record("request", name("request", page), url, asked, concurrent), response, _record("metadata", name("metadata", page), url, fetched, concurrent))
    return pages.select(F.explode(made).alias("value"))


def write_archives(pages: DataFrame, path: str, pages_per_file: tuple[tuple[int | None, int], ...] = PAGES_PER_FILE) -> None:
    """Writes ``classified`` pages as gzipped WARC files."""
    least = 0
    largest = pages.agg(F.max("size").alias("n")).first().n or 0
    for most, count in pages_per_file:
        if least == 0 or largest >= least:
            own = pages.where((F.col("size") >= least) & (F.col("size") < most if most else F.lit(True)))
            records(own).write.mode("append").option("lineSep", _EOL * 2).option("maxRecordsPerFile", 3 * count).option("compression", "gzip").text(path)
        least = most


_FIELDS = {b"warc-type": "kind", b"warc-record-id": "record", b"warc-concurrent-to": "concurrent_to", b"warc-refers-to": "refers_to", b"warc-payload-digest": "digest", b"warc-target-uri": "url"}
RECORD_SCHEMA = "kind string, record string, concurrent_to string, refers_to string, digest string, url string, http_length long, payload_digest string, payload_bytes long, payload binary, content string"


def parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive; a damaged one raises ValueError."""
    import base64
    import hashlib

    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        row, length = dict.fromkeys(re.findall(r"(\w+) \w+", RECORD_SCHEMA)), None
        for line in archive[at:end].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            if key.lower() == b"content-length":
                length = int(value)
            elif name := _FIELDS.get(key.lower()):
                row[name] = value.strip().decode().strip("<>")
        if length is None or archive[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        block = archive[end + 4 : end + 4 + length]
        if row["kind"] in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            found = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)
            row["http_length"] = int(found[1]) if found else None
            row["digest"] = (row["digest"] or "").removeprefix("sha1:")
            if row["kind"] == "response":
                row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
        else:
            row["content"] = block.decode("utf-8", "replace")
        yield row
        at = end + 8 + length


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``."""

    kind = RECORD_SCHEMA if payloads else RECORD_SCHEMA.replace(", payload binary", "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                whole = archive.as_py()
                for row in parse(gzip.decompress(whole) if whole.startswith(b"\x1f\x8b") else whole):
                    if not payloads:
                        row.pop("payload")
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in re.findall(r"(\w+) (\w+)", kind)])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, kind)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata concurrent to it.

    - Records are joined through WARC-Concurrent-To, in one shuffle: each
      capture has a bounded number of records. Request and metadata that name no
      response in the archives are kept, with a null response.
    - A record that is there twice counts once, of different ones with one id
      and kind the least.
    """
    key = F.when(F.col("kind").isin("response", "revisit"), F.col("record")).otherwise(F.col("concurrent_to"))
    has_payload = "payload" in found.columns
    inner = ["kind", "record", "url", "refers_to", "digest", "http_length", "payload_digest", "payload_bytes", *["payload"] * has_payload]
    return found.groupBy(key.alias("capture")).agg(
        F.min(F.when(F.col("kind") == "request", F.struct("record", "content"))).alias("request"),
        F.min(F.when(F.col("kind").isin("response", "revisit"), F.struct(*inner))).alias("response"),
        F.min(F.when(F.col("kind") == "metadata", F.struct("record", "content"))).alias("metadata"),
    )


def archive_roundtrip(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives under ``path``, reads them back and assembles the captures: one row per page.

    - Null payload counts as empty; null address as an empty one.
    - Equal payloads of ``min_bytes`` or more: the page with the smallest id is
      the response and the others are revisits of it; smaller payloads are all
      responses. Digests and sizes are of full payloads; a revisit's size is
      the Content-Length in its stored HTTP header.
    - verified: a response's digest is that of the payload that was read; a
      revisit's digest and size are those of the response that it refers to.
    - Ids must be whole numbers. Rows that repeat an id are captures of their
      own, alike in id; those of the smallest id are all responses. A row with
      a null id is a response that no other refers to.
    - An empty table gives an empty table. Other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    write_archives(classified(with_digests(pages, id_col, payload_col, url_col), min_bytes), path)
    found = written(transactions(read_archives(pages.sparkSession, path, payloads=False)), "captures")
    page = lambda record: F.regexp_extract(record, r"^urn:capture:[a-z]+:(-?\d+)", 1)
    number = lambda record: F.when(page(record) != "", page(record)).cast(kind)
    referred = settled(found.select(F.col("response.refers_to").alias("to")).where("to is not null").distinct())
    # A page that is there several times has responses of equal payload under names of their own.
    name = F.concat(F.lit("urn:capture:response:"), page(F.col("capture")))
    there = found.where("response.kind = 'response'").select(name.alias("to"), F.col("response.payload_digest").alias("its_digest"), F.col("response.payload_bytes").alias("its_bytes"))
    there = settled(there.join(small_side(referred), "to").distinct())
    met = found.join(small_side(there), (F.col("response.refers_to") == F.col("to")) & (F.col("its_digest") == F.col("response.digest")), "left")
    return met.select(
        number(F.col("capture")).alias(id_col),
        F.col("response.http_length").alias("payload_bytes"),
        # Of a response the digest is taken anew from what was read.
        F.coalesce("response.payload_digest", "response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        number(F.col("response.refers_to")).alias("refers_to"),
        F.when(F.col("response.kind") == "response", F.col("response.payload_digest") == F.col("response.digest")).otherwise(F.coalesce(F.col("its_bytes") == F.col("response.http_length"), F.lit(False))).alias("verified"),
        F.struct("request", "metadata").alias("concurrent"),
    )
