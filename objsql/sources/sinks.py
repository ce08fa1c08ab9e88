"""Encodings of results: CSV, JSON lines, a JSON array, event-stream frames."""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objsql.sources.request import CsvOutput, JsonOutput


def csv_lines(df: DataFrame, out: CsvOutput) -> DataFrame:
    """One column, ``value``: each row as a CSV record without its delimiter; nulls are empty."""
    quote, escape = out.quote, out.escape or out.quote

    def encoded(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        if not quote:
            return text
        quoted = F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(escape + quote)), F.lit(quote))
        if out.quote_all:
            return quoted
        special = [F.contains(text, F.lit(x)) for x in {out.delimiter, quote, "\n", "\r", out.record_delimiter}]
        needs = special[0]
        for x in special[1:]:
            needs = needs | x
        return F.when(needs, quoted).otherwise(text)

    return df.select(F.concat_ws(out.delimiter, *[encoded(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def encode_csv(df: DataFrame, out: CsvOutput = CsvOutput()) -> Iterator[bytes]:
    """CSV text in pieces, one row at a time on the driver: results that are returned to a caller."""
    end = out.record_delimiter
    if out.header:
        head = df.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"_{n} string" for n in range(len(df.columns))))
        yield (csv_lines(head, out).first().value + end).encode()
    for row in csv_lines(df, out).toLocalIterator(prefetchPartitions=True):
        yield (row.value + end).encode()


def encode_json(df: DataFrame, out: JsonOutput = JsonOutput()) -> Iterator[bytes]:
    """JSON lines, or one array; null fields are left out."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).toLocalIterator(prefetchPartitions=True)
    if not out.array:
        for row in rows:
            yield row.value.encode() + b"\n"
        return
    lead = b"["
    for row in rows:
        yield lead + row.value.encode()
        lead = b","
    yield b"[]" if lead == b"[" else b"]"


def encode(df: DataFrame, out: CsvOutput | JsonOutput) -> Iterator[bytes]:
    return encode_csv(df, out) if isinstance(out, CsvOutput) else encode_json(df, out)


def write(df: DataFrame, path: str, out: CsvOutput | JsonOutput) -> None:
    """Writes results in parallel to a folder."""
    if isinstance(out, JsonOutput):
        df.write.json(path)
    else:
        df.write.csv(path, sep=out.delimiter, quote=out.quote, escape=out.escape or out.quote, quoteAll=out.quote_all, lineSep=out.record_delimiter, header=out.header, emptyValue="")


def frame(headers: dict[str, str], payload: bytes) -> bytes:
    """A message of the public event-stream encoding: lengths, CRC of these, headers, payload, CRC of all."""
    head = b"".join(struct.pack(">B", len(k)) + k.encode() + struct.pack(">BH", 7, len(v.encode())) + v.encode() for k, v in headers.items())
    prelude = struct.pack(">II", 16 + len(head) + len(payload), len(head))
    body = prelude + struct.pack(">I", zlib.crc32(prelude)) + head + payload
    return body + struct.pack(">I", zlib.crc32(body))


def read_frames(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        total, size = struct.unpack(">II", data[at : at + 8])
        whole = data[at : at + total]
        if zlib.crc32(whole[:8]) != struct.unpack(">I", whole[8:12])[0] or zlib.crc32(whole[:-4]) != struct.unpack(">I", whole[-4:])[0]:
            raise ValueError("a frame's checksum is wrong")
        headers, k = {}, 12
        while k < 12 + size:
            n = whole[k]
            name = whole[k + 1 : k + 1 + n].decode()
            m = struct.unpack(">H", whole[k + 2 + n : k + 4 + n])[0]
            headers[name] = whole[k + 4 + n : k + 4 + n + m].decode()
            k += 4 + n + m
        yield headers, whole[12 + size : -4]
        at += total


def event_stream(pieces: Iterator[bytes], scanned: int, chunk: int = 1 << 16, progress: bool = False, idle_s: float = 5.0) -> Iterator[bytes]:
    """Records frames of up to ``chunk`` bytes, then Stats and End. Without records there is no Records frame.

    With ``progress`` each Records frame is followed by a Progress frame. A
    Cont frame goes ahead of what took longer than ``idle_s`` to come.
    """
    event = lambda kind, mime: {":message-type": "event", ":event-type": kind, **({":content-type": mime} if mime else {})}
    counts = lambda kind: frame(event(kind, "text/xml"), f"<{kind}><BytesScanned>{scanned}</BytesScanned><BytesProcessed>{scanned}</BytesProcessed><BytesReturned>{sent}</BytesReturned></{kind}>".encode())
    sent, held, last = 0, b"", time.monotonic()

    def records() -> Iterator[bytes]:
        nonlocal sent, held, last
        out = frame(event("Records", "application/octet-stream"), held)
        sent, held, last = sent + len(out), b"", time.monotonic()
        yield out
        if progress:
            yield counts("Progress")

    for piece in pieces:
        if time.monotonic() - last > idle_s:
            yield frame(event("Cont", ""), b"")
            last = time.monotonic()
        held += piece
        if len(held) >= chunk:
            yield from records()
    if held:
        yield from records()
    yield counts("Stats")
    yield frame(event("End", ""), b"")
