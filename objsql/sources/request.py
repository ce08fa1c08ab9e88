"""What a query asks for: the expression, how objects are stored and how rows come back."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from xml.etree import ElementTree


class RequestError(ValueError):
    """A request that can't be understood."""


_ESCAPES = {r"\t": "\t", r"\n": "\n", r"\r": "\r"}


@dataclass(frozen=True)
class CsvInput:
    header: str = "NONE"  # USE, IGNORE or NONE
    delimiter: str = ","
    quote: str = '"'  # '' turns quoting off
    escape: str | None = None  # None: a quote is doubled
    record_delimiter: str = "\n"
    comment: str = ""
    quoted_newlines: bool = False

    def __post_init__(self):
        if self.header not in ("USE", "IGNORE", "NONE"):
            raise RequestError(f"unknown header mode: {self.header}")
        if len(self.quote) > 1:
            raise RequestError("the quote must be one character")
        if not self.delimiter:
            raise RequestError("the delimiter is empty")


@dataclass(frozen=True)
class JsonInput:
    kind: str = "LINES"  # or DOCUMENT


@dataclass(frozen=True)
class ParquetInput:
    pass


@dataclass(frozen=True)
class CsvOutput:
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    record_delimiter: str = "\n"
    quote_all: bool = False
    header: bool = False


@dataclass(frozen=True)
class JsonOutput:
    array: bool = False


@dataclass(frozen=True)
class SelectRequest:
    expression: str
    input: CsvInput | JsonInput | ParquetInput = field(default_factory=CsvInput)
    output: CsvOutput | JsonOutput = field(default_factory=CsvOutput)
    scan_range: tuple[int | None, int | None] | None = None
    dialect: str = "extended"
    compression: str = "NONE"  # GZIP or BZIP2; NONE goes by the object's extension
    progress: bool = False


#: Format names of glob requests.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "pq": "parquet"}
EXTENSIONS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "pq": "parquet"}


def default_input(kind: str, **csv) -> CsvInput | JsonInput | ParquetInput:
    return {"csv": lambda: CsvInput(**{"header": "USE"} | csv), "json": JsonInput, "parquet": ParquetInput}[kind]()


def input_by_extension(key: str) -> CsvInput | JsonInput | ParquetInput | None:
    extension = key.rpartition(".")[2].lower()
    kind = EXTENSIONS.get(extension)
    return kind and default_input(kind, **({"delimiter": "\t"} if extension == "tsv" else {}))


def input_by_content_type(content_type: str) -> CsvInput | JsonInput | ParquetInput | None:
    kind = content_type.partition(";")[0].strip().lower()
    for mark, found in (("csv", "csv"), ("json", "json"), ("parquet", "parquet"), ("octet-stream", "parquet")):
        if mark in kind:
            return default_input(found)
    return None


@dataclass(frozen=True)
class GlobRequest:
    sql: str
    format: str = "csv"
    output: str = "json"
    has_headers: bool = True
    delimiter: str = ","
    dialect: str = "extended"
    skip_unreadable: bool = False  # pass over objects that are corrupt or gone

    @classmethod
    def from_json(cls, body: str) -> GlobRequest:
        try:
            asked = json.loads(body)
            request = cls(**{k: v for k, v in asked.items() if k in cls.__dataclass_fields__})
        except (ValueError, TypeError, AttributeError) as e:
            raise RequestError(f"bad request body: {e}") from None
        request.input()
        if request.output not in ("json", "csv"):
            raise RequestError(f"unknown output: {request.output}")
        return request

    def input(self) -> CsvInput | JsonInput | ParquetInput:
        if self.format.lower() not in FORMATS:
            raise RequestError(f"unknown format: {self.format}")
        kind = FORMATS[self.format.lower()]
        return CsvInput("USE" if self.has_headers else "NONE", _ESCAPES.get(self.delimiter, self.delimiter)) if kind == "csv" else default_input(kind)


def parse_select_xml(body: str | bytes) -> SelectRequest:
    """A request in the XML of the public S3 Select API; namespaces are ignored."""
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError as e:
        raise RequestError(f"bad XML: {e}") from None
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]

    def text(node, name: str, default: str) -> str:
        found = node.find(name)
        return default if found is None else _ESCAPES.get(found.text or "", found.text or "")

    expression = (root.findtext("Expression") or "").strip()
    if not expression:
        raise RequestError("no Expression")
    if (root.findtext("ExpressionType") or "SQL").upper() != "SQL":
        raise RequestError("ExpressionType must be SQL")
    source, target = root.find("InputSerialization"), root.find("OutputSerialization")
    if source is None:
        raise RequestError("no InputSerialization")
    if (csv := source.find("CSV")) is not None:
        quote = text(csv, "QuoteCharacter", '"')
        given = CsvInput(
            text(csv, "FileHeaderInfo", "NONE").upper(), text(csv, "FieldDelimiter", ","), quote, text(csv, "QuoteEscapeCharacter", quote or '"'),
            text(csv, "RecordDelimiter", "\n"), text(csv, "Comments", ""), text(csv, "AllowQuotedRecordDelimiter", "false").lower() == "true",
        )
    elif (node := source.find("JSON")) is not None:
        given = JsonInput(text(node, "Type", "LINES").upper())
    elif source.find("Parquet") is not None:
        given = ParquetInput()
    else:
        raise RequestError("InputSerialization names no format")
    wanted: CsvOutput | JsonOutput = CsvOutput()
    if target is not None and (csv := target.find("CSV")) is not None:
        quote = text(csv, "QuoteCharacter", '"')
        wanted = CsvOutput(text(csv, "FieldDelimiter", ","), quote, text(csv, "QuoteEscapeCharacter", quote or '"'), text(csv, "RecordDelimiter", "\n"), text(csv, "QuoteFields", "ASNEEDED").upper() == "ALWAYS")
    elif target is not None and target.find("JSON") is not None:
        wanted = JsonOutput()
    span = root.find("ScanRange")
    scan = None if span is None else tuple(int(x) if (x := span.findtext(n)) else None for n in ("Start", "End"))
    compression = text(source, "CompressionType", "NONE").upper()
    if compression not in ("NONE", "GZIP", "BZIP2"):
        raise RequestError(f"unknown compression: {compression}")
    asked = root.find("RequestProgress")
    progress = asked is not None and (asked.findtext("Enabled") or "").strip().lower() == "true"
    return SelectRequest(expression, given, wanted, scan, compression=compression, progress=progress)
