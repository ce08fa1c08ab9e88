"""Scans of stored objects: CSV, JSON and Parquet, one object or those a glob selects."""

from __future__ import annotations

import bz2
import gzip
import re
from dataclasses import replace

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, ShortType

from objsql.sources.request import CsvInput, JsonInput, ParquetInput, RequestError


def read_objects(spark: SparkSession, paths: str | list[str], given: CsvInput | JsonInput | ParquetInput, schema=None, skip_unreadable: bool = False) -> DataFrame:
    """The rows of the objects as one table.

    Without ``schema`` CSV and JSON types are inferred from all rows, whole
    numbers as BIGINT. CSV columns of several objects match by position, JSON
    fields and Parquet columns by name. A ragged or broken CSV record fails the
    query when it is reached. With ``skip_unreadable`` corrupt or vanished
    files are passed over. An RDD of lines may stand for an object.
    """
    paths = [paths] if isinstance(paths, (str, RDD)) else list(paths)
    lines = isinstance(paths[0], RDD)
    options = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"} if skip_unreadable else {}
    if isinstance(given, ParquetInput):
        return spark.read.options(**options).option("mergeSchema", "true" if len(paths) > 1 else "false").parquet(*paths)
    reader = spark.read.options(**options, mode="FAILFAST")
    if isinstance(given, JsonInput):
        if given.kind not in ("LINES", "DOCUMENT"):
            raise ValueError(f"unknown JSON type: {given.kind}")
        reader = reader.option("multiLine", given.kind == "DOCUMENT")
        return (reader.schema(schema) if schema else reader).json(paths[0] if lines else paths)
    reader = reader.options(header=given.header != "NONE", sep=given.delimiter, quote=given.quote, escape=given.escape or given.quote, multiLine=given.quoted_newlines, comment=given.comment)
    if given.record_delimiter not in ("\n", "\r\n", "\r"):
        reader = reader.option("lineSep", given.record_delimiter)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths[0] if lines else paths)
    if given.header != "USE":
        df = df.toDF(*[f"_{n + 1}" for n in range(len(df.columns))])
    if not schema:
        df = df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, (IntegerType, ShortType)) else F.col(f"`{f.name}`") for f in df.schema.fields])
    return df


def object_size(spark: SparkSession, path: str) -> int:
    """Bytes of the objects under ``path``, from the listing alone."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(there).getLength()


def read_scan_range(spark: SparkSession, path: str, given: CsvInput | JsonInput, scan: tuple[int | None, int | None]) -> DataFrame:
    """The records of an object that begin in the bytes from start up to, not with, end; without a start the last end bytes.

    Lines come with their offsets from Hadoop's text input, split by split, so
    a large object is read by many tasks. The schema is that of the whole object.
    """
    if not isinstance(given, (CsvInput, JsonInput)) or getattr(given, "kind", "LINES") != "LINES" or getattr(given, "quoted_newlines", False):
        raise RequestError("ScanRange is for CSV without quoted line breaks and for JSON lines")
    size, (start, end) = object_size(spark, path), scan
    first, last = (max(0, size - (end or 0)), size) if start is None else (start, size if end is None else end)
    if first > last:
        raise RequestError("ScanRange ends before it starts")
    rows = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    header = isinstance(given, CsvInput) and given.header != "NONE"
    lines = rows.filter(lambda r: first <= r[0] < last and (r[0] > 0 or not header)).map(lambda r: r[1])
    whole = read_objects(spark, path, given)
    return read_objects(spark, lines, replace(given, header="NONE") if header else given, whole.schema).toDF(*whole.columns)


def decompressed(spark: SparkSession, path: str, kind: str, target: str) -> str:
    """Copies compressed objects, whatever their names, as text under ``target``; an object is one value, as the codecs can't be split."""
    unpack = {"GZIP": gzip.decompress, "BZIP2": bz2.decompress}[kind]

    def text(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([unpack(c.as_py()).decode().removesuffix("\n") for c in batch.column(0)], pa.string())], ["value"])

    spark.read.format("binaryFile").load(path).select("content").mapInArrow(text, "value string").write.text(target)
    return target


def glob_regex(pattern: str) -> str:
    """A regular expression for whole keys: * and ? stay within a path part, ** crosses them, [..] and {a,b} as usual."""
    out, at, depth = "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if pattern.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        if c == "[" and (end := pattern.find("]", at + 2)) > 0:
            inner = pattern[at + 1 : end]
            out, at = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", r"\\") + "]", end + 1
            continue
        if c == "{":
            depth, c = depth + 1, "(?:"
        elif c == "}" and depth:
            depth, c = depth - 1, ")"
        elif c == "," and depth:
            c = "|"
        else:
            c = {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        out, at = out + c, at + 1
    return f"^{out}$"


def fixed_folder(pattern: str) -> str:
    """The folder under which all matches lie: what comes before the first wildcard, up to its last slash."""
    first = min((pattern.find(c) for c in "*?[{" if c in pattern), default=len(pattern))
    return pattern[: pattern.rfind("/", 0, first) + 1]


def is_glob(name: str) -> bool:
    return any(c in name for c in "*?[")


def matching_keys(keys: DataFrame, pattern: str, key_col: str = "key") -> DataFrame:
    return keys.where(keys[key_col].startswith(fixed_folder(pattern)) & keys[key_col].rlike(glob_regex(pattern)))


def list_objects(spark: SparkSession, bucket: str, pattern: str | None = None) -> list[str]:
    """Paths of the objects under ``bucket`` whose keys match, in order; all without a pattern.

    Names are listed by Spark's file index in parallel, no content is read. The
    driver gets the matching names, which a scan of these files would hold too.
    """
    base = bucket.rstrip("/") + "/"
    root = base + fixed_folder(pattern) if pattern else base
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    if pattern:
        plain = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", base)
        key = F.expr("substr(regexp_replace(path, '^[a-z][a-z0-9+.-]*:/*', '/'), {})".format(len(plain) + 1))
        files = files.where(key.rlike(glob_regex(pattern)))
    return sorted(r.path for r in files.collect())


def byte_range(spec: str, size: int) -> tuple[int, int] | None:
    """First byte and length of a range header, or None if it can't be met: a-b, a- or -n."""
    found = re.fullmatch(r"bytes=(\d*)-(\d*)", spec.strip())
    if not found or not any(found.groups()):
        return None
    first, last = found.groups()
    if not first:
        n = int(last)
        return (size - n, n) if 0 < n <= size else None
    start, end = int(first), min(int(last), size - 1) if last else size - 1
    return (start, end - start + 1) if start <= end else None


def read_range(spark: SparkSession, path: str, spec: str) -> DataFrame:
    """path, content: the range of each object under ``path`` that can meet it."""
    objects = spark.read.format("binaryFile").load(path)
    first, last = re.fullmatch(r"bytes=(\d*)-(\d*)", spec.strip()).groups()
    size = F.col("length")
    if not first:
        start, n = size - int(last), F.lit(int(last)).cast("long")
        fits = size >= int(last)
    else:
        start = F.lit(int(first)).cast("long")
        n = F.least(F.lit(int(last)).cast("long"), size - 1) - start + 1 if last else size - start
        fits = n > 0
    return objects.where(fits).select("path", F.substring("content", (start + 1).cast("int"), n.cast("int")).alias("content"))
