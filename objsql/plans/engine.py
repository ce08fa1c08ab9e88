"""Queries over stored objects and tables."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from objsql.functions import register
from objsql.plans.dialect import TABLE, check, object_tables, positions
from objsql.plans.rewrite import rewritten
from objsql.session import work_path
from objsql.sources.readers import decompressed, is_glob, list_objects, object_size, read_objects, read_scan_range
from objsql.sources.request import CsvOutput, GlobRequest, JsonOutput, SelectRequest
from objsql.sources.sinks import encode, event_stream


class ObjectNotFound(LookupError):
    """No object has the key, or none matches the glob."""


class QueryTimeout(TimeoutError):
    """A query ran longer than it may."""


@dataclass(frozen=True)
class Limits:
    timeout_s: float | None = 60.0
    # Beyond these there is an error, never a silent cut.
    max_result_rows: int | None = None
    max_objects: int | None = None


class Engine:
    """Runs read-only SQL over objects, with the dialects of ``objsql.plans.dialect``.

    Views are made in a session of their own, so queries don't see each other's.
    """

    def __init__(self, spark: SparkSession, limits: Limits = Limits()):
        self.spark, self.limits = spark.newSession(), limits
        for key, value in (("spark.sql.caseSensitive", "false"), ("spark.sql.session.timeZone", "UTC")):
            self.spark.conf.set(key, value)
        register(self.spark)
        # User text may quote identifiers with double quotes, which the bodies above don't.
        self.spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")

    def _run(self, sql: str, tables: dict[str, DataFrame], dialect: str) -> DataFrame:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        sql = positions(sql, {name: df.columns for name, df in tables.items()})
        source = re.search(r"(?is)\bfrom\b(.*?)(?:\bwhere\b|$)", sql)

        def is_whole(expression: str) -> bool:
            try:
                return isinstance(self.spark.sql(f"SELECT {expression} AS x FROM {source[1]}").schema[0].dataType, IntegralType)
            except Exception:  # the query itself will name the error
                return False

        def type_of(query: str) -> str | None:
            try:
                check(self.spark, query)  # a statement would be run at once
                return self.spark.sql(query).schema[0].dataType.simpleString()
            except Exception:  # it names columns of the query around it, or the query itself will name the error
                return None

        sql = rewritten(sql, dialect, is_whole if dialect == "strict" and source else None, type_of if dialect == "extended" else None)
        check(self.spark, sql, dialect)
        df, most = self.spark.sql(sql), self.limits.max_result_rows
        if most is None:
            return df
        # A limit leaves one partition, where the numbers count the rows.
        rows = df.limit(most + 1).withColumn("_objsql_row", F.monotonically_increasing_id())
        return rows.where(F.when(F.col("_objsql_row") < most, True).otherwise(F.raise_error(F.lit(f"the result has more than {most} rows")).cast("boolean"))).drop("_objsql_row")

    def query_tables(self, sql: str, tables: dict[str, str], dialect: str = "extended") -> DataFrame:
        """SQL over Parquet tables by name."""
        return self._run(sql, {name: self.spark.read.parquet(path) for name, path in tables.items()}, dialect)

    def query_object(self, request: SelectRequest, path: str) -> DataFrame:
        """SQL over one object, as table s3object."""
        if request.compression != "NONE" and not path.lower().endswith({"GZIP": ".gz", "BZIP2": ".bz2"}[request.compression]):
            path = decompressed(self.spark, path, request.compression, work_path(self.spark, "plain"))
        scan = request.scan_range
        table = self._scan([path], request.input) if scan is None else read_scan_range(self.spark, path, request.input, scan)
        return self._run(request.expression, {TABLE: table}, request.dialect)

    def query_glob(self, request: GlobRequest, bucket: str) -> DataFrame:
        """SQL over the objects that quoted table names select; a name without wildcards is one object, s3object all of them."""
        sql, names = object_tables(request.sql)
        tables = {}
        for n, name in enumerate(names):
            paths = list_objects(self.spark, bucket, name) if is_glob(name) else [f"{bucket.rstrip('/')}/{name}"]
            tables[f"objects_{n}"] = self._scan(paths, request.input(), name, request.skip_unreadable)
        if not names:
            tables[TABLE] = self._scan(list_objects(self.spark, bucket), request.input(), bucket, request.skip_unreadable)
        return self._run(sql, tables, request.dialect)

    def _scan(self, paths: list[str], given, name: str = "", skip_unreadable: bool = False) -> DataFrame:
        if not paths:
            raise ObjectNotFound(name)
        if self.limits.max_objects is not None and len(paths) > self.limits.max_objects:
            raise ValueError(f"{len(paths)} objects match; at most {self.limits.max_objects} are allowed")
        try:
            return read_objects(self.spark, paths, given, skip_unreadable=skip_unreadable)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise ObjectNotFound(name or paths[0]) from None
            raise

    def select(self, request: SelectRequest, path: str) -> bytes:
        """The framed answer to a request on one object."""
        return b"".join(self.bounded(lambda: list(event_stream(encode(self.query_object(request, path), request.output), object_size(self.spark, path), progress=request.progress))))

    def answer(self, request: GlobRequest, bucket: str) -> bytes:
        out = CsvOutput(header=True) if request.output == "csv" else JsonOutput(array=True)
        return b"".join(self.bounded(lambda: list(encode(self.query_glob(request, bucket), out))))

    def bounded(self, work) -> Iterator:
        """Does ``work``; its Spark jobs are cancelled when the time is up."""
        context, tag = self.spark.sparkContext, f"query-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.limits.timeout_s, stop) if self.limits.timeout_s is not None else None
        context.addJobTag(tag)
        try:
            if timer:
                timer.start()
            return work()
        except Exception:
            if late.is_set():
                raise QueryTimeout(f"stopped after {self.limits.timeout_s} s") from None
            raise
        finally:
            if timer:
                timer.cancel()
            context.removeJobTag(tag)
