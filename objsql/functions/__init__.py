"""Column builders for scalar functions whose rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def substring(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start below 1 counts as 1, a negative length as 0; past the end gives ''; a null argument null."""
    start = F.greatest(F.lit(start) if isinstance(start, int) else start.cast("int"), F.lit(1))
    given = F.lit(start) if isinstance(start, int) else start
    if length is None:
        return F.when(given.isNotNull(), F.substr(s, start))
    length = F.lit(length) if isinstance(length, int) else length.cast("int")
    return F.when(length.isNotNull() & given.isNotNull(), F.substr(s, start, F.greatest(length, F.lit(0))))


_SIDES = {"leading": r"(?U)^{0}+", "trailing": r"(?U){0}+$", "both": r"(?U)^{0}+|{0}+$"}


def trim(s: Column, side: str = "both", chars: str | None = None) -> Column:
    """Strips Unicode white space, or the first character of ``chars``, from the sides named."""
    if chars == "":
        return s
    what = r"\s" if chars is None else f"\\x{{{ord(chars[0]):x}}}"
    return F.regexp_replace(s, _SIDES[side].format(what), "")


def char_length(s: Column) -> Column:
    return F.char_length(s).cast("long")


#: Target names of CAST in the strict dialect; widths of CHAR and the like are ignored.
CAST_TYPES = {
    "BOOL": "boolean", "BOOLEAN": "boolean", "INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "INT64": "bigint", "SMALLINT": "smallint", "INT2": "smallint", "INT4": "int",
    "FLOAT": "float", "REAL": "float", "DOUBLE": "double", "DOUBLE PRECISION": "double", "FLOAT64": "double", "VARCHAR": "string", "TEXT": "string", "STRING": "string", "CHAR": "string",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "DECIMAL": "double", "NUMERIC": "double", "DEC": "double",
}


def cast(value: Column, target: str) -> Column:
    """Null where the value can't be cast; another target is an error."""
    try:
        return value.try_cast(CAST_TYPES[target.upper()])
    except KeyError:
        raise ValueError(f"unsupported CAST target: {target}") from None


def to_timestamp(s: Column) -> Column:
    return s.try_cast("timestamp_ntz")


def utcnow() -> Column:
    """The time of the query in UTC, to the second, as text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ring_position(key: Column) -> Column:
    """A place on the hash ring, 0 to 2**60 - 1: the first 60 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("long")


_SPACES = "concat(chr(92), 's')"
_ONE = "concat(chr(92), 'x{', lower(hex(ascii(chars))), '}')"
#: What a side's trim takes off; the pattern is folded to a constant where the characters are one.
_TRIMMED = {"leading": "concat('(?U)^', {0}, '+')", "trailing": "concat('(?U)', {0}, '+$')", "both": "concat('(?U)^', {0}, '+|', {0}, '+$')"}
#: SQL functions that user queries may call, as bodies of SQL UDFs; ``objsql.plans.rewrite`` puts SUBSTRING and TRIM as the objsql_ ones.
_SQL = {
    "utcnow": ("", "STRING", "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'yyyy-MM-dd''T''HH:mm:ss''Z''')"),
    "to_string": ("ts TIMESTAMP, fmt STRING", "STRING", "date_format(ts, fmt)"),
    "objsql_substring": ("s STRING, start BIGINT", "STRING", "CASE WHEN start IS NOT NULL THEN substr(s, CAST(greatest(start, 1) AS INT)) END"),
    "objsql_substring_n": ("s STRING, start BIGINT, n BIGINT", "STRING", "CASE WHEN start IS NOT NULL AND n IS NOT NULL THEN substr(s, CAST(greatest(start, 1) AS INT), CAST(greatest(n, 0) AS INT)) END"),
    **{f"objsql_trim_{side}": ("s STRING, chars STRING", "STRING", f"CASE WHEN chars = '' THEN s ELSE regexp_replace(s, {_TRIMMED[side].format(f'CASE WHEN chars IS NULL THEN {_SPACES} ELSE {_ONE} END')}, '') END") for side in _TRIMMED},
}


def register(spark: SparkSession) -> None:
    """Makes the functions of _SQL callable from SQL text."""
    for name, (args, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
