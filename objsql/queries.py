"""Queries over the driver's tables, one for each operator, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objsql import functions as fn
from objsql import streaming
from objsql.operators import lifecycle, listing, replicas, storage
from objsql.plans import Engine
from objsql.session import work_path
from objsql.sources import CsvInput, CsvOutput, GlobRequest, JsonInput, JsonOutput, ParquetInput, SelectRequest
from objsql.sources.request import input_by_content_type, input_by_extension
from objsql.sources.sinks import csv_lines, encode, read_frames, write

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the extended dialect, with the same text as its oracle unless another is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).query_tables(text, {t: f"{sf_dir}/{t}.parquet" for t in TABLES if t in text})

    run.__name__ = name
    query(oracle or text)(run)


# -- projection, filter, expressions --------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = SelectRequest("SELECT l_orderkey, l_quantity FROM S3Object WHERE l_quantity > 45", ParquetInput(), dialect="strict")
    return Engine(spark).query_object(request, f"{sf_dir}/lineitem.parquet")


sql("select_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, -l_tax AS minus_tax, l_returnflag || '/' || l_linestatus AS flags FROM lineitem WHERE l_quantity % 7 = 3 AND NOT (l_returnflag = 'N' OR l_discount >= 0.08) AND l_shipdate IS NOT NULL")
sql("select_between_in_like", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_size NOT BETWEEN 7 AND 9 AND p_brand IN (SELECT min(p_brand) FROM part UNION ALL SELECT max(p_brand) FROM part) AND (p_type LIKE '%A%' OR p_name NOT ILIKE '%x%')")
sql(
    "case_cast_coalesce",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN NULL ELSE 'small' END AS size_class, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS status_code, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, try_cast(o_orderpriority AS BIGINT) AS no_number, try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, CAST(o_totalprice AS BIGINT) AS whole FROM orders",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN NULL ELSE 'small' END AS size_class, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS status_code, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, try_cast(o_orderpriority AS BIGINT) AS no_number, try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders",
)
sql("three_valued_logic", "SELECT n_nationkey, (x IS NULL) AS x_null, (x AND FALSE) AS with_false, (x OR TRUE) AS with_true, coalesce(n_nationkey IN (1, 2, NULL), FALSE) AS listed, CASE WHEN TRUE THEN nullif(n_nationkey, 3) ELSE 0 END AS kept_null FROM (SELECT n_nationkey, nullif(n_regionkey = 1, FALSE) AS x FROM nation) t")


@query("SELECT doc_id, length(text) AS n_chars_seen, replace(upper(substr(text, 1, 12)), 'ẞ', 'SS') AS head, lower(substr(text, 3)) AS tail_lower, substr(text, 1, 2) AS clamped, trim(chr(9) || ' ' || source || ' ', ' ' || chr(9)) AS trimmed, rtrim(source, '0') AS no_zeros, lang || '-' || source AS tag FROM documents")
def string_functions(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", fn.char_length(text).alias("n_chars_seen"), F.upper(fn.substring(text, 1, 12)).alias("head"), F.lower(fn.substring(text, 3)).alias("tail_lower"), fn.substring(text, -4, 2).alias("clamped"),
        fn.trim(F.concat(F.lit("\t "), F.col("source"), F.lit(" "))).alias("trimmed"), fn.trim(F.col("source"), "trailing", "0").alias("no_zeros"), F.concat("lang", F.lit("-"), "source").alias("tag"),
    )


sql(
    "date_functions",
    "SELECT event_id, date_add(DAY, 10, ts) AS later, date_diff(DAY, TIMESTAMP '2024-01-01 00:00:00', date_trunc('DAY', ts)) AS days, CAST(extract(YEAR FROM ts) AS BIGINT) AS y, CAST(extract(MONTH FROM ts) AS BIGINT) AS m, CAST(extract(HOUR FROM ts) AS BIGINT) AS h, to_string(ts, 'yyyy-MM-dd') AS day, try_to_timestamp('nonsense') IS NULL AS bad FROM events",
    "SELECT event_id, ts + INTERVAL 10 DAY AS later, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS days, extract(year FROM ts) AS y, extract(month FROM ts) AS m, extract(hour FROM ts) AS h, strftime(ts, '%Y-%m-%d') AS day, TRUE AS bad FROM events",
)
sql("utcnow_shape", "SELECT r_regionkey, char_length(UTCNOW()) AS n, UTCNOW() LIKE '____-__-__T__:__:__Z' AS fine FROM region", "SELECT r_regionkey, 20 AS n, TRUE AS fine FROM region")

_TEXT_FUNCTIONS = "SELECT doc_id, SUBSTRING(text, -4, 6) AS clamped, SUBSTRING(text FROM 3 FOR 4) AS middle, substr(text, 5) AS rest, TRIM(chr(9) || ' ' || source || ' ') AS trimmed, TRIM(TRAILING '0' FROM source) AS no_zeros, TRIM(LEADING 'sx' FROM source) AS no_s, TO_TIMESTAMP(lang) IS NULL AS bad_time, CHARACTER_LENGTH(lang) + CHAR_LENGTH(lang) AS n, TO_STRING(TO_TIMESTAMP('2024-03-05 06:07:08'), 'yyyy/MM/dd HH') AS told FROM documents"
sql(
    "text_functions", _TEXT_FUNCTIONS,
    "SELECT doc_id, substr(text, 1, 6) AS clamped, substr(text, 3, 4) AS middle, substr(text, 5) AS rest, source AS trimmed, rtrim(source, '0') AS no_zeros, ltrim(source, 's') AS no_s, TRUE AS bad_time, CAST(2 * length(lang) AS INTEGER) AS n, '2024/03/05 06' AS told FROM documents",
)


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber // 2 AS BIGINT) AS half, CAST(l_orderkey * 3 // (l_linenumber + 1) AS BIGINT) AS mixed, l_quantity / 2 AS real_half, CAST(NULL AS BIGINT) AS no_number, CAST(substr(l_returnflag || '12', 2) AS BIGINT) AS number FROM lineitem WHERE l_linenumber // 2 = 1")
def strict_cast_division(spark, sf_dir):
    text = "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS half, l_orderkey * 3 / (l_linenumber + 1) AS mixed, l_quantity / 2 AS real_half, CAST(l_returnflag AS INT) AS no_number, CAST(SUBSTRING(l_returnflag || '12', 2) AS INTEGER) AS number FROM S3Object WHERE l_linenumber / 2 = 1"
    return Engine(spark).query_object(SelectRequest(text, ParquetInput(), dialect="strict"), f"{sf_dir}/lineitem.parquet")


sql("fetch_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 5 ROWS FETCH FIRST 12 ROWS ONLY", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 12 OFFSET 5")
sql("top_rows", "SELECT TOP 7 p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
sql("qualify_rows", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE value > 1 QUALIFY rn <= 2")
sql("any_all_subquery", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal - 5000 FROM customer) OR s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("is_missing", "SELECT n_nationkey, nullif(n_regionkey, 2) IS MISSING AS gone, n_name IS NOT MISSING AS there FROM nation", "SELECT n_nationkey, nullif(n_regionkey, 2) IS NULL AS gone, TRUE AS there FROM nation")
sql("truth_and_distinct", "SELECT n_nationkey, (n_regionkey = 1) IS TRUE AS t, (nullif(n_regionkey, 3) > 1) IS NOT FALSE AS f, nullif(n_regionkey, 2) IS DISTINCT FROM 2 AS d, nullif(n_regionkey, 2) IS NOT DISTINCT FROM NULL AS e, position('A' IN n_name) AS place, CAST(floor(n_nationkey / 4.0) AS BIGINT) AS low, CAST(ceil(n_nationkey / 4.0) AS BIGINT) AS high FROM nation", "SELECT n_nationkey, (n_regionkey = 1) IS TRUE AS t, (nullif(n_regionkey, 3) > 1) IS NOT FALSE AS f, nullif(n_regionkey, 2) IS DISTINCT FROM 2 AS d, nullif(n_regionkey, 2) IS NOT DISTINCT FROM NULL AS e, CAST(position('A' IN n_name) AS INTEGER) AS place, CAST(floor(n_nationkey / 4.0) AS BIGINT) AS low, CAST(ceil(n_nationkey / 4.0) AS BIGINT) AS high FROM nation")
sql("bits_and_patterns", "SELECT p_partkey, +p_size AS plus, p_size & 6 AS a, p_size | 6 AS o, regexp_replace(p_brand, '[0-9]+', '#') AS masked, p_name RLIKE '^[a-z]+' AS lower_start, abs(-p_size) AS size, sqrt(p_size * p_size) AS root, try_cast(p_brand AS BIGINT) AS none, p_size::STRING AS told FROM part", "SELECT p_partkey, p_size AS plus, p_size & 6 AS a, p_size | 6 AS o, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS masked, regexp_matches(p_name, '^[a-z]+') AS lower_start, abs(-p_size) AS size, sqrt(p_size * p_size) AS root, CAST(NULL AS BIGINT) AS none, p_size::VARCHAR AS told FROM part")
sql("values_rows", "SELECT k, v || '!' AS v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v) UNION ALL SELECT r_regionkey, r_name FROM region")
sql("alias_star", "SELECT r.*, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
sql("percentiles", "SELECT event_type, percentile(value, 0.5) AS p50, percentile(value, array(0.9))[0] AS p90, count(*) AS n FROM events GROUP BY event_type", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, count(*) AS n FROM events GROUP BY event_type")

# -- aggregates, joins, windows, sets -------------------------------------------------------------

sql("global_agg_where", "SELECT count(*) AS n, count(nullif(l_returnflag, 'N')) AS n_flagged, sum(l_quantity) AS qty, avg(l_extendedprice) AS mean_price, min(l_shipdate) AS first_ship, max(l_discount * l_tax) AS top, sum(l_extendedprice) / count(*) AS ratio FROM lineitem WHERE l_discount > 0.05")
sql("empty_agg", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a FROM lineitem WHERE l_quantity < 0")
sql("group_by_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100")
sql("rollup_orders", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS high, sum(DISTINCT user_id) AS id_sum FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS high, CAST(sum(DISTINCT user_id) AS BIGINT) AS id_sum FROM events GROUP BY event_type")
sql("join_inner", "SELECT n_name, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
sql("join_right", "SELECT n_name, s_suppkey FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 2")
sql("join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey")
sql("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_theta", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("window_rank", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr FROM events", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr FROM events")
sql("window_lag_frame", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id FROM events")
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("offset_page", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 40")
sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
sql("set_intersect_except", "(SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT s_suppkey FROM supplier")
sql("cte_subquery", "WITH per AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), mean AS (SELECT avg(total) AS m FROM per) SELECT o_custkey, total FROM per WHERE total > (SELECT m FROM mean) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("latency_windows", "SELECT date_trunc('DAY', ts) AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY date_trunc('DAY', ts), event_type", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")

# -- sources and sinks ------------------------------------------------------------------------------

_PART = "SELECT p_partkey, p_name, p_brand, p_size FROM part"


def _parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


@query(_PART + " WHERE p_size > 10")
def csv_roundtrip(spark, sf_dir):
    path = work_path(spark, "csv")
    write(_parts(spark, sf_dir), path, CsvOutput(delimiter="╦", quote="'", escape="'", quote_all=True, header=True))
    request = SelectRequest("SELECT p_partkey, p_name, p_brand, p_size FROM s3object WHERE p_size > 10", CsvInput("USE", "╦", "'", "'"), dialect="strict")
    return Engine(spark).query_object(request, path)


@query("SELECT p_partkey AS k, p_brand AS brand FROM part WHERE p_size > 10")
def csv_positional(spark, sf_dir):
    path = work_path(spark, "csv")
    write(_parts(spark, sf_dir), path, CsvOutput(delimiter="\t"))
    return Engine(spark).query_object(SelectRequest("SELECT _1 AS k, s._3 AS brand FROM S3Object s WHERE _4 > 10", CsvInput("NONE", "\t"), dialect="strict"), path)


@query("SELECT p_partkey || ',\"' || p_name || '\",' || p_size AS line FROM (SELECT p_partkey, p_name || ', \"\"x\"\"' AS p_name, p_size FROM part) t")
def csv_output(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(', "x"')).alias("p_name"), "p_size")
    return csv_lines(rows, CsvOutput()).withColumnRenamed("value", "line")


@query(_PART)
def json_lines(spark, sf_dir):
    path = work_path(spark, "json")
    _parts(spark, sf_dir).write.json(path)
    return Engine(spark).query_object(SelectRequest("SELECT p_partkey, p_name, p_brand, p_size FROM s3object", JsonInput("LINES")), path)


@query("SELECT r_regionkey, r_name FROM region")
def json_document(spark, sf_dir):
    path = work_path(spark, "json")
    region = read(spark, sf_dir, "region")
    region.agg(F.to_json(F.collect_list(F.struct(*region.columns))).alias("value")).write.text(path)  # a table of five rows
    return Engine(spark).query_object(SelectRequest("SELECT r_regionkey, r_name FROM s3object", JsonInput("DOCUMENT")), path)


@query("SELECT p_brand, count(*) AS n, sum(p_size) AS total FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_brand")
def multi_object_glob(spark, sf_dir):
    bucket = work_path(spark, "bucket")
    for n, folder in enumerate(("logs/none", "logs/2024/a", "logs/2024/b")):
        _parts(spark, sf_dir).where(F.col("p_partkey") % 3 == n).write.csv(f"{bucket}/{folder}", header=True)
    return Engine(spark).query_glob(GlobRequest("SELECT p_brand, count(*) AS n, sum(p_size) AS total FROM 'logs/2024/**/*.csv' GROUP BY p_brand"), bucket)


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[^/]*\\.org/en/[^/]*$')")
def glob_match(spark, sf_dir):
    return listing_keys(spark, sf_dir).transform(lambda df: _matching(df, "https://*.org/en/*")).select("page_id", "url")


def _matching(df, pattern):
    from objsql.sources.readers import matching_keys

    return matching_keys(df, pattern, "url")


@query("SELECT doc_id, octet_length(encode(text)) AS size, md5(right(text, 1)) AS last_char FROM documents WHERE octet_length(encode(text)) >= 500")
def object_sizes(spark, sf_dir):
    size = F.octet_length("text")
    return read(spark, sf_dir, "documents").where(size >= 500).select("doc_id", size.cast("long").alias("size"), F.md5(F.right("text", F.lit(1))).alias("last_char"))


@query("SELECT p_partkey AS k, p_brand AS brand FROM part")
def csv_header_ignored(spark, sf_dir):
    path = work_path(spark, "csv")
    write(_parts(spark, sf_dir), path, CsvOutput(header=True))
    return Engine(spark).query_object(SelectRequest("SELECT _1 AS k, _3 AS brand FROM s3object", CsvInput("IGNORE")), path)


@query("SELECT p_partkey AS k, p_name || chr(10) || 'x' AS name FROM part")
def csv_comments_newlines(spark, sf_dir):
    path = work_path(spark, "csv")
    lines = _parts(spark, sf_dir).select(F.concat(F.lit("#note\n"), F.col("p_partkey").cast("string"), F.lit(',"'), "p_name", F.lit('\nx"')).alias("value"))
    lines.write.text(path)
    return Engine(spark).query_object(SelectRequest("SELECT _1 AS k, _2 AS name FROM s3object", CsvInput(comment="#", quoted_newlines=True)), path)


@query("SELECT p_partkey AS k, p_size AS size FROM part")
def csv_record_delimiter(spark, sf_dir):
    path = work_path(spark, "csv")
    write(_parts(spark, sf_dir).select("p_partkey", "p_size"), path, CsvOutput(record_delimiter=";"))
    return Engine(spark).query_object(SelectRequest("SELECT _1 AS k, _2 AS size FROM s3object", CsvInput(record_delimiter=";")), path)


@query("SELECT CAST(0 AS BIGINT) AS n")
def csv_blank(spark, sf_dir):
    path = work_path(spark, "csv")
    write(_parts(spark, sf_dir).where("p_size < 0").select("p_partkey", "p_size"), path, CsvOutput(header=True))
    spark.createDataFrame([("k,size",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return Engine(spark).query_object(SelectRequest("SELECT count(*) AS n FROM s3object", CsvInput("USE")), path)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def whole_bucket(spark, sf_dir):
    bucket = work_path(spark, "bucket")
    for n in range(2):
        _parts(spark, sf_dir).where(F.col("p_partkey") % 2 == n).write.json(f"{bucket}/part{n}")
    for folder in ("part0", "part1"):
        _no_marks(spark, f"{bucket}/{folder}")
    return Engine(spark).query_glob(GlobRequest("SELECT p_brand, count(*) AS n FROM s3object GROUP BY p_brand", "ndjson"), bucket)


def _no_marks(spark, path):
    """Takes away the empty mark that a finished write leaves."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)


@query(_PART + " WHERE p_size > 25")
def gzip_object(spark, sf_dir):
    path, named = work_path(spark, "csv"), work_path(spark, "named")
    _parts(spark, sf_dir).coalesce(1).write.csv(path, header=True, compression="gzip")
    # The object's name says nothing about its compression.
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    there = fs_path(f"{path}/*.csv.gz")
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(fs.globStatus(there)[0].getPath(), fs_path(named))
    return Engine(spark).query_object(SelectRequest("SELECT p_partkey, p_name, p_brand, p_size FROM s3object WHERE p_size > 25", CsvInput("USE"), compression="GZIP"), named)


@query("SELECT p_partkey AS k FROM (SELECT p_partkey, sum(length(CAST(p_partkey AS VARCHAR)) + 1) OVER (ORDER BY p_partkey) - length(CAST(p_partkey AS VARCHAR)) - 1 AS byte_pos FROM part) t WHERE byte_pos >= 100 AND byte_pos < 2000")
def scan_range(spark, sf_dir):
    path = work_path(spark, "csv")
    _parts(spark, sf_dir).select("p_partkey").orderBy("p_partkey").coalesce(1).write.csv(path)
    _no_marks(spark, path)
    return Engine(spark).query_object(SelectRequest("SELECT _1 AS k FROM s3object", CsvInput(), scan_range=(100, 2000)), path)


@query("SELECT strlen(t) AS n, CAST(substr(t, 3, 5) AS VARCHAR) AS part FROM (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS t FROM region) x")
def byte_range_read(spark, sf_dir):
    path = work_path(spark, "bytes")
    read(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path)
    _no_marks(spark, path)
    from objsql.sources.readers import read_range

    size = spark.read.format("binaryFile").load(path).select(F.col("length").alias("n"))
    return size.crossJoin(read_range(spark, path, "bytes=2-6").select(F.col("content").cast("string").alias("part")))  # one row each


@query("SELECT p_partkey || ',' || p_brand AS line FROM part UNION ALL SELECT 'p_partkey,p_brand'")
def csv_output_header(spark, sf_dir):
    path = work_path(spark, "csv")
    write(_parts(spark, sf_dir).select("p_partkey", "p_brand").coalesce(1), path, CsvOutput(header=True))
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS line FROM region")
def json_output(spark, sf_dir):
    path = work_path(spark, "json")
    write(read(spark, sf_dir, "region"), path, JsonOutput())
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS answer FROM region")
def json_array_output(spark, sf_dir):
    text = b"".join(encode(read(spark, sf_dir, "region").orderBy("r_regionkey"), JsonOutput(array=True))).decode()  # five rows
    return spark.createDataFrame([(text,)], "answer string")


@query("SELECT unnest(['Records', 'Progress', 'Stats', 'End']) AS event, unnest([1, 2, 3, 4]) AS position")
def event_frames(spark, sf_dir):
    path = work_path(spark, "csv")
    write(read(spark, sf_dir, "region"), path, CsvOutput())
    answer = Engine(spark).select(SelectRequest("SELECT _2 FROM s3object", CsvInput(), progress=True), path)
    return spark.createDataFrame([(h[":event-type"], n + 1) for n, (h, _) in enumerate(read_frames(answer))], "event string, position int")


@query("SELECT ext AS object, kind FROM (SELECT unnest(['a.csv', 'b.tsv', 'c.jsonl', 'd.pq', 'e.exe', 'text/csv', 'application/x-ndjson; charset=utf-8', 'application/octet-stream']) AS ext, unnest(['CsvInput', 'CsvInput', 'JsonInput', 'ParquetInput', NULL, 'CsvInput', 'JsonInput', 'ParquetInput']) AS kind) t")
def format_detection(spark, sf_dir):
    names = ["a.csv", "b.tsv", "c.jsonl", "d.pq", "e.exe"]
    types = ["text/csv", "application/x-ndjson; charset=utf-8", "application/octet-stream"]
    found = [(n, input_by_extension(n)) for n in names] + [(t, input_by_content_type(t)) for t in types]
    return spark.createDataFrame([(n, type(f).__name__ if f else None) for n, f in found], "object string, kind string")


# -- the catalog -------------------------------------------------------------------------------------


def listing_keys(spark, sf_dir):
    return read(spark, sf_dir, "pages")


def event_versions(spark, sf_dir):
    """events as versions of objects: a key per user and type, an error a delete marker."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("b").alias("bucket"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("version_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("created_at"), (F.col("value") % 5 < 1).alias("is_delete_marker"), F.round("value").cast("long").alias("size"),
    )


_VERSIONS = "v AS (SELECT 'b' AS bucket, user_id || '/' || event_type AS key, event_id AS version_id, epoch_us(ts) * 1000 AS created_at, value % 5 < 1 AS is_delete_marker, CAST(round(value) AS BIGINT) AS size FROM events)"
_HISTORY = _VERSIONS + ", h AS (SELECT *, row_number() OVER w - 1 AS version_pos, coalesce(lag(created_at) OVER w, created_at) AS noncurrent_since, count(*) OVER (PARTITION BY key) AS n_versions FROM v WINDOW w AS (PARTITION BY key ORDER BY created_at DESC, version_id DESC))"


@query(f"WITH {_HISTORY} SELECT key, version_id, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, version_id) AS rn FROM v) t WHERE rn = 1 AND NOT is_delete_marker")
def latest_version_per_key(spark, sf_dir):
    return listing.latest_versions(event_versions(spark, sf_dir), modified="created_at").select("key", "version_id", "size")


@query("SELECT entry, kind, count(*) AS n_keys FROM (SELECT CASE WHEN strpos(substr(url, 9), '/') > 0 THEN substr(url, 1, 8 + strpos(substr(url, 9), '/')) ELSE url END AS entry, CASE WHEN strpos(substr(url, 9), '/') > 0 THEN 'prefix' ELSE 'key' END AS kind FROM pages WHERE starts_with(url, 'https://')) t GROUP BY entry, kind ORDER BY entry, kind LIMIT 1001")
def list_prefix_delimiter(spark, sf_dir):
    return listing.list_entries(listing_keys(spark, sf_dir), "https://", "/", key="url")


@query("SELECT url AS entry, row_number() OVER (ORDER BY url) AS position, TRUE AS is_truncated, max(url) OVER () AS next_marker FROM (SELECT DISTINCT url FROM pages WHERE url > 'http://t' ORDER BY url LIMIT 10) t")
def list_keyset_page(spark, sf_dir):
    return listing.list_page(listing_keys(spark, sf_dir), start_after="http://t", max_keys=10, key="url").select("entry", "position", "is_truncated", "next_marker")


@query(f"WITH {_HISTORY} SELECT key, version_id, version_pos, version_pos = 0 AS is_latest FROM h WHERE starts_with(key, '1') AND (key > '10/click' OR (key = '10/click' AND version_pos > 1)) ORDER BY key, version_pos LIMIT 500")
def list_versions(spark, sf_dir):
    return listing.list_versions(event_versions(spark, sf_dir), "1", "10/click", 1, 500).select("key", "version_id", "version_pos", "is_latest")


@query(f"WITH {_VERSIONS} SELECT DISTINCT key || '/part' AS entry FROM v WHERE starts_with(key, '2') ORDER BY 1 LIMIT 30")
def list_objects_live(spark, sf_dir):
    keys = event_versions(spark, sf_dir).withColumn("is_delete_marker", F.lit(False)).withColumn("key", F.concat("key", F.lit("/part")))
    return listing.list_objects(keys, "2", max_keys=30, modified="created_at").select("entry")


_NOW = 1706745600 * 10**9  # 2024-02-01


def _rules(spark):
    return lifecycle.rules_frame(spark, [lifecycle.Rule("b", "r1", prefix="1", expire_days=20), lifecycle.Rule("b", "r2", expire_days=25), lifecycle.Rule("b", "r3", noncurrent_days=15), lifecycle.Rule("b", "r4", prefix="2", expired_marker=True), lifecycle.Rule("b", "off", False, expire_days=1)])


_DAY = lifecycle.DAY_NS


@query(
    f"WITH {_HISTORY}, a AS (SELECT key, version_id, 'expire_current' AS action, 'r1' AS rule_id FROM h WHERE version_pos = 0 AND NOT is_delete_marker AND starts_with(key, '1') AND {_NOW} - created_at >= 20 * {_DAY}"
    f" UNION ALL SELECT key, version_id, 'expire_current', 'r2' FROM h WHERE version_pos = 0 AND NOT is_delete_marker AND {_NOW} - created_at >= 25 * {_DAY}"
    f" UNION ALL SELECT key, version_id, 'expire_noncurrent', 'r3' FROM h WHERE version_pos > 0 AND NOT is_delete_marker AND {_NOW} - noncurrent_since >= 15 * {_DAY}"
    " UNION ALL SELECT key, version_id, 'drop_marker', 'r4' FROM h WHERE is_delete_marker AND n_versions = 1 AND starts_with(key, '2')) SELECT key, version_id, action, min(rule_id) AS rule_id FROM a GROUP BY key, version_id, action"
)
def lifecycle_actions(spark, sf_dir):
    return lifecycle.lifecycle_actions(event_versions(spark, sf_dir), _rules(spark), _NOW).drop("bucket")


@query(f"WITH {_HISTORY} SELECT key, version_id, noncurrent_since FROM h WHERE version_pos > 0")
def noncurrent_since(spark, sf_dir):
    return lifecycle.with_history(event_versions(spark, sf_dir)).where("version_pos > 0").select("key", "version_id", "noncurrent_since")


@query(f"WITH {_VERSIONS} SELECT version_id, (version_id % 11 = 0 OR (version_id % 3 = 1 AND {_NOW} < created_at + 10 * {_DAY})) AS blocked, (version_id % 11 = 0 OR (version_id % 3 > 0 AND {_NOW} < created_at + 10 * {_DAY})) AS blocked_without_bypass FROM v")
def retention_check(spark, sf_dir):
    v, i = event_versions(spark, sf_dir), F.col("version_id")
    mode, until = F.when(i % 3 == 1, "COMPLIANCE").when(i % 3 == 2, "GOVERNANCE"), lifecycle.retain_until(F.col("created_at"), F.lit(10), F.lit(None).cast("int"))
    return v.select("version_id", lifecycle.delete_blocked(i % 11 == 0, mode, until, _NOW, True).alias("blocked"), lifecycle.delete_blocked(i % 11 == 0, mode, until, _NOW).alias("blocked_without_bypass"))


def _blobs(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), (F.col("doc_id") % 7).alias("volume_id"), F.col("doc_id").alias("offset"), F.col("doc_id").alias("sequence"), F.octet_length("text").cast("long").alias("blob_bytes"), "source", "text", "doc_id")


@query("SELECT sha256(text) AS content_hash, min(doc_id) % 7 AS volume_id, min(doc_id) AS \"offset\", count(*) AS ref_count FROM documents GROUP BY text")
def dedup_refcount(spark, sf_dir):
    return storage.ref_counts(_blobs(spark, sf_dir))


@query("SELECT count(DISTINCT text) AS unique_blobs, count(*) AS total_refs, 1 - count(DISTINCT text) / count(*) AS ratio FROM documents")
def dedup_ratio(spark, sf_dir):
    return storage.dedup_ratio(storage.ref_counts(_blobs(spark, sf_dir)))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id)")
def orphan_antijoin(spark, sf_dir):
    return storage.orphans(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), read(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id"), on="doc_id")


@query("SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS live, count(*) AS scanned, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS removed FROM documents")
def mark_sweep_counts(spark, sf_dir):
    return storage.sweep_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("WITH b AS (SELECT doc_id % 7 AS volume_id, octet_length(encode(text)) AS n, doc_id IN (SELECT doc_id FROM labels) AS live FROM documents), f AS (SELECT volume_id, count(*) FILTER (WHERE live) AS live_blobs, count(*) FILTER (WHERE NOT live) AS dead_blobs, CAST(coalesce(sum(n) FILTER (WHERE live), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(n) FILTER (WHERE NOT live), 0) AS BIGINT) AS dead_bytes FROM b GROUP BY volume_id) SELECT *, dead_bytes / (live_bytes + dead_bytes) AS fragmentation FROM f WHERE dead_bytes / (live_bytes + dead_bytes) >= 0.3 AND dead_bytes >= 10000 AND volume_id <> 6 ORDER BY 6 DESC, 1 LIMIT 4")
def fragmentation_plan(spark, sf_dir):
    live = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("offset"), (F.col("doc_id") % 7).alias("volume_id"))
    volumes = storage.fragmentation(storage.live_split(_blobs(spark, sf_dir), live, ["volume_id", "offset"]))
    return storage.compaction_plan(volumes, active=6, dead_bytes=10_000, most=4)


@query("SELECT source AS bucket, count(*) AS n_objects, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, grouping(source) = 1 AS is_total FROM documents GROUP BY ROLLUP (source)")
def bucket_stats_rollup(spark, sf_dir):
    return storage.bucket_stats(_blobs(spark, sf_dir).select(F.col("source").alias("bucket"), F.col("blob_bytes").alias("size")))


@query("SELECT source, count(*) FILTER (WHERE doc_id % 10 <> 0) AS n_ok, count(*) FILTER (WHERE doc_id % 10 = 0) AS n_corrupt FROM documents GROUP BY source")
def scrub_checksums(spark, sf_dir):
    stored = _blobs(spark, sf_dir).withColumn("content_hash", F.when(F.col("doc_id") % 10 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash"))).withColumn("crc", F.crc32(F.col("text").cast("binary")))
    return storage.scrub_summary(storage.scrub(stored, "text", "crc", "content_hash"), "source")


@query("SELECT event_id AS version FROM events WHERE event_type = 'error' AND 1000000 - event_id > 995000 AND event_id <= 4000 AND user_id % 3 <> 2")
def tombstone_gc(spark, sf_dir):
    dead = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("version"), F.col("event_id").alias("deleted_at"), (F.col("user_id") % 3).alias("range_start"))
    cuts = spark.createDataFrame([(0, "a", 4000), (0, "b", 9000), (1, "a", 4000), (2, "a", 9000), (2, "b", None)], "range_start long, replica string, cut long")
    return storage.purgeable_tombstones(dead, cuts, 1_000_000, 995_000).select("version")


@query("SELECT count(*) FILTER (WHERE doc_id % 5 = 0) AS n_inline, count(*) AS n_objects FROM documents")
def inline_objects(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 == 0, F.lit(storage.INLINE_FILE)).otherwise(F.col("doc_id")).alias("file_id"))
    return storage.inline_count(rows)


@query("SELECT CAST(e.event_id AS VARCHAR) AS version_id, 'u' || user_id AS key FROM events e UNION ALL SELECT 'null', 'u' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def unversioned_keys(spark, sf_dir):
    versioned = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("version_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"))
    plain = read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"))
    return listing.with_unversioned(versioned, plain)


@query("SELECT user_id AS key, event_id AS version_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS version_pos, value FROM events")
def version_lists(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version_id"), "value")
    lists = e.groupBy("key").agg(F.sort_array(F.collect_list("version_id"), asc=False).alias("versions"))
    return listing.exploded_versions(lists, e).withColumn("version_pos", F.col("version_pos").cast("long"))


@query("SELECT DISTINCT 'b' || l_partkey AS blob_id FROM lineitem")
def manifest_blobs(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    manifests = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("part_number"), F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("blob_id"))).alias("segments"))
    return storage.referenced_blobs(manifests)


_RING = "('0x' || substr(sha256(url), 1, 15))::BIGINT"


@query(f"SELECT url, {_RING} AS position FROM pages WHERE ({_RING} >= 1000000 AND {_RING} < 100000000000000000) OR ({_RING} >= 576460752303423488 AND {_RING} < 800000000000000000)")
def keys_to_repair(spark, sf_dir):
    ranges = spark.createDataFrame([(1_000_000, 10**17), (2**59, 8 * 10**17), (5, 5)], "range_start long, range_end long")
    return replicas.keys_in_ranges(read(spark, sf_dir, "pages").select("url", fn.ring_position(F.col("url")).alias("position")), ranges)


@query("SELECT count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND source <> 'src3'")
def listed_objects(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    key = F.when(F.col("doc_id") % 5 == 0, F.lit("k#v")).otherwise(F.lit("k"))
    bucket = F.when(F.col("source") == "src3", F.lit("__system")).otherwise(F.col("source"))
    return d.where(storage.is_listed(bucket, key, F.col("doc_id") % 7 == 0)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query(f"WITH {_VERSIONS}, r AS (SELECT *, CASE WHEN strpos(substr(key, 2), '/') > 0 THEN substr(key, 1, 1 + strpos(substr(key, 2), '/')) END AS p FROM v WHERE starts_with(key, '1')), e AS (SELECT key AS entry, 'version' AS kind, version_id AS version, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, version_id DESC) - 1 AS version_pos FROM r WHERE p IS NULL UNION ALL SELECT DISTINCT p, 'prefix', CAST(NULL AS BIGINT), 0 FROM r WHERE p IS NOT NULL) SELECT entry, kind, version, CAST(version_pos AS INTEGER) AS version_pos FROM e ORDER BY entry, version_pos LIMIT 40")
def versions_by_delimiter(spark, sf_dir):
    return listing.list_version_entries(event_versions(spark, sf_dir), "1", "/", max_keys=40)


@query("SELECT l_linenumber AS part_number, l_quantity AS size FROM lineitem WHERE l_orderkey = 7 AND l_linenumber > 1 ORDER BY l_linenumber LIMIT 3")
def multipart_parts(spark, sf_dir):
    parts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("upload_id"), F.col("l_linenumber").alias("part_number"), F.col("l_quantity").alias("size"))
    return listing.list_parts(parts, "7", 1, 3).select("part_number", "size")


@query("SELECT CAST(r_regionkey AS INTEGER) AS pool_id, 100 - 10 * ((r_regionkey * 3) % 5) AS free FROM region ORDER BY free DESC, pool_id LIMIT 1")
def freest_pool(spark, sf_dir):
    pools = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pool_id"), F.lit(100).alias("total"), (F.col("r_regionkey") * 3 % 5 * 10).alias("used"))
    return listing.most_free(pools)


@query("SELECT user_id AS key, event_id, value FROM events WHERE event_id > 2500")
def journal_tail(spark, sf_dir):
    journal = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "value")
    return streaming.tail(streaming.compacted(journal, 1000, "event_id"), 2500, "event_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND 10000 - greatest(event_id, user_id) > 4000")
def expired_uploads(spark, sf_dir):
    sessions = read(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.col("event_id").alias("updated_at"), F.col("user_id").alias("created_at"))
    return storage.expired_sessions(sessions, 10_000, 4_000).select("event_id")


@query("SELECT event_id AS hint_id, user_id AS target FROM events WHERE event_id + 5000 >= 9000 AND event_id % 3 <> 0 AND user_id % 4 = 1")
def hint_queue(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("hint_id"), F.col("user_id").alias("target"), F.col("event_id").alias("created_at"))
    return storage.pending_hints(e.where("target % 4 = 1"), e.where("hint_id % 3 = 0"), 9000, 5000).select("hint_id", "target")


@query("SELECT doc_id AS \"offset\", octet_length(encode(text)) AS blob_bytes FROM documents WHERE doc_id % 7 = 3")
def volume_scan(spark, sf_dir):
    return storage.scan_volume(_blobs(spark, sf_dir), 3).select("offset", "blob_bytes")


@query("SELECT r_regionkey, r_name FROM region")
def snapshot_restore(spark, sf_dir):
    path = work_path(spark, "snapshot")
    storage.snapshot({"region": read(spark, sf_dir, "region"), "nation": read(spark, sf_dir, "nation")}, path)
    return storage.restore(spark, path, "region")["region"]


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src2'")
def metadata_search(spark, sf_dir):
    objects = read(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    return storage.by_metadata(objects, lang="de", source="src2").select("doc_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def latency_histogram(spark, sf_dir):
    return streaming.windowed_latency(read(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT user_id, CAST(event_id % 7 AS INTEGER) AS slot, max(event_id) AS counter FROM events GROUP BY 1, 2")
def merged_vectors(spark, sf_dir):
    vectors = read(spark, sf_dir, "events").select("user_id", F.create_map((F.col("event_id") % 7).cast("int"), F.col("event_id")).alias("vector"))
    return replicas.merge_vectors(vectors, "user_id").select("user_id", F.explode("vector").alias("slot", "counter"))


@query(
    "SELECT event_id, CASE WHEN n > w THEN n ELSE w END AS tick_wall, CASE WHEN n > w THEN 0 ELSE l + 1 END AS tick_logical, greatest(w, ow, n) AS seen_wall,"
    " CASE WHEN greatest(w, ow, n) = w AND greatest(w, ow, n) = ow THEN greatest(l, ol) + 1 WHEN greatest(w, ow, n) = w THEN l + 1 WHEN greatest(w, ow, n) = ow THEN ol + 1 ELSE 0 END AS seen_logical FROM (SELECT event_id, event_id % 5 AS w, event_id % 3 AS l, user_id % 5 AS ow, user_id % 3 AS ol, event_id % 6 AS n FROM events) t"
)
def hlc_events(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    tick, seen = replicas.hlc_tick(e % 5, e % 3, e % 6), replicas.hlc_observe(e % 5, e % 3, u % 5, u % 3, e % 6)
    rows = read(spark, sf_dir, "events").select("event_id", tick.alias("tick"), seen.alias("seen"))
    return rows.select("event_id", F.col("tick.wall").alias("tick_wall"), F.col("tick.logical").alias("tick_logical"), F.col("seen.wall").alias("seen_wall"), F.col("seen.logical").alias("seen_logical"))


# -- replicas ------------------------------------------------------------------------------------------

_NODES = (("n0", 2), ("n1", 3), ("n2", 5))
_REPLICAS = "r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS node, user_id || '/' || event_type AS key, event_id AS wall, CAST(value AS BIGINT) % 3 AS logical, 'e' || event_id AS etag FROM events WHERE event_id % {m} <> 0" for n, m in _NODES) + ")"


def _replica(spark, sf_dir, node, m):
    e = read(spark, sf_dir, "events").where(F.col("event_id") % m != 0)
    return e.select(F.lit(node).alias("node"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("wall"), (F.round("value").cast("long") % 3).alias("logical"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("etag"))


@query(f"WITH {_REPLICAS} SELECT key, node, wall, etag FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY wall DESC, logical DESC, node DESC) AS rn FROM r) t WHERE rn = 1")
def replica_lww_merge(spark, sf_dir):
    return replicas.gathered([_replica(spark, sf_dir, n, m) for n, m in _NODES]).select("key", "node", "wall", "etag")


@query(f"WITH {_REPLICAS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, node ORDER BY wall DESC) AS rn FROM r) t WHERE rn = 1), w AS (SELECT *, max(wall) OVER (PARTITION BY key) AS top, count(*) OVER (PARTITION BY key) AS n FROM last) SELECT key, n AS n_answers, n >= 3 AS has_quorum, CASE WHEN n >= 3 THEN 'e' || max(top) END AS etag, CASE WHEN n >= 3 THEN n - count(*) FILTER (WHERE wall = top) END AS n_stale FROM w GROUP BY key, n")
def quorum_read(spark, sf_dir):
    answers = [replicas.merge_last_write(_replica(spark, sf_dir, n, m), hlc=("wall",)) for n, m in _NODES]
    return replicas.quorum_read(answers[0].unionByName(answers[1]).unionByName(answers[2]), 3, hlc=("wall",)).drop("stamp")


_LEAF = "('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT >> 54"


@query(f"SELECT {_LEAF} AS leaf, count(*) AS a_keys, count(*) FILTER (WHERE doc_id % 50 <> 0) AS b_keys FROM documents GROUP BY 1 HAVING count(*) FILTER (WHERE doc_id % 50 = 0 OR doc_id % 81 = 0) > 0")
def merkle_leaf_diff(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("n_chars").alias("etag"), "doc_id")
    other = d.where("doc_id % 50 <> 0").withColumn("etag", F.when(F.col("doc_id") % 81 == 0, -F.col("etag") - 1).otherwise(F.col("etag")))
    return replicas.merkle_diff(replicas.merkle_leaves(d, 64), replicas.merkle_leaves(other, 64)).withColumn("leaf", F.col("leaf").cast("long"))


_POS = "('0x' || substr(sha256({}), 1, 15))::BIGINT"


@query(
    f"WITH p AS (SELECT {_POS.format('n || chr(35) || k')} AS position, n AS node FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS n) x, (SELECT unnest(range(8)) AS k) y), k AS (SELECT url, {_POS.format('url')} AS place FROM (SELECT DISTINCT url FROM pages) u),"
    " d AS (SELECT url, node, min((position - place + 1152921504606846976) % 1152921504606846976) AS distance FROM k, p GROUP BY url, node)"
    " SELECT url, node, rank FROM (SELECT url, node, row_number() OVER (PARTITION BY url ORDER BY distance, node) AS rank FROM d) t WHERE rank <= 3"
)
def ring_replicas(spark, sf_dir):
    keys = read(spark, sf_dir, "pages").select("url").distinct()
    return replicas.ring_replicas(keys, replicas.ring(["a", "b", "c", "d"], 8, spark), 3, "url")


@query("SELECT user_id AS range_start, max(event_id) AS latest, min(m) AS least, count(DISTINCT event_type) AS replicas FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id, event_type) AS m FROM events) t GROUP BY user_id")
def frontier_cuts(spark, sf_dir):
    cuts = read(spark, sf_dir, "events").select(F.col("user_id").alias("range_start"), F.col("event_type").alias("replica"), F.col("event_id").alias("wall"))
    return replicas.frontier(cuts, hlc=("wall",)).select("range_start", F.col("latest.wall").alias("latest"), F.col("least.wall").alias("least"), "replicas")


@query("WITH x AS (SELECT user_id, max(event_id) AS top FROM events WHERE event_id % 3 = 0 GROUP BY user_id), y AS (SELECT user_id, max(event_id) AS top FROM events WHERE event_id % 3 <> 0 AND user_id % 2 = 0 GROUP BY user_id) SELECT x.user_id AS key, x.top AS wall FROM x LEFT JOIN y USING (user_id) WHERE y.top IS NULL OR x.top > y.top")
def anti_entropy_pull(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    top = lambda df: df.groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("wall"))
    return replicas.pull_plan(top(e.where("event_id % 3 <> 0 AND user_id % 2 = 0")), top(e.where("event_id % 3 = 0")), hlc=("wall",))


@query("SELECT o_orderkey, CASE WHEN a1 = b1 AND a2 = b2 THEN 'equal' WHEN a1 <= b1 AND a2 <= b2 THEN 'before' WHEN a1 >= b1 AND a2 >= b2 THEN 'after' ELSE 'concurrent' END AS relation FROM (SELECT o_orderkey, o_orderkey % 3 AS a1, o_custkey % 3 AS a2, o_custkey % 2 AS b1, o_orderkey % 2 AS b2 FROM orders) t")
def vector_compare(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = F.create_map(F.lit(1), o % 3, F.lit(2), c % 3), F.create_map(F.lit(2), o % 2, F.lit(1), c % 2)
    return read(spark, sf_dir, "orders").select("o_orderkey", replicas.compare_vectors(a, b).alias("relation"))


@query("SELECT n_nationkey, CASE WHEN 20 - n_nationkey <= 12 THEN 'rejoin' ELSE 'rebuild' END AS decision FROM nation")
def rejoin(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", replicas.rejoin_decision(F.col("n_nationkey"), 20, 12).alias("decision"))


# -- the journal -----------------------------------------------------------------------------------------


def _journal(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, (streaming.PUT, streaming.UPDATE, streaming.PUT, streaming.DELETE, streaming.UPDATE))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.lit("b").alias("bucket"), (F.col("user_id") % 50).cast("string").alias("key"), F.col("event_id").alias("sequence"), kind.alias("event_type"), F.col("value").alias("record"), F.create_map(F.col("event_type"), F.col("event_id").cast("string")).alias("updated_fields"))


@query(
    "WITH j AS (SELECT CAST(user_id % 50 AS VARCHAR) AS key, event_id, event_id % 5 AS e, value, event_type FROM events), base AS (SELECT key, max(event_id) AS s, arg_max(e, event_id) AS e, arg_max(value, event_id) AS record FROM j WHERE e IN (0, 2, 3) GROUP BY key),"
    " u AS (SELECT j.key, j.event_type, max(j.event_id) AS v FROM j JOIN base USING (key) WHERE j.e IN (1, 4) AND j.event_id > base.s AND base.e <> 3 GROUP BY j.key, j.event_type)"
    " SELECT base.key, record, s AS sequence, coalesce((SELECT string_agg(event_type || '=' || v, ',' ORDER BY event_type) FROM u WHERE u.key = base.key), '') AS fields FROM base WHERE e <> 3"
)
def journal_replay(spark, sf_dir):
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return streaming.replay(_journal(spark, sf_dir)).select("key", "record", "sequence", F.coalesce(F.array_join(F.array_sort(pairs), ","), F.lit("")).alias("fields"))


_LAST = "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1"


@query(_LAST)
def journal_replay_stream(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    folder = work_path(spark, "journal")
    e.repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    streaming.latest_stream(stream, "user_id", "event_id", f"{folder}/out", f"{folder}/checkpoint")
    return streaming.current(spark, f"{folder}/out", "user_id", "event_id")


@query("SELECT event_id % 1000 AS operation_id, count(*) > 1 AS again FROM events GROUP BY 1")
def idempotent_apply(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("operation_id"))
    again = e.groupBy("operation_id").agg((F.count(F.lit(1)) > 1).alias("again"))
    return streaming.apply_once(e).join(again, "operation_id")
