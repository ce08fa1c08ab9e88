import json

import pytest

from objsql.plans import DialectError, Engine
from objsql.plans.dialect import check, object_tables, positions
from objsql.plans.engine import Limits, ObjectNotFound, QueryTimeout
from objsql.plans.rewrite import rewritten
from objsql.sources import CsvInput, CsvOutput, GlobRequest, JsonInput, JsonOutput, SelectRequest, parse_select_xml
from objsql.sources.readers import byte_range, fixed_folder, glob_regex, read_range
from objsql.sources.request import RequestError, input_by_content_type, input_by_extension
from objsql.sources.sinks import encode, event_stream, frame, read_frames

STOPS = "stop,tracks,zone\nHafen,4,A\nWaldrand,2,C\nRathaus,7,A\nMuehle,2,B\n"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def ask(engine, path, sql, given=CsvInput("USE"), dialect="extended"):
    return [tuple(r) for r in engine.query_object(SelectRequest(sql, given, dialect=dialect), path).collect()]


def test_csv_scans(engine, tmp_path):
    p = put(tmp_path, "p.csv", STOPS)
    assert len(ask(engine, p, "SELECT * FROM s3object")) == 4
    assert ask(engine, p, "SELECT stop FROM S3Object o WHERE o.tracks > 3 AND o.stop LIKE 'R%'", dialect="strict") == [("Rathaus",)]
    assert ask(engine, p, "SELECT _1, _2 + 1 FROM s3object WHERE _2 < 4 AND _3 = 'B'", CsvInput("IGNORE")) == [("Muehle", 3)]
    assert ask(engine, p, "SELECT count(*) FROM s3object", CsvInput("NONE")) == [(5,)]
    assert ask(engine, put(tmp_path, "q.csv", "'say \"hi\"',b,c\n"), "SELECT _1 FROM s3object", CsvInput(quote="'")) == [('say "hi"',)]
    assert ask(engine, put(tmp_path, "m.csv", "7↦seven↦sieben\n"), "SELECT _2 FROM s3object", CsvInput(delimiter="↦")) == [("seven",)]
    assert ask(engine, put(tmp_path, "e.csv", 'a,b\n"x, ""y""\nz",2\n'), "SELECT a, b FROM s3object", CsvInput("USE", quoted_newlines=True)) == [('x, "y"\nz', 2)]


def test_json_scans(engine, tmp_path):
    rows = '{"stop":"Hafen","tracks":4,"a":{"b":1}}\n{"stop":"Muehle"}\n'
    assert ask(engine, put(tmp_path, "l.json", rows), "SELECT stop, tracks, a.b FROM s3object", JsonInput()) == [("Hafen", 4, 1), ("Muehle", None, None)]
    assert ask(engine, str(tmp_path / "l.json"), "SELECT stop FROM s3object WHERE tracks IS MISSING", JsonInput()) == [("Muehle",)]
    assert len(ask(engine, put(tmp_path, "d.json", '[{"x":1},{"x":2}]'), "SELECT x FROM s3object", JsonInput("DOCUMENT"))) == 2
    assert ask(engine, put(tmp_path, "o.json", '{"x":1}'), "SELECT x FROM s3object", JsonInput("DOCUMENT")) == [(1,)]


def test_q1_aggregates_obey_where(engine, tmp_path):
    assert ask(engine, put(tmp_path, "p.csv", STOPS), "SELECT count(*), sum(tracks) FROM s3object WHERE tracks > 2", dialect="strict") == [(2, 11)]


def test_q7_q8_empty_input(engine, tmp_path):
    p = put(tmp_path, "h.csv", "a,b\n")
    assert ask(engine, p, "SELECT count(*), sum(try_cast(a AS BIGINT)) FROM s3object") == [(0, None)]


def test_q9_strings_compare_with_numbers_as_numbers(engine, tmp_path):
    p = put(tmp_path, "s.csv", "a,b\n9,u\n12,v\n")
    assert ask(engine, p, "SELECT b FROM s3object WHERE '9' > a") == [] and ask(engine, p, "SELECT b FROM s3object WHERE a > '10'") == [("v",)]


def test_q14_a_name_without_wildcard_is_one_object(engine, tmp_path):
    put(tmp_path, "a.csv", "x\n1\n")
    put(tmp_path, "b.csv", "x\n2\n")
    run = lambda sql: [tuple(r) for r in engine.query_glob(GlobRequest(sql), str(tmp_path)).collect()]
    assert run("SELECT x FROM 'a.csv'") == [(1,)]
    assert run("SELECT sum(x) FROM '*.csv'") == [(3,)]
    assert run("SELECT sum(x), 'from \"q\"' FROM s3object") == [(3, 'from "q"')]
    with pytest.raises(ObjectNotFound):
        run("SELECT x FROM 'none/*.csv'")
    with pytest.raises(ObjectNotFound):
        run("SELECT x FROM 'none.csv'")


def test_globs_across_folders(engine, tmp_path):
    for name in ("meter/north/1.csv", "meter/north/attic/2.csv", "meter/north/1.txt", "weather/1.csv"):
        put(tmp_path, name, "x\n1\n")
    answer = engine.answer(GlobRequest("SELECT sum(x) AS s FROM 'meter/**/*.csv'"), str(tmp_path))
    assert json.loads(answer) == [{"s": 2}]
    assert engine.answer(GlobRequest("SELECT x AS \"a b\" FROM 'meter/north/*.csv'", output="csv"), str(tmp_path)) == b"a b\n1\n"


@pytest.mark.parametrize(
    "pattern,yes,no",
    [("in/*.gz", ["in/x.gz"], ["in/x/y.gz", "out/x.gz"]), ("in/**/*.gz", ["in/7/y.gz", "in/x.gz"], ["in/7/y.zip"]), ("a?[0-9].txt", ["ab1.txt"], ["a/1.txt", "abx.txt"]), ("{a,b}/[!x]", ["a/y"], ["c/y", "a/x"])],
)
def test_glob_regex(pattern, yes, no):
    import re

    assert all(re.match(glob_regex(pattern), k) for k in yes) and not any(re.match(glob_regex(pattern), k) for k in no)


def test_folder_of_a_glob():
    assert [fixed_folder(p) for p in ("in/7/*.gz", "*.gz", "in/*/y/*.gz", "plain")] == ["in/7/", "", "in/", ""]


@pytest.mark.parametrize("sql", ["INSERT INTO t VALUES (1)", "DELETE FROM t", "DROP TABLE t", "CREATE TABLE t (a INT)", "", "SELECT 1; SELECT 2", "SELEC 1", "SET x = 1", "SHOW TABLES", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"])
def test_read_only(spark, sql):
    with pytest.raises(DialectError):
        check(spark, sql)


@pytest.mark.parametrize(
    "sql",
    ["SELECT a FROM t ORDER BY a", "SELECT a FROM t LIMIT 1", "SELECT a FROM t OFFSET 1", "SELECT a, count(*) FROM t GROUP BY a", "SELECT DISTINCT a FROM t", "SELECT a FROM t JOIN u ON t.a = u.a", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT sum(a) OVER () FROM t", "SELECT a FROM t UNION SELECT a FROM t", "SELECT a FROM t WHERE a IN (SELECT 1 FROM u)", "SELECT count(DISTINCT a) FROM t", "SELECT a FROM t, u", "SELECT 1"],
)
def test_q2_strict_names_what_it_does_not_take(spark, sql):
    check(spark, sql)
    with pytest.raises(DialectError):
        check(spark, sql, "strict")


def test_rewrites_leave_literals_alone():
    assert object_tables("SELECT 'from ''x''' FROM 'a*.csv' JOIN \"t\" ON 1=1 -- from 'z'") == ("SELECT 'from ''x''' FROM objects_0 JOIN \"t\" ON 1=1 -- from 'z'", ["a*.csv"])
    assert positions("SELECT _1, '_1', \"_2\", _9, x_1 FROM t", {"t": ["n", "m"]}) == "SELECT `n`, '_1', \"_2\", _9, x_1 FROM t"
    two = {"objects_0": ["k", "v"], "objects_1": ["k", "w"]}
    assert positions("SELECT a._2, b._2, _1 FROM objects_0 a JOIN objects_1 AS b ON a._1 = b._1", two) == "SELECT a.`v`, b.`w`, a.`k` FROM objects_0 a JOIN objects_1 AS b ON a.`k` = b.`k`"


def test_positions_in_a_join(engine, tmp_path):
    put(tmp_path, "a.csv", "k,v\n1,x\n2,y\n")
    put(tmp_path, "b.csv", "k,w\n2,z\n")
    got = engine.query_glob(GlobRequest("SELECT a._2, b._2 FROM 'a.csv' a JOIN 'b.csv' b ON a._1 = b._1"), str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("y", "z")]


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT substring('abcdef', -4, 6), SUBSTR('abcdef' FROM 0 FOR 2), substring('abc', 9), substring('abc', 2, -1)", ("abcdef", "ab", "", "")),
        ("SELECT trim(chr(9) || 'x '), TRIM(BOTH '.' FROM '..a..'), trim(LEADING 'xy' FROM 'xxaxx'), TRIM(TRAILING FROM 'b  '), trim('\u3000c')", ("x", "a", "axx", "b", "c")),
        ("SELECT to_timestamp('bad'), to_timestamp('2024-01-02 03:04:05') IS NULL, 'to_timestamp(1)'", (None, False, "to_timestamp(1)")),
        ("SELECT 7 / 2, 1 IS MISSING, count(*) FROM (VALUES (1), (2)) t(a) WHERE a < ANY (SELECT 2) AND 3 > ALL (SELECT a)", (3.5, False, 1)),
        ("SELECT TOP 1 a FROM (VALUES (3), (2)) t(a) ORDER BY a", (2,)),
        ("SELECT a FROM (SELECT a FROM (VALUES (3), (2), (1)) t(a) ORDER BY a OFFSET 1 ROW FETCH NEXT 1 ROW ONLY) u", (2,)),
        ("SELECT a FROM (VALUES (3), (2)) t(a) QUALIFY row_number() OVER (ORDER BY a) = 1", (2,)),
    ],
)
def test_forms_that_spark_lacks(engine, sql, want):
    rows = engine.query_tables(sql, {}).collect()
    assert [tuple(r) for r in rows] == [want]


def _goes_through_pairs(df):
    return "NestedLoop" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("op", ["=", "<>", "!=", "<", "<=", ">", ">="])
@pytest.mark.parametrize("which", ["ANY", "ALL"])
def test_any_and_all_read_the_subquery_once(engine, op, which):
    big = "(SELECT id AS a FROM range(300000)) t"
    df = engine.query_tables(f"SELECT count(*) AS n FROM {big} WHERE a {op} {which} (SELECT id + 1 FROM range(300000)) OR a < 0", {})
    assert not _goes_through_pairs(df)
    want = {("=", "ANY"): 299_999, ("<>", "ANY"): 300_000, ("<", "ANY"): 300_000, ("<=", "ANY"): 300_000, (">", "ANY"): 299_998, (">=", "ANY"): 299_999, ("<>", "ALL"): 1, ("<", "ALL"): 1, ("<=", "ALL"): 2}
    assert df.first().n == want.get((op.replace("!=", "<>"), which), 0)


def test_any_and_all_name_what_with_defines(engine):
    sql = "WITH c AS (SELECT id AS v FROM range(10)), d AS (SELECT v FROM c WHERE v >= ALL (SELECT v - 2 FROM c)) SELECT v FROM d WHERE v > ANY (WITH e AS (SELECT v FROM d) SELECT v FROM e) ORDER BY v"
    df = engine.query_tables(sql, {})
    assert not _goes_through_pairs(df)
    assert [r.v for r in df.collect()] == [8, 9]


@pytest.mark.parametrize("left,rows,values", [("a", "SELECT w FROM u", (10, 25, None)), ("a", "SELECT w FROM u WHERE k > 9", ()), ("a", "SELECT w FROM u WHERE w > 0", (10, 25)), ("a", "SELECT nullif(w, w) FROM u", (None,)), ("a", "SELECT string(w) FROM u", (10, 25, None)), ("a", "SELECT '9' UNION ALL SELECT '10'", (9, 10)), ("b", "SELECT string(w) FROM u", ("10", "25", None)), ("a", "SELECT w FROM u WHERE k = t.k", None)])
@pytest.mark.parametrize("negated", [False, True])
def test_any_and_all_are_three_valued(engine, left, rows, values, negated):
    table = [(1, 10, "10"), (2, 9, "9"), (3, None, None), (4, 30, "30")]
    test = {"=": lambda x, v: x == v, "<>": lambda x, v: x != v, "<": lambda x, v: x < v, ">=": lambda x, v: x >= v}
    views = "WITH t AS (SELECT * FROM VALUES (1, 10, '10'), (2, 9, '9'), (3, NULL, NULL), (4, 30, '30') AS t(k, a, b)), u AS (SELECT * FROM VALUES (1, 10), (2, 25), (3, NULL) AS u(k, w)) "
    by_key = {1: (10,), 2: (25,), 3: (None,)}
    forms, want = [], []
    for op in test:
        for which, sure in (("ANY", True), ("ALL", False)):
            forms.append(f"SELECT '{op} {which}' AS form, k FROM t WHERE {'NOT ' * negated}{left} {op} {which} ({rows})")
            for k, a, b in table:
                x = a if left == "a" else b
                found = [None if x is None or v is None else test[op](x, v) for v in (by_key.get(k, ()) if values is None else values)]
                if (sure if sure in found else None if None in found else not sure) is not negated and (sure in found or None not in found):
                    want.append((f"{op} {which}", k))
    got = engine.query_tables(views + " UNION ALL ".join(forms), {}).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_strict_numbers(engine, tmp_path):
    p = put(tmp_path, "n.csv", "a,b,f,s\n7,2,7.0,x\n")
    assert ask(engine, p, "SELECT a / b, f / b, a * 3 / b / 2, -a / b, CAST(s AS INT), CAST(a AS DECIMAL) / b FROM s3object WHERE a / b = 3", dialect="strict") == [(3, 3.5, 5, -3, None, 3.5)]
    assert ask(engine, p, "SELECT a / b FROM s3object") == [(3.5,)]
    assert ask(engine, p, "SELECT sum(a) / count(*) FROM s3object", dialect="strict") == [(7,)]
    for form in ("SELECT TOP 1 a FROM s3object", "SELECT a FROM s3object FETCH FIRST 1 ROWS ONLY", "SELECT a FROM s3object WHERE a > ALL (SELECT 1)"):
        with pytest.raises(DialectError):
            ask(engine, p, form, dialect="strict")


def test_rewrites_keep_the_rest():
    for sql in ("SELECT 'trim(x) TOP 3', \"substring(a, 1)\" FROM t -- fetch first 2 rows only", "SELECT a.trim FROM a", "SELECT (1", "SELECT top FROM t", "/* QUALIFY */ SELECT 1"):
        assert rewritten(sql) == sql


XML = """<SelectObjectContentRequest xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Expression>SELECT * FROM S3Object</Expression><ExpressionType>SQL</ExpressionType>
<InputSerialization><CSV><FileHeaderInfo>Use</FileHeaderInfo><FieldDelimiter>\\t</FieldDelimiter><QuoteCharacter></QuoteCharacter></CSV></InputSerialization>
<OutputSerialization><JSON/></OutputSerialization><ScanRange><Start>5</Start></ScanRange><RequestProgress><Enabled>true</Enabled></RequestProgress></SelectObjectContentRequest>"""


def test_requests():
    r = parse_select_xml(XML)
    assert (r.input.header, r.input.delimiter, r.input.quote, r.scan_range) == ("USE", "\t", "", (5, None)) and isinstance(r.output, JsonOutput)
    packed = parse_select_xml(XML.replace("<InputSerialization>", "<InputSerialization><CompressionType>GZIP</CompressionType>"))
    assert packed.compression == "GZIP" and r.compression == "NONE" and r.progress
    for bad in (XML.replace("<InputSerialization>", "<InputSerialization><CompressionType>ZIP</CompressionType>"), "<x", "<R/>", XML.replace("SELECT * FROM S3Object", ""), XML.replace("<QuoteCharacter></QuoteCharacter>", "<QuoteCharacter>ab</QuoteCharacter>")):
        with pytest.raises(RequestError):
            parse_select_xml(bad)
    for bad in ("{", '{"sql":"x","format":"avro"}', '{"sql":"x","output":"xml"}', "[]", "{}"):
        with pytest.raises(RequestError):
            GlobRequest.from_json(bad)
    assert input_by_extension("a/b.tsv").delimiter == "\t" and input_by_extension("a/b.exe") is None
    assert isinstance(input_by_content_type("application/x-ndjson; charset=utf-8"), JsonInput)


def test_sinks(spark):
    df = spark.createDataFrame([("a,b", 1, None), ('q"x', 2, "z")], "s string, n int, e string")
    assert b"".join(encode(df.orderBy("n"), CsvOutput(header=True))) == b's,n,e\n"a,b",1,\n"q""x",2,z\n'
    assert b"".join(encode(df.orderBy("n"), CsvOutput(quote="'", quote_all=True))) == b"'a,b','1',''\n'q\"x','2','z'\n"
    assert json.loads(b"".join(encode(df.orderBy("n"), JsonOutput(array=True)))) == [{"s": "a,b", "n": 1}, {"s": 'q"x', "n": 2, "e": "z"}]
    assert b"".join(encode(df.limit(0), JsonOutput(array=True))) == b"[]"


def test_event_stream(engine, tmp_path):
    p = put(tmp_path, "p.csv", STOPS)
    frames = list(read_frames(engine.select(SelectRequest("SELECT stop FROM s3object WHERE tracks > 3", CsvInput("USE")), p)))
    assert [h[":event-type"] for h, _ in frames] == ["Records", "Stats", "End"]
    assert frames[0][1] == b"Hafen\nRathaus\n" and f"<BytesScanned>{len(STOPS)}</BytesScanned>".encode() in frames[1][1]
    none = list(read_frames(engine.select(SelectRequest("SELECT stop FROM s3object WHERE tracks > 99", CsvInput("USE"), progress=True), p)))
    assert [h[":event-type"] for h, _ in none] == ["Stats", "End"]
    kinds = [h[":event-type"] for h, _ in read_frames(b"".join(event_stream(iter([b"ab", b"cd"]), 4, chunk=2, progress=True, idle_s=-1)))]
    assert kinds == ["Cont", "Records", "Progress"] * 2 + ["Stats", "End"]
    broken = bytearray(frame({"a": "b"}, b"xyz"))
    broken[-6] ^= 1
    with pytest.raises(ValueError):
        list(read_frames(bytes(broken)))


def test_ranges(spark, tmp_path):
    assert [byte_range(s, 10) for s in ("bytes=2-4", "bytes=-3", "bytes=8-", "bytes=5-99", "bytes=-11", "bytes=10-", "bytes=-", "x")] == [(2, 3), (7, 3), (8, 2), (5, 5), None, None, None, None]
    p = put(tmp_path, "r.bin", "0123456789")
    assert [bytes(read_range(spark, p, s).first().content) for s in ("bytes=2-4", "bytes=-3", "bytes=8-")] == [b"234", b"789", b"89"]
    assert read_range(spark, p, "bytes=10-").count() == 0


def test_scan_ranges_and_compression(engine, tmp_path):
    import bz2
    import gzip

    p = put(tmp_path, "p.csv", STOPS)
    scan = lambda start, end, given=CsvInput("USE"): [r[0] for r in engine.query_object(SelectRequest("SELECT _1 FROM s3object", given, scan_range=(start, end)), p).collect()]
    starts = [k + 1 for k, c in enumerate(STOPS) if c == "\n"][:-1]
    stops = ["Hafen", "Waldrand", "Rathaus", "Muehle"]
    for start in range(0, len(STOPS), 5):
        for end in (start, start + 7, len(STOPS)):
            assert scan(start, end) == [n for n, at in zip(stops, starts) if start <= at < end]
    assert scan(None, 12) == ["Muehle"] and scan(41, None) == ["Muehle"] and scan(0, 1, CsvInput("NONE")) == ["stop"]
    with pytest.raises(RequestError):
        scan(0, 9, CsvInput("USE", quoted_newlines=True))
    for kind, pack in (("GZIP", gzip.compress), ("BZIP2", bz2.compress)):
        (tmp_path / kind).write_bytes(pack(STOPS.encode()))
        got = engine.query_object(SelectRequest("SELECT count(*), sum(tracks) FROM s3object", CsvInput("USE"), compression=kind), str(tmp_path / kind)).first()
        assert tuple(got) == (4, 15)


def test_unreadable_objects_are_passed_over_if_asked(engine, tmp_path):
    put(tmp_path, "good.parquet.txt", "x")
    engine.spark.range(3).write.parquet(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*.parquet"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.parquet").write_bytes(part.read_bytes())
    (tmp_path / "b" / "2.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):
        engine.query_glob(GlobRequest("SELECT count(*) FROM '*.parquet'", "parquet"), str(tmp_path / "b")).collect()
    assert engine.query_glob(GlobRequest("SELECT count(*) AS n FROM '*.parquet'", "parquet", skip_unreadable=True), str(tmp_path / "b")).first().n >= 1


def test_limits(spark, tmp_path):
    p = put(tmp_path, "p.csv", STOPS)
    assert len(ask(Engine(spark, Limits(max_result_rows=4)), p, "SELECT * FROM s3object")) == 4
    with pytest.raises(Exception, match="more than 3 rows"):
        ask(Engine(spark, Limits(max_result_rows=3)), p, "SELECT * FROM s3object")
    slow = Engine(spark, Limits(timeout_s=1.0))
    with pytest.raises(QueryTimeout):
        slow.bounded(lambda: slow.spark.range(0, 1 << 42, 1, 4).selectExpr("sum(id % 7 * (id % 11))").collect())


def test_strict_casts(spark):
    from pyspark.sql import functions as F

    from objsql import functions as fn

    row = spark.range(1).select(*[fn.cast(F.lit(v), t).alias(f"c{k}") for k, (v, t) in enumerate([("abc", "INT"), ("1.5", "DECIMAL"), ("", "BIGINT"), ("12", "INTEGER"), ("2024-01-02", "DATE")])]).first()
    assert (row.c0, row.c1, row.c2, row.c3, str(row.c4)) == (None, 1.5, None, 12, "2024-01-02")
    with pytest.raises(ValueError):
        fn.cast(F.lit(1), "UUID")


@pytest.mark.parametrize("start,length,want", [(-1, 2, "ab"), (0, 2, "ab"), (1, 2, "ab"), (3, None, "cé"), (99, 1, ""), (2, -1, ""), (2, 0, "")])
def test_substring_clamps(spark, start, length, want):
    from pyspark.sql import functions as F

    from objsql.functions import substring

    assert spark.range(1).select(substring(F.lit("abcé"), start, length)).first()[0] == want


def test_trim(spark):
    from pyspark.sql import functions as F

    from objsql.functions import trim

    t = lambda s, *a: spark.range(1).select(trim(F.lit(s), *a)).first()[0]
    assert t(" \t　x \n") == "x" and t("xxaxx", "leading", "xy") == "axx" and t("..a..", "trailing", ".") == "..a" and t("\\a\\", "both", "\\") == "a"
