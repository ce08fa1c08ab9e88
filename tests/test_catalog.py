import pytest
from pyspark.sql import functions as F

from objsql import streaming
from objsql.operators import lifecycle, listing, replicas, storage

D = lifecycle.DAY_NS


def test_latest_versions_ties_and_markers(spark):
    rows = [("a", "v1", 1, False), ("a", "v2", 2, True), ("b", "v2", 5, False), ("b", "v1", 5, False), ("c", "v1", 1, None)]
    df = spark.createDataFrame(rows, "key string, version_id string, modified_at long, is_delete_marker boolean")
    assert sorted((r.key, r.version_id) for r in listing.latest_versions(df).collect()) == [("b", "v1"), ("c", "v1")]


def test_pages_walk_the_whole_listing(spark):
    keys = ["a/1", "a/2", "b", "c/x/1", "c/y", "d", "/lead"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    seen, marker = [], ""
    while True:
        rows = listing.list_page(df, delimiter="/", start_after=marker, max_keys=2).orderBy("position").collect()
        seen += [(r.entry, r.kind, r.n_keys) for r in rows]
        if not rows or not rows[0].is_truncated:
            break
        marker = rows[0].next_marker
    assert seen == [("/", "prefix", 1), ("a/", "prefix", 2), ("b", "key", 1), ("c/", "prefix", 2), ("d", "key", 1)]
    assert [r.entry for r in listing.list_page(df, "c/", "/").collect()] == ["c/x/", "c/y"]
    assert listing.list_page(df, max_keys=0).count() == 0
    with pytest.raises(ValueError):
        listing.page_size(-1)
    with pytest.raises(ValueError):
        listing.page_size("x")


def test_unversioned_objects_join_the_versions(spark):
    v = spark.createDataFrame([("a", "1", 5), ("a", "2", 6)], "key string, version_id string, created_at long")
    plain = spark.createDataFrame([("a", 1), ("z", 2)], "key string, created_at long")
    rows = listing.list_versions(listing.with_unversioned(v, plain)).collect()
    assert [(r.key, r.version_id, r.version_pos, r.is_latest) for r in rows] == [("a", "2", 0, True), ("a", "1", 1, False), ("z", "null", 0, True)]


def test_lifecycle_boundaries(spark):
    now = 100 * D
    rows = [("b", "k29", "v", now - 29 * D, False), ("b", "k30", "v", now - 30 * D, False), ("b", "two", "v1", now - 60 * D, False), ("b", "two", "v2", now - 30 * D, False), ("b", "gone", "v", now - 1, True), ("u", "two", "v1", now - 60 * D, False), ("u", "two", "v2", now - 60 * D + 1, False)]
    df = spark.createDataFrame(rows, "bucket string, key string, version_id string, created_at long, is_delete_marker boolean")
    rules = lifecycle.rules_frame(spark, [lifecycle.Rule("b", "r", expire_days=30, noncurrent_days=30, expired_marker=True), lifecycle.Rule("u", "n", noncurrent_days=1)])
    got = {tuple(r) for r in lifecycle.lifecycle_actions(df, rules, now, spark.createDataFrame([("u",)], "bucket string")).collect()}
    assert got == {("b", "k30", "v", "expire_current", "r"), ("b", "two", "v2", "expire_current", "r"), ("b", "two", "v1", "expire_noncurrent", "r"), ("b", "gone", "v", "drop_marker", "r")}


@pytest.mark.parametrize("rules", [[], [lifecycle.Rule("b", "x")], [lifecycle.Rule("b", "x", expire_days=0)], [lifecycle.Rule("b", "x", expire_days=1)] * 2, [lifecycle.Rule("b", str(i), expire_days=1) for i in range(1001)]])
def test_bad_rules(rules):
    with pytest.raises(ValueError):
        lifecycle.check_rules(rules)


def test_tombstones_without_replicas_stay(spark):
    dead = spark.createDataFrame([("a", 5, 0, 0), ("b", 5, 0, 1), ("c", 9, 0, 0), ("d", 5, 99, 0)], "key string, version long, deleted_at long, range_start long")
    cuts = spark.createDataFrame([(0, "x", 8), (0, "y", 5)], "range_start long, replica string, cut long")
    assert [r.key for r in storage.purgeable_tombstones(dead, cuts, 100, 10).collect()] == ["a"]


def test_storage_edge_cases(spark):
    empty = spark.createDataFrame([], "content_hash string, volume_id int, offset long, sequence long")
    assert tuple(storage.dedup_ratio(storage.ref_counts(empty)).first()) == (0, 0, 0.0)
    blobs = spark.createDataFrame([(b"abc", 891568578, "x"), (b"abc", 1, "x"), (None, None, "y")], "content binary, crc long, v string")
    assert [r.ok for r in storage.scrub(blobs).collect()] == [True, False, True]
    manifests = spark.createDataFrame([("m", [(1, "b1"), (2, "b2"), (3, "b1")])], "id string, segments array<struct<part_number:int,blob_id:string>>")
    assert sorted(r.blob_id for r in storage.referenced_blobs(manifests).collect()) == ["b1", "b2"]
    objects = spark.createDataFrame([({"k": "v"},), ({},), (None,)], "metadata map<string,string>")
    assert storage.by_metadata(objects, k="v").count() == 1


def test_merge_by_clock(spark):
    df = spark.createDataFrame([("k", 5, 0, "a", "x"), ("k", 5, 1, "a", "y"), ("k", 5, 1, "b", "z"), ("j", 1, 0, "a", "w")], "key string, wall long, logical int, node string, etag string")
    assert {r.key: r.etag for r in replicas.merge_last_write(df).collect()} == {"k": "z", "j": "w"}


def test_merkle_finds_what_differs(spark):
    df = spark.createDataFrame([(f"k{i}", f"e{i}") for i in range(200)], "key string, etag string")
    other = df.where("key <> 'k7'").withColumn("etag", F.when(F.col("key") == "k9", "new").otherwise(F.col("etag")))
    a, b = replicas.merkle_leaves(df, 32), replicas.merkle_leaves(other, 32)
    diff = replicas.merkle_diff(a, b)
    found = {r.key for r in replicas.keys_in_leaves(df, diff, 32).collect()}
    assert {"k7", "k9"} <= found and len(found) < 60
    assert replicas.merkle_diff(a, a).count() == 0
    top = a
    for _ in range(5):
        top = replicas.merkle_parents(top)
    assert top.count() == 1 and top.first().n_keys == 200


def test_vectors(spark):
    df = spark.createDataFrame([("g", {1: 2, 2: 1}), ("g", {2: 5})], "g string, vector map<int,long>")
    assert replicas.merge_vectors(df, "g").first().vector == {1: 2, 2: 5}
    cases = spark.createDataFrame([({1: 1}, {1: 1}), ({1: 1}, {1: 2}), ({1: 1}, {}), ({1: 1}, {2: 1})], "a map<int,long>, b map<int,long>")
    assert [r[0] for r in cases.select(replicas.compare_vectors(F.col("a"), F.col("b"))).collect()] == ["equal", "before", "after", "concurrent"]


def test_replay(spark):
    rows = [("b", "k", 1, "put", "r1", None), ("b", "k", 2, "metadata_update", None, {"x": "1", "y": "1"}), ("b", "k", 3, "put", "r2", None), ("b", "k", 4, "metadata_update", None, {"x": "2"}), ("b", "k", 5, "metadata_update", None, {"x": "3"}), ("b", "d", 6, "put", "r", None), ("b", "d", 7, "delete", None, None), ("b", "u", 8, "metadata_update", None, {"x": "1"}), ("b", "m", 9, "delete_marker", "mk", None)]
    df = spark.createDataFrame(rows, "bucket string, key string, sequence long, event_type string, record string, updated_fields map<string,string>")
    got = {r.key: (r.record, r.fields) for r in streaming.replay(df).collect()}
    assert got == {"k": ("r2", {"x": "3"}), "m": ("mk", None)}
    assert streaming.tail(df, 7).count() == 2


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    make = lambda low, high: spark.range(low, high).selectExpr("id % 7 AS k", "id AS seq", "id * 2 AS v").coalesce(1)
    make(0, 50).write.parquet(f"{tmp_path}/in")
    run = lambda: streaming.latest_stream(spark.readStream.schema("k long, seq long, v long").parquet(f"{tmp_path}/in"), "k", "seq", f"{tmp_path}/out", f"{tmp_path}/cp")
    run()
    make(50, 60).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(tuple(r) for r in streaming.current(spark, f"{tmp_path}/out", "k", "seq").collect()) == sorted((s % 7, s, 2 * s) for s in range(53, 60))


def test_jobs_run_when_due():
    from objsql.streaming import run_jobs

    time, ran = [0.0], []

    def fail():
        ran.append("b")
        raise ValueError("no")

    done = run_jobs({"a": (2.0, lambda: ran.append("a")), "b": (3.0, fail)}, 6.0, lambda: time[0], lambda s: time.__setitem__(0, time[0] + s))
    assert ran == ["a", "b", "a", "b", "a", "a", "b"] and [n for n, e in done if e] == ["b"] * 3


def test_ring_replicas_of_few_nodes(spark):
    from objsql.operators import replicas

    keys = spark.range(200).selectExpr("cast(id as string) as key")
    got = replicas.ring_replicas(keys, replicas.ring(["x", "y"], 5, spark), 3).groupBy("key").count().collect()
    assert len(got) == 200 and all(r["count"] == 2 for r in got)
    plan = replicas.ring_replicas(keys, replicas.ring(["x", "y", "z"], 50, spark), 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
