"""Content dedup, space reclamation, garbage collection and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE_FILE = 2**32 - 1
FRAGMENTATION, DEAD_BYTES, VOLUMES = 0.3, 10 << 20, 10


def ref_counts(blobs: DataFrame, content_hash: str = "content_hash", location: tuple[str, ...] = ("volume_id", "offset"), order: str = "sequence") -> DataFrame:
    """Each content once: where it was stored first and how often it is referred to."""
    return blobs.groupBy(content_hash).agg(F.min_by(F.struct(*location), order).alias("first"), F.count(F.lit(1)).alias("ref_count")).select(content_hash, "first.*", "ref_count")


def dedup_ratio(refs: DataFrame, count: str = "ref_count") -> DataFrame:
    """unique_blobs, total_refs and ratio: the share of references that need no space, 0 without any."""
    both = refs.agg(F.count(F.lit(1)).alias("unique_blobs"), F.coalesce(F.sum(count), F.lit(0)).alias("total_refs"))
    return both.withColumn("ratio", F.when(F.col("total_refs") > 0, 1 - F.col("unique_blobs") / F.col("total_refs")).otherwise(0.0))


def is_listed(bucket: Column, key: Column, marker: Column) -> Column:
    """Whether a row counts in statistics: not a version row, a delete marker or in an internal bucket."""
    return ~key.contains("#") & ~F.coalesce(marker, F.lit(False)) & ~bucket.startswith("__")


def bucket_stats(objects: DataFrame, bucket: str = "bucket", size: str = "size") -> DataFrame:
    """Objects and bytes of each bucket, and of all in the row where ``bucket`` is null and is_total true."""
    return objects.rollup(bucket).agg(F.count(F.lit(1)).alias("n_objects"), F.sum(size).alias("bytes"), (F.grouping(bucket) == 1).alias("is_total"))


def live_split(blobs: DataFrame, live: DataFrame, on: list[str]) -> DataFrame:
    """Adds is_live: whether a row's location is in ``live``, whose size decides how it is joined."""
    return blobs.join(live.select(*on).distinct().withColumn("_live", F.lit(True)), on, "left").withColumn("is_live", F.col("_live").isNotNull()).drop("_live")


def fragmentation(blobs: DataFrame, volume: str = "volume_id", size: str = "blob_bytes") -> DataFrame:
    """Live and dead blobs and bytes of each volume (is_live as by ``live_split``) and the dead share of its bytes."""
    live = F.col("is_live")
    per = blobs.groupBy(volume).agg(
        F.count_if(live).alias("live_blobs"), F.count_if(~live).alias("dead_blobs"), F.sum(F.when(live, F.col(size)).otherwise(0)).alias("live_bytes"), F.sum(F.when(~live, F.col(size)).otherwise(0)).alias("dead_bytes")
    )
    total = F.col("live_bytes") + F.col("dead_bytes")
    return per.withColumn("fragmentation", F.when(total > 0, F.col("dead_bytes") / total).otherwise(0.0))


def compaction_plan(volumes: DataFrame, active: int | None = None, share: float = FRAGMENTATION, dead_bytes: int = DEAD_BYTES, most: int = VOLUMES, volume: str = "volume_id") -> DataFrame:
    """The volumes worth rewriting, most fragmented first: a run's worth of them, not the one being written."""
    found = volumes.where((F.col("fragmentation") >= share) & (F.col("dead_bytes") >= dead_bytes))
    if active is not None:
        found = found.where(F.col(volume) != active)
    return found.orderBy(F.col("fragmentation").desc(), volume).limit(most)


def scan_volume(blobs: DataFrame, volume: int, column: str = "volume_id", offset: str = "offset") -> DataFrame:
    """The blobs of one volume in the order they lie there."""
    return blobs.where(F.col(column) == volume).orderBy(offset)


def pending_hints(hints: DataFrame, delivered: DataFrame, now: int, ttl: int, target: str | None = None) -> DataFrame:
    """Hints (hint_id, target, created_at) still to be delivered at ``now``: not delivered yet and not older than ``ttl``, oldest first."""
    found = hints.where(F.col("created_at") + ttl >= now)
    if target is not None:
        found = found.where(F.col("target") == target)
    return found.join(delivered.select("hint_id"), "hint_id", "left_anti").orderBy("target", "created_at", "hint_id")


def orphans(found: DataFrame, *live: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``found`` that none of the live sets has."""
    keys = [on] if isinstance(on, str) else on
    for one in live:
        found = found.join(one.select(*keys), keys, "left_anti")
    return found


def referenced_blobs(manifests: DataFrame) -> DataFrame:
    """blob_id of every segment of the manifests."""
    return manifests.select(F.explode("segments").alias("s")).select("s.blob_id").distinct()


def sweep_counts(dedup: DataFrame, live: DataFrame, on: str = "content_hash") -> DataFrame:
    """live, scanned, removed: a mark and sweep of the dedup table in one pass."""
    marked = live_split(dedup, live, [on])
    return marked.agg(F.count_if("is_live").alias("live"), F.count(F.lit(1)).alias("scanned"), F.count_if(~F.col("is_live")).alias("removed"))


def expired_sessions(sessions: DataFrame, now: int, ttl: int) -> DataFrame:
    return sessions.where(F.lit(now) - F.greatest("updated_at", "created_at") > ttl)


def purgeable_tombstones(tombstones: DataFrame, cuts: DataFrame, now: int, grace: int, position: Column | None = None) -> DataFrame:
    """Tombstones older than ``grace`` that every replica of their range has passed: its cut is at or after their version.

    ``tombstones`` (key, version, deleted_at, range_start), ``cuts``
    (range_start, replica, cut): the least cut of a range decides, so a range
    without replicas purges nothing.
    """
    least = cuts.groupBy("range_start").agg(F.min("cut").alias("least"), F.count_if(F.col("cut").isNull()).alias("unknown"))
    old = tombstones.where(F.lit(now) - F.col("deleted_at") > grace)
    return old.join(least, "range_start").where((F.col("unknown") == 0) & (F.col("least") >= F.col("version"))).select(*tombstones.columns)


def scrub(blobs: DataFrame, content: str = "content", crc: str | None = "crc", sha256: str | None = None) -> DataFrame:
    """Adds ok: whether the content has the checksums stored with it."""
    fine = F.lit(True)
    if crc:
        fine = fine & F.crc32(F.col(content).cast("binary")).eqNullSafe(F.col(crc))
    if sha256:
        fine = fine & F.sha2(F.col(content).cast("binary"), 256).eqNullSafe(F.col(sha256))
    return blobs.withColumn("ok", fine)


def scrub_summary(scrubbed: DataFrame, *by: str) -> DataFrame:
    return scrubbed.groupBy(*by).agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_corrupt"))


def inline_count(objects: DataFrame, file_id: str = "file_id") -> DataFrame:
    return objects.agg(F.count_if(F.col(file_id) == INLINE_FILE).alias("n_inline"), F.count(F.lit(1)).alias("n_objects"))


def by_metadata(objects: DataFrame, **wanted: str) -> DataFrame:
    """Objects whose metadata map has the given values."""
    for k, v in wanted.items():
        objects = objects.where(F.try_element_at(F.col("metadata"), F.lit(k)) == v)
    return objects


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def restore(spark, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}
