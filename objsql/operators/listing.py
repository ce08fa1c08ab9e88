"""Listings: prefixes, delimiters and pages over a table of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_KEYS = 1000


def page_size(asked: int | str | None) -> int:
    """The number of entries of a page: MAX_KEYS if none or more is asked; a negative or non-numeric number is an error."""
    if asked is None:
        return MAX_KEYS
    n = int(asked)
    if n < 0:
        raise ValueError(f"negative page size: {n}")
    return min(n, MAX_KEYS)


def latest_versions(objects: DataFrame, key: str = "key", modified: str = "modified_at", marker: str = "is_delete_marker", tiebreak: str = "version_id") -> DataFrame:
    """The newest row of each key, without keys whose newest row is a delete marker; of rows as new the least ``tiebreak`` wins.

    An aggregation, not a window: a key with many versions is folded before the
    shuffle and never gathered.
    """
    order = F.struct((-F.col(modified)).alias("age"), F.col(tiebreak).alias("tie"))
    newest = objects.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*objects.columns), order).alias("row"))
    return newest.select("row.*").where(~F.coalesce(F.col(marker), F.lit(False)))


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """The key up to the first delimiter after the prefix, or null without one."""
    at = F.locate(delimiter, key, len(prefix) + 1)
    return F.when(at > 0, F.substr(key, F.lit(1), at + (len(delimiter) - 1)))


def list_entries(keys: DataFrame, prefix: str = "", delimiter: str = "", start_after: str = "", max_keys: int = MAX_KEYS, key: str = "key") -> DataFrame:
    """(entry, kind, n_keys) of one page in byte order, and one entry more if there are further ones.

    kind is 'key', or 'prefix' for keys rolled up to a common prefix, which
    counts once. After a page that ended with a common prefix, that prefix is
    the marker, and none of its keys come again.
    """
    k = F.col(key)
    found = keys.where(k.startswith(prefix) & (k > start_after)) if start_after else keys.where(k.startswith(prefix))
    if delimiter:
        if start_after.endswith(delimiter) and start_after != prefix:
            found = found.where(~k.startswith(start_after))
        rolled = common_prefix(k, prefix, delimiter)
        found = found.select(F.coalesce(rolled, k).alias("entry"), F.when(rolled.isNotNull(), "prefix").otherwise("key").alias("kind"))
    else:
        found = found.select(k.alias("entry"), F.lit("key").alias("kind"))
    return found.groupBy("entry", "kind").agg(F.count(F.lit(1)).alias("n_keys")).orderBy("entry", "kind").limit(max_keys + 1)


def list_page(keys: DataFrame, prefix: str = "", delimiter: str = "", start_after: str = "", max_keys: int | str | None = None, key: str = "key") -> DataFrame:
    """The page with position, is_truncated and next_marker on each row; at most MAX_KEYS rows by then, so a window is cheap."""
    n = page_size(max_keys)
    if n == 0:
        return list_entries(keys, prefix, delimiter, start_after, 0, key).limit(0).selectExpr("entry", "kind", "n_keys", "0 position", "false is_truncated", "entry next_marker")
    entries = list_entries(keys, prefix, delimiter, start_after, n, key)
    w = Window.orderBy("entry", "kind")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = entries.withColumn("position", F.row_number().over(w)).withColumn("is_truncated", F.count(F.lit(1)).over(whole) > n)
    last = F.when(F.col("is_truncated"), F.max(F.when(F.col("position") == n, F.col("entry"))).over(whole))
    return placed.withColumn("next_marker", last).where(F.col("position") <= n)


def list_objects(objects: DataFrame, prefix: str = "", delimiter: str = "", start_after: str = "", max_keys: int | str | None = None, key: str = "key", **versions) -> DataFrame:
    """A page of the live objects: versions are collapsed before paging, over keys with the prefix only."""
    return list_page(latest_versions(objects.where(F.col(key).startswith(prefix)), key, **versions), prefix, delimiter, start_after, max_keys, key)


def list_versions(versions: DataFrame, prefix: str = "", key_marker: str = "", version_marker: int | None = None, max_keys: int = MAX_KEYS, key: str = "key", created: str = "created_at", version: str = "version_id") -> DataFrame:
    """All versions in order of key, newest first: adds version_pos and is_latest.

    The markers are those of the last page: with ``version_marker`` rows after
    that position of the key, without it from the key on.
    """
    w = Window.partitionBy(key).orderBy(F.col(created).desc(), F.col(version).desc())
    found = versions.where(F.col(key).startswith(prefix))
    if key_marker:
        found = found.where(F.col(key) >= key_marker)
    placed = found.withColumn("version_pos", F.row_number().over(w) - 1)
    if key_marker and version_marker is not None:
        placed = placed.where((F.col(key) > key_marker) | (F.col("version_pos") > version_marker))
    return placed.withColumn("is_latest", F.col("version_pos") == 0).orderBy(key, "version_pos").limit(max_keys)


def list_version_entries(versions: DataFrame, prefix: str, delimiter: str, start_after: str = "", max_keys: int = MAX_KEYS, key: str = "key", created: str = "created_at", version: str = "version_id") -> DataFrame:
    """entry, kind, version, version_pos of a page of versions in order: keys that go on past a delimiter are rolled up to one common prefix before the page is cut."""
    rolled = common_prefix(F.col(key), prefix, delimiter)
    found = versions.where(F.col(key).startswith(prefix))
    if start_after:
        found = found.where((F.col(key) > start_after) & ~(F.lit(start_after.endswith(delimiter)) & F.col(key).startswith(start_after)))
    w = Window.partitionBy(key).orderBy(F.col(created).desc(), F.col(version).desc())
    plain = found.where(rolled.isNull()).select(F.col(key).alias("entry"), F.lit("version").alias("kind"), F.col(version).alias("version"), (F.row_number().over(w) - 1).alias("version_pos"))
    prefixes = found.where(rolled.isNotNull()).select(rolled.alias("entry")).distinct().select("entry", F.lit("prefix").alias("kind"), F.lit(None).cast(versions.schema[version].dataType).alias("version"), F.lit(0).alias("version_pos"))
    return plain.unionByName(prefixes).orderBy("entry", "version_pos").limit(max_keys)


def with_unversioned(versioned: DataFrame, plain: DataFrame, key: str = "key", version: str = "version_id") -> DataFrame:
    """Versions, and the objects whose key has none as version 'null'."""
    lone = plain.join(versioned.select(key).distinct(), key, "left_anti").withColumn(version, F.lit("null"))
    return versioned.unionByName(lone, allowMissingColumns=True)


def exploded_versions(lists: DataFrame, records: DataFrame, key: str = "key", version: str = "version_id") -> DataFrame:
    """Version lists (key, versions newest first) joined with the records of the versions."""
    one = lists.select(key, F.posexplode("versions").alias("version_pos", version))
    return one.join(records, [key, version])


def list_parts(parts: DataFrame, upload: str, marker: int = 0, max_parts: int = MAX_KEYS) -> DataFrame:
    return parts.where((F.col("upload_id") == upload) & (F.col("part_number") > marker)).orderBy("part_number").limit(max_parts)


def most_free(pools: DataFrame, total: str = "total", used: str = "used", pool: str = "pool_id") -> DataFrame:
    """The pool with the most free space (none is negative); of equals the least."""
    free = F.greatest(F.col(total) - F.col(used), F.lit(0))
    return pools.agg(F.min_by(F.struct(pool, free.alias("free")), F.struct((-free).alias("a"), F.col(pool).alias("b"))).alias("best")).select("best.*")
