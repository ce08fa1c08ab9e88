"""Lifecycle: which objects and versions rules expire, and whether retention blocks it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_NS = 86_400 * 10**9
MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    bucket: str
    rule_id: str
    enabled: bool = True
    prefix: str | None = None
    expire_days: int | None = None
    noncurrent_days: int | None = None
    expired_marker: bool = False


def check_rules(rules: list[Rule], most: int = MAX_RULES) -> None:
    """Raises ValueError for a rule set that can't be: none or too many, ids not unique, no action, days below 1."""
    if not rules:
        raise ValueError("at least one rule is needed")
    if len(rules) > most:
        raise ValueError(f"more than {most} rules")
    if len({(r.bucket, r.rule_id) for r in rules}) < len(rules):
        raise ValueError("rule ids must be unique in a bucket")
    for r in rules:
        if r.expire_days is None and r.noncurrent_days is None and not r.expired_marker:
            raise ValueError(f"rule {r.rule_id} has no action")
        if min(r.expire_days or 1, r.noncurrent_days or 1) < 1 or 0 in (r.expire_days, r.noncurrent_days):
            raise ValueError(f"rule {r.rule_id}: days must be 1 or more")


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    check_rules(rules)
    return spark.createDataFrame([tuple(vars(r).values()) for r in rules], "bucket string, rule_id string, enabled boolean, prefix string, expire_days int, noncurrent_days int, expired_marker boolean")


def with_history(versions: DataFrame, bucket: str = "bucket", key: str = "key", created: str = "created_at", version: str = "version_id") -> DataFrame:
    """Adds version_pos (0: current), n_versions and noncurrent_since: when the next newer version came, or the row's own time."""
    one = Window.partitionBy(bucket, key).orderBy(F.col(created).desc(), F.col(version).desc())
    newer = F.lag(created).over(one)
    return (
        versions.withColumn("version_pos", F.row_number().over(one) - 1)
        .withColumn("noncurrent_since", F.coalesce(newer, F.col(created)))
        .withColumn("n_versions", F.count(F.lit(1)).over(Window.partitionBy(bucket, key)))
    )


def lifecycle_actions(versions: DataFrame, rules: DataFrame, now_ns: int, unversioned: DataFrame | None = None) -> DataFrame:
    """(bucket, key, version_id, action, rule_id): what the enabled rules do at ``now_ns``.

    Actions are expire_current, expire_noncurrent and drop_marker; an age equal
    to a rule's days is old enough. A rule without a prefix is for all keys of
    its bucket. Noncurrent versions aren't expired in the ``unversioned``
    buckets. Each action of a version is given once, by the least rule id.
    Rules are a bounded configuration table (MAX_RULES), joined on the bucket.
    """
    active = F.broadcast(rules.where("enabled").withColumnRenamed("bucket", "_bucket"))
    history = with_history(versions)
    if unversioned is not None:
        history = history.join(F.broadcast(unversioned.select("bucket", F.lit(True).alias("_plain"))), "bucket", "left")
    else:
        history = history.withColumn("_plain", F.lit(None).cast("boolean"))
    marker = F.coalesce(F.col("is_delete_marker"), F.lit(False))
    age, since = F.lit(now_ns) - F.col("created_at"), F.lit(now_ns) - F.col("noncurrent_since")
    hit = history.join(active, (F.col("bucket") == F.col("_bucket")) & (F.coalesce("prefix", F.lit("")).eqNullSafe("") | F.col("key").startswith(F.col("prefix"))))
    actions = F.array_compact(
        F.array(
            F.when((F.col("version_pos") == 0) & ~marker & (age >= F.col("expire_days") * F.lit(DAY_NS)), "expire_current"),
            F.when((F.col("version_pos") > 0) & ~marker & F.col("_plain").isNull() & (since >= F.col("noncurrent_days") * F.lit(DAY_NS)), "expire_noncurrent"),
            F.when(F.col("expired_marker") & marker & (F.col("n_versions") == 1), "drop_marker"),
        )
    )
    return hit.select("bucket", "key", "version_id", F.explode(actions).alias("action"), "rule_id").groupBy("bucket", "key", "version_id", "action").agg(F.min("rule_id").alias("rule_id"))


def delete_blocked(legal_hold: Column, mode: Column, retain_until: Column, now_ns: int, bypass: bool = False) -> Column:
    """Whether retention keeps an object: a legal hold, or a time not yet come that is in COMPLIANCE mode or can't be bypassed."""
    held = F.coalesce(legal_hold, F.lit(False))
    kept = F.coalesce(F.lit(now_ns) < retain_until, F.lit(False)) & mode.isNotNull()
    return held | (kept & (mode == "COMPLIANCE")) if bypass else held | kept


def retain_until(start_ns: Column, days: Column, years: Column) -> Column:
    """The end of a retention of so many years of 365 days, or else days."""
    return start_ns + F.coalesce(years * 365, days) * F.lit(DAY_NS)
