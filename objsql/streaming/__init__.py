"""Journal processing, in batches and as streams."""

from __future__ import annotations

import time as clock
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Event kinds of a journal.
PUT, DELETE, MARKER, UPDATE = "put", "delete", "delete_marker", "metadata_update"


def tail(journal: DataFrame, after: int, sequence: str = "sequence") -> DataFrame:
    """Entries after a sequence number; works on batches and streams."""
    return journal.where(F.col(sequence) > after)


def compacted(journal: DataFrame, safe: int, sequence: str = "sequence") -> DataFrame:
    """What is left when entries up to ``safe`` are dropped."""
    return tail(journal, safe, sequence)


def apply_once(entries: DataFrame, operation: str = "operation_id", time: str | None = None, horizon: str = "1 hour") -> DataFrame:
    """One entry per operation. On a stream ``time`` bounds what is remembered to ``horizon``."""
    if entries.isStreaming and time:
        return entries.withWatermark(time, horizon).dropDuplicatesWithinWatermark([operation])
    return entries.dropDuplicates([operation])


def replay(journal: DataFrame, key: tuple[str, ...] = ("bucket", "key"), sequence: str = "sequence", event: str = "event_type", record: str = "record", updates: str = "updated_fields") -> DataFrame:
    """The index after all entries: key, record, fields, sequence, for keys whose last put or marker no delete follows.

    Of each field the last update after that put counts. Both are aggregations
    that fold before the shuffle: last base event per key, last update per key
    and field; updates with no record to apply to are dropped.
    """
    base = journal.where(F.col(event).isin(PUT, DELETE, MARKER)).groupBy(*key).agg(F.max_by(F.struct(F.col(event).alias("event"), F.col(record).alias("record"), F.col(sequence).alias("sequence")), sequence).alias("base"))
    live = base.where(F.col("base.event") != DELETE).select(*key, "base.record", "base.event", F.col("base.sequence").alias("sequence"))
    changes = journal.where(F.col(event) == UPDATE).select(*key, F.col(sequence).alias("_at"), F.explode(updates).alias("field", "value"))
    fields = (
        changes.join(live.select(*key, "sequence"), list(key)).where(F.col("_at") > F.col("sequence")).groupBy(*key, "field").agg(F.max_by("value", "_at").alias("value"))
        .groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    )
    return live.join(fields, list(key), "left").select(*key, "record", "event", "fields", "sequence")


def latest_stream(stream: DataFrame, key: str, sequence: str, path: str, checkpoint: str) -> None:
    """Keeps the last row of each key of a stream under ``path``, a folder of changed rows per batch; runs what is available and stops.

    The last rows are in Spark's state store, so a batch reads and writes the
    keys that it has alone; one that is run again writes its own folder anew.
    """
    last = stream.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*stream.columns), sequence).alias("row"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("row.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = last.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark, path: str, key: str, sequence: str) -> DataFrame:
    """The state that ``latest_stream`` has reached: of each key the last change."""
    changes = spark.read.parquet(path).drop("batch")
    return changes.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*changes.columns), sequence).alias("row")).select("row.*")


def windowed_latency(events: DataFrame, time: str = "ts", value: str = "value", by: str = "event_type", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and 50th and 99th percentiles of a value by window, for batches and streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, [0.5, 0.99], 10_000).alias("p50_p99"))


def run_jobs(jobs: dict[str, tuple[float, Callable[[], object]]], until: float, now: Callable[[], float] = clock.monotonic, sleep: Callable[[float], None] = clock.sleep) -> list[tuple[str, BaseException | None]]:
    """Runs each job (seconds between runs, what to do) at once and then whenever it is due, one at a time, until the time ``until``.

    Returns the runs in order with what they raised; a job that fails is run
    again when it is due next.
    """
    due, done = {name: now() for name in jobs}, []
    while due:
        name = min(due, key=lambda n: (due[n], n))
        if due[name] > until:
            break
        if due[name] > now():
            sleep(due[name] - now())
        error = None
        try:
            jobs[name][1]()
        except Exception as e:  # a job's failure is its own
            error = e
        done.append((name, error))
        due[name] = max(due[name] + jobs[name][0], now())
    return done
