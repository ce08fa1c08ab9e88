"""Replicas: merging by last write, quorums, Merkle comparison, placement, clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objsql.functions import ring_position

RING_BITS = 60
HLC = ("wall", "logical", "node")


def clock(*columns: str) -> Column:
    """A hybrid clock as a struct, compared part by part."""
    return F.struct(*(columns or HLC))


def merge_last_write(entries: DataFrame, key: str = "key", hlc: tuple[str, ...] = HLC, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """For each key the entry with the latest clock; of equal clocks the greatest ``tiebreak``."""
    order = F.struct(*hlc, *tiebreak)
    return entries.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*entries.columns), order).alias("row")).select("row.*")


def gathered(nodes: list[DataFrame], **options) -> DataFrame:
    """The merged entries of several nodes."""
    whole = nodes[0]
    for one in nodes[1:]:
        whole = whole.unionByName(one, allowMissingColumns=True)
    return merge_last_write(whole, **options)


def quorum_read(entries: DataFrame, quorum: int, key: str = "key", node: str = "node", etag: str = "etag", hlc: tuple[str, ...] = HLC) -> DataFrame:
    """key, n_answers, has_quorum, the winning etag and clock, and n_stale: answers that differ from the winner. Null without a quorum."""
    stamp = F.struct(*hlc)
    # Counting the answers equal to each (etag, clock) first leaves little to a key's final fold.
    alike = entries.groupBy(key, F.col(etag).alias("etag"), stamp.alias("stamp")).agg(F.count(F.lit(1)).alias("n"))
    per = alike.groupBy(key).agg(F.sum("n").alias("n_answers"), F.max_by(F.struct("etag", "stamp", "n"), F.struct("stamp", "etag")).alias("win"))
    enough = F.col("n_answers") >= quorum
    return per.select(key, "n_answers", enough.alias("has_quorum"), F.when(enough, F.col("win.etag")).alias("etag"), F.when(enough, F.col("win.stamp")).alias("stamp"), F.when(enough, F.col("n_answers") - F.col("win.n")).alias("n_stale"))


def _limbs(text: Column) -> list[Column]:
    """A SHA-256 as six numbers of up to 48 bits, whose XOR the rollups use."""
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("long") for k in range(6)]


def merkle_leaves(entries: DataFrame, leaves: int, key: str = "key", content: str = "etag") -> DataFrame:
    """leaf, n_keys and h0..h5: the XOR of the digests of the entries in each of ``leaves`` equal parts of the ring."""
    place = ring_position(F.col(key))
    leaf = F.floor(place / F.lit(2**RING_BITS // leaves)).cast("int") if 2**RING_BITS % leaves == 0 else F.floor(place / F.lit(2**RING_BITS / leaves)).cast("int")
    limbs = _limbs(F.concat_ws("\x00", F.col(key), F.col(content).cast("string")))
    return entries.groupBy(leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n_keys"), *[F.bit_xor(x).alias(f"h{k}") for k, x in enumerate(limbs)])


def merkle_parents(level: DataFrame, fan_out: int = 2) -> DataFrame:
    """The next level up: XOR of each ``fan_out`` neighbours."""
    return level.groupBy(F.floor(F.col("leaf") / fan_out).cast("int").alias("leaf")).agg(F.sum("n_keys").alias("n_keys"), *[F.bit_xor(f"h{k}").alias(f"h{k}") for k in range(6)])


def merkle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """leaf, a_keys, b_keys for the leaves that differ, also those that one side lacks."""
    differs = ~F.lit(True)
    for k in range(6):
        differs = differs | ~F.col(f"a.h{k}").eqNullSafe(F.col(f"b.h{k}"))
    both = a.alias("a").join(b.alias("b"), F.col("a.leaf") == F.col("b.leaf"), "full")
    return both.where(differs).select(F.coalesce("a.leaf", "b.leaf").alias("leaf"), F.coalesce("a.n_keys", F.lit(0)).alias("a_keys"), F.coalesce("b.n_keys", F.lit(0)).alias("b_keys"))


def keys_in_leaves(entries: DataFrame, diff: DataFrame, leaves: int, key: str = "key") -> DataFrame:
    """The entries whose place on the ring is in a differing leaf: ranges of equal size, so an equi-join on the leaf."""
    leaf = F.floor(ring_position(F.col(key)) / F.lit(2**RING_BITS / leaves)).cast("int")
    return entries.withColumn("leaf", leaf).join(diff.select("leaf"), "leaf", "left_semi").drop("leaf")


#: Leading bits of a place on the ring that range joins are made on.
_BITS = 12


def _covered(low: Column, high: Column) -> Column:
    """The leading bits of the places from low to high, both included."""
    return F.explode(F.sequence(F.shiftright(low, RING_BITS - _BITS), F.shiftright(high, RING_BITS - _BITS)))


def keys_in_ranges(entries: DataFrame, ranges: DataFrame, position: str = "position") -> DataFrame:
    """The entries with a position in one of the ranges (range_start, range_end), the end not included: an equi-join on the leading bits, and a comparison."""
    spread = ranges.where("range_start < range_end").select("range_start", "range_end", _covered(F.col("range_start"), F.col("range_end") - 1).alias("_lead"))
    here = (F.shiftright(entries[position], RING_BITS - _BITS) == F.col("_lead")) & (entries[position] >= F.col("range_start")) & (entries[position] < F.col("range_end"))
    return entries.join(spread, here, "left_semi")


def ring(nodes: list[str], points: int, spark) -> DataFrame:
    """position, node: ``points`` places of each node on the ring; a cluster's configuration, bounded by its size."""
    made = spark.createDataFrame([(n, k) for n in nodes for k in range(points)], "node string, k int")
    return made.select(ring_position(F.concat_ws("#", "node", "k")).alias("position"), "node")


def ring_replicas(keys: DataFrame, places: DataFrame, replicas: int, key: str = "key") -> DataFrame:
    """key, node, rank: the first ``replicas`` distinct nodes clockwise from each key's place.

    The walk is worked out once for each gap between two ring points, on the
    driver: the ring is a cluster's configuration and no data. A key finds its
    gap by an equi-join on the leading bits of its place, and a comparison.
    """
    points = sorted({r.position: r.node for r in places.orderBy(F.desc("node")).collect()}.items())
    spans = []
    for n, (gap, _) in enumerate(points):
        nodes = _first_nodes(points, n, replicas)
        # Gap g covers (previous point, g]; the first also what lies beyond the last.
        spans.append((points[n - 1][0] if n else -1, gap, nodes))
    spans += [(points[-1][0], 2**RING_BITS - 1, spans[0][2])] if points and points[-1][0] < 2**RING_BITS - 1 else []
    table = keys.sparkSession.createDataFrame(spans, "low long, gap long, nodes array<string>")
    table = table.select("low", "gap", F.transform("nodes", lambda n, k: F.struct((k + 1).alias("rank"), n.alias("node"))).alias("nodes"), _covered(F.col("low") + 1, F.col("gap")).alias("lead"))
    placed = keys.select(F.col(key), ring_position(F.col(key)).alias("_place"))
    met = placed.join(table, (F.shiftright("_place", RING_BITS - _BITS) == F.col("lead")) & (F.col("_place") > F.col("low")) & (F.col("_place") <= F.col("gap")))
    return met.select(key, F.explode("nodes").alias("n")).select(key, "n.node", "n.rank")


def _first_nodes(points: list[tuple[int, str]], start: int, count: int) -> list[str]:
    """The first ``count`` distinct nodes from a point on, clockwise; fewer if there are no more."""
    found: list[str] = []
    for k in range(len(points)):
        node = points[(start + k) % len(points)][1]
        if node not in found:
            found.append(node)
            if len(found) == count:
                break
    return found


def frontier(cuts: DataFrame, by: str = "range_start", hlc: tuple[str, ...] = HLC) -> DataFrame:
    """For each range the latest and the least clock that its replicas have reached; ``cuts`` has one row per report."""
    reached = cuts.groupBy(by, "replica").agg(F.max(F.struct(*hlc)).alias("cut"))
    return reached.groupBy(by).agg(F.max("cut").alias("latest"), F.min("cut").alias("least"), F.count(F.lit(1)).alias("replicas"))


def pull_plan(local: DataFrame, peer: DataFrame, key: str = "key", hlc: tuple[str, ...] = HLC) -> DataFrame:
    """The peer's entries to write here: missing here, or with a later clock there."""
    own = local.select(F.col(key), F.struct(*hlc).alias("_own"))
    return peer.join(own, key, "left").where(F.col("_own").isNull() | (F.struct(*hlc) > F.col("_own"))).drop("_own")


def merge_vectors(vectors: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """The greatest counter of each slot of the version vectors of a group."""
    slots = vectors.select(by, F.explode(vector).alias("slot", "counter")).groupBy(by, "slot").agg(F.max("counter").alias("counter"))
    return slots.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "counter")))).alias(vector))


def compare_vectors(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent; a slot that is absent counts 0."""
    slots = F.array_union(F.map_keys(a), F.map_keys(b))
    of = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    le, ge = F.forall(slots, lambda k: of(a, k) <= of(b, k)), F.forall(slots, lambda k: of(a, k) >= of(b, k))
    return F.when(le & ge, "equal").when(le, "before").when(ge, "after").otherwise("concurrent")


def rejoin_decision(last_seen: Column, now: int, max_downtime: int) -> Column:
    """Whether a node that comes back may go on, or must be built anew; so too one never seen."""
    return F.when(F.lit(now) - last_seen <= max_downtime, "rejoin").otherwise("rebuild")


def hlc_tick(wall: Column, logical: Column, now: Column) -> Column:
    """A clock (wall, logical) after an event of its own at the time ``now``."""
    return F.when(now > wall, F.struct(now.alias("wall"), F.lit(0).cast("long").alias("logical"))).otherwise(F.struct(wall.alias("wall"), (logical + 1).cast("long").alias("logical")))


def hlc_observe(wall: Column, logical: Column, other_wall: Column, other_logical: Column, now: Column) -> Column:
    """A clock after it has seen another one at the time ``now``: later than both."""
    top = F.greatest(wall, other_wall, now)
    counter = F.when((top == wall) & (top == other_wall), F.greatest(logical, other_logical) + 1).when(top == wall, logical + 1).when(top == other_wall, other_logical + 1).otherwise(0)
    return F.struct(top.alias("wall"), counter.cast("long").alias("logical"))
