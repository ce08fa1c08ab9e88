"""Links within buckets and the connected groups that links make.

Both work without listing the pairs of a bucket of copies or holding a bucket
in one task: the members of a large bucket are compared with a representative
that a partial aggregation finds, only what that leaves apart is compared with
the rest, and groups are contracted to stars by joins on node ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objsql.llm.common import discard, settled, small_side, written

#: Buckets of up to so many members have all their pairs compared at once; rounds of representatives in larger ones.
SMALL, STARS = 8, 2
#: Tasks that the rest of a large bucket is dealt to.
SALTS = 16
#: Comparisons that the rest of a large bucket may need before it is left to ``blockwise``.
DIRECT = 4096


def verified_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], ratio: float, blockwise: Callable[[DataFrame, DataFrame], DataFrame] | None = None, prepare: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Links (a, b), a > b, that connect members (key, id, size) of a bucket just as all links between them would.

    ``verify`` gets candidate pairs (a, b) and returns those that hold, which
    ones whose sizes' quotient is under ``ratio`` never do; a pair is compared
    once however many buckets share it. In a bucket of up to SMALL members all
    pairs are. In a larger one representatives, each the member in most other
    buckets of those still apart, are compared with all that aren't connected to
    them yet. Then every member outside the representative's group is compared
    with all members that aren't connected to it by then: two texts in different
    groups can't both be in the representative's, so none of their links is
    lost. What is connected is never compared again, so a bucket of copies
    costs as much as it has members; one of many texts that are alike in the
    key alone costs the square of what is outside. Of large such buckets
    ``blockwise``, if given, gets the members outside and all members, both (key,
    id, size, own), and returns the links (a, b) between them, a > b. ``prepare``,
    if given, gets all ids that may be compared before any is.
    """
    spark, scratch = members.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        return written(df, "links", scratch)

    members = keep(members.distinct())
    sizes = keep(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = keep(members.join(small_side(sizes), "key"))
    links, checked = [], []

    def compare(pairs: DataFrame) -> None:
        pairs = pairs.where("id <> other").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
        for done in checked:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        checked.append(keep(pairs))
        links.append(settled(verify(checked[-1])))

    def like(x: str, y: str) -> Column:
        return F.least(x, y) >= ratio * F.greatest(x, y)

    little = members.where(F.col("n") <= SMALL)
    large = members.where(F.col("n") > SMALL)
    every = little.select("key", "id", "size").join(little.select("key", F.col("id").alias("other"), F.col("size").alias("its_size")), "key").where("id > other").where(like("size", "its_size")).select("id", "other").distinct()
    every = keep(every)
    if prepare:
        prepare(every.select(F.explode(F.array("id", "other")).alias("id")).union(large.select("id")).distinct())
    if large.isEmpty():
        compare(every)
        discard(spark, scratch)
        return links[0]
    degrees = keep(large.groupBy("id").agg(F.sum("n").alias("degree")))
    large = keep(large.join(small_side(degrees), "id"))
    order = F.struct("degree", F.xxhash64("id"))
    own = apart = large.withColumn("own", F.col("id"))
    groups = None
    for number in range(STARS):
        reps = apart.groupBy("key").agg(F.max_by(F.struct("id", "size", "own"), order).alias("rep"))
        reps = keep(reps.select("key", F.col("rep.id").alias("other"), F.col("rep.size").alias("its_size"), F.col("rep.own").alias("its")))
        star = own.join(small_side(reps), "key").where(F.col("own") != F.col("its")).where(like("size", "its_size")).select("id", "other")
        compare(star if number else star.union(every))
        # What was connected before is a star already.
        found = links[-1] if groups is None else links[-1].union(groups.select(F.col("id").alias("a"), F.col("root").alias("b")))
        groups = keep(connected_groups(found))
        named = large.join(small_side(groups.withColumnRenamed("root", "own")), "id", "left").withColumn("own", F.coalesce("own", "id"))
        own = keep(named)
        # The largest group of a bucket; what is outside it is still to be compared.
        first = keep(own.groupBy("key", "own").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("own", F.struct("m", "own")).alias("most")))
        apart = keep(own.join(small_side(first), "key").where(F.col("own") != F.col("most")).drop("most"))
        if apart.isEmpty():
            break
    else:
        counts = keep(apart.groupBy("key").agg((F.count(F.lit(1)) * F.max("n")).alias("cost")))
        direct = apart.join(small_side(counts.where(F.col("cost") <= DIRECT)), "key", "left_semi") if blockwise else apart
        # Members are dealt to tasks; each task sees all that is apart.
        left = direct.select("key", "id", "size", "own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        right = own.join(small_side(counts.select("key")), "key", "left_semi")
        right = right.select("key", F.col("id").alias("other"), F.col("size").alias("its_size"), F.col("own").alias("its"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
        rest = left.join(right, ["key", "salt"]).where(F.col("own") != F.col("its")).where(like("size", "its_size")).select("id", "other")
        compare(rest)
        crowded = counts.where(F.col("cost") > DIRECT).select("key")
        if blockwise and not crowded.isEmpty():
            crowded = small_side(crowded)
            links.append(settled(blockwise(apart.join(crowded, "key", "left_semi"), own.join(crowded, "key", "left_semi"))))
    discard(spark, scratch)
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    return found


def connected_groups(links: DataFrame) -> DataFrame:
    """(id, root) for each node of the links (a, b): root is the least id of its connected group, and every node but the root has a row.

    Large-star and small-star contraction: every step points nodes at the least
    of their neighbours, until nothing changes. The number of steps grows with
    the logarithm of the group's diameter. Least neighbours are found by partial
    aggregation, so a group's root, which has all its nodes as neighbours, makes
    no hot key there; edges that are star-shaped already are left out of the joins.
    """
    spark, old, new = links.sparkSession, [], []
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", old)
    before = None
    while True:
        # Small star: a node's smaller neighbours and itself point at the least of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        several = small_side(written(least.where("m <> x").select("u", "m"), "edges", old))
        moved = edges.join(several, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", old)
        # Large star: a node's larger neighbours point at the least of its neighbourhood; only neighbours of nodes that have a smaller one move.
        above = written(small.groupBy("u").agg(F.min("v").alias("m")), "edges", old)
        lower = small_side(above.select(F.col("u").alias("v"), "m"))
        edges = written(small.join(lower, "v", "left").select("u", F.coalesce("m", "v").alias("v")).union(above.select("u", F.col("m").alias("v"))).distinct(), "edges", new)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, old)
        old, new = new, old
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state
