"""From signatures to classes of near-equal texts: banding, verification against leaders, and components.

A *unit* (a document, a paragraph) is known by the hash of its content, so copies are one unit from the start.
Units that share a band form a bucket.  A bucket is not compared all against all: in a round each unit is compared
with up to ``LEADERS`` leaders of its buckets, however many units those hold.  Buckets whose units still lie in several
components take other leaders in the next round.  What the leaders leave open is finished exactly: all units of buckets that still
hold several components meet over their rarest hashes (``links_between``).  So a pair is missed only if it shares no
bucket; two units of similarity ``s`` share one with probability ``1 - (1 - s ** rows) ** bands``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checked_broadcast, settle

SIMILARITY = 0.8
#: Rounds, and leaders a unit is compared with in each; they join the large classes cheaply, and what they leave open is finished exactly.
ROUNDS, LEADERS = 2, 3


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """The fewest bands of ``rows`` values that miss a pair of that similarity with at most that probability."""
    return math.ceil(math.log(miss) / math.log(1 - similarity ** rows))


def components(edges: DataFrame) -> DataFrame:
    """Rows (key, root) for every key of the edges (a, b): root is the smallest key of its component.

    Every round hangs each key's neighbours below the smallest of them, alternately all larger ones and all smaller
    ones, until nothing changes; the number of rounds grows with the logarithm of the size.
    """
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state_of = lambda e: e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = state_of(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        # large star: larger neighbours go below the smallest neighbour (or the key itself)
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select("b", "m").where("b <> m").distinct()
        # small star: smaller neighbours and the key itself go below the smallest neighbour
        low = large.groupBy("b").agg(F.min("m").alias("r"))
        small = large.join(low, "b").select(F.explode(F.array("b", "m")).alias("x"), "r").where("x <> r").distinct()
        edges = settle(small.select(F.col("r").alias("a"), F.col("x").alias("b")))
        state = state_of(edges)
        if state == seen:
            return edges.select(F.col("b").alias("key"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
        seen = state


def overlap(x: Column, y: Column) -> Column:
    """Jaccard of two arrays of distinct hashes."""
    shared = F.size(F.array_intersect(x, y))
    return shared / (F.size(x) + F.size(y) - shared)


def links_between(pool: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b): the roots of all pairs of units of the pool (key, root, size) that are similar and differ in root.

    An exact prefix filter.  All hashes have one order: those found under one root alone first (no pair asked for shares
    them), then from the rarest to the commonest.  Two similar sets x and y share at least
    ``similarity / (1 + similarity) * (|x| + |y|)`` hashes, so the first they share lies within the first
    ``1 - similarity`` of either, and enough of both sets comes after it.  The text of a template, which is common, comes
    last and is met only by units that hold little else.
    """
    tokens = held.join(checked_broadcast(pool.select("key", "root")), "key").select("key", "root", F.explode("hashes").alias("token"))
    mixed = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token", "n")
    ordered = tokens.select("key", "token").join(mixed, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("last"))
    spot = F.col("size") - F.size("last") + F.col("i")
    prefix = settle(ordered.join(checked_broadcast(pool), "key").select("key", "root", "size", "last", F.posexplode("last").alias("i", "t"))
                    .where(spot <= F.col("size") * (1 - similarity) + 1e-6).select(F.col("t.token").alias("token"), "key", "root", "size", spot.alias("spot")))
    x, y = (prefix.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "root", "size", "spot")]) for side in "xy")
    enough = similarity / (1 + similarity) * (F.col("size_x") + F.col("size_y")) - 1e-6
    pairs = settle(x.join(y, "token").where("root_x < root_y").where(F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y"))
                   .where(F.least(F.col("size_x") - F.col("spot_x"), F.col("size_y") - F.col("spot_y")) >= enough)
                   .select("key_x", "root_x", "key_y", "root_y").distinct())
    return (pairs.join(held.select(F.col("key").alias("key_x"), F.col("hashes").alias("x")), "key_x")
            .join(held.select(F.col("key").alias("key_y"), F.col("hashes").alias("y")), "key_y")
            .where(overlap(F.col("x"), F.col("y")) >= similarity)
            .select(F.col("root_x").alias("a"), F.col("root_y").alias("b")).distinct())


def joined_roots(roots: DataFrame | None, near: DataFrame) -> DataFrame:
    """``roots`` after the links (a, b) between roots."""
    joined = settle(components(near))
    if roots is None:
        return joined
    moved = roots.join(joined.select(F.col("key").alias("root"), F.col("root").alias("to")), "root", "left")
    return settle(moved.select("key", F.coalesce("to", "root").alias("root")).union(joined.join(roots, "key", "left_anti").select("key", "root")))


def classes(units: DataFrame, contents: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """Rows (key, root) for the units that are linked to others; other units are classes of their own.

    units: rows (key, size, bands array<long>), one per unit; ``contents`` gives (key, hashes) for a table of keys,
    where hashes are distinct (the repeats of a bag's element have hashes of their own).
    """
    each = settle(units.select("key", "size", F.posexplode("bands").alias("band", "value")))
    at = ["band", "value"]
    shared = each.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    # how many others a unit meets, counted once for each bucket they share
    each = settle(each.join(shared, at).withColumn("met", F.sum(F.col("n") - 1).over(W.partitionBy("key"))).drop("n"))
    held = settle(contents(each.select("key").distinct()))
    roots: DataFrame | None = None

    def placed() -> DataFrame:
        if roots is None:
            return each.withColumn("root", F.col("key"))
        return each.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    for turn in range(ROUNDS):
        members = placed()
        # the leader of a bucket is the unit that meets the most others over all bands, the middle of a large class; later
        # rounds draw others, in proportion to what they meet
        unit = (F.shiftrightunsigned(F.xxhash64("key", F.lit(turn)), 11) + 0.5) / float(1 << 53)
        rank = F.log(unit) / F.col("met") if turn else F.col("met")
        leaders = (members.groupBy(*at).agg(F.max(F.struct(rank.alias("r"), "key", "root", "size")).alias("l"), F.min("root").alias("a"), F.max("root").alias("b"))
                   .where("a <> b").select(*at, "l"))
        met = (members.join(leaders, at).where("root <> l.root")
               .where(F.least("size", F.col("l.size")) >= similarity * F.greatest("size", F.col("l.size")))
               .groupBy("key", "root", F.col("l.key").alias("leader"), F.col("l.root").alias("leader_root")).agg(F.count("*").alias("n")))
        # a unit has a leader for each band at most; it is compared with the few it shares the most buckets with
        likeliest = F.slice(F.sort_array(F.collect_list(F.struct("n", "leader", "leader_root")), False), 1, LEADERS)
        pairs = settle(met.groupBy("key", "root").agg(likeliest.alias("l")).select("key", "root", F.explode("l").alias("l")).select("key", "root", F.col("l.leader").alias("leader"), F.col("l.leader_root").alias("leader_root")))
        led = held.join(checked_broadcast(pairs.select(F.col("leader").alias("key")).distinct()), "key", "left_semi")
        near = settle(held.withColumnRenamed("hashes", "x").join(checked_broadcast(pairs), "key")
                      .join(led.select(F.col("key").alias("leader"), F.col("hashes").alias("y")), "leader")
                      .where(overlap(F.col("x"), F.col("y")) >= similarity)
                      .select(F.col("root").alias("a"), F.col("leader_root").alias("b")).distinct())
        if near.head(1):
            # links join components found so far: only their roots take part
            roots = joined_roots(roots, near)
        elif turn:
            break
    members = placed()
    several = members.groupBy(*at).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select(*at)
    pool = settle(members.join(several, at, "left_semi").select("key", "root", "size").distinct())
    if pool.head(1):
        near = settle(links_between(pool, held, similarity))
        if near.head(1):
            roots = joined_roots(roots, near)
    return each.select("key", F.col("key").alias("root")).limit(0) if roots is None else roots
