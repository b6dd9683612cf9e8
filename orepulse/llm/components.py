"""Connected components of a link table, and the candidate rounds that find links without making all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orepulse.llm.common import cut, drop_cut, join_bounded, release_shuffles

MOST_ROUNDS = 60


def ranked_id(times: Column) -> Column:
    """A unique id for each row that is the smaller, the more often the row's content occurs (in steps of a quarter power of two).

    The copy that occurs most often lies in the middle of its near copies, so that as the smallest id of a bucket it links to most of
    them. Write the rows down before using the id twice.
    """
    rank = F.lit(127) - F.least(F.lit(127), F.floor(F.log2(times) * 4))
    return F.shiftleft(rank.cast("long"), 55) + F.monotonically_increasing_id()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them; in ``edges`` a is above b."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id of ``links`` (a, b): the smallest id it is connected to.

    Union-find over the cluster by alternating stars: both steps only group and join on a node, and end in trees of depth one.
    Nulls and self links are ignored; no links give no rows.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        after = cut(_small_star(_large_star(edges)))
        drop_cut(edges)
        edges = after
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if (row["n"], row["s"]) == mark or not row["n"]:
            break
        mark = (row["n"], row["s"])
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def linked(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Components of everything that shares a bucket and passes ``verify``; ``members`` are (id, key).

    First every member is held against the hub of its bucket, the member with the largest buckets in all: what lies in the middle of a
    group of near copies agrees with most of them. ``verify`` turns pairs (a, b) into those that are links. What then lies in one
    component needs no more comparison, so only the members outside the hub's component go on: ``across`` gets (key, id, component,
    outside) of every bucket that has such members, without its hub, and returns the links (a, b) between an outside member and members
    of other components, of which one per component is enough. A group of copies is thus compared once per member, and no link between
    components is lost.
    """
    sizes = members.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("size")).where("least < most")
    shared = cut(join_bounded(members, cut(sizes.select("key", "size")), "key").distinct())
    release_shuffles(members.sparkSession)
    crowds = shared.groupBy("id").agg(F.sum("size").alias("crowd"))
    hubs = shared.join(crowds, "id").groupBy("key").agg(F.max(F.struct("crowd", (-F.col("id")).alias("at"))).alias("top"))
    placed = cut(shared.select("id", "key").join(hubs.select("key", (-F.col("top.at")).alias("hub")), "key"))
    drop_cut(shared)
    pairs = placed.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    first = cut(verify(pairs))
    found = cut(components(first))
    labelled = placed.join(found, "id", "left").select("id", "key", "hub", F.coalesce("component", "id").alias("component"))
    main = found.select(F.col("id").alias("hub"), F.col("component").alias("main"))
    labelled = cut(labelled.join(main, "hub", "left").select("id", "key", "hub", "component", F.coalesce("main", "hub").alias("main")))
    open_keys = labelled.where("component <> main").select("key").distinct()
    rest = labelled.where("id <> hub").join(open_keys, "key", "left_semi")
    second = across(cut(rest.select("key", "id", "component", (F.col("component") != F.col("main")).alias("outside"))))
    return components(cut(first.select("a", "b").unionByName(second.select("a", "b"))))
