"""Connected components as rounds of joins and minima."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.shipping import ship
from cinderlake.storage import Stored, broadcast_if_small

#: Links of one node in one join partition; a node with more is dealt out.
HOT_LINKS = 100_000
#: Links up to which ``components`` may be asked to settle them in one pass of one task: some 10 MB.
FEW_LINKS = 200_000


def settled(links: pa.Table) -> pa.Table:
    """``(node, component)`` of all links at once, by union-find with the smaller node on top."""
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := over.setdefault(x, x)) != x:
            over[x] = x = over[up]
        return x

    for u, v in zip(links.column("u").to_pylist(), links.column("v").to_pylist(), strict=True):
        a, b = top(u), top(v)
        over[max(a, b)] = min(a, b)
    return pa.table({"node": pa.array(over, pa.int64()), "component": pa.array([top(x) for x in over], pa.int64())})


def components(edges: DataFrame, most_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(node, component)`` for each node of an edge.

    Up to ``at_once`` different links are settled in one pass of one task, which spares small graphs the rounds.

    ``component`` is the smallest node that can be reached. Alternating large-star and small-star rounds; each
    round is written to the shared folder, so that a lost executor costs one round at most, and the last round's table stays there. All groupings are
    sums or minima that combine before the shuffle. No edges: an empty table.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    now = Stored(links, "links")
    sign = None
    seen = (now.df.count(),)
    if seen[0] <= at_once:
        ship(edges.sparkSession)
        return now.df.groupBy().applyInArrow(settled, "node long, component long")
    for _ in range(most_rounds):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large star: each neighbour above a node is tied to the least of the node's neighbourhood
        large = told_least(both.where("v > u"), low, seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: each node's smaller neighbours, and the node, are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = Stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        was, now = now, after
        was.drop()
        seen = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def tiled_components(links: DataFrame, tile: list[str], at_once: int = 0) -> DataFrame:
    """``components`` of links ``(a, b)`` whose columns ``tile`` deal them out so that a tile has a bounded number of them.

    A tile is settled in one group, where each of its nodes gets the smallest one of its component for a label. A node of several tiles ties its
    labels together, and only these ties, a few for each border, are settled across tiles. The smallest node of all is its own label in each tile.
    """
    ship(links.sparkSession)
    ends = links.where("a <> b").select(*tile, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pieces = Stored(ends.groupBy(*tile).applyInArrow(settled, "node long, component long"), "pieces").df
    named = pieces.groupBy("node").agg(F.min("component").alias("label"), F.collect_set("component").alias("labels"))
    ties = named.where(F.size("labels") > 1).select(F.explode("labels").alias("a"), F.col("label").alias("b"))
    across = components(ties, at_once=at_once).withColumnRenamed("node", "label")
    return named.select("node", "label").join(across.hint("merge"), "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def told_least(links: DataFrame, low: DataFrame, n_links: int) -> DataFrame:
    """``links(u, v)`` with ``m`` of ``low(u, m, n)``. Nodes with very many links, of which there can be few, are dealt out by their neighbour."""
    hot = low.where(F.col("n") > HOT_LINKS).select("u", F.ceil(F.col("n") / HOT_LINKS).alias("shares")) if n_links > HOT_LINKS else None
    if hot is None or hot.isEmpty():
        return links.join(low.drop("n").hint("merge"), "u")  # a round's nodes grow with the graph: they go by shuffles, not over the driver
    hot = broadcast_if_small(hot)
    salt = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.col("shares")), F.lit(0).cast("long"))
    dealt = links.join(hot, "u", "left").select("u", "v", salt("v").alias("salt"))
    each = low.join(hot, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("shares"), F.lit(1)) - 1)).alias("salt"))
    return dealt.join(each, ["u", "salt"])
