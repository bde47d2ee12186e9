"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import HUB, NARROW_ROWS, cut, fits, meet, sized


def _below(edges: DataFrame) -> DataFrame:
    """u, m, n: the smallest of each node's smaller neighbours, and their number."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _moved(edges: DataFrame, middle: DataFrame) -> DataFrame:
    """u, v of ``edges``: ends v that ``middle`` (v, m, n; written) has are replaced by m; others, which may have any number of edges, stay where they are."""
    if fits(middle, NARROW_ROWS):
        return edges.join(F.broadcast(middle.select("v", "m")), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    hubs = cut(edges.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HUB).select("v"), "hubs")
    hubs = sized(cut(hubs.join(middle.select("v", "m"), "v", "left"), "hubs"), NARROW_ROWS)  # few against the edges
    far = edges.join(hubs, "v").select("u", F.coalesce("m", "v").alias("v"))
    near = edges.join(hubs.select("v"), "v", "left_anti").join(middle.select("v", "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    return far.unionByName(near)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every end of ``edges`` (u, v: long); root is the component's smallest node.

    Edges point from larger to smaller nodes. A round moves edges that end in a node with smaller neighbours on
    to the smallest of them (large star), then the ends of a node's several edges under their smallest (small
    star), and writes the result down; without such nodes all are stars and it is done: the number of rounds
    grows with the logarithm of the graph. A star's centre, which may have any number of edges, is no such
    node; nodes that many edges end in are joined apart, by a broadcast while there are at most NARROW_ROWS of them
    (each has over HUB edges). Self-links are ignored. No edges give no rows.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        ends = now.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        middle = cut(_below(now).select(F.col("u").alias("v"), "m").join(ends, "v"), "middle")
        settled = middle.isEmpty()
        if not settled:
            now = cut(_moved(now, middle).distinct(), "edges")
        many = cut(_below(now).filter("n > 1"), "many")
        if many.isEmpty():
            if settled:
                break
            continue
        under = meet(now, many, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's edge to the least of its smaller neighbours stays, and it is the only one of a node that isn't in many
        kept = _below(now).select("u", F.col("m").alias("v"))
        now = cut(under.unionByName(kept).distinct(), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
