"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import discard, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``links``; the component is its smallest node.

    Links may repeat, run either way or join a node to itself; rows with a null end are no links.
    Every step is an aggregation with partial sums and a join that Spark can split where one node has
    most of the links. Each round's table is written, so nothing is recomputed after a loss.
    No links: no rows.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    selves = pairs.where("u = v").select("u").distinct()
    edges = written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        spread = _star(edges.union(edges.select("v", "u").toDF("u", "v")), large=True)
        packed = _star(spread, large=False)
        discard(spread)
        discard(edges)
        edges, before, mark = packed, mark, _mark(packed)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = edges.toDF("node", "component").union(roots)
    return found.union(selves.join(found, selves["u"] == found["node"], "left_anti").select("u", "u"))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large star) or the smaller (small star) neighbours of each node, and the node, to the least of them."""
    least = written(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    joined = pairs.join(least.withColumnRenamed("u", "n"), F.col("u") == F.col("n"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    result = written(moved.where("u <> v").distinct())
    discard(least)
    return result


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
