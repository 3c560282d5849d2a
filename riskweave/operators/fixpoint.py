"""Fix-points over edges: semi-naive reachability and re-export chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.runtime import cut, drop


def reach(edges: DataFrame, seeds: DataFrame, keys: list[str], node: str = "node", most: int = 10_000, by_key: bool = True) -> DataFrame:
    """All (keys, node) that ``seeds`` (keys, node) reach over ``edges`` (keys, src, dst), seeds included; without ``by_key``
    the edges are (src, dst), the same for all keys.

    Semi-naive: only nodes new in the last round are joined. Ends on cyclic graphs, as known nodes are taken off before
    each round; the number of rounds is the longest shortest path. Null nodes never match.
    """
    on = [*keys, "src"] if by_key else ["src"]
    e = cut(edges.select(*on, "dst").where("src is not null and dst is not null").distinct())
    known = cut(seeds.select(*keys, node).distinct())
    delta = known
    for _ in range(most):
        step = delta.withColumnRenamed(node, "src").join(e, on).select(*keys, F.col("dst").alias(node)).distinct()
        delta = cut(step.join(known, [*keys, node], "left_anti"))
        if delta.isEmpty():
            drop(delta)
            return known
        known, old = cut(known.unionByName(delta)), known
        drop(old)
    raise RuntimeError(f"no fix-point after {most} rounds")


def closure(edges: DataFrame, keys: list[str]) -> DataFrame:
    """All (keys, start, node) with node reachable from start in one or more steps."""
    e = edges.select(*keys, "src", "dst").distinct()
    seeds = e.select(*keys, F.col("src").alias("start"), F.col("dst").alias("node"))
    known = cut(seeds.distinct())
    delta = known
    while True:
        step = delta.withColumnRenamed("node", "src").join(e, [*keys, "src"]).select(*keys, "start", F.col("dst").alias("node")).distinct()
        delta = cut(step.join(known, [*keys, "start", "node"], "left_anti"))
        if delta.isEmpty():
            return known
        known = cut(known.unionByName(delta))


def chains(links: DataFrame, hops: int = 6) -> DataFrame:
    """(src, dst): each link (src, dst) followed to the end of its chain, for at most ``hops`` steps; a cycle keeps its start.

    Unrolled left joins with a stop as soon as nothing moves.
    """
    x = cut(links.select("src", "dst").distinct())
    step = x.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    out = x
    for _ in range(hops - 1):
        nxt = out.join(step, (out["dst"] == step["_s"]) & (step["_d"] != out["src"]), "left").select("src", F.coalesce("_d", "dst").alias("new"), "dst")
        if nxt.where("new <> dst").isEmpty():
            break
        out = cut(nxt.select("src", F.col("new").alias("dst")))
    return out
