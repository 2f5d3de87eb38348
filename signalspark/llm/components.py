"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import cut


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """(node, other) -> (node, other, low): low is the least of node and all its others.

    The minimum comes from a partial aggregate and is joined back, so that a node with very many
    neighbours is never gathered in one task."""
    low = pairs.groupBy("node").agg(F.min("other").alias("least")).select(F.col("node").alias("key"), "least")
    return pairs.join(low, pairs["node"] == low["key"]).select("node", "other", F.least("node", "least").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    return _with_minimum(both).where("other > node").select(F.col("other").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    star = _with_minimum(down)
    linked = star.select(F.col("other").alias("a"), F.col("low").alias("b")).union(star.select("node", "low"))
    return linked.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of comparable ids -> (node, root), root the least id of the component; isolated nodes are absent.

    Each round is written to the checkpoint folder; rounds grow with the logarithm of a component's diameter."""
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = cut(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
