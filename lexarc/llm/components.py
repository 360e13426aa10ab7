"""Connected components over a distributed edge table (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _hang(both: DataFrame, keep) -> DataFrame:
    """Hang each node's chosen neighbours under the least node of its neighbourhood.

    The least neighbour comes from a partially combined aggregate and is joined back, so that a hub's
    neighbours are never gathered in one row.
    """
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) to (id, component_id): the least id that each linked id reaches.

    Ids without an edge do not occur in the result. Null ends and loops are ignored; repeated edges count once.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e)
    before = _digest(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, F.col("v") > F.col("u")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.u", "x.v").filter("u <> v").distinct()
        after_df = scratch.keep(small)
        after = _digest(after_df)
        scratch.drop(e)
        e = after_df
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()
