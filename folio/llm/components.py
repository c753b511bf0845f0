"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014).

Edges with a null end are left out, as are loops; repeated edges count once; nodes without edges have no row. The
number of rounds grows with the logarithm of the longest chain and is not limited. A node with many edges is not
dealt to one task: its least neighbour is a pre-aggregated row, and a bounded number of such rows is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common


def _stars(edges: DataFrame, large: bool, bound: int, most: int) -> DataFrame:
    """One round: each node's neighbours (larger ones, or those not larger) are linked to its least neighbour."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    joined = common.hub_join(both, least, "u", "degree", bound, most)
    if large:
        new = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node of its component. Rounds are written tables."""
    spark = edges.sparkSession
    facts = {"n": F.count(F.lit(1)), "hash": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    now, state = common.measured(edges.select("u", "v").filter("u <> v").distinct(), "edges", **facts)
    was = None
    while state != was and state["n"]:
        bound, read = common.hub_bound(2 * state["n"]), common.made()[-1]
        # both stars of a round are written: the second reads the first several times
        stars = common.materialize(_stars(now, True, bound, 2 * state["n"]), "stars")
        was, (now, state) = state, common.measured(_stars(stars, False, bound, 2 * state["n"]), "edges", **facts)
        common.release(spark, [read, common.made()[-2]])
    common.collect_garbage(spark)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
