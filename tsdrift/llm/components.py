"""Connected components of an edge table by alternating star contractions.

Defined cases: nodes may be of any type that can be ordered and hashed; repeated
edges, both directions of an edge and edges of a node to itself change nothing; an
edge with a null end is left out; an empty table gives no rows; columns other than
the two ends are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsdrift.session import materialize


def _with_least(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with ``m``, the least of u and all its v.  The minimum
    is combined map-side and joined back, so a hub's links never meet."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("w")).drop("w")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node of its component) of every node with
    an edge to another.  Each round writes a table no longer than the edges; it
    ends when the edges are stars, which they become in logarithmically many
    rounds."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")

    def state(links: DataFrame):
        # exact sums of the links' hashes: equal before and after iff nothing moved
        h = F.xxhash64("u", "v")
        return links.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).head()

    before = None
    after = state(now)
    while after != before and after[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        small = _with_least(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = materialize(small.where("u <> v").distinct(), "small-star")
        before, after = after, state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select("v", "v").toDF("node", "component").distinct())
