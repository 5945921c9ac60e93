"""Connected components of an edge table, in rounds of large and small stars.

Each round is two groupings with map-side minima; no component gathers in one task and nothing
but a checksum reaches the driver. Rounds are written to the shared folder, so a lost executor
costs the running round only. A path of n nodes takes about log n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import stored


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("mix")
    ).first()
    return row["n"], row["mix"]


def _star(sided: DataFrame) -> DataFrame:
    """For each node, hang its neighbours ``far`` and itself on the least of them."""
    least = sided.groupBy("near").agg(F.min("far").alias("least"))
    return sided.join(least, "near").withColumn("least", F.least("near", "least"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("node").alias("near"), F.col("root").alias("far")).unionAll(
        edges.select(F.col("root").alias("near"), F.col("node").alias("far"))
    )
    return (
        _star(both)
        .filter("far > near")
        .select(F.col("far").alias("node"), F.col("least").alias("root"))
        .filter("node != root")
        .distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("node", "root").alias("near"), F.least("node", "root").alias("far"))
    stars = _star(down)
    return (
        stars.select(F.col("far").alias("node"), F.col("least").alias("root"))
        .unionAll(stars.select(F.col("near").alias("node"), F.col("least").alias("root")))
        .filter("node != root")
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) that is not its component's least node."""
    current = stored(
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        .distinct(),
        "edges",
    )
    seen = _checksum(current)
    while seen[0]:
        current = stored(_small(_large(current)), "stars")
        now = _checksum(current)
        if now == seen:
            break
        seen = now
    return current
