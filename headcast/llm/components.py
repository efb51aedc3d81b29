"""Connected components of an edge table, as alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcast.checkpoints import cut


#: Edges to a part.
PART_ROWS = 50_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of ``edges``; null ends and loops are ignored.

    Large-star and small-star steps: every node hands its neighbours on to the smallest of them, so a component of n
    nodes becomes a star after about log n rounds. Minima are aggregated map-side, hubs are joined with Spark's skew
    handling, and each round is checkpointed. Edges stay distributed; only a count and a checksum reach the driver.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(pairs)
    # small tables in few parts: each part that writes to an exchange costs files, however little it holds
    parts = 1 + seen[0] // PART_ROWS
    pairs = pairs.coalesce(parts)
    for _ in range(max_rounds):
        pairs = cut(_small_star(_large_star(pairs).coalesce(parts)).coalesce(parts))
        now = _mark(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components didn't settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(hash(u, v), 1000003))")).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are tied to the smallest of them. ``u > v`` holds in ``pairs``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
