"""Groups of texts whose sets of word shingles are alike by Jaccard similarity, each link verified on the sets themselves.

SimHash fingerprints within a radius are the first proposals; those whose sets prove alike form groups. What SimHash misses
comes from MinHash bands, which two sets alike by 0.8 share with all but certainty (``minhash``): only texts of different groups
are compared there, crowded buckets in blocks, and every link is proved as well. The result is that of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcast.checkpoints import cut
from headcast.llm.minhash import linked_texts
from headcast.llm.simhash import link


def print_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """``a``, ``b``: nodes that fingerprints within ``radius`` bits tie together; those of one fingerprint are tied to its least node."""
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    near = link(heads.select("fp"), radius)
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("u")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("v")), "b").select("u", "v")
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    return near.unionByName(same).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: Sequence[str] = ("doc_id", "th"), shingle: int = 5, print_shingle: int = 2, radius: int = 4) -> DataFrame:
    """``keys`` of each row (the id and a hash of the text) and ``root``, equal for the rows of one group.

    Two rows are linked if their ``shingle``-word sets are alike by 0.8 or more; groups are what links connect. The
    fingerprints that propose links are those of ``print_shingle``-word sets. Wordless and null texts are copies of each
    other. Repeated rows give repeated rows, an empty table an empty one; other columns are dropped.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("row_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("row_hash"), text.alias("text"))
    made, settled = linked_texts(rows, shingle, prints=print_shingle, proposals=lambda nodes: print_pairs(nodes, radius))
    # texts without words have no node: they share the root null, which no other group has
    found = made.select("row_id", "row_hash", "node").join(settled, "node", "left")
    return found.select(F.col("row_id").alias(keys[0]), F.col("row_hash").alias(keys[1]), F.coalesce("root", F.lit(0)).alias("root"))
