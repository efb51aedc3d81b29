"""Merkle manifest of a table: leaves per group, a root of each group, one root over all, and an inclusion proof per row.

Leaves are dealt to aligned blocks of ``2 ** bits`` places. A block keeps a level as one string of concatenated digests:
parents are hashes of its fixed-width pieces, a leaf's sibling is the piece beside its own, and the siblings of all levels of a
block make one path segment. The roots of blocks are the leaves of the next, smaller round, until each tree has one root.
Places come from a range sort whose parts are counted, so no group is ever in one task, and only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headcast.checkpoints import cut
from headcast.llm.native import let

#: Characters of a digest, and of one entry of a path: the side that the sibling is on (- without one), and the sibling.
WIDE, ENTRY = 64, 65
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field_bytes(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field_bytes, values)))


def ranked(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0) within its ``tree`` by ``order`` and ``n``, the tree's number of rows.

    Rows are range-sorted once and kept with the part they fell into; parts are counted by tree, and a row's place is what
    the parts before hold plus its place in its own. A part is what one task sorts, however large its tree is.
    """
    placed = cut(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy(tree, "part").agg(F.count("*").alias("here"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(tree, "part", before.alias("before"), F.sum("here").over(whole).alias("n"))
    own = F.row_number().over(Window.partitionBy(tree, "part").orderBy(*order)) - 1
    numbered = placed.withColumn("own", own).join(offsets, [tree, "part"])
    return numbered.withColumn("pos", F.col("before") + F.col("own")).drop("part", "own", "before")


def _parents(level: Column) -> Column:
    """The level above a level (both digests' characters as binary); a last piece may hold one digest only."""
    at = F.sequence(F.lit(0), ((F.octet_length(level) - 1) / (2 * WIDE)).cast("int"))
    return F.array_join(F.transform(at, lambda i: F.sha2(F.substring(level, i * 2 * WIDE + 1, F.lit(2 * WIDE)), 256)), "").cast("binary")


def _segment(levels: Column, place: Column, rounds: Column) -> Column:
    """Path entries of ``place`` through the first ``rounds`` of a block's levels."""

    def entry(level: Column, l: Column) -> Column:
        at = F.call_function("shiftright", place, l).cast("int")
        beside = at.bitwiseXOR(F.lit(1))
        sibling = F.substring(level, beside * WIDE + 1, F.lit(WIDE)).cast("string")
        side = F.when(beside > at, F.lit("r")).otherwise(F.lit("l"))
        return F.when((beside + 1) * WIDE <= F.octet_length(level), F.concat(side, sibling)).otherwise(F.rpad(F.lit("-"), ENTRY, " "))

    return F.array_join(F.transform(F.slice(levels, F.lit(1), rounds), entry), "")


def climb(nodes: DataFrame, tree: str, bits: int = 10, carry: Sequence[str] = ()) -> DataFrame:
    """``tree``, ``pos``, ``digest``, ``carry``, ``path`` (entries from the node up to its tree's root) and ``top`` (that root).

    ``nodes``: tree, pos, n, digest, and ``carry``. While a tree has more nodes than one they are hashed in twos, the last
    alone if odd. What a node carries travels with its block, so that paths, the widest rows, never meet it by an exchange.
    """
    size = 1 << bits
    depth = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    members = F.sort_array(F.collect_list(F.struct("pos", "digest", *carry)))
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / size)).groupBy(tree, "block").agg(members.alias("members"), F.max("n").alias("n"))
    blocks = blocks.withColumn("rounds", F.least(F.lit(bits), depth).cast("int"))
    first = F.array(F.array_join("members.digest", "").cast("binary"))
    steps = F.when(F.col("rounds") > 0, F.sequence(F.lit(1), F.col("rounds"))).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, first, lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))
    blocks = cut(blocks.withColumn("levels", levels))
    up = F.floor((F.col("n") - 1) / size) + 1
    tops = blocks.select(tree, F.col("block").alias("pos"), up.alias("n"), F.element_at("levels", -1).cast("string").alias("digest"))
    if (tops.agg(F.max("n")).first()[0] or 1) <= 1:
        above = tops.select(tree, F.col("pos").alias("block"), F.lit("").alias("rest"), F.col("digest").alias("top"))
    else:
        above = climb(tops, tree, bits).select(tree, F.col("pos").alias("block"), F.col("path").alias("rest"), "top")
    each = blocks.join(above, [tree, "block"]).select(tree, "rounds", "levels", "rest", "top", F.posexplode("members").alias("inner", "m"))
    path = F.concat(_segment(F.col("levels"), F.col("inner"), F.col("rounds")), "rest")
    return each.select(tree, "m.*", path.alias("path"), "top")


def siblings(path: Column) -> Column:
    """The digests of a path, joined: side marks and padding aren't hexadecimal digits."""
    return F.translate(path, "lr- ", "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` lead to."""
    entries = F.when(F.length(path) > 0, F.sequence(F.lit(0), (F.length(path) / ENTRY).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(here: Column, i: Column) -> Column:
        entry = F.substring(path, i * ENTRY + 1, F.lit(ENTRY))
        side, sibling = F.substring(entry, 1, 1), F.substring(entry, 2, WIDE)
        return F.sha2(F.when(side == "r", F.concat(here, sibling)).when(side == "l", F.concat(sibling, here)).otherwise(here).cast("binary"), 256)

    return F.aggregate(entries, leaf, step)


def manifest(df: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", id_col: str = "doc_id", bits: int = 10, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the id, ``leaf``, ``subroot``, ``root``, ``path`` (leaf to root) and what ``carry`` names.

    A leaf hashes ``fields``; per ``group`` leaves ascend by id, then by leaf, null ids first, repeated rows each being a leaf. Roots
    of groups ascend by group, null first and else bytewise. A group of one leaf has it as its root, a table of one group
    that group's. An empty table gives no rows. Columns that aren't named are dropped, so none can clash.
    """
    named = {f"f{i}": F.col(f"`{c}`") for i, c in enumerate(fields)}
    extra = {f"c{i}": value for i, value in enumerate((carry or {}).values())}
    # a null group comes before the empty one, and others keep their order
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    leaves = df.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf_of(list(named.values())).alias("digest"), *[v.alias(c) for c, v in extra.items()])
    low = climb(ranked(leaves, "tree", ["id", "digest"]), "tree", bits, ["id", *extra])
    groups = cut(low.where("pos = 0").select("tree", F.col("top").alias("digest")))
    high = climb(ranked(groups.withColumn("all", F.lit(0)), "all", ["tree"]), "all", bits, ["tree"])
    rows = low.join(high.select("tree", F.col("path").alias("rest"), F.col("top").alias("root")), "tree")
    out = [F.col("id").alias(id_col), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "rest").alias("path")]
    return rows.select(*out, *[F.col(c).alias(name) for c, name in zip(extra, carry or {})])


def verify(rows: DataFrame, leaf: Column) -> DataFrame:
    """``rows`` of a manifest with ``proof_sha256``, ``folded_root`` (from ``leaf`` and the path) and ``verified``."""
    folded = let(F.col("path"), lambda path: fold(leaf, path))
    with_proof = rows.withColumns({"proof_sha256": digest(siblings(F.col("path"))), "folded_root": folded})
    return with_proof.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_report(df: DataFrame, bits: int = 10) -> DataFrame:
    """``manifest`` of documents, each proof checked against the row as it may have been altered since.

    Where 7 divides crc32 of the decimal id, one is added to ``n_chars``; null ids and null counts are left alone.
    """
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    altered = leaf_of([(F.col(c).cast("long") + 1) if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = manifest(df, bits=bits, carry={"altered": F.when(hit, altered)})
    return verify(rows, F.coalesce("altered", "leaf")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
