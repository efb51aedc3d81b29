"""Conditional-quantile trees of residuals, for all legs, lines and quantiles at once, by distributed histograms.

A level of all trees is one aggregate: rows fall into (leg, line, quantile, node, feature, bin of the feature, bin of the label),
weights and weighted sums are added up in the tasks first, and what is left is bounded by the numbers of trees, nodes and bins.
From a node's histogram the pinball loss of any split follows exactly at the label bins' edges. Leaves get the exact
weighted quantile of their labels. No row is moved between levels: its node is computed anew from the model so far.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headcast.checkpoints import cut
from headcast.functions.scores import crps, pinball
from headcast.operators.joins import quantiles_by_counts

TREE = ["leg", "line", "q"]
MODEL = "leg string, line string, q double, node int, feature int, threshold double, gain double, n bigint"
#: Models of no more nodes than this are broadcast; beyond, rows and trees are joined by exchange.
FEW_NODES = 200_000
#: Label candidates and feature bins, and rows that a child must have.
LABEL_BINS, FEATURE_BINS, LEAST = 32, 32, 20


def long_legs(frame: DataFrame, features: Sequence[str], labels: dict[str, str], weight: Column | None = None) -> DataFrame:
    """One row per row and leg with a known label: leg, line, x (features in order, unknown ones null), y, w.

    Truths of unknown worth weigh a half. Rows without a line belong to the line ''.
    """
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    legs = F.array(*[F.struct(F.lit(leg).alias("leg"), known(label).alias("y")) for leg, label in labels.items()])
    rest = [c for c in frame.columns if c not in (*features, *labels.values(), "line", "leg", "x", "y", "w")]
    rows = frame.select(*rest, F.coalesce("line", F.lit("")).alias("line"), F.array(*map(known, features)).alias("x"), (F.lit(1.0) if weight is None else F.coalesce(weight, F.lit(0.5))).alias("w"), F.explode(legs).alias("l"))
    return rows.select(*rest, "line", "x", "w", "l.leg", "l.y").where("y is not null")


def edges_of(rows: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """``keys`` and ``edges``: ascending different values that cut the values of a key into ``n`` parts of about equal counts."""
    levels = [(i + 1) / n for i in range(n)]
    q = quantiles_by_counts(rows, keys, value, levels)
    return q.select(*keys, F.array_sort(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(n)]))).alias("edges"))


def place(value: Column, edges: Column) -> Column:
    """How many edges lie below a value: the bin whose upper edge is the first not below it."""
    return F.size(F.filter(edges, lambda e: e < value))


def best_split(hist: pd.DataFrame, q: float, edges: np.ndarray, least: int = LEAST) -> tuple[int, int, float, int] | None:
    """Feature, last bin on the left, gain and rows of the split with the least pinball loss; ties go to the first feature and bin.

    ``hist``: feature, bin, y_bin, n, w, s (rows, weight and weighted sum of labels). A bin's labels are at most its edge.
    """

    def loss(w: np.ndarray, s: np.ndarray) -> np.ndarray:
        below_w, below_s = np.cumsum(w, axis=1), np.cumsum(s, axis=1)
        above = (below_s[:, -1:] - below_s) - edges * (below_w[:, -1:] - below_w)
        return (q * above + (1 - q) * (edges * below_w - below_s)).min(axis=1)

    best = None
    for feature, part in hist.groupby("feature", sort=True):
        bins = np.sort(part["bin"].unique())
        at = np.searchsorted(bins, part["bin"].to_numpy())
        n, w, s = np.zeros(len(bins)), np.zeros((len(bins), len(edges))), np.zeros((len(bins), len(edges)))
        np.add.at(n, at, part["n"].to_numpy())
        np.add.at(w, (at, part["y_bin"].to_numpy()), part["w"].to_numpy())
        np.add.at(s, (at, part["y_bin"].to_numpy()), part["s"].to_numpy())
        total = int(n.sum())
        left_n, left_w, left_s = np.cumsum(n)[:-1], np.cumsum(w, axis=0)[:-1], np.cumsum(s, axis=0)[:-1]
        if not len(left_n):
            continue
        whole = loss(w.sum(axis=0)[None], s.sum(axis=0)[None])[0]
        gain = whole - loss(left_w, left_s) - loss(w.sum(axis=0) - left_w, s.sum(axis=0) - left_s)
        gain[(left_n < least) | (total - left_n < least)] = -np.inf
        k = int(np.argmax(np.round(gain, 9)))
        if gain[k] > 1e-9 and (best is None or gain[k] > best[2] + 1e-9):
            best = (int(feature), int(bins[k]), float(gain[k]), total)
    return best


def _node(x: Column, nodes: Column, depth: int) -> Column:
    """The node where a row ends: unknown values go left, as does what is at most the threshold."""

    def step(at: Column, _: Column) -> Column:
        s = F.try_element_at(nodes, at)
        value = F.coalesce(F.get(x, s["feature"]), F.lit(float("-inf")))
        return F.when(s["feature"].isNull(), at).when(value <= s["threshold"], 2 * at).otherwise(2 * at + 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if depth else F.lit(1)


def with_nodes(rows: DataFrame, model: DataFrame, quantiles: Sequence[float], depth: int, value: bool = False) -> DataFrame:
    """``rows`` (leg, line, x) once per quantile, with ``q`` and ``node``, or with ``value`` as well as the node's."""
    fields = ["feature", "threshold", *(["value"] if value else [])]
    packed = model.groupBy(*TREE).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct(*fields)))).alias("nodes"))
    trees = packed.groupBy("leg", "line").agg(F.map_from_entries(F.collect_list(F.struct("q", "nodes"))).alias("trees"))
    side = F.broadcast(trees) if model.count() <= FEW_NODES else trees
    each = rows.join(side, ["leg", "line"], "left").withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
    nodes = F.try_element_at("trees", F.col("q"))
    out = each.withColumn("node", F.coalesce(_node(F.col("x"), nodes, depth), F.lit(1)))
    return (out.withColumn("value", F.try_element_at(nodes, F.col("node"))["value"]) if value else out).drop("trees")


def fit_trees(rows: DataFrame, n_features: int, quantiles: Sequence[float] = (0.5, 0.8, 0.9), depth: int = 3, least: int = LEAST, feature_bins: int = FEATURE_BINS, label_bins: int = LABEL_BINS, least_rows: int = 50) -> DataFrame:
    """The model: one row per node of each (leg, line, q) with feature and threshold (null in leaves), gain, n, and ``value``,
    the weighted quantile of the labels that end there (null inside the tree).

    ``rows`` as from ``long_legs``. A (leg, line) of fewer than ``least_rows`` rows gets no tree. Each level is one pass over the
    rows and one histogram; the search in a node's histogram is a small task of its own.
    """
    enough = cut(rows.groupBy("leg", "line").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least_rows))
    kept = rows.join(enough.select("leg", "line"), ["leg", "line"], "left_semi")
    each = kept.select("leg", "line", "y", "w", "x", F.posexplode("x").alias("feature", "v"))
    # thresholds hold for all lines; a last edge of no use is kept, it splits nothing off
    feature_edges = cut(edges_of(each.where("v is not null"), ["feature"], "v", feature_bins))
    packed = feature_edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges"))).alias("cuts"))
    label_edges = cut(edges_of(kept, ["leg", "line"], "y", label_bins).withColumnRenamed("edges", "y_edges"))
    binned = kept.crossJoin(F.broadcast(packed)).join(label_edges, ["leg", "line"])
    # an unknown value is in the bin before the first
    bins = F.transform("x", lambda v, i: F.when(v.isNull(), -1).otherwise(place(v, F.coalesce(F.try_element_at("cuts", i), F.array().cast("array<double>")))))
    binned = cut(binned.select("leg", "line", "x", "y", "w", bins.alias("bins"), F.least(place(F.col("y"), F.col("y_edges")), F.size("y_edges") - 1).alias("y_bin")))
    model = rows.sparkSession.createDataFrame([], MODEL)
    thresholds = feature_edges.select("feature", "edges")

    def search(key: tuple, hist: pd.DataFrame) -> pd.DataFrame:
        leg, line, q, node = key
        found = best_split(hist, q, np.array(hist["y_edges"].iloc[0]), least)
        row = [] if found is None else [(leg, line, q, node, found[0], found[1], found[2], found[3])]
        return pd.DataFrame(row, columns=["leg", "line", "q", "node", "feature", "bin", "gain", "n"])

    for level in range(depth):
        here = with_nodes(binned, model, quantiles, level).where(F.col("node") >= (1 << level))
        hist = here.select(*TREE, "node", "y", "w", "y_bin", F.posexplode("bins").alias("feature", "bin")).groupBy(*TREE, "node", "feature", "bin", "y_bin")
        hist = hist.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s")).join(label_edges, ["leg", "line"])
        found = hist.groupBy(*TREE, "node").applyInPandas(search, "leg string, line string, q double, node int, feature int, bin int, gain double, n bigint")
        at = F.when(F.col("bin") < 0, F.lit(float("-inf"))).otherwise(F.get("edges", F.col("bin")))
        fresh = cut(found.join(F.broadcast(thresholds), "feature").select(*TREE, "node", "feature", at.alias("threshold"), "gain", "n"))
        if fresh.isEmpty():
            break
        model = cut(model.unionByName(fresh))
    ends = with_nodes(kept, model, quantiles, depth).groupBy(*TREE, "node", "y").agg(F.sum("w").alias("w"), F.count("*").alias("c"))
    of = Window.partitionBy(*TREE, "node")
    summed = ends.withColumns({"upto": F.sum("w").over(of.orderBy("y")), "all": F.sum("w").over(of)})
    leaves = summed.groupBy(*TREE, "node").agg(F.min(F.when(F.col("upto") >= F.col("q") * F.col("all") - 1e-9, F.col("y"))).alias("value"), F.sum("c").alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    split = model.withColumn("value", none("double"))
    return cut(split.unionByName(leaves.select(*TREE, "node", none("int").alias("feature"), none("double").alias("threshold"), none("double").alias("gain"), "n", "value")))


def validated(rows: DataFrame, model: DataFrame, quantiles: Sequence[float] = (0.5, 0.8, 0.9), depth: int = 3) -> DataFrame:
    """Of each (leg, line, q) on held-out ``rows`` with an ``id``: n, mean pinball loss, and the mean CRPS from the 0.5, 0.8 and 0.9 quantiles."""
    scored = with_nodes(rows, model, quantiles, depth, value=True).where("value is not null")
    by_row = scored.groupBy("leg", "line", "id").agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("v"), F.first("y").alias("y"))
    at = [F.try_element_at("v", F.lit(q)) for q in (0.5, 0.8, 0.9)]
    by_leg = by_row.groupBy("leg", "line").agg(F.avg(crps(F.col("y"), *at)).alias("crps"))
    loss = F.coalesce(*[F.when(F.col("q") == q, pinball(q, F.col("y"), F.col("value"))) for q in quantiles])
    return scored.groupBy(*TREE).agg(F.count("*").alias("n_val"), F.avg(loss).alias("pinball")).join(by_leg, ["leg", "line"])


def leg_quantiles(rows: DataFrame, model: DataFrame, base: Column, offsets: DataFrame | None = None, quantiles: Sequence[float] = (0.5, 0.8, 0.9), depth: int = 3) -> DataFrame:
    """Per ``id`` and leg p50, p80, p90: ``base`` plus the modelled residuals, in order, then shifted by conformal ``offsets``
    (leg, line, q, offset_s; those of no row count as zero) and put in order again. All at zero or more.

    ``base`` is computed from ``rows``. A leg without a tree isn't returned: there the caller's own forecast stands.
    """
    each = with_nodes(rows.withColumn("base", base), model, quantiles, depth, value=True).where("value is not null")
    if offsets is not None:
        each = each.join(offsets.select(*TREE, "offset_s"), TREE, "left")
    offset = F.coalesce("offset_s", F.lit(0.0)) if offsets is not None else F.lit(0.0)
    by = each.groupBy("id", "leg", "line").agg(F.array_sort(F.collect_list(F.struct("q", (F.col("base") + F.col("value")).alias("v"), offset.alias("o")))).alias("s"))
    value = lambda field: [F.get("s", F.lit(i))[field] for i in range(len(quantiles))]
    first = _rising(value("v"))
    second = _rising([a + b for a, b in zip(first, value("o"))])
    return by.select("id", "leg", "line", *[v.alias(f"p{round(100 * q)}") for q, v in zip(sorted(quantiles), second)])


def _rising(values: Sequence[Column]) -> list[Column]:
    out: list[Column] = []
    for v in values:
        out.append(F.greatest(F.lit(0.0) if not out else out[-1], v))
    return out
