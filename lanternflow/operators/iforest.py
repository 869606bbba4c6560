"""Isolation forest grown level by level with DataFrame aggregates.

Every random choice is a part of a SHA-256 (of seed, copy and row id for the samples; of seed, tree and node
for features and cuts), so that a forest follows from its rows alone and any engine can grow the same one.

A row is drawn for a tree if its hash lies under a threshold that leaves about twice the rows needed; each tree
takes the lowest of its own. With few rows, each one stands as several copies. So the sample is bounded by
trees x sample rows whatever the input, and nothing is sorted or counted beyond the number of rows.

All trees grow together: a node's spread is an aggregate over its rows, and a tree stays in one partition, so all
levels need one shuffle of the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forest size, sample per tree, Euler's constant.
TREES, SAMPLE = 300, 256
EULER_GAMMA = 0.5772156649015329
PLACES = 9      # features count as equal if they are so to this many decimal places
UNIT = 1 << 60  # range of the hashed numbers


def _mean_path(n):
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + EULER_GAMMA) - 2 * (many - 1) / many))


def _numbers(*parts: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits from the SHA-256 of the parts, joined by colons."""
    digest = F.sha2(F.encode(F.concat_ws(":", *[p.cast("string") for p in parts]), "UTF-8"), 256)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))


def draw_plan(rows: int, trees: int, sample: int) -> tuple[int, int]:
    """(copies of each row, threshold of the hash) that give about 2 x trees x sample draws."""
    wanted = 2 * trees * sample
    copies = max(1, -(-wanted // max(rows, 1)))
    return copies, int(min(1.0, wanted / (max(rows, 1) * copies)) * UNIT)


def sample_for_trees(rows: DataFrame, key: str, features: Sequence[str], seed: int, trees: int = TREES,
                     sample: int = SAMPLE, count: int | None = None) -> DataFrame:
    """``tree_id`` and the rounded features of at most ``sample`` distinct rows a tree; ``key`` must be unique."""
    copies, threshold = draw_plan(rows.count() if count is None else count, trees, sample)
    drawn = rows.select(key, *[F.round(f, PLACES).alias(f) for f in features],
                        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"))
    tree, place = _numbers(F.lit(seed), F.col("_copy"), F.col(key))
    drawn = drawn.withColumns({"tree_id": (tree % trees).cast("int"), "_u": place}).filter(F.col("_u") < threshold)
    once = F.row_number().over(Window.partitionBy("tree_id", key).orderBy("_u"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy("_u", key))
    own = drawn.repartition("tree_id").withColumn("_once", once).filter("_once = 1")
    return own.withColumn("_r", rank).filter(F.col("_r") <= sample).select("tree_id", *features)


def fit_forest(rows: DataFrame, key: str, features: Sequence[str], seed: int, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Nodes ``tree_id, node, feature, cut, n`` of all trees.

    Node 1 is the root, the children of a node are 2*node (up to the cut) and 2*node + 1; a leaf has feature -1. ``n`` counts
    the node's rows. A node splits at a random place of the spread of a random feature, unless it is at the
    depth limit, has one row, or none of its features has a spread.
    """
    names = list(features)
    limit = int(np.ceil(np.log2(max(sample, 2))))
    grown = sample_for_trees(rows, key, names, seed, trees, sample).withColumn("_node", F.lit(1))
    node = Window.partitionBy("tree_id", "_node")
    levels = []
    for depth in range(limit + 1):
        spread = F.array(*[F.struct(F.lit(i).alias("i"), F.min(f).over(node).alias("lo"), F.max(f).over(node).alias("hi"))
                           for i, f in enumerate(names)])
        grown = grown.withColumns({"_n": F.count(F.lit(1)).over(node), "_spread": spread})
        usable = F.filter("_spread", lambda c: c["hi"] > c["lo"])
        which, where = _numbers(F.lit(seed), F.col("tree_id"), F.col("_node"))
        grown = grown.withColumn("_usable", usable).withColumn("_at", F.when(
            (F.size("_usable") > 0) & F.lit(depth < limit), F.get("_usable", (which % F.size("_usable")).cast("int"))))
        grown = grown.withColumn("_cut", F.col("_at.lo") + where / F.lit(float(UNIT)) * (F.col("_at.hi") - F.col("_at.lo")))
        x = F.get(F.array(*names), F.col("_at.i"))
        grown = grown.withColumn(f"_level{depth}", F.struct(F.col("_node").alias("node"), F.coalesce("_at.i", F.lit(-1)).alias("feature"),
                                                            F.coalesce("_cut", F.lit(0.0)).alias("cut"), F.col("_n").cast("int").alias("n")))
        grown = grown.withColumn("_node", F.when(F.col("_at").isNull(), F.col("_node")).otherwise(
            2 * F.col("_node") + (x > F.col("_cut")).cast("int"))).drop("_n", "_spread", "_usable", "_at", "_cut")
        levels.append(f"_level{depth}")
    nodes = grown.select("tree_id", F.explode(F.array(*levels)).alias("s")).select("tree_id", "s.*")
    return nodes.groupBy("tree_id", "node").agg(F.max("feature").alias("feature"), F.max("cut").alias("cut"), F.max("n").alias("n"))


def with_isolation_score(rows: DataFrame, forest: DataFrame, features: Sequence[str], name: str = "isolation_forest") -> DataFrame:
    """Add 2^-(mean over the trees of path length / expected path length of the tree's sample).

    The node table is bounded by trees x 2 x sample rows, so it is sent to every task.
    """
    nodes = forest.toPandas()
    width = int(nodes["node"].max()) + 1
    packed = []
    for _, g in nodes.groupby("tree_id"):
        feature, cut, depth = np.full(width, -1), np.zeros(width), np.zeros(width)
        at, n = g["node"].to_numpy(), g["n"].to_numpy()
        feature[at], cut[at] = g["feature"], g["cut"]
        depth[at] = np.floor(np.log2(at)) + _mean_path(n)
        packed.append((feature, cut, depth / max(float(_mean_path(n[at == 1][0])), 1e-12)))
    trees = rows.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def isolation(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        total, lines = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, depth in trees.value:
            at = np.ones(len(x), dtype=np.int64)
            open_rows = lines[feature[at] >= 0]
            while len(open_rows):
                here = at[open_rows]
                at[open_rows] = 2 * here + (x[open_rows, feature[here]] > cut[here])
                open_rows = open_rows[feature[at[open_rows]] >= 0]
            total += depth[at]
        return pd.Series(np.power(2.0, -total / len(trees.value)))

    return rows.withColumn(name, isolation(*[F.round(f, PLACES) for f in features]))
