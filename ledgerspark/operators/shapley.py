"""Shapley values of fitted tree ensembles, path dependent: a feature that is left out splits by the rows each branch was fitted on.

A leaf asks one condition of every different feature on its path. What the leaf adds to each feature's value hangs only on
which of those conditions a row meets, so every leaf gets a table by that pattern, made once per task for all patterns at
once; scoring a batch is then a pattern number and a table look-up per leaf. Leaves with more than TABLE_BITS conditions
compute the patterns that a batch has. Rows stay where they are: no shuffle, and the model travels with the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.session import new_scratch

TABLE_BITS = 8


@dataclass
class Condition:
    """Of one feature on the way to a leaf: low < value <= high, or the code is one of `among` and none of `without`."""

    feature: int
    share: float = 1.0
    low: float = -math.inf
    high: float = math.inf
    among: frozenset[int] | None = None
    without: frozenset[int] = frozenset()

    def met(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        out = (v > self.low) & (v <= self.high)
        if self.among is not None:
            out &= np.isin(v, list(self.among))
        return out & ~np.isin(v, list(self.without)) if self.without else out


@dataclass
class Leaf:
    value: float
    conditions: list[Condition]
    table: np.ndarray | None = field(default=None, repr=False)

    @property
    def expected(self) -> float:
        return self.value * math.prod(c.share for c in self.conditions)

    def credit(self, met: np.ndarray) -> np.ndarray:
        """What the leaf adds to its features for each row of met (patterns x conditions).

        For a feature j: (met_j - share_j) * sum over subsets S of the others of |S|! (m - |S| - 1)! / m! times the product of
        met over S and of shares over the rest; the sums by |S| are coefficients of the product of (share + met * t).
        """
        shares = np.array([c.share for c in self.conditions])
        m = len(shares)
        weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
        out = np.empty((len(met), m))
        for j in range(m):
            sums = np.zeros((len(met), m))
            sums[:, 0] = 1.0
            for k in range(m):
                if k != j:
                    sums[:, 1:] = sums[:, 1:] * shares[k] + sums[:, :-1] * met[:, k, None]
                    sums[:, 0] *= shares[k]
            out[:, j] = self.value * (met[:, j] - shares[j]) * (sums @ weight)
        return out

    def add(self, x: np.ndarray, credit: np.ndarray) -> None:
        m = len(self.conditions)
        if not m:
            return
        met = np.stack([c.met(x) for c in self.conditions], axis=1)
        if m <= TABLE_BITS:
            if self.table is None:
                self.table = self.credit((np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float))
            own = self.table[met @ (1 << np.arange(m))]
        else:
            patterns, at = np.unique(met, axis=0, return_inverse=True)
            own = self.credit(patterns.astype(float))[at.reshape(-1)]
        credit[:, [c.feature for c in self.conditions]] += own


@dataclass
class Ensemble:
    """Leaves of all trees, their values weighted; prediction = base + sum of a row's Shapley values."""

    leaves: list[Leaf]

    @property
    def base(self) -> float:
        return math.fsum(leaf.expected for leaf in self.leaves)

    def values(self, x: np.ndarray) -> np.ndarray:
        credit = np.zeros(x.shape)
        for leaf in self.leaves:
            leaf.add(x, credit)
        return credit


def tree_table(model, spark: SparkSession) -> pd.DataFrame:
    """Nodes of a tree ensemble (trees x nodes per tree: a fixed model size), read from its saved form."""
    path = new_scratch(spark, "trees")
    model.write().save(path)
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["prediction"].alias("value"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["impurityStats"][0].alias("cover"),
        node["split"]["featureIndex"].alias("feature"), node["split"]["numCategories"].alias("n_cat"),
        node["split"]["leftCategoriesOrThreshold"].alias("cut"),
    ).toPandas().sort_values(["tree", "id"]).reset_index(drop=True)


def tree_leaves(nodes: pd.DataFrame, weight: float) -> list[Leaf]:
    """Leaves of one tree (rows of `tree_table`), conditions of a feature merged."""
    at = {r.id: r for r in nodes.itertuples()}
    out, todo = [], [(nodes["id"].min(), {})]
    while todo:
        number, path = todo.pop()
        node = at[number]
        if node.left < 0:
            out.append(Leaf(weight * node.value, list(path.values())))
            continue
        for child, left in ((node.left, True), (node.right, False)):
            was = path.get(node.feature) or Condition(node.feature)
            now = Condition(node.feature, was.share * (at[child].cover / node.cover if node.cover else 0.5), was.low, was.high, was.among, was.without)
            if node.n_cat >= 0:
                codes = frozenset(map(int, node.cut))
                if left:
                    now.among = codes if was.among is None else was.among & codes
                else:
                    now.without = was.without | codes  # codes not seen in the fit go right
            elif left:
                now.high = min(was.high, node.cut[0])
            else:
                now.low = max(was.low, node.cut[0])
            todo.append((child, {**path, node.feature: now}))
    return out


def ensemble(model, spark: SparkSession) -> Ensemble:
    """The trees of a fitted forest (mean of its trees), boosted regressor (sum) or boosted classifier (log-odds of class 1)."""
    kind = type(model).__name__
    weights = list(model.treeWeights)
    if kind.startswith("RandomForestRegression"):
        weights = [1.0 / len(weights)] * len(weights)
    elif kind.startswith("GBTClassification"):
        weights = [2.0 * w for w in weights]  # its probability is the logistic function of twice the sum
    elif not kind.startswith("GBTRegression"):
        raise ValueError(f"no Shapley values for {kind}")
    nodes = tree_table(model, spark)
    return Ensemble([leaf for t, part in nodes.groupby("tree") for leaf in tree_leaves(part, weights[int(t)])])


def shapley_drivers(df: DataFrame, pipeline: PipelineModel, features: Sequence[str], id_cols: Sequence[str]) -> DataFrame:
    """(ids, base, drivers): drivers is an array of (feature, contribution, value), one for each feature in the given order.

    The model's prediction (log-odds for a classifier) is base + the sum of contributions. value: as the row has it for
    numbers, null if missing; the model's code for texts.
    """
    trees = ensemble(pipeline.stages[-1], df.sparkSession)
    base, names = trees.base, list(features)
    numbers = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["_x"].to_numpy()) if len(batch) else np.empty((0, len(names)))
            out = batch.drop(columns=["_x"])
            out["_credit"] = list(trees.values(x))
            yield out

    own = F.array(*(F.col(f"`{f}`").cast("double") if f in numbers else F.lit(None).cast("double") for f in names))
    coded = F.array(*(F.lit(f not in numbers) for f in names))
    ready = pipeline.transform(df).select(*id_cols, vector_to_array("features").alias("_x"), own.alias("_own"))
    schema = T.StructType([*(df.schema[c] for c in id_cols), T.StructField("_own", T.ArrayType(T.DoubleType())), T.StructField("_codes", T.ArrayType(T.DoubleType())),
                           T.StructField("_credit", T.ArrayType(T.DoubleType()))])
    solved = ready.select(*id_cols, "_own", F.col("_x").alias("_codes"), "_x").mapInPandas(solve, schema)
    return solved.select(*id_cols, F.lit(base).alias("base"), F.transform(
        F.arrays_zip(F.array(*map(F.lit, names)).alias("f"), F.col("_credit"), F.col("_own"), F.col("_codes"), coded.alias("coded")),
        lambda d: F.struct(d["f"].alias("feature"), d["_credit"].alias("contribution"), F.when(d["coded"], d["_codes"]).otherwise(d["_own"]).alias("value")),
    ).alias("drivers"))


def tree_contributions(df: DataFrame, pipeline: PipelineModel, features: Sequence[str], id_cols: Sequence[str]) -> DataFrame:
    """The same in long rows (ids, feature, contribution, value)."""
    return shapley_drivers(df, pipeline, features, id_cols).select(*id_cols, F.inline("drivers"))


def mean_abs_contributions(long: DataFrame) -> DataFrame:
    """Global importance: (feature, mean_abs_contribution) over all rows."""
    return long.groupBy("feature").agg(F.avg(F.abs(F.col("contribution"))).alias("mean_abs_contribution"))


def strongest(drivers: Column, k: int = 4) -> Column:
    """struct(main, increasing, decreasing): the k strongest drivers each way, and the strongest of all."""
    def picked(keep) -> Column:
        order = F.transform(F.filter(drivers, keep), lambda d: F.struct((-F.abs(d["contribution"])).alias("w"), d["feature"].alias("f"), d.alias("d")))
        return F.transform(F.slice(F.array_sort(order), 1, k), lambda s: s["d"])

    first = F.array_min(F.transform(drivers, lambda d: F.struct((-F.abs(d["contribution"])).alias("w"), d["feature"].alias("f"), d.alias("d"))))["d"]
    return F.struct(first.alias("main"), picked(lambda d: d["contribution"] > 0).alias("increasing"), picked(lambda d: d["contribution"] < 0).alias("decreasing"))
