"""Shapley values of tree ensembles against the definition: all subsets of features, left-out features split by cover."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from ledgerspark.operators import models as ML
from ledgerspark.operators import shapley as SH

NUMBERS, TEXTS = ["a", "b", "c"], ["kind"]
NAMES = [*NUMBERS, *TEXTS]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(300):
        a, b, c, kind = rng.gauss(0, 1), rng.randint(0, 4), rng.random() if i % 9 else None, rng.choice("uvwxyz")
        t = a * (2 if kind in "uvx" else -1) + b * (c or 0.5) + rng.gauss(0, 0.1)
        out.append((i, a, b, c, kind, t, float(t > 1)))
    return spark.createDataFrame(out, "id int, a double, b int, c double, kind string, _t double, _y double").cache()


def fit(rows, estimator, texts=TEXTS):
    ready = ML.as_double(rows, NUMBERS)
    return ready, Pipeline(stages=[*ML.encoding(NUMBERS, texts).getStages(), estimator]).fit(ready)


def brute(nodes, weight, x):
    """Shapley values of one tree by the definition."""
    at = {r.id: r for r in nodes.itertuples()}

    def expect(i, known):
        n = at[i]
        if n.left < 0:
            return n.value
        left = x[n.feature] in n.cut if n.n_cat >= 0 else x[n.feature] <= n.cut[0]
        if n.feature in known:
            return expect(n.left if left else n.right, known)
        return (at[n.left].cover * expect(n.left, known) + at[n.right].cover * expect(n.right, known)) / n.cover

    k, root = len(x), nodes["id"].min()
    out = [0.0] * k
    for j in range(k):
        rest = [f for f in range(k) if f != j]
        for size in range(k):
            share = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
            for s in itertools.combinations(rest, size):
                out[j] += weight * share * (expect(root, {*s, j}) - expect(root, set(s)))
    return out


ESTIMATORS = {
    "forest": lambda: RandomForestRegressor(labelCol="_t", numTrees=3, maxDepth=5, seed=1),
    "boosted": lambda: GBTRegressor(labelCol="_t", maxIter=4, maxDepth=4, seed=1),
    "classifier": lambda: GBTClassifier(labelCol="_y", maxIter=4, maxDepth=4, seed=1),
}


@pytest.mark.parametrize("name", ESTIMATORS)
def test_equals_all_subsets(spark, rows, name):
    ready, pipe = fit(rows, ESTIMATORS[name]())
    model = pipe.stages[-1]
    trees = SH.ensemble(model, spark)
    table = SH.tree_table(model, spark)
    scale = {"forest": 1 / 3, "boosted": 1, "classifier": 2}[name]
    weights = [scale * (w if name != "forest" else 1) for w in model.treeWeights]
    x = np.array([r[0].toArray() for r in pipe.transform(ready).select("features").limit(40).collect()])
    x = np.vstack([x, [[0, 1, 0.5, 99.0]]])  # a text that the fit has not seen
    want = [np.sum([brute(part, weights[int(t)], row) for t, part in table.groupby("tree")], axis=0) for row in x]
    assert np.abs(trees.values(x) - want).max() < 1e-9
    assert any(len(leaf.conditions) >= 3 for leaf in trees.leaves)
    assert any(c.among or c.without for leaf in trees.leaves for c in leaf.conditions)
    for leaf in trees.leaves:
        leaf.table = None
    bits, SH.TABLE_BITS = SH.TABLE_BITS, 1  # leaves with more conditions look at the batch's own patterns
    try:
        assert np.abs(trees.values(x) - want).max() < 1e-9
    finally:
        SH.TABLE_BITS = bits


@pytest.mark.parametrize("name", ESTIMATORS)
def test_base_and_values_give_the_prediction(rows, name):
    ready, pipe = fit(rows, ESTIMATORS[name]())
    found = SH.shapley_drivers(ready, pipe, NAMES, ["id"])
    total = F.col("base") + F.aggregate("drivers", F.lit(0.0), lambda s, d: s + d["contribution"])
    out = pipe.transform(ready)
    if name == "classifier":
        p = vector_to_array("probability")[1]
        out = out.withColumn("prediction", F.log(p / (1 - p)))
    gaps = found.join(out.select("id", "prediction"), "id").select(F.abs(total - F.col("prediction")).alias("gap"), F.size("drivers").alias("k")).collect()
    assert len(gaps) == 300 and max(g.gap for g in gaps) < 1e-8 and {g.k for g in gaps} == {4}


def test_values_are_the_rows_own(rows):
    ready, pipe = fit(rows, ESTIMATORS["boosted"]())
    got = {(r.id, r.feature): r.value for r in SH.tree_contributions(ready, pipe, NAMES, ["id"]).collect()}
    for r in rows.collect():
        assert (got[r.id, "a"], got[r.id, "b"], got[r.id, "c"]) == (r.a, r.b, r.c)
        assert got[r.id, "kind"] == "uvwxyz".index(r.kind)


def test_importance_and_strongest(spark, rows):
    ready, pipe = fit(rows, ESTIMATORS["boosted"]())
    long = SH.tree_contributions(ready, pipe, NAMES, ["id"])
    table = {r.feature: r.mean_abs_contribution for r in SH.mean_abs_contributions(long).collect()}
    own = [(r.feature, abs(r.contribution)) for r in long.collect()]
    assert table == {n: pytest.approx(sum(c for f, c in own if f == n) / 300) for n in NAMES} and min(table.values()) > 0
    drivers = spark.createDataFrame([([("x", 1.0, None), ("y", -3.0, 2.0), ("z", 2.0, 0.0), ("w", 2.0, 1.0), ("v", 0.0, 1.0)],), ([],)],
                                    "drivers array<struct<feature:string,contribution:double,value:double>>")
    one, none = drivers.select(SH.strongest(F.col("drivers"), 2).alias("s")).collect()
    assert one.s.main.feature == "y" and [d.feature for d in one.s.increasing] == ["w", "z"] and [d.feature for d in one.s.decreasing] == ["y"]
    assert none.s.main is None and none.s.increasing == []


def test_a_tree_of_one_leaf_has_no_values(rows, spark):
    ready, pipe = fit(rows.withColumn("_t", F.lit(2.0)), ESTIMATORS["forest"](), [])
    trees = SH.ensemble(pipe.stages[-1], spark)
    assert trees.base == pytest.approx(2.0) and not trees.values(np.zeros((3, 3))).any()
    assert SH.shapley_drivers(ready.limit(0), pipe, NUMBERS, ["id"]).count() == 0
