"""Model fits on tables with MLlib: churn frequency and severity, baselines, grouped validation, scoring.

Only small numbers come back to the driver (counts, coefficients, metrics). Fit inputs are narrow
written tables, so the iterations do not recompute the feature plan.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor, IsotonicRegression, IsotonicRegressionModel, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.hashing import fold, unit
from ledgerspark.operators.portfolio import entity_shrunk_score
from ledgerspark.operators.shapley import mean_abs_contributions, tree_contributions  # noqa: F401
from ledgerspark.session import materialise
from ledgerspark.sources.tables import require_columns

# Columns never used as features of the company baseline: ids, targets, dimensions, and signals that
# the success score itself is made of.
BANNED_FEATURES = frozenset({
    "CompanyID", "LandLordID", "CompanyIsActive", "SuccessScore", "SuccessScoreRank",
    "OOFPredictedProb", "OOFResidual", "OOFFold", "CompanyStatus", "PrimaryType", "OriginCity",
    "OriginCountry", "PreferredIndustry", "SalesOfMainProduct", "SalesOfOtherProduct",
    "ReturningClient", "TotalActiveClients", "TodaysClients", "ClientsInTheLast7Days",
    "ClientsInTheLast6Months", "ClientsInTheLast12Months", "TotalClientsInTheLast7Days",
    "TotalClientsInTheLast6Months", "TotalClientsInTheLast12Months",
})


def temporal_split(df: DataFrame, date_col: str = "snapshot_date") -> tuple[DataFrame, DataFrame]:
    """(all but the latest snapshot, the latest snapshot). The date is a literal, so partitions prune."""
    last = df.agg(F.max(date_col)).first()[0]
    return df.filter(F.col(date_col) != F.lit(last)), df.filter(F.col(date_col) == F.lit(last))


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) == 0, 1)).alias("n")
    ).first()
    return row["p"], row["n"]


def balanced_weight(label: str, pos: int, neg: int) -> Column:
    """n / (2 n_class) per row."""
    total = pos + neg
    return F.when(F.col(label) == 1, F.lit(total / (2.0 * max(pos, 1)))).otherwise(F.lit(total / (2.0 * max(neg, 1))))


def as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def assembling(features: Sequence[str], tag: str = "") -> list:
    """Median imputation and vector assembly."""
    filled = [f"{c}__{tag}f" for c in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol=f"features{tag}"),
    ]


def usable(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one value: a column without any has no median."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in features]).first()
    return [c for c in features if row[c] > 0]


@dataclass
class Frequency:
    """Boosted churn classifier with isotonic calibration."""

    features: list[str]
    pipeline: PipelineModel
    isotonic: IsotonicRegressionModel | None

    def raw(self, df: DataFrame, out: str) -> DataFrame:
        scored = self.pipeline.transform(as_double(df, self.features))
        return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)

    def predict(self, df: DataFrame, out: str = "churn_prob") -> DataFrame:
        if self.isotonic is None:
            return self.raw(df, out)
        # The calibration curve is a short list of cut points; interpolation happens in the JVM.
        staged = self.raw(df, "_raw")
        return self.isotonic.transform(staged).withColumnRenamed("_calibrated", out).select(*df.columns, out)


def fit_frequency(
    df: DataFrame, features: Sequence[str], label: str = "y_churn", id_cols: Sequence[str] = ("customerid",),
    max_iter: int = 20, max_depth: int = 5, step: float = 0.1, seed: int = 42, calibrate: bool = True,
) -> Frequency:
    """Class-weighted boosting on 80 % of the rows, isotonic calibration on the other 20 %.

    The split is by md5 of the id, so it is the same in both classes and on every run. Calibration
    points are averaged per 1/10000 of probability before the monotone fit: at most 10001 rows.
    """
    features = usable(df, features)
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols])
    rows = as_double(df, features).withColumns({"_u": unit(key), "_y": F.col(label).cast("double")})
    fit, cal = (rows.filter(F.col("_u") < 0.8), rows.filter(F.col("_u") >= 0.8)) if calibrate else (rows, None)
    pos, neg = class_counts(fit, label)
    if not pos or not neg:
        raise ValueError(f"{label} has only one class")
    fit = fit.withColumn("_w", F.when(F.col(label) == 1, F.lit(neg / pos)).otherwise(F.lit(1.0)))
    gbt = GBTClassifier(
        labelCol="_y", weightCol="_w", maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed, subsamplingRate=0.8,
    )
    model = Frequency(list(features), Pipeline(stages=[*assembling(features), gbt]).fit(fit), None)
    if cal is not None:
        points = model.raw(cal, "_p").groupBy(F.round("_p", 4).alias("_raw")).agg(
            F.avg("_y").alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
        iso = IsotonicRegression(featuresCol="_raw", labelCol="_y", weightCol="_w", predictionCol="_calibrated")
        model.isotonic = iso.fit(points)
    return model


@dataclass
class Severity:
    features: list[str]
    pipeline: PipelineModel

    def predict(self, df: DataFrame, out: str = "severity") -> DataFrame:
        scored = self.pipeline.transform(as_double(df, self.features))
        return scored.withColumn(out, F.greatest(F.col("prediction"), F.lit(0.0))).select(*df.columns, out)


def fit_severity(
    df: DataFrame, features: Sequence[str], label: str = "y_churn", loss: str = "y_loss",
    max_iter: int = 20, max_depth: int = 5, step: float = 0.1, seed: int = 42,
) -> Severity:
    """Absolute-error boosting of the loss, on churned rows only; predictions are clipped at 0."""
    churned = df.filter(F.col(label) == 1)
    features = usable(churned, features)
    gbt = GBTRegressor(
        labelCol="_loss", lossType="absolute", maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed,
        subsamplingRate=0.8,
    )
    rows = as_double(churned, features).withColumn("_loss", F.col(loss).cast("double"))
    return Severity(list(features), Pipeline(stages=[*assembling(features), gbt]).fit(rows))


@dataclass
class Baseline:
    """A fitted baseline as plain numbers. Scoring is one column expression inside codegen."""

    features: list[str]
    medians: list[float]
    means: list[float]
    weights: list[float]
    bias: float

    def filled(self, name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(self.medians[self.features.index(name)]))

    def probability(self) -> Column:
        z = F.lit(self.bias)
        for name, mean, weight in zip(self.features, self.means, self.weights):
            z = z + F.lit(weight) * (self.filled(name) - F.lit(mean))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, df: DataFrame, out: str = "baseline_prob") -> DataFrame:
        return df.withColumn(out, self.probability())


def fit_logistic_baseline(
    df: DataFrame, features: Sequence[str], label: str = "y_churn", c: float = 1.0, max_iter: int = 100
) -> Baseline:
    """Median impute, standardise, class-balanced L2 logistic regression.

    Inverse regularisation C corresponds to regParam = 1 / (C x total weight); balanced weights add up
    to the number of rows. Equal rows are one weighted row of the fit.
    """
    features = usable(df, features)
    pos, neg = class_counts(df, label)
    if not pos or not neg:
        raise ValueError(f"{label} has only one class")
    rows = as_double(df, features).select(*features, F.col(label).cast("double").alias("_y"))
    imputer = assembling(features, "raw")[0].fit(rows)
    medians = imputer.surrogateDF.first().asDict()
    filled = imputer.getOutputCols()
    rows = imputer.transform(rows).select(*filled, "_y")
    moments = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in filled for f in (F.avg, F.stddev_samp)]).first()
    means = [float(moments[f"avg_{c}"]) for c in filled]
    stds = [float(moments[f"stddev_samp_{c}"] or 0.0) for c in filled]
    groups = materialise(rows.groupBy(*filled, "_y").agg(F.count(F.lit(1)).alias("_n")), "groups")
    scaled = groups.select(
        "_y", (balanced_weight("_y", pos, neg) * F.col("_n")).alias("_w"),
        *[((F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)).alias(c) for c, m, s in zip(filled, means, stds)])
    lr = LogisticRegression(
        labelCol="_y", weightCol="_w", maxIter=max_iter, regParam=1.0 / (c * (pos + neg)), standardization=False,
    ).fit(VectorAssembler(inputCols=filled, outputCol="features").transform(scaled))
    weights = [float(w / s) if s else 0.0 for w, s in zip(lr.coefficients.toArray(), stds)]
    return Baseline(list(features), [float(medians[f]) for f in features], means, weights, float(lr.intercept))


def with_expected_loss(df: DataFrame, freq: Frequency, sev: Severity, p: str = "churn_prob", out: str = "expected_loss") -> DataFrame:
    both = sev.predict(freq.predict(df, p), "_sev")
    return both.withColumn(out, F.col(p) * F.col("_sev")).drop("_sev")


def ablation_predictions(
    train: DataFrame, test: DataFrame, feature_sets: Mapping[str, Sequence[str]], keep: Sequence[str],
    max_iter: int = 10, max_depth: int = 4,
) -> DataFrame:
    """One wide table: p_<set> and exp_<set> per test row, with a recurring flag.

    The loop is over feature sets, each a distributed fit; predictions are added column by column.
    """
    out = test.withColumn("recurring", (F.col("n_events") >= 2).cast("int"))
    cols = [*keep, "recurring"]
    for name, features in feature_sets.items():
        freq = fit_frequency(train, features, max_iter=max_iter, max_depth=max_depth, calibrate=False)
        sev = fit_severity(train, features, max_iter=max_iter, max_depth=max_depth)
        out = with_expected_loss(out, freq, sev, f"p_{name}", f"exp_{name}")
        cols += [f"p_{name}", f"exp_{name}"]
    return out.select(*cols)


def group_kfold(df: DataFrame, group: str, n_splits: int, out: str = "fold") -> DataFrame:
    """Fold per row from the md5 of its group: whole groups stay together, without a shuffle."""
    return df.withColumn(out, fold(F.col(group), n_splits))


def clamp_splits(n_splits: int, n_groups: int, minority: int | None = None) -> int:
    return max(2, min(x for x in (n_splits, n_groups, minority) if x is not None))


def baseline_features(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in BANNED_FEATURES
    ]


def oof_residuals(
    model_base: DataFrame, features: Sequence[str] | None = None, label: str = "CompanyIsActive",
    group: str = "LandLordID", n_splits: int = 5, c: float = 0.1,
) -> DataFrame:
    """Model base with OOFPredictedProb, OOFResidual and OOFFold; rows without a label get null and -1.

    One distributed fit per fold on the other folds. The narrow fit table is written once.
    """
    require_columns(model_base, [label, group])
    features = list(features) if features is not None else baseline_features(model_base)
    require_columns(model_base, features)
    if not features:
        raise ValueError("no numeric feature columns left for the baseline")
    base = materialise(model_base, "base")
    labelled = base.filter(F.col(label).isNotNull())
    pos, neg = class_counts(labelled, label)
    if not pos or not neg:
        raise ValueError(f"{label} has only one class")
    groups = labelled.select(group).distinct().count()
    k = clamp_splits(n_splits, groups, min(pos, neg))
    # Written once: the folds' hashes cost more than all other work of a read, and each fit reads the rows several times.
    base = materialise(group_kfold(base, group, k, "OOFFold"), "folds")
    folded = base.filter(F.col(label).isNotNull())
    prob = F.lit(None).cast("double")
    for i in range(k):
        model = fit_logistic_baseline(folded.filter(F.col("OOFFold") != i), features, label, c)
        prob = F.when(F.col("OOFFold") == i, model.probability()).otherwise(prob)
    # One read gives every row its own fold's prediction.
    known = F.col(label).isNotNull()
    out = base.withColumn("OOFFold", F.when(known, F.col("OOFFold")).otherwise(F.lit(-1)))
    out = out.filter(F.col("OOFFold").isNotNull()).withColumn("OOFPredictedProb", prob)
    return out.withColumn("OOFResidual", F.col(label) - F.col("OOFPredictedProb"))


def adjusted_scores(model_base: DataFrame, features: Sequence[str] | None = None, n_splits: int = 5, m: float = 10.0) -> DataFrame:
    return entity_shrunk_score(oof_residuals(model_base, features, n_splits=n_splits), m=m)


MAX_CATEGORIES = 200
OTHER = "__other__"


def frequent(df: DataFrame, column: str, most: int) -> list[str] | None:
    """The `most` most frequent texts of a column; None if there are no more than that."""
    top = df.groupBy(column).count().filter(F.col(column).isNotNull()).orderBy(F.desc("count"), column).limit(most + 1).collect()
    return [row[0] for row in top[:most]] if len(top) > most else None


def encoding(numeric: Sequence[str], categorical: Sequence[str], df: DataFrame | None = None, most: int = MAX_CATEGORIES, trees: bool = False) -> Pipeline:
    """Median for numbers, index for texts; an unseen text gets the extra last index.

    With df given, a text column of more than `most` values keeps its most frequent ones and puts the rest into one class,
    so labels on the driver and bins of a tree are bounded. A tree has no more bins than rows: trees=True bounds by them, too.
    """
    if trees and df is not None and categorical:
        most = max(1, min(most, df.limit(most + 2).count() - 2))
    stages: list = []
    source = {c: c for c in categorical}
    for c in categorical if df is not None else ():
        kept = frequent(df, c, most)
        if kept is not None:
            listed = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in kept)
            stages.append(SQLTransformer(statement=f"SELECT *, CASE WHEN `{c}` IN ({listed}) THEN `{c}` ELSE '{OTHER}' END AS `{c}__k` FROM __THIS__"))
            source[c] = f"{c}__k"
    stages += [Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__f" for c in numeric])]
    inputs = [f"{c}__f" for c in numeric]
    if categorical:
        stages.append(StringIndexer(
            inputCols=[source[c] for c in categorical], outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep",
            stringOrderType="alphabetAsc"))
        inputs += [f"{c}__i" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages)


def encode_features(train: DataFrame, other: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Both tables encoded with what the training table alone shows."""
    ready = lambda df: as_double(df, numeric).withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("__missing__")) for c in categorical})
    model = encoding(numeric, categorical, ready(train)).fit(ready(train))
    return model.transform(ready(train)), model.transform(ready(other)), model


def regressors(seed: int = 42, rounds: int = 10) -> dict:
    return {
        "random_forest": RandomForestRegressor(labelCol="_t", numTrees=rounds, maxDepth=6, minInstancesPerNode=2, seed=seed, maxBins=MAX_CATEGORIES + 4),
        "boosted_trees": GBTRegressor(labelCol="_t", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed, maxBins=MAX_CATEGORIES + 4),
        "linear": LinearRegression(labelCol="_t", regParam=0.01, maxIter=50),
    }


@dataclass
class Validated:
    """Out-of-fold predictions (long by model), fold metrics, and a final fit per model."""

    predictions: DataFrame
    folds: DataFrame
    models: dict[str, PipelineModel]
    features: list[str]

    def importances(self) -> list[tuple[str, str, float]]:
        out = []
        for name, model in self.models.items():
            last = model.stages[-1]
            values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
            out += [(name, f, float(v)) for f, v in zip(self.features, values.toArray())]
        return out


def cv_regressors(
    matrix: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str = "AdjustedScore",
    id_col: str = "LandLordID", n_splits: int = 5, models: Mapping | None = None, seed: int = 42,
    final: bool = True,
) -> Validated:
    """Grouped cross-validation of several regressors: fold metrics, out-of-fold rows, and final fits unless not asked for."""
    from ledgerspark.operators.metrics import regression_metrics

    models = dict(models or regressors(seed))
    numeric = usable(matrix, numeric)
    rows = as_double(matrix.select(id_col, target, *numeric, *categorical), [*numeric]).withColumns({
        "_t": F.col(target).cast("double"),
        **{c: F.coalesce(F.col(c).cast("string"), F.lit("__missing__")) for c in categorical},
    }).filter(F.col("_t").isNotNull())
    rows = materialise(group_kfold(rows, id_col, n_splits), "matrix")
    parts, finals = [], {}
    for name, estimator in models.items():
        for i in range(n_splits):
            held = rows.filter(F.col("fold") == i)
            if held.isEmpty():
                continue
            others = rows.filter(F.col("fold") != i)
            fitted = Pipeline(stages=[*encoding(numeric, categorical, others, trees=True).getStages(), estimator]).fit(others)
            parts.append(fitted.transform(held).select(
                F.lit(name).alias("model_type"), id_col, "fold", F.col("_t").alias("truth"), F.col("prediction").alias("pred")))
        if final:
            finals[name] = Pipeline(stages=[*encoding(numeric, categorical, rows, trees=True).getStages(), estimator]).fit(rows)
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    predictions = materialise(predictions, "oof")
    folds = regression_metrics(predictions, "truth", "pred", ["model_type", "fold"])
    return Validated(predictions, folds, finals, [*numeric, *categorical])


def linear_contributions(
    df: DataFrame, features: Sequence[str], weights: Sequence[float], centres: Sequence[float]
) -> DataFrame:
    """weight x (value - centre) per feature as an array of drivers; a missing value contributes 0."""
    drivers = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.coalesce(F.lit(float(w)) * (F.col(f).cast("double") - F.lit(float(c))), F.lit(0.0)).alias("contribution"),
            F.col(f).cast("double").alias("value"),
        )
        for f, w, c in zip(features, weights, centres)
    ])
    return df.withColumn("drivers", drivers)


def logistic_contributions(df: DataFrame, model: Baseline) -> DataFrame:
    """Exact additive contributions to the log-odds of a fitted baseline, missing values at the median."""
    full = df.withColumns({f: model.filled(f) for f in model.features})
    return linear_contributions(full, model.features, model.weights, model.means)


def save_model(model: PipelineModel, path: str, reference: DataFrame, score_col: str, meta: Mapping) -> None:
    """One artifact folder: the pipeline, the reference scores, and a meta row."""
    spark = reference.sparkSession
    model.write().save(f"{path}/pipeline")
    reference.select(F.col(score_col).cast("double").alias("score")).write.parquet(f"{path}/reference_scores")
    spark.createDataFrame([(json.dumps(dict(meta), sort_keys=True),)], "meta string").write.json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, dict]:
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    return PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/reference_scores"), meta
