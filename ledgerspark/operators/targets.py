"""Company success targets: binary status, composite score of rank-normalised signals, sensitivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.config import WEIGHT_SETS, TargetConfig
from ledgerspark.functions.numeric import clip, col_or_null, safe_ratio_clip
from ledgerspark.operators.ranking import ROWS_PER_RANGE, average_ranks, dense_rank_desc
from ledgerspark.session import materialise
from ledgerspark.sources.tables import require_columns

COMPONENTS = ("sales_efficiency", "retention", "conversion", "momentum", "active_clients")
MISSING_WORDS = ("", "none", "nan", "null")


def binary_target(
    df: DataFrame, status_col: str = "CompanyStatus", cfg: TargetConfig = TargetConfig(), out: str = "CompanyIsActive"
) -> DataFrame:
    """1 / 0 / null from the status text. Without a negative list everything else, missing too, is 0."""
    require_columns(df, [status_col])
    text = F.lower(F.trim(F.col(status_col)))
    text = F.when(~text.isin(*MISSING_WORDS), text)
    lower = lambda labels: [x.lower() for x in labels]
    rest = F.lit(0.0) if cfg.negative is None else F.when(text.isin(*lower(cfg.negative)), F.lit(0.0))
    hit = F.when(text.isin(*lower(cfg.positive)), F.lit(1.0)).otherwise(rest)
    if cfg.exclude:
        hit = F.when(~F.coalesce(text.isin(*lower(cfg.exclude)), F.lit(False)), hit)
    return df.withColumn(out, hit)


def success_components(df: DataFrame) -> dict[str, Column]:
    """Five raw signals; each takes the first column name the table has."""
    num = lambda *names: col_or_null(df, *names)
    six = num("ClientsInTheLast6Months", "ClientsInTheLast6Month")
    twelve = num("ClientsInTheLast12Months", "ClientsInTheLast12Month")
    return {
        "sales_efficiency": safe_ratio_clip(num("SalesOfMainProduct"), num("MonthlyBudget", "Monthly budget")),
        "retention": safe_ratio_clip(num("ReturningClient"), num("TotalActiveClients")),
        "conversion": safe_ratio_clip(six, num(
            "TotalClientsInTheLast6Months", "TotalVisitorsInTheLast6Month", "TotalClientsInTheLast6Month")),
        "momentum": safe_ratio_clip(clip(twelve - six, 0.0), num(
            "TotalClientsInTheLast12Months", "TotalVisitorsInTheLast12Month", "TotalClientsInTheLast12Month")),
        "active_clients": clip(num("TotalActiveClients"), 0.0),
    }


def normalised_components(
    df: DataFrame, id_col: str = "CompanyID", names: Sequence[str] = COMPONENTS, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(id, component, share in 0..1) rows of the known signals.

    All signals are ranked together in long form: one count table, one join. Equal values are
    counted before the ranking, and missing values never reach the join.
    """
    parts = success_components(df)
    # The narrow signal table is read three times below (cut points, counts, join): written once.
    narrow = materialise(df.select(id_col, *[parts[n].alias(n) for n in names]), "signals")
    rows = narrow.select(
        id_col,
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("component"), F.col(n).alias("raw")) for n in names
        ])),
    ).filter(F.col("raw").isNotNull())
    ranks = average_ranks(rows, "raw", ["component"], rows_per_range=rows_per_range)
    share = F.when(F.col("n_valid") == 1, F.lit(0.5)).otherwise(
        F.try_divide(F.col("avg_rank") - 1, (F.col("n_valid") - 1).cast("double"))
    )
    return rows.join(ranks, ["component", "raw"]).select(id_col, "component", share.alias("share"))


def _weighted(weights: Mapping[str, float]) -> Column:
    """Weighted mean of the known shares: weights scaled to 1, then by the weight actually available."""
    total = sum(weights.values())
    scaled = {k: v / total for k, v in weights.items()} if abs(total - 1.0) > 1e-6 else dict(weights)
    w = F.lit(None).cast("double")
    for name, v in scaled.items():
        w = F.when(F.col("component") == name, F.lit(v)).otherwise(w)
    used = F.sum(w)
    return F.when(used > 0, F.when(used < 1 - 1e-6, F.sum(w * F.col("share")) / used).otherwise(F.sum(w * F.col("share"))))


def composite_score(
    df: DataFrame, id_col: str = "CompanyID", weights: Mapping[str, float] | None = None,
    return_components: bool = False, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """id -> SuccessScore in 0..1; ids with no known signal get null."""
    weights = dict(weights or TargetConfig().weights)
    names = [n for n in COMPONENTS if n in weights]
    long = normalised_components(df, id_col, names, rows_per_range)
    aggs = [_weighted(weights).alias("SuccessScore")]
    if return_components:
        aggs += [F.max(F.when(F.col("component") == n, F.col("share"))).alias(f"share_{n}") for n in names]
    return df.select(id_col).join(long.groupBy(id_col).agg(*aggs), id_col, "left")


def build_targets(
    companies: DataFrame, cfg: TargetConfig = TargetConfig(), id_col: str = "CompanyID",
    rows_per_range: int = ROWS_PER_RANGE, with_rank: bool = True,
) -> DataFrame:
    """Companies with CompanyIsActive, SuccessScore and SuccessScoreRank (1 = best)."""
    score = composite_score(companies, id_col, dict(cfg.weights), rows_per_range=rows_per_range)
    if not with_rank:
        return binary_target(companies, cfg=cfg).join(score, id_col, "left")
    score = materialise(score, "scores")
    # Scores are rounded before ranking so that equal sums added in another order stay equal.
    ranked = dense_rank_desc(
        score.withColumn("_s", F.round("SuccessScore", 12)), "_s", "SuccessScoreRank", rows_per_range
    ).drop("_s")
    return binary_target(companies, cfg=cfg).join(ranked, id_col, "left")


def weight_sensitivity(
    companies: DataFrame, weight_sets: Mapping[str, Sequence[float]] = WEIGHT_SETS, id_col: str = "CompanyID",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Spearman correlation of the scores under every pair of weight sets.

    Signals are ranked once; each weight set is one more aggregate. The scores are then ranked in
    long form and the pair correlations come from one aggregation over the ids.
    """
    names = list(weight_sets)
    long = normalised_components(companies, id_col, rows_per_range=rows_per_range)
    scores = long.groupBy(id_col).agg(*[
        _weighted(dict(zip(COMPONENTS, weight_sets[n]))).alias(n) for n in names
    ])
    scores = materialise(scores, "weighted")
    rows = scores.select(id_col, F.inline(F.array(*[
        F.struct(F.lit(n).alias("config"), F.round(F.col(n), 12).alias("score")) for n in names
    ]))).filter(F.col("score").isNotNull())
    ranks = average_ranks(rows, "score", ["config"], rows_per_range=rows_per_range)
    ranked = rows.join(ranks, ["config", "score"])
    wide = ranked.groupBy(id_col).agg(*[
        F.max(F.when(F.col("config") == n, F.col("avg_rank"))).alias(n) for n in names
    ])
    pairs = list(combinations(names, 2))
    one = wide.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"_{i}"), 4).alias("spearman"))
        for i, (a, b) in enumerate(pairs)
    ])))


def min_sensitivity(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.min("spearman").alias("min_spearman"))
