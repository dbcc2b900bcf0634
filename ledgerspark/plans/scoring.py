"""Owner scoring: model score -> percentile against stored scores -> 0..100 -> band and confidence."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.config import PortfolioConfig
from ledgerspark.operators import ranking as R


def score_entities(
    matrix: DataFrame, model: PipelineModel, reference: DataFrame, model_type: str, version: str = "1",
    cfg: PortfolioConfig = PortfolioConfig(), id_col: str = "LandLordID",
) -> DataFrame:
    """One row per owner: predicted score, percentile, 0..100 score, band, tenants, confidence, note."""
    tenants = F.coalesce(*[F.col(c).cast("bigint") for c in ("TenantCount", "PortfolioSize") if c in matrix.columns] or [F.lit(None).cast("bigint")])
    raw = model.transform(matrix).select(id_col, F.col("prediction").alias("PredictedScore"), tenants.alias("TenantCount"))
    placed = R.percentile_vs_reference(raw, "PredictedScore", reference, "score")
    return placed.select(
        id_col, "PredictedScore", F.col("score_0_100").alias("PredictedQualityScore"),
        F.col("percentile").alias("PercentileRank"),
        R.quality_band(F.col("percentile"), cfg.top_percentile, cfg.bottom_percentile).alias("QualityBand"),
        "TenantCount",
        R.confidence_level(F.col("TenantCount"), cfg.confidence_high, cfg.confidence_medium).alias("ConfidenceLevel"),
        F.when(
            F.col("TenantCount").isNull(), F.lit("Add TenantCount (or PortfolioSize) to estimate confidence.")
        ).alias("ConfidenceNote"),
        F.lit(model_type).alias("ModelType"), F.lit(version).alias("ModelVersion"),
    )
