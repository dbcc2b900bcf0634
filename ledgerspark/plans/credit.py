"""Company rows -> metric bundles -> starting verdict -> promotion -> guardrails: one narrow projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.config import CreditConfig
from ledgerspark.operators import credit as C
from ledgerspark.sources.tables import rename_columns


def assess_companies(
    companies: DataFrame, as_of_year: int, answers: DataFrame | None = None, cfg: CreditConfig = CreditConfig()
) -> DataFrame:
    """Verdicts for all companies. answers (CompanyID, answer) gives the starting verdicts; without
    them, or where a company has none, the written policy does."""
    rows = C.policy_verdict(C.metric_bundles(rename_columns(companies), as_of_year), cfg)
    if answers is not None:
        given = C.coerce_verdicts(C.parse_verdicts(answers, "answer")).select(
            "CompanyID", F.struct("recommendation", "confidence", "rationale", "error").alias("_given"))
        rows = rows.join(given, "CompanyID", "left").withColumns({
            name: F.coalesce(F.col(f"_given.{name}"), F.col(name)) for name in ("recommendation", "confidence", "rationale")
        }).withColumn("error", F.col("_given.error")).drop("_given")
        # A failed assessment is final: it is neither promoted nor overruled.
        failed = rows.filter(F.col("error").isNotNull())
        rows = C.guardrails(C.promote_continue(rows.filter(F.col("error").isNull()), cfg), cfg)
        return rows.unionByName(failed.withColumns({
            "promoted": F.lit(False), "guardrail_fired": F.lit(False), "guardrail_rule": F.lit(None).cast("string"),
            "guardrail_reason": F.lit(""),
        }))
    return C.guardrails(C.promote_continue(rows, cfg), cfg)
