"""Company credit triage: metric bundles, verdict texts, promotion, guardrails.

All of it is row-local column work: one narrow projection, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.config import CreditConfig
from ledgerspark.functions.lookups import RISK_TIERS, STATUS_FLAGS, by_class
from ledgerspark.functions.numeric import TINY, col_or_null, growth_rate, safe_ratio_null

VERDICTS = ("Continue", "Review", "No-Go")
CONFIDENCES = ("low", "medium", "high")
ALL_VERDICTS = VERDICTS + ("Error",)


def issues(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds, in the order given."""
    return F.array_compact(
        F.array(*[F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in rules])
    )


def _about_zero(c: Column) -> Column:
    return F.coalesce(F.abs(c) < TINY, F.lit(False))


def financial_health(main: Column, other: Column, budget: Column, invested: Column) -> Column:
    revenue = F.when(
        main.isNotNull() | other.isNotNull(),
        F.coalesce(main, F.lit(0.0)) + F.coalesce(other, F.lit(0.0)),
    )
    return F.struct(
        F.bround(revenue, 2).alias("revenue_estimate"),
        safe_ratio_null(revenue, budget).alias("budget_utilisation_ratio"),
        safe_ratio_null(revenue, invested).alias("revenue_per_investment"),
        safe_ratio_null(main, revenue).alias("sales_mix_ratio"),
        issues(
            (main.isNull(), "missing: sales_main"),
            (other.isNull(), "missing: sales_other"),
            (budget.isNull(), "missing: monthly_budget"),
            (_about_zero(budget), "zero: monthly_budget"),
            (invested.isNull(), "missing: investments"),
            (_about_zero(invested), "zero: investments"),
            (_about_zero(revenue), "zero: total_revenue (sales_main + sales_other)"),
        ).alias("data_quality_issues"),
    )


def _rate_issues(name: str, top: Column, bottom: Column, words: tuple[str, str, str]) -> list[tuple[Column, str]]:
    """First problem of a ratio only: missing top, else missing bottom, else zero bottom."""
    return [
        (top.isNull(), f"missing: {name} {words[0]}"),
        (top.isNotNull() & bottom.isNull(), f"missing: {name} {words[1]}"),
        (top.isNotNull() & _about_zero(bottom), f"zero: {name} {words[2]}"),
    ]


def client_engagement(
    todays: Column, returning: Column, active: Column,
    clients_7d: Column, clients_6m: Column, clients_12m: Column,
    visitors_7d: Column, visitors_12m: Column,
) -> Column:
    ratio_words = ("numerator", "denominator", "denominator")
    growth_words = ("(recent)", "(baseline)", "baseline")
    half_year = clients_12m / F.lit(2.0)
    full_year = clients_6m * F.lit(2.0)
    yearly_visits = visitors_7d * F.lit(52.0)
    found: list[tuple[Column, str]] = []
    found += _rate_issues("retention_rate", returning, todays, ratio_words)
    found += _rate_issues("active_client_ratio", active, todays, ratio_words)
    found += _rate_issues("client_growth_rate_6m", clients_6m, half_year, growth_words)
    found += _rate_issues("client_growth_rate_12m", clients_12m, full_year, growth_words)
    found += _rate_issues("conversion_rate_7d", clients_7d, visitors_7d, ratio_words)
    found += _rate_issues("visitor_trend_ratio", yearly_visits, visitors_12m, ratio_words)
    return F.struct(
        safe_ratio_null(returning, todays).alias("retention_rate"),
        safe_ratio_null(active, todays).alias("active_client_ratio"),
        growth_rate(clients_6m, half_year).alias("client_growth_rate_6m"),
        growth_rate(clients_12m, full_year).alias("client_growth_rate_12m"),
        safe_ratio_null(clients_7d, visitors_7d).alias("conversion_rate_7d"),
        safe_ratio_null(yearly_visits, visitors_12m).alias("visitor_trend_ratio"),
        issues(*found).alias("data_quality_issues"),
    )


def normalise_status(raw: Column) -> Column:
    return F.coalesce(by_class(raw, STATUS_FLAGS), F.lit("unknown"))


def risk_tier(kind: Column) -> Column:
    return F.coalesce(by_class(kind, RISK_TIERS), F.lit("medium"))


def company_age(year: Column, as_of_year: int) -> Column:
    age = F.lit(as_of_year) - year.try_cast("int")
    return F.when(age >= 0, age)


def rank_band(rank: Column) -> Column:
    return (
        F.when(rank.isNull(), F.lit("unknown"))
        .when(rank > 4.0, F.lit("strong"))
        .when(rank >= 3.0, F.lit("acceptable"))
        .otherwise(F.lit("weak"))
    )


def business_profile(
    status: Column, kind: Column, year: Column, country: Column, rank: Column, as_of_year: int
) -> Column:
    blank = status.isNull() | (F.trim(status) == "")
    return F.struct(
        normalise_status(status).alias("status_flag"),
        risk_tier(kind).alias("business_type_risk_tier"),
        company_age(year, as_of_year).alias("company_age_years"),
        rank_band(rank).alias("rank_band"),
        country.alias("country"),
        issues(
            (blank, "missing: company_status"),
            (
                ~blank & by_class(status, STATUS_FLAGS).isNull(),
                F.concat(F.lit("unknown_status_value: '"), status, F.lit("'")),
            ),
            (kind.isNull(), "missing: primary_type"),
            (
                kind.isNotNull() & by_class(kind, RISK_TIERS).isNull(),
                F.concat(F.lit("unknown_primary_type: '"), kind, F.lit("' (defaulted to medium)")),
            ),
            (year.isNull(), "missing: year_founded"),
            (
                year.try_cast("int") > as_of_year,
                F.concat(F.lit("invalid: year_founded ("), year.cast("string"), F.lit(") is in the future")),
            ),
            (country.isNull(), "missing: origin_country"),
            (rank.isNull(), "missing: rank"),
        ).alias("data_quality_issues"),
    )


def metric_bundles(companies: DataFrame, as_of_year: int) -> DataFrame:
    """The three metric structs per company; absent columns count as null."""
    num = lambda *names: col_or_null(companies, *names)
    text = lambda name: col_or_null(companies, name, cast="string")
    return companies.withColumns({
        "financial_health": financial_health(
            num("SalesMain"), num("SalesOther"), num("MonthlyBudget"), num("Investments")
        ),
        "client_engagement": client_engagement(
            num("TodaysClients"), num("ReturningClients"), num("TotalActiveClients"),
            num("Clients7D"), num("Clients6M"), num("Clients12M"),
            num("Visitors7D"), num("Visitors12M"),
        ),
        "business_profile": business_profile(
            text("CompanyStatus"), text("PrimaryType"),
            F.col("YearFounded") if "YearFounded" in companies.columns else F.lit(None).cast("int"),
            text("OriginCountry"), num("Rank"), as_of_year,
        ),
    })


def policy_verdict(df: DataFrame, cfg: CreditConfig = CreditConfig()) -> DataFrame:
    """Starting verdict from the written screening policy (used when there is no answer text)."""
    status = F.col("business_profile.status_flag")
    util = F.col("financial_health.budget_utilisation_ratio")
    kept = F.col("client_engagement.retention_rate")
    n_issues = (
        F.size("financial_health.data_quality_issues")
        + F.size("client_engagement.data_quality_issues")
        + F.size("business_profile.data_quality_issues")
    )
    return df.withColumns({
        "recommendation": F.when(
            status.isin(*cfg.blocked_statuses) | (util < cfg.budget_burn_threshold), F.lit("No-Go")
        )
        .when(
            (status == "active")
            & (util >= cfg.continue_util_floor)
            & (kept >= cfg.continue_retention_floor),
            F.lit("Continue"),
        )
        .otherwise(F.lit("Review")),
        "confidence": F.when(n_issues == 0, F.lit("high")).when(n_issues <= 3, F.lit("medium")).otherwise(F.lit("low")),
        "rationale": F.concat(
            F.lit("status "), status,
            F.lit(", budget utilisation "), F.coalesce(util.cast("string"), F.lit("unknown")),
            F.lit(", retention "), F.coalesce(kept.cast("string"), F.lit("unknown")),
            F.lit(", data gaps "), n_issues.cast("string"),
        ),
    })


def promote_continue(df: DataFrame, cfg: CreditConfig = CreditConfig()) -> DataFrame:
    """Lift a non-Continue verdict of an active company whose ratios clear the bar."""
    util = F.col("financial_health.budget_utilisation_ratio")
    kept = F.col("client_engagement.retention_rate")
    strong = (util >= cfg.continue_strong_util) & (kept >= cfg.continue_retention_floor)
    adequate = (util >= cfg.continue_util_floor) & (
        kept >= max(cfg.continue_retention_floor, cfg.continue_adequate_retention)
    )
    lift = F.coalesce(
        (F.col("recommendation") != "Continue")
        & (F.col("business_profile.status_flag") == "active")
        & (util >= cfg.continue_util_floor)
        & (strong | adequate),
        F.lit(False),
    )
    note = F.concat(
        F.lit("[CONTINUE CALIBRATION] Active company with budget_utilisation_ratio="), util.cast("string"),
        F.lit(" and retention_rate="), kept.cast("string"),
        F.lit(
            " meets the adequate first-pass Continue bar "
            f"(util≥{cfg.continue_util_floor}, retention≥{cfg.continue_retention_floor}). LLM had recommended "
        ),
        F.col("recommendation"), F.lit(".\n\n"),
    )
    return df.withColumns({
        "rationale": F.when(lift, F.concat(note, F.col("rationale"))).otherwise(F.col("rationale")),
        "confidence": F.when(lift & (F.col("confidence") == "low"), F.lit("medium")).otherwise(F.col("confidence")),
        "recommendation": F.when(lift, F.lit("Continue")).otherwise(F.col("recommendation")),
        "promoted": lift,
    })


def guardrails(df: DataFrame, cfg: CreditConfig = CreditConfig()) -> DataFrame:
    """Hard rules in priority order; the first that fires forces No-Go with high confidence."""
    status = F.col("business_profile.status_flag")
    util = F.col("financial_health.budget_utilisation_ratio")
    rules = [
        (
            "company_status_hard_stop",
            status.isin(*cfg.blocked_statuses),
            F.concat(
                F.lit("Company status is '"), status,
                F.lit(
                    "'. A non-active company cannot service or repay growth capital. "
                    "This rule fires regardless of financial or engagement metrics."
                ),
            ),
        ),
        (
            "extreme_budget_burn",
            util < cfg.budget_burn_threshold,
            F.concat(
                F.lit("Revenue covers only "), F.bround(util * 100, 1).cast("string"),
                F.lit(
                    f"% of monthly budget (threshold: {int(cfg.budget_burn_threshold * 100)}%). "
                    "The company is structurally insolvent — it cannot repay growth capital."
                ),
            ),
        ),
    ]
    hit = F.coalesce(*[
        F.when(cond, F.struct(F.lit(name).alias("rule"), text.alias("reason"))) for name, cond, text in rules
    ])
    fired = F.col("_hit").isNotNull()
    notice = F.concat(
        F.lit("[GUARDRAIL OVERRIDE — "), F.col("_hit.rule"), F.lit("] "), F.col("_hit.reason"),
        F.lit("\n\n"), F.col("rationale"),
    )
    return (
        df.withColumn("_hit", hit)
        .withColumns({
            "recommendation": F.when(fired, F.lit("No-Go")).otherwise(F.col("recommendation")),
            "confidence": F.when(fired, F.lit("high")).otherwise(F.col("confidence")),
            "rationale": F.when(fired, notice).otherwise(F.col("rationale")),
            "guardrail_fired": fired,
            "guardrail_rule": F.col("_hit.rule"),
            "guardrail_reason": F.when(
                fired, F.concat(F.col("_hit.rule"), F.lit(": "), F.col("_hit.reason"))
            ).otherwise(F.lit("")),
        })
        .drop("_hit")
    )


VERDICT_TYPE = "recommendation string, confidence string, rationale string"
FALLBACK_TYPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("recommendation", "confidence", "rationale")]
    + [T.StructField("tool_call", T.BooleanType())]
)


def _verdict_fields(found: object) -> tuple | None:
    if isinstance(found, dict) and "recommendation" in found:
        text = lambda key: None if found.get(key) is None else str(found[key])
        return text("recommendation") or "", text("confidence"), text("rationale"), False
    return None


def _tool_call(found: object) -> bool:
    first = found[0] if isinstance(found, list) and found else found
    return isinstance(first, dict) and "name" in first and bool({"args", "arguments"} & first.keys())


def _scan_answer(text: str) -> tuple:
    """Verdict hidden in prose: every balanced brace block as JSON, then the text as a literal."""
    import ast
    import json

    found: list[object] = []
    opened: list[int] = []
    for at, ch in enumerate(text):
        if ch == "{":
            opened.append(at)
        elif ch == "}" and opened:
            start = opened.pop()
            if not opened:
                try:
                    found.append(json.loads(text[start : at + 1]))
                except ValueError:
                    pass
    try:
        found.append(json.loads(text))
    except ValueError:
        try:
            found.append(ast.literal_eval(text))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
    for item in found:
        hit = _verdict_fields(item)
        if hit:
            return hit
    return None, None, None, any(_tool_call(item) for item in found)


@F.pandas_udf(FALLBACK_TYPE)
def _scan_answers(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = ["recommendation", "confidence", "rationale", "tool_call"]
    for batch in texts:
        rows = [_scan_answer(t.strip()) if t is not None else (None, None, None, False) for t in batch]
        yield pd.DataFrame(rows, columns=names).astype({"tool_call": "bool"})


def parse_verdicts(df: DataFrame, text_col: str) -> DataFrame:
    """Answer texts -> verdict struct and parse_error. Clean JSON never leaves the JVM."""
    quick = F.from_json(F.trim(F.col(text_col)), VERDICT_TYPE)
    clean = F.when(F.trim(F.col(text_col)).startswith("{"), quick)
    staged = df.withColumn("_quick", F.when(clean["recommendation"].isNotNull(), clean))
    hard = staged.filter(F.col("_quick").isNull() & F.col(text_col).isNotNull())
    easy = staged.filter(F.col("_quick").isNotNull() | F.col(text_col).isNull())
    parsed = hard.withColumn("_slow", _scan_answers(F.col(text_col)))
    slow = F.when(F.col("_slow.recommendation").isNotNull(), F.struct(*[
        F.col(f"_slow.{n}").alias(n) for n in ("recommendation", "confidence", "rationale")
    ]))
    failed = F.when(
        slow.isNull(),
        F.when(
            F.col("_slow.tool_call"),
            F.lit(
                "Model returned tool-call JSON instead of a verdict. "
                "Expected an object with keys recommendation / confidence / rationale."
            ),
        ).otherwise(F.lit("Could not parse JSON verdict from LLM output.")),
    )
    missing = F.when(F.col(text_col).isNull(), F.lit("Could not parse JSON verdict from LLM output."))
    return easy.select(
        *df.columns, F.col("_quick").alias("verdict"), missing.alias("parse_error")
    ).unionByName(parsed.select(*df.columns, slow.alias("verdict"), failed.alias("parse_error")))


def coerce_verdicts(df: DataFrame) -> DataFrame:
    """Verdict struct + parse_error -> allowed values; a failed row is No-Go with the error text."""
    rec, conf = F.col("verdict.recommendation"), F.col("verdict.confidence")
    bad = F.col("parse_error").isNotNull()
    return df.withColumns({
        "recommendation": F.when(bad, F.lit("No-Go"))
        .when(rec.isin(*VERDICTS), rec)
        .otherwise(F.lit("Review")),
        "confidence": F.when(bad, F.lit("low")).when(conf.isin(*CONFIDENCES), conf).otherwise(F.lit("low")),
        "rationale": F.when(
            bad, F.concat(F.lit("Assessment could not be completed: "), F.col("parse_error"))
        ).otherwise(F.coalesce(F.col("verdict.rationale"), F.lit("No rationale provided."))),
        "error": F.col("parse_error"),
    })


# Tool name in the message log -> bundle name.
TOOL_NAMES = {
    "compute_financial_health": "financial_health",
    "assess_client_engagement": "client_engagement",
    "check_business_profile": "business_profile",
}


def collect_tool_outputs(messages: DataFrame) -> DataFrame:
    """Message log (id, seq, role, name, content, has_tool_calls) -> last output per tool and final answer.

    One grouped aggregation: max_by keeps a single candidate per group on the map side, so a
    conversation of any length never meets in one place.
    """
    content = F.trim(F.col("content"))
    head = F.from_json(content, "array<struct<name:string,args:string,arguments:string>>")
    single = F.from_json(content, "name string, args string, arguments string, recommendation string")
    tool_payload = F.coalesce(
        F.when(
            content.startswith("["),
            head[0]["name"].isNotNull() & F.coalesce(head[0]["args"], head[0]["arguments"]).isNotNull(),
        ),
        F.when(
            content.startswith("{"),
            single["name"].isNotNull()
            & F.coalesce(single["args"], single["arguments"]).isNotNull()
            & single["recommendation"].isNull(),
        ),
        F.lit(False),
    )
    answer = (
        (F.col("role") == "assistant") & ~F.coalesce(F.col("has_tool_calls"), F.lit(False))
        & (content != "") & ~tool_payload
    )
    aggs = []
    for raw, name in TOOL_NAMES.items():
        mine = (F.col("role") == "tool") & F.col("name").isin(raw, name)
        aggs.append(F.max_by(F.when(mine, F.col("content")), F.when(mine, F.col("seq"))).alias(name))
    aggs.append(F.max_by(F.when(answer, content), F.when(answer, F.col("seq"))).alias("final_text"))
    return messages.groupBy("id").agg(*aggs)


def verdict_summary(
    verdicts: DataFrame, id_col: str = "CompanyID", verdict_col: str = "recommendation"
) -> DataFrame:
    """Count and share per verdict in fixed order, empty verdicts included.

    One global conditional aggregation; the id lists go out through write_verdict_lists, never
    through one array cell.
    """
    from ledgerspark.functions.numeric import count_if, pct

    label = F.col(verdict_col)
    one = verdicts.agg(
        F.count(F.lit(1)).alias("_n"),
        *[count_if(label == v).alias(f"_c{i}") for i, v in enumerate(ALL_VERDICTS)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(v).alias(verdict_col),
            F.col(f"_c{i}").alias("n"), pct(F.col(f"_c{i}"), F.col("_n"), 1).alias("pct"),
        )
        for i, v in enumerate(ALL_VERDICTS)
    ])
    return one.select(F.inline(rows))
