"""Data-quality checks as finding rows: check, severity, dataset, column, message, detail.

Each check is one aggregation whose single row is turned into findings. Nothing is collected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.numeric import count_if
from ledgerspark.operators.profile import null_rates, value_counts

CRITICAL, WARNING, INFO = "CRITICAL", "WARNING", "INFO"
FINDING = "check string, severity string, dataset string, column string, message string, detail map<string,string>"

# Columns that must not be negative, ratio denominators, and nested time windows.
NON_NEGATIVE = {
    "landlords": ("ActiveCompanies", "Area", "TotalPopulationAround"),
    "companies": (
        "SalesOfMainProduct", "SalesOfOtherProduct", "MonthlyBudget", "TotalActiveClients",
        "TodaysClients", "ClientsInTheLast7Days", "ClientsInTheLast6Months",
        "ClientsInTheLast12Months", "TotalClientsInTheLast7Days", "TotalClientsInTheLast6Months",
        "TotalClientsInTheLast12Months", "Investments", "ReturningClient", "Rank",
    ),
}
DENOMINATORS = ("Area", "ActiveCompanies", "MonthlyBudget")
WINDOW_PAIRS = (
    ("ClientsInTheLast7Days", "ClientsInTheLast6Months", "clients 7d vs 6m"),
    ("ClientsInTheLast7Days", "ClientsInTheLast12Months", "clients 7d vs 12m"),
    ("ClientsInTheLast6Months", "ClientsInTheLast12Months", "clients 6m vs 12m"),
    ("TotalClientsInTheLast7Days", "TotalClientsInTheLast6Months", "total clients 7d vs 6m"),
    ("TotalClientsInTheLast7Days", "TotalClientsInTheLast12Months", "total clients 7d vs 12m"),
    ("TotalClientsInTheLast6Months", "TotalClientsInTheLast12Months", "total clients 6m vs 12m"),
)
CATEGORICAL = {
    "landlords": ("PreferredIndustry", "OriginCity", "OriginCountry"),
    "companies": ("CompanyStatus", "PrimaryType", "OriginCity", "OriginCountry"),
}


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def finding(
    check: str, severity: Column | str, dataset: str, column: str | None, message: Column | str,
    when: Column | None = None, **detail: Column,
) -> Column:
    """One finding struct, or null when the condition does not hold."""
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    row = F.struct(
        F.lit(check).alias("check"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(dataset).alias("dataset"),
        F.lit(column).cast("string").alias("column"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("detail"),
    )
    return row if when is None else F.when(when, row)


def findings_of(one: DataFrame, rows: Sequence[Column]) -> DataFrame:
    if not rows:
        return one.sparkSession.createDataFrame([], FINDING)
    return one.select(F.inline(F.array_compact(F.array(*rows))))


def absent(df: DataFrame, check: str, dataset: str, column: str, message: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(check, WARNING, dataset, column, message, {})], FINDING)


def check_identifiers(df: DataFrame, id_col: str, dataset: str) -> DataFrame:
    """Null or blank ids are critical, duplicates a warning, otherwise info. Grouped once by id."""
    ids = F.col(id_col)
    counts = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(ids.isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.trim(ids.cast("string")) == "", F.col("n"))), F.lit(0)).alias("blanks"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dups"),
        count_if(ids.isNotNull()).alias("uniq"),
    )
    name, check = f"{dataset}.{id_col}", "identifier_integrity"
    return findings_of(one, [
        finding(check, CRITICAL, dataset, id_col, text(f"{name}: ", F.col("nulls"), " null values"),
                F.col("nulls") > 0, null_count=F.col("nulls")),
        finding(check, CRITICAL, dataset, id_col, text(f"{name}: ", F.col("blanks"), " blank/whitespace values"),
                F.col("blanks") > 0, blank_count=F.col("blanks")),
        finding(check, WARNING, dataset, id_col,
                text(f"{name}: ", F.col("dups"), " duplicate values (", F.col("uniq"), " unique out of ", F.col("rows"), " rows)"),
                F.col("dups") > 0, duplicate_count=F.col("dups"), unique_count=F.col("uniq")),
        finding(check, INFO, dataset, id_col, text(f"{name}: all ", F.col("rows"), " values unique and non-null"),
                F.col("dups") == 0),
    ])


def claimed_sizes(owners: DataFrame, bridge: DataFrame, claimed: str = "ActiveCompanies") -> DataFrame:
    """Owner, claimed member count, linked member count (null when the owner has no link)."""
    linked = bridge.select("LandLordID", "CompanyID").distinct().groupBy("LandLordID").agg(
        F.count("CompanyID").alias("linked")
    )
    return owners.select("LandLordID", F.col(claimed).try_cast("double").alias("claimed")).join(
        linked, "LandLordID", "left"
    )


def check_relationships(owners: DataFrame, bridge: DataFrame, dataset: str = "LandLords", limit: int = 5) -> DataFrame:
    check = "relationship_consistency"
    if "ActiveCompanies" not in owners.columns:
        return absent(owners, check, dataset, "ActiveCompanies",
                      "ActiveCompanies column not found in LandLords — skipping consistency check")
    off = F.abs(F.coalesce(F.col("claimed"), F.lit(0.0)).cast("int") - F.coalesce(F.col("linked"), F.lit(0)))
    sized = claimed_sizes(owners, bridge).withColumn("off", off)
    one = sized.agg(
        count_if(F.col("off") > limit).alias("n"),
        F.coalesce(F.max("off"), F.lit(0)).alias("worst"),
    )
    sample = (
        sized.filter(F.col("off") > limit).orderBy("LandLordID").limit(5)
        .agg(F.concat_ws(",", F.sort_array(F.collect_list("LandLordID"))).alias("ids"))
    )
    one = one.withColumn("ids", sample.scalar())
    return findings_of(one, [
        finding(check, WARNING, dataset, "ActiveCompanies",
                text(F.col("n"), f" landlords have ActiveCompanies count differing from parsed AllCompanyID count by >{limit}"),
                F.col("n") > 0, material=F.col("n"), max_discrepancy=F.col("worst"), sample_landlord_ids=F.col("ids")),
        finding(check, INFO, dataset, "ActiveCompanies",
                "ActiveCompanies counts are consistent with parsed AllCompanyID (within threshold)", F.col("n") == 0),
    ])


def check_dates(df: DataFrame, columns: Sequence[str], dataset: str, reference_date: dt.date) -> DataFrame:
    """Unparseable, future and implausible dates against a given reference date."""
    check = "date_validity"
    ref = F.lit(reference_date)
    present = [c for c in columns if c in df.columns]
    parts = [
        absent(df, check, dataset, c, f"{dataset}.{c}: column not found — skipping") for c in columns if c not in present
    ]
    if not present:
        return reduce(DataFrame.unionByName, parts)
    aggs, rows = [], []
    for i, c in enumerate(present):
        col, kind = F.col(f"`{c}`"), df.schema[c].dataType
        if isinstance(kind, T.StringType):
            parsed = F.to_date(F.try_to_timestamp(col))
        elif isinstance(kind, T.NumericType):
            # A bare number is read as an offset from the epoch, far in the past.
            parsed = F.when(col.isNotNull(), F.lit(dt.date(1970, 1, 1)))
        else:
            parsed = F.to_date(col)
        year = col.try_cast("double")
        aggs += [
            count_if(col.isNotNull() & parsed.isNull()).alias(f"bad{i}"),
            count_if(parsed > ref).alias(f"future{i}"),
            count_if((year < 1800) | (year > reference_date.year)).alias(f"odd{i}"),
        ]
        bad, future, odd = F.col(f"bad{i}"), F.col(f"future{i}"), F.col(f"odd{i}")
        rows += [
            finding(check, WARNING, dataset, c, text(f"{dataset}.{c}: ", bad, " values could not be parsed as dates"),
                    bad > 0, parse_failures=bad),
            finding(check, WARNING, dataset, c,
                    text(f"{dataset}.{c}: ", future, f" future dates (after {reference_date})"), future > 0, future_count=future),
        ]
        if c == "YearFounded":
            rows.append(finding(
                check, WARNING, dataset, c,
                text(f"{dataset}.YearFounded: ", odd, " implausible year values (<1800 or >current year)"),
                odd > 0, bad_count=odd))
        rows.append(finding(
            check, INFO, dataset, c, f"{dataset}.{c}: all non-null values parse correctly and are non-future",
            (bad == 0) & (future == 0)))
    return reduce(DataFrame.unionByName, [findings_of(df.agg(*aggs), rows), *parts])


def check_ranges(df: DataFrame, columns: Sequence[str], dataset: str) -> DataFrame:
    """Negative values per column, and zero or missing denominators."""
    aggs, rows = [], []
    for i, c in enumerate(c for c in columns if c in df.columns):
        v = F.col(f"`{c}`").try_cast("double")
        aggs += [count_if(v < 0).alias(f"neg{i}"), F.round(F.min(v), 4).alias(f"min{i}")]
        rows.append(finding(
            "range_check", WARNING, dataset, c, text(f"{dataset}.{c}: ", F.col(f"neg{i}"), " negative values"),
            F.col(f"neg{i}") > 0, negative_count=F.col(f"neg{i}"), min_value=F.col(f"min{i}")))
    for i, c in enumerate(c for c in DENOMINATORS if c in df.columns):
        v = F.col(f"`{c}`").try_cast("double")
        aggs.append(count_if(v.isNull() | (v == 0)).alias(f"gap{i}"))
        rows.append(finding(
            "denominator_guard", INFO, dataset, c,
            text(f"{dataset}.{c}: ", F.col(f"gap{i}"),
                 " zero/null values — safe-division (epsilon) applied during feature engineering"),
            F.col(f"gap{i}") > 0, zero_null_count=F.col(f"gap{i}")))
    return findings_of(df.agg(*aggs), rows) if aggs else findings_of(df, [])


def percent1(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100.0)


def check_window_nesting(df: DataFrame, dataset: str = "Companies", limit: float = 0.05) -> DataFrame:
    """Short-window counts above long-window counts, per window pair."""
    aggs, rows = [], []
    pairs = [p for p in WINDOW_PAIRS if p[0] in df.columns and p[1] in df.columns]
    for i, (short, long_, label) in enumerate(pairs):
        a, b = F.col(short).try_cast("double"), F.col(long_).try_cast("double")
        aggs += [count_if(a > b).alias(f"v{i}"), count_if(a.isNotNull() & b.isNotNull()).alias(f"t{i}")]
        v, t = F.col(f"v{i}"), F.col(f"t{i}")
        rate = F.coalesce(F.try_divide(v, t), F.lit(0.0))
        rows.append(finding(
            "time_window_consistency", F.when(rate > limit, F.lit(WARNING)).otherwise(F.lit(INFO)), dataset, short,
            text(f"{label}: ", v, "/", t, " rows (", percent1(rate), f") have {short} > {long_}"),
            None, violations=v, total_valid=t, violation_pct=F.round(rate, 4)))
    return findings_of(df.agg(*aggs), rows) if pairs else findings_of(df, [])


def check_categories(df: DataFrame, columns: Sequence[str], dataset: str, rare: float = 0.01) -> DataFrame:
    """Blank strings, casing or space variants, and rare values. All columns share one value count."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return findings_of(df, [])
    counts = value_counts(df, present).filter(F.col("value").isNotNull())
    per = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.trim("value") == "", F.col("n"))), F.lit(0)).alias("blank"),
        F.count(F.lit(1)).alias("raw_unique"),
    )
    folded = counts.groupBy("column", F.lower(F.trim("value")).alias("v")).agg(F.lit(1).alias("one"))
    folded = folded.groupBy("column").agg(F.count(F.lit(1)).alias("lower_unique"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    trimmed = counts.groupBy("column", F.trim("value").alias("v")).agg(F.sum("n").alias("n"))
    # One row per checked column on the broadcast side.
    seldom = trimmed.join(totals, "column").filter(F.col("n") / F.col("total") < rare)
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "v")
    named = seldom.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= 5).groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rank", "v"))), lambda x: x["v"]).alias("examples")
    )
    rare_n = seldom.groupBy("column").agg(F.count(F.lit(1)).alias("rare_n"))
    wide = per
    for other in (folded, rare_n, named):
        wide = wide.join(other, "column", "left")
    name = text(f"{dataset}.", F.col("column"))
    base = dict(check="category_quality", dataset=dataset)

    def row(severity: str, message: Column, when: Column, **detail: Column) -> Column:
        made = finding(base["check"], severity, dataset, None, message, None, **detail)
        return F.when(when, made.withField("column", F.col("column")))

    extra = F.col("raw_unique") - F.col("lower_unique")
    return wide.select(F.inline(F.array_compact(F.array(
        row(WARNING, text(name, ": ", F.col("blank"), " blank/whitespace strings (should be NaN, not empty string)"),
            F.col("blank") > 0, blank_count=F.col("blank")),
        row(WARNING, text(name, ": ", extra, " extra unique values due to casing/whitespace (e.g. 'Active' vs 'active')"),
            extra > 0, raw_unique=F.col("raw_unique"), normalised_unique=F.col("lower_unique")),
        row(INFO, text(name, ": ", F.col("rare_n"),
                       f" rare categories (each <{rare:.0%} of non-null values) — consider grouping as 'Other'"),
            F.coalesce(F.col("rare_n") > 0, F.lit(False)),
            rare_category_count=F.col("rare_n"), examples=F.concat_ws(",", F.col("examples"))),
    ))))


def check_snapshot_structure(df: DataFrame, id_col: str, dataset: str) -> DataFrame:
    if id_col not in df.columns:
        return findings_of(df, [])
    counts = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(count_if(F.col("n") > 1).alias("dup"), F.count(F.lit(1)).alias("total"))
    dup, total = F.col("dup"), F.col("total")
    return findings_of(one, [
        finding("snapshot_structure", INFO, dataset, id_col,
                f"{dataset}: one row per {id_col} — cross-sectional dataset (no time series splits needed)",
                dup == 0, total_entities=total),
        finding("snapshot_structure", WARNING, dataset, id_col,
                text(f"{dataset}: ", dup, "/", total, f" {id_col} values appear in multiple rows — "
                     "dataset may have historical snapshots; use time-based splitting"),
                dup > 0, duplicate_id_count=dup, total_id_count=total),
    ])


def check_coverage(bridge: DataFrame, companies: DataFrame, dataset: str = "Bridge") -> DataFrame:
    ids = bridge.select(F.col("CompanyID").cast("string").alias("CompanyID")).distinct()
    known = companies.select(F.col("CompanyID").cast("string").alias("CompanyID"), F.lit(1).alias("hit")).distinct()
    joined = ids.join(known, "CompanyID", "left")
    one = joined.agg(count_if(F.col("hit").isNull()).alias("missing"), F.count(F.lit(1)).alias("total"))
    first = joined.filter(F.col("hit").isNull()).orderBy("CompanyID").limit(5).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("CompanyID"))).alias("ids")
    )
    one = one.withColumn("ids", first.scalar())
    rate = F.coalesce(F.try_divide(F.col("missing"), F.col("total")), F.lit(0.0))
    severity = F.when(rate > 0.20, F.lit(CRITICAL)).when(rate > 0.05, F.lit(WARNING)).otherwise(F.lit(INFO))
    return findings_of(one, [finding(
        "bridge_coverage", severity, dataset, "CompanyID",
        text(F.col("missing"), "/", F.col("total"), " unique CompanyIDs in bridge not found in Companies (",
             percent1(rate), " unmatched)"),
        None, missing_count=F.col("missing"), total_bridge_ids=F.col("total"), missing_pct=F.round(rate, 4),
        sample_missing=F.col("ids"))])


def check_missing(df: DataFrame, dataset: str, critical: float = 0.50, warning: float = 0.20) -> DataFrame:
    """Null rates per column in two severities; the column list is bounded by the schema."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[
        count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)
    ])
    rates = F.array(*[
        F.struct(F.coalesce(F.try_divide(F.col(f"_{i}"), F.col("_n")), F.lit(0.0)).alias("rate"), F.lit(c).alias("c"))
        for i, c in enumerate(df.columns)
    ])
    one = one.select(rates.alias("r"))
    high = F.filter("r", lambda x: x["rate"] >= critical)
    medium = F.filter("r", lambda x: (x["rate"] >= warning) & (x["rate"] < critical))
    listed = lambda xs: F.concat_ws(
        ",", F.transform(F.reverse(F.array_sort(xs)), lambda x: F.concat(x["c"], F.lit("="), percent1(x["rate"])))
    )
    return findings_of(one, [
        finding("missing_rates", CRITICAL, dataset, None,
                text(f"{dataset}: ", F.size(high), f" columns with >={critical:.0%} missing values"),
                F.size(high) > 0, columns=listed(high)),
        finding("missing_rates", WARNING, dataset, None,
                text(f"{dataset}: ", F.size(medium), f" columns with {warning:.0%}–{critical:.0%} missing values"),
                F.size(medium) > 0, columns=listed(medium)),
        finding("missing_rates", INFO, dataset, None, f"{dataset}: all columns below {warning:.0%} missing threshold",
                (F.size(high) == 0) & (F.size(medium) == 0)),
    ])


def has_critical(findings: DataFrame) -> bool:
    return not findings.filter(F.col("severity") == CRITICAL).limit(1).isEmpty()


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def validate_all(
    landlords: DataFrame, companies: DataFrame, bridge: DataFrame, reference_date: dt.date, strict: bool = False
) -> DataFrame:
    """All nine checks on both tables; strict mode raises on a critical finding."""
    parts = [
        check_identifiers(landlords, "LandLordID", "LandLords"),
        check_identifiers(companies, "CompanyID", "Companies"),
        check_relationships(landlords, bridge),
        check_dates(landlords, ("LastUpdated", "YearFounded"), "LandLords", reference_date),
        check_dates(companies, ("YearFounded", "LastUpdated"), "Companies", reference_date),
        check_ranges(landlords, NON_NEGATIVE["landlords"], "LandLords"),
        check_ranges(companies, NON_NEGATIVE["companies"], "Companies"),
        check_window_nesting(companies),
        check_categories(landlords, CATEGORICAL["landlords"], "LandLords"),
        check_categories(companies, CATEGORICAL["companies"], "Companies"),
        check_snapshot_structure(landlords, "LandLordID", "LandLords"),
        check_snapshot_structure(companies, "CompanyID", "Companies"),
        check_coverage(bridge, companies),
        check_missing(landlords, "LandLords"),
        check_missing(companies, "Companies"),
    ]
    out = reduce(DataFrame.unionByName, parts)
    if strict:
        bad = out.filter(F.col("severity") == CRITICAL).select("message").limit(20).collect()
        if bad:
            raise ValueError("critical data-quality findings:\n" + "\n".join(row[0] for row in bad))
    return out


def invoice_findings(profile: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Threshold findings from the one-row invoice profile (and the one-row event profile)."""
    c = F.col
    rates = [c(n) for n in ("null_customer_rate", "null_date_rate", "null_amount_rate", "non_positive_amount_rate")]
    clean = F.greatest(*rates) < 1e-6
    f = lambda area, sev, msg, when=None: finding(area, sev, "invoices", None, msg, when)
    rows = [
        f("missingness", "info",
          "No nulls or non-positive amounts in customerid/date/amount — imputation is unnecessary; "
          "the real missing field is billing interval.", clean),
        f("missingness", "warn",
          text("Null/non-positive rates: customer=", rates[0], ", date=", rates[1], ", amount=", rates[2],
               ", non_pos=", rates[3], "."), ~clean),
        f("same_day_aggregation", F.when(c("multi_invoice_day_rate") > 0.05, F.lit("critical")).otherwise(F.lit("info")),
          text(percent1(c("multi_invoice_day_rate")), " of customer-days have >1 invoice (max ",
               c("max_invoices_on_one_day"),
               " on one day) — same-day aggregation is required before gap/interval logic.")),
        f("history_depth", F.when(c("share_single_invoice") > 0.4, F.lit("critical")).otherwise(F.lit("info")),
          text(percent1(c("share_single_invoice")), " of customers have a single invoice (max ", c("invoices_max"),
               ") — split insufficient_history vs one_time_candidate; do not blanket one_time.")),
        f("amount_skew", "warn",
          text("Amounts are right-skewed (max=", c("amount_max"),
               ") — use log1p / robust summaries for monetary features."),
          c("amount_mean") > 3 * c("amount_p50")),
        f("modeling_implication", "info",
          "Validate inferred intervals indirectly via temporally held-out ablation on dollar-churn "
          "(no ground-truth interval column exists)."),
    ]
    out = findings_of(profile, rows)
    if events is None:
        return out
    more = [
        f("gap_shape", "info",
          text("Inter-event gaps: n=", c("n_gaps"), ", p50=", c("gap_p50"), "d, p75=", c("gap_p75"), "d, p90=",
               c("gap_p90"), "d — match to calendar multiples (30/91/182/365) allowing skipped periods.")),
        f("recurring_share", "info",
          text("After aggregation, ", percent1(c("share_recurring")),
               " of customers have >=2 billing events (interval inference has a gap signal); ",
               percent1(c("share_single_event")), " remain single-event.")),
    ]
    return out.unionByName(findings_of(events, more))


def portfolio_findings(
    landlords: DataFrame, companies: DataFrame, coverage: DataFrame, claims: DataFrame,
    landlord_limit: float = 20.0, company_limit: float = 40.0,
) -> DataFrame:
    """Threshold findings for the two-table project from its summary rows."""
    c = F.col
    match = c("match_rate_bridge_pct")
    parts = [findings_of(coverage, [
        finding("Bridge coverage",
                F.when(match < 50, F.lit(CRITICAL)).when(match < 95, F.lit(WARNING)).otherwise(F.lit(INFO)),
                "bridge", "CompanyID",
                text(match, "% of bridge CompanyIDs match Companies (", c("overlap"), "/", c("companies_in_bridge"), ")")),
    ])]
    exact = c("exact_match_pct")
    parts.append(findings_of(claims, [
        finding("ActiveCompanies consistency", F.when(exact < 95, F.lit(WARNING)).otherwise(F.lit(INFO)),
                "landlords", "ActiveCompanies",
                text("ActiveCompanies matches parsed AllCompanyID count for ", exact, "% of landlords.")),
    ]))
    for df, name, limit in ((landlords, "Landlords", landlord_limit), (companies, "Companies", company_limit)):
        wide = null_rates(df).agg(count_if(c("null_pct") >= limit).alias("n"))
        parts.append(findings_of(wide, [finding(
            f"{name} missingness", WARNING, name, None,
            text(c("n"), f" columns have >={limit:.0f}% null."), c("n") > 0)]))
    status = companies.agg(
        (F.avg(F.when(c("CompanyStatus").isNull(), 1.0).otherwise(0.0)) * 100).alias("null_pct"),
        (F.avg(F.when(c("CompanyStatus") == "None", 1.0).otherwise(0.0)) * 100).alias("none_pct"),
        *[
            (F.avg(F.when(F.col(s) == 0, 1.0).otherwise(0.0)) * 100).alias(f"zero_{s}")
            for s in ("SalesOfMainProduct", "SalesOfOtherProduct") if s in companies.columns
        ],
    )
    rows = [finding(
        "CompanyStatus label quality", WARNING, "Companies", "CompanyStatus",
        text("CompanyStatus is sparse/ambiguous (null~=", F.format_string("%.1f", c("null_pct")), "%, literal 'None'~=",
             F.format_string("%.1f", c("none_pct")), "%). Binary good/bad mapping will be noisy."),
        c("null_pct") + c("none_pct") > 30)]
    for s in ("SalesOfMainProduct", "SalesOfOtherProduct"):
        if s in companies.columns:
            rows.append(finding(
                "Zero-inflated sales", INFO, "Companies", s,
                text(f"{s} is ", F.format_string("%.1f", c(f"zero_{s}")), "% zeros - consider log1p / tree models."),
                c(f"zero_{s}") >= 50))
    parts.append(findings_of(status, rows))
    return reduce(DataFrame.unionByName, parts)


def company_findings(companies: DataFrame, impact: DataFrame, limit: float = 40.0) -> DataFrame:
    """Threshold findings for the credit table: missingness, hard stops, utilisation cuts."""
    c = F.col
    wide = null_rates(companies).agg(count_if(c("null_pct") >= limit).alias("n"))
    parts = [findings_of(wide, [finding(
        "missingness", WARNING, "companies", None,
        text(c("n"), f" columns have >={limit:.0f}% null. Lower confidence and Review rates will be common."),
        c("n") > 0)])]
    row = F.struct(
        F.lit("cut_impact").alias("check"), F.lit(INFO).alias("severity"), F.lit("companies").alias("dataset"),
        F.lit(None).cast("string").alias("column"),
        text(c("metric"), ": ", c("n"), " (", F.format_string("%.2f", c("pct")), "%)").alias("message"),
        F.create_map(F.lit("n"), c("n").cast("string")).alias("detail"),
    )
    parts.append(impact.select(F.inline(F.array(row))))
    return reduce(DataFrame.unionByName, parts)

