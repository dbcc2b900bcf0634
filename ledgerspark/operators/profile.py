"""Profiles of tables: single-pass aggregates, long-form column profiles, exact or approximate quantiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.hashing import order_key
from ledgerspark.functions.numeric import TINY, count_if, nan_to_null, pct
from ledgerspark.operators.ordering import first_by_hash, slice_in_order
from ledgerspark.operators.quantiles import wide_quantiles
from ledgerspark.operators.ranking import exact_quantiles, quantiles_of_counts, running_totals



def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def long_form(df: DataFrame, columns: Sequence[str], cast: str, name: str = "column", value: str = "value") -> DataFrame:
    """(column, value) rows by a row-local explode, so only the listed columns are read."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast(cast).alias(value)) for c in columns
    ])))


def wide_to_rows(one: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn a one-row summary into several rows of named fields."""
    return one.select(F.inline(F.array(*[
        F.struct(*[c.alias(k) for k, c in row.items()]) for row in rows
    ])))


def metric_rows(one: DataFrame, section: str, skip: Sequence[str] = ()) -> DataFrame:
    """One-row summary -> (section, metric, value) with numbers as double."""
    return wide_to_rows(one, [
        {"section": F.lit(section), "metric": F.lit(c), "value": F.col(c).cast("double")}
        for c in one.columns if c not in skip
    ])


def identifier_report(df: DataFrame, customer: str = "customerid", account: str = "accountid") -> DataFrame:
    """Distinct customers, accounts and pairs, whether the id alone is a key, and the key to use.

    The pairs are made distinct once; customers and accounts are counted on that smaller table. A
    null member counts as a value of the pair.
    """
    if account not in df.columns:
        one = df.select(customer).distinct().agg(F.count(customer).alias("n_customers"))
        return one.select(
            "n_customers", F.lit(0).cast("bigint").alias("n_accounts"), F.col("n_customers").alias("n_pairs"),
            F.lit(True).alias("customer_id_is_unique"), F.lit(customer).alias("key_columns"),
        )
    pairs = df.select(customer, account).distinct()
    tagged = pairs.select(F.inline(F.array(
        F.struct(F.lit("c").alias("side"), F.col(customer).cast("string").alias("v")),
        F.struct(F.lit("a").alias("side"), F.col(account).cast("string").alias("v")),
    )))
    sides = tagged.groupBy("side", "v").agg(F.count(F.lit(1)).alias("n"))
    one = sides.agg(
        count_if((F.col("side") == "c") & F.col("v").isNotNull()).alias("n_customers"),
        count_if((F.col("side") == "a") & F.col("v").isNotNull()).alias("n_accounts"),
        F.sum(F.when(F.col("side") == "c", F.col("n"))).alias("n_pairs"),
    )
    unique = F.col("n_pairs") == F.col("n_customers")
    return one.withColumns({
        "customer_id_is_unique": unique,
        "key_columns": F.when(unique, F.lit(customer)).otherwise(F.lit(f"{account},{customer}")),
    })


def require_unique_customers(df: DataFrame, customer: str = "customerid", account: str = "accountid") -> DataFrame:
    row = identifier_report(df, customer, account).first()
    if not row["customer_id_is_unique"]:
        raise ValueError(f"{customer!r} is not unique across accounts; use the key ({row['key_columns']})")
    return df


def quality_aggregates(customer: str = "customerid", date: str = "date", amount: str = "amount") -> list[Column]:
    rate = lambda cond: F.coalesce(F.avg(F.when(cond, 1.0).otherwise(0.0)), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("n_rows"),
        rate(F.col(customer).isNull()).alias("null_customer_rate"),
        rate(F.col(date).isNull()).alias("null_date_rate"),
        rate(F.col(amount).isNull()).alias("null_amount_rate"),
        rate(F.col(amount) <= 0).alias("non_positive_amount_rate"),
        F.min(date).alias("date_min"),
        F.max(date).alias("date_max"),
    ]


def quality_report(df: DataFrame, **names: str) -> DataFrame:
    return df.agg(*quality_aggregates(**names))


def observe_quality(df: DataFrame, name: str = "invoice_quality", **names: str):
    """The same numbers as a by-product of whatever job reads df. Returns (df, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *quality_aggregates(**names)), seen


def _quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], exact: bool, accuracy: int = 10000
) -> DataFrame:
    if exact:
        return exact_quantiles(df, value, probs).drop("n_valid")
    got = F.percentile_approx(value, list(probs.values()), accuracy)
    one = df.agg(got.alias("_q"))
    return one.select(*[F.col("_q")[i].cast("double").alias(name) for i, name in enumerate(probs)])


def side_by_side(*ones: DataFrame) -> DataFrame:
    """One-row summaries next to each other, as scalar subqueries of the first."""
    base = ones[0]
    extra = {}
    for one in ones[1:]:
        packed = one.select(F.struct(*one.columns).alias("s")).scalar()
        extra |= {c: packed[c] for c in one.columns}
    return base.withColumns(extra)


def profile_invoices(
    df: DataFrame, customer: str = "customerid", date: str = "date", amount: str = "amount", exact: bool = False
) -> DataFrame:
    """One row: quality, amount distribution, same-day repeats, invoices per customer."""
    base = df.agg(
        *quality_aggregates(customer, date, amount),
        F.min(amount).alias("amount_min"), F.avg(amount).alias("amount_mean"), F.max(amount).alias("amount_max"),
    )
    amounts = _quantiles(
        df, amount, {"amount_p50": 0.5, "amount_p75": 0.75, "amount_p95": 0.95, "amount_p99": 0.99}, exact
    )
    days = df.groupBy(customer, F.to_date(date).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    same_day = days.agg(
        F.count(F.lit(1)).alias("n_customer_days"),
        F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias("multi_invoice_day_rate"),
        count_if(F.col("n") > 1).alias("n_multi_invoice_days"),
        F.max("n").alias("max_invoices_on_one_day"),
    )
    per_customer = df.groupBy(customer).agg(F.count(F.lit(1)).alias("n"))
    depth = per_customer.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("share_single_invoice"),
        F.avg("n").alias("invoices_mean"), F.max("n").alias("invoices_max"),
    )
    depth_q = _quantiles(
        per_customer, "n", {"invoices_p50": 0.5, "invoices_p75": 0.75, "invoices_p95": 0.95}, exact
    )
    return side_by_side(base, amounts, same_day, depth, depth_q)


def profile_events(
    events: DataFrame, gaps: DataFrame, customer: str = "customerid", exact: bool = False
) -> DataFrame:
    """One row: event totals, events per customer, gap distribution, share of lines folded away."""
    base = events.agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("event_amount").alias("event_amount_mean"),
        F.max("event_amount").alias("event_amount_max"), F.avg("n_invoices").alias("mean_invoices_per_event"),
        (F.lit(1.0) - F.count(F.lit(1)) / F.sum("n_invoices")).alias("same_day_collapse_ratio"),
    )
    amount_q = _quantiles(events, "event_amount", {"event_amount_p50": 0.5}, exact)
    per = events.groupBy(customer).agg(F.count(F.lit(1)).alias("n"))
    depth = per.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("share_single_event"),
        F.avg(F.when(F.col("n") >= 2, 1.0).otherwise(0.0)).alias("share_recurring"),
        F.max("n").alias("events_max"),
    )
    depth_q = _quantiles(per, "n", {"events_p50": 0.5, "events_p75": 0.75, "events_p95": 0.95}, exact)
    # Whole-day gaps: group first, then every gap statistic comes from the small table of lengths.
    lengths = running_totals(gaps, "gap_days", {"cnt": F.col("times")})
    total = F.sum("cnt")
    gap_q = quantiles_of_counts(
        lengths, "gap_days", {"gap_p25": 0.25, "gap_p50": 0.5, "gap_p75": 0.75, "gap_p90": 0.9},
        extra=[(F.sum(F.col("cnt") * F.col("gap_days")) / total).alias("gap_mean")],
    ).withColumnRenamed("n_valid", "n_gaps")
    return side_by_side(base, amount_q, depth, depth_q, gap_q)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for all listed columns in one shuffle of pre-counted pairs."""
    return long_form(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count, null percent, distinct values, most frequent value.

    Arrays and structs are profiled by their JSON text.
    """
    nested = (T.ArrayType, T.StructType, T.MapType)
    plain = df.select(*[
        (F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields
    ])
    kinds = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    counts = value_counts(plain, df.columns)
    known = F.col("value").isNotNull()
    # Highest count first, the smallest text among equals.
    top = counts.groupBy("column").agg(F.max(F.when(known, F.col("n"))).alias("top_n"))
    named = counts.join(top, "column")
    return named.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"),
        F.sum("n").alias("_all"),
        count_if(known).alias("n_unique"),
        F.min(F.when(known & (F.col("n") == F.col("top_n")), F.col("value"))).alias("top_value"),
    ).select(
        "column",
        F.element_at(kinds, F.col("column")).alias("dtype"),
        "non_null",
        F.round((F.col("_all") - F.col("non_null")) * 100.0 / F.col("_all"), 2).alias("null_pct"),
        "n_unique",
        F.coalesce("top_value", F.lit("")).alias("top_value"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, std, min, exact quartiles, max, sample skew and excess kurtosis.

    Two reads: the moments come with the brackets of the quartiles, then values inside the brackets are counted.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    aggs, out = [], []
    for i, c in enumerate(cols):
        v = nan_to_null(F.col(f"`{c}`").cast("double"))
        parts = {
            "n": F.count(v), "m": F.avg(v), "sd": F.stddev_samp(v), "lo": F.min(v), "hi": F.max(v), "vp": F.var_pop(v),
            "sk": F.skewness(v), "ku": F.kurtosis(v),
        }
        aggs += [expr.alias(f"{k}{i}") for k, expr in parts.items()]
        g = lambda k, i=i: F.col(f"{k}{i}")
        n = g("n").cast("double")
        out.append({
            "column": F.lit(c), "count": g("n"), "mean": g("m"), "std": g("sd"), "min": g("lo"), "max": g("hi"),
            "skew": F.when((n > 2) & (g("vp") > 0), g("sk") * F.sqrt(n * (n - 1)) / (n - 2)),
            "kurtosis": F.when((n > 3) & (g("vp") > 0), ((n + 1) * g("ku") + 6) * (n - 1) / ((n - 2) * (n - 3))),
        })
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found, moments = wide_quantiles(df, cols, shares, aggs)
    kinds = {name: "bigint" if name.startswith("n") else "double" for name in (f"{k}{i}" for i in range(len(cols)) for k in parts)} if cols else {}
    one = df.sparkSession.createDataFrame([tuple(moments[name] for name in kinds)], ", ".join(f"{n} {k}" for n, k in kinds.items()))
    # One row per column on both sides.
    return wide_to_rows(one, out).join(found.select("column", *shares), "column", "left")


def category_summary(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10) -> DataFrame:
    """Most frequent values per column, null included, with count and percent.

    The rank filter is pushed below the shuffle (window group limit), so each map task sends at most
    top_n rows per column.
    """
    cols = list(columns) if columns is not None else text_columns(df)
    counts = value_counts(df, [c for c in cols if c in df.columns])
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        counts.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top_n)
        .select("column", "value", F.col("n").alias("count"), F.round(F.col("n") * 100.0 / total, 2).alias("pct"))
    )


SIZE_BUCKETS = (
    ("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4", 4, 4), ("5-9", 5, 9), ("10-19", 10, 19),
    ("20-49", 20, 49), ("50-99", 50, 99), ("100+", 100, None),
)


def portfolio_sizes(bridge: DataFrame, owner: str = "LandLordID", member: str = "CompanyID") -> DataFrame:
    return bridge.select(owner, member).distinct().groupBy(owner).agg(F.count(member).alias("n_companies"))


def portfolio_size_stats(bridge: DataFrame, owner: str = "LandLordID", member: str = "CompanyID") -> DataFrame:
    """One row: describe of the sizes, singles and totals."""
    sizes = portfolio_sizes(bridge, owner, member)
    base = sizes.agg(
        F.count(F.lit(1)).alias("total_owners"), F.sum("n_companies").alias("distinct_links"),
        F.avg("n_companies").alias("size_mean"), F.stddev_samp("n_companies").alias("size_std"),
        F.min("n_companies").alias("size_min"), F.max("n_companies").alias("size_max"),
        count_if(F.col("n_companies") == 1).alias("single_member_owners"),
    )
    quart = exact_quantiles(sizes, "n_companies", {"size_p25": 0.25, "size_p50": 0.5, "size_p75": 0.75}).drop("n_valid")
    links = bridge.agg(F.count(F.lit(1)).alias("total_links"))
    members = bridge.select(member).distinct().agg(F.count(member).alias("unique_members"))
    return side_by_side(base, quart, links, members)


def size_buckets(bridge: DataFrame, owner: str = "LandLordID", member: str = "CompanyID") -> DataFrame:
    """Owners per size bucket; empty buckets are listed with 0."""
    n = F.col("n_companies")
    fits = [(name, (n >= low) if high is None else n.between(low, high)) for name, low, high in SIZE_BUCKETS]
    one = portfolio_sizes(bridge, owner, member).agg(*[count_if(cond).alias(f"b{i}") for i, (_, cond) in enumerate(fits)])
    return wide_to_rows(one, [
        {"position": F.lit(i), "bucket": F.lit(name), "owners": F.col(f"b{i}")} for i, (name, _) in enumerate(fits)
    ])


def size_histogram(bridge: DataFrame, owner: str = "LandLordID", member: str = "CompanyID") -> DataFrame:
    return portfolio_sizes(bridge, owner, member).groupBy("n_companies").agg(F.count(F.lit(1)).alias("owners"))


def largest_portfolios(bridge: DataFrame, top: int = 10, owner: str = "LandLordID", member: str = "CompanyID") -> DataFrame:
    return portfolio_sizes(bridge, owner, member).orderBy(F.col("n_companies").desc(), owner).limit(top)


def null_rates(df: DataFrame, threshold_pct: float | None = None) -> DataFrame:
    """Null percent per column, one aggregation; optionally only columns at or above a threshold."""
    def empty(name: str) -> Column:
        c = F.col(f"`{name}`")
        kind = df.schema[name].dataType
        return c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()

    one = df.agg(F.count(F.lit(1)).alias("_n"), *[count_if(empty(c)).alias(f"_{i}") for i, c in enumerate(df.columns)])
    out = wide_to_rows(one, [
        {"column": F.lit(c), "null_count": F.col(f"_{i}"), "null_pct": pct(F.col(f"_{i}"), F.col("_n"))}
        for i, c in enumerate(df.columns)
    ])
    return out if threshold_pct is None else out.filter(F.col("null_pct") >= threshold_pct)


def feature_sparsity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Model columns without any value (absent ones too), portfolio columns flagged."""
    have = [c for c in columns if c in df.columns]
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in have]) if have else df.agg(F.count(F.lit(1)).alias("_"))
    rows = wide_to_rows(one, [
        {
            "feature": F.lit(c),
            "n_values": F.col(f"`{c}`") if c in have else F.lit(0).cast("bigint"),
            "is_portfolio": F.lit(c.startswith("Portfolio")),
        }
        for c in columns
    ])
    return rows.filter(F.col("n_values") == 0)


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 15) -> DataFrame:
    """Absolute Pearson correlation of every column pair over rows where both are known, best first.

    The number of pairs depends on the column count only; one aggregation computes them all.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    pairs = list(combinations(cols, 2))
    num = lambda c: nan_to_null(F.col(f"`{c}`").cast("double"))
    one = df.agg(*[F.corr(num(a), num(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = wide_to_rows(one, [
        {"a": F.lit(a), "b": F.lit(b), "abs_corr": F.round(F.abs(nan_to_null(F.col(f"_{i}"))), 4)}
        for i, (a, b) in enumerate(pairs)
    ]).filter(F.col("abs_corr").isNotNull())
    return rows.orderBy(F.col("abs_corr").desc(), "a", "b").limit(top_n)


def table_shape(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns and duplicate full rows."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "duplicate_rows")


def id_integrity(df: DataFrame, id_col: str, name: str) -> DataFrame:
    counts = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    known = F.col(id_col).isNotNull()
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        count_if(known).alias("n_unique"),
        F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicate"),
    ).select(F.lit(name).alias("name"), F.lit(id_col).alias("id_column"), "n_rows", "n_unique", "n_null", "n_duplicate")


# Utilisation cuts reported by cut_impact.
UTIL_CUTS = (0.10, 0.30, 0.40, 0.50)


def utilisation(main: Column, other: Column, budget: Column) -> Column:
    revenue = F.when(main.isNotNull() | other.isNotNull(), F.coalesce(main, F.lit(0.0)) + F.coalesce(other, F.lit(0.0)))
    return F.when(F.abs(budget) >= TINY, revenue / budget)


def cut_impact(companies: DataFrame, cuts: Sequence[float] = UTIL_CUTS) -> DataFrame:
    """Share of positive-budget companies with utilisation below each cut, plus budget gaps and hard stops."""
    from ledgerspark.operators.credit import normalise_status

    budget = F.col("MonthlyBudget")
    util = utilisation(F.col("SalesMain"), F.col("SalesOther"), budget)
    usable = (budget > 0) & util.isNotNull()
    one = companies.agg(
        count_if(usable).alias("_n"),
        F.count(F.lit(1)).alias("_all"),
        *[count_if(usable & (util < cut)).alias(f"_{i}") for i, cut in enumerate(cuts)],
        count_if(budget.isNull() | (F.abs(budget) < TINY)).alias("_gap"),
        count_if(normalise_status(F.col("CompanyStatus")).isin("inactive", "suspended", "closed")).alias("_stop"),
    )
    rows = [
        {"metric": F.lit(f"below_{cut:.2f}"), "n": F.col(f"_{i}"), "pct": pct(F.col(f"_{i}"), F.col("_n"))}
        for i, cut in enumerate(cuts)
    ]
    rows.append({"metric": F.lit("missing_or_zero_budget"), "n": F.col("_gap"), "pct": pct(F.col("_gap"), F.col("_all"))})
    rows.append({"metric": F.lit("non_active"), "n": F.col("_stop"), "pct": pct(F.col("_stop"), F.col("_all"))})
    return wide_to_rows(one, rows)


def quantile_row(df: DataFrame, value: str) -> DataFrame:
    """count, p25, p50, p75, p90, p95, mean of one column, four decimals."""
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    totals = running_totals(df, value, {"cnt": F.lit(1).cast("bigint")})
    out = quantiles_of_counts(
        totals, value, probs,
        extra=[(F.sum(F.col("cnt") * F.col(value)) / F.sum("cnt")).alias("mean")],
    )
    return out.select(
        F.coalesce(F.col("n_valid"), F.lit(0)).alias("count"), *[F.round(c, 4).alias(c) for c in (*probs, "mean")]
    )


def inspect_list_format(df: DataFrame, column: str = "AllCompanyID", sample: int = 200) -> DataFrame:
    """Cells per storage format among the first non-null ones (a fixed-size look, as asked for)."""
    is_array = isinstance(df.schema[column].dataType, T.ArrayType)
    cell = F.col(column)
    head = df.filter(cell.isNotNull()).select(column)
    head = head.orderBy(order_key(0, cell.cast("string") if not is_array else F.to_json(cell)), column).limit(sample)
    raw = F.trim(F.col(column).cast("string")) if not is_array else F.lit("")
    as_list = raw.startswith("[")
    python = as_list & raw.contains("'") & ~F.substring(raw, 1, 3).contains('"')
    zero = F.lit(False)
    return head.agg(
        F.count(F.lit(1)).alias("of_first_n"),
        count_if(F.lit(is_array)).alias("already_list"),
        count_if(zero if is_array else python).alias("looks_like_python_list"),
        count_if(zero if is_array else (as_list & ~python)).alias("looks_like_json"),
        count_if(zero if is_array else (~as_list & raw.contains(","))).alias("looks_like_csv"),
    )


def uniform_sample(df: DataFrame, id_col: str, n: int, seed: int = 42, forced: DataFrame | None = None) -> DataFrame:
    """n rows in md5 order of the id, the forced ids always among them. Only the group of the n-th row is sorted."""
    if forced is None:
        return first_by_hash(df, order_key(seed, F.col(id_col)), n, ties=[id_col])
    keys = forced.select(F.col(id_col)).distinct()
    must = df.join(keys, id_col, "left_semi")
    # The forced list belongs to a sample of n rows, so its size is of that order.
    left = max(0, n - must.count())
    rest = df.join(keys, id_col, "left_anti")
    return must.unionByName(first_by_hash(rest, order_key(seed, F.col(id_col)), left, ties=[id_col]))


def stratified_sample(df: DataFrame, id_col: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """max(1, n // strata) rows per stratum in md5 order, at most n overall."""
    known = df.filter(F.col(stratum).isNotNull())
    strata = known.select(stratum).distinct().count()
    per = max(1, n // strata) if strata else n
    picked = first_by_hash(known, order_key(seed, F.col(id_col)), per, [stratum], [id_col])
    if strata <= n:
        return picked
    # More strata than rows asked for: one row of each of the first n strata.
    return slice_in_order(picked, [stratum, id_col], 0, n)[0]


def retention(returning: Column, todays: Column) -> Column:
    return F.when(F.abs(todays) >= TINY, returning / todays)
