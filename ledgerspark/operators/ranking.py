"""Global ranks, running totals and exact quantiles without a single-task sort.

Everything rests on one table: the distinct values of a column with their row counts and sums.
Duplicates collapse on the map side, so a value that holds a third of all rows is one row here. The
distinct values are cut into as many ranges of bounded size as the row count asks for; each range is summed on
its own, and the range totals are added up and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.hashing import order_key
from ledgerspark.functions.numeric import clip, nan_to_null

ROWS_PER_RANGE = 1_000_000
MIN_TIE_DIGITS = 3


def range_bounds(
    df: DataFrame, value: str, keys: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE
) -> dict[tuple, list[float]]:
    """Cut points per key so that a range holds about rows_per_range rows. Empty = one range is enough.

    A counting job, and a second one for the cut points only if some key needs more than one range; one number per
    range comes back (keys are column or model names here, never data-sized). The jobs run when the function is called,
    so an expensive df is best materialised before.
    """
    grouped = lambda *aggs: df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    sizes = {tuple(r[k] for k in keys): r["n"] for r in grouped(F.count(value).alias("n")).collect()}
    parts = {key: -(-n // rows_per_range) for key, n in sizes.items()}
    most = max(parts.values(), default=0)
    if most <= 1:
        return {}
    shares = [i / most for i in range(1, most)]
    stats = grouped(F.percentile_approx(value, shares, max(10_000, 10 * most)).alias("q")).collect()
    out: dict[tuple, list[float]] = {}
    for row in stats:
        key = tuple(row[k] for k in keys)
        if parts[key] > 1:
            out[key] = sorted({float(row["q"][max(0, i * most // parts[key] - 1)]) for i in range(1, parts[key])})
    return out


def _range_of(value: Column, keys: Sequence[str], bounds: dict[tuple, list[float]]) -> Column:
    """Range number of a value, by binary search over the cut points of its key."""
    names = {tuple(str(x) for x in k): np.asarray(v) for k, v in bounds.items()}
    if not keys:
        cuts = names[()]

        @F.pandas_udf("int")
        def locate(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, v.to_numpy(dtype=float), side="right").astype("int32"))

        return locate(value)

    @F.pandas_udf("int")
    def locate_keyed(v: pd.Series, key: pd.Series) -> pd.Series:
        out = np.zeros(len(v), dtype="int32")
        nums = v.to_numpy(dtype=float)
        for name, rows in key.groupby(key).groups.items():
            cuts = names.get(tuple(str(name).split("\x1f")))
            if cuts is not None:
                out[rows] = np.searchsorted(cuts, nums[rows], side="right")
        return pd.Series(out)

    return locate_keyed(value, F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]))


def running_totals(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    then: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per (keys, value, then) with each sum, its running total upward and its grand total.

    For a sum named s the columns are s, cum_s (this value included) and tot_s. Rows with a null
    value are left out.
    """
    keys, then = list(keys), list(then)
    df = df.filter(F.col(value).isNotNull())
    bounds = range_bounds(df, value, keys, rows_per_range)
    table = df.groupBy(*keys, value, *then).agg(*[F.sum(e).alias(s) for s, e in sums.items()])
    up = [F.col(value), *[F.col(c) for c in then]]
    if not bounds:
        # All distinct values of a key fit one range.
        part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        run = part.orderBy(*up).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return table.withColumns({f"cum_{s}": F.sum(s).over(run) for s in sums}).withColumns(
            {f"tot_{s}": F.sum(s).over(part) for s in sums}
        )
    table = table.withColumn("_range", _range_of(F.col(value), keys, bounds))
    run = Window.partitionBy(*keys, "_range").orderBy(*up).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    per_range = table.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_r_{s}") for s in sums])
    below = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_range")
    before = below.rowsBetween(Window.unboundedPreceding, -1)
    whole = below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_range.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_r_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_r_{s}").over(whole).alias(f"tot_{s}") for s in sums],
    )
    # No hint: one row per key and range, which Spark broadcasts only while its measured size allows.
    return (
        table.join(offsets, [*keys, "_range"])
        .withColumns({f"cum_{s}": F.col(f"_o_{s}") + F.sum(s).over(run) for s in sums})
        .drop("_range", *[f"_o_{s}" for s in sums])
    )


def average_ranks(
    df: DataFrame, value: str, keys: Sequence[str] = (), weight: Column | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """(keys, value) -> avg_rank (ties share the mean rank), n_valid.

    weight counts a row several times, for input that was grouped beforehand.
    """
    counts = {"cnt": F.lit(1).cast("bigint") if weight is None else weight}
    totals = running_totals(df, value, counts, keys, rows_per_range=rows_per_range)
    return totals.select(
        *keys,
        value,
        (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / F.lit(2.0)).alias("avg_rank"),
        F.col("tot_cnt").alias("n_valid"),
    )


def with_average_rank(
    df: DataFrame, value: str, out: str, keys: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Rows with the average rank of their value; null values get no rank.

    A value shared by very many rows makes one side of the join skewed; the rank side has one row per
    value, so AQE can split the row side freely.
    """
    ranks = average_ranks(df, value, keys, rows_per_range=rows_per_range).select(
        *keys, value, F.col("avg_rank").alias(out), F.col("n_valid").alias(f"{out}_n")
    )
    return df.join(ranks, [*keys, value], "left").select(*df.columns, out, f"{out}_n")


def rank_normalize(
    df: DataFrame, value: str, out: str, keys: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(average rank - 1) / (n - 1); a single valid row gets 0.5, nulls stay null."""
    ranked = with_average_rank(df, value, "_rank", keys, rows_per_range)
    share = F.when(F.col("_rank_n") == 1, F.lit(0.5)).otherwise(
        F.try_divide(F.col("_rank") - 1, (F.col("_rank_n") - 1).cast("double"))
    )
    return ranked.withColumn(out, F.when(F.col(value).isNotNull(), share)).drop("_rank", "_rank_n")


def dense_rank_desc(
    df: DataFrame, value: str, out: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """1 = highest value, ties share, rows without a value share the last place."""
    levels = df.select(value).filter(F.col(value).isNotNull()).distinct()
    totals = running_totals(levels, value, {"one": F.lit(1).cast("bigint")}, rows_per_range=rows_per_range)
    ranks = totals.select(value, (F.col("tot_one") - F.col("cum_one") + 1).alias(out))
    last = totals.agg((F.coalesce(F.max("tot_one"), F.lit(0)) + 1).alias("n")).scalar()
    return df.join(ranks, value, "left").withColumn(out, F.coalesce(F.col(out), last)).select(*df.columns, out)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, from running counts (no per-group value map)."""
    totals = running_totals(df, value, {"cnt": F.lit(1).cast("bigint")}, keys, rows_per_range=rows_per_range)
    return quantiles_of_counts(totals, value, probs, keys)


def quantiles_of_counts(
    totals: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    v = F.col(value).cast("double")
    first, last, size = F.col("cum_cnt") - F.col("cnt"), F.col("cum_cnt") - 1, F.col("tot_cnt")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (size - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((first <= at) & (at <= last), v)).alias(f"_{name}_{tag}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_w"))
    grouped = totals.groupBy(*keys) if keys else totals.groupBy()
    picked = grouped.agg(F.max("tot_cnt").alias("n_valid"), *aggs, *extra)
    out = {
        name: F.col(f"_{name}_lo") + F.col(f"_{name}_w") * (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
        for name in probs
    }
    spare = [f"_{name}_{tag}" for name in probs for tag in ("lo", "hi", "w")]
    return picked.withColumns(out).drop(*spare)


def global_positions(
    df: DataFrame,
    value: str,
    id_col: str,
    out: str = "position",
    descending: bool = True,
    keys: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Row number 1..n by value, ties in md5(id) order, plus n_rows.

    Ties are split by the leading hex digits of md5(id), so even one value shared by a third of the
    rows spreads over even groups of bounded size before any row is numbered.
    """
    rows, digits = df.count(), MIN_TIE_DIGITS
    while 16**digits * rows_per_range < rows:
        digits += 1
    tagged = df.filter(F.col(value).isNotNull()).withColumn("_md5", F.md5(F.col(id_col).cast("string")))
    tagged = tagged.withColumns({
        "_tie": F.substring("_md5", 1, digits),
        "_v": -F.col(value).cast("double") if descending else F.col(value).cast("double"),
    })
    totals = running_totals(
        tagged, "_v", {"cnt": F.lit(1).cast("bigint")}, keys, ["_tie"], rows_per_range=rows_per_range
    ).select(*keys, "_v", "_tie", (F.col("cum_cnt") - F.col("cnt")).alias("_before"), F.col("tot_cnt").alias("n_rows"))
    inside = Window.partitionBy(*keys, "_v", "_tie").orderBy("_md5")
    return (
        tagged.join(totals, [*keys, "_v", "_tie"])
        .withColumn(out, F.col("_before") + F.row_number().over(inside))
        .select(*df.columns, out, "n_rows")
    )


def percentile_vs_reference(
    scores: DataFrame, score: str, reference: DataFrame, ref_score: str,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Percent of reference scores <= score, and the 0..100 score (raw x 100 without a reference)."""
    ref = reference.select(F.col(ref_score).cast("double").alias("_v"), F.lit(1).cast("bigint").alias("_w"))
    mine = scores.select(F.col(score).cast("double").alias("_v"), F.lit(0).cast("bigint").alias("_w"))
    totals = running_totals(ref.unionByName(mine), "_v", {"w": F.col("_w")}, rows_per_range=rows_per_range)
    share = totals.select(
        F.col("_v").alias("_score"),
        F.try_divide(F.lit(100.0) * F.col("cum_w"), F.col("tot_w").cast("double")).alias("percentile"),
    )
    joined = scores.join(share, F.col(score).cast("double") == F.col("_score"), "left").drop("_score")
    return joined.withColumn(
        "score_0_100", clip(F.coalesce(F.col("percentile"), F.col(score) * 100.0), 0.0, 100.0)
    )


def quality_band(percentile: Column, top: float = 70.0, bottom: float = 30.0) -> Column:
    p = nan_to_null(percentile)
    return (
        F.when(p.isNull(), F.lit("unknown"))
        .when(p >= top, F.lit("good"))
        .when(p <= bottom, F.lit("bad"))
        .otherwise(F.lit("neutral"))
    )


def confidence_level(count: Column, high: int = 10, medium: int = 5) -> Column:
    return (
        F.when(count.isNull(), F.lit("n/a"))
        .when(count >= high, F.lit("high"))
        .when(count >= medium, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def top_k_drivers(drivers: Column, k: int = 5) -> Column:
    """Array of driver structs -> struct(positive, negative), strongest first. No shuffle."""
    def ranked(keep, sign: int) -> Column:
        picked = F.filter(drivers, keep)
        order = lambda a, b: (
            F.when(a["contribution"] * sign > b["contribution"] * sign, F.lit(-1))
            .when(a["contribution"] * sign < b["contribution"] * sign, F.lit(1))
            .when(a["feature"] < b["feature"], F.lit(-1))
            .when(a["feature"] > b["feature"], F.lit(1))
            .otherwise(F.lit(0))
        )
        return F.slice(F.array_sort(picked, order), 1, k)

    return F.struct(
        ranked(lambda d: d["contribution"] > 0, 1).alias("positive"),
        ranked(lambda d: d["contribution"] < 0, -1).alias("negative"),
    )


def select_case_studies(
    scores: DataFrame, id_col: str = "LandLordID", score_col: str = "AdjustedScore",
    tenant_col: str = "TenantCount", n_good: int = 2, n_bad: int = 2, n_mid: int = 1, min_tenants: int = 5,
) -> DataFrame:
    """Best, worst and middle rows by score among entities with enough tenants, distinct ids."""
    ids = F.col(id_col).cast("string")
    scored = scores.filter(F.col(score_col).isNotNull())
    if tenant_col in scores.columns:
        need = n_good + n_bad + n_mid
        # A handful of rows decides; limit() stops the scan early.
        if scored.filter(F.col(tenant_col) >= min_tenants).limit(need).count() >= need:
            scored = scored.filter(F.col(tenant_col) >= min_tenants)
    placed = global_positions(scored, score_col, id_col)
    start = F.greatest(F.lit(0), F.floor(F.col("n_rows") / 2) - F.lit(n_mid // 2))
    pos, n = F.col("position"), F.col("n_rows")
    band = (
        F.when(pos <= n_good, F.lit("good"))
        .when(pos > n - n_bad, F.lit("bad"))
        .when((pos > start) & (pos <= start + n_mid), F.lit("neutral"))
    )
    return (
        placed.withColumn("band", band).filter(F.col("band").isNotNull())
        .withColumn(id_col, ids).drop("position", "n_rows")
    )


def billing_case_studies(
    scores: DataFrame, id_col: str = "customerid", prob_col: str = "churn_prob", events_col: str = "n_events"
) -> DataFrame:
    """Highest risk, lowest risk, and the recurring customer nearest P = 0.5, as one grouped arg-max."""
    p = F.col(prob_col)
    row = F.struct(*[F.col(c) for c in scores.columns])
    near = F.when(F.col(events_col) >= 2, F.struct(-F.abs(p - 0.5), order_key(0, F.col(id_col))))
    picked = scores.agg(
        F.max_by(row, F.struct(p, order_key(0, F.col(id_col)))).alias("highest_risk"),
        F.min_by(row, F.struct(p, order_key(0, F.col(id_col)))).alias("lowest_risk"),
        F.max_by(row, near).alias("recurring_review_case"),
    )
    return picked.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("case"), *[F.col(c)[x].alias(x) for x in scores.columns])
        for c in ("highest_risk", "lowest_risk", "recurring_review_case")
    ])))
