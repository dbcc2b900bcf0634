"""Population stability: exact decile edges of the reference, one grouped job for all features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.numeric import nan_to_null
from ledgerspark.operators.profile import long_form
from ledgerspark.operators.quantiles import by_number, numbered, wide_quantiles
from ledgerspark.operators.ranking import ROWS_PER_RANGE, exact_quantiles
from ledgerspark.session import materialise

STABLE, SIGNIFICANT = 0.1, 0.25


def drift_label(value: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit("unknown"))
        .when(value < STABLE, F.lit("stable"))
        .when(value < SIGNIFICANT, F.lit("moderate"))
        .otherwise(F.lit("significant"))
    )


def reference_edges(
    reference: DataFrame, n_bins: int = 10, feature: str = "feature", value: str = "value",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """(feature, edges, n_edges): distinct inner quantiles, the first and last edge being infinite."""
    probs = {f"q{i}": i / n_bins for i in range(n_bins + 1)}
    q = exact_quantiles(reference, value, probs, [feature], rows_per_range)
    every = F.array_sort(F.array_distinct(F.array(*probs)))
    inner = F.slice(every, F.lit(2), F.greatest(F.size(every) - 2, F.lit(0)))
    return q.select(feature, inner.alias("edges"), F.size(every).alias("n_edges"))


def known_values(rows: DataFrame) -> DataFrame:
    return rows.filter(nan_to_null(F.col("value")).isNotNull())


def bin_counts(rows: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, bin, n): rows per bin. The edges table has one row per feature; Spark broadcasts it by its size."""
    bin_of = F.aggregate("edges", F.lit(0), lambda n, e: n + F.when(F.col("value") >= e, 1).otherwise(0))
    return known_values(rows).join(edges, "feature").groupBy(*keys, "feature", bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def psi_of_counts(
    edges: DataFrame, ref: DataFrame, act: DataFrame, eps: float = 1e-6, keys: Sequence[str] = ()
) -> DataFrame:
    """psi per (keys, feature) from bin counts of both sides; keys belong to the actual side.

    Bins are listed from the edges, so a bin empty on one side still counts. All inputs are bounded by
    features x bins (x keys such as weeks).
    """
    keys = list(keys)
    bins = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"), "n_edges")
    if keys:
        bins = act.select(*keys, "feature").distinct().join(bins, "feature")
    r = ref.select("feature", "bin", F.col("n").alias("r"))
    a = act.select(*keys, "feature", "bin", F.col("n").alias("a"))
    tr = r.groupBy("feature").agg(F.sum("r").alias("tr"))
    ta = a.groupBy(*keys, "feature").agg(F.sum("a").alias("ta"))
    table = (
        bins.join(r, ["feature", "bin"], "left")
        .join(a, [*keys, "feature", "bin"], "left")
        .join(tr, "feature", "left")
        .join(ta, [*keys, "feature"], "left")
    )
    share = lambda c, t: F.greatest(F.try_divide(F.coalesce(F.col(c), F.lit(0)), F.col(t)), F.lit(eps))
    rs, as_ = share("r", "tr"), share("a", "ta")
    total = F.sum((as_ - rs) * F.ln(as_ / rs))
    return table.groupBy(*keys, "feature").agg(
        F.when(
            (F.max("tr") > 0) & (F.max("ta") > 0),
            F.when(F.max("n_edges") < 2, F.lit(0.0)).otherwise(total),
        ).alias("psi")
    )


def psi_long(
    reference: DataFrame, actual: DataFrame, n_bins: int = 10, eps: float = 1e-6,
    edges: DataFrame | None = None, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """(feature, value) rows of both sides -> psi per feature of the reference."""
    if edges is None:
        # A few numbers per feature, used on both sides: written once.
        edges = materialise(reference_edges(known_values(reference), n_bins, rows_per_range=rows_per_range), "edges")
    return psi_of_counts(edges, bin_counts(reference, edges), bin_counts(actual, edges), eps)


def psi(reference: DataFrame, actual: DataFrame, column: str, n_bins: int = 10, **kw) -> DataFrame:
    return psi_long(
        long_form(reference, [column], "double", "feature"), long_form(actual, [column], "double", "feature"), n_bins, **kw
    )


def wide_psi(reference: DataFrame, actual: DataFrame, columns: Sequence[str], n_bins: int = 10, eps: float = 1e-6, **kw) -> DataFrame:
    """(feature, psi) of columns on both sides: two reads of the reference, whose bins follow from its quantiles, one of the actual side."""
    probs = {f"q{i}": i / n_bins for i in range(n_bins + 1)}
    found = wide_quantiles(reference, columns, probs, **kw)[0].collect()  # columns x bins numbers
    rows, bins = [], []
    for r in found:
        every = sorted({r[q]: r[f"below_{q}"] for q in probs}.items())
        cuts = [0, *(below for _, below in every[1:-1]), r["n_valid"]]
        rows.append((r["column"], [v for v, _ in every[1:-1]], len(every)))
        bins += [(r["column"], b, high - low) for b, (low, high) in enumerate(zip(cuts, cuts[1:]))]
    spark = reference.sparkSession
    edges = spark.createDataFrame(rows, "feature string, edges array<double>, n_edges int")
    ref = spark.createDataFrame(bins, "feature string, bin int, n bigint")
    if rows:
        v = F.col("value")
        bin_of = {c: sum((F.when(v >= F.lit(e), 1).otherwise(0) for e in own), F.lit(0)) for c, (_, own, _) in enumerate(rows)}
        cells = numbered(actual, {c: nan_to_null(F.col(f"`{name}`").cast("double")) for c, (name, _, _) in enumerate(rows)})
        act = cells.select(by_number({c: F.lit(r[0]) for c, r in enumerate(rows)}).alias("feature"), by_number(bin_of).alias("bin"))
    else:
        act = spark.createDataFrame([], "feature string, bin int")
    table = psi_of_counts(edges, ref, act.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")), eps)
    every = spark.createDataFrame([(c,) for c in columns], "feature string")
    return every.join(table, "feature", "left")


def drift_report(reference: DataFrame, actual: DataFrame, columns: Sequence[str], n_bins: int = 10, **kw) -> DataFrame:
    """psi (four decimals) and label for every shared feature."""
    shared = [c for c in columns if c in reference.columns and c in actual.columns]
    table = wide_psi(reference, actual, shared, n_bins, **kw)
    return table.select("feature", F.round("psi", 4).alias("psi"), drift_label(F.col("psi")).alias("drift"))


def drift_action(report: DataFrame) -> DataFrame:
    n = F.count(F.when(F.col("drift") == "significant", F.lit(1)))
    return report.agg(
        n.alias("n_significant_drift"), F.when(n > 0, F.lit("retrain")).otherwise(F.lit("none")).alias("action")
    )
