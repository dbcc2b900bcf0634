"""Exact quantiles of many columns in two reads: approximate brackets in one wide pass, then exact counts inside the brackets only.

The first read is a single aggregation: a sketch per column gives, for each asked share, two values whose ranks lie safely on either
side. The second read counts every column's values by segment, and by value only where a segment is a bracket, so that map
tasks hand on a few counts and some thousandths of the values instead of rows x columns. Exact counts then tell whether a
rank lies in its bracket; brackets that missed are widened. Where brackets of a very large table would hold too many
values, a wide pass over the brackets narrows them first.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerspark.functions.numeric import nan_to_null
from ledgerspark.session import materialise

#: A sketch's rank error is one part in ACCURACY; brackets leave MARGIN errors on either side.
ACCURACY = 10_000
MARGIN = 3
#: Values that the brackets of one column may hold, and steps of a narrowing pass.
MOST_VALUES = 1_000_000
STEPS = 200

Bracket = tuple[float, float]


def _disjoint(brackets: Sequence[Bracket]) -> list[Bracket]:
    out: list[list[float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _segment(v: Column, brackets: Sequence[Bracket]) -> Column:
    """2 i + 1 inside bracket i, 2 i between bracket i - 1 and it."""
    at = None
    for i, (low, high) in enumerate(brackets):
        for number, holds in ((2 * i, v < F.lit(low)), (2 * i + 1, v <= F.lit(high))):
            at = F.when(holds, number) if at is None else at.when(holds, number)
    return at.otherwise(2 * len(brackets))


def numbered(df: DataFrame, values: Mapping[int, Column]) -> DataFrame:
    """(c, value) rows of the numbered columns, without nulls; row-local, and what follows stays in generated code."""
    cells = [F.struct(F.lit(c).alias("c"), v.alias("value")) for c, v in values.items()]
    return df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


def by_number(of: Mapping[int, Column]) -> Column:
    """The expression of the row's column number c."""
    out = None
    for c, e in of.items():
        out = F.when(F.col("c") == c, e) if out is None else out.when(F.col("c") == c, e)
    return out


def _ranks(n: int, probs: Sequence[float]) -> list[int]:
    """Places from 0 of the values that linear interpolation needs."""
    return sorted({int(f(float(p) * (n - 1))) for p in probs for f in (math.floor, math.ceil)})


def _narrowed(df: DataFrame, values: Sequence[Column], brackets: dict[int, list[Bracket]], n: Sequence[int], probs: Sequence[float], accuracy: int) -> dict[int, list[Bracket]]:
    """Smaller brackets around the same ranks, from one wide pass over the rows inside the given ones."""
    grid = [i / STEPS for i in range(STEPS + 1)]
    aggs, places = [], [(c, i) for c in brackets for i in range(len(brackets[c]))]
    for c, i in places:
        low, high = brackets[c][i]
        v, inside = values[c], (values[c] >= F.lit(low)) & (values[c] <= F.lit(high))
        aggs += [F.struct(F.count_if(v < F.lit(low)).alias("below"), F.count_if(inside).alias("inside"),
                          F.percentile_approx(F.when(inside, v), grid, accuracy).alias("q")).alias(f"b{c}_{i}")]
    row = df.agg(*aggs).first()
    out: dict[int, list[Bracket]] = {c: [] for c in brackets}
    for c, i in places:
        r = row[f"b{c}_{i}"]
        for k in _ranks(n[c], probs):
            if r["inside"] and r["below"] <= k < r["below"] + r["inside"]:
                share, slack = (k - r["below"]) / r["inside"], MARGIN / accuracy
                first, last = math.floor((share - slack) * STEPS), math.ceil((share + slack) * STEPS + STEPS / r["inside"])
                out[c].append((r["q"][max(0, first)] if first > 0 else brackets[c][i][0], r["q"][last] if last < STEPS else brackets[c][i][1]))
    return {c: _disjoint(b) if b else brackets[c] for c, b in out.items()}


def _counted(df: DataFrame, values: Sequence[Column], brackets: dict[int, list[Bracket]]) -> DataFrame:
    """(c, segment, value, cnt): rows by column and segment, and by value inside brackets."""
    v = F.col("value")
    segment = by_number({c: _segment(v, own) for c, own in brackets.items()})
    placed = numbered(df, {c: values[c] for c in brackets}).withColumn("segment", segment)
    return placed.groupBy("c", "segment", F.when(F.col("segment") % 2 == 1, v).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def wide_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], also: Sequence[Column] = (), accuracy: int = ACCURACY,
    most: int = MOST_VALUES,
) -> tuple[DataFrame, Row]:
    """((column, n_valid, a quantile per name of probs, below_<name>), row of the aggregates in also).

    Quantiles interpolate linearly between ranks, like sorting each column would; below_<name> counts the values under the quantile.
    Null and NaN don't count; a column without values has no row. `also` is computed in the first read.
    """
    spark = df.sparkSession
    values = [nan_to_null(F.col(f"`{c}`").cast("double")) for c in columns]
    shares, margin = list(probs.values()), MARGIN
    asked = [max(0.0, p - margin / accuracy) for p in shares] + [min(1.0, p + margin / accuracy) for p in shares]
    first = df.agg(*also, *[F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile_approx(v, asked, accuracy).alias("q")).alias(f"_w{c}")
                            for c, v in enumerate(values)]).first()
    facts = [first[f"_w{c}"] for c in range(len(columns))]
    n = [f["n"] for f in facts]
    brackets: dict[int, list[Bracket]] = {}
    for c, f in enumerate(facts):
        if n[c]:
            pairs = zip(shares, f["q"][: len(shares)], f["q"][len(shares) :])
            brackets[c] = _disjoint([(f["lo"] if p <= margin / accuracy else a, f["hi"] if p >= 1 - margin / accuracy else b) for p, a, b in pairs])
    expected = max((2 * (margin + 1) * len(shares) * k / accuracy for k in n), default=0)
    while expected > most:
        brackets = _narrowed(df, values, brackets, n, shares, accuracy)
        expected *= 2 * (1 / STEPS + MARGIN / accuracy)
    while True:
        if not brackets:
            cells, tops = spark.createDataFrame([], "c int, segment int, value double, cnt bigint"), []
            break
        cells = materialise(_counted(df, values, brackets), "bracket_counts")
        tops = [(r["c"], r["segment"], r["k"]) for r in cells.groupBy("c", "segment").agg(F.sum("cnt").alias("k")).collect()]  # two a bracket, and one
        missed = set()
        for c in brackets:
            done, held = 0, []
            for _, segment, k in sorted(t for t in tops if t[0] == c):
                held += [(done, done + k)] if segment % 2 else []
                done += k
            if not all(any(a <= r < b for a, b in held) for r in _ranks(n[c], shares)):
                missed.add(c)
        if not missed:
            break
        for c in missed:  # a sketch erred by more than it promises: this column is counted whole
            brackets[c] = [(facts[c]["lo"], facts[c]["hi"])]
    offsets, done = [], {}
    for c, segment, k in sorted(tops):
        offsets.append((c, segment, done.get(c, 0), n[c]))
        done[c] = done.get(c, 0) + k
    offsets = spark.createDataFrame(offsets, "c int, segment int, before bigint, tot_cnt bigint")
    run = Window.partitionBy("c", "segment").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cells.filter("segment % 2 = 1").join(F.broadcast(offsets), ["c", "segment"]).withColumn("cum_cnt", F.col("before") + F.sum("cnt").over(run))
    start, last, size = F.col("cum_cnt") - F.col("cnt"), F.col("cum_cnt") - 1, F.col("tot_cnt")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (size - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (start <= at) & (at <= last)
            aggs += [F.max(F.when(here, F.struct("value", start.alias("first"), "cum_cnt"))).alias(f"_{name}_{tag}")]
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_w"))
    out = totals.groupBy("c").agg(F.max("tot_cnt").alias("n_valid"), *aggs)
    for name in probs:
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, lo["value"] + F.col(f"_{name}_w") * (hi["value"] - lo["value"])).withColumn(
            f"below_{name}", F.when(F.col(name) == lo["value"], lo["first"]).otherwise(lo["cum_cnt"]))
    labels = spark.createDataFrame(list(enumerate(columns)), "c int, column string")
    found = out.join(F.broadcast(labels), "c").select("column", "n_valid", *probs, *[f"below_{p}" for p in probs])
    return found, first
