"""Incremental forms of the batch operators with Structured Streaming.

Sinks are foreachBatch tables below one folder per micro-batch, written with overwrite of that folder
only: a replayed batch replaces its own output, so results are exactly-once and survive lost executors.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.config import IntervalConfig
from ledgerspark.operators.billing import infer_intervals
from ledgerspark.operators.drift import bin_counts, drift_label, psi_of_counts
from ledgerspark.session import new_scratch


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table as a file stream. The schema comes from the batch table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A glob lets the same path be one file or a folder of files.
    return reader.parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def stream_in_parts(df: DataFrame, parts: int) -> DataFrame:
    """A table as a stream of several micro-batches: written once as files, of which each trigger takes one."""
    path = new_scratch(df.sparkSession, "stream")
    df.repartition(parts).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def start(
    stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None,
    name: str | None = None, each_of: Callable[[DataFrame, int], DataFrame] | None = None,
) -> StreamingQuery:
    """Run each micro-batch through `each`, or `each_of` with its number, and write it to <path>/data/batch_id=<n>."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = each_of(batch, batch_id) if each_of else each(batch) if each else batch
        out.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    if name:
        writer = writer.queryName(name)
    return writer.trigger(availableNow=True).start()


def run(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process everything that is available, then read the sink table."""
    start(stream, path, mode, each).awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/data")


def latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key of an update-mode sink: a grouped arg-max, no window."""
    rest = [c for c in table.columns if c not in (*keys, "batch_id")]
    packed = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_v"))
    return packed.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def same_day_events(invoices: DataFrame, delay: str = "2 days") -> DataFrame:
    """Invoice stream (customerid, date timestamp, amount) -> daily events.

    Late rows inside the watermark update their day; older ones are dropped.
    """
    return (
        invoices.withWatermark("date", delay)
        .groupBy("customerid", F.window("date", "1 day").alias("w"))
        .agg(F.sum("amount").alias("event_amount"), F.count(F.lit(1)).alias("n_invoices"))
        .select("customerid", F.to_date("w.start").alias("date"), "event_amount", "n_invoices")
    )


def stored_history(batch: DataFrame, batch_id: int, path: str, key: str) -> DataFrame:
    """Adds the batch to the table below path, and gives all rows stored so far of the keys it touches.

    A replayed batch overwrites its own part and sees only parts up to its own, so it gives the same rows again.
    """
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    stored = batch.sparkSession.read.parquet(path).filter(F.col("batch_id") <= batch_id)
    touched = stored.filter(F.col("batch_id") == batch_id).select(key).distinct()
    return stored.drop("batch_id").join(touched, key, "left_semi")


def score_files(
    invoices: DataFrame, path: str, scorer: Callable[[DataFrame], DataFrame], key: str = "customerid"
) -> StreamingQuery:
    """Score new invoice files as they land; scorer is any batch table -> table function.

    Every customer of a new file is scored again from all rows stored so far, however many files they came in.
    `latest(table, [key])` gives the current scores.
    """
    return start(invoices, path, each_of=lambda batch, n: scorer(stored_history(batch, n, f"{path}/events", key)))


def verdict_mix(verdicts: DataFrame, every: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Verdict stream (ts, recommendation, guardrail_rule) -> counts per period, verdict and rule."""
    return (
        verdicts.withWatermark("ts", delay)
        .groupBy(F.window("ts", every).alias("w"), "recommendation", "guardrail_rule")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("period"), "recommendation", "guardrail_rule", "n")
    )


VERDICTS = ("Continue", "Review", "No-Go")


def with_zeros(counts: DataFrame, over: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """(over, kind, n) -> (over, kind, n, total) with a row for every kind of every period, absent ones counting 0."""
    per = counts.groupBy(over).agg(
        F.sum("n").alias("total"), *[F.sum(F.when(F.col(kind) == k, F.col("n"))).alias(f"_{i}") for i, k in enumerate(kinds)]
    )
    rows = F.array(*[
        F.struct(F.lit(k).alias(kind), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("n")) for i, k in enumerate(kinds)
    ])
    return per.select(over, "total", F.inline(rows))


def mix_alerts(counts: DataFrame, points: float = 20.0, verdicts: Sequence[str] = VERDICTS, every_days: int = 7) -> DataFrame:
    """Share per period and verdict, and the shift to the period before; alert above `points`.

    A verdict that no company got has share 0, so its fall and its return are shifts. Only adjacent periods are compared: after
    a period without any verdict there is no shift. The window per verdict is as long as the number of periods.
    """
    share = with_zeros(counts, "period", "recommendation", verdicts).withColumn("share_pct", F.col("n") * 100.0 / F.col("total"))
    w = Window.partitionBy("recommendation").orderBy("period")
    adjacent = F.date_diff("period", F.lag("period").over(w)) == every_days
    shift = share.withColumn("shift", F.when(adjacent, F.col("share_pct") - F.lag("share_pct").over(w)))
    return shift.withColumn("alert", F.coalesce(F.abs("shift") > points, F.lit(False)))


def rule_alerts(daily: DataFrame, rules: Sequence[str], days: int = 30, sigmas: float = 3.0) -> DataFrame:
    """(day, guardrail_rule, n), the rule null for verdicts without one -> fire rate against its own trailing baseline.

    Days on which a rule did not fire count with rate 0; days without any verdict have no rate.
    """
    at = F.date_diff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("guardrail_rule").orderBy(at).rangeBetween(-days, -1)
    rate = with_zeros(daily, "day", "guardrail_rule", rules).withColumnRenamed("n", "fired").withColumn("rate", F.col("fired") / F.col("total"))
    based = rate.withColumns({"baseline": F.avg("rate").over(w), "spread": F.stddev_samp("rate").over(w)})
    return based.withColumn(
        "alert", F.coalesce(F.col("rate") > F.col("baseline") + sigmas * F.col("spread"), F.lit(False)))


def drift_counts(edges: DataFrame, every: str = "7 days") -> Callable[[DataFrame], DataFrame]:
    """Micro-batch function: (ts, feature, value) -> partial bin counts per period. Counts add up over batches."""
    def each(batch: DataFrame) -> DataFrame:
        dated = batch.withColumn("period", F.to_date(F.window("ts", every)["start"]))
        return bin_counts(dated, edges, ["period"])

    return each


def weekly_drift(counts: DataFrame, edges: DataFrame, reference: DataFrame) -> DataFrame:
    """psi per period and feature from the accumulated counts; above .25 asks for a review."""
    summed = counts.groupBy("period", "feature", "bin").agg(F.sum("n").alias("n"))
    out = psi_of_counts(edges, reference, summed, keys=["period"])
    return out.withColumn("drift", drift_label(F.col("psi"))).withColumn(
        "review", F.coalesce(F.col("psi") > 0.25, F.lit(False)))


def dedupe_stream(invoices: DataFrame, keys: Sequence[str], time_col: str = "date", delay: str = "2 days") -> DataFrame:
    """Drop repeated lines (same keys) that arrive within the watermark."""
    return invoices.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def gap_tracker(
    days: DataFrame, path: str, as_of: dt.date | None = None, cfg: IntervalConfig = IntervalConfig(), keep_days: int | None = None
) -> StreamingQuery:
    """Event-day stream (customerid, d date) -> interval label and confidence of every customer a batch touches.

    The distinct days of a batch join a day table; the customers it touches are labelled again from all their days by the
    batch operator, so late and repeated days count like any other. as_of: date of the label (default: the day after the
    latest day stored); with keep_days, older days are left out. `latest(table, ["customerid"])` gives the current labels.
    """
    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        history = stored_history(batch.select("customerid", "d").distinct(), batch_id, f"{path}/days", "customerid").distinct()
        end = as_of
        if end is None:
            last = batch.sparkSession.read.parquet(f"{path}/days").filter(F.col("batch_id") <= batch_id).agg(F.max("d")).first()[0]
            end = (last or dt.date(1970, 1, 1)) + dt.timedelta(days=1)
        if keep_days is not None:
            history = history.filter(F.col("d") >= F.lit(end - dt.timedelta(days=keep_days)))
        events = history.select(
            "customerid", F.col("d").alias("date"), F.lit(1.0).alias("event_amount"), F.lit(1).cast("bigint").alias("n_invoices"))
        return infer_intervals(events, [end], cfg, daily=True).select(
            "customerid", F.col("snapshot_date").alias("as_of"), F.col("n_events").alias("n_days"), "billing_interval", "interval_confidence")

    return start(days, path, each_of=each)
