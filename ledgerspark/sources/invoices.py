"""Reading and normalising invoice lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.numeric import nan_to_null
from ledgerspark.operators.ordering import slice_in_order
from ledgerspark.sources.tables import read_table

# Accepted names per invoice column, canonical name first. The first present wins.
INVOICE_ALIASES: dict[str, tuple[str, ...]] = {
    "customerid": ("customerid", "customer_id", "customer", "cust_id", "id_customer"),
    "date": ("date", "invoice_date", "billing_date", "invoice_dt"),
    "amount": ("amount", "invoice_amount", "amt", "value", "total"),
}
ORDER_ALIASES: dict[str, tuple[str, ...]] = {
    "customerid": ("o_custkey",), "date": ("o_orderdate",), "amount": ("o_totalprice",),
}
INVOICE_SCHEMA = "customerid string, date timestamp, amount double"


@dataclass
class Loaded:
    frame: DataFrame
    max_customers_applied: int | None
    truncated: bool
    source: str = ""

    def counts(self) -> dict[str, int]:
        """Row and customer count, in one aggregation job."""
        row = self.frame.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("customerid").alias("n_customers")
        ).first()
        return row.asDict()


def resolve_columns(
    columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = INVOICE_ALIASES
) -> dict[str, str]:
    """Canonical name -> actual column, matched without regard to case."""
    lower = {c.lower(): c for c in columns}
    found = {}
    for name, options in aliases.items():
        hit = next((lower[o.lower()] for o in options if o.lower() in lower), None)
        if hit is None:
            raise ValueError(f"no column for {name!r}; looked for {sorted(options)}, table has {list(columns)}")
        found[name] = hit
    return found


def canonical(df: DataFrame, aliases: Mapping[str, Sequence[str]] = INVOICE_ALIASES) -> DataFrame:
    """The three invoice columns with id as text, amount as double and date as timestamp."""
    at = resolve_columns(df.columns, aliases)
    kind = df.schema[at["date"]].dataType
    date = F.col(f"`{at['date']}`")
    if isinstance(kind, T.StringType):
        date = F.try_to_timestamp(date)
    elif not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        date = date.try_cast("timestamp")
    return df.select(
        F.col(f"`{at['customerid']}`").cast("string").alias("customerid"),
        date.alias("date"),
        nan_to_null(F.col(f"`{at['amount']}`").try_cast("double")).alias("amount"),
    )


def valid_rows(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("customerid").isNotNull() & F.col("date").isNotNull() & (F.col("amount") > 0)
    )


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no valid invoice rows after normalisation (check columns and amounts)")
    return df


def normalize_invoices(
    df: DataFrame, aliases: Mapping[str, Sequence[str]] = INVOICE_ALIASES, check: bool = True
) -> DataFrame:
    """Alias columns to canonical ones, cast, and keep complete rows with a positive amount."""
    out = valid_rows(canonical(df, aliases))
    return require_rows(out) if check else out


def invoices_from_records(spark: SparkSession, customer_id: str, records: Sequence[Mapping]) -> DataFrame:
    """Small in-memory {date, amount} records of one customer as an invoice table."""
    rows = [(customer_id, str(x["date"]), float(x["amount"])) for x in records]
    return normalize_invoices(spark.createDataFrame(rows, "customerid string, date string, amount double"))


def cap_customers(
    df: DataFrame,
    max_customers: int | None = None,
    customer_id: str | None = None,
    recurring_only: bool = False,
    min_events: int = 2,
) -> Loaded:
    """One customer, or the first N customer ids in id order, optionally only recurring ones.

    Nothing is cut unless it is asked for. `truncated` says whether the id or the cap left out any customer.
    """
    if customer_id:
        own = F.col("customerid") == str(customer_id)
        return Loaded(df.filter(own), 1, not df.filter(~own).isEmpty())
    if max_customers is None and not recurring_only:
        return Loaded(df, None, False)
    if recurring_only:
        # Days are made distinct first, so a busy customer is reduced on the map side.
        days = df.select("customerid", F.to_date("date").alias("_d")).distinct()
        ids = days.groupBy("customerid").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_events)
        ids = ids.select("customerid")
    else:
        ids = df.select("customerid").distinct()
    if max_customers is None:
        return Loaded(df.join(ids, "customerid", "left_semi"), None, False)
    kept, total = slice_in_order(ids, ["customerid"], 0, max_customers)
    return Loaded(df.join(kept, "customerid", "left_semi"), max_customers, total > max_customers)


def cap_rows(df: DataFrame, max_rows: int, order_by: Sequence[str] = ("customerid", "date", "amount")) -> DataFrame:
    """The first max_rows rows in a fixed order."""
    return slice_in_order(df, order_by, 0, max_rows)[0]


def load_invoices(
    spark: SparkSession,
    path: str,
    max_customers: int | None = None,
    customer_id: str | None = None,
    recurring_only: bool = False,
    min_events: int = 2,
    max_rows: int | None = None,
    aliases: Mapping[str, Sequence[str]] = INVOICE_ALIASES,
) -> Loaded:
    """Read by suffix, alias and normalise the whole table; caps on customers or rows only where the caller asks for them."""
    df = canonical(read_table(spark, path), aliases)
    capped = cap_customers(df, max_customers, customer_id, recurring_only, min_events)
    frame, truncated = capped.frame, capped.truncated
    if max_rows is not None:
        frame, total = slice_in_order(frame, ("customerid", "date", "amount"), 0, max_rows)
        truncated = truncated or total > max_rows
    return Loaded(require_rows(valid_rows(frame)), capped.max_customers_applied, truncated, path)
