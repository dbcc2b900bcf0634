"""Id-list cells in several text formats -> array<string>, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that mean "no ids".
EMPTY_CELLS = ("", "nan", "none", "null", "[]")
FORMATS = ("auto", "list", "json", "csv")


def _clean(arr: Column) -> Column:
    trimmed = F.transform(arr, lambda x: F.trim(F.coalesce(x, F.lit("None"))))
    return F.filter(trimmed, lambda x: x != "")


def _strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def _parts(raw: Column, chars: str) -> Column:
    pieces = F.filter(F.split(raw, ","), lambda x: F.trim(x) != "")
    return F.transform(pieces, lambda x: _strip_chars(F.trim(x), chars))


def parse_id_list(cell: Column, fmt: str = "auto", is_array: bool = False) -> Column:
    """Array of trimmed ids; an empty array for null-like cells."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown id list format {fmt!r}")
    none = F.array().cast("array<string>")
    if is_array:
        items = F.filter(cell.cast("array<string>"), lambda x: x.isNotNull())
        return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), none)
    raw = F.trim(cell.cast("string"))
    missing = raw.isNull() | F.lower(raw).isin(*EMPTY_CELLS)
    as_json = F.from_json(raw, "array<string>", {"allowSingleQuotes": "true"})
    scalar = F.array(raw)
    if fmt in ("list", "json"):
        body = F.when(raw.startswith("["), F.coalesce(_clean(as_json), scalar)).otherwise(scalar)
    elif fmt == "csv":
        pieces = _parts(raw, "'\"")
        body = F.when(F.size(pieces) > 0, pieces).otherwise(scalar)
    else:
        pieces = _parts(raw, "'\"[]")
        listed = F.when(raw.startswith("["), _clean(as_json))
        body = F.coalesce(
            listed,
            F.when(raw.contains(",") & (F.size(pieces) > 1), pieces),
            F.array(_strip_chars(raw, "'\"")),
        )
    return F.when(missing, none).otherwise(body)
