"""URL filter: host and path rules first, then the likelihood ratio of two character models.

Two variable-order Markov models over characters are counted on all URLs that a rule allows and on all that a rule
blocks. A URL without a rule is scored by the difference of its log likelihoods per character, and blocked below a cutoff
calibrated on held-out allowed URLs. Each order backs off to the shorter context by Witten-Bell smoothing. Contexts are exact,
so the models grow with the different contexts of the URLs (17 bytes on the driver and in the broadcast for each that is
followed by some symbol), not with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.session import materialise

#: Fixed values: (verdict, host, path) of the query's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
SYMBOLS = 64
#: Contexts of the longest order; as many numbers are set aside for each order.
CONTEXTS = SYMBOLS**ORDER
FOLDS = 5
#: Share of the held-out allowed URLs that the cutoff may block.
FALSE_BLOCKS = 0.01
CLASSES = ("allow", "block")

_ALPHABET = b"abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&%#:+~,;@!$'()*|[]"
#: Symbol 0 stands for the ends of a URL, SYMBOLS - 1 for all other bytes.
_SYMBOL = np.full(256, SYMBOLS - 1, np.int64)
_SYMBOL[list(_ALPHABET)] = np.arange(1, len(_ALPHABET) + 1)
_SYMBOL[65:91] = _SYMBOL[97:123]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.substr(rest, F.length(host) + 1)


def match_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. Of equally long ones the first listed wins."""
    rule, verdict = None, None
    for action, h, p in sorted(rules, key=lambda x: -len(x[1] + x[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _positions(urls: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every character and the end of every URL: the URL's place, the symbol, and its context for each order."""
    texts = [u.partition(b"://")[2] or u if u else b"" for u in urls]
    # Each URL is preceded by ORDER ends, so contexts never reach into the one before it.
    joined = (b"\x00" * ORDER).join([b"", *texts, b""])
    symbol = _SYMBOL[np.frombuffer(joined, np.uint8)]
    symbol[np.frombuffer(joined, np.uint8) == 0] = 0
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    first = ORDER + np.cumsum(np.r_[0, lengths[:-1] + ORDER]) if len(texts) else np.zeros(0, np.int64)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(np.r_[0, lengths[:-1] + 1]) if len(texts) else first, lengths + 1)
    at = np.repeat(first, lengths + 1) + inside
    contexts = [np.zeros(len(at), np.int64)]
    for k in range(1, ORDER + 1):
        contexts.append(contexts[-1] + symbol[at - k] * SYMBOLS ** (k - 1))
    return owner, symbol[at], contexts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, cell, n): cell is order, context and symbol in one number, summed per batch."""
    for batch in batches:
        urls, verdicts = C.as_bytes(batch.column(0)), batch.column(1).to_pylist()
        for k, name in enumerate(CLASSES):
            _, symbol, contexts = _positions([u for u, v in zip(urls, verdicts) if v == name])
            cells = [(order * CONTEXTS + c) * SYMBOLS + symbol for order, c in enumerate(contexts)]
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(n)], ["class", "cell", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.to_numpy().astype(kind).tobytes()], pa.binary()) for x, kind in zip(batch.columns, ("u1", "<i8", "<i8"))],
            ["class", "cell", "n"],
        )


class Model:
    """Cells of both classes in ascending order, with their counts."""

    def __init__(self, packed: list[tuple[np.ndarray, np.ndarray]]):
        self.packed = packed

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each class: cells, their counts, contexts, and totals and numbers of different symbols by context."""
        out = []
        for cell, n in self.packed:
            context, first, kinds = np.unique(cell // SYMBOLS, return_index=True, return_counts=True)
            out.append((cell, n, context, np.add.reduceat(n, first), kinds))
        return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key, 0 where it is not among the ascending keys."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.float64)


def log_likelihood(symbol: np.ndarray, contexts: list[np.ndarray], table: tuple) -> np.ndarray:
    """Log probability of each symbol: every order mixes its counts with the order below it."""
    cells, counts, known, totals, kinds = table
    p = np.full(len(symbol), 1.0 / SYMBOLS)
    for order, c in enumerate(contexts):
        context = order * CONTEXTS + c
        n, t = _found(known, totals, context), _found(known, kinds, context)
        p = np.where(n > 0, (_found(cells, counts, context * SYMBOLS + symbol) + t * p) / np.maximum(n + t, 1), p)
    return np.log(p)


def ratios(urls: list[bytes | None], tables: list[tuple]) -> np.ndarray:
    """(log P(url | allowed) - log P(url | blocked)) per character; the end of a URL counts as a character."""
    owner, symbol, contexts = _positions(urls)
    gap = log_likelihood(symbol, contexts, tables[0]) - log_likelihood(symbol, contexts, tables[1])
    return np.bincount(owner, gap, minlength=len(urls)) / np.maximum(np.bincount(owner, minlength=len(urls)), 1)


def learn(urls: DataFrame) -> Model | None:
    """Model from (url, verdict) rows; None unless both verdicts occur. Counts cover all rows."""
    cells = urls.where(F.col("verdict").isin(*CLASSES) & F.col("url").isNotNull()).select("url", "verdict").mapInArrow(
        _count, "class int, cell bigint, n bigint"
    )
    packed = cells.groupBy("class", "cell").agg(F.sum("n").alias("n")).mapInArrow(_pack, "class binary, cell binary, n binary")
    rows = packed.collect()  # different cells only, of 17 bytes

    def column(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(r[name]) for r in rows), kind)

    owner, cell, n = column("class", "u1"), column("cell", "<i8"), column("n", "<i8")
    order = np.argsort(cell)
    owner, cell, n = owner[order], cell[order], n[order]
    own = [(cell[owner == k], n[owner == k]) for k in range(len(CLASSES))]
    return Model(own) if all(len(c) for c, _ in own) else None


def with_ratio(urls: DataFrame, model: Model) -> DataFrame:
    """urls with a column ratio from their column url; other columns must not be called so."""
    shared = urls.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            texts = C.as_bytes(batch.column(batch.schema.get_field_index("url")))
            # Blocks of bounded size, as every character needs some hundred bytes of working memory.
            found = [ratios(texts[i : i + 2000], tables) for i in range(0, len(texts), 2000)]
            yield batch.append_column("ratio", pa.array(np.concatenate(found) if found else np.zeros(0)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return urls.mapInArrow(run, f"{fields}, ratio double")


def judge(pages: DataFrame, rules: tuple = RULES, false_blocks: float = FALSE_BLOCKS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, ratio) of every row of pages.

    A rule decides where one fits. Else the models do: a ratio below the cutoff is blocked, the cutoff being the
    `false_blocks` quantile of the ratios of allowed URLs that the models were not counted on, but never above 0, where
    both classes are equally likely. Null and empty URLs have ratio
    0, empty host and path, and are allowed; so is every URL without a rule where the rules leave one class empty. Repeated
    URLs each count.
    """
    C.bounded_batches(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    placed = own.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    ruled = placed.select("*", rule.alias("rule"), verdict.alias("verdict"))
    fold = C.fold_of(F.col("url"), FOLDS)
    model = learn(ruled.where(fold != 0))
    if model is None:
        return ruled.withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).withColumn("ratio", F.lit(0.0))
    scored = materialise(with_ratio(ruled, model), "url_ratios")
    kept_out = scored.where((fold == 0) & (F.col("verdict") == "allow"))
    cutoff = kept_out.agg(F.percentile_approx("ratio", F.lit(false_blocks), F.lit(10_000))).first()[0]
    blocked = (F.col("ratio") < F.lit(min(0.0, cutoff or 0.0))) & (F.coalesce(F.length("url"), F.lit(0)) > 0)
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "ratio")


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLE_SQL: dict[str, str] = {}
