"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule compares one metric with a cutoff. On labelled good documents (the holdout) every cutoff of a rule's grid is
tested per stratum: the hypothesis that it rejects more than `risk` of the good documents falls if the exact binomial
probability of so few rejections is small enough, with Holm's correction over all strata, rules and cutoffs. So, with
confidence 1 - `error`, every chosen cutoff falsely rejects at most `risk` of the good documents of its stratum. The
strictest cutoff shown safe is used; where none is (small or unlabelled strata), the rule does not apply.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.session import materialise

RISK = 0.01
ERROR = 0.05
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: rule: (metric, sign, cutoffs); a document is rejected if sign * metric > sign * cutoff.
RULES: dict[str, tuple[str, int, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 1, (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", 1, (0.1, 0.2, 0.3, 0.5)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 1, (0.05, 0.1, 0.15)),
    "long_words": ("word_chars / greatest(n_words, 1)", 1, (6.0, 6.5, 7.0, 8.0, 10.0)),
    "short_words": ("word_chars / greatest(n_words, 1)", -1, (4.5, 4.0, 3.5, 3.0, 2.0)),
}

_SPACE = " \t\n\x0b\f\r"


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window found twice or more; windows are told apart by 64-bit hashes."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def from_sorted(s: Column) -> Column:
        def twin(e: Column, j: Column) -> Column:
            before, after = F.get(s, j - 1)["h"], F.get(s, j + 1)["h"]
            return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

        return _let(F.array_sort(F.transform(F.filter(s, twin), lambda e: e["i"])), covered)

    def from_hashes(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, from_sorted))

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes, from_hashes))


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns other than the text, with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    Words are runs of characters other than ASCII white space. Null and empty texts have zeros.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    of_words = _let(words, lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words"),
    ))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    found = docs.select(*others, of_words.alias("_w"), of_lines.alias("_l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("_s"))
    value = {"n_words": "_w.n_words", "word_chars": "_w.word_chars", "n_symbols": "_s", "n_dup_lines": "_l.n_dup_lines",
             "n_lines": "_l.n_lines", "n_repeat_words": "_w.n_repeat_words"}
    return found.select(*others, *[F.col(c).cast("bigint").alias(n) for n, c in value.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p), exact but for rounding; 0 (no evidence) once k reaches n * p."""
    odds = math.log(p / (1 - p))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    none = n * F.lit(math.log1p(-p))
    start = F.struct(none.alias("term"), none.alias("total"))
    total = F.when(k == 0, none).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))), start, add)["total"])
    return F.when(k >= n * F.lit(p), F.lit(0.0)).otherwise(total)


def choose_cutoffs(holdout: DataFrame, risk: float = RISK, error: float = ERROR, rules: dict = RULES) -> DataFrame:
    """(stratum, cut_<rule>...) from good labelled documents with a stratum and the metrics; null: rule not applied."""
    tested = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(sign * c).alias("cut"), (F.expr(metric) * sign > sign * c).cast("bigint").alias("bad"))
        for name, (metric, sign, cuts) in rules.items() for c in cuts
    ])
    counts = holdout.select("stratum", F.explode(tested).alias("t")).groupBy("stratum", "t.rule", "t.cut").agg(
        F.count("*").alias("n"), F.sum("t.bad").alias("k")
    )
    scored = counts.withColumn("p", log_binomial_cdf(F.col("k"), F.col("n"), risk))
    # One row per stratum, rule and cutoff: a table of tests, not of documents.
    every = Window.orderBy("p", "stratum", "rule", "cut")
    left = F.count("*").over(Window.partitionBy(F.lit(0))) - F.row_number().over(every) + 1
    passed = F.col("p") <= F.log(F.lit(error) / left)
    held = scored.withColumn("ok", passed).withColumn("safe", F.min(F.col("ok").cast("int")).over(every.rowsBetween(Window.unboundedPreceding, 0)))
    return held.where("safe = 1").groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == name, F.col("cut"))).alias(f"cut_{name}") for name in rules]
    )


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, rules: dict = RULES,
          stratum_col: str = "lang") -> DataFrame:
    """(doc_id, metrics, base_failed, kept) of every row of docs, which needs doc_id, text and the stratum column.

    labels: (doc_id, quality); quality 1 is good. A document with any label 0 is not good; null labels and labels of
    other documents are ignored. The holdout is every row with a good document that passes the base rule; a null stratum is
    one of its own. Rows whose base rule fails are not kept; others are kept unless a certified cutoff of their stratum
    rejects them. Null and empty texts have no words and fail the base rule. Repeated rows each count.
    """
    measured = materialise(
        metrics(docs.select("doc_id", F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), "text")), "metrics"
    ).withColumn("base_failed", base_failed())
    good = labels.groupBy(F.col("doc_id").alias("good_id")).agg(F.min("quality").alias("q")).where("q = 1")
    holdout = measured.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("good_id"), "left_semi")
    cuts = materialise(choose_cutoffs(holdout, risk, error, rules), "cutoffs").withColumnRenamed("stratum", "s")
    rejected = F.lit(False)
    for name, (metric, sign, _) in rules.items():
        rejected = rejected | F.coalesce(F.expr(metric) * sign > F.col(f"cut_{name}"), F.lit(False))
    return measured.join(cuts, F.col("stratum") == F.col("s"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def _grid_sql() -> str:
    return ", ".join(f"('{name}', {float(sign * c)!r})" for name, (_, sign, cuts) in RULES.items() for c in cuts)


def _case_sql() -> str:
    whens = " ".join(f"WHEN '{name}' THEN {sign} * {m.replace(' / ', ' * 1.0 / ')}" for name, (m, sign, _) in RULES.items())
    return f"CASE rule {whens} END"


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1)
        GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT l.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM l LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m),
grid AS (SELECT * FROM (VALUES {_grid_sql()}) v(rule, cut)),
tests AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER ({_case_sql()} > cut) AS k
          FROM b JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) CROSS JOIN grid
          WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {RISK} THEN 0.0 ELSE ln((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) FROM (SELECT unnest(range(0, k + 1)) AS i))) END AS p FROM tests),
o AS (SELECT *, p <= ln({ERROR} / (count(*) OVER () - row_number() OVER (ORDER BY p, stratum, rule, cut) + 1)) AS ok FROM p),
h AS (SELECT *, bool_and(ok) OVER (ORDER BY p, stratum, rule, cut ROWS UNBOUNDED PRECEDING) AS safe FROM o),
c AS (SELECT stratum, rule, min(cut) AS cut FROM h WHERE safe GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM b JOIN c USING (stratum) WHERE NOT base_failed AND {_case_sql()} > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM b
"""

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": OP7_SQL}
