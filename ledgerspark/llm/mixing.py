"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a uniform hash key. Within its source the key range is cut into about sqrt(rows) equal ranges of
about sqrt(rows) rows, so a source with a third of all rows is spread like the others. Sizes are summed per range, the
range totals are summed up along the source, and a window inside one range finishes the prefix sum. A source is read
whole `target // size` times; the rest of its target is cut out of the front of the random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.session import materialise

SHARE = 1.5
MAX_EPOCHS = 2.0
WEIGHTS = (3, 1, 2)
SEED = 20250101
KEY_BITS = 60


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def random_key(doc_id: Column, seed: int = SEED) -> Column:
    """Uniform integer of KEY_BITS bits from md5 of seed and id; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def repeating_weights(sources: DataFrame, pattern: tuple = WEIGHTS) -> DataFrame:
    """weight of each source: the pattern repeated over the sources in code-point order, null last.

    The window takes one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in pattern])
    return sources.withColumn("weight", F.element_at(values, F.pmod(place, F.lit(len(pattern))) + 1))


def targets(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size, weight) with target: share * all sizes, dealt by weight.

    A source stops at max_epochs times its size and what it can't take is dealt again by weight, until none is above.
    That is the level at which min(cap, level * weight) adds up to the budget, found by running sums over the sources
    in the order in which they reach their caps. A weight of 0 or less takes nothing; where all caps together are below
    the budget, every source gets its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    base = sources.withColumn("cap", F.when(F.col("weight") > 0, cap).otherwise(0.0)).withColumn(
        "ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0)
    )
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.col("capped"), F.lit(0.0))) / F.col("weights")
    fits = F.col("weight") > 0
    solved = (
        base.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("capped", F.sum("cap").over(before))
        .withColumn("weights", F.sum(F.greatest("weight", F.lit(0.0))).over(after))
        # The first source in this order that the level doesn't fill fixes the level for all that follow.
        .withColumn("open", F.when(fits & (F.col("weights") > 0) & (level <= F.col("ratio")), level))
        .withColumn("level", F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ratio"))).over(everything))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.greatest("weight", F.lit(0.0))))
    return solved.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weigh=repeating_weights, share: float = SHARE, max_epochs: float = MAX_EPOCHS, cut: str = "word",
        seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, size, source_size, target, epochs, taken) of every row of docs.

    size: words of the text (null: 0); taken: words the mix takes from the row, repeats counted. weigh: function from
    (source, source_size, n_docs) to the same with weight. cut="word" takes whole words up to each target exactly, so one
    document per source may be taken in part; cut="document" takes whole documents only and ends within half a
    document of the target. Null is a source of its own. Empty texts take nothing; a source without words has target
    0. Equal keys (repeated ids) are ordered by size; repeated rows each count. Reruns give the same rows.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            random_key(F.col(id_col), seed).alias("key"),
        ),
        "sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = targets(weigh(sources), share, max_epochs).join(
        sources.select(F.col("source").alias("s"), F.ceil(F.sqrt("n_docs")).alias("ranges")), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    goal = materialise(goal.withColumnRenamed("source", "goal_source"), "targets")
    # The key is uniform, so its upper 32 bits, scaled, number the ranges without sampling.
    share_of_key = (F.shiftright("key", KEY_BITS - 32) * F.col("ranges")) / F.lit(float(1 << 32))
    placed = sized.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source").withColumn(
        "range", F.floor(share_of_key).cast("bigint")
    )
    totals = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("o_source"), F.col("range").alias("o_range"),
        F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range"))
    )
    start = F.col("ahead") + F.col("offset")
    goal_words = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(0).cast("bigint")
    left = goal_words - epochs * F.col("source_size") - start
    if cut == "word":
        part = F.greatest(F.least(left, F.col("size")), F.lit(0))
    elif cut == "document":
        part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    else:
        raise ValueError(f"cut must be 'word' or 'document', not {cut!r}")
    taken = (epochs * F.col("size") + part).cast("bigint")
    return ahead.select("doc_id", "source", "key", "size", "source_size", "target", epochs.alias("epochs"), taken.alias("taken"))


def draw(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...) as the mix takes them: whole documents, each as often as it is taken.

    A mix of whole documents is two numbers per source: the full passes, and the key up to which one more is taken. So
    the texts stay where they are and only meet a table with one row per source. Rows without words stay out. Rows with
    equal keys (repeated ids) are taken alike. All columns are kept.
    """
    plan = mix(docs, cut="document", seed=seed, **options)
    more = F.when(F.col("taken") > F.col("epochs") * F.col("size"), F.col("key"))
    ends = plan.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(more).alias("last_key"))
    ends = materialise(ends.withColumnRenamed("source", "end_source"), "source_ends")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("row_source"))
    extra = F.coalesce(random_key(F.col("row.doc_id"), seed) <= F.col("last_key"), F.lit(False)).cast("int")
    times = F.when(word_count(F.col("row.text")) > 0, F.col("epochs").cast("int") + extra).otherwise(0)
    taken = rows.join(ends, F.col("row_source").eqNullSafe(F.col("end_source"))).select("row", times.alias("times")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {KEY_BITS // 4}) AS BIGINT) AS key
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM s),
r AS (SELECT *, {MAX_EPOCHS} * source_size AS cap, {MAX_EPOCHS} * source_size / weight AS ratio,
             {SHARE} * sum(source_size) OVER () AS budget FROM w),
x AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT min_by(level, ratio) AS level FROM x WHERE level <= ratio),
t AS (SELECT x.source, source_size, CAST(least(cap, l.level * weight) AS DOUBLE) AS target FROM x, l),
p AS (SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS goal,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (goal // source_size) * size + greatest(least(goal % source_size - ahead, size), 0) END AS BIGINT) AS taken
FROM p
"""

QUERIES = {"op2_mixing": op2_mixing}
ORACLE_SQL = {"op2_mixing": OP2_SQL}
