"""Paired significance tests: Poisson bootstrap, DeLong, and the ablation verdict.

Bootstrap. A row's weights in all replicates are one vector, drawn from md5(seed, block, id) where the row is read, so both models
see the same resample and a retried task draws the same numbers. No row travels once per replicate: tasks add up vectors, and
what a metric needs in order is summed over pieces of the order first, replicates side by side.

* Means of a row loss are sums of vectors: one partial row a task and replicate.
* PR-AUC adds up the vectors of equal scores (a hot score is one row a batch) and cuts the scores into ranges. Totals of the ranges
  give each range its offsets, and every range finishes its part of the curve by itself.
* Dollar recall knows from totals of position blocks which blocks lie above a replicate's cut; only the few blocks that hold a cut
  are looked into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.hashing import POISSON_TOP, md5_numbers, poisson_bounds
from ledgerspark.operators.ranking import ROWS_PER_RANGE, global_positions, range_bounds, running_totals
from ledgerspark.session import materialise

#: Most pieces of one order; larger inputs get larger pieces, since a few numbers per piece and replicate reach the driver.
MOST_PIECES = 4096


def replicate_weights(ids: Sequence[str | None], n_boot: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, rows x (n_boot + 1); column 0 is the sample itself. One md5 serves four replicates."""
    starts = [f"{seed}|{block}".encode() for block in range(-(-n_boot // 4))]
    ends = [b"" if i is None else b"|" + i.encode() for i in ids]
    numbers = md5_numbers(starts, ends)[:, :n_boot]
    bounds = np.array(poisson_bounds(POISSON_TOP), np.uint64)
    # The upper half of a number settles its draw, but for the few halves that a bound cuts.
    halves = np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)
    low, high = (np.searchsorted(bounds, h, side="right").astype(np.uint8) for h in (halves, halves + np.uint64(0xFFFF)))
    half = numbers >> 16
    drawn, cut = low[half], (low != high)[half]
    drawn[cut] = np.searchsorted(bounds, numbers[cut].astype(np.uint64), side="right")
    out = np.ones((len(ends), n_boot + 1), np.uint8)
    out[:, 1:] = drawn
    return out


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(df with its keys as one text column _key, table of the keys by that text); keys are names, never data-sized."""
    text = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    df = df.withColumn("_key", text)
    return df, df.select("_key", *keys).distinct()


def _spread(df: DataFrame) -> DataFrame:
    """Narrow rows dealt to all cores: drawing a row's weights takes far longer than moving the row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _groups(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(code, positions that have it)."""
    order = np.argsort(codes, kind="stable")
    own = codes[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    yield from zip(own[first].tolist(), np.split(order, first[1:]))


def _grouped(codes: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(code, sum of the rows of values with that code)."""
    order = np.argsort(codes, kind="stable")
    own = codes[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    if len(first) == 1:
        yield int(own[0]), values.sum(axis=0)
    elif len(first):
        yield from zip(own[first].tolist(), np.add.reduceat(values[order], first, axis=0))


def _summed(df: DataFrame, pieces: Sequence[str], columns: Mapping[str, Column], id_col: str, n_boot: int, seed: int) -> DataFrame:
    """(_key, model, piece, replicate, sums): replicate-weighted sums of the columns by key and piece.

    pieces: a column of piece numbers for each model; a row without one is not in that model's order. Each task hands on one row a
    key, model, piece and replicate that it saw.
    """
    names = list(columns)
    narrow = df.select("_key", F.col(id_col).cast("string").alias("_id"), *[F.col(p).cast("bigint").alias(f"_p{k}") for k, p in enumerate(pieces)],
                       *[c.cast("double").alias(n) for n, c in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            key = batch.column(0).dictionary_encode()
            w = replicate_weights(batch.column(1).to_pylist(), n_boot, seed).astype(float)
            values = np.stack([np.nan_to_num(batch.column(2 + len(pieces) + k).to_numpy(zero_copy_only=False)) for k in range(len(names))])
            for model in range(len(pieces)):
                piece = batch.column(2 + model)
                own = np.flatnonzero(np.asarray(piece.is_valid()))
                number = piece.fill_null(0).to_numpy()[own]
                for code, rows in _groups(number * len(key.dictionary) + key.indices.to_numpy()[own]):
                    place = key.dictionary[code % len(key.dictionary)].as_py(), model, code // len(key.dictionary)
                    sums[place] = sums.get(place, 0) + (values[:, own[rows]] @ w[own[rows]]).ravel()
        n = n_boot + 1
        for (text, model, number), part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([text] * n), pa.array([model] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), *map(pa.array, part.reshape(-1, n))],
                ["_key", "model", "piece", "replicate", *names])

    parts = narrow.mapInArrow(run, "_key string, model int, piece bigint, replicate int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("_key", "model", "piece", "replicate").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_summary(reps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(replicate, base, treat) -> observed delta, 95 % interval, two-sided p, significance.

    n_boot rows per key: the quantiles run on that many values.
    """
    both = reps.withColumn("delta", F.col("treat") - F.col("base"))
    seen, drawn = F.col("replicate") == 0, F.when(F.col("replicate") > 0, F.col("delta"))
    share = lambda cond: F.avg(F.when(F.col("replicate") > 0, F.when(cond, 1.0).otherwise(0.0)))
    out = both.groupBy(*keys).agg(
        F.max(F.when(seen, F.col("base"))).alias("base"),
        F.max(F.when(seen, F.col("treat"))).alias("treatment"),
        F.max(F.when(seen, F.col("delta"))).alias("delta"),
        F.percentile(drawn, 0.025).alias("ci_low"),
        F.percentile(drawn, 0.975).alias("ci_high"),
        F.least(F.lit(1.0), F.lit(2.0) * F.least(share(F.col("delta") <= 0), share(F.col("delta") >= 0))).alias("p_value"),
    )
    return out.withColumns({
        **{c: F.round(c, 4) for c in ("base", "treatment", "delta", "p_value")},
        "significant": (F.col("ci_low") > 0) | (F.col("ci_high") < 0),
        "ci_low": F.round("ci_low", 4),
        "ci_high": F.round("ci_high", 4),
    })


def paired_bootstrap(
    df: DataFrame,
    loss: Callable[[str], Column],
    base: str,
    treat: str,
    id_col: str = "id",
    n_boot: int = 150,
    seed: int = 42,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Bootstrap of the mean of a row loss: loss(score column) -> Column. Rows without both losses are left out."""
    return paired_bootstraps(df, [(loss, base, treat)], id_col, n_boot, seed, keys)[0]


def paired_bootstraps(
    df: DataFrame, losses: Sequence[tuple[Callable[[str], Column], str, str]], id_col: str = "id", n_boot: int = 150, seed: int = 42,
    keys: Sequence[str] = (),
) -> list[DataFrame]:
    """The same for several (loss, base, treat), whose rows draw their weights once."""
    rows, names = _keyed(df, keys)
    columns = {}
    for k, (loss, base, treat) in enumerate(losses):
        known = loss(base).isNotNull() & loss(treat).isNotNull()
        columns |= {f"_w{k}": F.when(known, 1.0), f"_b{k}": F.when(known, loss(base)), f"_t{k}": F.when(known, loss(treat))}
    rows = rows.withColumns({**columns, "piece": F.lit(0).cast("bigint")}).filter(F.coalesce(*[f"_w{k}" for k in range(len(losses))]).isNotNull())
    rows = _spread(rows.select("_key", id_col, *columns, "piece"))
    sums = _summed(rows, ["piece"], {c: F.col(c) for c in columns}, id_col, n_boot, seed)
    if len(losses) > 1:
        sums = materialise(sums, "bootstrap_sums")
    out = []
    for k in range(len(losses)):
        seen = sums
        if len(losses) > 1:
            # A key all of whose rows lack this loss has no sample.
            whole = F.max(F.when(F.col("replicate") == 0, F.col(f"_w{k}"))).over(Window.partitionBy("_key"))
            seen = sums.withColumn("_whole", whole).filter("_whole > 0")
        reps = seen.select("_key", "replicate", F.try_divide(f"_b{k}", f"_w{k}").alias("base"), F.try_divide(f"_t{k}", f"_w{k}").alias("treat"))
        out.append(bootstrap_summary(reps.join(names, "_key"), keys))
    return out


def weighted_brier(y: str) -> Callable[[str], Column]:
    return lambda p: (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))


def weighted_mae(y: str) -> Callable[[str], Column]:
    return lambda p: F.abs(F.col(p) - F.col(y))


def _by_model(parts: DataFrame, names: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(_key, model, replicate, value) -> summary."""
    reps = parts.groupBy("_key", "replicate").agg(
        F.max(F.when(F.col("model") == 0, F.col(value))).alias("base"), F.max(F.when(F.col("model") == 1, F.col(value))).alias("treat"))
    return bootstrap_summary(reps.join(names, "_key"), keys)


def _packed(vectors: np.ndarray) -> list[bytes]:
    """Rows of counts, a byte each where they fit."""
    kind = np.uint8 if vectors.max(initial=0) < 256 else np.dtype("<u4")
    return [row.tobytes() for row in vectors.astype(kind)]


def _unpacked(column: pa.Array, n: int) -> np.ndarray:
    values = column.to_pylist()
    out = np.empty((len(values), n), np.int64)
    for i, v in enumerate(values):
        out[i] = np.frombuffer(v, np.uint8 if len(v) == n else "<u4")
    return out


_CELL = "_key string, model int, piece int, score double, pos binary, seen binary"


def _cells(cuts: Mapping[tuple[str, int], np.ndarray], n_boot: int, seed: int):
    """Rows of equal score of a batch as one: weight vectors of the positive rows and of all; piece: range of the score, highest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = replicate_weights(batch.column(1).to_pylist(), n_boot, seed).astype(np.int64)
            key = np.array(batch.column(0).to_pylist(), object)
            y = batch.column(2).to_numpy(zero_copy_only=False) == 1
            for k in dict.fromkeys(key.tolist()):
                for model in (0, 1):
                    score = batch.column(3 + model).to_numpy(zero_copy_only=False)
                    own = np.flatnonzero((key == k) & ~np.isnan(score))
                    if not len(own):
                        continue
                    own = own[np.argsort(score[own], kind="stable")]
                    first = np.flatnonzero(np.r_[True, score[own][1:] != score[own][:-1]])
                    pos, seen = (np.add.reduceat(v, first, axis=0) for v in (w[own] * y[own, None], w[own]))
                    value = score[own][first]
                    edges = cuts.get((k, model), np.zeros(0))
                    piece = len(edges) - np.searchsorted(edges, value, side="right")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(first)), pa.array(np.full(len(first), model, np.int32)), pa.array(piece.astype(np.int32)), pa.array(value),
                         pa.array(_packed(pos), pa.binary()), pa.array(_packed(seen), pa.binary())], ["_key", "model", "piece", "score", "pos", "seen"])

    return run


def _range_totals(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            key = batch.column(0).dictionary_encode()
            model, piece = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
            both = np.concatenate([_unpacked(batch.column(k), n) for k in (3, 4)], axis=1)
            for code, part in _grouped((piece * 2 + model) * len(key.dictionary) + key.indices.to_numpy(), both):
                rest, at = divmod(code, len(key.dictionary))
                place = key.dictionary[at].as_py(), rest % 2, rest // 2
                sums[place] = sums.get(place, 0) + part
        for (text, model, piece), part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([text] * n), pa.array([model] * n, pa.int32()), pa.array([piece] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(part[:n]), pa.array(part[n:])],
                ["_key", "model", "piece", "replicate", "pos", "seen"])

    return run


def _curves(offsets: Mapping[tuple, np.ndarray], n: int):
    """Each range's part of the average precision; reads key, model and piece together, scores downward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, score, total = None, None, np.zeros(n)
        pos = seen = done_pos = done_seen = np.zeros(n)

        def point() -> None:
            """The curve's point at the score that is complete now."""
            nonlocal done_pos, done_seen, total
            done_pos, done_seen = done_pos + pos, done_seen + seen
            total = total + pos * np.divide(done_pos, done_seen, out=np.zeros(n), where=done_seen > 0)

        def part() -> pa.RecordBatch:
            key, model, _ = place
            return pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([model] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(total)], ["_key", "model", "replicate", "part"])

        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            values = batch.column(3).to_pylist()
            cells = [_unpacked(batch.column(k), n) for k in (4, 5)]
            for i, (p, v) in enumerate(zip(places, values)):
                if p != place or v != score:
                    if score is not None:
                        point()
                    if p != place:
                        if place is not None:
                            yield part()
                        place, total = p, np.zeros(n)
                        done_pos, done_seen = offsets[p]
                    score, pos, seen = v, np.zeros(n), np.zeros(n)
                pos, seen = pos + cells[0][i], seen + cells[1][i]
        if place is not None:
            point()
            yield part()

    return run


def bootstrap_pr_auc(
    df: DataFrame, base: str, treat: str, y: str = "y", id_col: str = "id", n_boot: int = 150, seed: int = 42,
    keys: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """PR-AUC delta. A replicate with one class only has no value and counts as none. Rows without a score have no place on its curve."""
    n = n_boot + 1
    rows, names = _keyed(df.select(*keys, id_col, y, F.col(base).cast("double").alias("_b"), F.col(treat).cast("double").alias("_t")), keys)
    rows = materialise(_spread(rows), "bootstrap_rows")
    size = max(rows_per_range, -(-rows.count() // MOST_PIECES))
    cuts = {}
    for model, score in enumerate(("_b", "_t")):
        cuts |= {(k[0], model): np.array(v) for k, v in range_bounds(rows, score, ["_key"], size).items()}
    narrow = rows.select("_key", F.col(id_col).cast("string"), F.col(y).cast("int"), "_b", "_t")
    cells = materialise(narrow.mapInArrow(_cells(cuts, n_boot, seed), _CELL), "bootstrap_cells")
    schema = "_key string, model int, piece int, replicate int, pos bigint, seen bigint"
    totals = cells.select("_key", "model", "piece", "pos", "seen").mapInArrow(_range_totals(n), schema).groupBy("_key", "model", "piece", "replicate").agg(
        F.sum("pos").alias("pos"), F.sum("seen").alias("seen"))
    every = Window.partitionBy("_key", "model", "replicate")
    above = every.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(totals.select("_key", "model", "piece", "replicate", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in ("pos", "seen")],
                                       *[F.sum(c).over(every).alias(f"all_{c}") for c in ("pos", "seen")]), "bootstrap_offsets")
    offsets: dict[tuple, np.ndarray] = {}
    for r in placed.toLocalIterator():  # at most MOST_PIECES pieces a key and model
        offsets.setdefault((r["_key"], r["model"], r["piece"]), np.zeros((2, n)))[:, r["replicate"]] = r["above_pos"], r["above_seen"]
    ordered = cells.repartition("_key", "model", "piece").sortWithinPartitions("_key", "model", "piece", F.desc("score"))
    parts = ordered.mapInArrow(_curves(offsets, n), "_key string, model int, replicate int, part double")
    size_of = placed.groupBy("_key", "model", "replicate").agg(F.max("all_pos").alias("p"), F.max("all_seen").alias("s"))
    whole = parts.groupBy("_key", "model", "replicate").agg(F.sum("part").alias("part")).join(size_of, ["_key", "model", "replicate"])
    value = F.when((F.col("p") > 0) & (F.col("p") < F.col("s")), F.col("part") / F.col("p"))
    return _by_model(whole.withColumn("value", value), names, "value", keys)


def _cut_blocks(room: Mapping[tuple, np.ndarray], n_boot: int, seed: int):
    """Dollars above the cut in blocks that hold one; room: weight that fits, by block and replicate. Reads blocks in order of position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, left, usd = None, None, None

        def part() -> pa.RecordBatch:
            n = n_boot + 1
            return pa.RecordBatch.from_arrays([pa.array([place[0]] * n), pa.array([place[1]] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(usd)], ["_key", "model", "replicate", "usd"])

        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            w = replicate_weights(batch.column(3).to_pylist(), n_boot, seed).astype(float)
            dollars = np.nan_to_num(batch.column(4).to_numpy(zero_copy_only=False))
            starts = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(places)]):
                if places[a] != place:
                    if place is not None:
                        yield part()
                    place, left, usd = places[a], room[places[a]].copy(), np.zeros(n_boot + 1)
                before = np.cumsum(w[a:b], axis=0) - w[a:b]
                usd += (np.clip(left - before, 0, w[a:b]) * dollars[a:b, None]).sum(axis=0)
                left -= w[a:b].sum(axis=0)
        if place is not None:
            yield part()

    return run


def bootstrap_dollar_recall(
    df: DataFrame, dollars: str, base: str, treat: str, k_frac: float = 0.10, id_col: str = "id",
    n_boot: int = 150, seed: int = 42, keys: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Dollar-recall delta. A replicate's top k counts weighted rows; the row at the cut counts in part.

    The order of the rows does not change between replicates, so each model is positioned once.
    """
    rows, names = _keyed(df.select(*keys, id_col, dollars, base, treat), keys)
    rows = materialise(rows.withColumnRenamed(dollars, "usd"), "bootstrap_rows")
    size = max(rows_per_range, -(-rows.count() // MOST_PIECES))
    placed = rows
    for model, score in enumerate((base, treat)):
        kept = placed.filter(F.col(score).isNull()).withColumn(f"_place{model}", F.lit(None).cast("bigint"))
        ranked = global_positions(placed, score, id_col, f"_place{model}", keys=["_key"], rows_per_range=rows_per_range).drop("n_rows")
        placed = ranked.withColumn(f"_place{model}", F.col(f"_place{model}").cast("bigint")).unionByName(kept)
        if model == 0:
            placed = materialise(placed, "bootstrap_places")
    placed = materialise(_spread(placed.select("_key", id_col, "usd", *[c for m in (0, 1) for c in (f"_place{m}", F.expr(f"(_place{m} - 1) div {size}").alias(f"_block{m}"))])), "bootstrap_places")
    sums = _summed(placed, ["_block0", "_block1"], {"w": F.lit(1.0), "usd": F.col("usd")}, id_col, n_boot, seed)
    by = Window.partitionBy("_key", "model", "replicate")
    upto = by.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = materialise(sums.withColumnRenamed("piece", "block").select(
        "_key", "model", "block", "replicate", "w", "usd", F.sum("w").over(upto).alias("upto"), F.sum("usd").over(by).alias("all_usd"),
        F.greatest(F.lit(1.0), F.ceil(F.lit(k_frac) * F.sum("w").over(by))).alias("k")), "bootstrap_blocks")
    above, cut = F.col("upto") <= F.col("k"), (F.col("upto") > F.col("k")) & (F.col("upto") - F.col("w") < F.col("k"))
    held = state.filter(cut).select("_key", "model", "block").distinct()  # a block a key, model and replicate at most
    room: dict[tuple, np.ndarray] = {}
    for r in state.join(held, ["_key", "model", "block"]).withColumn("room", F.col("k") - F.col("upto") + F.col("w")).toLocalIterator():
        room.setdefault((r["_key"], r["model"], r["block"]), np.zeros(n_boot + 1))[r["replicate"]] = r["room"]
    sides = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_block{m}").alias("block"), F.col(f"_place{m}").alias("_place")) for m in (0, 1)])
    long = placed.select("_key", F.col(id_col).cast("string").alias("_id"), F.col("usd").cast("double").alias("usd"), F.inline(sides))
    inside = long.join(held, ["_key", "model", "block"]).select("_key", "model", "block", "_id", "usd", "_place")
    inside = inside.repartition("_key", "model", "block").sortWithinPartitions("_key", "model", "block", "_place").drop("_place")
    partly = inside.mapInArrow(_cut_blocks(room, n_boot, seed), "_key string, model int, replicate int, usd double")
    whole = state.join(held, ["_key", "model", "block"], "left_anti").filter(above).select("_key", "model", "replicate", "usd")
    got = whole.unionByName(partly).groupBy("_key", "model", "replicate").agg(F.sum("usd").alias("got"))
    total = state.groupBy("_key", "model", "replicate").agg(F.max("all_usd").alias("total"))
    value = F.try_divide(F.coalesce("got", F.lit(0.0)), F.col("total"))
    return _by_model(total.join(got, ["_key", "model", "replicate"], "left").withColumn("value", value), names, "value", keys)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal, z >= 0, by Zelen and Severo's polynomial (error below 1e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    # Coefficients of the published approximation.
    coef = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly, power = F.lit(0.0), t
    for c in coef:
        poly, power = poly + F.lit(c) * power, power * t
    return F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly


def delong_test(
    df: DataFrame, y: str = "y", base: str = "p_base", treat: str = "p_treat", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Two correlated AUCs: delta, z, p. Significant when p < .05 and delta > 0.

    The placement of a row is the share of the other class below it (ties half), which comes from the
    running class counts of its score; the covariances of the placements are plain aggregates over
    pre-grouped (class, base score, treat score) rows.
    """
    cells = df.groupBy(F.col(y).cast("int").alias("y"), F.col(base).alias("sb"), F.col(treat).alias("st")).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    places = []
    for score, name in (("sb", "vb"), ("st", "vt")):
        pos = F.when(F.col("y") == 1, F.col("w")).otherwise(F.lit(0.0))
        neg = F.when(F.col("y") == 1, F.lit(0.0)).otherwise(F.col("w"))
        t = running_totals(cells, score, {"pos": pos, "neg": neg}, rows_per_range=rows_per_range)
        places.append(t.select(
            score,
            # For a positive: share of negatives below. For a negative: share of positives above.
            F.try_divide(F.col("cum_neg") - F.col("neg") / 2, F.col("tot_neg")).alias(f"{name}1"),
            F.try_divide(F.col("tot_pos") - F.col("cum_pos") + F.col("pos") / 2, F.col("tot_pos")).alias(f"{name}0"),
        ))
    rows = cells.join(places[0], "sb").join(places[1], "st")
    v = {m: F.when(F.col("y") == 1, F.col(f"{m}1")).otherwise(F.col(f"{m}0")) for m in ("vb", "vt")}
    rows = rows.select("y", "w", v["vb"].alias("vb"), v["vt"].alias("vt"), (v["vt"] - v["vb"]).alias("d"))
    w = F.col("w")
    per = rows.groupBy("y").agg(
        F.sum(w).alias("n"), (F.sum(w * F.col("vb")) / F.sum(w)).alias("mb"), (F.sum(w * F.col("vt")) / F.sum(w)).alias("mt"),
        # var(treat - base) = var + var - 2 cov, with the differences summed directly.
        ((F.sum(w * F.col("d") * F.col("d")) - F.sum(w * F.col("d")) * F.sum(w * F.col("d")) / F.sum(w)) / (F.sum(w) - 1)).alias("vd"),
    )
    one = per.agg(
        F.max(F.when(F.col("y") == 1, F.col("mb"))).alias("auc_base"),
        F.max(F.when(F.col("y") == 1, F.col("mt"))).alias("auc_treatment"),
        F.sum(F.col("vd") / F.col("n")).alias("var"),
    )
    delta = F.col("auc_treatment") - F.col("auc_base")
    z = F.when(F.col("var") > 1e-18, delta / F.sqrt("var")).otherwise(F.lit(0.0))
    p = F.when(F.col("var") > 1e-18, F.lit(2.0) * normal_sf(F.abs(z))).otherwise(F.lit(1.0))
    return one.select(
        F.round("auc_base", 4).alias("auc_base"), F.round("auc_treatment", 4).alias("auc_treatment"),
        F.round(delta, 4).alias("delta"), F.round(z, 4).alias("z"), F.round(p, 4).alias("p_value"),
        ((p < 0.05) & (delta > 0)).alias("significant"),
    )


def segments(df: DataFrame, recurring: Column) -> DataFrame:
    """Rows labelled overall, and once more as recurring where the condition holds. Row-local."""
    names = F.array_compact(F.array(F.lit("overall"), F.when(recurring, F.lit("recurring"))))
    return df.withColumn("segment", F.explode(names))


def ablation_metrics(
    df: DataFrame, y: str, loss: str, p_base: str, p_treat: str, e_base: str, e_treat: str, id_col: str,
    n_boot: int = 150, seed: int = 42, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """(segment, metric, base, treatment, delta, interval, p, significant) for the four paired metrics."""
    keys = ["segment"]
    losses = [(weighted_brier(y), p_base, p_treat), (weighted_mae(loss), e_base, e_treat)]
    by_brier, by_mae = paired_bootstraps(df, losses, id_col, n_boot, seed, keys)
    parts: Mapping[str, DataFrame] = {
        "pr_auc": bootstrap_pr_auc(df, p_base, p_treat, y, id_col, n_boot, seed, keys, rows_per_range),
        "dollar_recall_top10pct": bootstrap_dollar_recall(
            df, loss, e_base, e_treat, 0.10, id_col, n_boot, seed, keys, rows_per_range),
        "brier": by_brier,
        "expected_loss_mae": by_mae,
    }
    out = None
    for name, part in parts.items():
        part = part.withColumn("metric", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def ablation_verdict(metrics: DataFrame) -> DataFrame:
    """Per segment: better on PR-AUC or dollar recall, and no material loss elsewhere."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    better = lambda m: F.coalesce((pick(m, "delta") > 0) & pick(m, "significant"), F.lit(False))
    pr, rec = better("pr_auc"), better("dollar_recall_top10pct")
    brier_ok = pick("brier", "delta") <= 0.005
    mae_ok = pick("expected_loss_mae", "delta") <= 0.01 * F.abs(pick("expected_loss_mae", "base"))
    return metrics.groupBy("segment").agg(
        pr.alias("improves_pr_auc"), rec.alias("improves_dollar_recall"),
        brier_ok.alias("no_material_brier_degradation"), mae_ok.alias("no_material_mae_degradation"),
        ((pr | rec) & brier_ok & mae_ok).alias("good_enough"),
    )

