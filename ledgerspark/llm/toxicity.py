"""Toxicity scores by a counterfactually regularised classifier.

A logistic regression over the presence of words and of proper word beginnings is fitted to labelled texts. For labelled
texts that mention an identity group, a copy is made with the term swapped for another one of its kind, and the fit
penalises the squared change of the score between the two. So the classifier can't lean on which group is named, and
neutral mentions don't raise the score of one group over another.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C

FOLDS = 4
HELD_OUT = 2
CUTOFF = 0.3
#: Labelled rows of each class that the fit uses, taken in hash order; scoring covers every row.
ROWS_PER_CLASS = 4000
FEATURES = 1500
MIN_ROWS = 3
PREFIXES = range(3, 9)
ROUNDS = 400
STEP = 0.5
RIDGE = 1e-4
COUNTERFACTUAL = 10.0
#: Words a worker remembers the features of.
CACHED_WORDS = 100_000

#: Terms of one line name groups of one kind and may stand for each other.
IDENTITY_TERMS = (
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"), ("male", "female"), ("father", "mother"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "hispanic"), ("african", "european", "american", "arab", "mexican", "chinese"),
    ("young", "old", "elderly"), ("deaf", "blind", "disabled"), ("immigrant", "native"), ("immigrants", "natives"),
    ("homme", "femme"), ("hommes", "femmes"), ("mann", "frau"), ("männer", "frauen"), ("hombre", "mujer"), ("hombres", "mujeres"),
)
_SWAPS = {term: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, term in enumerate(group)}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of_word(word: str) -> list[str]:
    """The word, and its beginnings that are shorter than it."""
    return [word, *(word[:k] + "+" for k in PREFIXES if k < len(word))]


def swapped(words: set[str]) -> set[str] | None:
    """The words with every identity term replaced by the next of its kind; None if there is none."""
    return {_SWAPS.get(w, w) for w in words} if not words.isdisjoint(_SWAPS) else None


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, words: set[str], cache: dict[str, tuple]) -> float:
        """cache: features with a weight of words seen before; the caller bounds it."""
        seen: set[str] = set()
        for w in words:
            found = cache.get(w)
            if found is None:
                found = cache[w] = tuple(f for f in features_of_word(w) if f in self.weights)
            if found:
                seen.update(found)
        z = self.bias + sum(self.weights[f] for f in sorted(seen))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias; change: rows of features lost (-1) and won (+1) by a swap, whose effect is penalised."""
    b = float(np.log((weight @ y + 1e-9) / (weight @ (1 - y) + 1e-9)))
    y, weight, change = (v.astype(x.dtype) for v in (y, weight, change))  # one type, or every product copies x
    w = np.zeros(x.shape[1], x.dtype)
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(ROUNDS):
        pull = weight * (1 / (1 + np.exp(-np.clip(x @ w + x.dtype.type(b), -30, 30))) - y)
        grad = pull @ x + x.dtype.type(RIDGE) * w
        if len(change):
            # Each swap's pull is kept below the step at which the descent would swing.
            size = np.maximum(1.0, (change**2).sum(axis=1))
            grad = grad + x.dtype.type(min(penalty, 1.0) / len(change)) * (((change @ w) / size) @ change)
        vw, vb = (0.9 * vw - STEP * grad).astype(x.dtype), 0.9 * vb - STEP * float(pull.sum())
        w, b = w + vw, b + vb
    if len(change) and penalty > 1.0:
        w = _settle(w.astype(np.float64), change.astype(np.float64), penalty)
    return w, b


def _settle(w: np.ndarray, change: np.ndarray, penalty: float) -> np.ndarray:
    """The weights nearest to w under the whole penalty: argmin |v - w|^2 + penalty * mean (change v)^2."""
    part = np.flatnonzero(np.abs(change).any(axis=0))
    c = change[:, part]
    out = w.copy()
    out[part] = np.linalg.solve(np.eye(len(part)) + penalty * (c.T @ c) / len(c) * len(part), w[part])
    return out


def _stated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (feature, bad, good): documents of either class with the feature, counted per batch."""
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label].update({f for w in words_of(text) for f in features_of_word(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())],
            ["feature", "bad", "good"],
        )


def _encoded(index: dict[str, int]):
    def numbers(words: set[str]) -> list[int]:
        return sorted({index[f] for w in words for f in features_of_word(w) if f in index})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                swap = swapped(words)
                own.append(numbers(words))
                other.append(None if swap is None else numbers(swap))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, kind), pa.array(other, kind)], ["label", "own", "other"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, penalty: float = COUNTERFACTUAL, n_features: int = FEATURES,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most `rows_per_class` labelled rows of each class; without both classes, a model of the base rate.

    Rows of the held-out fold are not read. Of several labels of a document the larger counts; null labels, other values
    and labels of unknown documents are ignored.
    """
    C.bounded_batches(docs.sparkSession)
    given = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id"))
    usable = given.agg(F.max(label_col).cast("int").alias("label")).where(C.fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    draw = F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string"))
    sizes = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model({}, 30.0 if sizes.get(1) else -30.0)
    # Ids are drawn first, from the labels alone, so the texts of other rows are not moved.
    drawn = None
    for label in (0, 1):
        part = usable.where(F.col("label") == label).orderBy(draw, "doc_id").limit(rows_per_class).select(F.col("doc_id").alias("label_id"), "label")
        drawn = part if drawn is None else drawn.unionByName(part)
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(
        F.broadcast(drawn), F.col("doc_id") == F.col("label_id")  # at most 2 * rows_per_class ids
    ).select("text", "label")
    counted = sample.mapInArrow(C.tidied(_stated), "feature string, bad bigint, good bigint").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    n = {k: min(v, rows_per_class) for k, v in sizes.items()}
    gap = F.col("bad") / n[1] - F.col("good") / n[0]
    spread = F.sqrt((F.col("bad") + 1) / n[1] ** 2 + (F.col("good") + 1) / n[0] ** 2)
    top = counted.where((F.col("bad") >= MIN_ROWS) & (gap > 0)).orderBy(F.desc(gap / spread), "feature").limit(n_features).select("feature").collect()
    names = sorted({r.feature for r in top} | set(_SWAPS))
    rows = sample.mapInArrow(C.tidied(_encoded({f: i for i, f in enumerate(names)})), "label int, own array<int>, other array<int>").collect()
    rows.sort(key=lambda r: (r.label, r.own, r.other or []))
    if len({r.label for r in rows}) < 2:
        return Model({}, 30.0 if rows and rows[0].label else -30.0)
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        x[i, r.own] = 1
    y = np.array([r.label for r in rows], np.float64)
    share = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    pairs = [(i, r.other) for i, r in enumerate(rows) if r.other is not None]
    change = np.zeros((len(pairs), len(names)))
    for k, (i, other) in enumerate(pairs):
        change[k] -= x[i]
        change[k, other] += 1
    w, b = fit(x, y, share / share.sum(), change[np.abs(change).any(axis=1)], penalty)
    return Model({f: float(v) for f, v in zip(names, w) if v}, float(b))


def score(docs: DataFrame, model: Model, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the cutoff on), from the text alone: (doc_id, score, predicted).

    Null and empty texts and texts without letters get the score of a text without any known feature. Repeated rows each count.
    """
    C.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                scores.append(own.score(words_of(text), cache))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = narrow.mapInArrow(C.tidied(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that score below the cutoff, all columns kept.

    The score is a function of the text only and is computed while the rows stream by: no join, no shuffle of texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            keep = []
            for text in batch.column(1).to_pylist():
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                keep.append(own.score(words_of(text), cache) < cutoff)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rest = packed.schema["rest"].dataType.simpleString()
    kept = packed.mapInArrow(C.tidied(run), f"rest {rest}, text string")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs, C.table(spark, sf_dir, "labels"))
    held_out = (C.fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
