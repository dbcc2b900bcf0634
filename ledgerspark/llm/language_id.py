"""Language identification by error-correcting output codes over character n-grams.

Each learned language gets a codeword. One binary classifier per code bit (ridge-penalised logistic regression over hashed
byte n-grams) predicts that bit from the text. Decoding takes the codeword with the smallest loss, each bit weighted by
how well its classifier separated the training rows, so a weak bit can be outvoted. A small lead over the next codeword
flags the row as ambiguous.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C

FOLDS = 3
HELD_OUT = 1
#: Labelled rows per language that the fit uses, taken in hash order; all other work covers every row.
ROWS_PER_LANGUAGE = 800
#: Rows of all languages together: some 130 MB on the driver. With very many languages LEAST_ROWS of each go beyond it.
MAX_ROWS = 6400
LEAST_ROWS = 16
BUCKETS = 4096
NGRAMS = (2, 3, 4)
ROUNDS = 300
STEP = 2.0
PENALTY = 1e-4
MARGIN = 0.1
UNDECIDED = "und"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams of the text, other than letters blanked; unit length."""
    words = text.translate(_FOLD).lower().split()
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    counts = np.zeros(buckets)
    for start in range(0, len(raw), 1 << 20):  # whole text in bounded pieces that overlap by the longest n-gram
        piece = raw[start : start + (1 << 20) + max(NGRAMS) - 1].astype(np.uint32)
        for n in NGRAMS:
            size = min(len(piece) - n + 1, 1 << 20)
            if size <= 0:
                continue
            h = np.full(size, n * 0x1B873593 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ piece[k : k + size]) * np.uint32(_FACTORS[k])
                h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32(buckets - 1), minlength=buckets)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 / -1. Up to seven languages: every split into two parts once; above: random columns, far apart."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        rest = itertools.product((1.0, -1.0), repeat=k - 1)
        return np.array([(1.0, *r) for r in rest if min(r) < 0]).T
    rng, bits = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(k)))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice((1.0, -1.0), (k, bits))
        apart = (bits - code @ code.T)[~np.eye(k, dtype=bool)].min() / 2
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding, adds up to 1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability-like score and its lead, per row of x."""
        margin = x @ self.weights + self.bias
        # A bit's loss has one of two values, so two products cover all codewords, however many there are.
        loss = sum((np.log1p(np.exp(-np.clip(side * margin, -30, 30))) * self.trust) @ (self.code == side).T for side in (1, -1))
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(-self.code.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        rows = np.arange(len(x))
        best = share[rows, order[:, 0]]
        lead = best - share[rows, order[:, 1]] if len(self.languages) > 1 else best
        return order[:, 0], best, lead


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """All bit classifiers at once, by gradient steps with momentum; rows weigh the same per language."""
    code = codewords(len(languages))
    # One type throughout, or every product copies x.
    target = code[y].astype(x.dtype)
    weight = (1.0 / np.bincount(y, minlength=len(languages))[y] / len(languages)).astype(x.dtype)
    w, b = np.zeros((x.shape[1], code.shape[1]), x.dtype), np.zeros(code.shape[1], x.dtype)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(ROUNDS):
        pull = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * weight[:, None]
        vw = (0.9 * vw - STEP * (x.T @ pull + PENALTY * w)).astype(x.dtype)
        vb = (0.9 * vb - STEP * pull.sum(axis=0)).astype(x.dtype)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * target > 0).astype(float)
    accuracy = np.clip((right * weight[:, None]).sum(axis=0), 0.5, 0.999)
    trust = np.log(accuracy / (1 - accuracy)) + 1e-6
    return Model(languages, code, w, b, trust / trust.sum())


def _feature_rows(most: int):
    """Features of the chosen rows; a task gives at most `most` rows of a language, also where a row is repeated very often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            keep = []
            for i, name in enumerate(batch.column(0).to_pylist()):
                seen[name] += 1
                if seen[name] <= most:
                    keep.append(i)
            own = batch.take(pa.array(keep, pa.int64()))
            rows = [features(t or b"").astype("<f4").tobytes() for t in C.as_bytes(own.column(1))]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(rows, pa.binary())], ["lang", "draw", "x"])

    return run


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model | None:
    """Model from rows with a label and a letter outside the held-out fold; None if there are none.

    Every language is learned, however rare. The driver gets at most `rows_per_language` feature vectors of 16 KB for each,
    and at most MAX_ROWS together or LEAST_ROWS of each language if that is more.
    """
    C.bounded_batches(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).where(
        C.fold_of(F.col(id_col), FOLDS) != HELD_OUT
    )
    # Counted first: the share to read per language follows, so no language is sorted or gathered in one task.
    usable = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    sizes = usable.groupBy("lang").count().collect()
    if not sizes:
        return None
    most = min(rows_per_language, max(LEAST_ROWS, MAX_ROWS // len(sizes)))
    draw = F.pmod(F.xxhash64(F.lit("language"), "id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.select("lang", "text", draw.alias("draw"))

    def up_to(last: list[tuple[str, float]]) -> DataFrame:
        """Rows drawn up to the last draw of their language."""
        table = docs.sparkSession.createDataFrame(last, "lang string, last double")
        return drawn.join(F.broadcast(table), "lang").where("draw <= last").select("lang", "text", "draw")

    # Twice the rows wanted are looked at where there are enough; their draws alone tell where to cut.
    draws = up_to([(name, min(1.0, 2 * most / n)) for name, n in sizes]).groupBy("lang", "draw").count().collect()
    taken, last = Counter(), {}
    for r in sorted(draws, key=lambda r: r.draw):
        if taken[r.lang] < most:
            taken[r.lang], last[r.lang] = taken[r.lang] + r["count"], r.draw
    found = up_to(list(last.items())).mapInArrow(_feature_rows(most), "lang string, draw double, x binary").collect()
    rows, used = [], Counter()
    for r in sorted(found, key=lambda r: (r.lang, r.draw, bytes(r.x))):
        used[r.lang] += 1
        if used[r.lang] <= most:
            rows.append(r)
    languages = sorted({r.lang for r in rows})
    x = np.array([np.frombuffer(r.x, "<f4") for r in rows])
    place = {name: k for k, name in enumerate(languages)}
    y = np.array([place[r.lang] for r in rows])
    order = np.lexsort((*x.T[:8], y))  # the fit doesn't depend on the order in which rows arrive
    return fit(x[order], y[order], languages)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row of docs, from the text alone.

    score: 0 to 1; ambiguous: the lead over the next language is below `margin`. Null and empty texts, texts without a
    letter, and all rows where nothing was learned get `und`, score 0 and no ambiguity. Repeated rows each count.
    """
    C.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = C.as_bytes(batch.column(1))
            usable = [own is not None and has_letter(t and t.decode()) for t in texts]
            names, scores, doubt = [UNDECIDED] * len(texts), [0.0] * len(texts), [False] * len(texts)
            places = [i for i, ok in enumerate(usable) if ok]
            for at in range(0, len(places), 256):
                rows = places[at : at + 256]
                best, score, lead = own.decode(np.array([features(texts[i]) for i in rows]))
                for i, k, s, gap in zip(rows, best.tolist(), score.tolist(), lead.tolist()):
                    names[i], scores[i], doubt[i] = own.languages[k], min(1.0, s), gap < margin
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held_out = (C.fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return identify(docs, train(docs)).select("doc_id", held_out, "lang_pred", "score", "ambiguous")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL: dict[str, str] = {}
