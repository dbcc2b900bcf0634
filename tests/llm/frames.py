"""Small frames with the awkward rows every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; they must not clash.
CLASHING = "rest string, row string, spans string, items string, score string, key string, size string, id string, fp string, node string, times string, stratum string, verdict string, content string"


def words(seed: int, n: int, pool: str = "alpha beta gamma delta river stone cloud window paper light green seven") -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(pool.split()) + rng.choice(["", "s", "ing", "er", "ly"]) for _ in range(n))


def edge_rows() -> list[tuple]:
    long = words(99, 60_000)
    return [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", 4),
        (4, "short", "en", "a", 5),
        (5, "Same text here twice, really the same", "en", "b", 30),
        (5, "Same text here twice, really the same", "en", "b", 30),
        (None, "a text whose row has no id at all", "en", "b", 30),
        (7, long, "en", "a", len(long)),
        (8, "Ünïcödé — “quoted” 漢字 Straße ÀÉ", "de", None, 30),
        (9, "!!! ... ??? 123 456", "en", "c", 19),
    ]


def edge_docs(spark):
    """Ten awkward rows with columns of clashing names."""
    extra = CLASHING.split(", ")
    rows = [(*r, *["x"] * len(extra)) for r in edge_rows()]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHING}")


def no_docs(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASHING}")
