"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items form one automaton (a state stands for all word sequences that end at the same places of the
items). Each document streams its words through it, keeping the longest suffix that occurs in some item. Where that
length reaches the window, the document holds an item window; the suffix link chain leads to the state of exactly
that window, which knows its items.

The automaton is built from bounded shards of the items (`shard_bytes`), so neither the driver nor a worker holds more
than one shard of it; each further shard is one more pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.session import materialise

WINDOW = 10
#: Text bytes of the items in one automaton; some 200,000 words, about 150 MB in a worker.
SHARD_BYTES = 1 << 20

#: A-Z lower-cased, other ASCII but 0-9 and a-z blanked, all bytes of longer code points kept.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; length `window` marks which items own a state."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        texts = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                texts.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        #: Shortest sequence that can be a hit.
        self.least = min([window, *(len(ids) for _, ids in texts)])
        self._own(texts)

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        clone = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def _own(self, texts: list[tuple[str | None, list[int]]]) -> None:
        """Owners of each window state and of each whole short item, looked up while matching."""
        window, link, length = self.window, self.link, self.length
        #: For states at least a window long: the state on the link chain that holds the last `window` words.
        self.anchor = [-1] * len(link)
        for s in sorted(range(1, len(link)), key=length.__getitem__):
            if length[s] >= window:
                self.anchor[s] = s if length[link[s]] < window else self.anchor[link[s]]
        owners: dict[int, set] = {}
        whole: dict[int, dict[int, set]] = {}
        for name, ids in texts:
            state = 0
            for i, c in enumerate(ids):
                state = self.step[state][c]
                if i + 1 >= window:
                    owners.setdefault(self.anchor[state], set()).add(name)
            if len(ids) < window:
                whole.setdefault(state, {}).setdefault(len(ids), set()).add(name)
        self.owners = {s: frozenset(x) for s, x in owners.items()}
        #: (length, items) of short items that end at a state, its link chain included.
        self.short: dict[int, list[tuple[int, frozenset]]] = {}
        if whole:
            for s in sorted(range(1, len(link)), key=length.__getitem__):
                marks = [(n, frozenset(x)) for n, x in whole.get(s, {}).items()] + self.short.get(link[s], [])
                if marks:
                    self.short[s] = marks

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit word ranges [start, end), items with a hit, and the longest match in words."""
        known = bytes(map(self.vocabulary.__contains__, words))
        spans: list[tuple[int, int]] = []
        items: set = set()
        longest = 0
        step, link, length, window = self.step, self.link, self.length, self.window
        # An unknown word ends every match, so only runs of known words that can hold a hit are walked.
        for run in re.finditer(b"\x01{%d,}" % self.least, known):
            state, matched = 0, 0
            for i in range(run.start(), run.end()):
                c = self.vocabulary[words[i]]
                while c not in step[state]:
                    state = link[state]
                    matched = length[state]
                state = step[state][c]
                matched += 1
                if matched > longest:
                    longest = matched
                if matched >= window:
                    items |= self.owners[self.anchor[state]]
                    spans.append((i + 1 - window, i + 1))
                if state in self.short:
                    for n, names in self.short[state]:
                        if n <= matched:
                            items |= names
                            spans.append((i + 1 - n, i + 1))
        return spans, items, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _shards(benchmark: DataFrame, shard_bytes: int, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items in bounded lists; a shard is chosen by hash, so reruns agree."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / shard_bytes))
    for k in range(count):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(row.item, bytes(row.text) if row.text is not None else None) for row in own.collect()]


_FOUND = (
    "n_words bigint, longest bigint, spans array<struct<start:int,end:int>>, items array<string>"
)


def _matched(rows: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, item_col: str, text_col: str) -> DataFrame:
    """rows (rest struct, text) with what _FOUND names added."""
    spark = rows.sparkSession
    C.bounded_batches(spark)
    rest, text = (f.simpleString().split(":", 1)[1] for f in rows.schema.fields)
    schema = f"rest {rest}, text {text}, {_FOUND}"
    found = rows.select(
        "rest", "text", F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("longest"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def passes(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                counts, lengths, spans, items = [], [], [], []
                held = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))
                for text, (best, old, names) in zip(C.as_bytes(batch.column(1)), held):
                    words = words_of(text)
                    new, more, longest = automaton.scan(words)
                    counts.append(len(words))
                    lengths.append(max(best, longest))
                    spans.append([{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in old] + new)])
                    items.append(sorted({*names, *(x for x in more if x is not None)}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))],
                    names=["rest", "text", "n_words", "longest", "spans", "items"],
                )

        return run

    for k, items in enumerate(_shards(benchmark, shard_bytes, item_col, text_col)):
        if k:
            found = materialise(found, "matched")
        found = found.mapInArrow(C.tidied(passes(spark.sparkContext.broadcast(Automaton(items, window)))), schema)
    return found


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, longest, spans, items) of every row of docs.

    spans: hit word ranges, start inclusive, end exclusive, sorted and merged; items: ids with an occurring window,
    sorted as strings. A window is `window` consecutive item words; a shorter item with a word is one window. Null and
    empty texts have no words and no hits; items without words match nothing; an item without an id hits but is not named.
    Repeated documents and items, ties and an empty benchmark need no care: each document row gives one row.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("rest"), F.col(text_col).alias("text"))
    found = _matched(rows, benchmark, window, shard_bytes, item_col, item_text_col)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("rest.doc_id", "n_words", hit.alias("n_hit"), "longest", "spans", "items")


def _cut(text: bytes, spans: list[dict], least: int) -> bytes:
    """The text without the spans of at least `least` words; what stands around a span stays."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_FOLD))]
    out, done = [], 0
    for span in spans:
        if span["end"] - span["start"] >= least:
            out.append(text[done : at[span["start"]][0]].rstrip())
            done = at[span["end"] - 1][1]
    return b"\n".join(piece for piece in [*out, text[done:].lstrip()] if piece) if out else text


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs without benchmark passages, with the columns of docs.

    A hit span of at least `min_span` words is cut out of the text (a line break takes its place); a document of whose
    words more than `max_coverage` are hit is removed whole, as are documents that hold nothing else. Cutting repeats
    until no window is left, as the words around a cut may meet in a new one. n_chars follows the new text where docs
    has that column. Null and empty texts pass unchanged.
    """
    others = [f.name for f in docs.schema.fields if f.name != "text"]
    rest = F.struct(*[F.col(f"`{c}`") for c in others])
    rows = docs.select(rest.alias("rest"), "text")
    found = _matched(rows, benchmark, window, shard_bytes, "item_id", "text")
    covered = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    kept = found.where(covered <= F.col("n_words") * F.lit(max_coverage)).select("rest", "text", "spans")
    rest_type = kept.schema["rest"].dataType.simpleString()

    def cut(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value if shared is not None else None
            for batch in batches:
                new = []
                for text, spans in zip(C.as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                    while spans:
                        shorter = _cut(text, spans, min_span)
                        if shorter == text or automaton is None:
                            text = shorter
                            break
                        text = shorter
                        spans = [{"start": a, "end": b} for a, b in merged(automaton.scan(words_of(text))[0])]
                    new.append(text)
                texts = pa.array(new, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["rest", "text"])

        return run

    shards = list(_shards(benchmark, shard_bytes, "item_id", "text")) if min_span <= window else []
    if not shards:
        kept = kept.mapInArrow(C.tidied(cut(None)), f"rest {rest_type}, text string")
    for k, items in enumerate(shards):
        if k:  # a later shard is asked again about the text that the earlier ones left
            again = _matched(kept.select("rest", "text"), benchmark, window, shard_bytes, "item_id", "text")
            kept = materialise(again.select("rest", "text", "spans"), "cut")
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(items, window))
        kept = kept.mapInArrow(C.tidied(cut(shared)), f"rest {rest_type}, text string")
    size = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in others else {}
    columns = [F.col("text") if c == "text" else F.coalesce(size[c], F.col(f"rest.`{c}`")).alias(c) if c in size else F.col(f"rest.`{c}`")
               for c in docs.columns]
    return kept.select(*columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM bw)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
             FROM d CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hits AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN win USING (k, s)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
       FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL = {"op1_decontamination": OP1_SQL}
