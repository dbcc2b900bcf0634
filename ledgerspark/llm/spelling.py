"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word's letter counts are a vector. One inserted or deleted letter moves it by a squared distance of 1, one replaced letter by
2, so pairs at most 2 apart are the candidates, and a look at the letters verifies the edit. Squared distances of two
blocks of words come from one NumPy product of their count matrices.

Blocks. Words of equal or adjacent length could be near. A length block is cut further by the same bound: letters are dealt
to GROUPS groups, and the letters a word has of each group are its block. One edit adds 1 to a group, takes 1 from one, moves
1 between two, or leaves the block alone. So a word owns its own block and visits the few adjacent ones in which a longer or
a later partner may be; every pair of words meets in exactly one block. A block of more than TILE words is cut into tiles by
hash, and its words visit the earlier tiles, so that no task holds more than a tile of owners, whatever visits it.

A block gives each word one row with its number of partners and the best of them, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.session import materialise

#: In Latin-1 bytes, which hold each letter of the class in one byte.
_RUN = re.compile(rb"[a-z\xC0-\xFF]+")
_OTHER = re.compile(rb"[^a-z\xC0-\xFF]")
MISPRINT = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_RATIO = 5
GROUPS = 6
TILE = 4096
#: Sides of the largest product of count matrices.
SIDE = 2048
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Letters of a text that are split at a time, and bytes of letters that are compared at a time.
PIECE = 1 << 20
_NEAR = 2


def runs(text: str | None) -> Counter:
    """Lower-cased letter runs of a whole text, as Latin-1 bytes."""
    out: Counter = Counter()
    if text:
        letters = text.encode("latin-1", "replace").lower()  # of bytes: A-Z only; what is not Latin-1 becomes '?'
        start = 0
        while start < len(letters):
            cut = _OTHER.search(letters, start + PIECE) if start + PIECE < len(letters) else None
            stop = cut.start() if cut else len(letters)
            out.update(_RUN.findall(letters, start, stop))
            start = stop
    return out


def printed(run: bytes, prefix: int) -> bytes:
    """The run as it counts: one letter in MISPRINT runs is lost. prefix: crc32 of what stands before the run in its key."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % MISPRINT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with at least LEAST_LETTERS letters and LEAST_COUNT occurrences. A null id is the empty text."""
    C.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in runs(text).items():
                    if len(word) >= LEAST_LETTERS and len(word := printed(word, prefix)) >= LEAST_LETTERS:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    parts = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(C.tidied(run), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_counts(words: list[bytes], columns: np.ndarray, width: int) -> np.ndarray:
    """Row per word: how many of its letters go to each column; columns: the column of each byte."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = columns[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(np.repeat(np.arange(len(words)), lengths) * width + letters, minlength=len(words) * width).reshape(-1, width)


def block_keys(counts: np.ndarray) -> list[bytes]:
    """Exact keys of blocks: a byte a group, four where a group has over 255 letters."""
    wide = counts.max(axis=1, initial=0) > 255
    keys = [bytes(r) for r in counts.astype(np.uint8)] if len(counts) else []
    for i in np.flatnonzero(wide).tolist():
        keys[i] = counts[i].astype("<u4").tobytes()
    return keys


def visits(counts: np.ndarray, groups: int = GROUPS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, blocks) that words visit: one more letter in a group, or one moved to an earlier group from a later one."""
    unit = np.eye(groups, dtype=np.int64)
    everyone = np.arange(len(counts))
    for i in range(groups):
        yield everyone, counts + unit[i]
        for j in range(i + 1, groups):
            rows = np.flatnonzero(counts[:, j])
            yield rows, counts[rows] + unit[i] - unit[j]


def _copies(owners_only: bool):
    """Rows (block, side, word, n): side 0 in the word's own block, side 1 where it visits."""
    columns = np.arange(256) % GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            counts = letter_counts(words, columns, GROUPS)
            parts = [(0, np.arange(len(words)), counts)]
            if not owners_only:
                parts += [(1, rows, blocks) for rows, blocks in visits(counts)]
            for side, rows, blocks in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block_keys(blocks), pa.binary()), pa.array(np.full(len(rows), side, np.int32)), batch.column(0).take(pa.array(rows)),
                     batch.column(1).take(pa.array(rows))], ["block", "side", "word", "n"],
                )

    return run


_COPY = "block binary, side int, word string, n bigint"


def one_edit(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Whether left[i] becomes right[i] by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(len(left), bool)
    width = max(map(len, (*left, *right)), default=0) + 1
    step = max(1, PIECE // width)
    place = np.arange(width)
    for start in range(0, len(left), step):
        pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left[start : start + step], right[start : start + step])]
        short, long = (np.frombuffer(b"".join(p[k].ljust(width, b"\0") for p in pairs), np.uint8).reshape(-1, width) for k in (0, 1))
        size = np.array([len(a) for a, _ in pairs])
        gap = np.array([len(b) for _, b in pairs]) - size
        differ = short != long
        first = np.argmax(differ, axis=1)
        after = (short[:, :-1] != long[:, 1:]) & (place[:-1] >= first[:, None]) & (place[:-1] < size[:, None])
        out[start : start + step] = np.where(gap == 0, differ.sum(axis=1) == 1, (gap == 1) & ~after.any(axis=1))
    return out


def gram_candidates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of rows of a and b whose squared distance is at most _NEAR."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Sums of squares below 2^24 are exact in single precision.
    kind = np.float32 if max(a.sum(axis=1).max(initial=0), b.sum(axis=1).max(initial=0)) < 2048 else np.float64
    a, b = a.astype(kind), b.astype(kind)
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    for i in range(0, len(a), SIDE):
        for j in range(0, len(b), SIDE):
            far = own[i : i + SIDE, None] + other[None, j : j + SIDE] - 2 * (a[i : i + SIDE] @ b[j : j + SIDE].T)
            x, y = np.nonzero(far <= _NEAR)
            left.append(x + i)
            right.append(y + j)
    return np.concatenate(left), np.concatenate(right)


class Block:
    """Owners of the tile that is being read."""

    def __init__(self, key):
        self.key, self.words, self.sizes, self.counts = key, [], [], None


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, near, best_n, best) from copies in the order of block, tile and side: owners come before visitors."""
    columns = np.zeros(256, np.int64)
    alphabet = [*range(97, 123), *range(0xC0, 0x100)]
    columns[alphabet] = np.arange(len(alphabet))
    block = Block(None)
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        side = batch.column(2).to_numpy()
        words = [w.encode("latin-1") for w in batch.column(3).to_pylist()]
        sizes = batch.column(4).to_pylist()
        counts = letter_counts(words, columns, len(alphabet)).astype(np.int32)
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        left, right, left_n, right_n = [], [], [], []
        for start, stop in zip(starts, [*starts[1:], len(keys)]):
            if keys[start] != block.key:
                block = Block(keys[start])
            owners = start + int(np.searchsorted(side[start:stop], 1))
            if owners > start:
                mine = counts[start:owners]
                base = len(block.words)
                block.words += words[start:owners]
                block.sizes += sizes[start:owners]
                block.counts = mine if base == 0 else np.concatenate([block.counts, mine])
                if len(block.words) > 1:
                    i, j = gram_candidates(mine, block.counts)
                    keep = i + base > j  # each pair of owners once
                    i, j = i[keep].tolist(), j[keep].tolist()
                    left += [words[start + x] for x in i]
                    left_n += [sizes[start + x] for x in i]
                    right += [block.words[y] for y in j]
                    right_n += [block.sizes[y] for y in j]
            if stop > owners and block.words:
                i, j = (x.tolist() for x in gram_candidates(counts[owners:stop], block.counts))
                left += [words[owners + x] for x in i]
                left_n += [sizes[owners + x] for x in i]
                right += [block.words[y] for y in j]
                right_n += [block.sizes[y] for y in j]
        found: dict[bytes, list] = {}
        for k in np.flatnonzero(one_edit(left, right)).tolist():
            for w, other, n in ((left[k], right[k], right_n[k]), (right[k], left[k], left_n[k])):
                entry = found.get(w)
                if entry is None:
                    found[w] = [1, n, other]
                else:
                    entry[0] += 1
                    if n > entry[1] or n == entry[1] and other < entry[2]:  # Latin-1 bytes are in code-point order
                        entry[1:] = n, other
        if found:
            rows = found.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in found]), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2].decode("latin-1") for r in rows])], ["word", "near", "best_n", "best"],
            )


def partners(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of the rows (word, n) that have a near word; best: largest n, then smallest word."""
    owned = words.mapInArrow(C.tidied(_copies(owners_only=True)), _COPY).groupBy("block").agg(F.count("*").alias("size"))
    large = materialise(owned.where(F.col("size") > tile).select("block", F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "large_blocks")
    copies = words.mapInArrow(C.tidied(_copies(owners_only=False)), _COPY).join(large, "block", "left")

    def target(t, side):
        return F.struct(t.cast("int").alias("tile"), side.cast("int").alias("side"))

    everyone = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: target(t, F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    places = (
        F.when(F.col("tiles").isNull(), F.array(target(F.lit(0), F.col("side"))))
        .when(F.col("side") == 1, everyone)
        .otherwise(F.concat(F.array(target(own, F.lit(0))), F.slice(everyone, F.lit(1), own)))
    )
    dealt = copies.select("block", F.explode(places).alias("at"), "word", "n").select("block", "at.tile", "at.side", "word", "n")
    placed = dealt.repartition("block", "tile").sortWithinPartitions("block", "tile", "side")
    parts = placed.mapInArrow(C.tidied(_partners), "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("top")
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word of (word, form) rows.

    Each round doubles the steps behind a pointer. A form has at least FORM_RATIO times its word's n, so chains are short.
    """
    now = materialise(links.select("word", F.col("form").alias("root")), "pointers")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        step = materialise(step, "pointers")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of docs with the spelling it is a variant of.

    Words are lower-cased (A-Z only) runs of letters, at least six and five times in all, some with a lost letter (`printed`).
    form: the near word of largest n, ties to the smaller, if that n is at least FORM_RATIO times the word's; null otherwise. root:
    where forms lead in the end. Null and empty texts have no words, repeated rows count again, a null id counts as empty
    text, very long texts are split in pieces between words and very long runs stay whole. No words, no rows.
    """
    words = materialise(count_words(docs, id_col, text_col), "words")
    found = words.join(partners(words, tile), "word", "left")
    chosen = F.col("best_n") >= FORM_RATIO * F.col("n")
    rows = materialise(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")),
        "forms",
    )
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(C.table(spark, sf_dir, "documents"))


#: The crc32 takes a step a bit: each byte is followed by eight shifts, marked by -1. Near words share what is left when
#: one letter goes, at the same place (replaced) or on one side only (inserted).
_SQL = f"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY ALL HAVING length(run) >= {LEAST_LETTERS}),
steps AS (
  SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(hx), 2),
      lambda i: [CAST(('0x' || substr(hx, i, 2)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
  FROM steps),
printed AS (
  SELECT CASE WHEN h % {MISPRINT} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM printed WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 100) t(i) WHERE i <= length(word)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS top_n, arg_min(other, (-n, other)) AS top FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= {FORM_RATIO} * w.n THEN top END AS form, CASE WHEN top_n >= {FORM_RATIO} * w.n THEN top_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, coalesce(form, word) AS spot, form IS NULL AS ended FROM forms
  UNION ALL SELECT walk.word, coalesce(f.form, f.word), f.form IS NULL FROM walk JOIN forms f ON f.word = walk.spot WHERE NOT ended)
SELECT word, form, spot AS root, n, n_near, form_n FROM forms JOIN walk USING (word) WHERE ended"""

QUERIES = {"op11_spelling": op11_spelling}
ORACLE_SQL = {"op11_spelling": _SQL}
