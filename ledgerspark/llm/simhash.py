"""SimHash near-duplicates, searched by vantage-point trees.

A fingerprint is one or more 64-bit words. Fingerprints within the radius of each other are linked, and linked ones
form classes. The search works on distinct fingerprints only, so a group of exact copies is one point.

Partitioning. With `4 * words` blocks of 16 bits, two fingerprints that differ in fewer bits than there are blocks
agree on at least one whole block, so each block value is a shard and the search is exact for such radii. (With a
wider radius the shards are a probabilistic filter: see `expected_recall`.) A shard with more than `shard_limit`
points is cut again by rings of Hamming distance around a vantage point: by the triangle inequality partners lie in the
same ring or the next one, so each point stays in its ring and also visits the next if its ball reaches over the boundary.

Search in a shard. A vantage-point tree: points within the radius of the vantage point are linked to it and need no
comparison among themselves; the rest is halved at the median distance, and only points whose ball crosses the
boundary are compared across it. Each shard emits a spanning forest of its links, never all pairs.

With more than FIRST_BLOCKS blocks the search runs twice: the first blocks join most of a large class, and the others then only
add links between classes, which keeps the graph small however many blocks there are.

Similar texts. Where the limit is a similarity of shingle sets (`similar_classes`), fingerprints only find candidates: the radius is
the mean distance at the limit and three deviations, more blocks are read, and each shard emits a forest of its closest pairs. A
candidate is a link only if the exact Jaccard similarity of its two shingle sets reaches the limit.

What fingerprints miss is found exactly. In any fixed order of all shingles, two sets that reach the limit share one of their first
n - ceil(limit * n) + 1; the order puts common shingles last, so few sets meet there. Sets of different classes that meet are
candidates unless their sizes or the parities of their shingles by bin prove them too far apart. Many that meet are cut into tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.llm.graph import components
from ledgerspark.session import materialise

SEED = 42
BLOCK_BITS = 16
BLOCKS_PER_WORD = 64 // BLOCK_BITS
SHARD_LIMIT = 4096
LEAF = 96
FIRST_BLOCKS = 8
#: Standard deviations of a fingerprint distance that the candidate radius of similar texts allows for.
DEVIATIONS = 3
#: Rows with a shingle beyond which it is common, and bits of its place in the table of how common shingles are.
COMMON = 16
LEVEL_BITS = 20
#: Words of the parities of a set of shingles; sets that meet in one tile.
PARITY_WORDS = 8
TILE = 1024
#: Node numbers from here on stand for fingerprints that only rows without an id have.
NAMELESS = 1 << 62

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Odd multipliers (golden-ratio sequence) that give further words from one hash of a shingle.
_STEP = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle; A-Z lower-cased, words split at ASCII white space."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths) + np.arange(n)
    pieces = [joined[a:b] for a, b in zip((ends - lengths)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Word 0 is the hash itself; later words are well-mixed functions of it."""
    if word == 0:
        return h
    z = h + np.uint64(word * _STEP & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes | None, shingle: int = 3, words: int = 1) -> np.ndarray:
    """A bit is 1 if it is set in over half the shingle hashes (repeats count); no words: all zero."""
    h = shingle_hashes(text, shingle) if text else np.zeros(0, np.uint64)
    out = np.zeros(words, np.uint64)
    if not len(h):
        return out
    place = np.arange(8, dtype=np.int64) * 256
    for w in range(words):
        as_bytes = _mixed(h, w).astype("<u8").view(np.uint8).reshape(-1, 8)
        seen = np.zeros(2048, np.int64)
        for start in range(0, len(as_bytes), 1 << 16):
            seen += np.bincount((as_bytes[start : start + (1 << 16)] + place).ravel(), minlength=2048)
        ones = seen.reshape(8, 256) @ _BITS_OF_BYTE
        out[w] = np.packbits((2 * ones > len(h)).astype(np.uint8).ravel(), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp array<bigint>), one row per row of docs. Null and empty texts get the zero fingerprint."""
    C.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle, words) for t in C.as_bytes(batch.column(1))]
            flat = np.concatenate(prints).view(np.int64) if prints else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(0, len(prints) * words + 1, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["id", "fp"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(C.tidied(run), "id bigint, fp array<bigint>")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Forest:
    """Union-find over the points of one shard; a root is the smallest position of its tree."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def joined(self, *parts: np.ndarray) -> bool:
        first = self.root(int(parts[0][0]))
        return all(self.root(i) == first for part in parts for i in part.tolist())


def _compare(points: np.ndarray, radius: int, forest: Forest, left: np.ndarray, right: np.ndarray, step: int = 512) -> None:
    """Links between two lists of positions, in blocks of bounded size; joined blocks are skipped."""
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        for b in range(0, len(right), step):
            cols = right[b : b + step]
            if forest.joined(rows, cols):
                continue
            for i, j in zip(*np.nonzero(distance(points[rows][:, None], points[cols][None]) <= radius)):
                forest.union(int(rows[i]), int(cols[j]))


def _grow(points: np.ndarray, radius: int, forest: Forest) -> None:
    """Joins the points of forest that are linked, by a vantage-point tree."""
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            if len(own) > 1:
                _compare(points, radius, forest, own, own)
            continue
        far = distance(points[own], points[own[0]])
        for i in own[far <= radius].tolist():
            forest.union(int(own[0]), i)
        if forest.joined(own):
            continue
        middle = int(np.median(far))
        if far.max() == middle:
            middle -= 1
        inner, outer = far <= middle, far > middle
        if not inner.any():  # all others are equally far: nothing to prune by
            _compare(points, radius, forest, own, own)
            continue
        near, beyond = own[inner & (far > middle - radius)], own[outer & (far <= middle + radius)]
        if len(near) and len(beyond):
            _compare(points, radius, forest, near, beyond)
        todo += [own[inner], own[outer]]


def vantage_search(points: np.ndarray, radius: int, known: np.ndarray | None = None) -> np.ndarray:
    """Root position of every point under links of at most radius bits, by a vantage-point tree.

    known: class numbers found before, equal ones adjacent; such points are linked from the start.
    """
    forest = Forest(len(points))
    for i in np.flatnonzero(known[1:] == known[:-1]).tolist() if known is not None else ():
        forest.union(i, i + 1)
    _grow(points, radius, forest)
    return np.array([forest.root(i) for i in range(len(points))], np.int64)


def _small_groups(start: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions (i, j) inside small adjacent groups; start: first position of each row's group."""
    left, right = [], []
    n, k = len(points), 1
    alive = np.arange(n)
    while True:
        alive = alive[alive + k < n]
        alive = alive[start[alive] == start[alive + k]]
        if not len(alive):
            break
        hit = alive[distance(points[alive], points[alive + k]) <= radius]
        left.append(hit)
        right.append(hit + k)
        k += 1
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _shard_links(radius: int, words: int):
    """Reads rows (shard, node, fp) in shard and node order and gives the links between nodes found in each shard."""

    def solve(shard: np.ndarray, node: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, shard[1:] != shard[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(shard)])
        start = np.repeat(first, size)
        small = np.flatnonzero(np.repeat((size > 1) & (size <= LEAF), size))
        i, j = _small_groups(start[small], points[small], radius)
        a, b = [node[small[i]]], [node[small[j]]]
        for f, s in zip(first[size > LEAF].tolist(), size[size > LEAF].tolist()):
            own = node[f : f + s]
            a.append(own)
            b.append(own[vantage_search(points[f : f + s], radius, own)])
        pairs = np.stack([np.concatenate(a), np.concatenate(b)], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return _by_shard(solve, words)


def _by_shard(solve, words: int):
    """Hands whole shards of rows (shard, node, fp, ...) in shard order to solve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = (
                batch.column(0).to_numpy(),
                batch.column(1).to_numpy(),
                batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, words),
                *(batch.column(c).to_numpy() for c in range(3, batch.num_columns)),
            )
            held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows))
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield solve(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None and len(held[0]):
            yield solve(*held)

    return run


def _closest_pairs(start: np.ndarray, points: np.ndarray, radius: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forests of the closest linked pairs of different nodes inside small adjacent groups."""
    i, j = _small_groups(start, points, radius)
    other = node[i] != node[j]
    i, j = i[other], j[other]
    forest = Forest(len(points))
    for k in np.flatnonzero((node[1:] == node[:-1]) & (start[1:] == start[:-1])).tolist():
        forest.union(k, k + 1)
    forest.edges.clear()
    order = np.argsort(distance(points[i], points[j]), kind="stable")
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        forest.union(x, y)
    found = np.array(forest.edges, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _candidates(radius: int, words: int):
    """Reads rows (shard, node, fp, key) in shard and node order and gives a forest of close pairs (key_a, a, key_b, b) of each shard."""

    def solve(shard: np.ndarray, node: np.ndarray, points: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        size = np.diff(np.r_[first, len(shard)])
        small = np.flatnonzero(np.repeat((size > 1) & (size <= LEAF), size))
        i, j = _closest_pairs(np.repeat(first, size)[small], points[small], radius, node[small])
        left, right = [small[i]], [small[j]]
        for f, s in zip(first[size > LEAF].tolist(), size[size > LEAF].tolist()):
            forest = Forest(s)
            own = node[f : f + s]
            for k in np.flatnonzero(own[1:] == own[:-1]).tolist():
                forest.union(k, k + 1)
            forest.edges.clear()
            for reach in (radius // 4, radius // 2, 3 * radius // 4, radius):
                _grow(points[f : f + s], reach, forest)
            pairs = np.array(forest.edges, np.int64).reshape(-1, 2) + f
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
        i, j = np.concatenate(left), np.concatenate(right)
        swap = key[i] > key[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[i], node[i], key[j], node[j])], ["key_a", "a", "key_b", "b"])

    return _by_shard(solve, words)


def _column_distance(a: Column, b: Column) -> Column:
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def shard_rows(points: DataFrame, radius: int, first: int, stop: int, shard_limit: int = SHARD_LIMIT, words: int | None = None,
               extra: tuple[str, ...] = ()) -> DataFrame:
    """(shard bigint, node, fp, extra...): every point once per block from first to stop - 1, large shards cut into rings that overlap.

    With `words`, blocks beyond those of the words are mixed: the low half of one block and the high half of the next.
    """

    def cut(i: Column, mask: int) -> Column:
        word = F.element_at("fp", (F.floor(i / BLOCKS_PER_WORD) + 1).cast("int"))
        shift = (F.pmod(i, F.lit(BLOCKS_PER_WORD)) * BLOCK_BITS).cast("int")
        return F.call_function("shiftrightunsigned", word, shift).bitwiseAND(F.lit(mask))

    def block(i: Column) -> Column:
        value = cut(i, (1 << BLOCK_BITS) - 1)
        if words is not None and stop > words * BLOCKS_PER_WORD:
            plain = words * BLOCKS_PER_WORD
            low = F.greatest(i - plain, F.lit(0)) * 2
            mixed = cut(low, (1 << BLOCK_BITS // 2) - 1) + cut(low + 1, (1 << BLOCK_BITS) - (1 << BLOCK_BITS // 2))
            value = F.when(i < plain, cut(F.least(i, F.lit(plain - 1)), (1 << BLOCK_BITS) - 1)).otherwise(mixed)
        return i.cast("bigint") * F.lit(1 << BLOCK_BITS) + value

    blocks = F.sequence(F.lit(first), F.lit(stop - 1))
    rows = points.select("key", "node", "fp", F.explode(F.transform(blocks, block)).alias("block"))
    counts = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("key").alias("key")).where(F.col("n") > shard_limit)
    # Written once, so its size is known: the points meet a broadcast table while it is small, a sorted one beyond.
    large = materialise(counts.select("block", "key"), "large_shards").join(points, "key").select("block", F.col("fp").alias("vantage"))
    large = materialise(large, "vantage_points")
    width = radius + 1
    far = _column_distance(F.col("fp"), F.col("vantage"))
    rings = F.when(F.col("vantage").isNull(), F.array(F.lit(0))).otherwise(
        F.array_distinct(F.array(F.floor(far / width).cast("int"), F.floor((far + radius) / width).cast("int")))
    )
    ring = F.explode(rings).alias("ring")
    # At most 64 * words + 1 rings, so the number fits below the block number.
    return rows.join(large, "block", "left").select("block", "node", "fp", *extra, ring).select(
        (F.col("block") * F.lit(1 << 20) + F.col("ring")).alias("shard"), "node", "fp", *extra
    )


def links(points: DataFrame, radius: int, words: int, first: int, stop: int, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b) node pairs that span the same classes as all links of at most radius bits found in the blocks' shards.

    points: (key, node, fp); key tells the points apart, those of one node are linked already.
    """
    rows = shard_rows(points, radius, first, stop, shard_limit)
    width = C.shuffle_width(points.sparkSession)
    # In node order the root of every class of a shard is its smallest node, so shards agree on the links of a large class.
    placed = rows.repartition(width, "shard").sortWithinPartitions("shard", "node")
    return placed.mapInArrow(C.tidied(_shard_links(radius, words)), "a bigint, b bigint")


def classes(docs: DataFrame, radius: int = 3, shingle: int = 3, words: int = 1, shard_limit: int = SHARD_LIMIT,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): the fingerprint class of every row of docs.

    component is the smallest id reachable over links of at most `radius` bits, the row's own included; null where no
    row of the class has an id. Rows without words share the zero fingerprint and are linked like any other. Repeated
    rows stay repeated. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, shingle, words, id_col, text_col), "fingerprints")
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("fp"), 2)
    points = prints.groupBy("fp").agg(F.min("id").alias("low")).select(F.coalesce("low", nameless).alias("key"), "fp")
    points = materialise(points.select("key", F.col("key").alias("node"), "fp"), "points")
    blocks = words * BLOCKS_PER_WORD
    for first, stop in ((0, FIRST_BLOCKS), (FIRST_BLOCKS, blocks)) if blocks > FIRST_BLOCKS else ((0, blocks),):
        star = components(links(points, radius, words, first, stop, shard_limit))
        points = materialise(points.join(star, "node", "left").select("key", F.coalesce("root", "node").alias("node"), "fp"), "points")
    named = F.when(F.col("node") < NAMELESS, F.col("node"))
    return prints.join(points, "fp", "left").select("id", "fp", named.alias("component"))


def similarity_radius(similarity: float, words: int) -> int:
    """Bits that differ at a Jaccard similarity of shingle sets: the mean (their vectors' angle over pi) and DEVIATIONS deviations."""
    differs = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    bits = 64 * words
    return round(bits * differs + DEVIATIONS * math.sqrt(bits * differs * (1 - differs)))


def shingle_levels(docs: DataFrame, shingle: int) -> np.ndarray:
    """The logarithm of how many rows of docs (..., text) have a shingle, by the last bits of its hash; 0 if all there are rare.

    Where shingles share a place the most common one counts: it only orders shingles, so a wrong level costs time, not results.
    """
    C.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in C.as_bytes(batch.column(0)) if t]
            if sets:
                h, n = np.unique(np.concatenate(sets).astype(np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int32)), pa.array(n.astype(np.int32))], ["h", "n"])

    counts = docs.select("text").mapInArrow(C.tidied(run), "h int, n int").groupBy("h").agg(F.sum("n").alias("n"))
    place = F.col("h").bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("bigint")
    common = counts.where(F.col("n") > COMMON).groupBy(place.alias("place")).agg(F.max(F.floor(F.log2("n"))).alias("level"))
    packed = common.groupBy(F.expr("place div 4096").alias("block")).agg(F.collect_list(F.col("place") * 64 + F.col("level")).alias("found"))
    levels = np.zeros(1 << LEVEL_BITS, np.uint8)
    for r in packed.collect():  # a number for each place at most: of fixed size
        found = np.array(r.found, np.int64)
        levels[found // 64] = found % 64
    return levels


def prefix_length(n: int, similarity: float) -> int:
    """How many first shingles of a set of n a set of at least this similarity must meet, whatever the order."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each bin is odd: two sets differ in at least as many shingles as these in bits."""
    odd = np.bincount((shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(t, shingle)) if t else np.zeros(0, np.uint64) for t in texts]


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets), np.uint64, len(sets)).view(np.int64)


def sketches(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """For every row of docs (doc_id, text) its fingerprint, and of its set of shingles a digest, the size and parities."""
    C.bounded_batches(docs.sparkSession)

    def lists(parts: list[np.ndarray], width: int) -> pa.Array:
        flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.as_bytes(batch.column(1))
            sets = _shingle_sets(texts, shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists([fingerprint(t, shingle, words) for t in texts], words), pa.array(_digests(sets)),
                 pa.array([len(h) for h in sets], pa.int32()), lists([parities(h) for h in sets], PARITY_WORDS)],
                ["id", "fp", "digest", "n", "parity"],
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return narrow.mapInArrow(C.tidied(run), "id bigint, fp array<bigint>, digest bigint, n int, parity array<bigint>")


def first_shingles(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(h, digest): of the set of every row of docs (..., text) the shingles that a similar set must share one of, rare ones first."""
    shared = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, last = shared.value, np.uint64((1 << LEVEL_BITS) - 1)
        for batch in batches:
            sets = _shingle_sets(C.as_bytes(batch.column(0)), shingle)
            first = [h[np.argsort(level[(h & last).astype(np.int64)], kind="stable")[: prefix_length(len(h), similarity)]] for h in sets]
            if first:
                digests = np.repeat(_digests(sets), [len(h) for h in first])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(digests)], ["h", "digest"])

    return docs.select("text").mapInArrow(C.tidied(run), "h bigint, digest bigint")


def _meeting_pairs(similarity: float):
    """Reads rows (tile, node, parity, key, n, part, whole) in tile order and gives the pairs (key_a, a, key_b, b) of different nodes that
    may reach the similarity. Sets of one part are compared only in its whole tile."""
    apart = (1 - similarity) / (1 + similarity)

    def solve(tile: np.ndarray, node: np.ndarray, parity: np.ndarray, key: np.ndarray, n: np.ndarray, part: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = (node[i] != node[j]) & ((whole[i] > 0) | (part[i] != part[j]))
            ok &= np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6
            at = np.flatnonzero(ok)
            i, j = i[at], j[at]
            near = distance(parity[i], parity[j]) <= apart * (n[i] + n[j]) + 1e-6
            return at[near]

        first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        size = np.diff(np.r_[first, len(tile)])
        end = np.repeat(first + size, size)
        alive = np.flatnonzero(np.repeat((size > 1) & (size <= LEAF), size))
        left, right, k = [], [], 1
        while len(alive := alive[alive + k < end[alive]]):
            hit = alive[close(alive, alive + k)]
            left.append(hit)
            right.append(hit + k)
            k += 1
        for f, s in zip(first[size > LEAF].tolist(), size[size > LEAF].tolist()):
            own, counts = np.unique(node[f : f + s], return_counts=True)
            # Each pair of different nodes has an end outside the largest node.
            largest = node[f : f + s] == own[counts.argmax()]
            for i in (f + np.flatnonzero(~largest)).tolist():
                others = f + np.flatnonzero(largest | (np.arange(f, f + s) > i))
                hit = others[close(np.full(len(others), i), others)]
                left.append(np.full(len(hit), i))
                right.append(hit)
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        swap = key[i] > key[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pairs = np.unique(np.stack([key[i], node[i], key[j], node[j]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(4)], ["key_a", "a", "key_b", "b"])

    return _by_shard(solve, PARITY_WORDS)


def missed_links(prints: DataFrame, points: DataFrame, docs: DataFrame, similarity: float, shingle: int, tile: int = TILE) -> DataFrame:
    """(a, b) nodes of points (node, fp) with rows whose sets of shingles are equal or reach the similarity: all that are not one node yet.

    prints: `sketches` of docs. A pair is compared if the two sets share one of their first shingles, and linked by its exact similarity.
    """
    width = C.shuffle_width(docs.sparkSession)
    placed = prints.where("n > 0").join(points.select("node", "fp"), "fp")
    sets = placed.groupBy("digest").agg(
        F.min("id").alias("key"), F.min("node").alias("node"), F.any_value("n").alias("n"), F.any_value("parity").alias("parity"), F.collect_set("node").alias("nodes")
    )
    sets = materialise(sets, "sets")
    same = sets.where(F.size("nodes") > 1).select(F.col("node").alias("a"), F.explode("nodes").alias("b"))
    by_shingle = Window.partitionBy("h")
    rows = first_shingles(docs, similarity, shingle).repartition(width, "h").dropDuplicates(["h", "digest"])
    rows = rows.select("h", "digest", (F.min("digest").over(by_shingle) != F.max("digest").over(by_shingle)).alias("shared")).where("shared")
    rows = rows.join(sets.select("digest", "node"), "digest").select(
        "h", "digest", F.min("node").over(by_shingle).alias("low"), F.max("node").over(by_shingle).alias("high"), F.count("*").over(by_shingle).alias("m")
    )
    rows = rows.where("low <> high").select("h", "digest", F.ceil(F.col("m") / F.lit(tile)).alias("parts"))
    rows = rows.select("h", "digest", "parts", F.pmod(F.xxhash64("digest"), F.col("parts")).alias("part"))
    rows = rows.select("h", "digest", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    tiles = rows.select(
        F.xxhash64("h", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "digest", "part", (F.col("part") == F.col("other")).alias("whole")
    ).join(sets, "digest").select("tile", "node", "parity", "key", F.col("n").cast("bigint").alias("n"), "part", F.col("whole").cast("int").alias("whole"))
    found = tiles.repartition(width, "tile").sortWithinPartitions("tile", "node").mapInArrow(
        C.tidied(_meeting_pairs(similarity)), "key_a bigint, a bigint, key_b bigint, b bigint"
    )
    pairs = materialise(found.distinct(), "candidate_pairs")
    return similar_pairs(pairs, docs, similarity, shingle).select("a", "b").unionByName(same)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles): the distinct shingle hashes of every row of docs (doc_id, text)."""
    C.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _shingle_sets(C.as_bytes(batch.column(1)), shingle)
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "shingles"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("key"), "text")
    return narrow.mapInArrow(C.tidied(run), "key bigint, shingles array<bigint>")


def similar_pairs(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (key_a, key_b, ...) whose documents have an exact Jaccard similarity of shingle sets of at least similarity.

    Of a repeated id with different texts any text counts. Texts without words are similar to nothing here.
    """
    ends = pairs.select(F.explode(F.array("key_a", "key_b")).alias("k")).distinct()
    sets = shingle_sets(docs.join(materialise(ends, "candidates"), F.col("doc_id") == F.col("k"), "left_semi"), shingle)
    # An id has one row for each of its texts; the rows are laid out by id, as the join needs them.
    digest = F.xxhash64("shingles").alias("digest")
    sets = sets.repartition(C.shuffle_width(docs.sparkSession), "key").select("*", digest).dropDuplicates(["key", "digest"])
    sets = sets.drop("digest")
    left = sets.select(F.col("key").alias("key_a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("key").alias("key_b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "key_a").join(right, "key_b")
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    return both.where((common > 0) & (common >= F.lit(similarity) * union - 1e-9)).select(*pairs.columns)


def contracted(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points (key, node, fp) with linked nodes joined."""
    joined = points.join(components(edges), "node", "left")
    return materialise(joined.select("key", F.coalesce("root", "node").alias("node"), "fp"), "points")


def similar_classes(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 8, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(id, component) of every row of docs (doc_id, text) that has an id: classes of all links of at least similarity.

    component is the smallest id reachable, the row's own included. Rows without words are one class; equal fingerprints are
    linked, as are all rows of a repeated id.
    """
    named = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    prints = materialise(sketches(named, shingle, words), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("id").alias("key")).select("key", F.col("key").alias("node"), "fp")
    points = materialise(points, "points")
    radius, plain = similarity_radius(similarity, words), words * BLOCKS_PER_WORD
    for first, stop in ((0, FIRST_BLOCKS), (FIRST_BLOCKS, plain + plain // 2)):
        rows = shard_rows(points, radius, first, stop, shard_limit, words, ("key",))
        placed = rows.repartition(C.shuffle_width(docs.sparkSession), "shard").sortWithinPartitions("shard", "node")
        found = placed.mapInArrow(C.tidied(_candidates(radius, words)), "key_a bigint, a bigint, key_b bigint, b bigint")
        pairs = materialise(found.where("a <> b").distinct(), "candidate_pairs")
        points = contracted(points, similar_pairs(pairs, named, similarity, shingle).select("a", "b"))
    points = contracted(points, missed_links(prints, points, named, similarity, shingle))
    return prints.join(points, "fp", "left").select("id", F.col("node").alias("component"))


def deduplicate(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 8) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class; all columns of docs stay.

    Near-duplicates share at least `similarity` of their distinct word shingles, exactly; candidates come from fingerprints of
    64 * words bits, then from first shingles, which miss none. Rows without an id are kept and link nothing; all rows with an id but without words go, but one.
    Repeated rows count as one document: one of them stays.
    """
    found = materialise(similar_classes(docs, similarity, shingle, words), "classes")
    ids = found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"), F.max("component").alias("component"))
    # The two lists of ids are written, so that texts are shuffled only where a list has outgrown a broadcast.
    gone = materialise(ids.where(F.col("doc_id") != F.col("component")).select("doc_id"), "near_duplicates")
    again = materialise(ids.where("n > 1 and doc_id = component").select("doc_id"), "repeated_ids")
    left = docs.join(gone, "doc_id", "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").unionByName(once)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = classes(docs, radius=3, shingle=3, words=1)
    hexed = F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
