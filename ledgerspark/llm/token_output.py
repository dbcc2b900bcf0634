"""Token ids in training order, as binary shards.

Every document is tokenised, ended by an end mark and cut into sequences of a fixed length. A sequence's number (documents
in reading order) goes through a keyed Feistel permutation of [0, N), walking the cycle where the network's domain of a power
of four is larger than N; the result is its global slot. Slots are dealt to shards of equal size and consecutive shards to
tasks, which write flat files: every sequence has the same stride, so slot s starts at byte (s mod per_shard) * stride of
shard s div per_shard, and a reader can start anywhere. A file is moved into place when it is whole; rerun tasks write the same.

Texts are tokenised once: packed sequences are written with the number of the input partition and their place in it, and
numbers follow from those written rows. So no later change of the splits moves a number, and numbers need no shuffle; only
sequences are shuffled, packed and compressed per task and shard. A shard that is not filled exactly fails the job.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.session import materialise, new_scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern by which the tokenizer's makers cut text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern without its lookahead, which only matters where white space meets white space.
PLAIN_PATTERN = PATTERN.replace(r"|\s+(?!\S)", "")
_SPACE_RUN = re.compile(r"\s\s")
SEQUENCE = 256
SHARD_BYTES = 16 << 20
KEY = 0x5DEECE66D1F3A7B9
ROUNDS = 6
#: A worker writes its sequences when PIECE_BYTES wait, and packs them by shard when FLUSH_BYTES wait.
PIECE_BYTES = 2 << 20
FLUSH_BYTES = 8 << 20
#: Of zstd, for what is written or shuffled on the way.
LEVEL = 9


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def slots(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The place of each number under the permutation of [0, total) that the key picks."""
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key + r * 0x9E3779B97F4A7C15) & mask)
        x = (left << shift) | right
        out[walking] = x
        walking = walking[x >= total]
    return out.astype(np.int64)


class Tokenizer:
    """Token bytes of texts."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.end = len(ranks)
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.code = "H" if self.end < 1 << 16 else "I"
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # Without lookahead the pieces are found much faster, and they are the same in texts without runs of white space.
        self.plain = tiktoken.Encoding("plain", pat_str=PLAIN_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return (self.coder if _SPACE_RUN.search(text) else self.plain).encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def encode(self, text: str) -> bytes:
        ids = array(self.code, self.ids(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def sequences(self, text: str | None, length: int) -> list[tuple[bytes, int]]:
        """(padded bytes, tokens) of a text's sequences, the end mark included; none for null and empty texts."""
        if not text:
            return []
        stride = length * self.kind.itemsize
        mark = np.array([self.end], self.kind).tobytes()
        ids = self.encode(text) + mark
        parts = [ids[i : i + stride] for i in range(0, len(ids), stride)]
        out = [(p, len(p) // self.kind.itemsize) for p in parts]
        return [*out[:-1], (parts[-1] + mark * (length - out[-1][1]), out[-1][1])]


def _read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:  # some megabytes, read once on the driver
        return file.read()


def _packed(ids: list[int | None], *numbers: np.ndarray) -> bytes:
    """Ids (a null is a flag), then numbers below 2^31, as one compressed value."""
    null = np.array([x is None for x in ids], np.uint8)
    known = np.array([0 if x is None else x for x in ids], "<i8")
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([null.tobytes(), known.tobytes(), *(n.astype("<i4").tobytes() for n in numbers)]))


def _unpacked(value: bytes, n: int) -> tuple:
    """What _packed was given, for n ids."""
    raw = zstandard.ZstdDecompressor().decompress(value)
    ids = np.frombuffer(raw, "<i8", n, n).astype(object)
    ids[np.frombuffer(raw, np.uint8, n) == 1] = None
    return ids.tolist(), *np.frombuffer(raw, "<i4", offset=9 * n).reshape(-1, n)


_PIECES = "partition int, first bigint, n bigint, docs bigint, about binary, tokens binary"


def _cutter(shared, length: int):
    """Rows of whole documents' sequences in reading order; first: place of a row's first sequence among those of its input
    partition; about: for each document its id, its sequences, and the tokens of the last one (the others are full)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer(shared.value)
        pack = zstandard.ZstdCompressor(level=LEVEL)
        partition, first = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, int, int]] = []
        ids: list[bytes] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held, ids, waiting
            row = (
                partition, first, len(ids), len(held),
                _packed([x[0] for x in held], np.array([x[1] for x in held]), np.array([x[2] for x in held])), pack.compress(b"".join(ids)),
            )
            first += len(ids)
            held, ids, waiting = [], [], 0
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["partition", "first", "n", "docs", "about", "tokens"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own := coder.sequences(text, length):
                    held.append((doc, len(own), own[-1][1]))
                    ids += [x[0] for x in own]
                    waiting += sum(len(x[0]) for x in own)
                if waiting >= PIECE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


_PACKED = "task int, shard bigint, n bigint, about binary, tokens binary"


def _packer(starts, total: int, stride: int, length: int, per_shard: int, shards_per_task: int, key: int):
    """Rows of packed sequences, one per shard and flush; about: for each its document, place in the shard, part and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        held: list[tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting
            number, part, n, ids = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3, 4))
            docs = [d for x in held for d in x[1]]
            held = []
            place = slots(number, total, key)
            order = np.argsort(place)
            shard = place[order] // per_shard
            cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = order[a:b]
                about = _packed([docs[i] for i in own.tolist()], place[own] - shard[a] * per_shard, part[own], n[own])
                rows.append((int(shard[a]) // shards_per_task, int(shard[a]), len(own), about, pack.compress(ids[own].tobytes())))
            waiting = 0
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["task", "shard", "n", "about", "tokens"])

        for batch in batches:
            for x in batch.to_pylist():
                start = starts.value[x["partition"]] + x["first"]
                ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(x["tokens"]), np.uint8).reshape(-1, stride)
                docs, parts, last = _unpacked(x["about"], x["docs"])
                ends = np.cumsum(parts)
                n = np.full(x["n"], length)
                n[ends - 1] = last
                part = np.arange(x["n"]) - np.repeat(ends - parts, parts)
                held.append((np.arange(start, start + x["n"]), [d for d, k in zip(docs, parts.tolist()) for _ in range(k)], part, n, ids))
                waiting += ids.size
                if waiting >= FLUSH_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


_INDEX = "slot bigint, doc_id bigint, part int, n_tokens int, crc int"


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _writer(out: str, total: int, stride: int, per_shard: int):
    """Writes each shard as it has been read whole; gives one index row per sequence, in slot order."""

    def place(store, root: str, shard: int, buffer: bytearray, rows: list) -> pa.RecordBatch:
        doc = [d for r in rows for d in r[0]]
        row, part, n = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
        order = np.argsort(row, kind="stable")
        if not np.array_equal(row[order], np.arange(min(per_shard, total - shard * per_shard))):
            raise RuntimeError(f"shard {shard}: {len(row)} sequences do not fill its slots once each")
        final = f"{root}/{shard_name(shard)}"
        draft = f"{final}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as file:
            file.write(buffer)
        store.move(draft, final)
        view = memoryview(buffer)
        crc = np.array([zlib.crc32(view[r * stride : (r + 1) * stride]) for r in range(len(row))], np.uint32).view(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard * per_shard + np.arange(len(row))), pa.array([doc[i] for i in order.tolist()], pa.int64()), pa.array(part[order], pa.int32()),
             pa.array(n[order], pa.int32()), pa.array(crc)],
            ["slot", "doc_id", "part", "n_tokens", "crc"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        current, buffer, rows = None, bytearray(), []
        for batch in batches:
            for x in batch.to_pylist():
                if x["shard"] != current:
                    if current is not None:
                        yield place(store, root, current, buffer, rows)
                    current, rows = x["shard"], []
                    buffer = bytearray(stride * min(per_shard, total - current * per_shard))
                rows.append(_unpacked(x["about"], x["n"]))
                ids = zstandard.ZstdDecompressor().decompress(x["tokens"])
                for k, r in enumerate(rows[-1][1].tolist()):
                    buffer[r * stride : (r + 1) * stride] = ids[k * stride : (k + 1) * stride]
        if current is not None:
            yield place(store, root, current, buffer, rows)

    return run


def _index(stored: DataFrame, per_shard: int) -> DataFrame:
    """The index with the columns that follow from the stored ones."""
    shard = F.expr(f"slot div {per_shard}")
    return stored.select(
        "slot", shard.alias("shard"), (F.col("slot") - shard * per_shard).alias("row"), "doc_id", "part", "n_tokens",
        F.col("crc").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)).alias("crc32"),
    )


def write(docs: DataFrame, out: str | None = None, length: int = SEQUENCE, shard_bytes: int = SHARD_BYTES, key: int = KEY,
          tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and gives their index: one row (slot, shard, row, doc_id, part, n_tokens, crc32) per sequence.

    out: folder (path or URI that pyarrow can write) all executors share; a fresh one below the shared scratch folder by
    default. part: the sequence's place in its document; n_tokens: without padding, with the end mark; crc32: of the
    sequence's bytes in the shard. The last sequence of a document is padded with the end mark. Null and empty texts
    have no sequence; repeated rows each have their own; null ids stay null. Without any sequence no shard is written.
    The folder also gets meta.json with what a reader needs.
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    context = spark.sparkContext
    vocabulary = context.broadcast(_read_vocabulary(tokenizer))
    end = len(vocabulary.value.splitlines())
    stride = length * (2 if end < 1 << 16 else 4)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(narrow.mapInArrow(C.tidied(_cutter(vocabulary, length)), _PIECES), "sequences")
    counts = pieces.groupBy("partition").agg(F.sum("n").alias("n")).collect()  # one row per input split
    starts, total = {}, 0
    for partition, n in sorted((r.partition, r.n) for r in counts):
        starts[partition] = total
        total += n
    out = out or new_scratch(spark, "shards")
    if not total:
        return _index(spark.createDataFrame([], _INDEX), 1)
    per_shard = max(1, shard_bytes // stride)
    shards = -(-total // per_shard)
    tasks = min(shards, 100_000)
    per_task = -(-shards // tasks)
    store, root = fs.FileSystem.from_uri(out)
    store.create_dir(root, recursive=True)
    packed = pieces.mapInArrow(C.tidied(_packer(context.broadcast(starts), total, stride, length, per_shard, per_task, key)), _PACKED)
    ranged = packed.repartitionById(tasks, F.col("task")).sortWithinPartitions("shard")
    index = materialise(ranged.mapInArrow(C.tidied(_writer(out, total, stride, per_shard)), _INDEX), "shard_index")
    if (written := index.count()) != total:
        raise RuntimeError(f"{written} sequences written of {total}")
    meta = {"sequences": total, "length": length, "token_bytes": stride // length, "stride": stride, "per_shard": per_shard,
            "shards": shards, "end_token": end, "key": key, "index": index.inputFiles()[0].rsplit("/", 1)[0]}
    with store.open_output_stream(f"{root}/meta.json") as file:
        file.write(json.dumps(meta).encode())
    return _index(index, per_shard)


def read(out: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """Sequences of slots [start, stop) in training order, read shard by shard; start resumes where a run ended."""
    store, root = fs.FileSystem.from_uri(out)
    with store.open_input_stream(f"{root}/meta.json") as file:
        meta = json.loads(file.read())
    kind = np.dtype("<u2" if meta["token_bytes"] == 2 else "<u4")
    slot, stop = start, min(meta["sequences"], meta["sequences"] if stop is None else stop)
    while slot < stop:
        shard, row = divmod(slot, meta["per_shard"])
        last = min(stop, (shard + 1) * meta["per_shard"])
        with store.open_input_file(f"{root}/{shard_name(shard)}") as file:
            file.seek(row * meta["stride"])
            for _ in range(last - slot):
                yield np.frombuffer(file.read(meta["stride"]), kind)
        slot = last


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(C.table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_output": op6_token_output}
ORACLE_SQL: dict[str, str] = {}
