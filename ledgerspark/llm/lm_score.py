"""Language-model scores of documents: a hashed maximum-entropy model with a class-factored softmax.

Events. The most frequent words are modelled one by one and sit in head classes by rank; every other word, known
or not, belongs to the tail class of its last two bytes. P(word | history) = P(class | history) * P(word | class, history).

Features. The history is the two words before, a tail word counting as its class. The word before, the two words before, and
a skip (the second word back alone) are hashed, each to a row of weights: one table for the classes, one (hashed with the
class, too) for the words of a head class. A distribution is the softmax of the sum of its rows and of a bias, the log of the corpus
count. Words of a tail class have only that bias: their probability is the smoothed share of their count, with one place for
all unknown words, so that all probabilities of a history sum to one.

Training. Counts of all words of all training documents come first, as a grouped table that grows with the corpus. Then every
training document is used once, in rounds: tasks take gradient steps over their own documents from the weights of the last
round, and each row of weights moves by the mean of the tasks' moves, weighted by how often each used the row. Tasks hand on
moves by blocks of rows; only the mean, of a fixed size, reaches the driver.

Scoring. Documents pass by in Arrow batches as arrays of symbols; scores come from gathered rows of weights, gathered once for
tokens that share a history. Counts of the most frequent words (at most KNOWN, however large the corpus) travel with the tasks; the
other words' counts are joined, summed by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.session import materialise

#: Words whose counts travel with the tasks, and the longest of them in bytes.
KNOWN = 1 << 18
KNOWN_BYTES = 64
FOLDS = 5
HELD_OUT = 1
#: Shares of the training documents that the rounds take, in sixteenths.
ROUNDS = (2, 14)
RATE = 1.0
#: Tokens of a gradient step, and histories that are scored at a time.
STEP = 8192
#: Tokens among which equal histories are scored once.
SHARED = 16 * STEP
#: Logit rows that are worked on at a time, so that they stay in a core's cache.
CACHED = 1024
#: Gradients of a row up to which they are added with those of other rows.
FEW = 20
#: A token that is no word.
END = b" "
#: Most tasks that train at a time: bounds how many moves are averaged, not what they read.
TASKS = 2048
#: Rows of weights in one block of moves.
MOVE_ROWS = 1024
#: Words that a task gathers before it counts them and hands them on; bytes of a text that are split at a time.
HELD_WORDS = 2_000_000
PIECE = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"
_NONE = -1e9
#: Lowest log probability of one choice, near the smallest normal number of single precision.
LEAST = -87.0


@dataclass(frozen=True)
class Shape:
    """Words of a head class, head classes, tail classes; rows of the tables of weights for classes and for words."""

    width: int = 64
    heads: int = 32
    tails: int = 32
    class_rows: int = 1 << 14
    word_rows: int = 1 << 14

    @property
    def head(self) -> int:
        """Words that are modelled one by one; symbols from here on are tail classes."""
        return self.heads * self.width

    @property
    def start(self) -> int:
        """The symbol that stands before a document."""
        return self.head + self.tails

    def tail(self, word: bytes) -> int:
        return zlib.crc32(word[-2:]) % self.tails

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.head, symbols // self.width, symbols - self.head + self.heads)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words (A-Z only, split at ASCII white space) of a text, some at a time."""
    start = 0
    while start < len(text):
        stop = start + PIECE
        while stop < len(text) and text[stop] not in _SPACES:
            stop += 1
        yield text[start:stop].lower().split()
        start = stop


def split(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(numbers of the texts, words) for the words of all texts, those of a text in their order; long texts come in `pieces`."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    long = pc.binary_length(texts).to_numpy() > PIECE
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.filter(pa.array(~long)) if long.any() else texts))
    numbers, words = np.repeat(np.flatnonzero(~long), np.diff(lists.offsets.to_numpy())), lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    yield numbers[real.to_numpy(zero_copy_only=False)], words.filter(real).cast(pa.binary())
    for i in np.flatnonzero(long).tolist():
        for part in pieces(texts[i].as_buffer().to_pybytes()):
            yield np.full(len(part), i), pa.array(part, pa.binary())


def last_bytes(words: pa.Array) -> np.ndarray:
    """The last two bytes of each word as a number, 65536 and more for a word of one byte."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    last = data[ends[1:] - 1].astype(np.int64)
    return np.where(np.diff(ends) > 1, last + 256 * data[ends[1:] - 2].astype(np.int64), last + (1 << 16))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word binary, n) of all words of rows (…, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            found = pa.chunked_array(held).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays(found.flatten(), ["word", "n"])

        for batch in batches:
            for _, words in split(batch.column(0)):
                held.append(words)
                if sum(map(len, held)) >= HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(C.tidied(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """What tasks need to know of the words: symbols, counts and fixed parts of the model.

    A symbol is the rank of a word of the head, or stands for a tail class.
    """

    def __init__(self, words: list[tuple[bytes, int]], documents: int, tails: dict[int, tuple[int, int]], shape: Shape = Shape()):
        """words: the most frequent ones with their counts; tails: (occurrences, different words) of all words by tail class."""
        self.shape, size = shape, shape.head
        words = sorted([*words, (END, documents)], key=lambda w: (w[0] != END, -w[1], w[0]))
        self.words, self.counts = [w for w, _ in words], np.array([n for _, n in words], np.int64)
        self.symbols = np.array([i if i < size else size + shape.tail(w) for i, w in enumerate(self.words)], np.int32)
        self.tokens = sum(n for n, _ in tails.values()) + documents
        self.kinds = sum(v for _, v in tails.values()) + (documents > 0)
        mass, kinds = (np.array([tails.get(t, (0, 0))[k] for t in range(shape.tails)], np.int64) for k in (0, 1))
        head = np.zeros(size, np.int64)
        head[: len(words)] = self.counts[:size]
        for w, n in words[1:size]:
            mass[shape.tail(w)] -= n
            kinds[shape.tail(w)] -= 1
        self.tail_log = np.log(mass + 0.5 * (kinds + 1))  # of what a tail word's share is taken
        by_class = np.r_[head.reshape(shape.heads, shape.width).sum(axis=1), mass + 0.5 * (kinds + 1)]
        present = (np.arange(size) < len(words)).reshape(shape.heads, shape.width)
        with np.errstate(divide="ignore"):
            self.class_bias = np.where(np.r_[present.any(axis=1), np.ones(shape.tails, bool)], np.log(np.maximum(by_class, 0.5) / max(1, self.tokens)), _NONE).astype(np.float32)
            self.word_bias = np.where(present, np.log(np.maximum(head, 0.5)).reshape(shape.heads, shape.width), _NONE).astype(np.float32)
        self.word_bias -= np.where(present, self.word_bias, -np.inf).max(axis=1, initial=_NONE, keepdims=True).clip(-1e8)
        self.table: pa.Array | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(sizes, symbols, places, strange words, their texts) of all texts' tokens with the end marks, text by text.

        A size is a text's number of tokens, a place a word's number here, -1 for strange words.
        """
        if self.table is None:
            self.table = pa.array(self.words, pa.binary())
        numbers, places, symbols, strange, owners = [], [], [], [], []
        for of, words in split(texts):
            place = pc.fill_null(pc.index_in(words, value_set=self.table), -1).to_numpy()
            symbol = self.symbols[place]
            new = np.flatnonzero(place < 0)
            if len(new):
                odd = words.take(pa.array(new))
                ends, back = np.unique(last_bytes(odd), return_inverse=True)
                tail = [self.shape.tail(bytes([e & 255]) if e >> 16 else e.to_bytes(2, "big")) for e in ends.tolist()]
                symbol[new] = self.shape.head + np.array(tail, np.int32)[back]
                strange.append(odd)
                owners.append(of[new])
            numbers.append(of)
            places.append(place)
            symbols.append(symbol)
        n = np.bincount(np.concatenate(numbers), minlength=len(texts)) + 1
        order = None if len(numbers) == 1 else np.argsort(np.concatenate(numbers), kind="stable")
        ends = np.cumsum(n) - 1
        word = np.ones(n.sum(), bool)
        word[ends] = False
        out = []
        for parts, end in ((symbols, self.symbols[0]), (places, 0)):
            own = np.full(len(word), end, np.int32)
            own[word] = np.concatenate(parts) if order is None else np.concatenate(parts)[order]
            out.append(own)
        return n, *out, pa.concat_arrays(strange) if strange else pa.array([], pa.binary()), np.concatenate([np.zeros(0, np.int64), *owners])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def features(symbols: list[np.ndarray], start: int) -> np.ndarray:
    """A row of three hashed features for each token of each document; `start` stands before it."""
    before = np.full(2, start, np.int64)
    joined = np.concatenate([x for s in symbols for x in (before, s)])
    real = np.ones(len(joined), bool)
    ends = np.cumsum([len(s) + 2 for s in symbols])
    real[np.r_[0, ends[:-1], 1, ends[:-1] + 1]] = False
    at = np.flatnonzero(real)
    one, two = (joined[at - k].astype(np.uint64) + np.uint64(1) for k in (1, 2))
    wide = np.uint64(1 << 20)
    return np.stack([_mix(k * np.uint64(0x9E3779B97F4A7C15)) for k in (one, one * wide + two, two * wide * wide)], axis=1)


def class_rows(f: np.ndarray, rows: int) -> np.ndarray:
    return (f >> np.uint64(20)).astype(np.int64) % rows


def word_rows(f: np.ndarray, cls: np.ndarray, rows: int) -> np.ndarray:
    return class_rows(_mix(f + cls.astype(np.uint64)[:, None] * np.uint64(0x94D049BB133111EB)), rows)


def _exponentials(table: np.ndarray, bias: np.ndarray, rows: np.ndarray, shares: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials of the logits, scaled by their largest, and their sum) for each row of feature rows; shares: of that sum."""
    z, total = np.empty((len(rows), table.shape[1]), table.dtype), np.empty(len(rows), table.dtype)
    for a in range(0, len(rows), CACHED):
        own, at = z[a : a + CACHED], rows[a : a + CACHED]
        table.take(at[:, 0], axis=0, out=own, mode="clip")
        for k in range(1, rows.shape[1]):
            own += table.take(at[:, k], axis=0, mode="clip")
        own += bias if bias.ndim == 1 else bias[a : a + CACHED]
        own -= own.max(axis=1, keepdims=True)
        np.exp(own, out=own)
        own.sum(axis=1, out=total[a : a + CACHED])
        if shares:
            own *= (1 / total[a : a + CACHED])[:, None]
    return z, total


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order that puts equal keys together, where each group starts in it and the last ends, the group of each key)."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.r_[True, own[1:] != own[:-1]]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.r_[np.flatnonzero(new), len(keys)], group


class Model:
    def __init__(self, lexicon: Lexicon, class_table: np.ndarray | None = None, word_table: np.ndarray | None = None):
        self.lexicon, shape = lexicon, lexicon.shape
        self.tables = [
            np.zeros((shape.class_rows, shape.heads + shape.tails), np.float32) if class_table is None else class_table,
            np.zeros((shape.word_rows, shape.width), np.float32) if word_table is None else word_table,
        ]

    def choice(self, table: int, cls: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(biases, rows of weights) of the choice of a class, or of a word of the given classes."""
        lexicon, shape = self.lexicon, self.lexicon.shape
        return (lexicon.word_bias[cls], word_rows(f, cls, shape.word_rows)) if table else (lexicon.class_bias, class_rows(f, shape.class_rows))

    def parts(self, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, tokens, their classes, targets): the classes of all tokens, then the words of those of the head."""
        shape = self.lexicon.shape
        cls = shape.classes(symbols)
        yield 0, np.arange(len(symbols)), cls, cls
        head = np.flatnonzero(symbols < shape.head)
        if len(head):
            yield 1, head, cls[head], symbols[head] % shape.width

    def log_probabilities(self, symbols: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Natural log of P(class | history), times P(word | class, history) for words of the head."""
        out = np.zeros(len(symbols))
        for a in range(0, len(symbols), SHARED):
            own = f[a : a + SHARED]
            same = own[:, 1]  # the two words before, from which all features follow
            for table, tokens, cls, target in self.parts(symbols[a : a + SHARED]):
                if table:
                    same = group[tokens] * len(self.lexicon.word_bias) + cls
                order, starts, group = _groups(same)
                for i in range(0, len(starts) - 1, STEP):
                    start = starts[i : i + STEP + 1]
                    first, every = order[start[:-1]], order[start[0] : start[-1]]
                    e, total = _exponentials(self.tables[table], *self.choice(table, cls[first], own[tokens[first]]))
                    of = np.repeat(np.arange(len(first)), np.diff(start))
                    with np.errstate(divide="ignore"):
                        out[a + tokens[every]] += np.maximum(np.log(e[of, target[every]] / total[of]), LEAST)
        return out


def _summed(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different rows, sums of the values with that row, how many)."""
    order = np.argsort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, kind="stable")  # short numbers sort by digits
    own = rows[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size = np.diff(np.r_[first, len(own)])
    by_size = np.argsort(-np.minimum(size, FEW + 1).astype(np.int16), kind="stable")  # larger groups first
    start, at_least = first[by_size], len(size) - np.cumsum(np.bincount(np.minimum(size, FEW + 1), minlength=FEW + 2))
    large = at_least[FEW]  # groups of more than FEW; at_least[k]: of more than k
    out = values.take(order[start], axis=0, mode="clip")
    for k in range(1, FEW):  # small groups together: the second value of all, then the third, ...
        out[large : at_least[k]] += values.take(order[start[large : at_least[k]] + k], axis=0, mode="clip")
    for i, (a, n) in enumerate(zip(start[:large].tolist(), size[by_size[:large]].tolist())):
        np.add.reduce(values.take(order[a : a + n], axis=0, mode="clip"), axis=0, out=out[i])
    back = np.empty_like(by_size)
    back[by_size] = np.arange(len(by_size))
    return own[first], out.take(back, axis=0, mode="clip"), size


class Trainer:
    """Gradient steps from given weights; a row's rate falls by its own past gradients."""

    def __init__(self, model: Model):
        self.model = model
        self.past = [np.ones(len(t), np.float32) for t in model.tables]
        self.used = [np.zeros(len(t), np.float32) for t in model.tables]

    def _move(self, k: int, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
        table, past = self.model.tables[k], self.past[k]
        gradient, _ = _exponentials(table, bias, rows, shares=True)
        gradient[np.arange(len(target)), target] -= 1
        for c in range(rows.shape[1]):
            row, move, size = _summed(gradient, rows[:, c])
            self.used[k][row] += size
            grown = past[row] + np.einsum("ij,ij->i", move, move)
            past[row] = grown
            move *= (RATE / np.sqrt(grown))[:, None]
            table[row] = np.subtract(table.take(row, axis=0, mode="clip"), move, out=move)

    def learn(self, symbols: np.ndarray, f: np.ndarray) -> None:
        for a in range(0, len(symbols), STEP):
            for table, tokens, cls, target in self.model.parts(symbols[a : a + STEP]):
                self._move(table, *self.model.choice(table, cls, f[a + tokens]), target)


def _steps(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, features) of documents that together are worth a few steps."""
    held, size = [], 0
    for batch in batches:
        sizes, symbols, *_ = lexicon.read(batch.column(0))
        for own in np.split(symbols, np.cumsum(sizes)[:-1]):
            held.append(own)
            size += len(own)
            if size >= 8 * STEP:
                yield np.concatenate(held), features(held, lexicon.shape.start)
                held, size = [], 0
    if held:
        yield np.concatenate(held), features(held, lexicon.shape.start)


_MOVE = "table int, block int, rows binary, used binary, moves binary"


def _learner(lexicon, weights):
    """Rows of the moves that a task's documents make, by table and block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(lexicon.value, *(t.astype(np.float32) for t in weights.value))
        trainer = Trainer(model)
        for step in _steps(lexicon.value, batches):
            trainer.learn(*step)
        out = []
        for k, table in enumerate(model.tables):
            move = table - weights.value[k].astype(np.float32)
            for a in range(0, len(table), MOVE_ROWS):
                rows = a + np.flatnonzero(trainer.used[k][a : a + MOVE_ROWS])
                if len(rows):
                    out.append((k, a // MOVE_ROWS, rows.astype("<i4").tobytes(), trainer.used[k][rows].astype("<f4").tobytes(), move[rows].astype("<f2").tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["table", "block", "rows", "used", "moves"])

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean move of each row of weights; reads tables and blocks in order."""
    key, used, moves = None, None, None

    def done() -> pa.RecordBatch:
        rows = np.flatnonzero(used)
        mean = (moves[rows] / used[rows, None]).astype("<f2")
        place = (key[1] * MOVE_ROWS + rows).astype("<i4")
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*key, place.tobytes(), mean.tobytes()), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["table", "block", "rows", "moves"])

    for batch in batches:
        for r in batch.to_pylist():
            if (r["table"], r["block"]) != key:
                if key is not None:
                    yield done()
                key = r["table"], r["block"]
                used, moves = np.zeros(MOVE_ROWS, np.float32), 0
            own = np.frombuffer(r["rows"], "<i4") - key[1] * MOVE_ROWS
            weight = np.frombuffer(r["used"], "<f4")
            move = np.frombuffer(r["moves"], "<f2").reshape(len(own), -1)
            moves = np.zeros((MOVE_ROWS, move.shape[1]), np.float32) if isinstance(moves, int) else moves
            used[own] += weight
            moves[own] += weight[:, None] * move
    if key is not None:
        yield done()


def learn_lexicon(training: DataFrame, shape: Shape = Shape(), known: int = KNOWN) -> tuple[DataFrame, Lexicon]:
    """(counts (word, n) of all words, written once; the lexicon of the most frequent ones)."""
    counts = materialise(count_tokens(training), "token_counts")
    size = F.floor(8 * F.log2("n")).cast("int")
    short = counts.where(F.octet_length("word") <= KNOWN_BYTES)
    bins = sorted(((r.size, r.k) for r in short.groupBy(size.alias("size")).agg(F.count("*").alias("k")).collect()), reverse=True)  # a few hundred
    total, least = 0, None
    for b, k in bins:
        if total + k > known:
            break
        total, least = total + k, b
    frequent = [] if least is None else [(bytes(r.word), r.n) for r in short.where(size >= least).collect()]  # at most `known`
    tail = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(shape.tails)).cast("int")
    tails = {r.tail: (r.n, r.k) for r in counts.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    return counts, Lexicon(frequent, training.count(), tails, shape)


def train(training: DataFrame, rounds: tuple[int, ...] = ROUNDS, shape: Shape = Shape(), known: int = KNOWN) -> tuple[DataFrame, Model]:
    """(word counts, model) from all rows (doc_id, text). No rows or words: every token is as likely as the smoothing says."""
    spark = training.sparkSession
    C.bounded_batches(spark)
    counts, lexicon = learn_lexicon(training, shape, known)
    model, shared = Model(lexicon), spark.sparkContext.broadcast(lexicon)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(sum(rounds)))
    first = 0
    for size in rounds:
        weights = spark.sparkContext.broadcast([t.astype(np.float16) for t in model.tables])
        # The same split of the input whatever the share, so no more than TASKS moves are averaged at any size of the corpus.
        own = training.where((share >= first) & (share < first + size)).select("text").coalesce(TASKS)
        moves = own.mapInArrow(C.tidied(_learner(shared, weights)), _MOVE)
        mean = moves.repartition("table", "block").sortWithinPartitions("table", "block").mapInArrow(C.tidied(_mean), "table int, block int, rows binary, moves binary")
        tables = [t.astype(np.float32) for t in weights.value]
        for r in mean.collect():  # one move for each row of weights at most: of fixed size
            rows = np.frombuffer(r.rows, "<i4")
            tables[r.table][rows] += np.frombuffer(r.moves, "<f2").reshape(len(rows), -1)
        model, first = Model(lexicon, *tables), first + size
    return counts, model


_PART = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, words array<binary>, times array<bigint>"


def _tallies(words: pa.Array, owners: np.ndarray, documents: int) -> tuple[pa.Array, pa.Array]:
    """(different words, how often each occurs) of each document, from words and the numbers of their documents."""
    coded = words.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    both, times = np.unique(owners * kinds + coded.indices.to_numpy(), return_counts=True)
    offsets = pa.array(np.searchsorted(both, np.arange(documents + 1) * kinds).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(both % kinds))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))


def _scorer(shared):
    """A row for each document: what follows from known words, and the other words with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        lexicon, size = model.lexicon, model.lexicon.shape.head
        row = TaskContext.get().partitionId() << 40
        scale = math.log(lexicon.tokens + 0.5 * (lexicon.kinds + 1))

        for batch in batches:
            n, symbols, places, strange, owners = lexicon.read(batch.column(1))
            if not len(n):
                continue
            starts = np.cumsum(n) - n
            p = model.log_probabilities(symbols, features(np.split(symbols, starts[1:]), lexicon.shape.start))
            tail = np.flatnonzero(symbols >= size)
            p[tail] -= lexicon.tail_log[symbols[tail] - size]
            known = places >= 0
            counts = np.where(known, lexicon.counts[places], 0)
            own = np.where(known, np.log(counts + 0.5), 0.0)
            p[tail] += own[tail]
            columns = [
                pa.array(row + np.arange(len(n))), batch.column(0).cast(pa.int64()), pa.array(n),
                pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(own, starts) - n * scale), pa.array(np.add.reduceat(p, starts)),
                *_tallies(strange, owners, len(n)),
            ]
            row += len(n)
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "n_known", "base", "score", "words", "times"])

    return run


def score(docs: DataFrame, counts: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; see `score_documents`."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    parts = materialise(narrow.mapInArrow(C.tidied(_scorer(shared)), _PART), "scored")  # row numbers hang on the splits of this one pass
    words = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    rest = words.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log(n + 0.5)).alias("extra")
    )
    extra, ten = F.coalesce("extra", F.lit(0.0)), F.lit(math.log(10))
    return parts.join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.lexicon.tokens).cast("bigint").alias("train_tokens"),
        ((F.col("base") + extra) / ten).alias("base_score"), ((F.col("score") + extra) / ten).alias("score"),
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every text.

    Learned from the rows whose crc32(doc_id as text) mod FOLDS is not HELD_OUT; a null id counts as empty text. Tokens are lower-cased
    (A-Z) words and an end mark, so null and empty texts have one token. base_score: of smoothed word shares; score: of the
    model. Repeated rows are each learned from and scored; very long texts are split in pieces between words. Without training
    rows all words are unknown. No rows, no scores.
    """
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    counts, model = train(narrow.where(C.fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    found = score(narrow, counts, model)
    return found.select("doc_id", (C.fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(C.table(spark, sf_dir, "documents"))


QUERIES = {"op13_lm_score": op13_lm_score}
ORACLE_SQL: dict[str, str] = {}
