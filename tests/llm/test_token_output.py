import collections
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from ledgerspark.llm import token_output as O
from ledgerspark.session import materialise
from tests.llm.frames import DOCS, edge_docs, edge_rows, no_docs, words


@pytest.fixture(scope="module")
def coder():
    with open(O.TOKENIZER, "rb") as file:
        return O.Tokenizer(file.read())


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 16, 17, 100, 4096, 4097])
def test_slots_are_a_permutation(total):
    assert sorted(O.slots(np.arange(total), total)) == list(range(total))
    if total > 50:
        assert list(O.slots(np.arange(total), total, 1)) != list(O.slots(np.arange(total), total, 2))


@pytest.mark.parametrize("text", ["a  b", "a\n b", " a", "a ", "\n\n a", "a \n", "é  b", "  ", " ", "a   b\t c", "It's x, y! 12 34", "a\nb\tc\u2003d\u0085e f\n", "x\u001cy\u001c\u001cz", "tail ", "a\u00a0b \u3000c", "\ufeffx <|endoftext|> y"])
def test_tokens_decode_to_the_text(coder, text):
    ids = np.frombuffer(coder.encode(text), coder.kind)
    assert ids.tolist() == coder.coder.encode_ordinary(text)
    assert len(ids) == coder.count(text) and coder.coder.decode(ids.tolist()) == text
    parts = coder.sequences(text, 4)
    assert b"".join(p[: n * coder.kind.itemsize] for p, n in parts) == coder.encode(text) + np.array([coder.end], coder.kind).tobytes()


def stored(spark, rows):
    return materialise(spark.createDataFrame(rows, DOCS).repartition(3), "docs")


def test_round_trip_and_resumed_read(spark, coder):
    texts = {i: words(i, 5 + 37 * i) for i in range(40)}
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/shards"
    docs = stored(spark, [(i, t, "en", "a", 0) for i, t in texts.items()])
    index = O.write(docs, out, length=32, shard_bytes=32 * 2 * 10).collect()
    sequences = list(O.read(out))
    assert sorted(r.slot for r in index) == list(range(len(sequences)))
    parts = collections.defaultdict(dict)
    for r in index:
        own = sequences[r.slot]
        assert (r.shard, r.row) == divmod(r.slot, 10) and zlib.crc32(own.tobytes()) == r.crc32
        assert (own[r.n_tokens :] == coder.end).all()
        parts[r.doc_id][r.part] = own[: r.n_tokens]
    for i, t in texts.items():
        ids = np.concatenate([parts[i][k] for k in sorted(parts[i])])
        assert ids[-1] == coder.end and coder.coder.decode(ids[:-1].tolist()) == t
    assert [x.tolist() for x in O.read(out, 13, 37)] == [x.tolist() for x in sequences[13:37]]
    again = O.write(docs, None, length=32, shard_bytes=32 * 2 * 10).collect()
    assert sorted(again) == sorted(index)


def test_edge_rows(spark):
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/shards"
    index = O.write(materialise(edge_docs(spark), "docs"), out).collect()
    texts = [(r[0], r[1]) for r in edge_rows() if r[1]]
    assert collections.Counter(r.doc_id for r in index if r.part == 0) == collections.Counter(i for i, _ in texts)
    assert sum(1 for _ in O.read(out)) == len(index)
    assert O.write(materialise(no_docs(spark), "docs")).count() == 0


def test_splits_that_change_on_the_way_lose_nothing(spark, monkeypatch):
    """Executors that come or go change the splits between two reads of the same files."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    docs = stored(spark, [(i, words(i, 5 + 37 * i), "en", "a", 0) for i in range(40)])
    wanted = sorted((r.doc_id, r.part, r.n_tokens) for r in O.write(docs, None, length=32, shard_bytes=640).collect())

    def changed(session, name_, scratch=O.new_scratch):
        session.conf.set(name, "3000")
        return scratch(session, name_)

    monkeypatch.setattr(O, "new_scratch", changed)
    try:
        index = O.write(docs, None, length=32, shard_bytes=640).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted((r.doc_id, r.part, r.n_tokens) for r in index) == wanted
    assert sorted(r.slot for r in index) == list(range(len(wanted)))


def test_a_shard_with_a_slot_missing_or_twice_fails(tmp_path):
    run = O._writer(str(tmp_path), 2, 4, 2)
    pack = zstandard.ZstdCompressor().compress(b"abcdabcd")
    for slot in ([0, 0], [0]):
        one = np.ones(len(slot), int)
        row = {"task": 0, "shard": 0, "n": len(slot), "about": O._packed([1] * len(slot), np.array(slot), one, one), "tokens": pack}
        with pytest.raises(RuntimeError):
            list(run([pa.RecordBatch.from_pylist([row])]))
    assert not list(tmp_path.iterdir())
