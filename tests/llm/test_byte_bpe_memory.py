"""What a worker of the encoder holds: one of them does both ways, and frequent words stay when memory is full."""

import collections

import pytest

from tendergrid.llm import byte_bpe, queries

ROWS = [(1, "a  plain text, 12 words\n"), (1, "a  plain text, 12 words\n"), (2, None), (None, ""), (3, "é\U0001d11e " * 600), (4, " \t x")]


@pytest.fixture(scope="module")
def shared(spark):
    return byte_bpe.share(spark.range(1), *queries.vocabulary())


def test_round_trip_is_encode_then_decode(spark, shared):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    both = byte_bpe.decode(byte_bpe.encode(rows, shared).select("doc_id", "ids"), shared)
    found = byte_bpe.round_trip(rows, shared)
    assert found.columns == both.columns == ["doc_id", "ids", "decoded"]
    got = collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found.collect())
    assert got == collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in both.collect())
    assert collections.Counter(d.decode() for _, _, d in got.elements()) == collections.Counter(t or "" for _, t in ROWS)


def test_one_worker_encodes_and_decodes(spark, capsys):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    byte_bpe.digests(rows, *queries.vocabulary()).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_frequent_words_outlast_full_memory(monkeypatch):
    path, pattern = queries.vocabulary()
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 100_000)
    work = byte_bpe.Encoder(byte_bpe.tables(byte_bpe.read_ranks(path), pattern))
    fresh = byte_bpe.Encoder(byte_bpe.tables(byte_bpe.read_ranks(path), pattern))
    learnt, learn = collections.Counter(), work._learn
    monkeypatch.setattr(work, "_learn", lambda texts: (learnt.update(texts), learn(texts))[1])
    swaps = 0
    for number in range(200):
        text = "qzxvfrequent jkwordy " + " ".join(f"v{number}w{i}" for i in range(20))
        held = work.held[0]
        assert work.encode([text]) == fresh.encode([text])
        swaps += work.held[0] < held
        assert (len(work.words) + len(work.older)) * byte_bpe.ENTRY_BYTES <= 100_000 + 60 * byte_bpe.ENTRY_BYTES
    assert swaps > 3 and learnt["qzxvfrequent"] == learnt[" jkwordy"] == 1
