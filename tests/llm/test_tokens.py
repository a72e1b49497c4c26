"""Token blocks: exact round trips, independent segments, checksums, order."""

import sys
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llmdata import SCHEMA, documents, frame
from tokenizers import Tokenizer

from ephysframe.llm import queries, token_blocks
from ephysframe.llm.common import scratch

BPE = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.integers(1, 9), st.integers(1, 5))
def test_block_round_trip(tokens, lanes, steps):
    x = np.array(tokens, np.uint16)
    symbols, counts = np.unique(np.append(x, 7), return_counts=True)
    table = token_blocks.Table(symbols, counts)
    assert table.decode(table.encode(x, lanes, steps)).tolist() == tokens


def test_segments_decode_alone_and_damage_is_found():
    x = np.random.default_rng(0).zipf(1.2, 50_000) % 50_257
    table = token_blocks.Table(*np.unique(x, return_counts=True))
    block = table.encode(x.astype(np.uint16), lanes=64, steps=100)
    assert table.decode(block, range(3, 4)).tolist() == x[3 * 6400:4 * 6400].tolist()
    assert len(block) * 8 / len(x) < 1.1 * -sum(p * np.log2(p) for p in np.unique(x, return_counts=True)[1] / len(x))
    broken = bytearray(block)
    broken[-5] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        table.decode(bytes(broken))
    with pytest.raises(ValueError, match="not a block"):
        token_blocks.Table(np.array([1]), np.array([1])).decode(block)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r!?.'s\xa0　\x1c<|endoftext|>"), st.characters(codec="utf-8"))), max_size=4))
def test_pieces_equal_whole_texts(texts):
    encoder = token_blocks.Encoder(BPE, 2)
    whole = [np.array(e.ids, "<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == whole


def test_memory_of_pieces_turns_over(monkeypatch):
    monkeypatch.setattr(token_blocks, "REMEMBERED", 5)
    encoder = token_blocks.Encoder(BPE, 4)
    texts = [f" w{i} x{i % 3} y{i}" for i in range(40)]
    assert encoder.encode(texts) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_runs_of_pieces_and_texts(monkeypatch, at_once):
    monkeypatch.setattr(token_blocks, "AT_ONCE", at_once)
    monkeypatch.setattr(token_blocks, "CHARS", 50)
    encoder = token_blocks.Encoder(BPE, 4)
    texts = ["", "it's a_b __!? x2y\n\n \t end ", "", "a" * 70, "é–a. ßß!", " ", "a  b   c", "", "\n", "it's", ""]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    assert encoder.encode([]) == [] and encoder.encode(["", ""]) == [b"", b""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    few = list(token_blocks._few(batch))
    assert len(few) > 1 and [t for b in few for t in b.column("text").to_pylist()] == texts


def test_words_among_other_pieces():
    encoder = token_blocks.Encoder(BPE, 2)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from([" ", "the", "Word", "zqx", "e", "é", "Ġ", "'", "s", "1", "\n", ".", "\u212a"]), max_size=30))
    def check(parts):
        text = "".join(parts)
        assert encoder.encode([text]) == [np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]

    check()


def test_no_call_for_each_piece():
    encoder = token_blocks.Encoder(BPE, 2)
    texts = ["".join(f" w{i:x}q" for i in range(j, j + 1000)) for j in range(0, 20_000, 1000)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = encoder.encode(texts), encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert got == (want, want)
    assert calls < 5_000  # of 20,000 different pieces, learnt and looked up


def test_pieces_kept_through_a_turn_over(monkeypatch):
    monkeypatch.setattr(token_blocks, "REMEMBERED", 6)
    encoder = token_blocks.Encoder(BPE, 2)
    learnt, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda pieces: learnt.append(pieces.to_pylist()) or learn(pieces))
    for text in ("a. b c", "d c b e f", "f b\t c", " b c"):
        assert encoder.encode([text]) == [np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]
    assert learnt == [["a", ".", " b", " c"], ["d", " e", " f"], ["f", "\t c"], [" c"]]


def test_added_tokens_inside_texts():
    encoder = token_blocks.Encoder(BPE, 2)
    texts = ["a <|endoftext|> b", "x y", "<|endoftext|>", "", "it's<|endoftext|>\n", "<|endoftext"]
    assert encoder.encode(texts) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    sliced = pa.array(["\xa0 left out", *texts, "é left out"]).slice(1, len(texts))
    assert encoder.encode(sliced) == encoder.encode(texts)


def test_folder_of_odd_rows(spark):
    rows = documents()
    path = scratch(spark, "test-tokens")
    token_blocks.write(frame(spark, rows), path, BPE, 50_257, block=2000)
    got = sorted(token_blocks.read(spark, path).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(BPE)
    at, ids = 0, []
    for r in got:
        assert r.start == at
        at += len(r.tokens)
        ids.append(r.id)
    assert ids == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    expect = sorted((-1 if r[0] is None else r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows)
    assert sorted((-1 if r.id is None else r.id, r.tokens) for r in got) == expect
    assert spark.read.parquet(f"{path}/blocks").count() > 3
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_blocks.read_digests(spark, path).collect()) == [
        (r.start, len(r.tokens), zlib.crc32(np.array(r.tokens, "<u4").tobytes())) for r in got]


def test_rows_of_one_id_are_dealt_to_several_ranges(spark):
    texts = [f"row {i} of one id" for i in range(600)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(1, "last")], "doc_id long, text string")
    path = scratch(spark, "test-tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_blocks.write(docs, path, BPE, 50_257)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.where("exists(ids, i -> i is null)").select("part").distinct().count() > 1
    got = sorted(token_blocks.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None] * 600 + [1]
    assert [r.start for r in got] == np.cumsum([0, *(len(r.tokens) for r in got[:-1])]).tolist()
    tokenizer = Tokenizer.from_file(BPE)
    assert sorted(tuple(r.tokens) for r in got) == sorted((*tokenizer.encode(t, add_special_tokens=False).ids, 0) for t in [*texts, "last"])


def test_query_against_whole_encodings(spark):
    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(BPE)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op2_rans_tokens"](spark, sf).collect()}
    at = 0
    for i, text in docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert got.pop(i) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_empty_folder(spark):
    path = scratch(spark, "test-tokens")
    token_blocks.write(spark.createDataFrame([], SCHEMA), path, BPE, 50_257)
    assert token_blocks.read(spark, path).count() == 0
