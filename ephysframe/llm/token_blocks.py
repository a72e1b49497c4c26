"""Token ids in blocks of range asymmetric numeral coding.

Texts are encoded in ascending id order, each ended by an end id, and cut
into blocks of whole texts. One frequency table, counted over all tokens, is
shared by all blocks. In a block the tokens go round lanes, each a rANS
state of its own, whose 32-bit words are interleaved in the order in which
decoding asks for them; checkpoints hold all states and the place in the words
at regular steps, with a checksum of the tokens up to the next, so that the
segments of a block, and the blocks, decode independently of each other.

A written folder holds three Parquet tables: ``table`` (symbol counts),
``blocks`` (ids, lengths and coded bytes) and ``index`` (tokens before a
block).
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, text_or_empty

BLOCK, LANES, STEPS = 1 << 20, 1024, 256
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sBBxxIIIIIQ")
MAGIC = b"rAN1"

#: Kinds of UTF-8 bytes: ASCII letters and digits, white space, other ASCII, and parts of longer characters.
#: Texts may be cut before white space that follows something else, and between a letter or digit and a mark.
#: Cutting marks off words leaves fewer different pieces. The pattern has what some tokenizers take for white space too.
WORD, SPACE, MARK, WIDE = range(4)
_KIND = np.array([WIDE if b > 127 else WORD if chr(b).isalnum() else SPACE if chr(b) in " \n\t\r" else MARK for b in range(256)], np.uint8)
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_OTHER_SPACE = re.compile("[" + "".join(map(chr, (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: First UTF-8 bytes of that white space: only texts that hold one are searched for it.
_SUSPECT = np.isin(np.arange(256), [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])
#: Pieces that a Python worker remembers, of up to 16 ids each on average, and those of a run.
REMEMBERED = 800_000
#: Pieces looked up at once, and bytes of texts encoded at once (one text at least).
AT_ONCE, CHARS = 1 << 21, 1 << 23
#: New pieces encoded as one string: few, as the tokenizer takes longer for a character of a long one.
JOINED = 256
_encoders: dict[tuple[str, int], "Encoder"] = {}


def _gather(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at ``begin``, one after another."""
    # at most AT_ONCE pieces, or one text: places in 32 bits
    place = np.repeat((begin - (np.cumsum(size) - size)).astype(np.int32), size)
    place += np.arange(len(place), dtype=np.int32)
    return ids[place]


def _bytes(texts: pa.LargeStringArray) -> tuple[pa.Buffer, np.ndarray]:
    """The texts' bytes one after another, and where each begins and the last ends."""
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return (data if data is not None else pa.py_buffer(b""))[offsets[0]:offsets[-1]], offsets - offsets[0]


class Encoder:
    """The tokenizer with a memory of pieces.

    A byte-level tokenizer never joins a character with white space that
    follows it, nor a letter or digit with anything else that follows it, so a
    text's ids are the ids of its pieces. Other tokenizers, and texts with other
    kinds of white space or with an added token, get whole texts.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # a space and ASCII letters are one word for the byte-level pattern too, which takes longer; U+0120 stands for the space
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.pieces = pa.array([], pa.large_string())
        self.ids, self.begin, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, begin, size)`` of the pieces; those that may follow one another are encoded in runs."""
        body, offsets = _bytes(pieces)
        body = np.frombuffer(body, np.uint8)
        joined = (_KIND[body[offsets[:-1]]] == SPACE) & (_KIND[body[offsets[1:] - 1]] != SPACE)
        other = np.concatenate([[0], np.cumsum(~_LETTER[body])])
        word = joined & (body[offsets[:-1]] == ord(" ")) & (np.diff(other[offsets]) == 1)
        size, begin = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        found, n = [np.zeros(0, self.dtype)], 0
        for own, tokenizer, space in ((word, self.words, " \u0120"), (joined & ~word, self.tokenizer, " ")):
            text, ends = _bytes(pieces.filter(pa.array(own)))
            cuts = [*range(0, len(ends) - 1, JOINED), len(ends) - 1]
            runs = [text[a:b].to_pybytes().decode().replace(" ", space) for a, b in zip(ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist())]
            ids = [np.array(e.ids, self.dtype) for e in tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
            ids = np.concatenate([np.zeros(0, self.dtype), *ids])
            size[own] = np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends[1:]) + 1, prepend=0)
            begin[own] = n + np.cumsum(size[own]) - size[own]
            found.append(ids)
            n += len(ids)
        alone = [np.frombuffer(x, self.dtype) for x in self.whole(pieces.filter(pa.array(~joined)).to_pylist())]
        size[~joined] = list(map(len, alone))
        begin[~joined] = n + np.cumsum(size[~joined]) - size[~joined]
        return np.concatenate([*found, *alone]), begin, size

    def known(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of different pieces, remembered or learnt, begin, and how many they are."""
        at = pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = at < 0
        if max(len(self.pieces) + np.count_nonzero(missing), len(self.ids) // 16) > REMEMBERED:
            # only what this run has again stays
            kept = at[~missing]
            self.ids, self.size = _gather(self.ids, self.begin[kept], self.size[kept]), self.size[kept]
            self.pieces, self.begin = self.pieces.take(pa.array(kept)), np.cumsum(self.size) - self.size
            at[~missing] = np.arange(len(kept))
        if missing.any():
            new = pieces.filter(pa.array(missing))
            ids, begin, size = self.learn(new)
            at[missing] = np.arange(len(self.pieces), len(self.pieces) + len(new))
            self.begin, self.size = np.append(self.begin, begin + len(self.ids)), np.append(self.size, size)
            self.pieces, self.ids = pa.concat_arrays([self.pieces, new]), np.append(self.ids, ids)
        return self.begin[at], self.size[at]

    def by_pieces(self, texts: pa.LargeStringArray) -> Iterator[bytes]:
        """The ids of each text: cut into pieces, each different one of a run looked up once, gathered by its number."""
        buffer, ends = _bytes(texts)
        kind = _KIND[np.frombuffer(buffer, np.uint8)]
        first = np.zeros(len(kind) + 1, bool)
        first[1:-1] = ((kind[1:] == SPACE) & (kind[:-1] != SPACE)) | ((kind[1:] == MARK) & (kind[:-1] == WORD))
        first[ends] = True
        edges = np.flatnonzero(first)
        n, width = len(edges) - 1, self.dtype.itemsize
        tokens, counts = [], [np.zeros(1, np.int64)]
        for lo in range(0, n, AT_ONCE):
            own = edges[lo:lo + AT_ONCE + 1]
            pieces = pa.LargeStringArray.from_buffers(len(own) - 1, pa.py_buffer(own.astype(np.int64)), buffer).dictionary_encode()
            begin, size = self.known(pieces.dictionary)
            which = pieces.indices.to_numpy()
            counts.append(size[which])
            tokens.append(_gather(self.ids, begin[which], counts[-1]).tobytes())
        data = b"".join(tokens)
        stops = (np.cumsum(np.concatenate(counts))[np.searchsorted(edges, ends)] * width).tolist()
        return (data[a:b] for a, b in zip(stops, stops[1:]))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian numbers."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.by_piece:
            return self.whole(texts.to_pylist())
        body, ends = _bytes(texts)
        hits = np.flatnonzero(_SUSPECT[np.frombuffer(body, np.uint8)])
        odd = {i for i in np.flatnonzero(np.diff(np.searchsorted(hits, ends))).tolist() if _OTHER_SPACE.search(texts[i].as_py())}
        plain = body.to_pybytes() if self.added else b""
        for token in self.added:
            if token.encode() in plain:
                odd.update(np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist())
        if not odd:
            return list(self.by_pieces(texts))
        out: list[bytes | None] = [None] * len(texts)
        rest = [i for i in range(len(texts)) if i not in odd]
        for own, found in ((sorted(odd), self.whole(texts.take(pa.array(sorted(odd))).to_pylist())), (rest, self.by_pieces(texts.take(pa.array(rest, pa.int64()))))):
            for i, ids in zip(own, found):
                out[i] = ids
        return out


def _few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together have about ``CHARS`` bytes, or of one row."""
    size = np.array(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), np.int64)
    run = np.cumsum(size) // CHARS
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _tokenise(path: str, width: int, end_id: int, block: int):
    """Blocks ``(part, blk, ids, lengths, tokens)`` of the rows of a partition, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has one core: the tokenizer's own threads would only take time from the other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.get((path, width)) or _encoders.setdefault((path, width), Encoder(path, width))
        end = np.array([end_id], encoder.dtype).tobytes()
        held: list = [[], [], []]
        total, blk, part, kind = 0, 0, None, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([blk], pa.int32()), pa.array([held[0]], pa.list_(kind)),
                pa.array([held[1]], pa.list_(pa.int64())), pa.array([b"".join(held[2])], pa.binary())], names=["part", "blk", "ids", "lengths", "tokens"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for few in _few(batch):
                if not few.num_rows:
                    continue
                part = few.column("part")[0].as_py()
                for i, ids in zip(few.column("id").to_pylist(), encoder.encode(few.column("text"))):
                    held[0].append(i)
                    held[1].append(len(ids) // width + 1)
                    held[2] += [ids, end]
                    total += held[1][-1]
                    if total >= block:
                        yield flush()
                        held, total, blk = [[], [], []], 0, blk + 1
        if held[0]:
            yield flush()
    return run


def _count(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("tokens"):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2" if width == 2 else "<u4"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["symbol", "n"])
    return run


class Table:
    """Counts scaled to a power of two, each seen symbol at least 1."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.int64), counts[order].astype(np.float64)
        n = len(counts)
        self.bits = max(16, int(n).bit_length() + 2)
        space = 1 << self.bits
        if n:
            share = np.maximum(1, np.floor(counts / counts.sum() * (space - n))).astype(np.int64)
            share[np.argmax(share)] += space - share.sum()
        else:
            share = np.zeros(0, np.int64)
        self.freq = np.zeros(int(self.symbols.max()) + 1 if n else 0, np.uint64)
        self.start = self.freq.copy()
        self.freq[self.symbols] = share
        self.start[self.symbols] = np.concatenate([[0], np.cumsum(share)[:-1]]) if n else 0
        self.of_slot = np.repeat(self.symbols, share).astype(np.uint32)
        self.crc = zlib.crc32(self.symbols.astype("<u4").tobytes() + share.astype("<u8").tobytes())

    def encode(self, tokens: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> bytes:
        """A block: head, checkpoints (states, place in the words, checksum), words."""
        n = len(tokens)
        lanes = max(1, min(lanes, n // 64))
        rows = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        bits, words, marks = np.uint64(self.bits), [], []
        limit = (LOW >> bits) << np.uint64(32)
        for row in range(rows - 1, -1, -1):
            own = tokens[row * lanes:(row + 1) * lanes]
            k = len(own)
            freq, begin, x = self.freq[own], self.start[own], state[:k]
            full = x >= limit * freq
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
            high = x // freq
            state[:k] = (high << bits) + (x - high * freq) + begin
            if row % steps == 0:
                marks.append((state.astype("<u8").tobytes(), row))
        words.reverse()
        sizes = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64) if words else np.zeros(1, np.int64)
        points = [states + struct.pack("<QI", int(sizes[row]), zlib.crc32(tokens[row * lanes:(row + steps) * lanes].astype("<u4").tobytes()))
                  for states, row in reversed(marks)]
        body = b"".join([w.tobytes() for w in words])
        return HEAD.pack(MAGIC, 1, self.bits, self.crc, lanes, steps, len(points), zlib.crc32(body), n) + b"".join(points) + body

    def decode(self, block: bytes, segments: range | None = None) -> np.ndarray:
        """The tokens of a block, or of some of its segments; all segments run side by side."""
        magic, version, bits, crc, lanes, steps, n_points, body_crc, n = HEAD.unpack_from(block)
        if magic != MAGIC or version != 1 or crc != self.crc or bits != self.bits:
            raise ValueError("not a block of this table")
        point = lanes * 8 + 12
        body = memoryview(block)[HEAD.size + n_points * point:]
        if segments is None and zlib.crc32(body) != body_crc:
            raise ValueError("the words' checksum differs")
        words = np.frombuffer(body, "<u4").astype(np.uint64)
        chosen = list(segments if segments is not None else range(n_points))
        if not chosen:
            return np.zeros(0, np.uint32)
        at = [HEAD.size + s * point for s in chosen]
        state = np.stack([np.frombuffer(block, "<u8", lanes, a) for a in at]).astype(np.uint64)
        place = np.array([struct.unpack_from("<Q", block, a + lanes * 8)[0] for a in at], np.int64)
        sums = [struct.unpack_from("<I", block, a + lanes * 8 + 8)[0] for a in at]
        first = np.array(chosen, np.int64) * steps * lanes
        size = np.minimum(n - first, steps * lanes)
        out = np.zeros((len(chosen), steps, lanes), np.uint32)
        shift, mask, lane = np.uint64(self.bits), np.uint64((1 << self.bits) - 1), np.arange(lanes)
        for step in range(int(-(-size.max() // lanes))):
            live = lane[None, :] < (size - step * lanes)[:, None]
            slot = state & mask
            symbol = self.of_slot[slot]
            x = self.freq[symbol] * (state >> shift) + slot - self.start[symbol]
            need = live & (x < LOW)
            index = place[:, None] + np.cumsum(need, axis=1) - 1
            x[need] = (x[need] << np.uint64(32)) | words[index[need]]
            place += need.sum(axis=1)
            state = np.where(live, x, state)
            out[:, step] = symbol
        parts = [out[i].ravel()[:k] for i, k in enumerate(size.tolist())]
        for p, s in zip(parts, sums):
            if zlib.crc32(p.astype("<u4").tobytes()) != s:
                raise ValueError("a segment's checksum differs")
        return np.concatenate(parts)


def _table(counts: DataFrame) -> Table:
    # one row for each token of the vocabulary at most
    rows = counts.toPandas()
    return Table(rows["symbol"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def write(docs: DataFrame, path: str, tokenizer: str, vocab: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Encode every whole text of ``docs`` to the folder ``path``, in ascending id order (null first, equal ids by text).

    A null text is empty: its tokens are the end id alone. An empty table
    gives a folder without blocks.
    """
    width = 2 if vocab <= 1 << 16 else 4
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # by text hash too: rows of one id, null among them, are not one partition's
    order = ("id", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    spark = docs.sparkSession
    raw = scratch(spark, "token-ids")
    schema = f"part int, blk int, ids array<{kind}>, lengths array<bigint>, tokens binary"
    dealt.mapInArrow(_tokenise(tokenizer, width, end_id, block), schema).write.option("compression", "zstd").parquet(raw)
    plain = spark.read.schema(schema).parquet(raw)
    counts = plain.select("tokens").mapInArrow(_count(width, max(vocab, end_id + 1)), "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(_table(spark.read.schema("symbol int, n long").parquet(f"{path}/table")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                tokens = np.frombuffer(one.column("tokens")[0].as_buffer(), "<u2" if width == 2 else "<u4")
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("part", "blk", "ids", "lengths")), pa.array([table.encode(tokens)], pa.binary())],
                                                 names=["part", "blk", "ids", "lengths", "coded"])

    plain.mapInArrow(run, f"part int, blk int, ids array<{kind}>, lengths array<bigint>, coded binary").write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = plain.select("part", "blk", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sizes = materialise(sizes, "token-sizes")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition of the range shuffle
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.cast("long").alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("inside", inside).join(parts, "part").select("part", "blk", (F.col("base") + F.col("inside")).cast("long").alias("start")).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, tokens)`` of each text of a written folder: tokens before it, and its own as an array with the end id."""
    return _decoded(spark, path, lambda kind: (f"id {kind}, at long, part int, blk int, tokens array<long>", pa.list_(pa.int64()), lambda ids: ids.astype(np.int64)), "tokens")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read` with ``n_tokens`` and ``ids_crc32``, the checksum of the ids as little-endian 32-bit numbers, for the tokens."""
    out = _decoded(spark, path, lambda kind: (f"id {kind}, at long, part int, blk int, digest struct<n:long,crc:long>", pa.struct([("n", pa.int64()), ("crc", pa.int64())]),
                                              lambda ids: {"n": len(ids), "crc": zlib.crc32(ids.astype("<u4").tobytes())}), "digest")
    return out.select("id", "start", F.col("digest.n").alias("n_tokens"), F.col("digest.crc").alias("ids_crc32"))


def _decoded(spark: SparkSession, path: str, shape, name: str) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    shared = spark.sparkContext.broadcast(_table(spark.read.schema("symbol int, n long").parquet(f"{path}/table")))
    schema, arrow, of = shape(blocks.schema["ids"].dataType.elementType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                tokens = table.decode(batch.column("coded")[i].as_py())
                ends = np.cumsum(lengths)
                values = [of(tokens[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                ids = batch.column("ids").slice(i, 1).flatten()
                part, blk = batch.column("part")[i].as_py(), batch.column("blk")[i].as_py()
                yield pa.RecordBatch.from_arrays([ids, pa.array(ends - lengths), pa.array([part] * len(ids), pa.int32()), pa.array([blk] * len(ids), pa.int32()),
                                                  pa.array(values, arrow)], names=["id", "at", "part", "blk", name])

    texts = blocks.select("part", "blk", "ids", "lengths", "coded").mapInArrow(run, schema)
    index = spark.read.schema("part int, blk int, start long").parquet(f"{path}/index")
    return texts.join(index, ["part", "blk"]).select("id", (F.col("start") + F.col("at")).alias("start"), name)
