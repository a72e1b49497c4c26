"""Removal of repeated byte strings by suffix arrays.

A string of LENGTH bytes that starts in two places is found through the
smallest k-gram hash inside it, which both places share (its anchor). Anchors
that occur once cannot lie in a repeated string and are left out by a join on
counts. What surrounds the others is dealt into shards by anchor, so that
equal strings meet in a shard: each shard builds a suffix array of its
distinct surroundings by Larsson-Sadakane refinement, Kasai's common prefixes
tell which strings repeat, and an anchor with more distinct surroundings than
a shard takes is spread over several shards whose sorted strings are merged by
binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import _power, mixed, slices
from .common import by_group, groups, materialise, text_or_empty

LENGTH, GRAM = 200, 32
#: Surroundings of a shard; with LENGTH and GRAM this keeps a suffix array under 2**21 symbols.
SHARD = 5000
#: Bits of a symbol's index and of a rank in a sort key.
BITS = 21


def anchors(body: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """``(row, first start, starts, anchor hash, hash of the surroundings)`` of each anchor.

    The strings starting at ``first start`` and the next ``starts - 1`` bytes
    of a row have this anchor; the surroundings span all of them.
    """
    n, w = len(body), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    value = (total[gram:] - total[:-gram]) * inverse[:n - gram + 1]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    # smallest value of each window of w grams: windows of powers of two, two of which cover it
    short = (value >> np.uint64(32)).astype(np.uint32)
    low, span = short, 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    m = n - length + 1
    low = np.minimum(low[:m], low[w - span:w - span + m])
    # starts whose string lies inside one row
    number = np.maximum(np.diff(offsets) - length + 1, 0)
    if not number.any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    row = np.repeat(np.arange(len(number)), number)
    start = np.arange(len(row)) + np.repeat(offsets[:-1] - np.cumsum(number) + number, number)
    low = low[start]
    # a run of starts has one smallest value; its first place is the anchor as long as the place is inside the window
    new = np.ones(len(start), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    stop = np.append(head[1:], len(start))
    place = np.concatenate([start[x] + short[start[x][:, None] + np.arange(w)].argmin(axis=1) for x in np.array_split(head, len(head) // 2048 + 1)])
    single = start[stop - 1] <= place
    firsts, counts, places = [head[single]], [(stop - head)[single]], [place[single]]
    for a, b in zip(head[~single].tolist(), stop[~single].tolist()):
        s = start[a:b]
        here = s[0] + np.flatnonzero(short[s[0]:s[-1] + w] == low[a])
        own = here[np.searchsorted(here, s)]
        cut = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
        firsts.append(a + cut)
        counts.append(np.diff(np.append(cut, b - a)))
        places.append(own[cut])
    first, count, place = np.concatenate(firsts), np.concatenate(counts), np.concatenate(places)
    begin = start[first]
    end = begin + count + length - 1
    around = mixed((total[end] - total[begin]) * inverse[begin] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = row[first]
    return own, begin - offsets[own], count, mixed(value[place]), around


def _anchor_rows(length: int, gram: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, body, offsets in slices(batch.column("text")):
                row, start, count, h, c = anchors(body, offsets, length, gram)
                if full:
                    take = pa.array(first + row)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("id").take(take), batch.column("th").take(take), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                        pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], names=["id", "th", "s", "n", "h", "c"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])
    return run


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(suffix array, rank)`` of a string of non-negative symbols in which each 0 is a separator unlike any other, earlier ones smaller.

    Larsson-Sadakane: suffixes are grouped by their first symbols, and each
    round doubles the length by sorting the groups of more than one suffix by
    the groups of what follows; sorted suffixes are not touched again.
    """
    n = len(symbols)
    mask, index = np.int64((1 << BITS) - 1), np.arange(n, dtype=np.int64)
    padded = np.concatenate([symbols, np.zeros(4, np.int64)])
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    for j in range(4):
        ended |= padded[j:j + n] == 0
        key = (key << 9) | np.where(ended, 0, padded[j:j + n])
    key = np.sort((key << BITS) | index)
    sa = key & mask
    key >>= BITS
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ended[sa[1:]]
    head = np.maximum.accumulate(np.where(new, index, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    size = np.diff(np.append(np.flatnonzero(new), n))
    open_at = np.repeat(size > 1, size)
    slots = np.flatnonzero(open_at)  # places in the array that are not sorted yet
    h = 4
    while len(slots):
        own = sa[slots]
        key = np.sort((rank[own] << (2 * BITS)) | (rank[own + h] << BITS) | own)
        own = key & mask
        key >>= BITS
        group = key >> BITS
        sa[slots] = own
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        outer = np.ones(len(slots), bool)
        outer[1:] = group[1:] != group[:-1]
        here = np.arange(len(slots))
        inner_at = np.maximum.accumulate(np.where(new, here, 0))
        outer_at = np.maximum.accumulate(np.where(outer, here, 0))
        rank[own] = group + inner_at - outer_at
        size = np.diff(np.append(np.flatnonzero(new), len(slots)))
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return sa, rank


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, stride: int = 8) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, by suffix.

    Kasai: the value at i is at least the value at i - 1 less one. Every
    ``stride``-th suffix is compared from its first symbol, the others from
    the bound that the one before them gives.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    # seven symbols as one number, and whether none of them is a separator
    padded = np.concatenate([symbols, np.zeros(7, np.int64)])
    packed, clean = np.zeros(n + 1, np.int64), np.ones(n + 1, bool)
    for j in range(7):
        packed = (packed << 9) | padded[j:j + n + 1]
        clean &= padded[j:j + n + 1] > 0
    out = np.zeros(n, np.int64)
    for k in range(stride):
        own = np.arange(k, n, stride)
        if k:
            out[own] = np.maximum(out[own - 1] - 1, 0)
        out[own[before[own] < 0]] = 0
        own = own[before[own] >= 0]
        at = own
        while len(at):
            i = at + out[at]
            at = at[clean[i] & (packed[i] == packed[before[at] + out[at]])]
            out[at] += 7
        at = own
        while len(at):
            a = padded[at + out[at]]
            at = at[(a > 0) & (a == padded[before[at] + out[at]])]
            out[at] += 1
    return out


def repeated_starts(around: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place of each piece, repeated, same as the start before)``: flags by byte of the joined pieces."""
    size = np.array([len(x) for x in around], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    symbols = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[first + size] = False
    symbols[inside] = np.concatenate(around).astype(np.int64) + 1
    sa, _ = suffix_array(symbols)
    lcp = common_prefixes(symbols, sa)
    same = lcp >= length
    repeated = same.copy()
    after = np.zeros(len(sa), bool)
    after[sa[:-1]] = same[sa[1:]]
    return first, repeated | after, same


def _runs(flags: np.ndarray, length: int) -> list[dict]:
    """Covered byte ranges of a piece from the flags of its starts."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"a": int(a), "b": int(b) + length - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _shards(length: int, limit: int):
    """Rows ``(h, c, ranges, w1, w2, s)``: ranges found in a shard, and for spread anchors each distinct string not found twice or to be met by others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["shard", "sub"]):
            h, c = g.column("h").to_numpy(), g.column("c").to_numpy()
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])  # equal rows come as often as the table has them
            g = g.filter(pa.array(keep))
            h, c = h[keep], c[keep]
            around, count, parts = g.column("around"), g.column("n").to_numpy(), g.column("parts").to_numpy()
            known = g.column("known").to_numpy(zero_copy_only=False)
            # whole anchors, as many as a suffix array takes
            heads = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)).tolist()
            cuts = [0]
            for a, b in zip(heads, heads[1:]):
                if b - cuts[-1] > limit and a > cuts[-1]:
                    cuts.append(a)
            cuts.append(len(h))
            for lo, hi in zip(cuts, cuts[1:]):
                pieces = [np.frombuffer(x.as_buffer(), np.uint8) for x in around.slice(lo, hi - lo)]
                first, repeated, same = repeated_starts(pieces, length)
                rows: list[list] = [[], [], [], [], [], []]
                for k in range(lo, hi):
                    at = first[k - lo]
                    flags = repeated[at:at + count[k]] | bool(known[k])
                    for col, v in zip(rows, (int(h[k]), int(c[k]), _runs(flags, length), None, None, None)):
                        col.append(v)
                    if parts[k] > 1:
                        piece = pieces[k - lo]
                        power, inverse = _power(len(piece) + 1)
                        for seed, store in ((1, 3), (7, 4)):
                            total = np.zeros(len(piece) + 1, np.uint64)
                            np.cumsum((mixed(piece.astype(np.uint64) + np.uint64(seed))) * power[:len(piece)], out=total[1:])
                            n = int(count[k])
                            key = mixed((total[length:length + n] - total[:n]) * inverse[:n])
                            once = ~same[at:at + n]  # one of equal strings stands for them
                            rows[store] += key[once].view(np.int64).tolist()
                        new = np.flatnonzero(once)
                        rows[0] += [int(h[k])] * len(new)
                        rows[1] += [int(c[k])] * len(new)
                        rows[2] += [None] * len(new)
                        rows[5] += new.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(rows, (pa.int64(), pa.int64(), RANGES, pa.int64(), pa.int64(), pa.int32()))],
                                                 names=["h", "c", "ranges", "w1", "w2", "s"])
    return run


def _merged(length: int):
    """Strings of spread anchors that another shard has too: each shard's sorted run is looked up in the other runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["h", "bucket"]):
            sub, w1, w2 = (g.column(k).to_numpy() for k in ("sub", "w1", "w2"))
            order = np.lexsort((w2, w1))
            keys = w1[order]
            found = np.zeros(len(keys), bool)
            lo, hi = np.searchsorted(keys, w1, "left"), np.searchsorted(keys, w1, "right")
            for step in range(int((hi - lo).max())):
                at = np.minimum(lo + step, hi - 1)
                other = order[at]
                found |= (w2[other] == w2) & (sub[other] != sub)
            g = g.filter(pa.array(found))
            rows = [[{"a": s, "b": s + length}] for s in g.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([g.column("h").combine_chunks(), g.column("c").combine_chunks(), pa.array(rows, RANGES)], names=["h", "c", "ranges"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept, sizes = [], [], []
        for text, ranges in zip(batch.column("text").fill_null("").cast(pa.binary()), batch.column("ranges").to_pylist()):
            body = text.as_py()
            runs: list[dict] = []
            for a, b in sorted((x["a"], x["b"]) for x in ranges or []):
                if runs and a <= runs[-1]["b"]:
                    runs[-1]["b"] = max(runs[-1]["b"], b)
                else:
                    runs.append({"a": a, "b": b})
            out, at = [], 0
            for r in runs:
                out.append(body[at:r["a"]])
                at = r["b"]
            out.append(body[at:])
            spans.append(runs)
            kept.append(b"".join(out))
            sizes.append(len(body))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(spans, RANGES), pa.array(kept, pa.binary())],
                                         names=["id", "th", "n_bytes", "spans", "kept"])


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, limit: int = SHARD) -> DataFrame:
    """``(id, th, n_bytes, spans, kept)`` for each row: the removed byte ranges (first, end) and the bytes that are left.

    Each byte covered by a string of ``length`` bytes that also starts
    elsewhere, in the same row or another, goes. Strings are judged on the
    input, so all copies go. A null text counts as empty; texts shorter than
    ``length`` stay whole; equal rows are copies of each other.
    """
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = rows.select("text").mapInArrow(_anchor_rows(length, gram, False), "h long").groupBy("h").count()
    often = materialise(counts.where("count > 1").select("h"), "suffix-anchors")
    every = rows.mapInArrow(_anchor_rows(length, gram, True), f"id {kind}, th long, s int, n int, h long, c long")
    live = materialise(every.join(often, "h", "left_semi"), "suffix-live")
    classes = live.groupBy("h", "c", "n").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th", "s")).alias("at"))
    classes = materialise(classes, "suffix-classes")
    kinds = classes.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_ = materialise(classes.join(kinds, "h").select("h", "c", "n", "kinds", (F.col("times") > 1).alias("known"), F.col("at.id").alias("__id"),
                                                        F.col("at.th").alias("__th"), F.col("at.s").alias("s")), "suffix-open")
    n_shards = max(1, open_.count() // limit)
    body = F.substring(F.col("text").cast("binary"), F.col("s") + 1, F.col("n") + (length - 1))
    around = rows.join(open_, rows["id"].eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    parts = F.ceil(F.col("kinds") / F.lit(limit)).cast("int")
    around = around.select(F.pmod("h", F.lit(n_shards)).alias("shard"), F.pmod("c", parts).cast("int").alias("sub"), "h", "c", "n", "known", parts.alias("parts"), body.alias("around"))
    found = by_group(around, ["shard", "sub"], "h", "c").mapInArrow(_shards(length, limit), "h long, c long, ranges array<struct<a:int,b:int>>, w1 long, w2 long, s int")
    found = materialise(found, "suffix-found")
    # anchors spread over several shards
    sub = classes.join(kinds.where(F.col("kinds") > limit), "h").select("h", "c", F.pmod("c", parts).cast("int").alias("sub"))
    loose = found.where("s is not null").join(sub, ["h", "c"]).withColumn("bucket", F.pmod("w1", F.lit(4096)))
    met = by_group(loose.select("h", "bucket", "sub", "c", "w1", "w2", "s"), ["h", "bucket"]).mapInArrow(_merged(length), "h long, c long, ranges array<struct<a:int,b:int>>")
    ranges = found.where("s is null and size(ranges) > 0").select("h", "c", "ranges").union(met)
    closed = classes.join(kinds, "h", "left_anti").select("h", "c", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + (length - 1)).cast("int").alias("b"))).alias("ranges"))
    ranges = ranges.union(closed).select("h", "c", F.explode("ranges").alias("r"))
    places = live.join(ranges, ["h", "c"]).select("id", "th", F.struct((F.col("s") + F.col("r.a")).alias("a"), (F.col("s") + F.col("r.b")).alias("b")).alias("r"))
    per = places.groupBy("id", "th").agg(F.collect_set("r").alias("ranges")).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "ranges")
    both = rows.join(per, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").select("id", "th", "text", "ranges")
    return both.mapInArrow(_cut, f"id {kind}, th long, n_bytes long, spans array<struct<a:int,b:int>>, kept binary")
