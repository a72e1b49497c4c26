"""Hard-negative mining by Kronecker-packed products.

Vectors are made integers. Several candidates' components, biased so that none
is negative, lie side by side in separated fields of one wide integer; one
multiplication by an anchor's biased component adds to the products of all of
them, and no field overflows into the next. The biases' share is subtracted
when the fields are taken apart, so scores are exact.

Anchors and candidates are dealt to blocks by hash, whatever their labels, and
every anchor block meets every candidate block in a task of its own, which
returns its few best rows for each anchor: first the anchor's positives, then,
with the positives' scores known, the negatives in the band that they set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, groups, materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
#: Bytes of vectors in a block of candidates, and anchors in a block.
BLOCK_BYTES, ANCHOR_BLOCK = 4 << 20, 2048
#: Anchors and packed integers that are multiplied at once, few enough to stay in a core's cache.
TILE_ANCHORS, TILE_WORDS = 16, 2048
#: Integer components beyond this magnitude, and sums of products beyond it, are Python's integers of any width, so many fields in each.
NARROW, WIDE_FIELDS = 1 << 62, 4
LONG = np.iinfo(np.int64)


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of each component: 64-bit integers, or Python's where some are too large. No component counts as a single 0."""
    if not vectors.shape[1]:
        return np.zeros((len(vectors), 1), np.int64)
    x = np.floor(vectors * float(scale))
    if np.abs(x).max(initial=0) < NARROW:
        return x.astype(np.int64)
    return np.array([[math.floor(Fraction(c) * scale) for c in row] for row in vectors.tolist()], object)


class Packed:
    """Candidates' integer vectors (rows), packed for products with the given anchors."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        n, dim = rows.shape
        largest = [max(abs(int(x.min())), abs(int(x.max()))) for x in (rows, anchors)]
        wide = dim * largest[0] * largest[1] >= NARROW
        if wide:
            rows, anchors = rows.astype(object), anchors.astype(object)
        self.n, self.signed = n, object if wide else np.int64
        self.bias, self.anchor_bias = -rows.min(axis=0), -anchors.min(axis=0)
        own, other = rows + self.bias, anchors + self.anchor_bias
        most = sum(int(a) * int(b) for a, b in zip(own.max(axis=0).tolist(), other.max(axis=0).tolist()))
        self.bits = max(1, most.bit_length())
        self.kind = object if wide or self.bits > 64 else np.uint64
        self.fields = WIDE_FIELDS if self.kind is object else 64 // self.bits
        full = np.zeros((-(-n // self.fields) * self.fields, dim), self.kind)
        full[:n] = own.astype(self.kind)
        part = full.reshape(-1, self.fields, dim)
        word = part[:, 0].copy()
        for f in range(1, self.fields):
            word += part[:, f] << self._number(f * self.bits)
        self.word = np.ascontiguousarray(word.T)
        # (a + A)(c + B) = ac + (a + A)B + Ac: the last, summed, for each candidate
        self.share = (rows * self.anchor_bias).sum(axis=1)

    def _number(self, x: int):
        return x if self.kind is object else np.uint64(x)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors by candidates; one beyond 64 bits is the nearest 64-bit integer."""
        biased = anchors.astype(self.signed) + self.anchor_bias
        share = (biased * self.bias).sum(axis=1)
        biased = biased.astype(self.kind)
        q, dim = anchors.shape
        out = np.empty((q, self.word.shape[1], self.fields), self.signed)
        mask = self._number((1 << self.bits) - 1)
        for w in range(0, self.word.shape[1], TILE_WORDS):
            word = self.word[:, w:w + TILE_WORDS]
            total = np.zeros((q, word.shape[1]), self.kind)
            room = np.empty_like(total)
            for d in range(dim):
                total += np.multiply(biased[:, d:d + 1], word[d], out=room)
            for f in range(self.fields):
                out[:, w:w + TILE_WORDS, f] = ((total >> self._number(f * self.bits)) & mask).astype(self.signed)
        exact = out.reshape(q, -1)[:, :self.n] - share[:, None] - self.share[None, :]
        return np.clip(exact, LONG.min, LONG.max).astype(np.int64) if self.signed is object else exact


def _best(score: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Of ``rows`` (ascending), those of the greatest scores, earlier rows first among equals."""
    if len(rows) > most:
        own = score[rows]
        least = np.partition(own, len(own) - most)[len(own) - most]
        above = np.flatnonzero(own > least)
        equal = np.flatnonzero(own == least)[:most - len(above)]
        rows = rows[np.sort(np.concatenate([above, equal]))]
    return rows[np.argsort(~score[rows], kind="stable")]


class _Block:
    """Rows of one dimension that meet in a task: candidates by ascending id (null last), and anchors."""

    def __init__(self, table: pa.Table, scale: int):
        self.rid = table.column("rid").to_numpy()
        self.id = table.column("id").combine_chunks()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.vector = integers(flat.reshape(len(self.rid), -1) if len(flat) else np.zeros((len(self.rid), 0)), scale)
        self.label = table.column("label").combine_chunks()


def _meetings(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.Table, _Block, _Block, np.ndarray, np.ndarray]]:
    """``(anchor rows, anchors, candidates, label codes of both)`` of each pair of blocks and dimension that has both."""
    for g in groups(batches, ["qb", "cb"]):
        sizes = g.column("dim").to_numpy()
        for dim in np.unique(sizes):
            own = g.filter(pa.array(sizes == dim))
            asked = own.column("asked").to_numpy(zero_copy_only=False).astype(bool)
            if asked.all() or not asked.any():
                continue
            rows = own.filter(pa.array(asked))
            found = own.filter(pa.array(~asked))
            found = found.take(pc.sort_indices(found, sort_keys=[("id", "ascending"), ("rid", "ascending")], null_placement="at_end"))
            a, c = _Block(rows, scale), _Block(found, scale)
            _, code = np.unique(np.concatenate([a.label.to_numpy(zero_copy_only=False), c.label.to_numpy(zero_copy_only=False)]), return_inverse=True)
            yield rows, a, c, code[:len(a.rid)], code[len(a.rid):]


def _positives(scale: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, c, code, label in _meetings(batches, scale):
            order = np.argsort(label, kind="stable")
            bound = np.searchsorted(label[order], np.arange(label.max() + 2))
            rid: list[int] = []
            row: list[int] = []
            value: list[int] = []
            for k in np.unique(code[code <= label.max()]):
                same, asking = order[bound[k]:bound[k + 1]], np.flatnonzero(code == k)
                if not len(same):
                    continue
                packed = Packed(c.vector[same], a.vector[asking])
                for t in range(0, len(asking), TILE_ANCHORS):
                    some = asking[t:t + TILE_ANCHORS]
                    for x, score in zip(some.tolist(), packed.scores(a.vector[some])):
                        best = _best(score, np.flatnonzero(c.rid[same] != a.rid[x]), most)
                        rid += [int(a.rid[x])] * len(best)
                        row += same[best].tolist()
                        value += score[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), c.id.take(pa.array(row, pa.int64())), pa.array(value, pa.int64())],
                                             names=["rid", "positive_id", "positive_score"])
    return run


def _negatives(scale: int, most: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, a, c, code, label in _meetings(batches, scale):
            bands = [[(-(-low * p // 100), high * p // 100) for p in x] for x in rows.column("scores").to_pylist()]
            packed = Packed(c.vector, a.vector)
            for t in range(0, len(code), TILE_ANCHORS):
                rid: list[int] = []
                place: list[int] = []
                row: list[int] = []
                value: list[int] = []
                for x, score in enumerate(packed.scores(a.vector[t:t + TILE_ANCHORS]), t):
                    least, top = min(b[0] for b in bands[x]), max(b[1] for b in bands[x])
                    near = np.flatnonzero((score >= least) & (score <= top) & (label != code[x]))
                    for p, (lo, hi) in enumerate(bands[x]):
                        best = _best(score, near[(score[near] >= lo) & (score[near] <= hi)], most)
                        rid += [int(a.rid[x])] * len(best)
                        place += [p] * len(best)
                        row += best.tolist()
                        value += score[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(place, pa.int32()), c.id.take(pa.array(row, pa.int64())), pa.array(value, pa.int64())],
                                                 names=["rid", "place", "negative_id", "negative_score"])
    return run


def _meet(candidates: DataFrame, anchors: DataFrame, parts: int, asking: int) -> DataFrame:
    """Every candidate block beside every anchor block: each row travels once for each block of the other side."""
    empty = F.array().cast("array<long>")
    scores = F.col("scores") if "scores" in anchors.columns else empty
    a = anchors.select(F.pmod(F.xxhash64("rid"), F.lit(asking)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cb"),
                       F.lit(True).alias("asked"), "rid", "id", "label", "v", "dim", scores.alias("scores"))
    c = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("qb"), F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int").alias("cb"),
                          F.lit(False).alias("asked"), "rid", "id", "label", "v", "dim", empty.alias("scores"))
    return by_group(c.unionByName(a), ["qb", "cb"])


def mine(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows for which ``anchor`` holds. A score is the integer
    inner product of ``floor(scale * x)`` of both vectors. An anchor's
    positives are its ``positives`` best other rows of equal label; for each,
    up to ``negatives`` best rows of another label are returned whose score is
    between ``low`` and ``high`` percent of the positive's. Equal scores go by
    ascending id, a null id last.

    A row with a null label, a null vector, or a null or non-finite component
    takes no part; vectors of unequal length are not compared, and an empty
    one scores 0. Repeated rows are rows of their own, as candidates and as
    anchors. Scores are exact; one beyond 64 bits counts as the nearest
    64-bit integer. Columns of other names are left out; without anchors the
    result is empty.
    """
    name = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).alias("id"), name.cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"),
                          F.coalesce(anchor, F.lit(False)).alias("asks"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(~odd)
    rows = materialise(rows.withColumn("dim", F.size("v")).withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    # two sums decide how many blocks there are
    size = rows.agg(F.sum(F.lit(8) * F.col("dim")).alias("bytes"), F.sum(F.col("asks").cast("long")).alias("asks")).first()
    parts, asking = max(1, -(-(size["bytes"] or 0) // BLOCK_BYTES)), max(1, -(-(size["asks"] or 0) // ANCHOR_BLOCK))
    kind = rows.schema["id"].dataType.simpleString()
    anchors = rows.where("asks")
    near = _meet(rows, anchors, parts, asking).mapInArrow(_positives(scale, positives), f"rid long, positive_id {kind}, positive_score long")
    best = Window.partitionBy("rid").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    near = near.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives)
    # at most `positives` scores an anchor, in order
    near = near.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("near"))
    near = materialise(near, "negatives-positives")
    asked = materialise(anchors.join(near, "rid").withColumn("scores", F.transform("near", lambda x: x["positive_score"])), "negatives-anchors")
    far = _meet(rows, asked, parts, asking).mapInArrow(_negatives(scale, negatives, low, high), f"rid long, place int, negative_id {kind}, negative_score long")
    best = Window.partitionBy("rid", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = asked.select("rid", F.col("id").alias("anchor_id"), "near")
    own = F.get("near", F.col("place"))
    return far.join(named, "rid").select("anchor_id", own["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
                                         own["positive_score"].alias("positive_score"), "negative_score")
