"""Quality scores from random Fourier features of document statistics.

A document's text is reduced to a few dozen statistics of its letters, words
and lines. Random Fourier features of the standardised statistics approximate
a Gaussian kernel; a ridge regression on them is solved from normal equations
that every partition sums over its own rows. The sums are kept by fold, so a
labelled row can be scored by a fit that has not seen it; from those scores an
isotonic curve turns a document's value into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import IS_WORD, LOWER, Words, slices
from .common import materialise, text_or_empty

#: Random features, and the kernel's width in standard deviations of a statistic times the root of their number.
FEATURES, WIDTH = 256, 2.0
RIDGE, FOLDS = 1e-4, 5
#: Cells of ridge values from which the isotonic curve is made.
CELLS, LOWEST, HIGHEST = 2000, -1.0, 2.0
#: Groups in which the partitions' sums of a fold are added, before these are added to one.
SLOTS = 16
PREDICT = 0.3

#: Classes of bytes. A mark is neither white space nor of a word.
UPPER, LOWERED, DIGIT, HIGH = slice(65, 91), slice(97, 123), slice(48, 58), slice(128, 256)
SPACES, STOPS = np.array([9, 10, 13, 32]), np.array([33, 46, 63])
IS_SPACE = np.isin(np.arange(256), SPACES)
IS_MARK = ~(IS_WORD[LOWER] | IS_SPACE)
IS_STOP = np.isin(np.arange(256), STOPS)
IS_UPPER = np.isin(np.arange(256), np.arange(65, 91)).astype(np.int32)
IS_DIGIT = np.isin(np.arange(256), np.arange(48, 58)).astype(np.int32)
NAMES = ("bytes", "words", "lines", "upper", "digit", "space", "high", "mark", "word_length", "word_spread", "word_kinds", "word_top", "word_once",
         "long_words", "short_words", "marked_words", "mark_runs", "capital_words", "full_capital_words", "line_length", "line_kinds", "line_stops",
         "pair_kinds", "entropy", "mark_entropy", "sentence", "digit_words", "space_runs")


def _up_to(flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    return total


def _kinds(row: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's codes: how many differ, how often the commonest comes, how many come once."""
    # the row above the upper bits of the code: one sort of plain numbers
    bits = np.uint64(max(1, int(rows).bit_length()))
    key = np.sort(row.astype(np.uint64) << (np.uint64(64) - bits) | code >> bits)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(key)))
    owner = (key[at] >> (np.uint64(64) - bits)).astype(np.int64)
    most = np.zeros(rows)
    if len(at):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        most[owner[first]] = np.maximum.reduceat(size, first)
    return np.bincount(owner, minlength=rows), most, np.bincount(owner[size == 1], minlength=rows)


def _entropy(count: np.ndarray) -> np.ndarray:
    """Bits a symbol, of each row of counts."""
    total = np.maximum(count.sum(axis=1), 1)
    return np.log2(total) - (count * np.log2(np.maximum(count, 1))).sum(axis=1) / total


def statistics(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``NAMES`` of each text, from whole texts; an empty text has zeros."""
    rows, n = len(offsets) - 1, len(body)
    size = np.diff(offsets).astype(np.float64)
    words = Words(body, offsets)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    word, count = words.end - words.start, np.bincount(words.row, minlength=rows).astype(np.float64)
    share = lambda x, of: x / np.maximum(of, 1)
    per_word = lambda x: np.bincount(words.row, x, rows)

    held = np.bincount(row * 256 + body, minlength=rows * 256).reshape(rows, 256).astype(np.float64)
    of = lambda which: held[:, which].sum(axis=1)
    folded = held.copy()
    folded[:, LOWERED] += folded[:, UPPER]
    folded[:, UPPER] = 0
    marks = held[:, IS_MARK]

    capital = IS_UPPER[body[words.start]] > 0
    upper, digit = _up_to(IS_UPPER[body]), _up_to(IS_DIGIT[body])
    all_capital = (upper[words.end] - upper[words.start] == word) & (word > 1)
    digits = digit[words.end] > digit[words.start]
    mark, space, stop = IS_MARK[body], IS_SPACE[body], IS_STOP[body]
    marked = np.append(mark, False)[words.end] & (words.end < offsets[1:][words.row])
    kinds, most, once = _kinds(words.row, words.code, rows)
    at, pairs = words.grams(2)
    pair_kinds, _, _ = _kinds(words.row[at], pairs, rows)
    pair_count = np.bincount(words.row[at], minlength=rows)
    # one mark, or one space, after another
    joined = np.ones(n, bool)
    joined[offsets[:-1][size > 0]] = False
    twice = lambda flags: np.bincount(row[1:][flags[1:] & flags[:-1] & joined[1:]], minlength=rows)

    # lines: runs between line feeds, told apart by their words and the words' places
    edges = np.unique(np.concatenate([offsets[:-1][size > 0], np.flatnonzero(body == 10) + 1]))
    edges = edges[edges < n]
    line_row = row[edges]
    lines = np.bincount(line_row, minlength=rows).astype(np.float64)
    in_line = np.searchsorted(edges, words.start, "right") - 1
    line_code = np.zeros(len(edges), np.uint64)
    if len(word):
        first = np.flatnonzero(np.diff(in_line, prepend=-1))
        line_code[in_line[first]] = np.add.reduceat(words.code * (words.start - edges[in_line] + 1).astype(np.uint64), first)
    line_kinds, _, _ = _kinds(line_row, line_code, rows)
    last = np.append(edges[1:], n)[:len(edges)] - 1
    last = np.where(body[last] == 10, np.maximum(last - 1, 0), last)
    line_stops = np.bincount(line_row, stop[last], rows)

    mean = share(per_word(word), count)
    spread = np.sqrt(np.maximum(share(per_word(word.astype(np.float64)**2), count) - mean**2, 0))
    return np.stack([
        np.log1p(size), np.log1p(count), np.log1p(lines), share(of(UPPER), of(UPPER) + of(LOWERED)), share(of(DIGIT), size), share(of(SPACES), size),
        share(of(HIGH), size), share(marks.sum(axis=1), size), mean, spread, share(kinds, np.sqrt(count)), share(most, count), share(once, count),
        share(per_word(word > 12), count), share(per_word(word < 4), count), share(per_word(marked), count), share(twice(mark), count),
        share(per_word(capital), count), share(per_word(all_capital), count), np.log1p(share(size, lines)), share(line_kinds, lines), share(line_stops, lines),
        share(pair_kinds, pair_count), _entropy(folded), _entropy(marks), np.log1p(share(count, of(STOPS) + 1)), share(per_word(digits), count),
        share(twice(space), size),
    ], axis=1)


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    #: Points of the isotonic curve: ridge values and probabilities, both ascending.
    value: np.ndarray
    chance: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(fourier(stats, self.centre, self.spread) @ self.weights, self.value, self.chance)


def frequencies() -> tuple[np.ndarray, np.ndarray]:
    """The fixed random directions and phases."""
    rng = np.random.default_rng(20240613)
    return rng.normal(size=(len(NAMES), FEATURES)) / (WIDTH * np.sqrt(len(NAMES))), rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(stats: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random features of standardised statistics, and a constant. A statistic is held within 4 deviations."""
    direction, phase = frequencies()
    z = np.clip((stats - centre) / spread, -4, 4)
    return np.concatenate([np.cos(z @ direction + phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))], axis=1)


def isotonic(value: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing means closest to the cells' own (pool adjacent violators), at their mean values."""
    out: list[list[float]] = []
    for v, t, c in zip(value.tolist(), total.tolist(), count.tolist()):
        out.append([v * c, t, c])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            top = out.pop()
            out[-1] = [x + y for x, y in zip(out[-1], top)]
    v, t, c = np.array(out).T
    return v / c, t / c


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, body, offsets in slices(batch.column("text")):
            stats = statistics(body, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, len(NAMES), dtype=np.int32)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, end - first), lists], names=["key", "stats"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(NAMES))


def _normal(centre: np.ndarray, spread: np.ndarray):
    """One row a task and fold: the sums of products of the features and label, in one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
        for batch in batches:
            x = np.concatenate([fourier(_matrix(batch), centre, spread), batch.column("y").to_numpy()[:, None]], axis=1)
            fold = batch.column("fold").to_numpy()
            for k in range(FOLDS):
                own = x[fold == k]
                total[k] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["fold", "sums"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all matrices of each fold that meet in a task."""
    total: dict[int, np.ndarray] = {}
    slot = 0
    for batch in batches:
        for k, slot, x in zip(batch.column("fold").to_pylist(), batch.column("slot").to_pylist(), batch.column("sums")):
            total[k] = total.get(k, 0.0) + np.frombuffer(x.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([slot] * len(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                                     names=["fold", "slot", "sums"])


def _solve(sums: np.ndarray) -> np.ndarray:
    rows = max(sums[-2, -2], 1.0)  # the constant's own product
    left = sums[:-1, :-1] + np.diag([RIDGE * rows / FEATURES] * FEATURES + [1e-9])
    return np.linalg.solve(left, sums[:-1, -1])


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, stats)`` of each row, written once: the only pass over the texts."""
    texts = docs.select(F.col(doc_id).alias("key"), text_or_empty(text).alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    return materialise(texts.mapInArrow(_measured, f"key {kind}, stats array<double>"), "quality-statistics")


def fit(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on every row of :func:`measure` that has a label (1 or not); several labels of an id count as their largest.

    All labelled rows take part, each copy of a repeated id too; only
    statistics, a few hundred bytes a row, meet the labels, and each task
    returns sums of a fixed size. Without both classes the score is a
    constant: the class seen, or 0.5.
    """
    own = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("key")).agg(
        F.max((F.col(label) == 1).cast("double")).alias("y"))
    data = measured.join(own, "key")
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("key").cast("string")), F.lit(FOLDS)).cast("int").alias("fold")
    data = materialise(data.select("stats", "y", fold), "quality-labelled")
    each = [x for k in range(len(NAMES)) for x in (F.avg(F.get("stats", F.lit(k))), F.stddev_pop(F.get("stats", F.lit(k))))]
    seen = data.agg(F.count(F.lit(1)), F.sum("y"), *each).first()
    n, ones = seen[0], seen[1] or 0.0
    if ones in (0, n):
        chance = 0.5 if not n else float(ones > 0)
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(FEATURES + 1), np.array([0.0]), np.array([chance]))
    moments = np.array(seen[2:], np.float64)
    centre, spread = moments[::2], np.where(moments[1::2] > 1e-9, moments[1::2], 1.0)
    # a partition's sums have a fixed size; they are added in two steps, and one matrix a fold reaches the driver
    parts = data.mapInArrow(_normal(centre, spread), "fold int, sums binary").withColumn("slot", F.spark_partition_id() % SLOTS)
    for keys in (["fold", "slot"], ["fold"]):
        parts = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added, "fold int, slot int, sums binary")
    sums = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
    for r in parts.collect():
        sums[r["fold"]] = np.frombuffer(r["sums"]).reshape(FEATURES + 2, -1)
    weights = _solve(sums.sum(axis=0))
    left_out = np.stack([_solve(sums.sum(axis=0) - sums[k]) for k in range(FOLDS)])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = (fourier(_matrix(batch), centre, spread) * left_out[batch.column("fold").to_numpy()]).sum(axis=1)
            cell = np.clip((value - LOWEST) / (HIGHEST - LOWEST) * CELLS, 0, CELLS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y")], names=["cell", "y"])

    cells = data.mapInArrow(unseen, "cell int, y double").groupBy("cell").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    cell, total, count = np.array([tuple(r) for r in cells], np.float64).T
    value, chance = isotonic(LOWEST + (cell + 0.5) * (HIGHEST - LOWEST) / CELLS, total, count)
    return Model(centre, spread, weights, value, chance)


def score(measured: DataFrame, model: Model) -> DataFrame:
    """``(key, score)`` of each row of :func:`measure`: the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.clip(model.scores(_matrix(batch)), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found)], names=["key", "score"])

    kind = measured.schema["key"].dataType.simpleString()
    return measured.mapInArrow(run, f"key {kind}, score double")


def held_out(doc_id: str, parts: int = 5):
    """Is the crc32 of the id as text divisible by ``parts``? A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 0, F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = PREDICT) -> DataFrame:
    """``(id, held_out, score, predicted)`` of each row; labels of held-out rows are not read.

    A score depends on the text alone, so repeated rows score alike; a null or
    empty text has the statistics 0 and a score like any other. Very long
    texts are measured whole, one at a time. Columns of other names are left
    out; an empty table gives an empty result.
    """
    measured = measure(docs, doc_id, text)
    scored = score(measured, fit(measured, labels.where(~held_out(doc_id)), doc_id, label))
    scored = scored.select(F.col("key").alias("id"), F.round("score", 9).alias("score"))
    return scored.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
