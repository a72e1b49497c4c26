"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on hashed words
and word beginnings; each later model also reads the probabilities of the
categories before it. For training those probabilities are out of fold: a
document's come from models that have not seen it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .bytetext import P, Words, _power, mixed, slices
from .common import materialise, text_or_empty

#: Hashed features, and bytes of the word beginnings.
FEATURES, BEGINNINGS = 1 << 18, (4, 6)
#: Labelled rows that are fitted at most, by hash order of their ids.
SAMPLE = 12_000
FOLDS = 3
#: Penalties of a weight's magnitude and of its square (intercepts have none), rounds of a fit, and the relative gain at which it ends earlier.
LASSO, RIDGE, ROUNDS, ENOUGH = 5e-5, 2e-6, 60, 1e-7
#: Steps that the fit remembers to guess curvature.
MEMORY = 8


@dataclass(frozen=True)
class Category:
    """A category, in the order of the chain: its name, label column and the value that counts as positive."""

    name: str
    column: str
    positive: int


#: The label columns at hand. Pages of no use are told apart first, as they are never labelled toxic.
CATEGORIES = (Category("low_quality", "quality", 0), Category("toxic", "toxic", 1))


@dataclass
class Model:
    categories: tuple[Category, ...]
    #: For each category, weights of the features, of the earlier categories, and the intercept.
    weights: list[np.ndarray] = field(default_factory=list)
    earlier: list[np.ndarray] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)


def feature_sets(words: Words) -> Iterator[np.ndarray]:
    """The sorted distinct features of each row: its words, those that it holds twice, and beginnings of words."""
    power, inverse = _power(len(words.lower) + 1)
    total = np.zeros(len(words.lower) + 1, np.uint64)
    np.cumsum((words.lower.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    codes = [words.code]
    for k in BEGINNINGS:
        end = np.minimum(words.start + k, words.end)
        codes.append(mixed((total[end] - total[words.start]) * inverse[words.start] + np.uint64(k)))
    hashed = (np.stack(codes, axis=1) % np.uint64(FEATURES)).astype(np.int32)
    again = (mixed(words.code + P) % np.uint64(FEATURES)).astype(np.int32)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        _, at, n = np.unique(hashed[a:b, 0], return_index=True, return_counts=True)
        yield np.unique(np.concatenate([hashed[a:b].ravel(), again[a + at[n > 1]]]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, body, offsets in slices(batch.column("text")):
            sets = [x.tobytes() for x in feature_sets(Words(body, offsets))]
            own = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([own.column("key"), own.column("th"), pa.array(sets, pa.binary())], names=["key", "th", "x"])


class Rows:
    """Sparse rows: the features of each (weight 1) and a few dense columns."""

    def __init__(self, sets: list[np.ndarray], dense: np.ndarray):
        place = np.concatenate([*sets, np.zeros(0, np.int32)]).astype(np.int32)
        # features renumbered: few of all the buckets are filled
        held = np.zeros(FEATURES, bool)
        held[place] = True
        self.used = np.flatnonzero(held).astype(np.int32)
        number = np.zeros(FEATURES, np.int32)
        number[self.used] = np.arange(len(self.used))
        self.at = number[place]
        self.row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        self.dense, self.n = dense, len(sets)
        self.size = len(self.used) + dense.shape[1] + 1

    def times(self, w: np.ndarray) -> np.ndarray:
        k = len(self.used)
        return np.bincount(self.row, w[self.at], self.n) + self.dense @ w[k:-1] + w[-1]

    def summed(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.at, r[self.row], len(self.used)), self.dense.T @ r, [r.sum()]])


def logistic(rows: Rows, y: np.ndarray, rounds: int = ROUNDS, enough: float = ENOUGH) -> np.ndarray:
    """Weights (features, dense columns, intercept) of the least mean log loss plus penalties.

    Quasi-Newton steps that stay within one orthant, as the lasso penalty has
    a corner at 0: the guess of curvature comes from the last steps, a step is
    halved until the objective falls.
    """
    lasso = np.full(rows.size, LASSO)
    lasso[-1] = 0.0
    ridge = np.where(lasso > 0, RIDGE, 0.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.times(w)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        value = (np.logaddexp(0, z) - y * z).mean() + (ridge * w * w).sum() / 2
        return value, rows.summed(p - y) / rows.n + ridge * w

    w = np.zeros(rows.size)
    value, slope = loss(w)
    total = value
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        corner = np.sign(slope) * np.maximum(np.abs(slope) - lasso, 0)
        steep = np.where(w != 0, slope + np.sign(w) * lasso, corner)
        move = -steep
        back = []
        for s, d, product in reversed(steps):
            back.append((s @ move) / product)
            move = move - back[-1] * d
        if steps:
            s, d, product = steps[-1]
            move = move * (product / (d @ d))
        for (s, d, product), share in zip(steps, reversed(back)):
            move = move + s * (share - (d @ move) / product)
        move[move * steep >= 0] = 0
        side = np.where(w != 0, np.sign(w), -np.sign(steep))
        length = 1.0 if steps else 1 / max(1e-12, float(np.sqrt(steep @ steep)))
        for _ in range(40):
            new = w + length * move
            new[(new * side < 0) & (lasso > 0)] = 0
            value, after = loss(new)
            now = value + lasso @ np.abs(new)
            if now <= total + 1e-4 * (steep @ (new - w)):
                break
            length /= 2
        else:
            break
        s, d = new - w, after - slope
        gain, total, w, slope = total - now, now, new, after
        if s @ d > 1e-16:
            steps = [*steps, (s, d, float(s @ d))][-MEMORY:]
        if gain <= enough * max(abs(total), 1e-12):
            break
    return w


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[Rows, np.ndarray]:
    """The rows of a fit in the order of their ids' hashes: the order of arrival may differ between runs."""
    table = pa.Table.from_batches(list(batches))
    sets = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("x")]
    before = np.array(table.column("before").to_pylist(), np.float64).reshape(len(sets), -1)
    y = table.column("y").to_numpy()
    order = np.argsort(table.column("place").to_numpy(), kind="stable").tolist()
    return Rows([sets[i] for i in order], before[order]), y[order]


def _fitted(number: int, rounds: int, enough: float):
    """One row: a fit's number, the buckets with weights, these, those of earlier categories, and the intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        place, weight, earlier, intercept = np.zeros(0, np.int32), np.zeros(0), np.zeros(0), 0.0
        if batches:
            rows, y = _read(batches)
            batches.clear()
            if len(np.unique(y)) < 2:
                earlier, intercept = np.zeros(rows.dense.shape[1]), 30.0 if y[0] == 1 else -30.0
            else:
                w = logistic(rows, y, rounds, enough)
                k = len(rows.used)
                kept = np.flatnonzero(w[:k])
                place, weight, earlier, intercept = rows.used[kept], w[:k][kept], w[k:-1], float(w[-1])
        else:
            intercept = -30.0
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([place.astype(np.int32).tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary()),
                                          pa.array([earlier.tobytes()], pa.binary()), pa.array([intercept], pa.float64())],
                                         names=["fit", "place", "weight", "earlier", "intercept"])
    return run


def _linear(row, dense: int) -> tuple[np.ndarray, np.ndarray, float]:
    full = np.zeros(FEATURES, np.float32)
    full[np.frombuffer(row["place"], np.int32)] = np.frombuffer(row["weight"])
    earlier = np.frombuffer(row["earlier"])
    return full, earlier if len(earlier) else np.zeros(dense), row["intercept"]


def chance(x: np.ndarray, before: list[float], weights: np.ndarray, earlier: np.ndarray, intercept: float) -> float:
    z = float(weights[x].sum(dtype=np.float64)) + float(earlier @ np.array(before, np.float64)) + intercept
    return 1.0 / (1.0 + float(np.exp(-np.clip(z, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...] = CATEGORIES, doc_id: str = "doc_id", text: str = "text",
        sample: int = SAMPLE, rounds: int = ROUNDS, enough: float = ENOUGH) -> Model:
    """Fit the chain on at most ``sample`` labelled documents.

    Several labels of an id count as their largest; a null label leaves the
    document out of that category's fit. Of several documents of one id that
    with the smallest text hash is fitted, so the sample has ``sample`` rows at
    most, however often ids repeat. Where a category has no two classes its
    model is a constant. Each fit is one task that reads the sample, all its
    features weighed; the fits of a category run side by side, and only
    weights that are not 0 reach the driver.
    """
    own = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("key")).agg(
        *[F.max((F.col(c.column) == c.positive).cast("double")).alias(f"y{k}") for k, c in enumerate(categories)])
    own = materialise(own.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(sample), "toxicity-labels")
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("key"), text_or_empty(text).alias("text"))
    texts = texts.join(F.broadcast(own.select("key")), "key", "left_semi").withColumn("th", F.xxhash64("text"))  # `sample` ids
    sets = texts.mapInArrow(_features, f"key {kind}, th long, x binary").groupBy("key").agg(F.min(F.struct("th", "x")).alias("first"))
    hashed = F.xxhash64(F.lit("fold"), F.col("key").cast("string"))
    data = sets.join(F.broadcast(own), "key").select("*", hashed.alias("place"), F.pmod(hashed, F.lit(FOLDS)).cast("int").alias("fold"), F.col("first.x").alias("x"))
    data = materialise(data.drop("first").withColumn("before", F.array().cast("array<double>")), "toxicity-sample")
    model = Model(categories)
    for k in range(len(categories)):
        known = data.where(F.col(f"y{k}").isNotNull()).select("x", "before", "place", "fold", F.col(f"y{k}").alias("y"))
        numbers = range(FOLDS + 1 if k + 1 < len(categories) else 1)  # 0 is the whole sample, f + 1 all but fold f
        found = None
        for number in numbers:
            part = known if number == 0 else known.where(F.col("fold") != number - 1)
            one = part.coalesce(1).mapInArrow(_fitted(number, rounds, enough), "fit int, place binary, weight binary, earlier binary, intercept double")
            found = one if found is None else found.union(one)
        fits = {r["fit"]: _linear(r, k) for r in found.collect()}
        weights, earlier, intercept = fits[0]
        model.weights.append(weights)
        model.earlier.append(earlier)
        model.intercepts.append(intercept)
        if len(fits) > 1:
            shared = docs.sparkSession.sparkContext.broadcast(fits)  # FEATURES numbers a fold

            def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    each = zip(batch.column("x"), batch.column("before").to_pylist(), batch.column("fold").to_pylist())
                    longer = [[*before, chance(np.frombuffer(x.as_buffer(), np.int32), before, *shared.value[fold + 1])] for x, before, fold in each]
                    at = batch.schema.get_field_index("before")
                    yield batch.set_column(at, "before", pa.array(longer, pa.list_(pa.float64())))

            data = materialise(data.mapInArrow(chained, data.schema), "toxicity-chain")
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``chain``: each row's probabilities of the categories, in order. An empty text has no features.

    One pass without a join; a column named ``chain`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.earlier, model.intercepts))  # FEATURES numbers a category
    rows = docs.drop("chain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, earlier, intercepts = shared.value
        for batch in batches:
            body = batch.column(batch.num_columns - 1)
            for first, end, chars, offsets in slices(body):
                out = []
                for x in feature_sets(Words(chars, offsets)):
                    p: list[float] = []
                    for linear in zip(weights, earlier, intercepts):
                        p.append(chance(x, p, *linear))
                    out.append(p)
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*own.schema.names[:-1], "chain"])

    schema = StructType([*rows.schema.fields, StructField("chain", ArrayType(DoubleType()))])
    return rows.withColumn("__body", text_or_empty(text)).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...] = CATEGORIES, doc_id: str = "doc_id", text: str = "text",
          threshold: float = 0.5, sample: int = SAMPLE, rounds: int = ROUNDS, enough: float = ENOUGH) -> DataFrame:
    """``(id, th, p_<category>..., rejected)`` of each row; the last category decides.

    A row's probabilities depend on its text alone, so repeated rows agree; a
    null, empty or wordless text has no features and the intercepts' chances.
    Texts are read whole. Columns of other names are left out; an empty table
    gives an empty result.
    """
    own = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text")).withColumn("th", F.xxhash64("text"))
    scored = score(own, fit(docs, labels, categories, doc_id, text, sample, rounds, enough)).drop("text")
    named = [F.get("chain", F.lit(k)).alias(f"p_{c.name}") for k, c in enumerate(categories)]
    return scored.select("id", "th", *named, (F.get("chain", F.lit(len(categories) - 1)) >= threshold).alias("rejected"))


def clean(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...] = CATEGORIES, doc_id: str = "doc_id", text: str = "text",
          threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` that are not rejected, with their columns (``chain`` is not among them)."""
    scored = score(docs, fit(docs, labels, categories, doc_id, text, sample), text)
    return scored.where(F.get("chain", F.lit(len(categories) - 1)) < threshold).drop("chain")
