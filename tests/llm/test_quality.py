"""Quality scores: statistics, sums and calibration against plain numpy; held-out rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from llmdata import SCHEMA, documents, frame, prose, words

from ephysframe.llm import quality_features as quality
from ephysframe.llm import queries
from ephysframe.llm.bytetext import slices

SF = "/root/testdata/sf0.01"
AT = {n: k for k, n in enumerate(quality.NAMES)}


def measured(texts):
    return np.concatenate([quality.statistics(b, o) for _, _, b, o in slices(pa.array(texts, pa.string()))])


def test_statistics_by_definition():
    texts = [r[1] for r in documents(2)] + ["A b", "THE!! END!!", "one\ntwo\none\n", "\n\n", "1a 22 b\t\tc", "é É", "...", "x" * 300, "a.\nb.\nc"]
    got = measured(texts)
    assert got.shape == (len(texts), len(quality.NAMES)) and np.isfinite(got).all()
    assert np.allclose(got, np.concatenate([measured([t]) for t in texts]))  # a text's neighbours do not matter
    assert not got[[not t for t in texts]].any()
    for t, row in zip(texts, got):
        t = t or ""
        data, w = t.encode(), words(t)
        n, lines = len(data), t.split("\n")[:-1] if t.endswith("\n") else t.split("\n") if t else []
        assert np.isclose(row[AT["bytes"]], np.log1p(n)) and np.isclose(row[AT["words"]], np.log1p(len(w))) and np.isclose(row[AT["lines"]], np.log1p(len(lines)))
        letters = [c for c in t if c.isascii() and c.isalpha()]
        assert np.isclose(row[AT["upper"]], sum(c.isupper() for c in letters) / max(1, len(letters)))
        assert np.isclose(row[AT["digit"]], sum(c in "0123456789" for c in t) / max(1, n))
        assert np.isclose(row[AT["high"]], sum(b >= 128 for b in data) / max(1, n))
        counts = Counter(w)
        assert np.isclose(row[AT["word_top"]], max(counts.values(), default=0) / max(1, len(w)))
        assert np.isclose(row[AT["word_once"]], sum(v == 1 for v in counts.values()) / max(1, len(w)))
        assert np.isclose(row[AT["word_kinds"]], len(counts) / max(1, np.sqrt(len(w))))
        assert np.isclose(row[AT["word_length"]], sum(len(x.encode()) for x in w) / max(1, len(w)))
        pairs = list(zip(w, w[1:]))
        assert np.isclose(row[AT["pair_kinds"]], len(set(pairs)) / max(1, len(pairs)))
        p = np.array(list(Counter(data.lower()).values()), float) / max(1, n)
        assert np.isclose(row[AT["entropy"]], -(p * np.log2(p)).sum())
    row = dict(zip(quality.NAMES, measured(["THE!! END!!"])[0]))
    assert row["full_capital_words"] == row["capital_words"] == row["marked_words"] == 1 and row["mark_runs"] == 1
    assert np.isclose(measured(["one\ntwo\none\n"])[0, AT["line_kinds"]], 2 / 3) and measured(["a.\nb.\nc"])[0, AT["line_stops"]] == 2 / 3


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 12))
        count = rng.integers(1, 5, n).astype(float)
        total = np.array([rng.integers(0, c + 1) for c in count], float)
        value, chance = quality.isotonic(np.arange(n, dtype=float), total, count)
        assert (np.diff(value) > 0).all() and (np.diff(chance) > 0).all()
        # minimax formula of isotonic regression
        means = [max(min(total[a:b + 1].sum() / count[a:b + 1].sum() for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        assert np.allclose(np.unique(np.round(means, 9)), np.round(chance, 9))


def table(n=700, seed=0):
    """Prose, and prose in which every word has marks after it or all letters are capitals."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, good = prose(rng, rng.randint(3, 90)), rng.random() < 0.8
        if not good:
            text = " ".join(w + rng.choice(["$$$", "%%%"]) for w in text.split()) if rng.random() < 0.5 else text.upper().replace(" ", "!! ")
        docs.append((i, text, "en", "s", 1, "th", "key", 1, "shard", "parts"))
        labels.append((i, int(good), 0))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_fit_equals_dense_numpy(spark):
    docs, labels = table()
    rows = quality.measure(frame(spark, docs))
    model = quality.fit(rows, spark.createDataFrame(labels, LABELS).repartition(3))
    stats, y = measured([d[1] for d in docs]), np.array([x[1] for x in labels], float)
    spread = stats.std(axis=0)
    assert np.allclose(model.centre, stats.mean(axis=0)) and np.allclose(model.spread, np.where(spread > 1e-9, spread, 1))
    x = quality.fourier(stats, model.centre, model.spread)
    penalty = np.diag([quality.RIDGE * len(y) / quality.FEATURES] * quality.FEATURES + [1e-9])
    assert np.allclose(model.weights, np.linalg.solve(x.T @ x + penalty, x.T @ y), atol=1e-6)
    assert (np.diff(model.chance) > 0).all() and 0 <= model.chance[0] and model.chance[-1] <= 1
    got = {r.key: r.score for r in quality.score(rows, model).collect()}
    assert np.allclose([got[i] for i in range(len(docs))], np.clip(model.scores(stats), 0, 1), atol=1e-9)


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, len(quality.NAMES))) * 0.7
    p = quality.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2 * len(quality.NAMES))
    assert np.abs(p @ p.T - np.exp(-far)).mean() < 0.07


def test_scores_of_held_out_and_odd_rows(spark):
    docs, labels = table()
    tail = ["th", "key", 7, "shard", "parts"]
    docs += [(5000, None, None, None, None, *tail), (5001, "", None, None, None, *tail), (None, "a b c", None, None, None, *tail), docs[0], docs[0],
             (5002, prose(random.Random(1), 30_000), "en", "s", 1, *tail)]
    odd = [*labels, (None, 1, 0), (9999, 0, 0), (5001, None, 0), labels[0]]
    wrong = [(i, 1 - y, t) if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else (i, y, t) for i, y, t in odd]
    got = quality.judge(frame(spark, docs), spark.createDataFrame(odd, LABELS)).collect()
    assert len(got) == len(docs)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.id in truth]
    assert len(held) > 100 and {r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got if r.id is not None} == {True}
    assert sum(r.predicted == truth[r.id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert [r.held_out for r in got if r.id is None] == [True]
    # labels of held-out rows are never read
    again = quality.judge(frame(spark, docs), spark.createDataFrame(wrong, LABELS)).collect()
    assert {(r.id, round(r.score, 6)) for r in again} == {(r.id, round(r.score, 6)) for r in got}


def test_without_labels_or_rows(spark):
    docs = frame(spark, documents())
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.judge(docs, none).collect()} == {0.5}
    for y in (0, 1):
        one = spark.createDataFrame([(i, y, 0) for i in range(30)], LABELS)
        assert {(r.score, r.predicted) for r in quality.judge(docs, one).collect()} == {(float(y), y)}
    assert quality.judge(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_fourier_quality"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.95 * len(held)
