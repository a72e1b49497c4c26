"""Fill-in-middle and hard negatives against brute force, on odd rows and in small blocks."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from llmdata import SCHEMA, documents, frame
from pyspark.sql import functions as F

from ephysframe.llm import fill_middle, hard_negatives, queries
from ephysframe.llm.fill_middle import Units

SF = "/root/testdata/sf0.001"


# --- fill in the middle -------------------------------------------------------

def filled(doc_id, text, seed=1, rate=90, spm=20, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not n or any(m in text for m in marks) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    mp, ms, mm = marks
    if h4 % 100 < spm:
        return doc_id, n, "spm", a, b - a, ms + s + mp + p + mm + m
    return doc_id, n, "psm", a, b - a, mp + p + ms + s + mm + m


def middle_rows():
    rows = documents(3)
    tail = ["th", "key", 7, "shard", "parts"]
    odd = ["<P>", "a <S> b", "<M>x", "<P", "<", "S><", "<<S", ">M>", "é", "日本語", "😀", "á", "\u0000x", "é" * 9, "x" * 7 + "é", "￿" * 5, "<S" * 30]
    return rows + [(1000 + i, t, "en", "s", 1, *tail) for i, t in enumerate(odd * 6)]


def test_units_are_found_by_rank():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("aé日😀 \x00z") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 9))]
        data = [x.encode() for x in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        units = Units(np.frombuffer(b"".join(data), np.uint8), offsets)
        base = units.count(offsets[:-1])
        assert (units.count(offsets[1:]) - base).tolist() == [len(x) for x in texts]
        for i, x in enumerate(texts):
            ends = np.maximum(units.after(base[i] + np.arange(len(x) + 1)), offsets[i]) - offsets[i]
            assert ends.tolist() == [len(x[:k].encode()) for k in range(len(x) + 1)]


@pytest.mark.parametrize("rate,spm,marks", [(90, 20, ("<P>", "<S>", "<M>")), (100, 50, ("[pre]", "[suf]", "[mid]"))])
def test_middle_on_odd_rows(spark, rate, spm, marks):
    rows = middle_rows()
    made = fill_middle.transform(frame(spark, rows), rate=rate, spm=spm, marks=marks)
    made = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks))
    got = made.collect()
    expect = [(*filled(r[0], r[1], 1, rate, spm, marks), r[1] or "") for r in rows]
    assert Counter(map(tuple, got)) == Counter(expect)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middle_of_an_empty_table(spark):
    assert fill_middle.transform(spark.createDataFrame([], SCHEMA)).collect() == []


def test_middle_query_restores_every_text(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_fill_middle"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        expect = filled(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == expect[1:5]
        assert r.output_sha256 == hashlib.sha256(expect[5].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- hard negatives -----------------------------------------------------------

LONG = 2**63


def mined(rows, every=10, positives=5, negatives=10, low=30, high=90):
    """Rows (id, vector, label) by definition, in Python's integers."""
    use = []
    for i, v, label in rows:
        if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            use.append((i, [math.floor(256 * Fraction(c)) for c in v], label))
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for at, (i, v, label) in enumerate(use):
        if i is None or i % every:
            continue
        found = {True: [], False: []}
        for k, (j, w, other) in enumerate(use):
            if k != at and len(v) == len(w):
                score = sum(a * b for a, b in zip(v, w))
                found[label == other].append((j, max(-LONG, min(LONG - 1, score))))
        for j, p in sorted(found[True], key=order)[:positives]:
            near = sorted((x for x in found[False] if low * p <= 100 * x[1] <= high * p), key=order)[:negatives]
            out += [(i, j, rank, k, p, s) for rank, (k, s) in enumerate(near, 1)]
    return out


def vector_rows(seed=0, dim=16, n=160):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim)) * 0.2 + 0.2
    rows = []
    for i in range(n):
        v = centres[i % 4] + rng.normal(size=dim) * 0.1
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    odd = [None, [], [], [0.0] * dim, [float("nan")] * dim, [None] + [1.0] * (dim - 1), [float("-inf")] * dim, [1.0] * 3, [2.0] * 3, [1.5] * 3]
    rows += [(10 * (n + k), v, k % 2) for k, v in enumerate(odd)]
    rows += [rows[0], rows[0], rows[10], (None, rows[1][1], 1), (None, rows[2][1], 2), (20 * n, rows[2][1], None)]
    return rows


def check_mined(spark, rows, **kw):
    schema = "vec_id long, embedding array<double>, label int, rid string, v string, dim int, qb string, scores string, near string"
    df = spark.createDataFrame([(*r, "rid", "v", 3, "qb", "scores", "near") for r in rows], schema).repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **kw).collect()
    assert Counter(map(tuple, got)) == Counter(mined(rows, **kw))
    return got


def test_negatives_on_odd_rows(spark):
    assert len(check_mined(spark, vector_rows())) > 500


def test_negatives_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 6)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "TILE_WORDS", 3)
    check_mined(spark, vector_rows(1, 9), positives=3, negatives=4, low=10, high=99)


def test_negatives_with_ties_and_one_hot_vector(spark):
    same = [0.5, 0.25, -0.125]
    rows = [(i, same, 0 if i % 3 else 1) for i in range(70)] + [(100 + i, [0.3, 0.2, 0.1 * (i % 2)], 2) for i in range(30)]
    check_mined(spark, rows)


def test_negatives_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e30, 3e4, 1e12, -2.5, 7e15]) * rng.random() for _ in range(4)], i % 2) for i in range(60)]
    check_mined(spark, rows)


def test_negatives_without_anchors_or_rows(spark):
    rows = [(i + 1, [1.0, float(i)], i % 2) for i in range(5)]
    check_mined(spark, rows)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(none, F.col("vec_id") % 10 == 0).collect() == []


def test_packed_fields_hold_exact_scores():
    rng = np.random.default_rng(3)
    for low, high, dim, n in ((-300, 300, 64, 57), (0, 1, 3, 8), (-5, -4, 7, 9), (-(2**31), 2**31, 5, 11), (2**40, 2**41, 2, 4)):
        c, a = rng.integers(low, high + 1, (n, dim)), rng.integers(low, high + 1, (6, dim))
        packed = hard_negatives.Packed(c, a)
        exact = np.array([[min(LONG - 1, max(-LONG, sum(int(x) * int(y) for x, y in zip(u, w)))) for w in c] for u in a], object)
        assert (packed.scores(a).astype(object) == exact).all()
    assert hard_negatives.Packed(rng.integers(-250, 250, (9, 64)), rng.integers(-250, 250, (2, 64))).fields == 2
