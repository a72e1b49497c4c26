"""Lattice hashing against brute force; the toxicity chain on held-out rows; components; the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from llmdata import SCHEMA, documents, frame

import corpus_pipeline
from ephysframe.llm import lattice_dedup, queries, toxicity_chain
from ephysframe.llm.bytetext import Words, slices
from ephysframe.llm.common import connected_components

SF = "/root/testdata/sf0.001"


def linked(rows, threshold=0.98):
    """Expected (id, links, component) of rows (id, vector, label)."""
    n = len(rows)
    unit = []
    for _, v, label in rows:
        x = None if v is None or label is None or any(c is None for c in v) else np.array(v, float)
        unit.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x))
    up, links = list(range(n)), [0] * n

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    first = {}
    for i in range(n):
        key = (rows[i][0] is None, rows[i][0] or 0)
        first[top(i)] = min(first.get(top(i), (True, 1 << 60)), key)
    return [(rows[i][0], links[i], None if first[top(i)][0] else first[top(i)][1]) for i in range(n)], len(first)


def vectors(seed=0, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(25):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 12))):
            v = centre + rng.normal(size=dim) * rng.choice([0.05, 0.1, 0.14, 0.2])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(rng.integers(0, 2)) if g % 5 == 0 else g % 3))
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [None] + [1.0] * (dim - 1), [float("inf")] * dim, [1.0] * 3, [2.0] * 3, [1e30] * dim, [1e-30] * dim]
    rows += [(len(rows) + k, v, 1) for k, v in enumerate(odd)]
    rows += [rows[0], rows[0], (None, rows[1][1], rows[1][2]), (9999, rows[2][1], None), (10_000, rows[2][1], None)]
    return rows


def check_vectors(spark, rows):
    df = spark.createDataFrame([(*r, "u", "n") for r in rows], "vec_id long, embedding array<float>, label int, unit string, node string").repartition(3)
    got = lattice_dedup.join(df).collect()
    expect, n = linked(rows)
    assert Counter((r.id, r.n_links, r.component_id) for r in got) == Counter(expect)
    assert sum(r.first for r in got) == n
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_lattice_on_odd_rows(spark):
    check_vectors(spark, vectors())


def test_lattice_blocks_and_other_dimensions(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "BLOCK", 3)
    check_vectors(spark, vectors(1, 16))


def test_lattice_query_recall(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expect, _ = linked(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op9_lattice_hashing"](spark, SF).collect()}
    assert got == {i: (n, c, c == i) for i, n, c in expect}


def planted(dim, pairs, seed):
    """Lone pairs just above the threshold, each in a direction of its own."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(pairs):
        a, b = rng.normal(size=(2, dim))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cos = rng.uniform(0.9801, 0.981)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (cos * a + np.sqrt(1 - cos**2) * b).tolist(), 1)]
    return rows


def test_lattice_recall_of_lone_pairs(spark):
    for dim, pairs, least in ((64, 600, 0.99), (768, 300, 0.99)):
        rows = planted(dim, pairs, dim)
        got = lattice_dedup.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)).collect()
        linked = sum(r.n_links == 1 and r.component_id == r.id - r.id % 2 for r in got)
        assert linked >= least * 2 * pairs and all(r.n_links <= 1 for r in got), (dim, linked)


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice_dedup.decode_e8(x)
    twice = np.rint(2 * p)
    assert (2 * p == twice).all() and ((twice % 2 == 0).all(axis=1) | (twice % 2 != 0).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    shell = lattice_dedup._neighbours()
    assert shell.shape == (240, 8) and np.allclose((shell**2).sum(axis=1), 2)
    own = ((x - p) ** 2).sum(axis=1)
    assert (own[:, None] <= ((x[:, None] - p[:, None] - shell[None]) ** 2).sum(axis=2) + 1e-9).all()


def test_components_against_python(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- toxicity -----------------------------------------------------------------

BAD = ["grubble", "snarkit", "vexilo", "plonker"]


def toxic_table(spark, n=900, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 80))]
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD).title())
        if low:
            w += ["buy", "cheap", f"pills{rng.randrange(5)}"] * 2
        docs.append((i, " ".join(w), "en", "s", 1, "th", "key", 1, "shard", "parts"))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_chain_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    seen = [x for x in labels if x[0] % 3] + [(1, None, None), (None, 1, 1), (5000, 1, 1), labels[1]]
    docs += [(None, "", None, None, None, "", "", 1, "", ""), (None, None, None, None, None, "", "", 1, "", ""), docs[0]]
    got = toxicity_chain.judge(frame(spark, docs), spark.createDataFrame(seen, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    toxic = {x[0]: x[2] for x in labels}
    held = [r for r in got if r.id is not None and r.id % 3 == 0]
    right = sum(r.rejected == bool(toxic[r.id]) for r in held) / len(held)
    assert right > 0.97, right
    assert all(0 <= r.p_low_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    assert not any(r.rejected for r in got if r.id is None)


def test_chain_weighs_rare_words_among_many_features(spark):
    """About 44,000 filled buckets, each of 9 rows or more but for the toxic words' of 4 rows: none of theirs is among the 32,768 commonest."""
    rng = random.Random(7)
    invented = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(16_060)]
    noise, bad = invented[60:], invented[:60]
    train, held = 1200, 300
    spread = noise * 9 + rng.choices(noise, k=120 * held)
    texts = [spread[i:i + 120] for i in range(0, len(spread), 120)]
    labels = [(i, 1, int(i % 10 == 0)) for i in range(len(texts))]
    slots = bad * 4
    for i in range(0, len(texts), 10):
        texts[i] = texts[i] + (slots[i // 5:i // 5 + 2] if i < train else rng.sample(bad, 4))
    docs = [(i, " ".join(rng.sample(w, len(w))), "en", "s", 1, "th", "key", 1, "shard", "parts") for i, w in enumerate(texts)]
    got = toxicity_chain.judge(frame(spark, docs), spark.createDataFrame(labels[:train], "doc_id long, quality int, toxic int")).collect()
    toxic = {x[0] for x in labels if x[2]}
    rejected = {r.id for r in got if r.id >= train and r.rejected}
    expect = {i for i in toxic if i >= train}
    assert len(rejected & expect) >= 0.9 * len(expect), (len(rejected & expect), len(expect))
    assert len(rejected - expect) <= 0.02 * held, len(rejected - expect)


def dense_fit(x, y, rounds=60_000):
    """The same objective by plain proximal steps on a dense matrix with a last column of ones."""
    n = len(y)
    step = 1 / (np.linalg.norm(x, 2) ** 2 / (4 * n) + toxicity_chain.RIDGE)
    cut = np.full(x.shape[1], toxicity_chain.LASSO * step)
    ridge = np.full(x.shape[1], toxicity_chain.RIDGE)
    cut[-1] = ridge[-1] = 0
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = z - step * (x.T @ (1 / (1 + np.exp(-(x @ z))) - y) / n + ridge * z)
        new = np.sign(new) * np.maximum(np.abs(new) - cut, 0)
        if (z - new) @ (new - w) > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, t, w = new + (t - 1) / after * (new - w), after, new
    return w


def test_chain_equals_brute_force(spark):
    """The whole chain on a small table: every fit, the out-of-fold chances and the scores."""
    docs, labels = toxic_table(spark, 90, 3)
    ids = [d[0] for d in docs]
    fold = {r.i: r.f for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("i", "pmod(xxhash64('fold', cast(i as string)), 3) f").collect()}
    used, x = {}, np.zeros((len(ids), 20_000))
    for k, (_, _, body, offsets) in enumerate(slices(pa.array([d[1] for d in docs]))):
        for r, own in enumerate(toxicity_chain.feature_sets(Words(body, offsets))):
            for f in own.tolist():
                x[r, used.setdefault(f, len(used))] = 1
    x = np.concatenate([x[:, :len(used)], np.ones((len(ids), 1))], axis=1)
    fold = np.array([fold[i] for i in ids])
    low, toxic = np.array([1.0 - q for _, q, _ in labels]), np.array([float(t) for _, _, t in labels])
    known = np.array(ids) % 4 != 0
    sure = lambda x, w: 1 / (1 + np.exp(-(x @ w)))
    first = sure(x, dense_fit(x[known], low[known]))
    unseen = np.zeros(len(ids))
    for f in range(3):
        unseen[fold == f] = sure(x[fold == f], dense_fit(x[known & (fold != f)], low[known & (fold != f)]))
    joined = np.insert(x, -1, unseen, axis=1)
    last = sure(np.insert(x, -1, first, axis=1), dense_fit(joined[known], toxic[known]))
    seen = spark.createDataFrame([y for y in labels if y[0] % 4], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in toxicity_chain.judge(frame(spark, docs), seen, rounds=4000, enough=0.0).collect()}
    assert np.allclose([got[i].p_low_quality for i in ids], first, atol=2e-4)
    assert np.allclose([got[i].p_toxic for i in ids], last, atol=2e-4)
    assert 0 < sum(r.rejected for r in got.values()) < len(ids)


def test_chain_with_repeated_ids(spark):
    """Copies of an id are one row of the sample; every copy is scored, whatever its text."""
    docs, labels = toxic_table(spark, 300, 5)
    copies = [(docs[7][0], docs[k][1], *docs[7][2:]) for k in range(250)] + [docs[8]] * 250
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    least = spark.createDataFrame([(d[1],) for d in docs[:250]], "t string").selectExpr("min_by(t, xxhash64(t)) t").first().t
    model = toxicity_chain.fit(frame(spark, docs + copies), table, sample=300)
    alone = [(d[0], least if d[0] == docs[7][0] else d[1], *d[2:]) for d in docs]
    plain = toxicity_chain.fit(frame(spark, alone), table, sample=300)
    assert all(np.allclose(a, b) for a, b in zip(model.weights, plain.weights)) and np.allclose(model.intercepts, plain.intercepts)
    got = toxicity_chain.judge(frame(spark, docs + copies), table, sample=300).collect()
    assert len(got) == len(docs) + len(copies)


def test_chain_without_labels(spark):
    docs = frame(spark, documents())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.rejected for r in toxicity_chain.judge(docs, none).collect())
    one = spark.createDataFrame([(i, 1, 1) for i in range(5)], none.schema)
    assert all(r.rejected for r in toxicity_chain.judge(docs, one).collect())
    assert toxicity_chain.judge(spark.createDataFrame([], SCHEMA), none).count() == 0


# --- pipeline -----------------------------------------------------------------

def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), stage(spark, kept, sf).schema) if name != "sharding" else stage(spark, kept, sf)
        rows = kept.collect()
        assert rows and all(before[r.doc_id] == r.text for r in rows)
        if name != "sharding":
            assert kept.columns == docs.columns
        if name == "toxicity":
            left = {r.doc_id for r in rows}
            assert len(toxic - left) >= 0.8 * len(toxic) and len(left) >= 0.9 * (len(before) - len(toxic))
        if name in ("near_duplicates", "decontamination"):
            assert len({r.doc_id for r in rows}) == len(rows)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
