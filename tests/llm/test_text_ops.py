"""Suffix arrays, Jaccard join, winnowing: against brute force on odd rows and on the smallest tables."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from llmdata import SCHEMA, documents, frame, words

from ephysframe.llm import lsh_forest, queries, suffix_dedup, winnowing

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


# --- suffix arrays ------------------------------------------------------------

def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = rng.integers(0, rng.integers(2, 5), rng.integers(1, 150))
        x[-1] = 0
        suffix = [[(0, k) if v == 0 else (1, v) for k, v in enumerate(x.tolist())][i:] for i in range(len(x))]
        sa, rank = suffix_dedup.suffix_array(x.astype(np.int64))
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: suffix[i])
        assert rank[sa].tolist() == list(range(len(x)))
        lcp = suffix_dedup.common_prefixes(x.astype(np.int64), sa)
        for a, b in zip(sa[:-1], sa[1:]):
            n = next((k for k, (p, q) in enumerate(zip(suffix[a], suffix[b])) if p != q), min(len(suffix[a]), len(suffix[b])))
            assert lcp[b] == n


def cut(texts, length):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        out.append((len(b), [(int(a), int(e)) for a, e in zip(edge[::2], edge[1::2])], bytes(v for v, g in zip(b, gone[1:]) if not g)))
    return out


@pytest.mark.parametrize("length,gram,limit", [(40, 8, 5000), (25, 25, 3), (40, 8, 2)])
def test_repeats_on_odd_rows(spark, length, gram, limit):
    """The small limits spread anchors over several shards, which binary search merges."""
    rows = documents()
    rows += [(200 + i, "0123456789" * 8 + chr(97 + i) * 30, None, None, 0, "", "", 0, "", "") for i in range(9)]
    rows += [(300 + i, chr(65 + i) * 50 + "the one passage that many rows share, word for word" + chr(97 + i) * 50, None, None, 0, "", "", 0, "", "") for i in range(9)]
    got = suffix_dedup.remove(frame(spark, rows), length=length, gram=gram, limit=limit).collect()
    expect = Counter((r[0], n, tuple(s), k) for r, (n, s, k) in zip(rows, cut([r[1] for r in rows], length)))
    assert Counter((r.id, r.n_bytes, tuple((x.a, x.b) for x in r.spans), bytes(r.kept)) for r in got) == expect


def test_repeats_query(spark):
    docs = table(spark, "documents")
    expect = {r.doc_id: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for r, (n, s, k) in zip(docs, cut([r.text for r in docs], 200))}
    assert {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op6_suffix_arrays"](spark, SF).collect()} == expect


# --- Jaccard join -------------------------------------------------------------

def classes(rows, shingle=5):
    """Expected (class, links, component) by row number; ids may be null or repeat."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else None)
    n = len(rows)
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * n
    same = list(range(n))
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
                if sets[i] == sets[j]:
                    same[i] = same[j]
    by, cls = defaultdict(list), defaultdict(list)
    for i in range(n):
        by[top(i)].append(rows[i][0])
        cls[same[i]].append(rows[i][0])
    first = lambda ids: min((x is None, x or 0) for x in ids)
    id_of = lambda p: None if p[0] else p[1]
    return [(id_of(first(cls[same[i]])), links[i], id_of(first(by[top(i)]))) for i in range(n)], len(by)


def test_jaccard_on_odd_rows(spark):
    rows = documents()
    expect, n = classes([(r[0], r[1]) for r in rows])
    got = lsh_forest.join(frame(spark, rows)).collect()
    assert Counter((r.id, r.class_id, r.n_links, r.component_id) for r in got) == Counter((r[0], *e) for r, e in zip(rows, expect))
    assert sum(r.kept for r in got) == n
    kept = lsh_forest.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() <= n


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(lsh_forest, "VERIFY_BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:k] + [f"n{k}"] + base[k + 1:])) for k in range(12)] + [(50 + k, " ".join(base)) for k in range(3)]
    rows += [(90 + k, " ".join(base[:10 + k])) for k in range(30)]
    expect, _ = classes(rows)
    got = {r.id: r for r in lsh_forest.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), e in zip(rows, expect):
        assert (got[i].class_id, got[i].n_links, got[i].component_id) == e


def test_overlaps_take_memory_by_what_is_shared(monkeypatch):
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
    sets = [np.sort(rng.permutation(pool)[:k]) for k in (400, 300, 1, 0, 500)]
    want = [[len(np.intersect1d(x, y)) if i != j else int(np.isin(x, np.concatenate([*sets[:i], *sets[i + 1:]])).sum()) for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    tracemalloc.start()
    try:
        got = lsh_forest.overlaps(sets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.tolist() == want and peak < 1_000_000, peak
    monkeypatch.setattr(lsh_forest, "OVERLAP_CELLS", 1)  # several steps of 256 columns
    assert lsh_forest.overlaps(sets).tolist() == want
    assert lsh_forest.overlaps([pool[:3], pool[3:5]]).tolist() == [[0, 0], [0, 0]]


def test_jaccard_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents")]
    expect, _ = classes(rows)
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op7_lsh_forest"](spark, SF).collect()}
    assert got == {i: (*e, e[2] == i) for (i, _), e in zip(rows, expect)}


def test_prefix_is_shortened_until_recall():
    assert lsh_forest.prefix_depth(0.8, 24, 6, 0.99999) == 4
    assert lsh_forest.prefix_depth(0.8, 24, 6, 0.9) == 6
    assert lsh_forest.prefix_depth(0.1, 2, 6, 0.99999) == 1


def test_ascending_a_trie_joins_what_is_similar():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 60))
        sketch = rng.integers(0, 3, (n, 12)).astype(np.uint8)
        sketch[rng.integers(0, n, n // 2)] = sketch[0]
        rest = np.sort(rng.integers(0, 3, n).astype(np.uint64) << np.uint64(32) | rng.integers(0, 3, n).astype(np.uint64))
        found = lsh_forest.ascend(sketch, rest, [0, 32, 64], 8)
        near = (sketch[:, None] == sketch[None]).sum(axis=2) >= 8
        assert all(near[x, y] for x, y in found) and len(found) < n
        got, want = list(range(n)), list(range(n))
        for up, edges in ((got, found), (want, np.argwhere(near).tolist())):
            for x, y in edges:
                a, b = up[x], up[y]
                up[:] = [min(a, b) if c in (a, b) else c for c in up]
        assert got == want


def test_jaccard_recall_of_lone_pairs(spark):
    """Pairs of texts at a Jaccard similarity of exactly 0.8: 45 and 45 shingles, 40 of them shared."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = []
    for k in range(900):
        w = [word() for _ in range(49)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:44], *(word() for _ in range(5))]))]
    got = lsh_forest.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    linked = sum(r.n_links == 1 and r.component_id == r.id - r.id % 2 for r in got)
    assert linked >= 0.99 * len(rows) and all(r.n_links <= 1 for r in got), linked


def test_deduplicate_keeps_every_wordless_row(spark):
    none = [(i, t, None, source, 0, "", "", 0, "", "") for i, t in ((None, None), (7, ""), (8, "!?\n")) for source in ("a", "a", "b")]
    worded = [(1, "one text of some words", None, s, 0, "", "", 0, "", "") for s in ("a", "b")] + [
        (2, "one text of some words", None, "a", 0, "", "", 0, "", ""), (3, "日", None, "a", 0, "", "", 0, "", ""), (3, "日", None, "b", 0, "", "", 0, "", "")]
    got = [tuple(r) for r in lsh_forest.deduplicate(frame(spark, none + worded)).collect()]
    assert Counter(r for r in got if r[0] not in (1, 2, 3)) == Counter(none)
    assert sorted(r[0] for r in got if r[0] in (1, 2, 3)) == [1, 3]


# --- winnowing ----------------------------------------------------------------

ITEMS = [(1, "one two THREE four five six seven eight nine ten eleven twelve"), (2, "four five six seven eight nine ten eleven twelve thirteen"), (2, "short item"),
         (None, "a null item of exactly ten words long is this one"), (3, ""), (4, None), (5, "!!! ..."), (11, "x1"), (12, "one two THREE four five six seven eight nine ten eleven twelve")]


def hits(text, items):
    w, hit, names = words(text), set(), set()
    for i, t in items:
        v = words(t)
        size = min(10, len(v))
        wins = {tuple(v[k:k + size]) for k in range(len(v) - size + 1)} if size else set()
        for k in range(len(w) - size + 1) if size else ():
            if tuple(w[k:k + size]) in wins:
                hit |= set(range(k, k + size))
                names.add("null" if i is None else str(i))
    return len(w), len(hit), sorted(names)


def test_winnowing_on_odd_rows(spark):
    more = [ITEMS[0][1], "zzz " * 500 + ITEMS[0][1] + " tail " + ITEMS[1][1], "One, two; three\nfour-five six seven eight nine TEN", "short ITEM! short item", "x1 x1 x1",
            ITEMS[3][1] + " " + ITEMS[3][1], "seven " * 40, " ".join(ITEMS[0][1].split()[1:11])]
    rows = documents() + [(500 + i, t, None, None, 0, "", "", 0, "", "") for i, t in enumerate(more)] + [(500, more[0], None, None, 0, "", "", 0, "", "")]
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, fp string")
    got = winnowing.find(frame(spark, rows), items).collect()
    expect = Counter((r[0], n, h, tuple(names)) for r in rows for n, h, names in [hits(r[1], ITEMS)])
    assert Counter((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == expect
    assert all(sum(s.end - s.first for s in r.spans) == r.n_hit for r in got)
    left = winnowing.clean(frame(spark, rows), items)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((r[0], r[1]) for r in rows if not hits(r[1], ITEMS)[1])
    assert left.columns == frame(spark, rows).columns


def test_winnowing_query(spark):
    items = [(r.item_id, r.text) for r in table(spark, "benchmark")]
    got = {r.doc_id: r for r in queries.QUERIES["op8_winnowing"](spark, SF).collect()}
    docs = table(spark, "documents")
    assert len(got) == len(docs)
    for r in docs:
        n, h, names = hits(r.text, items)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, h, len(names), h > 0)
        assert g.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert winnowing.find(none, items).count() == lsh_forest.join(none).count() == suffix_dedup.remove(none).count() == 0
    some = frame(spark, documents()[:5])
    assert [r.n_hit for r in winnowing.find(some, items.limit(0)).collect()] == [0] * 5
