"""The five stages, one after another, against plain Python on odd rows: nulls, empty and long texts, repeated rows, further columns."""

import math
from collections import Counter, defaultdict

import pytest
from llmdata import SCHEMA, documents, words
from test_native import draw
from test_text_ops import ITEMS, classes, hits

import corpus_pipeline
from ephysframe.llm import poisson_mix, toxicity_chain
from ephysframe.llm.queries import MIX_WEIGHTS

LABELS, BENCHMARK = "doc_id long, quality int, toxic int", "item_id long, text string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def odd_rows():
    tail = ["th", "key", 7, "shard", "parts"]
    rows = documents(6) + [(300 + i, f"{ITEMS[0][1]} {i}", "en", "src0", 1, *tail) for i in range(3)]
    rows += [(400 + i, "grubble snarkit " * 4 + f"w{i} x{i}", "en", ("src0", "src1", "src2", "zz")[i % 4], 1, *tail) for i in range(40)]
    rows += [(500 + i, f"plain words number{i} and{i} more{i} of{i} them{i}", None, ("src0", "src1", "src2", "zz")[i % 4], 1, *tail) for i in range(60)]
    return rows, [(400 + i, 1, 1) for i in range(30)] + [(500 + i, 1, 0) for i in range(50)] + [(None, 0, 1), (777, 0, 1)]


def written(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_one_after_another(spark, tmp_path):
    rows, labels = odd_rows()
    sf = tables(spark, tmp_path, rows, labels)
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")

    def after(name, docs):
        path = f"{tmp_path}/{name}"
        stages[name](spark, docs, sf).write.parquet(path)
        return spark.read.parquet(path)

    # toxicity: what the classifier chain rejects goes, every copy of it
    judged = toxicity_chain.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    clean = after("toxicity", docs)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id) for r in clean.collect()) == Counter(r.id for r in judged if not r.rejected)
    left = {r.doc_id for r in clean.collect()}
    assert not left & set(range(400, 440)) and set(range(500, 560)) <= left
    # near duplicates: one row a group, and all without words
    before = written(clean)
    lone = after("near_duplicates", clean)
    kept = written(lone)
    assert lone.columns == docs.columns and not Counter(kept) - Counter(before)
    worded = [r for r in before if words(r[1])]
    _, groups = classes([(r[0], r[1]) for r in worded])
    assert sum(bool(words(r[1])) for r in kept) == groups
    assert [r for r in kept if not words(r[1])] == [r for r in before if not words(r[1])]
    assert classes([(r[0], r[1]) for r in kept if words(r[1])])[1] == groups
    # decontamination
    pure = after("decontamination", lone)
    assert written(pure) == [r for r in kept if not hits(r[1], ITEMS)[1]] and pure.columns == docs.columns
    assert not {300, 301, 302} & {r[0] for r in written(pure)}
    # mixing: each row as often as its draw says
    size = defaultdict(int)
    for r in written(pure):
        size[r[3] or ""] += len((r[1] or "").encode())
    weight = {s: MIX_WEIGHTS.get(s, 1.0) for s in size}
    expect = Counter()
    for r in written(pure):
        s = r[3] or ""
        lam = weight[s] / sum(weight.values()) * sum(size.values()) / size[s] if size[s] else 0.0
        parts = max(1, math.ceil(lam / poisson_mix.PART))
        p = c = math.exp(-lam / parts)
        cdf = [c]
        for j in range(1, poisson_mix.TERMS + 1):
            p *= lam / parts / j
            c += p
            cdf.append(c)
        expect[r] += sum(sum(x <= draw("mix", "null" if r[0] is None else str(r[0]), str(i)) for x in cdf) for i in range(1, parts + 1))
    mixed = after("mixing", pure)
    assert Counter(written(mixed)) == +expect and mixed.columns == docs.columns
    # sharding: every row has a slot of its own, gapless in its shard; an id decides the shard
    placed = after("sharding", mixed).collect()
    assert Counter(tuple(r[c] for c in COLUMNS if c != "shard") for r in placed) == Counter(tuple(x for c, x in zip(COLUMNS, r) if c != "shard") for r in written(mixed))
    slots, home = defaultdict(list), defaultdict(set)
    for r in placed:
        slots[r.shard].append(r.slot)
        home[r.doc_id].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(24))
    assert all(len(x) == 1 for x in home.values())


def test_run_equals_its_stages_and_takes_empty_tables(spark, tmp_path):
    rows, labels = odd_rows()
    sf = tables(spark, tmp_path / "full", rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    # which of equal rows gets which slot is open
    own = [c for c in docs.columns if c != "slot"]
    assert written(corpus_pipeline.run(spark, sf).select(*own)) == written(docs.select(*own))
    empty = tables(spark, tmp_path / "empty", [], [])
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_missing_benchmark_is_an_error(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
