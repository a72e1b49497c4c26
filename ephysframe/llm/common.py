"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ephysframe.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    optimiser the table's real size, by which it broadcasts or shuffles.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def id_string(c: str | Column) -> Column:
    """An id as text; null has a text of its own."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("null"))


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1) fixed by the parts: 52 bits of their md5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def joined_back(rows: DataFrame, sums: DataFrame, keys: str | list[str], name: str) -> DataFrame:
    """``rows`` joined with a grouped aggregate of theirs.

    The aggregate, one row a key, is written first: read back, it is dealt out
    anew like the rows, and in such a join Spark splits a hot key's rows among
    tasks. Joined as it is, it would keep the rows of a key together.
    """
    return rows.join(materialise(sums, name), keys)


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Smallest node reachable from each node: ``(node, component)``.

    ``edges`` has two non-null long columns ``a`` and ``b``. Alternates
    large-star and small-star steps, each a grouped minimum and a join, until
    an exact check finds only stars. The edge set never grows beyond its
    first size, nothing but a count of changed edges reaches the driver, and
    each round is written to the shared folder.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        # large star: neighbours above a node go to the node's smallest neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = joined_back(both, low, "a", name).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialise(large.distinct(), name)
        # small star: a node and its lower neighbours go to the smallest of them
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), name)
        kept = large.join(low, "a")
        small = (kept.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
                 .where("a <> b").distinct())
        e = materialise(small, name)
        # stars: no node points to two roots, and no root points further
        heads = e.select(F.col("b").alias("a")).distinct()
        twice = e.groupBy("a").count().where("count > 1").select("a")
        if e.join(heads, "a", "left_semi").isEmpty() and twice.isEmpty():
            break
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def groups(batches, keys: list[str]):
    """Tables of equal keys from batches that are sorted by them; only one group is held at a time."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``df`` dealt out by the keys and sorted by them, ready for :func:`groups`."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def blocks(df: DataFrame, key: str, size: Column, limit: int, salt: Column) -> DataFrame:
    """``df`` with ``bi``, ``bj`` and ``own``: large groups split into blocks, each row sent to all pairs of its block.

    A group of at most ``limit`` rows is the one pair (0, 0). Pairs of blocks
    together hold every pair of rows, and each row travels once for each
    block of its group, not once for each row. ``own`` is the row's block.
    """
    n = F.ceil(size / F.lit(limit)).cast("int")
    mine = F.pmod(salt, n).cast("int")
    pair = F.explode(F.sequence(F.lit(0), n - 1)).alias("other")
    split = df.withColumn("own", mine).select("*", pair)
    return split.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other")


def spanning(match, own, first: int, second: int) -> list[tuple[int, int]]:
    """Edges (row, row) that connect what the boolean matrix ``match`` connects.

    Rows of one block get a spanning forest. For a pair of blocks only the
    edges are returned that join parts which their blocks alone leave apart.
    """
    import numpy as np

    n = len(own)

    def parts(rows):
        label = {}
        for r in rows:
            if r in label:
                continue
            label[r] = r
            todo = [r]
            while todo:
                near = np.flatnonzero(match[todo].any(axis=0))
                todo = [x for x in near.tolist() if x in inside and x not in label]
                label |= dict.fromkeys(todo, r)
        return label

    if first == second:
        inside = set(range(n))
        return [(r, root) for r, root in parts(range(n)).items() if r != root]
    label = {}
    for b in (first, second):
        rows = np.flatnonzero(own == b).tolist()
        inside = set(rows)
        label |= parts(rows)
    up = {r: r for r in set(label.values())}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    names = np.array([label[r] for r in range(n)])
    a, b = np.nonzero(match & (own[:, None] == first) & (own[None, :] == second))
    out = []
    for x, y in set(zip(names[a].tolist(), names[b].tolist())):
        if top(x) != top(y):
            up[top(x)] = top(y)
            out.append((x, y))
    return out
