"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to eight dimensions in several tables
and decoded to the nearest point of the E8 lattice; each vector is put into
its own cell and into the cells of the nearest neighbouring lattice points.
Vectors that share a cell are compared by short sketches, and what is close
is joined to candidate components. Within a component every pair is verified
by its cosine in double precision. Large cells and components are split into
blocks, and pairs of blocks are compared in tasks of their own; links are
counted there, never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import mixed
from .common import blocks, by_group, connected_components, groups, joined_back, materialise, spanning

THRESHOLD = 0.98
TABLES, PROBES = 6, 8
#: Length, in the lattice's unit, of the projected difference of a pair at the threshold.
REACH = 0.57
SKETCH, SKETCH_SCALE, SKETCH_SLACK = 32, 200.0, 1.9
BLOCK = 1024


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, from their rule."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of D8 and of D8 shifted by a half in every dimension."""

    def d8(y: np.ndarray) -> np.ndarray:
        f = np.rint(y)
        e = y - f
        worst, at = np.abs(e).argmax(axis=1), np.arange(len(y))
        g = f.copy()
        g[at, worst] += np.where(e[at, worst] >= 0, 1.0, -1.0)
        return np.where((f.sum(axis=1) % 2 != 0)[:, None], g, f)

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def projection(dim: int, number: int, width: int) -> np.ndarray:
    """``width`` orthonormal random directions, the same for a number and dimension everywhere."""
    rng = np.random.default_rng([7, dim, number])
    return np.linalg.qr(rng.normal(size=(max(dim, width), max(dim, width))))[0][:dim, :width]


def cells(unit: np.ndarray, threshold: float) -> np.ndarray:
    """Cell numbers of each unit vector: in each table its own, then the nearest neighbours'."""
    n, dim = unit.shape
    shell = _neighbours()
    scale = REACH / (np.sqrt(2 - 2 * threshold) * np.sqrt(8 / max(dim, 8)))
    out = np.zeros((n, TABLES, 1 + PROBES), np.uint64)
    for t in range(TABLES):
        x = unit @ (projection(dim, t, 8) * scale)
        own = decode_e8(x)
        near = np.argsort(-((x - own) @ shell.T), axis=1, kind="stable")[:, :PROBES]
        for p in range(1 + PROBES):
            point = np.rint(2 * (own if p == 0 else own + shell[near[:, p - 1]])).astype(np.int64).view(np.uint64)
            key = np.full(n, dim * 64 + t, np.uint64)
            for k in range(8):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + point[:, k])
            out[:, t, p] = key
    return out.reshape(n, -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("v")
        flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        at = vectors.offsets.to_numpy()
        absent = vectors.is_null().to_numpy(zero_copy_only=False) | batch.column("label").is_null().to_numpy(zero_copy_only=False)
        out: list[bytes | None] = []
        for i in range(len(vectors)):
            x = flat[at[i]:at[i + 1]]
            ok = not absent[i] and len(x) and np.isfinite(x).all() and x.any()
            if ok:
                x = x / np.abs(x).max()
                x = x / np.sqrt(x @ x)
            out.append(x.tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], names=["id", "label", "unit"])


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _cells(threshold: float):
    width = TABLES * (1 + PROBES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                size = np.array([len(x.as_buffer()) for x in batch.column("unit")])
                for s in np.unique(size):
                    rows = pa.array(np.flatnonzero(size == s))
                    unit = _stack(batch.column("unit").take(rows))
                    dim = unit.shape[1]
                    short = unit @ projection(dim, 1000, min(dim, SKETCH)) * np.sqrt(dim / min(dim, SKETCH)) * SKETCH_SCALE * np.sqrt(1 / 2)
                    short = np.clip(np.rint(short), -127, 127).astype(np.int8)
                    key = cells(unit, threshold).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(unit) * width + 1, width, dtype=np.int32)), pa.array(key.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), batch.column("label").take(rows),
                                                      pa.array([x.tobytes() for x in short], pa.binary()), lists], names=["node", "label", "sketch", "keys"])
    return run


def _cell_edges(threshold: float):
    most = (2 - 2 * threshold) * SKETCH_SLACK * SKETCH_SCALE**2 / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for g in groups(batches, ["label", "key", "bi", "bj"]):
            node, index = np.unique(g.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            g = g.take(pa.array(index))
            short = np.array([np.frombuffer(x.as_buffer(), np.int8) for x in g.column("sketch")]).astype(np.float32)
            norm = (short**2).sum(axis=1)
            close = norm[:, None] + norm[None, :] - 2 * short @ short.T <= most
            for x, y in spanning(close, g.column("own").to_numpy(), g.column("bi")[0].as_py(), g.column("bj")[0].as_py()):
                a.append(int(node[x]))
                b.append(int(node[y]))
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["comp", "bi", "bj"]):
            node, own, weight = (g.column(k).to_numpy() for k in ("node", "own", "members"))
            bi, bj = g.column("bi")[0].as_py(), g.column("bj")[0].as_py()
            unit = _stack(g.column("unit"))
            match = unit @ unit.T >= threshold
            np.fill_diagonal(match, False)
            links = (match if bi == bj else match & (own[:, None] != own[None, :])) @ weight
            edges = spanning(match, own, bi, bj)
            a = [*node.tolist(), *(int(node[x]) for x, _ in edges)]
            b = [*[None] * len(node), *(int(node[y]) for _, y in edges)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*links.tolist(), *[0] * len(edges)], pa.int64())],
                                             names=["a", "b", "links"])
    return run


def join(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, n_links, component_id, kept, first)`` for each row of ``vectors``.

    Rows of equal, non-null label and equal dimension are linked at a cosine
    of ``threshold`` or more. A null, empty or zero vector, and one with null
    or non-finite components, links with nothing. Equal vectors are one node
    that counts its copies; ids may repeat: rows are told apart inside.
    ``component_id`` is a component's smallest id (null last), and ``kept``
    says whether the row has that id (a null id has it where the component has
    no other); where it repeats, ``first`` marks one of its rows.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    own = materialise(rows.mapInArrow(_units, f"id {kind}, label string, unit binary").withColumn("rid", F.monotonically_increasing_id()), "lattice-units")
    head = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rid")).alias("head")
    nodes = own.where("unit is not null").groupBy("label", "unit").agg(head, F.count(F.lit(1)).alias("members"))
    nodes = materialise(nodes.select("label", "unit", F.col("head.rid").alias("node"), F.col("head.id").alias("first_id"), "members"), "lattice-nodes")
    placed = materialise(nodes.select("node", "label", "unit").mapInArrow(_cells(threshold), "node long, label string, sketch binary, keys array<long>"), "lattice-cells")
    entries = placed.select("node", "label", "sketch", F.explode("keys").alias("key"))
    many = entries.groupBy("label", "key").count().where("count > 1").withColumnRenamed("count", "size")
    dealt = blocks(entries.join(many, ["label", "key"]), "key", F.col("size"), BLOCK, F.xxhash64("node")).select("label", "key", "bi", "bj", "own", "node", "sketch")
    near = by_group(dealt, ["label", "key", "bi", "bj"]).mapInArrow(_cell_edges(threshold), "a long, b long").distinct()
    comps = connected_components(near, "lattice-candidates")
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    wanted = joined_back(comps, sizes, "component", "lattice-sizes").select(F.col("component").alias("comp"), "node", "n").join(nodes.select("node", "unit", "members"), "node")
    dealt = blocks(wanted, "comp", F.col("n"), BLOCK, F.xxhash64("node")).select("comp", "bi", "bj", "own", "node", "members", "unit")
    checked = materialise(by_group(dealt, ["comp", "bi", "bj"]).mapInArrow(_verified(threshold), "a long, b long, links long"), "lattice-checked")
    links = checked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    final = connected_components(checked.where("b is not null").select("a", "b"), "lattice-links")
    named = nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node")).join(links, "node", "left")
    top = named.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("no"), F.col("first_id").alias("id"), F.col("node").alias("rid"))).alias("top"))
    named = joined_back(named, top, "component", "lattice-tops").select("label", "unit", "members", F.coalesce("links", F.lit(0).cast("long")).alias("links"),
                                                F.col("top.id").alias("top_id"), F.col("top.rid").alias("top_rid"))
    full = own.join(named, ["label", "unit"], "left")
    alone = F.col("members").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("top_id"))
    return full.select("id", F.when(alone, F.lit(0).cast("long")).otherwise(F.col("links") + F.col("members") - 1).alias("n_links"),
                       component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), (alone | (F.col("rid") == F.col("top_rid"))).alias("first"))
