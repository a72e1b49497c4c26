"""N-gram Jaccard join through a MinHash LSH forest.

Texts are sets of word shingles; equal sets are one class. A tree's label of a
class is a path of MinHash values, and the sorted labels of a tree are a trie.
Classes that share the longest prefix are compared first, by sketches; then the
prefix is shortened, and classes that no longer prefix has joined are compared,
down to the depth at which some tree finds a pair at the threshold with the
target recall. What looks similar is joined to candidate components. Within a
component every pair is verified exactly on its shingle sets. Large nodes of a
trie and large components are split into blocks, and pairs of blocks are
compared in tasks of their own; links are counted there, never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Words, mixed, slices
from .common import blocks, by_group, connected_components, groups, joined_back, materialise, spanning, text_or_empty

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 6, 0.99999
#: Sketches agree in at least the threshold less so much; about 5 standard deviations of 144 values.
SLACK = 0.17
#: Classes of a trie's node, classes of a component and their shingles that are compared in one task, about.
BUCKET_BLOCK, VERIFY_BLOCK, VERIFY_SHINGLES = 1024, 512, 1 << 21
#: Cells of an incidence matrix that are multiplied at once, about.
OVERLAP_CELLS = 4 << 20
#: A character of a word, as in ``bytetext``.
WORDED = r"[0-9A-Za-z]|[^\x00-\x7F]"
_draws = np.random.default_rng(20240229).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from the whole path upwards, at which a pair at the threshold is found with the target recall."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row; a text of fewer words is one shingle."""
    at, value = words.grams(size)
    bound = np.searchsorted(at, words.first)
    for r in range(len(words.first) - 1):
        if bound[r] < bound[r + 1]:
            yield np.unique(value[bound[r]:bound[r + 1]])
            continue
        own = words.code[words.first[r]:words.first[r + 1]]
        code = np.uint64(len(own))
        with np.errstate(over="ignore"):
            for w in own:
                code = code * np.uint64(0xD6E8FEB86659FD93) + w
        yield mixed(np.array([code], np.uint64)) if len(own) else np.zeros(0, np.uint64)


def _signatures(shingle: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(TREES, dtype=np.uint64)
        for batch in batches:
            for first, end, body, offsets in slices(batch.column("text")):
                n = end - first
                size, c1, c2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                low = np.zeros((n, TREES * DEPTH), np.uint64)
                for r, s in enumerate(shingle_sets(Words(body, offsets), shingle)):
                    size[r] = len(s)
                    if len(s):
                        c1[r], c2[r] = mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), mixed(s ^ np.uint64(0x14057B7EF767814F)).sum()
                        low[r] = np.multiply.outer(s, _draws).min(axis=0) if len(s) <= 4096 else np.min(
                            [np.multiply.outer(s[i:i + 4096], _draws).min(axis=0) for i in range(0, len(s), 4096)], axis=0)
                path = low.reshape(n, TREES, DEPTH)
                key = np.broadcast_to(tree, (n, TREES)).copy()
                for d in range(keep):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + path[:, :, d])
                # what follows the shared prefix: 64 bits in which longer prefixes are leading bits
                rest = np.zeros((n, TREES), np.uint64)
                width = np.uint64(64 // (DEPTH - keep)) if keep < DEPTH else np.uint64(0)
                for d in range(keep, DEPTH):
                    rest = (rest << width) | (mixed(path[:, :, d] + tree) >> (np.uint64(64) - width))
                sketch = mixed(low).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, n), batch.column("th").slice(first, n), pa.array(size),
                    pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * TREES + 1, TREES, dtype=np.int32)), pa.array(key.view(np.int64).ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * TREES + 1, TREES, dtype=np.int32)), pa.array(rest.view(np.int64).ravel())),
                ], names=["id", "th", "size", "c1", "c2", "sketch", "keys", "rests"])
    return run


def ascend(sketch: np.ndarray, rest: np.ndarray, shifts: list[int], limit: int) -> list[tuple[int, int]]:
    """Edges (row, row) that connect the rows of a trie's node whose sketches agree in ``limit`` places, directly or over others.

    Rows are sorted by ``rest``, so the rows of a longer prefix are neighbours.
    From the longest prefix up, each row is compared with the rows of its
    prefix that are not joined with it yet; rows joined further down are
    joined for good, so a cluster of near copies costs one comparison a row.
    """
    part = np.arange(len(rest))
    edges: list[tuple[int, int]] = []
    done = np.zeros(len(rest), np.int64)  # the length of the run in which a row was last compared with all others
    for shift in shifts:
        prefix = rest >> np.uint64(shift) if shift < 64 else np.zeros(len(rest), np.uint64)
        bounds = [0, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1).tolist(), len(rest)]
        for first, end in zip(bounds, bounds[1:]):
            if end - first < 2 or end - first == done[first]:
                continue
            done[first:end] = end - first
            left = np.arange(first, end)
            while len(left):
                # one part after another: its rows, and those that join it, against what is left
                todo = left[part[left] == part[left[0]]].tolist()
                name = part[left[0]]
                left = left[part[left] != name]
                while todo and len(left):
                    row = todo.pop()
                    near = left[(sketch[left] == sketch[row]).sum(axis=1) >= limit]
                    if not len(near):
                        continue
                    joined = np.unique(part[near])
                    at = {int(part[x]): int(x) for x in near.tolist()}
                    edges += [(row, at[int(k)]) for k in joined]
                    new = np.isin(part[left], joined)
                    todo += left[new].tolist()
                    part[left[new]] = name
                    left = left[~new]
    return edges


def _bucket_edges(limit: int, shifts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for g in groups(batches, ["key", "bi", "bj"]):
            node = g.column("node").to_numpy()
            if len(node) < 2:
                continue
            sketch = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
            if len(node) == 2:
                found = [(0, 1)] if (sketch[0] == sketch[1]).sum() >= limit else []
            else:
                rest = g.column("rest").to_numpy().view(np.uint64)
                order = np.argsort(rest, kind="stable")
                found = [(order[x], order[y]) for x, y in ascend(sketch[order], rest[order], shifts, limit)]
            a += [int(node[x]) for x, _ in found]
            b += [int(node[y]) for _, y in found]
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, body, offsets in slices(batch.column("text")):
                sets = [s.tobytes() for s in shingle_sets(Words(body, offsets), shingle)]
                rest = [batch.column(c).slice(first, end - first) for c in ("comp", "node", "n", "members")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], names=["comp", "node", "n", "members", "shingles"])
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over the shingles that some two sets share."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((n, n), np.float32)
    # no wider than what is shared: most components are a few texts
    total = int(shared.sum())
    step = max(1, min(total, max(256, OVERLAP_CELLS // max(1, n))))
    for c in range(0, total, step):
        lo, hi = np.searchsorted(column, [c, c + step])
        part = np.zeros((n, step), np.float32)
        part[rows[lo:hi], column[lo:hi] - c] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def _verified(threshold: float):
    num, den = round(threshold * 10_000), 10_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["comp", "bi", "bj"]):
            node, index = np.unique(g.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            g = g.take(pa.array(index))
            own, weight = g.column("own").to_numpy(), g.column("members").to_numpy()
            bi, bj = g.column("bi")[0].as_py(), g.column("bj")[0].as_py()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("shingles")]
            both = overlaps(sets)
            size = np.array([len(s) for s in sets])
            match = both * den >= num * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(match, False)
            counted = match if bi == bj else match & (own[:, None] != own[None, :])
            links = counted @ weight
            edges = spanning(match, own, bi, bj)
            a = [*node.tolist(), *(int(node[x]) for x, _ in edges)]
            b = [*[None] * len(node), *(int(node[y]) for _, y in edges)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*links.tolist(), *[0] * len(edges)], pa.int64())],
                                             names=["a", "b", "links"])
    return run


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, th, class_id, n_links, component_id, kept)`` for each row of ``docs``.

    ``class_id`` is the smallest id of the rows with the same shingles,
    ``n_links`` the number of other rows at the threshold or above, copies
    included, ``component_id`` the smallest id reachable over links; the
    first row of a component, by id (null last) and then any fixed order, is
    kept. A null or wordless text links with nothing and is kept.
    """
    keep = prefix_depth(threshold, TREES, DEPTH, RECALL)
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_signatures(shingle, keep), f"id {kind}, th long, size long, c1 long, c2 long, sketch binary, keys array<long>, rests array<long>")
    sig = materialise(made.withColumn("rid", F.monotonically_increasing_id()), "jaccard-signatures")
    worded = sig.where("size > 0")
    first = F.struct(F.col("id").isNull().alias("no"), "id", "rid")
    classes = worded.groupBy("c1", "c2").agg(F.min(first).alias("head"), F.count(F.lit(1)).alias("members"))
    classes = materialise(classes.select("c1", "c2", F.col("head.rid").alias("node"), F.col("head.id").alias("class_id"), "members"), "jaccard-classes")
    heads = worded.join(classes.select(F.col("node").alias("rid"), "members"), "rid")
    # nodes of the tries, at the shortest prefix, that hold more than one class
    zipped = F.explode(F.arrays_zip("keys", "rests")).alias("label")
    entries = heads.select(F.col("rid").alias("node"), zipped).select("node", F.col("label.keys").alias("key"), F.col("label.rests").alias("rest"))
    entries = materialise(entries, "jaccard-entries")
    many = entries.groupBy("key").count().where("count > 1").withColumnRenamed("count", "size")
    found = joined_back(entries, many, "key", "jaccard-nodes").join(heads.select(F.col("rid").alias("node"), "sketch"), "node")
    dealt = blocks(found, "key", F.col("size"), BUCKET_BLOCK, F.xxhash64("node")).select("key", "bi", "bj", "own", "node", "rest", "sketch")
    agree = round((threshold - SLACK) * TREES * DEPTH)
    # bits dropped from the end of a label's rest, from the longest prefix to the shortest
    shifts = [64 // (DEPTH - keep) * d for d in range(DEPTH - keep)] + [64] if keep < DEPTH else [64]
    near = by_group(dealt, ["key", "bi", "bj"], "rest").mapInArrow(_bucket_edges(agree, shifts), "a long, b long").distinct()
    comps = connected_components(near, "jaccard-candidates")
    # exact verification of all pairs within a candidate component
    comps = comps.join(heads.select(F.col("rid").alias("node"), "id", "th", "members", "size"), "node")
    # a component's blocks are as many as its classes and as its shingles ask for
    sizes = comps.groupBy("component").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("size") * VERIFY_BLOCK / VERIFY_SHINGLES)).alias("n"))
    wanted = joined_back(comps, sizes, "component", "jaccard-sizes").select(
        F.col("component").alias("comp"), "node", "n", "members", F.col("id").alias("__id"), F.col("th").alias("__th"))
    wanted = materialise(wanted, "jaccard-wanted")
    # both sides grow with the corpus: a shuffle at every size
    texts = rows.join(wanted.hint("merge"), rows["id"].eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    sets = texts.select("text", "comp", "node", "n", "members").mapInArrow(_sets(shingle), "comp long, node long, n long, members long, shingles binary")
    dealt = blocks(sets, "comp", F.col("n"), VERIFY_BLOCK, F.xxhash64("node")).select("comp", "bi", "bj", "own", "node", "members", "shingles")
    checked = materialise(by_group(dealt, ["comp", "bi", "bj"]).mapInArrow(_verified(threshold), "a long, b long, links long"), "jaccard-checked")
    links = checked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    final = connected_components(checked.where("b is not null").select("a", "b"), "jaccard-links")
    named = (classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node")).join(links, "node", "left"))
    top = named.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("no"), F.col("class_id").alias("id"), F.col("node").alias("rid"))).alias("top"))
    named = joined_back(named, top, "component", "jaccard-tops").select("c1", "c2", "class_id", "members", F.coalesce("links", F.lit(0).cast("long")).alias("links"),
                                                F.col("top.id").alias("component_id"), F.col("top.rid").alias("top_rid"))
    full = sig.select("id", "th", "size", "c1", "c2", "rid").join(named, ["c1", "c2"], "left")
    alone = F.col("size") == 0
    return full.select(
        "id", "th", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("links") + F.col("members") - 1).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("rid") == F.col("top_rid"))).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``; of equal rows with the same id one stays. Wordless rows all stay."""
    joined = materialise(join(docs, doc_id, text), "jaccard-result")
    kept = joined.where("kept").select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    keyed = docs.withColumn("__own", F.xxhash64(text_or_empty(text)))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th"))
    worded = text_or_empty(text).rlike(WORDED)
    out = keyed.where(worded).join(kept, same, "left_semi")
    # rows equal in id and text cannot be told apart by a join; where there are any, one is left
    if not joined.groupBy("id", "th").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([doc_id, "__own"])
    return out.union(keyed.where(~worded)).drop("__own")
