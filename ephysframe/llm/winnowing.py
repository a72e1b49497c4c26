"""Benchmark decontamination by winnowing.

Of every ``window`` of consecutive words the smallest (last on ties) of its
k-gram hashes is kept as a fingerprint, in documents and benchmark items
alike, so each shared span of at least ``window`` words shares one. The
fingerprints are joined; around each hit the windows that chose it are
compared word by word, and neighbouring windows make up the extended hit. An
item of fewer words than a window is a window of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Words, slices
from .common import materialise, text_or_empty

WINDOW, GRAM = 10, 5


def chosen(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(index of the window's first word, fingerprint)`` of each window of ``size`` words."""
    k = GRAM if size >= WINDOW else size
    at, value = words.grams(k)
    n = len(words.code) - size + 1
    if n <= 0 or not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = np.full(len(words.code), np.iinfo(np.uint64).max, np.uint64)
    full[at] = value
    best = full[:n].copy()
    for j in range(1, size - k + 1):
        np.minimum(best, full[j:j + n], out=best)
    whole = np.flatnonzero(words.row[:n] == words.row[size - 1:size - 1 + n])
    return whole, best[whole]


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, win, fp, len)``: the windows of the items, their words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, body, offsets in slices(batch.column(1)):
                words = Words(body, offsets)
                count = np.diff(words.first)
                out: list[tuple] = []
                for size in {min(int(c), WINDOW) for c in count if c}:
                    at, fp = chosen(words, size)
                    own = (count[words.row[at]] >= WINDOW) if size == WINDOW else (count[words.row[at]] == size)
                    out += [(ids[first + words.row[a]], words.text(a, size), int(f), size) for a, f in zip(at[own], fp[own].astype(np.int64))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int32()))],
                                                     names=["item", "win", "fp", "len"])

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "item string, win string, fp long, len int").distinct()


def _doc_prints(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, body, offsets in slices(batch.column("text")):
                words = Words(body, offsets)
                for size in sizes:
                    at, fp = chosen(words, size)
                    if not len(at):
                        continue
                    # a fingerprint once for each run of windows that choose it
                    row = words.row[at]
                    new = np.ones(len(at), bool)
                    new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
                    take = pa.array(first + row[new])
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("th").take(take), pa.array(fp[new].astype(np.int64))],
                                                     names=["id", "th", "fp"])
    return run


def _doc_windows(sizes: list[int]):
    kind = pa.list_(pa.struct([("s", pa.int32()), ("win", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("fps")
            for first, end, body, offsets in slices(batch.column("text")):
                words = Words(body, offsets)
                wins: list[list] = [[] for _ in range(end - first)]
                wanted = asked.slice(first, end - first)
                if wanted.null_count < end - first:
                    found = {size: chosen(words, size) for size in sizes}
                    for r, prints in enumerate(wanted.to_pylist()):
                        if prints:
                            prints = np.array(prints, np.int64).view(np.uint64)
                            for size, (at, fp) in found.items():
                                lo, hi = np.searchsorted(at, [words.first[r], words.first[r + 1]])
                                for a in at[lo:hi][np.isin(fp[lo:hi], prints)]:
                                    wins[r].append({"s": int(a - words.first[r]), "win": words.text(a, size)})
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), batch.column("rid").slice(first, end - first),
                                                  pa.array(np.diff(words.first)), pa.array(wins, kind)], names=["id", "rid", "n_words", "wins"])
    return run


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """``(id, th, n_words, n_hit, items, spans)`` for each row of ``docs``.

    ``th`` is the hash of the text; ``items`` the sorted ids, as text, of
    items with an occurring window, ``spans`` the maximal runs of hit words
    as (first, end). Null and empty texts have no words; equal rows give
    equal results; a null item id is the item ``null``.
    """
    windows = materialise(item_windows(items, item_id, item_text), "bench-windows")
    # at most WINDOW values
    sizes = sorted(r["len"] for r in windows.select("len").distinct().collect()) or [WINDOW]
    rows = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    prints = rows.mapInArrow(_doc_prints(sizes), f"id {kind}, th long, fp long")
    shared = prints.join(windows.select("fp").distinct(), "fp", "left_semi")
    asked = materialise(shared.groupBy("id", "th").agg(F.collect_set("fp").alias("fps")), "bench-prints")
    asked = asked.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "fps")
    # both sides grow with the corpus: a shuffle at every size
    both = rows.join(asked.hint("merge"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    seen = (both.select("id", F.col("th").alias("rid"), "text", "fps")
            .mapInArrow(_doc_windows(sizes), f"id {kind}, rid long, n_words long, wins array<struct<s:int,win:string>>"))
    seen = materialise(seen.withColumnRenamed("rid", "th").withColumn("rid", F.monotonically_increasing_id()), "bench-seen")
    distinct = windows.groupBy("win", "len").agg(F.collect_set("item").alias("items"))
    hits = (seen.select("rid", F.explode("wins").alias("w")).select("rid", F.col("w.s").alias("s"), F.col("w.win").alias("win"))
            .join(distinct, "win"))
    hits = materialise(hits.select("rid", "s", "len", "items"), "bench-hits")
    # one value for each word hit, so at most a text's words
    marks = hits.select("rid", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("w")).distinct()
    marks = marks.groupBy("rid").agg(F.sort_array(F.collect_list("w")).alias("w"))
    start = F.filter("w", lambda x, i: (i == 0) | (F.get("w", i - 1) != x - 1))
    stop = F.filter("w", lambda x, i: (i == F.size("w") - 1) | (F.get("w", i + 1) != x + 1))
    spans = F.transform(F.arrays_zip(start.alias("a"), stop.alias("b")), lambda x: F.struct(x["a"].alias("first"), (x["b"] + 1).alias("end")))
    marks = marks.select("rid", F.size("w").cast("long").alias("n_hit"), spans.alias("spans"))
    named = hits.select("rid", F.explode("items").alias("item")).distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = seen.select("rid", "id", "th", "n_words").join(marks, "rid", "left").join(named, "rid", "left")
    return out.select("id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """Rows of ``docs`` without a hit."""
    bad = find(docs, items, doc_id, text, item_id, item_text).where("n_hit > 0").select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    keyed = docs.withColumn("__own", F.xxhash64(text_or_empty(text)))
    return keyed.join(bad.hint("merge"), F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")), "left_anti").drop("__own")
