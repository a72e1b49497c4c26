"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its
share of the input. Each document inverts the Poisson distribution of that
mean at a number drawn from a hash of the seed and its id, is exploded by the
count, and the copies are sorted by a hash: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_string, materialise, text_or_empty, unit_draw

#: A Poisson mean above this is drawn as a sum of equal parts, each at most so large.
PART = 16.0
#: Terms of a part's cumulative distribution: 12 deviations and 20 beyond the mean, far below double precision.
TERMS = 84


def rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0, source: str = "source", text: str = "text",
          unit: str = "bytes", total_ratio: float = 1.0) -> DataFrame:
    """``(source, lam, parts, cdf)`` for each source: mean repetitions so that shares of ``unit`` meet the weights.

    Sources missing from ``weights`` get ``default``; a null source is a
    source of its own. ``total_ratio`` is the output's size over the input's.
    A source of no bytes repeats 0 times.
    """
    size = F.octet_length(text_or_empty(text)).cast("long") if unit == "bytes" else F.lit(1).cast("long")
    src = F.coalesce(F.col(source).cast("string"), F.lit(""))
    per = docs.select(src.alias("__source"), size.alias("__size")).groupBy("__source").agg(F.sum("__size").alias("__size"))
    listed = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
    weight = F.coalesce(F.element_at(F.create_map(*listed), F.col("__source")), F.lit(float(default))) if listed else F.lit(float(default))
    per = materialise(per.withColumn("__weight", weight), "mix-sizes")
    whole = per.agg(F.sum("__weight").alias("w"), F.sum("__size").cast("double").alias("n")).first()
    w, n = float(whole["w"] or 1.0), float(whole["n"] or 0.0)
    lam = F.when(F.col("__size") > 0, F.col("__weight") / F.lit(w) * F.lit(n * total_ratio) / F.col("__size")).otherwise(F.lit(0.0))
    out = per.withColumn("lam", lam).withColumn("parts", F.greatest(F.ceil(F.col("lam") / PART), F.lit(1)).cast("int"))
    mean = F.col("lam") / F.col("parts")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, lambda acc, j: F.struct(
        (acc["p"] * mean / j).alias("p"),
        F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / j)).alias("c")), lambda acc: acc["c"])
    return out.select("__source", "lam", "parts", cdf.alias("cdf"))


def copies(draws_key: Column, parts: Column, cdf: Column, seed: str) -> Column:
    """Inverse Poisson: for each part, how many steps of the distribution lie at or below the draw."""
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + F.size(F.filter(
        cdf, lambda c: c <= unit_draw(F.lit(seed), draws_key, i.cast("string")))))


def mix(docs: DataFrame, weights: dict[str, float], default: float = 1.0, doc_id: str = "doc_id", source: str = "source",
        text: str = "text", unit: str = "bytes", total_ratio: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` repeated to the target weights in a global hash order, with ``copy`` (from 1) and ``n_copies``.

    Rows of equal id draw alike; a null id draws as one id. Columns of these
    two names in ``docs`` are replaced.
    """
    table = rates(docs, weights, default, source, text, unit, total_ratio)
    table = materialise(table.select("__source", F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf")), "mix-rates")
    key = id_string(doc_id)
    rows = docs.drop("copy", "n_copies").withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    # the rates' size is known from their file: broadcast while small, else joined by a shuffle whose hot keys AQE splits
    drawn = rows.join(table, "__source").withColumn("n_copies", copies(key, F.col("__parts"), F.col("__cdf"), seed))
    drawn = drawn.drop("__source", "__parts", "__cdf").where("n_copies > 0")
    repeated = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), key, F.col("copy").cast("string")))
    return repeated.withColumn("__order", order).orderBy("__order").drop("__order")
