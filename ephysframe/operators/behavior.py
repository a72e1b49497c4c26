"""Behaviour score per session and over time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ephysframe.functions import first_by, parse_id_list, row_mean


#: Cut points between buckets of sessions; a bucket holds about one in so many of a subject's sessions.
CUTS = 256


def _null_safe(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ranked_in_group(rows: DataFrame, group: str, order: str, rank: str, cuts: int = CUTS) -> DataFrame:
    """Distinct ``(group, order, rank)``: the dense rank of ``order`` within ``group`` (nulls are one group; a null order ranks last).

    No window holds a whole group. Cut points are a fixed random choice of the
    order's values (of each of ``cuts`` hash classes the value with the
    smallest second hash), so ranges between them hold about equally many
    values. A window ranks each (group, range), and the sizes of the ranges
    before it, one row a range, are added. A hot group is spread over as many
    tasks as there are ranges.
    """
    pairs = rows.select(F.col(group).alias("_g"), F.col(order).alias("_o")).distinct()
    text = F.col("_o").cast("string")
    picked = (pairs.where(F.col("_o").isNotNull()).groupBy(F.pmod(F.xxhash64(text), F.lit(cuts)))
              .agg(F.min_by("_o", F.struct(F.xxhash64(F.lit("cut"), text), text)).alias("c")))
    points = F.coalesce(picked.select(F.sort_array(F.collect_set("c"))).scalar(), F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>"))
    below = F.size(F.filter("_points", lambda c: c <= F.col("_o")))
    ranged = pairs.withColumn("_points", points).select("_g", "_o", F.when(F.col("_o").isNull(), F.lit(cuts + 1)).otherwise(below).alias("_b"))
    inside = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_b").orderBy(F.asc_nulls_last("_o"))))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(F.col("_g").alias("_g2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = _null_safe("_g", "_g2") & (F.col("_b") == F.col("_b2"))
    return inside.join(sizes, same).select(F.col("_g").alias(group), F.col("_o").alias(order), (F.col("_before") + F.col("_r")).cast("long").alias(rank))


def session_mean_dprime(performance: DataFrame) -> DataFrame:
    """Per session, the mean over blocks of the row mean of the visual
    and auditory intra-modal d-primes (nulls ignored), with the block count.

    ``session_number`` is the dense rank of the session id within its
    subject taken over ALL sessions, before blocks without a score drop.
    ``days_since_first_session`` counts from the subject's first session
    that still has a score.

    Ranks are taken over the distinct (subject, session) pairs in ranges of
    sessions (:func:`ranked_in_group`), and the first day is a grouped minimum
    joined back, so that the sessions without a subject, which form one group,
    never meet in one task.
    """
    blocks = performance.withColumn("mean_dprime", row_mean("vis_intra_dprime", "aud_intra_dprime"))
    numbering = ranked_in_group(blocks, "subject_id", "session_id", "session_number").withColumnsRenamed(
        {"subject_id": "_subject", "session_id": "_session"}
    )
    per_session = (
        blocks.where(F.col("mean_dprime").isNotNull())
        .groupBy("session_id")
        .agg(
            first_by("subject_id", "block_index").alias("subject_id"),
            first_by("date", "block_index").alias("date"),
            F.avg("mean_dprime").alias("mean_dprime"),
            F.count("block_index").alias("num_blocks"),
        )
    )
    first = per_session.groupBy(F.col("subject_id").alias("_who")).agg(F.min("date").alias("_first"))
    return (
        per_session.join(numbering, _null_safe("subject_id", "_subject") & (F.col("session_id") == F.col("_session")))
        .join(first, _null_safe("subject_id", "_who"))
        .withColumn("days_since_first_session", F.datediff("date", "_first").cast("bigint"))
        .select("session_id", "subject_id", "date", "mean_dprime", "num_blocks", "session_number", "days_since_first_session")
        .orderBy("subject_id", "date")
    )


def dprime_over_time(performance: DataFrame, subject_ids: str | Iterable[int] | None = None) -> DataFrame:
    """C27 line-plot data: optionally only the given subjects (``'1, 2 3'``),
    with the date as text."""
    ids = parse_id_list(subject_ids)
    # ranks and first days are per subject, so the subjects are chosen first
    chosen = performance.where(F.col("subject_id").isin(*ids)) if ids else performance
    return session_mean_dprime(chosen).withColumn("date", F.col("date").cast("string"))
