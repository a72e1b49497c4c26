"""Quality gates: which sessions and units count as "good" (C1, C2, C12, C29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ephysframe.functions import all_of, first_by, list_lacks, n_unique

# The dashboards' default thresholds.
DPRIME_THRESHOLD = 1.0
MIN_PASSING_BLOCKS = 3  # a session needs MORE than this many passing blocks
ISI_VIOLATIONS_RATIO_THRESHOLD = 0.5
AMPLITUDE_CUTOFF_THRESHOLD = 0.1
PRESENCE_RATIO_THRESHOLD = 0.95
EXCLUDED_KEYWORD = "templeton"


def _pair(v: float | tuple[float, float]) -> tuple[float, float]:
    return (v, v) if isinstance(v, (int, float)) else (float(v[0]), float(v[1]))


def passing_sessions(
    performance: DataFrame,
    *,
    min_dprime: float | tuple[float, float] = DPRIME_THRESHOLD,
    min_blocks: int = MIN_PASSING_BLOCKS,
) -> DataFrame:
    """Session ids with more than ``min_blocks`` blocks where both the
    same-modal and cross-modal d-prime exceed the threshold.

    The filter sits under the aggregate so it reaches the scan; the count is
    a partial (map-side) aggregate, so only one row per session and map
    task crosses the shuffle.
    """
    same_t, cross_t = _pair(min_dprime)
    return (
        performance.where(all_of([F.col("same_modal_dprime") > same_t, F.col("cross_modal_dprime") > cross_t]))
        .groupBy("session_id")
        .agg(F.count("block_index").alias("passing_blocks"))
        .where(F.col("passing_blocks") > min_blocks)
        .select("session_id")
    )


def qualifying_sessions(
    session: DataFrame,
    performance: DataFrame,
    *,
    exclude_keyword: str = EXCLUDED_KEYWORD,
    min_dprime: float | tuple[float, float] = DPRIME_THRESHOLD,
    min_blocks: int = MIN_PASSING_BLOCKS,
    enabled: bool = True,
) -> DataFrame:
    """Sessions without the excluded keyword that pass the behaviour gate.

    With ``enabled=False`` every session that has any performance row is kept.
    """
    if not enabled:
        return session.join(performance.select("session_id"), "session_id", "left_semi")
    passing = passing_sessions(performance, min_dprime=min_dprime, min_blocks=min_blocks)
    return session.where(list_lacks("keywords", exclude_keyword)).join(passing, "session_id", "left_semi")


def unit_quality_predicates(
    *,
    max_isi: float = ISI_VIOLATIONS_RATIO_THRESHOLD,
    max_amp_cutoff: float = AMPLITUDE_CUTOFF_THRESHOLD,
    min_presence: float = PRESENCE_RATIO_THRESHOLD,
    isi_column: str = "isi_violations_ratio",
) -> list[Column]:
    return [
        F.col(isi_column) < max_isi,
        F.col("amplitude_cutoff") < max_amp_cutoff,
        F.col("presence_ratio") > min_presence,
    ]


def good_units(
    sessions: DataFrame,
    units: DataFrame,
    electrode_groups: DataFrame,
    tree: DataFrame,
    midline: float | Column,
    *,
    max_isi: float = ISI_VIOLATIONS_RATIO_THRESHOLD,
    max_amp_cutoff: float = AMPLITUDE_CUTOFF_THRESHOLD,
    min_presence: float = PRESENCE_RATIO_THRESHOLD,
    enabled: bool = True,
) -> DataFrame:
    """Units of the given sessions that pass the three quality thresholds.

    Adds ``implant_location`` (from the electrode group), the hemisphere flag
    (strictly right of the midline) and every structure-tree column of the
    unit's location. Units whose location is not a tree acronym drop out.

    ``midline`` may be a number or a scalar-subquery column (see
    ``operators.volume.midline``), evaluated once per query.
    """
    u = units
    if enabled:
        u = u.where(all_of(unit_quality_predicates(max_isi=max_isi, max_amp_cutoff=max_amp_cutoff, min_presence=min_presence)))
    groups = electrode_groups.select(
        "session_id",
        F.col("name").alias("electrode_group_name"),
        F.col("location").alias("implant_location"),
    )
    midline_col = midline if isinstance(midline, Column) else F.lit(float(midline))
    return (
        sessions.join(u, "session_id")
        .join(groups, ["session_id", "electrode_group_name"])
        .withColumn("is_right_hemisphere", F.col("ccf_ml") > midline_col)
        .join(tree.withColumnRenamed("acronym", "location"), "location")
    )


def coverage_stats(units: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row with the number of units, sessions and subjects.

    Sessions and subjects count null as a value, as a set of values does.
    Thresholds in force, if given, are added as literal columns.
    """
    out = units.agg(
        F.count(F.lit(1)).alias("units"),
        n_unique("session_id").alias("sessions"),
        n_unique("subject_id").alias("subjects"),
    )
    for name, value in (thresholds or {}).items():
        out = out.withColumn(name, F.lit(value))
    return out


def unit_locations_v1(
    session: DataFrame,
    performance: DataFrame,
    units: DataFrame,
    electrode_groups: DataFrame,
    *,
    exclude_keyword: str = EXCLUDED_KEYWORD,
    min_dprime: float | tuple[float, float] = DPRIME_THRESHOLD,
    min_blocks: int = MIN_PASSING_BLOCKS,
    max_isi_count: float = ISI_VIOLATIONS_RATIO_THRESHOLD,
    max_amp_cutoff: float = AMPLITUDE_CUTOFF_THRESHOLD,
    min_presence: float = PRESENCE_RATIO_THRESHOLD,
) -> DataFrame:
    """The older gate and grouping.

    ``unit_ids`` lists the ids of the group, in order: its length is bounded
    by the units of one session in one structure.

    Differences from C1-C3: the ISI gate reads ``isi_violations_count``, no
    tree join and no hemisphere flag, and the per-group columns omit the
    probe name.
    """
    sessions = qualifying_sessions(
        session, performance, exclude_keyword=exclude_keyword, min_dprime=min_dprime, min_blocks=min_blocks
    )
    u = units.where(
        all_of(
            unit_quality_predicates(
                max_isi=max_isi_count, max_amp_cutoff=max_amp_cutoff, min_presence=min_presence,
                isi_column="isi_violations_count",
            )
        )
    )
    groups = electrode_groups.select(
        "session_id", F.col("name").alias("electrode_group_name"), F.col("location").alias("implant_location")
    )
    joined = sessions.join(u, "session_id").join(groups, ["session_id", "electrode_group_name"])
    order = ("unit_id", "electrode_group_name")
    aggs = [
        F.count("location").alias("location_count"),
        first_by("structure", *order).alias("structure"),
        first_by("subject_id", *order).alias("subject_id"),
        first_by("date", *order).alias("date"),
        first_by("implant_location", *order).alias("implant_location"),
        F.array_sort(F.collect_list("unit_id")).alias("unit_ids"),
    ]
    return joined.groupBy("session_id", "location").agg(*aggs)
