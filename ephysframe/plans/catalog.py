"""Registered queries: one per operator of SURVEY §2B, on the driver tables.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables. Array columns are emitted as sorted, joined strings and
computed doubles are rounded to 6 places so the result compares exactly
with the SQL oracle (``plans/oracle.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ephysframe.operators import behavior, coverage, gates, inventory, qc, status
from ephysframe.operators import tree as T
from ephysframe.operators import volume as V
from ephysframe.plans import roles
from ephysframe.plans.context import Ctx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The area searches a user types into the search box. Each is
# an operator input evaluated over the whole tables, not a row subset.
AREA_PREFIX = "Supplier#0000000"  # starts_with
AREA_REGEX = "#00000001[0-9]$"  # contains (regular expression)
AREA_REGEX_CI = r"^supplier\D0+1[0-9]$"  # contains, case-insensitive
AREA_REGIONS = "AMERICA, ASIA"  # children_of: regions expand to their suppliers in the volume
AREA_NATION = "NATION_18"  # children_of on a nation with labelled suppliers in the volume at every scale
AREA_TWO = "NATION_18, NATION_8"  # a probe must reach both
MISSED = {"filter_implant_location": "small", "filter_probe_letter": "B"}


def query(name: str):
    def deco(fn: Callable[[Ctx], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Ctx(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn

    return deco


def joined(c: str, sep: str = ",") -> F.Column:
    return F.array_join(F.array_sort(F.col(c)), sep)


# ---------------------------------------------------------------- gates ------

@query("qualifying_sessions")
def q_qualifying_sessions(c: Ctx) -> DataFrame:
    """Sessions passing the keyword and d-prime block gate."""
    return c.good_sessions.select("session_id", "subject_id", "date", F.array_join("keywords", "-").alias("keywords"))


GOOD_COLUMNS = [
    "unit_id", "session_id", "subject_id", "date", "electrode_group_name", "implant_location", "location",
    "structure", "is_right_hemisphere", "ccf_ap", "ccf_dv", "ccf_ml", "id", "color_hex_triplet", "color_hex_int",
]


@query("good_units")
def q_good_units(c: Ctx) -> DataFrame:
    """Good units with implant, hemisphere and tree columns."""
    return c.good.select(*GOOD_COLUMNS)


@query("coverage_stats")
def q_coverage_stats(c: Ctx) -> DataFrame:
    """Units, sessions and subjects passing the gates."""
    return gates.coverage_stats(c.good)


@query("coverage_stats_ungated")
def q_coverage_stats_ungated(c: Ctx) -> DataFrame:
    """C1/C2/C12 with the gates switched off."""
    sessions = gates.qualifying_sessions(c.session, c.performance, enabled=False)
    good = gates.good_units(sessions, c.units, c.electrode_groups, c.tree, c.midline, enabled=False)
    return gates.coverage_stats(good)


@query("unit_locations_v1")
def q_unit_locations_v1(c: Ctx) -> DataFrame:
    """Older gate grouped per (session, location)."""
    gate = dict(roles.SESSION_GATE, **roles.UNIT_GATE_V1)
    out = gates.unit_locations_v1(c.session, c.performance, c.units, c.electrode_groups, **gate)
    return out.withColumn("unit_ids", joined("unit_ids"))


@query("coverage_stats_thresholds")
def q_coverage_stats_thresholds(c: Ctx) -> DataFrame:
    """C12 with the thresholds in force beside the counts."""
    same, cross = roles.SESSION_GATE["min_dprime"]
    return gates.coverage_stats(c.good, {"same_modal_dprime": same, "cross_modal_dprime": cross, **roles.UNIT_GATE})


# ------------------------------------------------------------- coverage ------

COUNT_COLUMNS = ["session_id", "location", "location_count", "structure", "subject_id", "date",
                 "implant_location", "electrode_group_name"]


@query("unit_counts")
def q_unit_counts(c: Ctx) -> DataFrame:
    """Per (session, location) unit counts over all good units."""
    return coverage.unit_counts(c.good).select(*COUNT_COLUMNS, joined("unit_ids").alias("unit_ids"))


@query("units_at_location_starts_with")
def q_units_prefix(c: Ctx) -> DataFrame:
    """C5 starts_with, left hemisphere, sorted by date and location."""
    return c.matched(AREA_PREFIX, "starts_with", ordered=True).select(*GOOD_COLUMNS)


@query("units_at_location_contains")
def q_units_regex(c: Ctx) -> DataFrame:
    """C5 contains (regex), both hemispheres."""
    return c.matched(AREA_REGEX, "contains", include_right_hemisphere=True).select(*GOOD_COLUMNS)


@query("units_at_location_case_insensitive")
def q_units_ci(c: Ctx) -> DataFrame:
    """C5 starts_with, case-insensitive: each term is lowered."""
    return c.matched(AREA_PREFIX.lower(), "starts_with", case_sensitive=False).select(*GOOD_COLUMNS)


@query("units_at_location_contains_case_insensitive")
def q_units_regex_ci(c: Ctx) -> DataFrame:
    """C5 contains, case-insensitive: the pattern's own letters (``\\D``) keep their case."""
    return c.matched(AREA_REGEX_CI, "contains", case_sensitive=False).select(*GOOD_COLUMNS)


@query("units_at_location_children_of")
def q_units_children(c: Ctx) -> DataFrame:
    """C5 children_of: exact match on the in-volume descendants of two regions."""
    return c.matched(AREA_REGIONS, "children_of").select(*GOOD_COLUMNS)


@query("units_at_location_any")
def q_units_any(c: Ctx) -> DataFrame:
    """C5 with no term: every left-hemisphere unit with a location."""
    return c.matched("", "starts_with").select(*GOOD_COLUMNS)


@query("location_breakdown")
def q_location_breakdown(c: Ctx) -> DataFrame:
    """Units per subject × location for the prefix search, with totals."""
    return coverage.location_breakdown(coverage.unit_counts(c.matched(AREA_PREFIX)), "subject_id")


@query("location_breakdown_sessions")
def q_location_breakdown_sessions(c: Ctx) -> DataFrame:
    """C8 by session."""
    return coverage.location_breakdown(coverage.unit_counts(c.matched(AREA_PREFIX)), "session_id")


@query("co_recorded_structures")
def q_co_recorded(c: Ctx) -> DataFrame:
    """Top-15 structures co-recorded with the children of NATION_18."""
    return coverage.co_recorded_structures(c.flagged(AREA_NATION, "children_of"), k=15)


@query("location_summary")
def q_location_summary(c: Ctx) -> DataFrame:
    """Per-location table with queried rows first and a row index."""
    return coverage.location_summary(c.good, c.matched(AREA_PREFIX))


@query("implant_value_counts")
def q_implant_value_counts(c: Ctx) -> DataFrame:
    """Implant locations of the older grouping's prefix search."""
    gate = dict(roles.SESSION_GATE, **roles.UNIT_GATE_V1)
    groups = gates.unit_locations_v1(c.session, c.performance, c.units, c.electrode_groups, **gate)
    found = groups.where(F.col("location").startswith(AREA_PREFIX))
    return coverage.implant_value_counts(found)


PROBE_COLUMNS = ["session_id", "electrode_group_name", "implant_location", "ccf_ml", "ccf_ap", "ccf_dv", "location",
                 "structure", "is_right_hemisphere", "color_hex_triplet", "color_hex_int", "color_hex_str"]


def _probe_locs(c: Ctx, area: str, mode: str, **kw) -> DataFrame:
    return coverage.probe_locations(
        c.electrodes, c.electrode_groups, c.matched(area, mode), c.tree, c.midline, area, mode, atlas=c.atlas, **kw
    )


def _probe_out(df: DataFrame) -> DataFrame:
    rgb = [F.round(F.col("color_rgb")[i], 9).alias(f"color_{ch}") for i, ch in enumerate("rgb")]
    return df.select(*PROBE_COLUMNS, *rgb)


@query("probe_locations_children_of")
def q_probe_locations_children(c: Ctx) -> DataFrame:
    """Electrode positions of probes reaching NATION_18's children, at unit positions."""
    return _probe_out(_probe_locs(c, AREA_NATION, "children_of"))


@query("probe_locations_children_of_two")
def q_probe_locations_children_two(c: Ctx) -> DataFrame:
    """Probes that reached children of both nations."""
    return _probe_out(_probe_locs(c, AREA_TWO, "children_of"))


@query("probe_locations_contains_whole_probe")
def q_probe_locations_regex(c: Ctx) -> DataFrame:
    """Whole probes hitting both regex terms, filtered by implant and probe letter."""
    return _probe_out(
        _probe_locs(c, "NATION_1, Supplier#00000001", "contains", whole_probe=True,
                    filter_implant_location="^s", filter_probe_letter="b")
    )


@query("missed_insertions")
def q_missed(c: Ctx) -> DataFrame:
    """Small-implant probe B tracks that never reached NATION_18's children."""
    return _probe_out(_missed(c))


def _missed(c: Ctx) -> DataFrame:
    return coverage.missed_insertions(
        c.electrodes, c.electrode_groups, c.flagged(AREA_NATION, "children_of"), c.tree, c.midline, AREA_NATION, "children_of",
        atlas=c.atlas, **MISSED,
    )


@query("insertion_hit_rate")
def q_hit_rate(c: Ctx) -> DataFrame:
    """C11: per probe × hole hit rate for NATION_18's children."""
    flagged = c.flagged(AREA_NATION, "children_of")
    probes = coverage.probe_keys(
        c.electrodes, c.electrode_groups, flagged.where("in_area"), c.tree, c.midline, AREA_NATION, "children_of", atlas=c.atlas
    )
    out = coverage.insertion_hit_rate(flagged, probes)
    return out.orderBy(F.desc("total_hits_this_implant"), F.desc("hits"), F.desc("rate"))


@query("overlay_regions")
def q_overlay(c: Ctx) -> DataFrame:
    """C20: areas drawn over the atlas for the NATION_18 search."""
    return coverage.overlay_regions(c.matched(AREA_NATION, "children_of"), AREA_NATION)


@query("overlay_regions_single")
def q_overlay_single(c: Ctx) -> DataFrame:
    """C20 with exactly one matched location: the location itself."""
    area = "Supplier#000000011"
    return coverage.overlay_regions(c.matched(area, "starts_with", include_right_hemisphere=True), area)


@query("pick_structure")
def q_pick_structure(c: Ctx) -> DataFrame:
    """Seeded pick of one left-hemisphere structure."""
    return coverage.pick_structure(c.good, seed=7)


# ------------------------------------------------------------ behaviour ------

@query("session_mean_dprime")
def q_session_mean_dprime(c: Ctx) -> DataFrame:
    """Per-session mean d-prime, session number and days since first."""
    out = behavior.session_mean_dprime(roles.dprime_blocks(c.spark, c.d))
    return out.withColumn("mean_dprime", F.round("mean_dprime", 6))


@query("dprime_over_time")
def q_dprime_over_time(c: Ctx) -> DataFrame:
    """C27 over time for a typed list of subject ids."""
    out = behavior.dprime_over_time(roles.dprime_blocks(c.spark, c.d), "1, 2 3  4,17")
    return out.withColumn("mean_dprime", F.round("mean_dprime", 6))


# ---------------------------------------------------------- tree, volume ------

@query("structure_tree")
def q_structure_tree(c: Ctx) -> DataFrame:
    """The tree with its derived colour columns."""
    return c.tree.select(
        "id", "acronym", "parent_structure_id", "depth", "structure_id_path", "color_hex_triplet", "color_hex_int",
        "color_hex_str", *[F.round(F.col("color_rgb")[i], 9).alias(f"color_{ch}") for i, ch in enumerate("rgb")],
    )


@query("frontier_descendants")
def q_frontier(c: Ctx) -> DataFrame:
    """C4: for every node, itself or its nearest descendants labelled in the volume."""
    return T.frontier_descendants(c.tree, c.atlas.volume_ids, c.tree.select(F.col("id").alias("root_id")))


@query("immediate_children")
def q_immediate_children(c: Ctx) -> DataFrame:
    """C4 (one level): direct children of every node."""
    return T.immediate_children(c.tree, c.tree.select(F.col("id").alias("root_id")))


@query("acronym_lookup")
def q_acronym_lookup(c: Ctx) -> DataFrame:
    """C14: acronym → id for every structure named by a unit."""
    keys = c.units.where(F.col("structure").isNotNull()).select(F.col("structure").alias("acronym")).distinct()
    return T.acronyms_to_ids(c.tree, keys)


@query("id_lookup")
def q_id_lookup(c: Ctx) -> DataFrame:
    """C14: id → acronym for every label present in the volume."""
    keys = c.voxels.select(F.col("structure_id").alias("id")).distinct()
    return T.ids_to_acronyms(c.tree, keys)


@query("structure_info")
def q_structure_info(c: Ctx) -> DataFrame:
    """C14: full tree row of each region, looked up by acronym."""
    keys = roles.table(c.spark, c.d, "region").select(F.col("r_name").alias("acronym"))
    return T.structure_info(c.tree, keys).select(
        "id", "acronym", "name", "safe_name", "parent_structure_id", "depth", "structure_id_path",
        "color_hex_triplet", "color_hex_int", "color_hex_str",
    )


@query("volume_acronyms")
def q_volume_acronyms(c: Ctx) -> DataFrame:
    """Acronyms of the labels in the left hemisphere of the volume."""
    return T.volume_acronyms(c.tree, c.atlas.volume_ids)


@query("volume_hemispheres")
def q_volume_hemispheres(c: Ctx) -> DataFrame:
    """Midline and voxel count per side."""
    n_ml = roles.SHAPE["ml"]
    left = V.hemisphere(c.voxels, "left", n_ml).select(F.lit("left").alias("side"))
    right = V.hemisphere(c.voxels, "right", n_ml).select(F.lit("right").alias("side"))
    per = left.unionByName(right).groupBy().agg(
        F.count_if(F.col("side") == "left").alias("left_voxels"), F.count_if(F.col("side") == "right").alias("right_voxels")
    )
    return per.select(F.lit(n_ml).alias("n_ml"), c.midline.alias("midline_um"), "left_voxels", "right_voxels")


def _mask(c: Ctx, area: str | None, side: str = "left") -> DataFrame:
    n_ml = roles.SHAPE["ml"]
    if not area:
        return V.region_mask(c.voxels, side=side, n_ml=n_ml)
    ids = c.atlas.children_acronyms([area]).join(c.tree.select("id", "acronym"), "acronym").select("id")
    return V.region_mask(c.voxels, ids, side=side, n_ml=n_ml)


@query("region_mask_right")
def q_region_mask_right(c: Ctx) -> DataFrame:
    """C17: right-hemisphere voxels of EUROPE's in-volume descendants."""
    return _mask(c, "EUROPE", "right")


@query("projection_sagittal")
def q_projection_sagittal(c: Ctx) -> DataFrame:
    """Sagittal projection of the left half of the volume, from running counts."""
    half = roles.SHAPE["ml"] // 2
    img = V.project_counts(V.running_counts(_mask(c, None), "sagittal", depth_size=half), depth_size=half)
    return _round_image(img)


@query("region_mask")
def q_region_mask(c: Ctx) -> DataFrame:
    """C17: left-hemisphere voxels of EUROPE's in-volume descendants."""
    return _mask(c, "EUROPE")


def _area_rgb(c: Ctx, area: str):
    """The area's colour as one scalar subquery (the array), indexed three
    times: identical subqueries are computed once and reused."""
    rgb = c.tree.where(F.col("acronym") == area).select(F.min("color_rgb")).scalar()
    return tuple(rgb[i] for i in range(3))


def _round_image(df: DataFrame) -> DataFrame:
    return df.select("y", "x", *[F.round(ch, 9).alias(ch) for ch in ("r", "g", "b", "a")])


@query("projection_area")
def q_projection_area(c: Ctx) -> DataFrame:
    """Horizontal projection of EUROPE, coloured, alpha by density."""
    img = V.project(_mask(c, "EUROPE"), "horizontal", depth_size=roles.SHAPE["dv"], rgb=_area_rgb(c, "EUROPE"))
    return _round_image(img)


@query("projection_slab")
def q_projection_slab(c: Ctx) -> DataFrame:
    """Coronal projection of the whole left volume through a 10-plane
    slab, grey, 0/1 alpha, 0..255 colour, from running counts."""
    n = roles.SHAPE["ap"]
    img = V.project_counts(V.running_counts(_mask(c, None), "coronal", depth_size=n), depth_size=n, thickness=10,
                           with_opacity=False, normalize_rgb=False)
    return _round_image(img)


@query("scatter_density")
def q_scatter_density(c: Ctx) -> DataFrame:
    """Horizontal density image of the prefix-matched units."""
    img = V.scatter_density(c.matched(AREA_PREFIX), "horizontal", volume_shape=roles.SHAPE, opacity_range=(0.7, 1.0))
    return _round_image(img)


# --------------------------------------------------------------- boards ------

@query("find_sessions")
def q_find_sessions(c: Ctx) -> DataFrame:
    """Sessions of typed subjects within a date range."""
    return status.find_sessions(roles.board_sessions(c.spark, c.d), "7, 13 x, abc, 1001", None, "1996-01-01", "1998-12-31")


@query("find_sessions_on_date")
def q_find_sessions_on_date(c: Ctx) -> DataFrame:
    """One date wins over a range."""
    subjects = ", ".join(map(str, range(1, 200)))
    return status.find_sessions(roles.board_sessions(c.spark, c.d), subjects, "1997-07-10", "1996-01-01", "1996-12-31")


@query("sorting_status")
def q_sorting_status(c: Ctx) -> DataFrame:
    """Sorting board over every ecephys session."""
    sessions = roles.board_sessions(c.spark, c.d).where(F.col("platform") == "ecephys")
    out = status.sorting_status(sessions, roles.assets(c.spark, c.d), roles.computations(c.spark, c.d))
    return out.withColumns({"complete_probe_data": joined("complete_probe_data"), "jobs_running": joined("jobs_running")})


@query("already_triggered")
def q_already_triggered(c: Ctx) -> DataFrame:
    """Raw assets with a running trigger job."""
    return status.already_triggered(roles.computations(c.spark, c.d))


def _upload(c: Ctx, **kw) -> DataFrame:
    folders = status.recording_folders(roles.folders(c.spark, c.d))
    return status.upload_status(folders, roles.manifests(c.spark, c.d), roles.uploaded(c.spark, c.d), **kw)


@query("upload_status")
def q_upload_status(c: Ctx) -> DataFrame:
    """Upload board over every folder."""
    return _upload(c)


@query("upload_status_unstarted")
def q_upload_unstarted(c: Ctx) -> DataFrame:
    """C24 with the ephys-only and unstarted-only switches."""
    return _upload(c, ephys_only=True, unstarted_only=True)


@query("inventory_apply")
def q_inventory_apply(c: Ctx) -> DataFrame:
    """Probe inventory after applying a change batch by serial number."""
    return inventory.inventory_apply(
        roles.probes_current(c.spark, c.d), roles.probe_changes(c.spark, c.d), ["changed_at", "event_id"]
    )


@query("qc_manifest")
def q_qc_manifest(c: Ctx) -> DataFrame:
    """QC files matched to sessions by name prefix, classified."""
    return qc.qc_manifest(roles.qc_files(c.spark, c.d), roles.qc_sessions(c.spark, c.d))


@query("column_filters")
def q_column_filters(c: Ctx) -> DataFrame:
    """Like / > / three-state bool filters on the good-unit table."""
    spec = {
        "location": ("like", "#00000002"),
        "ccf_ap": (">", 100.0),
        "is_right_hemisphere": ("bool", False),
        "structure": ("like", "NATION"),
        "electrode_group_name": ("bool", None),  # three-state switch left open: no filter
    }
    return status.column_filters(c.good, spec).select(*GOOD_COLUMNS)


@query("column_filters_below")
def q_column_filters_below(c: Ctx) -> DataFrame:
    """The < filter."""
    return status.column_filters(c.good, {"ccf_ap": ("<", 500.0), "location": ("like", "9")}).select(*GOOD_COLUMNS)


@query("session_table")
def q_session_table(c: Ctx) -> DataFrame:
    """Every session, id descending."""
    return status.session_table(roles.qc_sessions(c.spark, c.d))


# ------------------------------------------------------- small surfaces ------

@query("location_legend")
def q_location_legend(c: Ctx) -> DataFrame:
    """Legend order of the prefix breakdown."""
    return coverage.location_legend(coverage.unit_counts(c.matched(AREA_PREFIX)))


@query("session_sketches")
def q_session_sketches(c: Ctx) -> DataFrame:
    """Sketches of the good units' sessions by location, implant and probe, merged by probe and for two filters:
    the exact counts, and whether the estimates lie within 6 % (about four standard errors) and 1 of them."""
    rows = c.good.select("session_id", "location", "implant_location", "electrode_group_name")
    sketches = coverage.session_sketches(rows)
    keyed = lambda df, name: df.withColumn("part", name)
    parts = [(F.col("electrode_group_name"), None), (F.lit("small implants"), F.col("implant_location").contains("small")),
             (F.lit("prefix"), F.col("location").startswith(AREA_PREFIX))]
    exact = approx = None
    for name, keep in parts:
        e, a = (keyed(x if keep is None else x.where(keep), name) for x in (rows, sketches))
        exact, approx = (e, a) if exact is None else (exact.unionByName(e), approx.unionByName(a))
    exact = exact.groupBy("part").agg(F.count_distinct("session_id").alias("exact_sessions"))
    near = F.abs(F.col("approx_sessions") - F.col("exact_sessions")) <= 0.06 * F.col("exact_sessions") + 1
    return exact.join(coverage.approx_sessions(approx, "part"), "part").select("part", "exact_sessions", near.alias("in_range"))


@query("approx_location_stats")
def q_approx_location_stats(c: Ctx) -> DataFrame:
    """Approximate distinct sessions/locations of NATION_18's probe tracks:
    the exact counts, and whether the estimates lie within three of their
    standard errors (5 %)."""
    stats = coverage.approx_location_stats(_probe_locs(c, AREA_NATION, "children_of"))
    near = lambda k: F.abs(F.col(f"approx_{k}") - F.col(f"exact_{k}")) <= 0.15 * F.col(f"exact_{k}") + 1
    return stats.select("exact_sessions", "exact_locations", near("sessions").alias("sessions_in_range"), near("locations").alias("locations_in_range"))


@query("inventory_table")
def q_inventory_table(c: Ctx) -> DataFrame:
    """The merged inventory with dates as text."""
    merged = inventory.inventory_apply(
        roles.probes_current(c.spark, c.d), roles.probe_changes(c.spark, c.d), ["changed_at", "event_id"]
    )
    return inventory.as_text_dates(merged)


@query("sorting_status_compact")
def q_sorting_compact(c: Ctx) -> DataFrame:
    """P10: the sorting board with its id columns hidden."""
    sessions = roles.board_sessions(c.spark, c.d).where(F.col("platform") == "ecephys")
    out = status.sorting_status(sessions, roles.assets(c.spark, c.d), roles.computations(c.spark, c.d))
    out = status.hide_columns(out, ["subject", "raw_asset", "latest_sorted_asset", "detail"])
    return out.withColumns({"complete_probe_data": joined("complete_probe_data"), "jobs_running": joined("jobs_running")})


@query("scatter_missed_insertions")
def q_scatter_missed(c: Ctx) -> DataFrame:
    """C19 × C7: coronal density image of the missed insertions, drawn black."""
    img = V.scatter_density(_missed(c), "coronal", volume_shape=roles.SHAPE, opacity_range=(0.7, 1.0), rgb=(0.0, 0.0, 0.0))
    return _round_image(img)
