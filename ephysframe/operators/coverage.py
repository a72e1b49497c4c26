"""Area coverage: which brain areas were recorded, by which probe, from
which implant hole (C3, C5-C11, C20, C30, C32).

Inputs are the good-unit table of ``gates.good_units`` and the electrode,
electrode-group and tree tables. All list round trips of the dashboards
(collect a group, filter, explode back) are written as semi/anti joins and
flags. The one list kept is the result's own: the unit ids of a session in
one structure.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ephysframe.functions import (
    all_of, any_of, first_by, format_probe_name, match_term, n_unique, replace_first,
    round_half_up_ratio, split_part, split_terms,
)
from ephysframe.operators.tree import acronyms_to_ids, frontier_descendants

# Mode names of the area search.
MODES = ("starts_with", "contains", "children_of")


@dataclass
class Atlas:
    """Tree plus the labels present in the volume, for ``children_of`` searches."""

    tree: DataFrame
    volume_ids: DataFrame  # column ``id``

    def children_acronyms(self, terms: list[str]) -> DataFrame:
        """(term_idx, acronym): frontier descendants in the volume of each term."""
        spark = self.tree.sparkSession
        # the user's search terms: a handful of strings typed into a box
        roots = spark.createDataFrame(list(enumerate(terms)), "term_idx int, acronym string")
        root_ids = acronyms_to_ids(self.tree, roots).select("term_idx", F.col("id").alias("root_id"))
        desc = frontier_descendants(self.tree, self.volume_ids, root_ids.select("root_id").distinct())
        names = self.tree.select("id", "acronym")
        return root_ids.join(desc, "root_id").join(names, "id").select("term_idx", "acronym")


def unit_counts(units: DataFrame) -> DataFrame:
    """Per (session, location): unit count, the first structure /
    subject / date / implant / probe (first by unit id) and the sorted list
    of unit ids, bounded by the units of one session in one structure.
    """
    order = ("unit_id", "electrode_group_name")
    aggs = [
        F.count("location").alias("location_count"),
        first_by("structure", *order).alias("structure"),
        first_by("subject_id", *order).alias("subject_id"),
        first_by("date", *order).alias("date"),
        first_by("implant_location", *order).alias("implant_location"),
        first_by("electrode_group_name", *order).alias("electrode_group_name"),
        F.array_sort(F.collect_list("unit_id")).alias("unit_ids"),
    ]
    return units.groupBy("session_id", "location").agg(*aggs)


def _hemisphere_filter(df: DataFrame, include_right_hemisphere: bool) -> DataFrame:
    return df if include_right_hemisphere else df.where(F.col("is_right_hemisphere") == F.lit(False))


def units_at_location(
    good: DataFrame,
    filter_area: str | None,
    filter_type: str = "starts_with",
    *,
    case_sensitive: bool = True,
    include_right_hemisphere: bool = False,
    atlas: Atlas | None = None,
    ordered: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Units whose location matches any of the comma separated terms.

    ``starts_with`` is literal, ``contains`` a regular expression,
    ``children_of`` an exact, case-sensitive match on the frontier
    descendants of each term (a semi-join against the tree). No term keeps
    every unit with a location. Left hemisphere only unless asked.
    A ``children_of`` search that expands to nothing fails when it runs,
    unless ``strict`` is off.
    """
    if filter_type not in MODES:
        raise ValueError(f"filter_type must be one of {MODES}")
    units = _hemisphere_filter(good, include_right_hemisphere)
    terms = split_terms(filter_area)
    if not terms:
        out = units.where(F.col("location").isNotNull())
    elif filter_type == "children_of":
        out = units.join(_children(atlas, terms, filter_area, strict), "location", "left_semi")
    else:
        out = units.where(_label_matches(F.col("location"), terms, filter_type, case_sensitive))
    return out.orderBy("date", "location") if ordered else out


def flag_at_location(
    good: DataFrame,
    filter_area: str | None,
    filter_type: str = "starts_with",
    *,
    case_sensitive: bool = True,
    include_right_hemisphere: bool = False,
    atlas: Atlas | None = None,
    strict: bool = True,
) -> DataFrame:
    """``good`` with a flag ``in_area``: would :func:`units_at_location` keep
    the row? One pass where a caller needs the matched units and the others."""
    terms = split_terms(filter_area)
    side = F.lit(True) if include_right_hemisphere else F.coalesce(~F.col("is_right_hemisphere"), F.lit(False))
    if not terms:
        return good.withColumn("in_area", side & F.col("location").isNotNull())
    if filter_type == "children_of":
        acr = _children(atlas, terms, filter_area, strict).withColumn("_child", F.lit(True))
        return good.join(acr, "location", "left").withColumn("in_area", side & F.coalesce("_child", F.lit(False))).drop("_child")
    label = _label_matches(F.col("location"), terms, filter_type, case_sensitive)
    return good.withColumn("in_area", side & F.coalesce(label, F.lit(False)))


def _label_matches(loc: Column, terms: list[str], filter_type: str, case_sensitive: bool) -> Column:
    if case_sensitive:
        return any_of(match_term(loc, t, filter_type) for t in terms)
    if filter_type == "contains":  # the pattern itself must not be lowered: \\D is not \\d
        return any_of(loc.rlike("(?i)" + t) for t in terms)
    return any_of(match_term(F.lower(loc), t.lower(), filter_type) for t in terms)


def _children(atlas: Atlas | None, terms: list[str], filter_area: str | None, strict: bool) -> DataFrame:
    """The acronyms (column ``location``) of a ``children_of`` search."""
    if atlas is None:
        raise ValueError("children_of needs an Atlas")
    acr = atlas.children_acronyms(terms).select(F.col("acronym").alias("location")).distinct()
    if not strict:
        return acr
    # an aggregate always has a row, so an empty set is seen when the query runs
    seen = acr.agg(F.count(F.lit(1)).alias("_n"))
    failure = F.raise_error(F.lit(f"area search {filter_area!r} matches nothing in the volume")).cast("string")
    guard = seen.where(F.col("_n") == 0).select(failure.alias("location"))
    return acr.unionByName(guard)


def contains_any(values: DataFrame, needles: DataFrame) -> DataFrame:
    """(term_idx, value) for each distinct ``value`` containing some ``needle``
    of that term as a literal substring.

    Exact and join-based: the substrings of each distinct value that are as
    long as some needle are exploded and equi-joined with the needles, so
    there is no nested-loop join and a value gives at most its length times
    the number of distinct needle lengths.
    """
    lengths = needles.where(F.length("acronym") > 0).select(F.collect_set(F.length("acronym"))).scalar()
    sized = values.select("value", F.explode(lengths).alias("_n")).where(F.col("_n") <= F.length("value"))
    starts = F.sequence(F.lit(1), F.length("value") - F.col("_n") + 1)
    pieces = F.transform(starts, lambda i: F.substr(F.col("value"), i, F.col("_n")))
    subs = sized.select("value", F.explode(pieces).alias("needle")).distinct()
    return subs.join(needles.select("term_idx", F.col("acronym").alias("needle")), "needle").select("term_idx", "value").distinct()


def _sites(electrodes: DataFrame, midline: float | Column, include_right_hemisphere: bool, probe_letter: str | None) -> DataFrame:
    """Electrodes of the hemisphere and of the probe letter, if one is given."""
    e = electrodes.select(
        "session_id",
        F.col("group_name").alias("electrode_group_name"),
        F.col("x").alias("ccf_ap"),
        F.col("y").alias("ccf_dv"),
        F.col("z").alias("ccf_ml"),
        "location",
        "structure",
    )
    midline_col = midline if isinstance(midline, Column) else F.lit(float(midline))
    e = _hemisphere_filter(e.withColumn("is_right_hemisphere", F.col("ccf_ml") > midline_col), include_right_hemisphere)
    return e.where(all_of(_insertion_filters(None, probe_letter)))


def _probe_tracks(sites: DataFrame, electrode_groups: DataFrame, implant: str | None, probe_letter: str | None) -> DataFrame:
    """Electrodes with their insertion's implant location; the insertion filters come first."""
    groups = electrode_groups.select(
        "session_id", F.col("name").alias("electrode_group_name"), F.col("location").alias("implant_location")
    ).where(all_of(_insertion_filters(implant, probe_letter)))
    return sites.join(groups, PROBE_KEY)


def _reached(sites: DataFrame, filter_area: str | None, filter_type: str, atlas: Atlas | None) -> DataFrame:
    """Probes (session, electrode group) of which, for EVERY term, some electrode's label matches.

    The terms are matched with the distinct pairs of labels, which are few and
    shared by many electrodes, so only electrodes with a matching label are
    gathered by probe, a flag a term.
    """
    terms = split_terms(filter_area)
    pair = ["location", "structure"]
    labelled = sites.select(*pair).distinct().select(*pair, F.explode(F.array(*pair)).alias("value")).where(F.col("value").isNotNull())
    if filter_type == "children_of":
        if atlas is None:
            raise ValueError("children_of needs an Atlas")
        hits = contains_any(labelled.select("value").distinct(), atlas.children_acronyms(terms))
        labelled = labelled.join(hits, "value")
    else:
        found = F.array(*[F.when(F.col("value").rlike(t), F.lit(i)) for i, t in enumerate(terms)])
        labelled = labelled.select(*pair, F.explode(F.filter(found, lambda i: i.isNotNull())).alias("term_idx"))
    flags = [f"_term{i}" for i in range(len(terms))]
    matched = labelled.groupBy(*pair).agg(*[F.bool_or(F.col("term_idx") == i).alias(f) for i, f in enumerate(flags)])
    s, m = sites.alias("s"), matched.alias("m")
    at_label = s.join(m, all_of([F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in pair]))
    return (
        at_label.groupBy(*[F.col(f"s.{c}") for c in PROBE_KEY])
        .agg(*[F.bool_or(f"m.{f}").alias(f) for f in flags])
        .where(all_of([F.col(f) for f in flags]))
        .select(*PROBE_KEY)
    )


PROBE_KEY = ["session_id", "electrode_group_name"]
POSITION = ["ccf_ap", "ccf_dv", "ccf_ml"]


def _inside(df: DataFrame) -> DataFrame:
    return df.where(all_of([F.col(p) > -1 for p in POSITION]))


def probe_locations(
    electrodes: DataFrame,
    electrode_groups: DataFrame,
    matched_units: DataFrame,
    tree: DataFrame,
    midline: float | Column,
    filter_area: str | None,
    filter_type: str = "starts_with",
    *,
    include_right_hemisphere: bool = False,
    filter_implant_location: str | None = None,
    filter_probe_letter: str | None = None,
    whole_probe: bool = False,
    atlas: Atlas | None = None,
) -> DataFrame:
    """Electrode positions of probes that reached the area.

    A probe (session, electrode group) is kept when, for EVERY term, one of
    its electrodes has a structure or location matching it (regex contains;
    for ``children_of``, containing any child acronym as a substring). The
    case flag does not apply here. Kept electrodes must then coincide with a
    matched unit: same probe, and same position unless ``whole_probe``.
    """
    sites = _sites(electrodes, midline, include_right_hemisphere, filter_probe_letter)
    e = _probe_tracks(sites, electrode_groups, filter_implant_location, filter_probe_letter)
    if split_terms(filter_area):
        e = e.join(_reached(sites, filter_area, filter_type, atlas), PROBE_KEY, "left_semi")
    join_on = PROBE_KEY + ([] if whole_probe else POSITION)
    e = _inside(e.join(matched_units.select(*join_on), join_on, "left_semi"))
    return _coloured(e, tree)


def _coloured(tracks: DataFrame, tree: DataFrame) -> DataFrame:
    columns = [*PROBE_KEY, "implant_location", "ccf_ml", "ccf_ap", "ccf_dv", "location", "structure", "is_right_hemisphere"]
    colours = tree.select(F.col("acronym").alias("location"), *[c for c in tree.columns if c.startswith("color_")])
    return tracks.select(*columns).join(colours, "location")


def probe_keys(
    electrodes: DataFrame,
    electrode_groups: DataFrame,
    matched_units: DataFrame,
    tree: DataFrame,
    midline: float | Column,
    filter_area: str | None,
    filter_type: str = "starts_with",
    *,
    include_right_hemisphere: bool = False,
    atlas: Atlas | None = None,
) -> DataFrame:
    """C6 without positions: the distinct probes with a row in :func:`probe_locations`."""
    sites = _sites(electrodes, midline, include_right_hemisphere, None)
    e = _probe_tracks(sites, electrode_groups, None, None)
    at_units = _inside(e.join(matched_units.select(*PROBE_KEY, *POSITION), PROBE_KEY + POSITION, "left_semi"))
    keys = at_units.join(tree.select(F.col("acronym").alias("location")), "location", "left_semi").select(*PROBE_KEY).distinct()
    if split_terms(filter_area):
        keys = keys.join(_reached(sites, filter_area, filter_type, atlas), PROBE_KEY, "left_semi")
    return keys


def _insertion_filters(implant: str | None, probe_letter: str | None) -> list[Column]:
    preds = []
    if implant:
        preds.append(F.col("implant_location").rlike(implant))
    if probe_letter:
        preds.append(F.col("electrode_group_name") == format_probe_name(F.lit(probe_letter)))
    return preds


def missed_insertions(
    electrodes: DataFrame,
    electrode_groups: DataFrame,
    flagged: DataFrame,
    tree: DataFrame,
    midline: float | Column,
    filter_area: str | None,
    filter_type: str = "starts_with",
    *,
    include_right_hemisphere: bool = False,
    filter_implant_location: str | None = None,
    filter_probe_letter: str | None = None,
    atlas: Atlas | None = None,
) -> DataFrame:
    """Whole tracks of probes (matching the implant and probe filter) with
    a good unit somewhere that never reached the area.

    ``flagged`` comes from :func:`flag_at_location`. A probe reached the
    area when its labels match and a unit of its own lies in the area; both
    are flags of the probe, so electrodes and good units are each read once.
    """
    sites = _sites(electrodes, midline, include_right_hemisphere, filter_probe_letter)
    e = _probe_tracks(sites, electrode_groups, filter_implant_location, filter_probe_letter)
    units = flagged if include_right_hemisphere else flagged.where(F.col("is_right_hemisphere") == F.lit(False))
    probes = units.where(F.col("location").isNotNull()).groupBy(*PROBE_KEY).agg(F.max("in_area").alias("_unit_in_area"))
    if split_terms(filter_area):
        reached = _reached(sites, filter_area, filter_type, atlas).withColumn("_reached", F.lit(True))
        probes = probes.join(reached, PROBE_KEY, "left")
    else:
        probes = probes.withColumn("_reached", F.lit(True))
    missed = probes.where(~(F.col("_unit_in_area") & F.coalesce("_reached", F.lit(False)))).select(*PROBE_KEY)
    return _coloured(_inside(e.join(missed, PROBE_KEY, "left_semi")), tree)


def location_breakdown(counts: DataFrame, group_by: str = "subject_id") -> DataFrame:
    """Units per (subject or session) × location, plus the overall number
    of units and of (non-null) sessions as scalar-subquery columns."""
    if group_by not in ("subject_id", "session_id"):
        raise ValueError("group_by must be subject_id or session_id")
    totals = counts.select(F.struct(F.sum("location_count").alias("units"), F.count_distinct("session_id").alias("sessions"))).scalar()
    total_units, total_sessions = totals["units"], totals["sessions"]
    return (
        counts.groupBy(group_by, "location")
        .agg(F.sum("location_count").alias("units"))
        .withColumns({"total_units": total_units, "total_sessions": total_sessions})
    )


def location_legend(counts: DataFrame) -> DataFrame:
    """Sorted distinct locations (the legend order of the breakdown)."""
    return counts.select("location").distinct().orderBy(F.asc_nulls_first("location"))


#: log2 of the registers of a session sketch: a standard error of about 1.04 / sqrt(2 ** so many).
SKETCH_BITS = 12


def session_sketches(locations: DataFrame, by: tuple[str, ...] = ("location", "implant_location", "electrode_group_name")) -> DataFrame:
    """One row a group with a mergeable HyperLogLog sketch of its sessions.

    ``locations`` are probe-track or unit rows; they are read once. A sketch
    has a fixed size, so the table grows with the groups, not with the rows.
    """
    return locations.groupBy(*by).agg(F.hll_sketch_agg(F.col("session_id").cast("string"), SKETCH_BITS).alias("sessions"))


def approx_sessions(sketches: DataFrame, *by: str) -> DataFrame:
    """Approximate distinct sessions of sketches (filtered at will), in all or by columns, without rereading their rows."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("approx_sessions"))


def approx_location_stats(locations: DataFrame) -> DataFrame:
    """Approximate distinct sessions and locations of a probe-track
    result (HyperLogLog++, mergeable partial states) beside the exact ones."""
    return locations.agg(
        F.approx_count_distinct("session_id").alias("approx_sessions"),
        F.approx_count_distinct("location").alias("approx_locations"),
        F.count_distinct("session_id").alias("exact_sessions"),
        F.count_distinct("location").alias("exact_locations"),
    )


def co_recorded_structures(flagged: DataFrame, k: int = 15) -> DataFrame:
    """In sessions that hit the area, the units NOT in it, counted per
    structure × session, for the ``k`` structures with most such units
    (ties broken by structure name; a null structure takes no place).

    ``flagged`` comes from :func:`flag_at_location`, so the good units are
    read once. Counts are taken per (session, structure); a window over a
    session's few structures then tells whether the session was hit. The
    join back takes at most ``k`` rows (broadcast: bounded by ``k``).
    """
    counted = flagged.groupBy("session_id", "structure").agg(
        F.max("in_area").alias("_hit"),
        F.count(F.when(~F.col("in_area"), F.col("unit_id"))).alias("unit_count"),
    )
    per = (
        counted.withColumn("_session_hit", F.max("_hit").over(Window.partitionBy("session_id")))
        .where(F.col("_session_hit") & (F.col("unit_count") > 0) & F.col("structure").isNotNull())
        .select("structure", "session_id", "unit_count")
    )
    top = (
        per.groupBy("structure")
        .agg(F.sum("unit_count").alias("total_structure_count"))
        .orderBy(F.desc("total_structure_count"), F.asc_nulls_last("structure"))
        .limit(k)
    )
    t = F.broadcast(top).alias("t")
    p = per.alias("p")
    return p.join(t, F.col("p.structure") == F.col("t.structure")).select(
        "p.structure", "p.session_id", "p.unit_count", "t.total_structure_count"
    )


def location_summary(
    good: DataFrame,
    matched_units: DataFrame,
    *,
    include_right_hemisphere: bool = False,
    filter_implant_location: str | None = None,
    filter_probe_letter: str | None = None,
    highlight: bool = True,
) -> DataFrame:
    """Per location: distinct units, sessions, subjects, first structure
    and description. Queried locations first, then by units descending, then
    by location; 0-based ``index`` in that order; ``highlight`` colour
    ``#rrggbb`` on queried rows."""
    units = _hemisphere_filter(good, include_right_hemisphere).where(
        all_of(_insertion_filters(filter_implant_location, filter_probe_letter))
    )
    summary = units.groupBy("location").agg(
        n_unique("unit_id").alias("units"),
        n_unique("session_id").alias("sessions"),
        n_unique("subject_id").alias("subjects"),
        first_by("structure", "unit_id", "session_id").alias("structure"),
        first_by("safe_name", "unit_id", "session_id").alias("description"),
    )
    queried = matched_units.groupBy("location").agg(F.min("color_hex_triplet").alias("_colour"), F.lit(True).alias("_queried"))
    flagged = summary.join(queried, "location", "left").withColumn("selected", F.coalesce("_queried", F.lit(False)))
    if highlight:
        flagged = flagged.withColumn("highlight", F.when(F.col("selected"), F.concat(F.lit("#"), F.col("_colour"))))
    # rows before a (selected, units) class from the classes' sizes, then the place within the class
    key = ["selected", "units"]
    sizes = flagged.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.desc("selected"), F.desc("units")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("location")))
    return (
        flagged.withColumn("_place", place)
        .join(offsets, key)
        .withColumn("index", (F.col("_before") + F.col("_place") - 1).cast("long"))
        .drop("_colour", "_queried", "_place", "_before")
    )


def insertion_hit_rate(
    flagged: DataFrame,
    probes: DataFrame,
    *,
    filter_implant_location: str | None = None,
    filter_probe_letter: str | None = None,
) -> DataFrame:
    """C11: per (probe, implant hole): ``hits`` = distinct insertions that
    reached the area, ``total`` = distinct sessions with that probe in that
    hole among all good units, ``rate`` = hits/total rounded half-up to 2
    places. The implant location is split into implant and hole; the probe
    letter is the group name without its first ``probe``.

    ``flagged`` comes from :func:`flag_at_location`, ``probes`` from
    :func:`probe_keys`. The good units are reduced to insertions first.
    """
    key = ["electrode_group_name", "implant_location"]
    insertions = flagged.groupBy("session_id", *key).agg(F.max("in_area").alias("_in_area"))
    reached = insertions.join(probes.withColumn("_reached", F.lit(True)), PROBE_KEY, "left")
    hit = F.col("_in_area") & F.coalesce("_reached", F.lit(False))
    wanted = all_of(_insertion_filters(filter_implant_location, filter_probe_letter))
    rates = (
        reached.where(wanted & F.col("implant_location").isNotNull())
        .groupBy(*key)
        .agg(F.count(F.when(hit, F.lit(1))).alias("hits"), F.count(F.lit(1)).alias("total"))
        .where(F.col("hits") > 0)
        .withColumn("rate", round_half_up_ratio("hits", "total", 2))
        .where(F.col("rate").isNotNull())
        .withColumns(
            {
                "implant": split_part("implant_location", " ", 0),
                "hole": split_part("implant_location", " ", 1),
                "probe": replace_first("electrode_group_name", "probe"),
            }
        )
    )
    per_implant = rates.groupBy("implant").agg(F.sum("hits").alias("total_hits_this_implant"))
    r, pi = rates.alias("r"), per_implant.alias("pi")
    return (
        r.join(pi, F.col("r.implant").eqNullSafe(F.col("pi.implant")))
        .select("r.implant", "r.hole", "r.probe", "r.hits", "r.total", "r.rate", "pi.total_hits_this_implant")
    )


def overlay_regions(matched_units: DataFrame, filter_area: str | None, show_parent: bool = False) -> DataFrame:
    """C20: areas to draw over the atlas: none without a term; the matched
    structures when ``show_parent`` or more than one location matched;
    otherwise the single matched location."""
    if not split_terms(filter_area):
        return matched_units.select(F.col("location").alias("area")).where(F.lit(False))
    n_locations = matched_units.select(n_unique("location")).scalar()
    use_structure = F.lit(show_parent) | (n_locations > 1)
    return matched_units.select(F.when(use_structure, F.col("structure")).otherwise(F.col("location")).alias("area")).distinct()


def implant_value_counts(counts: DataFrame) -> DataFrame:
    """Number of (session × location) groups per implant location,
    most frequent first; null is its own value."""
    return counts.groupBy("implant_location").agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), F.asc_nulls_first("implant_location")
    )


def pick_structure(good: DataFrame, seed: int = 0) -> DataFrame:
    """One pseudo-random structure holding a left-hemisphere unit
    (the starting value of the search box). Deterministic for a seed."""
    return (
        good.where(F.col("unit_id").isNotNull() & (F.col("is_right_hemisphere") == F.lit(False)) & F.col("structure").isNotNull())
        .select("structure")
        .distinct()
        .orderBy(F.md5(F.concat(F.col("structure"), F.lit(f"|{seed}"))), "structure")
        .limit(1)
    )
