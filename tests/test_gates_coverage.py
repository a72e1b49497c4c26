"""Gates (C1, C2, C12) and coverage operators on small domain fixtures."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ephysframe.operators import coverage, gates

D = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def domain(spark):
    session = spark.createDataFrame(
        [("s1", 1, D, ["a"]), ("s2", 1, D, ["templeton"]), ("s3", 2, D, []), ("s4", 3, D, [None, "b"]),
         ("s5", 4, D, ["a"]), ("s6", 4, D, None)],
        "session_id string, subject_id long, date date, keywords array<string>",
    )
    perf = []
    for sid, n in (("s1", 4), ("s2", 4), ("s3", 4), ("s4", 4), ("s5", 3), ("s6", 4)):
        perf += [(sid, i, 1.5, 1.5) for i in range(n)]
    perf += [("s1", 9, 1.0, 2.0)]  # d-prime exactly on the threshold does not pass
    performance = spark.createDataFrame(perf, "session_id string, block_index long, same_modal_dprime double, cross_modal_dprime double")
    units = spark.createDataFrame(
        [
            ("s1", "probeA", "u1", "VISp1", "VISp", 100.0, 10.0, 50.0, 0.1, 0.0, 0.05, 0.99),
            ("s1", "probeA", "u2", "VISp1", "VISp", 100.0, 10.0, 250.0, 0.1, 0.0, 0.05, 0.99),
            ("s1", "probeB", "u3", "MOs1", "MOs", 200.0, 20.0, 50.0, 0.1, 0.0, 0.05, 0.99),
            ("s1", "probeB", "u4", "MOs1", "MOs", 200.0, 20.0, 50.0, 0.5, 0.0, 0.05, 0.99),  # isi on threshold
            ("s1", "probeB", "u5", "MOs1", "MOs", 200.0, 20.0, 50.0, 0.1, 0.0, 0.10, 0.99),  # amp on threshold
            ("s1", "probeB", "u6", "MOs1", "MOs", 200.0, 20.0, 50.0, 0.1, 0.0, 0.05, 0.95),  # presence on threshold
            ("s3", "probeA", "u7", "VISp1", "VISp", 100.0, 10.0, 125.0, 0.1, 0.0, 0.05, 0.99),  # on the midline: left
            ("s4", "probeA", "u8", "nowhere", "none", 1.0, 1.0, 1.0, 0.1, 0.0, 0.05, 0.99),  # not in the tree
            ("s4", "probeC", "u9", "MOs1", "MOs", 300.0, 30.0, 50.0, 0.1, 0.0, 0.05, 0.99),
        ],
        "session_id string, electrode_group_name string, unit_id string, location string, structure string, "
        "ccf_ap double, ccf_dv double, ccf_ml double, isi_violations_ratio double, isi_violations_count double, "
        "amplitude_cutoff double, presence_ratio double",
    )
    groups = spark.createDataFrame(
        [("s1", "probeA", "2002 E2"), ("s1", "probeB", "2002 A1"), ("s3", "probeA", "2002 E2"), ("s4", "probeA", "H1"),
         ("s4", "probeC", "2002 E2")],
        "session_id string, name string, location string",
    )
    tree = spark.createDataFrame(
        [(1, "VISp1", "layer 1", "00FF00"), (2, "MOs1", "motor 1", "FF0000")],
        "id long, acronym string, safe_name string, color_hex_triplet string",
    )
    sessions = gates.qualifying_sessions(session, performance)
    good = gates.good_units(sessions, units, groups, tree, 125.0)
    return {"session": session, "performance": performance, "units": units, "groups": groups, "tree": tree,
            "sessions": sessions, "good": good}


def test_qualifying_sessions(domain):
    # s2 has the keyword, s5 only 3 passing blocks, s6 a null list; a list with a null is kept
    assert sorted(r.session_id for r in domain["sessions"].collect()) == ["s1", "s3", "s4"]
    off = gates.qualifying_sessions(domain["session"], domain["performance"], enabled=False)
    assert off.count() == 6


def test_good_units_thresholds_and_hemisphere(domain):
    g = {r.unit_id: r for r in domain["good"].collect()}
    assert sorted(g) == ["u1", "u2", "u3", "u7", "u9"]
    assert g["u2"].is_right_hemisphere and not g["u7"].is_right_hemisphere
    assert g["u1"].implant_location == "2002 E2" and g["u1"].safe_name == "layer 1"


def test_coverage_stats(domain):
    r = gates.coverage_stats(domain["good"], {"max_isi": 0.5}).first()
    assert (r.units, r.sessions, r.subjects, r.max_isi) == (5, 3, 3, 0.5)


def test_units_at_location_modes(domain):
    good = domain["good"]
    ids = lambda df: sorted(r.unit_id for r in df.collect())
    assert ids(coverage.units_at_location(good, "VIS", "starts_with")) == ["u1", "u7"]
    assert ids(coverage.units_at_location(good, "VIS", "starts_with", include_right_hemisphere=True)) == ["u1", "u2", "u7"]
    assert ids(coverage.units_at_location(good, "vis, mos", "starts_with", case_sensitive=False)) == ["u1", "u3", "u7", "u9"]
    assert ids(coverage.units_at_location(good, "[ps][0-9]$", "contains")) == ["u1", "u3", "u7", "u9"]
    assert ids(coverage.units_at_location(good, "", "starts_with")) == ["u1", "u3", "u7", "u9"]


def test_flags_equal_matched_units(domain):
    good = domain["good"]
    for area, mode, kw in (("VIS", "starts_with", {}), ("vis, mos", "starts_with", {"case_sensitive": False}), ("", "starts_with", {}),
                           ("[ps][0-9]$", "contains", {"include_right_hemisphere": True})):
        flagged = {r.unit_id for r in coverage.flag_at_location(good, area, mode, **kw).where("in_area").collect()}
        assert flagged == {r.unit_id for r in coverage.units_at_location(good, area, mode, **kw).collect()}


def test_case_insensitive_pattern_keeps_its_escapes(domain):
    found = coverage.units_at_location(domain["good"], r"^vis\Dp?1?", "contains", case_sensitive=False)
    assert sorted(r.unit_id for r in found.collect()) == ["u1", "u7"]


def test_substrings_are_bounded_by_needle_lengths(spark):
    long = "".join(chr(97 + i % 7) for i in range(5000)) + "NEEDLE"
    v = spark.createDataFrame([(long,)], "value string")
    n = spark.createDataFrame([(0, "NEEDLE"), (1, "absent")], "term_idx int, acronym string")
    assert [(r.term_idx, r.value) for r in coverage.contains_any(v, n).collect()] == [(0, long)]


def test_probe_tracks_and_missed(domain, spark):
    good, tree = domain["good"], domain["tree"].withColumn("color_hex_int", F.lit(1))
    el = spark.createDataFrame(
        [("s1", "probeA", 100.0, 10.0, 50.0, "VISp1", "VISp"), ("s1", "probeA", 101.0, 10.0, 50.0, "MOs1", None),
         ("s1", "probeB", 200.0, 20.0, 50.0, "MOs1", "MOs"), ("s4", "probeC", 300.0, 30.0, 50.0, "MOs1", "MOs"),
         ("s4", "probeC", -1.0, 30.0, 50.0, "MOs1", "MOs")],
        "session_id string, group_name string, x double, y double, z double, location string, structure string",
    )
    args = (el, domain["groups"])
    matched = coverage.units_at_location(good, "MOs", "starts_with")
    near = coverage.probe_locations(*args, matched, tree, 125.0, "MOs", "starts_with")
    assert sorted((r.session_id, r.ccf_ap) for r in near.collect()) == [("s1", 200.0), ("s4", 300.0)]
    keys = coverage.probe_keys(*args, matched, tree, 125.0, "MOs", "starts_with")
    assert sorted((r.session_id, r.electrode_group_name) for r in keys.collect()) == [("s1", "probeB"), ("s4", "probeC")]
    missed = coverage.missed_insertions(*args, coverage.flag_at_location(good, "MOs", "starts_with"), tree, 125.0, "MOs", "starts_with")
    assert sorted((r.electrode_group_name, r.ccf_ap) for r in missed.collect()) == [("probeA", 100.0), ("probeA", 101.0)]
    only = coverage.missed_insertions(*args, coverage.flag_at_location(good, "VIS", "starts_with"), tree, 125.0, "VIS", "starts_with",
                                      filter_implant_location="A1", filter_probe_letter="b")
    assert [r.ccf_ap for r in only.collect()] == [200.0]


def test_probes_are_gathered_without_their_labels(spark):
    el = [("s1", "probeA", "VISp1", None), ("s1", "probeA", None, "MOs"), ("s1", "probeB", "VISp1", "VISp"), ("s1", "probeB", "VISp1", "VISp"),
          ("s2", "probeA", None, None), ("s2", "probeB", None, "VISpMOs"), ("s3", "probeA", "MOs1", "MOs"), (None, "probeA", "VISp1", "MOs")]
    sites = spark.createDataFrame([(a, b, 1.0, 1.0, 1.0, c, d) for a, b, c, d in el],
                                  "session_id string, group_name string, x double, y double, z double, location string, structure string")
    groups = spark.createDataFrame([(s, p, "E1") for s in ("s1", "s2", "s3") for p in ("probeA", "probeB")], "session_id string, name string, location string")
    tree = spark.createDataFrame([("VISp1",), ("MOs1",)], "acronym string")
    units = sites.select("session_id", F.col("group_name").alias("electrode_group_name"), *[F.lit(1.0).alias(c) for c in coverage.POSITION])
    for area in ("VIS, MOs", "VIS", "MOs, MOs", "none, VIS"):
        out = coverage.probe_locations(sites, groups, units, tree, 125.0, area, "contains")
        labels = {}
        for a, b, *own in el:
            labels.setdefault((a, b), set()).update(filter(None, own))
        reached = {k for k, own in labels.items() if all(any(t in v for v in own) for t in area.split(", "))}
        want = sorted((a, b, c) for a, b, c, _ in el if a and (a, b) in reached and c in ("VISp1", "MOs1"))
        assert sorted((r.session_id, r.electrode_group_name, r.location) for r in out.collect()) == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        grouped = [set(re.sub(r"#\d+L?", "", g).split(", ")) for g in re.findall(r"Aggregate \[([^\]]*)\]", plan)]
        assert any("location" in g for g in grouped) and all(g <= set(coverage.PROBE_KEY) for g in grouped if "session_id" in g)


def test_unit_counts_and_breakdown(domain):
    counts = coverage.unit_counts(domain["good"])
    rows = {(r.session_id, r.location): r for r in counts.collect()}
    assert rows[("s1", "VISp1")].location_count == 2 and rows[("s1", "VISp1")].unit_ids == ["u1", "u2"]
    b = coverage.location_breakdown(counts, "subject_id").collect()
    assert {r.total_units for r in b} == {5} and {r.total_sessions for r in b} == {3}


def test_co_recorded_top_k(domain):
    flagged = coverage.flag_at_location(domain["good"], "VISp", "starts_with")
    out = coverage.co_recorded_structures(flagged, k=2).collect()
    # u2 lies in the area but on the right, so it counts as another unit of VISp
    assert {(r.structure, r.session_id, r.unit_count, r.total_structure_count) for r in out} == {("MOs", "s1", 1, 1), ("VISp", "s1", 1, 1)}
    none = flagged.withColumn("structure", F.lit(None).cast("string"))
    assert coverage.co_recorded_structures(none).count() == 0  # a null structure takes no place


def test_location_summary_index(domain):
    matched = coverage.units_at_location(domain["good"], "MOs", "starts_with")
    out = sorted(coverage.location_summary(domain["good"], matched).collect(), key=lambda r: r["index"])
    assert [(r["index"], r.location, r.selected, r.highlight) for r in out] == [
        (0, "MOs1", True, "#FF0000"), (1, "VISp1", False, None)
    ]
    assert out[0].units == 2 and out[0].sessions == 2


def test_contains_any_matches_brute_force(spark):
    values = ["NATION_1", "NATION_12", "Supplier#1", "abc", "ab"]
    needles = [(0, "NATION_1"), (0, "c"), (1, "b"), (1, "Supplier")]
    v = spark.createDataFrame([(x,) for x in values], "value string")
    n = spark.createDataFrame(needles, "term_idx int, acronym string")
    got = {(r.term_idx, r.value) for r in coverage.contains_any(v, n).collect()}
    want = {(t, x) for t, a in needles for x in values if a in x}
    assert got == want


def test_insertion_hit_rate(domain, spark):
    flagged = coverage.flag_at_location(domain["good"], "MOs", "starts_with")
    probes = flagged.where("in_area").select("session_id", "electrode_group_name").distinct()
    out = {(r.implant, r.hole, r.probe): r for r in coverage.insertion_hit_rate(flagged, probes).collect()}
    assert (out[("2002", "A1", "B")].hits, out[("2002", "A1", "B")].total, out[("2002", "A1", "B")].rate) == (1, 1, 1.0)
    assert out[("2002", "E2", "C")].total_hits_this_implant == 2


def test_overlay_and_pick(domain):
    good = domain["good"]
    m = coverage.units_at_location(good, "VISp1", "starts_with")
    assert [r.area for r in coverage.overlay_regions(m, "VISp1").collect()] == ["VISp1"]
    assert [r.area for r in coverage.overlay_regions(m, "VISp1", show_parent=True).collect()] == ["VISp"]
    assert coverage.overlay_regions(m, "").count() == 0
    assert coverage.pick_structure(good, 1).count() == 1
