"""Plan-shape checks: pushdown reaches the scan; no Python UDFs, cartesian
products or nested-loop joins in any registered query."""

import contextlib
import io

import pytest

from ephysframe.operators import coverage, gates
from ephysframe.plans import roles
from ephysframe.plans.catalog import GOOD_COLUMNS, QUERIES
from ephysframe.plans.context import Ctx
from ephysframe.sources import write_bucketed

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct")


def plan_of(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def unbounded_nested_loops(plan: str) -> int:
    """Nested-loop joins whose broadcast side is not limited to one row.

    Catalyst turns a semi-join against a constant key (the tree's literal
    root row) into an EXISTS check with a ``LocalLimit 1`` build side; that
    one is bounded and allowed."""
    lines = plan.splitlines()
    bad = 0
    for i, line in enumerate(lines):
        if "BroadcastNestedLoopJoin" in line:
            window = "\n".join(lines[i : i + 6])
            bad += "LocalLimit 1" not in window
    return bad


def test_gates_push_down_to_parquet(spark):
    plan = plan_of(QUERIES["units_at_location_starts_with"](spark, SF))
    assert "GreaterThan(l_quantity,10.0)" in plan and "LessThan(l_discount,0.08)" in plan
    assert "StringStartsWith(s_name,Supplier#0000000)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_building_a_query_runs_no_job(spark, name):
    group = f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        QUERIES[name](spark, SF)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_udf_or_nested_loop(spark, name):
    df = QUERIES[name](spark, SF)
    plan = plan_of(df)
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, f"{name}: {bad}"
    assert unbounded_nested_loops(plan_of(df, "simple")) == 0, name


def test_bucketed_components_join_without_a_shuffle(spark):
    """Good units from tables in buckets of sessions: neither units nor electrode groups nor sessions are exchanged."""
    c = Ctx(spark, SF)
    names = {n: f"bucketed_{n}" for n in ("session", "performance", "units", "electrode_groups")}
    for n, t in names.items():
        write_bucketed(getattr(c, n), t, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        s, p, u, g = (spark.table(t) for t in names.values())
        sessions = gates.qualifying_sessions(s, p, **roles.SESSION_GATE)
        kept = u.join(sessions.select("session_id"), "session_id", "left_semi")
        both = kept.join(g.withColumnsRenamed({"name": "electrode_group_name", "location": "implant_location"}), ["session_id", "electrode_group_name"])
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        got = gates.good_units(sessions, u, g, c.tree, c.midline, **roles.UNIT_GATE).select(*GOOD_COLUMNS)
        text = got._jdf.queryExecution().executedPlan().toString()
        # only rows that have passed sessions, groups and gates are exchanged, for the tree's acronyms
        assert text.count("Bucketed: true") == 4 and "session_id" not in "".join(x for x in text.splitlines() if "Exchange hashpartitioning" in x)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, c.good.select(*GOOD_COLUMNS).collect()))
    finally:
        for k in ("autoBroadcastJoinThreshold", "adaptive.enabled", "requireAllClusterKeysForCoPartition"):
            spark.conf.unset(f"spark.sql.{k}")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        for t in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_sketches_serve_any_filter(spark):
    c = Ctx(spark, "/root/testdata/sf0.01")
    rows = c.good.select("session_id", "location", "implant_location", "electrode_group_name")
    sketches = coverage.session_sketches(rows).persist()
    assert sketches.count() == rows.select("location", "implant_location", "electrode_group_name").distinct().count()
    for keep in ("true", "electrode_group_name = 'probeA'", "location like 'Supplier#00000001%' or implant_location like '%small%'", "location = 'nowhere'"):
        exact = rows.where(keep).select("session_id").distinct().count()
        found = coverage.approx_sessions(sketches.where(keep)).first()[0] or 0
        assert abs(found - exact) <= 0.06 * exact + 1, (keep, found, exact)
        plan = coverage.approx_sessions(sketches.where(keep))._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan
    sketches.unpersist()
