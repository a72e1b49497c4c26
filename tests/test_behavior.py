"""C27 golden: rank taken before blocks without a score drop."""

import datetime as dt

import random
from collections import Counter

from pyspark.sql import functions as F

from ephysframe.operators.behavior import dprime_over_time, ranked_in_group, session_mean_dprime

COLS = "session_id string, subject_id long, date date, block_index long, vis_intra_dprime double, aud_intra_dprime double"


def test_session_mean_dprime_golden(spark):
    d = dt.date
    rows = [
        ("614910_2022-03-29_0", 614910, d(2022, 3, 29), 0, None, None),
        ("614910_2022-03-30_0", 614910, d(2022, 3, 30), 0, 0.29937, None),
        ("614910_2022-03-31_0", 614910, d(2022, 3, 31), 0, 0.5, 0.654744),
        ("1_2022-01-01_0", 1, d(2022, 1, 1), 0, 1.0, 3.0),
        ("1_2022-01-01_0", 1, d(2022, 1, 1), 1, 2.0, None),
    ]
    out = session_mean_dprime(spark.createDataFrame(rows, COLS)).collect()
    by = {r.session_id: r for r in out}
    assert "614910_2022-03-29_0" not in by
    a, b = by["614910_2022-03-30_0"], by["614910_2022-03-31_0"]
    assert (a.session_number, a.num_blocks, a.days_since_first_session) == (2, 1, 0)
    assert (b.session_number, b.num_blocks, b.days_since_first_session) == (3, 1, 1)
    assert round(a.mean_dprime, 6) == 0.29937 and round(b.mean_dprime, 6) == 0.577372
    assert by["1_2022-01-01_0"].mean_dprime == 2.0 and by["1_2022-01-01_0"].num_blocks == 2
    assert [r.session_id for r in out] == ["1_2022-01-01_0", "614910_2022-03-30_0", "614910_2022-03-31_0"]
    only = dprime_over_time(spark.createDataFrame(rows, COLS), "614910").collect()
    assert {r.date for r in only} == {"2022-03-30", "2022-03-31"}


def test_sessions_without_a_subject_stay(spark):
    d = dt.date
    rows = [("a", None, d(2024, 1, 1), 0, 1.0, None), ("b", None, d(2024, 1, 3), 0, 1.0, 3.0), ("c", 5, d(2024, 1, 2), 0, 2.0, None)]
    by = {r.session_id: r for r in session_mean_dprime(spark.createDataFrame(rows, COLS)).collect()}
    assert (by["a"].session_number, by["b"].session_number, by["b"].days_since_first_session) == (1, 2, 2)
    assert by["b"].mean_dprime == 2.0 and by["c"].session_number == 1
    assert [r.session_id for r in dprime_over_time(spark.createDataFrame(rows, COLS), "5").collect()] == ["c"]


def test_rank_under_a_hot_group(spark):
    """Half of all sessions have no subject: ranks are right, and no window holds more than its share of them."""
    rng = random.Random(2)
    rows = [(None if i % 2 else rng.randrange(50), f"{rng.randrange(10**9):09d}") for i in range(6000)]
    rows += rows[:500] + [(3, None), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "subject_id long, session_id string").repartition(5)
    got = [tuple(r) for r in ranked_in_group(df, "subject_id", "session_id", "n").collect()]
    expect = []
    for subject in {r[0] for r in rows}:
        own = sorted({r[1] for r in rows if r[0] == subject}, key=lambda x: (x is None, x or ""))
        expect += [(subject, x, k) for k, x in enumerate(own, 1)]
    assert Counter(got) == Counter(expect)
    plan = ranked_in_group(df, "subject_id", "session_id", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_g" in plan and "_b#" in plan.split("row_number()")[1].split("]")[0]
    # the ranges of the hot group: about 3,000 sessions over 257 of them
    ordered = sorted({r[1] for r in rows if r[1]})
    picked = {}
    for r in spark.createDataFrame([(x,) for x in ordered], "o string").select("o", F.pmod(F.xxhash64("o"), F.lit(256)).alias("k"), F.xxhash64(F.lit("cut"), "o").alias("h")).collect():
        picked[r.k] = min(picked.get(r.k, (r.h, r.o)), (r.h, r.o))
    cuts = sorted(o for _, o in picked.values())
    hot = [sum(c <= s for c in cuts) for g, s, _ in got if g is None and s]
    assert max(Counter(hot).values()) < len(hot) / 20
    few = spark.createDataFrame([(1, 5), (1, 3), (None, 9)], "g int, o int")
    assert Counter(map(tuple, ranked_in_group(few, "g", "o", "n").collect())) == Counter([(1, 3, 1), (1, 5, 2), (None, 9, 1)])
    assert ranked_in_group(few.where("g > 5"), "g", "o", "n").collect() == []
