"""Property tests: exact helpers against plain Python definitions."""

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ephysframe.functions import list_lacks, n_unique, round_half_up_ratio
from ephysframe.operators.coverage import contains_any

SHORT = st.text(alphabet="abAB#_1", min_size=0, max_size=6)


@settings(max_examples=12, deadline=None)
@given(values=st.lists(SHORT, min_size=1, max_size=12), needles=st.lists(st.tuples(st.integers(0, 2), SHORT.filter(bool)), min_size=1, max_size=6))
def test_contains_any_is_substring_test(spark, values, needles):
    v = spark.createDataFrame([(x,) for x in values], "value string")
    n = spark.createDataFrame(needles, "term_idx int, acronym string")
    got = {(r.term_idx, r.value) for r in contains_any(v, n).collect()}
    want = {(t, x) for t, a in needles for x in values if x and a in x}
    assert got == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 5)), min_size=1, max_size=20))
def test_n_unique_matches_set(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v long")
    assert df.select(n_unique("v").alias("n")).first().n == len(set(xs))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10_000), st.integers(1, 10_000)), min_size=1, max_size=20))
def test_half_up_ratio_is_exact(spark, pairs):
    df = spark.createDataFrame(pairs, "h long, t long")
    got = [r.r for r in df.select(round_half_up_ratio("h", "t").alias("r")).collect()]
    want = [float(int(Fraction(h, t) * 100 + Fraction(1, 2))) / 100 for h, t in pairs]
    assert got == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.sampled_from(["x", "templeton", "y"])), max_size=4)),
                min_size=1, max_size=10))
def test_list_lacks_matches_python(spark, lists):
    df = spark.createDataFrame(list(enumerate(lists)), "i int, k array<string>")
    got = sorted(r.i for r in df.where(list_lacks("k", "templeton")).collect())
    want = [i for i, k in enumerate(lists) if k is not None and "templeton" not in k]  # a null list drops its row
    assert got == want
