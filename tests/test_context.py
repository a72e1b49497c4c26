"""Memoisation of good-unit tables by their arguments."""

import pytest

from ephysframe.plans.catalog import GOOD_COLUMNS
from ephysframe.plans.context import Ctx, Memo

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*GOOD_COLUMNS).collect()))


def cached(df):
    return df.storageLevel.useMemory or df.storageLevel.useDisk


def test_two_thresholds_are_two_entries(spark):
    memo = Memo(2)
    plain, kept = Ctx(spark, SF), Ctx(spark, SF, memo)
    strict = {"max_isi": 0.05}
    usual, fewer = rows(plain.good), rows(plain.good_by(unit_gate=strict))
    assert not cached(plain.good) and usual != fewer
    assert rows(kept.good) == usual and rows(kept.good_by(unit_gate=strict)) == fewer
    assert cached(kept.good) and cached(kept.good_by(unit_gate=strict)) and len(memo) == 2
    # another context finds the same tables; equal arguments are one entry
    assert Ctx(spark, SF, memo).good is kept.good and len(memo) == 2
    plan = Ctx(spark, SF, memo).good_by(unit_gate={"max_isi": 0.05})._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and len(memo) == 2
    assert memo.release() == 2 and not cached(kept.good) and len(memo) == 0
    assert rows(kept.good) == usual


def test_the_oldest_entry_goes(spark):
    memo = Memo(2)
    made = [memo.get("t", lambda n: spark.range(n), n=n) for n in (3, 4)]
    assert memo.get("t", lambda n: spark.range(n), n=3) is made[0]
    last = memo.get("u", lambda n: spark.range(n + 10), n=4)
    assert [cached(x) for x in (*made, last)] == [True, False, True] and len(memo) == 2
    assert [x.count() for x in (*made, last)] == [3, 4, 14]
    assert memo.release("t") == 1 and cached(last) and memo.release("t") == 0
    assert memo.key("t", {"a": [1, 2], "b": {"c": 1}}) == memo.key("t", {"b": {"c": 1}, "a": (1, 2)})
    memo.release()
    with pytest.raises(ValueError):
        Memo(0)
