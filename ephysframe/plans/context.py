"""Per-query build context: the derived domain tables of one sf directory."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession

from ephysframe.operators import coverage, gates, volume
from ephysframe.plans import roles


class Memo:
    """Persisted plans by the arguments that made them.

    A table is kept by Spark (memory, then disk) from the first action that
    reads it, and found again by name and arguments. Beyond ``most`` tables the
    one that was asked for longest ago is released, so a run over many
    arguments does not pin the cluster's memory. A released plan still works:
    it is computed again when read.
    """

    def __init__(self, most: int = 8, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        if most < 1:
            raise ValueError("a memo holds at least one table")
        self.most, self.level = most, level
        self._kept: OrderedDict[Hashable, DataFrame] = OrderedDict()

    @staticmethod
    def key(name: str, args: dict) -> Hashable:
        """Equal arguments in any order are one key; lists count as tuples."""

        def fixed(x):
            if isinstance(x, dict):
                return tuple(sorted((k, fixed(v)) for k, v in x.items()))
            return tuple(map(fixed, x)) if isinstance(x, (list, tuple, set)) else x

        return name, fixed(args)

    def get(self, name: str, build: Callable[..., DataFrame], **args) -> DataFrame:
        """``build(**args)``, persisted under its name and arguments."""
        key = self.key(name, args)
        if key not in self._kept:
            self._kept[key] = build(**args).persist(self.level)
            while len(self._kept) > self.most:
                self._kept.popitem(last=False)[1].unpersist()
        self._kept.move_to_end(key)
        return self._kept[key]

    def release(self, name: str | None = None) -> int:
        """Release the tables of a name, or all; returns how many."""
        gone = [k for k in self._kept if name is None or k[0] == name]
        for k in gone:
            self._kept.pop(k).unpersist()
        return len(gone)

    def __len__(self) -> int:
        return len(self._kept)


class Ctx:
    """Lazily derived domain tables for one driver directory.

    Nothing here executes: each property is a logical plan that Catalyst
    optimises together with the query that uses it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, memo: Memo | None = None):
        """``memo`` keeps good-unit tables by directory and thresholds (S10),
        like the dashboards' argument cache; contexts may share one. Off by
        default: a cache pins memory across queries."""
        self.spark, self.d, self.memo = spark, sf_dir, memo

    @cached_property
    def session(self) -> DataFrame:
        return roles.session(self.spark, self.d)

    @cached_property
    def performance(self) -> DataFrame:
        return roles.performance(self.spark, self.d)

    @cached_property
    def units(self) -> DataFrame:
        return roles.units(self.spark, self.d)

    @cached_property
    def electrodes(self) -> DataFrame:
        return roles.electrodes(self.spark, self.d)

    @cached_property
    def electrode_groups(self) -> DataFrame:
        return roles.electrode_groups(self.spark, self.d)

    @cached_property
    def tree(self) -> DataFrame:
        return roles.tree(self.spark, self.d)

    @cached_property
    def voxels(self) -> DataFrame:
        return roles.voxels(self.spark, self.d)

    @cached_property
    def midline(self) -> Column:
        return volume.midline(roles.SHAPE["ml"])

    @cached_property
    def good_sessions(self) -> DataFrame:
        return gates.qualifying_sessions(self.session, self.performance, **roles.SESSION_GATE)

    @cached_property
    def good(self) -> DataFrame:
        return self.good_by()

    def good_by(self, session_gate: dict | None = None, unit_gate: dict | None = None) -> DataFrame:
        """The good units under other thresholds than the usual ones."""

        def build(directory: str, session_gate: dict, unit_gate: dict) -> DataFrame:
            sessions = gates.qualifying_sessions(self.session, self.performance, **session_gate)
            return gates.good_units(sessions, self.units, self.electrode_groups, self.tree, self.midline, **unit_gate)

        args = {"directory": self.d, "session_gate": dict(roles.SESSION_GATE, **(session_gate or {})), "unit_gate": dict(roles.UNIT_GATE, **(unit_gate or {}))}
        return self.memo.get("good_units", build, **args) if self.memo is not None else build(**args)

    @cached_property
    def atlas(self) -> coverage.Atlas:
        return coverage.Atlas(self.tree, volume.volume_ids(self.voxels, "left", roles.SHAPE["ml"]))

    def flagged(self, area: str, mode: str = "starts_with", **kw) -> DataFrame:
        return coverage.flag_at_location(self.good, area, mode, atlas=self.atlas, **kw)

    def matched(self, area: str, mode: str = "starts_with", **kw) -> DataFrame:
        return coverage.units_at_location(self.good, area, mode, atlas=self.atlas, **kw)
