"""Structure tree goldens and the frontier rule (C4)."""

import random

import pytest
from pyspark.sql import functions as F

from ephysframe.operators import tree as T

COLS = "id long, acronym string, parent_structure_id long, structure_id_path string, color_hex_triplet string, safe_name string"

# A slice of the atlas tree around MOs as stated in FIXTURES.md.
ROWS = [
    (997, "root", None, "/997/", "FFFFFF", "root"),
    (500, "MO", 997, "/997/500/", "1F9D5A", "Somatomotor areas"),
    (993, "MOs", 500, "/997/500/993/", "1F9D5A", "Secondary motor area"),
    (656, "MOs1", 993, "/997/500/993/656/", "1F9D5A", "layer 1"),
    (962, "MOs2/3", 993, "/997/500/993/962/", "1F9D5A", "layer 2/3"),
    (767, "MOs5", 993, "/997/500/993/767/", "1F9D5A", "layer 5"),
    (1021, "MOs6a", 993, "/997/500/993/1021/", "1F9D5A", "layer 6a"),
    (1085, "MOs6b", 993, "/997/500/993/1085/", "1F9D5A", "layer 6b"),
    (385, "VISp", 997, "/997/385/", "08858C", "Primary visual area"),
    (593, "VISp1", 385, "/997/385/593/", "08858C", "layer 1"),
    (7001, "X", 997, "/997/7001/", "000123", "leaf not in volume"),
    (7002, "Y", 997, "/997/7002/", "123456", "child two levels down"),
    (7003, "Y1", 7002, "/997/7002/7003/", "123456", "middle"),
    (7004, "Y1a", 7003, "/997/7002/7003/7004/", "123456", "deep"),
]


@pytest.fixture(scope="module")
def tree(spark):
    return T.structure_tree(spark.createDataFrame(ROWS, COLS))


def test_colour_golden(tree):
    r = tree.where(F.col("acronym") == "MOs").first()
    assert r.color_hex_int == 2071898
    assert r.color_hex_str == "0x1F9D5A"
    assert r.color_rgb == [0.12156862745098039, 0.615686274509804, 0.3529411764705882]
    lead = tree.where(F.col("acronym") == "X").first()
    assert lead.color_hex_str == "0x000123" and lead.color_hex_int == 0x123


def test_lookups(spark, tree):
    keys = spark.createDataFrame([("MOs",), ("VISp",)], "acronym string")
    assert {r.acronym: r.id for r in T.acronyms_to_ids(tree, keys).collect()} == {"MOs": 993, "VISp": 385}
    ids = spark.createDataFrame([(993,), (385,)], "id long")
    assert {r.id: r.acronym for r in T.ids_to_acronyms(tree, ids).collect()} == {993: "MOs", 385: "VISp"}
    info = T.structure_info(tree, spark.createDataFrame([("MOs",)], "acronym string")).first()
    assert info.id == 993 and info.parent_structure_id == 500


def test_unknown_acronym_fails(spark, tree):
    keys = spark.createDataFrame([("nope",)], "acronym string")
    with pytest.raises(Exception, match="unknown acronym"):
        T.acronyms_to_ids(tree, keys).collect()
    with pytest.raises(Exception, match="no structure with acronym nope"):
        T.structure_info(tree, keys).collect()


def _frontier(spark, tree, vol, roots):
    v = spark.createDataFrame([(i,) for i in vol], "id long")
    r = spark.createDataFrame([(i,) for i in roots], "root_id long")
    out = {}
    for row in T.frontier_descendants(tree, v, r).collect():
        out.setdefault(row.root_id, set()).add(row.id)
    return out


def test_children_of_mos_golden(spark, tree):
    vol = [0, 656, 962, 767, 1021, 1085, 593, 7004]
    got = _frontier(spark, tree, vol, [993])
    names = {r.id: r.acronym for r in tree.collect()}
    assert sorted(names[i] for i in got[993]) == ["MOs1", "MOs2/3", "MOs5", "MOs6a", "MOs6b"]


def test_frontier_cases(spark, tree):
    vol = [385, 593, 7004]
    got = _frontier(spark, tree, vol, [385, 7002, 7001, 997])
    assert got[385] == {385}  # root itself labelled
    assert got[7002] == {7004}  # two levels down
    assert 7001 not in got  # unlabelled leaf vanishes
    assert got[997] == {385, 7004}  # VISp1 hidden behind labelled VISp


def _walk(children, vol, root):
    """The loop form: expand unlabelled nodes until every node is labelled."""
    if root in vol:
        return {root}
    out, todo = set(), list(children.get(root, []))
    while todo:
        n = todo.pop()
        if n in vol:
            out.add(n)
        else:
            todo.extend(children.get(n, []))
    return out


def test_frontier_matches_walk_on_random_trees(spark):
    rnd = random.Random(5)
    rows, children, paths = [], {}, {1: "/1/"}
    rows.append((1, "n1", None, "/1/", "000000", "n1"))
    for i in range(2, 300):
        p = rnd.randint(1, i - 1)
        paths[i] = paths[p] + f"{i}/"
        children.setdefault(p, []).append(i)
        rows.append((i, f"n{i}", p, paths[i], "000000", f"n{i}"))
    tree = spark.createDataFrame(rows, COLS)
    vol = {i for i in range(1, 300) if rnd.random() < 0.3}
    roots = list(range(1, 300, 7))
    got = _frontier(spark, tree, vol, roots)
    for r in roots:
        assert got.get(r, set()) == _walk(children, vol, r), r


def test_strict_children_search(spark, tree):
    from ephysframe.operators.coverage import Atlas, units_at_location

    good = spark.createDataFrame([("u1", "MOs1", False)], "unit_id string, location string, is_right_hemisphere boolean")
    atlas = Atlas(tree, spark.createDataFrame([(656,)], "id long"))
    assert units_at_location(good, "MOs", "children_of", atlas=atlas).count() == 1
    empty = units_at_location(good, "X", "children_of", atlas=atlas)  # building it runs nothing
    with pytest.raises(Exception, match="matches nothing in the volume"):
        empty.collect()
    assert units_at_location(good, "X", "children_of", atlas=atlas, strict=False).count() == 0
