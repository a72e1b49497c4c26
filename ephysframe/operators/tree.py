"""Structure tree operators (C4, C13, C14, C15 acronyms).

The tree is a plain table (id, acronym, parent_structure_id,
structure_id_path, colour, ...). Descendant questions are answered with
set operations over the exploded id path instead of a driver-side walk, so
they work for a tree of any size and for many roots at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ephysframe.functions import hex_to_int


def structure_tree(raw: DataFrame) -> DataFrame:
    """Add ``color_hex_int``, ``color_hex_str`` and ``color_rgb`` (0..1)."""
    t = F.col("color_hex_triplet")
    inv255 = F.lit(1 / 255)  # multiply by 1/255 (not divide): same digits as the atlas helper
    channels = [hex_to_int(F.substring(t, start, 2)).cast("int") * inv255 for start in (1, 3, 5)]
    return raw.withColumns(
        {
            "color_hex_int": hex_to_int(t).cast("int"),
            "color_hex_str": F.concat(F.lit("0x"), t),
            "color_rgb": F.array(*channels),
        }
    )


def path_nodes(tree: DataFrame) -> DataFrame:
    """(id, node, pos): every ancestor-or-self ``node`` of ``id`` with its
    depth position along the id path ``/a0/a1/.../id/``."""
    parts = F.filter(F.split(F.col("structure_id_path"), "/"), lambda s: s != "")
    return tree.select("id", F.posexplode(parts).alias("pos", "node")).withColumn("node", F.col("node").cast("bigint"))


def immediate_children(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, id) for the direct children of each ``root_id``."""
    return roots.join(
        tree.select(F.col("parent_structure_id").alias("root_id"), "id"), "root_id"
    ).select("root_id", "id")


def frontier_descendants(tree: DataFrame, volume_ids: DataFrame, roots: DataFrame) -> DataFrame:
    """C4: (root_id, id) for each root: the root itself when it is labelled in
    the volume, otherwise the nearest labelled descendants along every path.
    Unlabelled leaves contribute nothing.

    Set form: keep a labelled node ``d`` under root ``r`` when no labelled
    proper ancestor of ``d`` sits at or below ``r``. One explode of the id
    paths, two semi-joins, one aggregate and one join; no loop.

    ``volume_ids`` has a column ``id``; ``roots`` has a column ``root_id``.
    """
    nodes = path_nodes(tree)
    vol = volume_ids.select(F.col("id").cast("bigint").alias("id")).distinct()
    labelled = nodes.join(vol, "id", "left_semi")  # paths of labelled nodes only
    labelled_ancestors = labelled.join(vol.withColumnRenamed("id", "node"), "node", "left_semi")
    last_labelled_proper = (
        labelled_ancestors.where(F.col("node") != F.col("id"))
        .groupBy("id")
        .agg(F.max("pos").alias("last_labelled_pos"))
    )
    under_root = labelled.join(roots.select(F.col("root_id").cast("bigint").alias("node")), "node").withColumnRenamed(
        "node", "root_id"
    )
    return (
        under_root.join(last_labelled_proper, "id", "left")
        .where(F.col("last_labelled_pos").isNull() | (F.col("pos") > F.col("last_labelled_pos")))
        .select("root_id", "id")
    )


def acronyms_to_ids(tree: DataFrame, keys: DataFrame, key_col: str = "acronym", strict: bool = True) -> DataFrame:
    """C14 acronym→id for every row of ``keys``. An unknown acronym fails
    the query (lazily, at execution) when ``strict``."""
    ids = tree.select(F.col("acronym").alias(key_col), "id").groupBy(key_col).agg(F.min("id").alias("id"))
    out = keys.join(ids, key_col, "left")
    if strict:
        out = out.withColumn(
            "id",
            F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("unknown acronym: "), F.col(key_col).cast("string"))))
            .otherwise(F.col("id")),
        )
    return out


def ids_to_acronyms(tree: DataFrame, keys: DataFrame, key_col: str = "id", strict: bool = True) -> DataFrame:
    """C14 id→acronym; a duplicated id resolves to its first acronym."""
    names = tree.select(F.col("id").alias(key_col), "acronym").groupBy(key_col).agg(F.min("acronym").alias("acronym"))
    out = keys.join(names, key_col, "left")
    if strict:
        out = out.withColumn(
            "acronym",
            F.when(F.col("acronym").isNull(), F.raise_error(F.concat(F.lit("unknown id: "), F.col(key_col).cast("string"))))
            .otherwise(F.col("acronym")),
        )
    return out


def structure_info(tree: DataFrame, keys: DataFrame, key_col: str = "acronym") -> DataFrame:
    """C14 full row per key (``acronym`` or ``id``); duplicates → first by id.
    An unknown key fails the query when it runs."""
    cols = tree.columns
    best = tree.groupBy(F.col(key_col)).agg(F.min_by(F.struct(*cols), F.col("id")).alias("row"))
    unknown = F.raise_error(F.concat(F.lit(f"no structure with {key_col} "), F.coalesce(F.col(key_col).cast("string"), F.lit("null"))))
    found = keys.join(best, key_col, "left").withColumn("row", F.when(F.col("row").isNull(), unknown).otherwise(F.col("row")))
    return found.select("row.*")


def volume_acronyms(tree: DataFrame, volume_ids: DataFrame) -> DataFrame:
    """C15 acronyms of the labels present in the volume."""
    return tree.join(volume_ids.select("id").distinct(), "id", "left_semi").select("acronym")
