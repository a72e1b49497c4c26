"""Domain tables derived from the driver's TPC-H-style tables.

The operators are written against the recording-metadata schema of
FIXTURES.md. To run them on the driver tables (and let their work grow with
those tables), each domain table is derived here by Spark from the given
parquet files. The mapping (which column plays which role) is fixed and
mirrored line for line by the SQL views in ``plans/oracle.py``.

| role | derived from |
|---|---|
| session | orders: o_orderkey, o_custkey, order date, priority split on '-' (null for every 50th key) |
| performance | lineitem per order: l_linenumber as block, l_quantity / l_discount as the two d-primes |
| units, electrodes | lineitem: supplier name as location, nation name as structure (null for every 29th part), probe letter from l_linenumber, position from quantity/discount/tax |
| electrode_groups | one per (order, probe): p_name of the smallest part key |
| structure tree | root → region → nation → supplier, ids by a fixed rule |
| voxels | one label per (ml, dv, ap) cell: the smallest supplier there, or a nation or region by its key |
| d-prime blocks | events: vis = value of ``view``, aud = value of ``click``, both from ``signup``; every 41st user unknown |
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ephysframe.operators.tree import structure_tree

# Thresholds used with these stand-in roles (the reference's
# own defaults are in operators/gates.py).
SESSION_GATE = {"exclude_keyword": "LOW", "min_dprime": (10.0, 0.02), "min_blocks": 1}
UNIT_GATE = {"max_isi": 0.08, "max_amp_cutoff": 0.08, "min_presence": 10.0}
UNIT_GATE_V1 = {"max_isi_count": 8.0, "max_amp_cutoff": 0.08, "min_presence": 10.0}
# Planes of the stand-in volume by axis; the outer ones are empty.
SHAPE = {"ml": 10, "dv": 12, "ap": 52}
COLOUR_MULTIPLIER = 40503
ROOT_ID = 4


# Schemas of the driver's tables (TESTDATA.md). Reading with an
# explicit schema skips the footer-inference job each scan would otherwise run.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = DRIVER_SCHEMAS.get(name)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def region_id(key: Column) -> Column:
    return key.cast("bigint") * 4 + 1


def nation_id(key: Column) -> Column:
    return key.cast("bigint") * 4 + 2


def supplier_id(key: Column) -> Column:
    return key.cast("bigint") * 4 + 3


def probe_of(linenumber: Column) -> Column:
    return F.concat(F.lit("probe"), F.char(linenumber + 64))


def session(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderkey") % 50 != 0, F.split(F.col("o_orderpriority"), "-")).alias("keywords"),
    )


def performance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").cast("bigint").alias("block_index"),
        F.col("l_quantity").alias("same_modal_dprime"),
        F.col("l_discount").alias("cross_modal_dprime"),
    )


def _located_lines(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, d, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )


def _position(prefix: str = "ccf_") -> dict[str, Column]:
    return {
        f"{prefix}ap": F.col("l_quantity") * 25,
        f"{prefix}dv": F.round(F.col("l_discount") * 100) * 25,
        f"{prefix}ml": F.round(F.col("l_tax") * 100) * 25,
    }


def units(spark: SparkSession, d: str) -> DataFrame:
    pos = _position()
    return _located_lines(spark, d).select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"),
        F.col("l_orderkey").alias("session_id"),
        probe_of(F.col("l_linenumber")).alias("electrode_group_name"),
        F.col("s_name").alias("location"),
        F.when(F.col("l_partkey") % 29 != 0, F.col("n_name")).alias("structure"),
        pos["ccf_ap"].alias("ccf_ap"),
        pos["ccf_dv"].alias("ccf_dv"),
        pos["ccf_ml"].alias("ccf_ml"),
        F.col("l_discount").alias("isi_violations_ratio"),
        F.round(F.col("l_discount") * 100).alias("isi_violations_count"),
        F.col("l_tax").alias("amplitude_cutoff"),
        F.col("l_quantity").alias("presence_ratio"),
    )


def electrodes(spark: SparkSession, d: str) -> DataFrame:
    pos = _position()
    return _located_lines(spark, d).select(
        F.col("l_orderkey").alias("session_id"),
        probe_of(F.col("l_linenumber")).alias("group_name"),
        pos["ccf_ap"].alias("x"),
        pos["ccf_dv"].alias("y"),
        pos["ccf_ml"].alias("z"),
        F.col("s_name").alias("location"),
        F.when(F.col("l_partkey") % 29 != 0, F.col("n_name")).alias("structure"),
    )


def electrode_groups(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name")
    first_part = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("p_partkey"))
    )
    return first_part.join(part, "p_partkey").select(
        F.col("l_orderkey").alias("session_id"),
        probe_of(F.col("l_linenumber")).alias("name"),
        F.col("p_name").alias("location"),
    )


def _colour(id_col: Column) -> Column:
    return F.lpad(F.upper(F.hex((id_col * COLOUR_MULTIPLIER) % 16777216)), 6, "0")


def raw_tree(spark: SparkSession, d: str) -> DataFrame:
    def rows(df: DataFrame, id_: Column, acronym: Column, kind: str, parent: Column, depth: int, path: Column) -> DataFrame:
        return df.select(
            id_.alias("id"),
            acronym.alias("acronym"),
            acronym.alias("name"),
            F.concat(F.lit(kind + " "), acronym).alias("safe_name"),
            parent.cast("bigint").alias("parent_structure_id"),
            F.lit(depth).cast("bigint").alias("depth"),
            path.alias("structure_id_path"),
        )

    root_path = F.lit(f"/{ROOT_ID}/")
    region = table(spark, d, "region")
    nation = table(spark, d, "nation")
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    r_id, n_id, s_id = region_id(F.col("r_regionkey")), nation_id(F.col("n_nationkey")), supplier_id(F.col("s_suppkey"))
    parts = [
        rows(spark.range(1), F.lit(ROOT_ID).cast("bigint"), F.lit("root"), "root", F.lit(None), 0, root_path),
        rows(region, r_id, F.col("r_name"), "region", F.lit(ROOT_ID), 1, F.concat(root_path, r_id.cast("string"), F.lit("/"))),
        rows(nation, n_id, F.col("n_name"), "nation", region_id(F.col("n_regionkey")), 2,
             F.concat(root_path, region_id(F.col("n_regionkey")).cast("string"), F.lit("/"), n_id.cast("string"), F.lit("/"))),
        rows(supplier, s_id, F.col("s_name"), "supplier", n_id, 3,
             F.concat(root_path, region_id(F.col("n_regionkey")).cast("string"), F.lit("/"), n_id.cast("string"), F.lit("/"),
                      s_id.cast("string"), F.lit("/"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("color_hex_triplet", _colour(F.col("id")))


def tree(spark: SparkSession, d: str) -> DataFrame:
    return structure_tree(raw_tree(spark, d))


def voxels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(
        F.round(F.col("l_tax") * 100).cast("int").alias("ml"),
        F.round(F.col("l_discount") * 100).cast("int").alias("dv"),
        F.col("l_quantity").cast("int").alias("ap"),
    ).agg(_label(F.min("l_suppkey")).alias("structure_id"))


def _label(supplier: Column) -> Column:
    """Most cells are labelled with a supplier, some with one of five nations or the first region above it."""
    return (
        F.when(supplier % 11 == 0, region_id(F.lit(0)))
        .when(supplier % 7 == 0, nation_id(supplier % 5 * 5))
        .otherwise(supplier_id(supplier))
    )


def dprime_blocks(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    day = F.col("ts").cast("date")
    return ev.select(
        F.col("event_id").alias("block_index"),
        F.when(F.col("user_id") % 41 != 0, F.col("user_id")).alias("subject_id"),
        day.alias("date"),
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format(day, "yyyy-MM-dd"), F.lit("0")).alias("session_id"),
        F.when(F.col("event_type").isin("view", "signup"), F.col("value")).alias("vis_intra_dprime"),
        F.when(F.col("event_type") == "click", F.col("value")).when(F.col("event_type") == "signup", F.col("value") * 2).alias(
            "aud_intra_dprime"
        ),
    )


# ------------------------------------------------------------ boards ---------
# sessions / assets / computations of the sorting board, folders / manifests
# / uploads of the upload board, probe inventory and QC files.

def board_sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "P", "behavior").otherwise("ecephys").alias("platform"),
    )


def assets(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").cast("string").alias("session_id"),
        F.concat(F.lit("raw_"), F.col("o_orderkey")).alias("asset_id"),
        F.lit("raw").alias("kind"),
        F.col("o_orderdate").alias("created"),
        F.lit(False).alias("failed"),
        F.lit(None).cast("array<string>").alias("sorted_probes"),
        F.lit(None).cast("string").alias("output"),
    )
    srt = table(spark, d, "lineitem").where(F.col("l_returnflag") != "N").select(
        F.col("l_orderkey").cast("string").alias("session_id"),
        F.concat_ws("_", F.lit("sorted"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("asset_id"),
        F.lit("sorted").alias("kind"),
        F.col("l_shipdate").alias("created"),
        (F.col("l_returnflag") == "A").alias("failed"),
        F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.char(i + 64)).alias("sorted_probes"),
        F.concat(F.lit("sorted "), F.col("l_linenumber"), F.lit(" probes")).alias("output"),
    )
    return raw.unionByName(srt)


def computations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    raw_id = F.concat(F.lit("raw_"), F.col("l_orderkey"))
    even = F.col("l_linenumber") % 2 == 0
    return li.select(
        F.concat_ws("_", F.lit("job"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("name"),
        F.when(F.col("l_returnflag") == "R", "trigger").otherwise("sorting").alias("capsule_or_pipeline_id"),
        (F.col("l_linestatus") == "O").alias("in_progress"),
        # some jobs list their asset twice
        F.array_repeat(F.struct(raw_id.alias("id")), F.when(F.col("l_linenumber") % 3 == 0, 2).otherwise(1)).alias("data_assets"),
        F.array(
            F.struct(
                F.when(even, "input data asset ID").otherwise("other").alias("name"),
                F.when(~even, "input_data_asset_ID").otherwise("x").alias("param_name"),
                raw_id.alias("value"),
            )
        ).alias("parameters"),
    )


def _folder() -> Column:
    """Folder of an order: some without a date, some with a dashed one, some with a subject of eight digits."""
    key = F.col("o_orderkey")
    subject = F.when(key % 11 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey"))
    day = (
        F.when(key % 17 == 0, F.lit(""))
        .when(key % 13 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_")))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_")))
    )
    return F.concat(F.lit("DRpilot_"), subject, F.lit("_"), day, key)


def folders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        _folder().alias("folder"),
        (F.col("o_orderstatus") != "P").alias("has_ephys"),
    )


def _manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderstatus") != "P")
    li = table(spark, d, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumns(
        {
            "folder": _folder(),
            "row": F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"),
        }
    )


def manifests(spark: SparkSession, d: str) -> list[DataFrame]:
    """Two header variants: ``acq-datetime``, or ``acq-date`` + ``acq-time``."""
    lines = _manifest_lines(spark, d)
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    v1 = lines.where(urgent).select(
        "folder", "row",
        F.when(F.col("l_returnflag") != "N", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("acq-datetime"),
    )
    v2 = lines.where(~urgent).select(
        "folder", "row",
        F.when(F.col("l_returnflag") != "N", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("acq-date"),
        F.when(F.col("l_returnflag") != "R", F.date_format("l_shipdate", "HH:mm:ss")).alias("acq-time"),
    )
    return [v1, v2]


def uploaded(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem").where(F.col("l_linestatus") == "F")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("ecephys_"), F.col("o_custkey"), F.lit("_"), F.date_format("l_shipdate", "yyyy-MM-dd_HH-mm-ss")).alias(
            "session_id"
        )
    )


def probes_current(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.concat(F.lit("P"), F.col("c_custkey")).alias("serial_number"),
        F.lit(None).cast("date").alias("date_installed"),
        F.lit(None).cast("date").alias("date_removed"),
        F.lit(None).cast("string").alias("issue"),
        F.col("c_mktsegment").alias("rig"),
        F.concat(F.lit("nation "), F.col("c_nationkey")).alias("storage_location"),
        (F.col("c_acctbal") < 0).alias("is_destroyed"),
    )


def probe_changes(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    day = F.col("ts").cast("date")
    return ev.select(
        F.concat(F.lit("P"), F.col("user_id") * 11).alias("serial_number"),
        F.col("ts").alias("changed_at"),
        "event_id",
        day.alias("date_installed"),
        F.when(F.col("event_type") == "signup", day).alias("date_removed"),
        F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.lit("")).alias("issue"),
        F.col("event_type").alias("rig"),
        F.lit("").alias("storage_location"),
        F.when(F.col("event_type") == "error", F.lit(True)).alias("is_destroyed"),
    )


def qc_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "qc/").alias("path"))


def qc_sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("_0")).alias("session_id"))
