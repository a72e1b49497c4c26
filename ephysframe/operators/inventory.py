"""Probe inventory: keyed table with edits and additions.

The dashboard kept a SQLite table. Here it is a catalog table with column
defaults: a change batch is merged by key, staged, checked and then put in the
table's place. A plain Parquet folder can be read and written as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ephysframe.functions import blank_to_null
from ephysframe.session import checkpoint_dir
from ephysframe.sources.schemas import PROBES

KEY = "serial_number"
TEXT_COLUMNS = ("issue", "rig", "storage_location")


def latest_per_key(changes: DataFrame, order: list[str], key: str = KEY) -> DataFrame:
    """Last change per key by ``order``: a grouped ``max_by`` (partial
    aggregate), not a window, so a hot key never gathers its rows in one
    task."""
    cols = [c for c in changes.columns if c != key]
    return (
        changes.groupBy(key)
        .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
        .select(key, "_row.*")
    )


def normalise(df: DataFrame) -> DataFrame:
    """Blank text → null; ``is_destroyed`` defaults to false."""
    return df.withColumns({c: blank_to_null(c) for c in TEXT_COLUMNS}).withColumn(
        "is_destroyed", F.coalesce(F.col("is_destroyed"), F.lit(False))
    )


def inventory_apply(current: DataFrame, changes: DataFrame, order: list[str], key: str = KEY) -> DataFrame:
    """Edits replace the row with the same key, new keys are appended;
    within one batch the last change per key wins."""
    cols = [f.name for f in PROBES.fields]
    latest = normalise(latest_per_key(changes, order, key)).select(*cols)
    kept = current.join(latest.select(key), key, "left_anti").select(*cols)
    return kept.unionByName(latest)


def as_text_dates(df: DataFrame, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """The inventory shown with its dates as text, as the form stored them."""
    dates = [f.name for f in df.schema.fields if f.dataType.typeName() == "date"]
    return df.withColumns({c: F.date_format(c, fmt) for c in dates})


def create_if_missing(spark: SparkSession, path: str) -> None:
    """An empty inventory at ``path`` unless there is one."""
    spark.createDataFrame([], PROBES).coalesce(1).write.mode("ignore").parquet(path)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The inventory at ``path``."""
    return spark.read.schema(PROBES).parquet(path)


def write_inventory(df: DataFrame, path: str) -> None:
    """Write the inventory to ``path``, which must not be where it is read from."""
    df.select(*[f.name for f in PROBES.fields]).write.mode("overwrite").parquet(path)


# Column defaults of the inventory; the others default to null.
DEFAULTS = {"is_destroyed": "false"}


def create_table(spark: SparkSession, name: str) -> None:
    """The catalog table ``name`` with its column defaults, unless there is one."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()} DEFAULT {DEFAULTS.get(f.name, 'NULL')}" for f in PROBES.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def column_defaults(spark: SparkSession, name: str) -> dict[str, str]:
    """SQL text of each column's default in the catalog."""
    return {f.name: f.metadata.get("CURRENT_DEFAULT", "NULL") for f in spark.table(name).schema.fields}


def check_key(df: DataFrame, key: str = KEY, shown: int = 5) -> None:
    """Fail if a key is null or occurs twice: one grouped count, of which at most ``shown`` keys are returned."""
    twice = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).orderBy(key).limit(shown).collect()
    if twice:
        raise ValueError(f"{key} is null or repeated: {[(r[key], r['count']) for r in twice]}")


def replace_table(spark: SparkSession, name: str, rows: DataFrame, key: str = KEY) -> None:
    """Put ``rows`` in the place of all rows of the table, which ``rows`` may be read from.

    The rows are first written to the shared folder and checked there, so a
    batch that cannot be computed or has a repeated or null key fails while
    the table still has its old rows. Columns that ``rows`` lacks get their
    defaults; an unknown column fails.
    """
    known = spark.table(name).columns
    unknown = [c for c in rows.columns if c not in known]
    if unknown:
        raise ValueError(f"{name} has no columns {unknown}")
    stage = f"{checkpoint_dir(spark).rstrip('/')}/inventory-{uuid.uuid4().hex}"
    rows.write.parquet(stage)
    staged = spark.read.schema(rows.schema).parquet(stage)
    check_key(staged, key)
    columns = ", ".join(f"`{c}`" for c in rows.columns)
    spark.sql(f"INSERT OVERWRITE TABLE {name} ({columns}) SELECT {columns} FROM {{staged}}", staged=staged)
    spark.catalog.refreshTable(name)


def apply_to_table(spark: SparkSession, name: str, changes: DataFrame, order: list[str], key: str = KEY) -> None:
    """C25 in place: the table with a batch of edits and additions merged in.

    A column that the batch lacks keeps its value in an edited row and gets
    its default in a new one. Blank text is stored as null.
    """
    current, given = spark.table(name), [c for c in changes.columns if c not in order or c in PROBES.names]
    latest = latest_per_key(changes.select(*dict.fromkeys([*given, *order])), order, key)
    latest = latest.withColumns({c: blank_to_null(c) for c in TEXT_COLUMNS if c in given}).select(*given, F.lit(True).alias("_edited"))
    old = current.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_old_{c}") for c in current.columns], F.lit(True).alias("_known"))
    both = old.join(latest, F.col("_key") == F.col(key), "full")
    defaults = column_defaults(spark, name)

    def value(c: str):
        kept = F.col(f"_old_{c}")
        if c in given:
            return F.when(F.col("_edited"), F.col(c)).otherwise(kept).alias(c)
        default = F.expr(defaults[c]).cast(current.schema[c].dataType)
        return F.when(F.col("_known"), kept).otherwise(default).alias(c)

    replace_table(spark, name, both.select(*[value(c) for c in current.columns]), key)
