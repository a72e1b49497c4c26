"""Scans, listings and sinks.

Everything here returns a lazy DataFrame; column pruning and filters reach
the Parquet scan because nothing is materialised in between.
"""

from __future__ import annotations

import csv
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_component(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Lazy Parquet scan of one named component table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(os.path.join(root, f"{name}.parquet"))


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "session_id") -> None:
    """A catalog table of ``df`` in buckets by ``key``, sorted by it within each.

    Tables of equal bucket numbers join on the key, or on keys that start with
    it, without a shuffle of either; choose the number so that a bucket fits a
    task's memory. Each bucket is written by one task.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row (S3). Pass a schema in production: inference
    costs a full extra pass and can mistype text such as colour codes."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", False)
    return reader.csv(path)


def read_csv_variants(spark: SparkSession, path: str | list[str], file_col: str = "file", row_col: str = "row", most: int = 64) -> list[DataFrame]:
    """CSV files whose headers differ, in one scan (S3): a DataFrame for each header.

    Each holds the file's path, the row's place in it and the header's columns
    as text. Only the distinct headers reach the driver, and more than ``most``
    of them is an error. A carriage return at a line's end and a byte order
    mark are dropped, a repeated header line is no row, and a file that has a
    header only gives one row of nulls, so that it is seen. Quoted fields may
    hold commas but no line feeds.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    lines = lines.select(
        F.regexp_replace("value", r"^\x{FEFF}|\r+$", "").alias("_line"), F.col("_metadata.file_path").alias("_path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("_at"),
    ).where(F.trim("_line") != "")
    # a file's first line lies in its first block
    heads = lines.groupBy(F.col("_path").alias(file_col)).agg(F.min_by("_line", "_at").alias("_head"))
    variants = [r["_head"] for r in heads.select("_head").distinct().orderBy("_head").limit(most + 1).collect()]
    if len(variants) > most:
        raise ValueError(f"more than {most} different headers under {path}")
    rows = heads.join(lines, (F.col("_path") == F.col(file_col)) & (F.col("_line") != F.col("_head")), "left")
    out = []
    for head in variants:
        names = [n.strip() or f"_c{i}" for i, n in enumerate(next(csv.reader([head])))]
        if len({n.lower() for n in [*names, file_col, row_col]}) < len(names) + 2:
            raise ValueError(f"repeated column in the header {head!r}")
        fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        parsed = rows.where(F.col("_head") == head).withColumn("_csv", F.from_csv("_line", fields.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
        out.append(parsed.select(file_col, F.col("_at").alias(row_col), *[F.col(f"_csv.c{i}").alias(n) for i, n in enumerate(names)]))
    return out


def parent_folder(c: str) -> F.Column:
    """Name of the folder that a file's path (with escapes, as Spark gives it) lies in."""
    return F.url_decode(F.replace(F.element_at(F.split(F.col(c), "/"), -2), F.lit("+"), F.lit("%2B")))


def list_entries(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files and folders directly under ``root`` whose names match a glob (S4): ``(name, path, is_folder)``.

    Listed by the file system that Spark reads ``root`` with, one call for the
    folder, so empty folders are rows too; nothing below them is listed. The
    names pass the driver, as they do when Spark lists a table's files.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root, pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    rows = [(f.getPath().getName(), f.getPath().toString(), f.isDirectory()) for f in found]
    return spark.createDataFrame(rows, "name string, path string, is_folder boolean")


def list_folders(spark: SparkSession, root: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """Folders directly under ``root`` (S4), empty ones too: ``(folder, path)``; ``exclude`` drops names containing that text."""
    out = list_entries(spark, root, pattern).where("is_folder").select(F.col("name").alias("folder"), "path")
    return out.where(~F.col("folder").contains(exclude)) if exclude else out


def list_files(spark: SparkSession, root: str, path_glob: str | None = None) -> DataFrame:
    """Recursive file listing (S5): one row per file, column ``path``.

    Uses the ``binaryFile`` source with only ``path`` selected, so file
    contents are never read; listing is distributed by Spark's file index.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    return reader.load(root).select("path")


def folder_names(files: DataFrame, root: str, *, prefix: str = "", exclude: str | None = None) -> DataFrame:
    """First-level folder names under ``root`` (S4), from a listing of files
    or of directories; a path of a directory ends in ``/``. A file directly
    under the root is no folder. Spark's listing has files only;
    :func:`list_folders` has empty folders as well.

    ``prefix`` is a literal start of the name (a ``DRpilot*`` glob);
    ``exclude`` drops names containing that text.
    """
    rel = F.regexp_replace(F.col("path"), r"^(file:)?/*" + re.escape(root.strip("/")) + "/?", "")
    name = F.split(rel, "/").getItem(0)
    out = files.where(F.size(F.split(rel, "/")) > 1).select(name.alias("folder")).where(F.col("folder") != "")
    if prefix:
        out = out.where(F.col("folder").startswith(prefix))
    if exclude:
        out = out.where(~F.col("folder").contains(exclude))
    return out.distinct()


def exists_flag(df: DataFrame, listing: DataFrame, key: str, flag: str) -> DataFrame:
    """Add boolean ``flag``: does ``key`` appear in ``listing``."""
    present = listing.select(F.col(key)).distinct().withColumn(flag, F.lit(True))
    return df.join(present, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))

