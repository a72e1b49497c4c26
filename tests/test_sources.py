"""Scans and listings."""

import pytest
from pyspark.sql import types as T

from ephysframe.sources import (
    exists_flag, folder_names, list_entries, list_files, list_folders, parent_folder, read_csv, read_csv_variants,
)


def test_csv_schema_keeps_colour_text(spark, tmp_path):
    p = tmp_path / "tree.csv"
    p.write_text("id,acronym,color_hex_triplet\n1,A,000123\n2,B,1F9D5A\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("acronym", T.StringType()),
                           T.StructField("color_hex_triplet", T.StringType())])
    rows = read_csv(spark, str(p), schema).collect()
    assert [r.color_hex_triplet for r in rows] == ["000123", "1F9D5A"]


def test_listing_folders_and_flags(spark, tmp_path):
    root = tmp_path / "ephys"
    for rel in ("DRpilot_1_20230101/a.txt", "DRpilot_1_20230101/DRpilot_1_20230101/b.bin",
                "DRpilot_366122_20230102/c.txt", "Other_2/d.txt", "DRpilot_3_20230103/e.txt", "DRpilot_file.txt"):
        f = root / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    files = list_files(spark, str(root))
    assert files.columns == ["path"] and files.count() == 6
    names = sorted(r.folder for r in folder_names(files, str(root), prefix="DRpilot", exclude="366122").collect())
    assert names == ["DRpilot_1_20230101", "DRpilot_3_20230103"]
    folders = spark.createDataFrame([(f"{root}/DRpilot_empty/",), (f"{root}/DRpilot_x",)], "path string")
    assert [r.folder for r in folder_names(folders, str(root)).collect()] == ["DRpilot_empty"]
    listing = spark.createDataFrame([("DRpilot_1_20230101",)], "folder string")
    flagged = exists_flag(folder_names(files, str(root), prefix="DRpilot"), listing, "folder", "started")
    assert {r.folder: r.started for r in flagged.collect()} == {
        "DRpilot_1_20230101": True, "DRpilot_366122_20230102": False, "DRpilot_3_20230103": False}


def test_folders_with_an_empty_one(spark, tmp_path):
    root = tmp_path / "ephys"
    for rel in ("DRpilot_1/a.txt", "DRpilot_366122/b.txt", "DRpilot_3/DRpilot_3/c.bin", "Other/d.txt"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text("x")
    (root / "DRpilot_empty").mkdir()
    (root / "DRpilot_file.txt").write_text("x")
    found = {r.folder for r in list_folders(spark, str(root), "DRpilot*", "366122").collect()}
    assert found == {"DRpilot_1", "DRpilot_3", "DRpilot_empty"}
    assert {(r.name, r.is_folder) for r in list_entries(spark, f"file://{root}").collect()} == {
        ("DRpilot_1", True), ("DRpilot_366122", True), ("DRpilot_3", True), ("Other", True), ("DRpilot_empty", True), ("DRpilot_file.txt", False)}
    assert list_folders(spark, str(root / "DRpilot_empty")).collect() == []
    assert list_folders(spark, str(root / "absent")).collect() == []


def test_csv_files_with_different_headers(spark, tmp_path):
    for name, data in {"a b+1": "x,y\n1,\"p, q\"\n,2\n", "b": "x,y\r\n3,4\r\n", "c": "﻿y,x\n5,6\nx\n7\n", "d": "x,y\n", "e": "z \nx,y\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "upload.csv").write_bytes(data.encode())
    found = read_csv_variants(spark, f"{tmp_path}/*/upload.csv")
    got = {tuple(m.columns[2:]): m.withColumn("folder", parent_folder("file")).orderBy("folder", "row").collect() for m in found}
    assert set(got) == {("x", "y"), ("y", "x"), ("z",)}
    assert [(r.folder, r.x, r.y) for r in got["x", "y"]] == [("a b+1", "1", "p, q"), ("a b+1", None, "2"), ("b", "3", "4"), ("d", None, None)]
    assert [(r.y, r.x) for r in got["y", "x"]] == [("5", "6"), ("x", None), ("7", None)]
    with pytest.raises(ValueError, match="more than 2"):
        read_csv_variants(spark, f"{tmp_path}/*/upload.csv", most=2)
    (tmp_path / "b" / "upload.csv").write_text("x,X\n1,2\n")
    with pytest.raises(ValueError, match="repeated column"):
        read_csv_variants(spark, f"{tmp_path}/b/upload.csv")


def test_rows_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "m.csv").write_text("n,t\n" + "".join(f"{i},line {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        (found,) = read_csv_variants(spark, str(tmp_path / "m.csv"))
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "m.csv")).rdd.getNumPartitions() > 1
        assert [int(r.n) for r in found.orderBy("row").collect()] == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
