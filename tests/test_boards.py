"""Status boards, inventory and QC manifest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ephysframe.operators import inventory, qc, status

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def test_find_sessions(spark):
    s = spark.createDataFrame(
        [("a", "614910", dt.date(2024, 1, 5), "ecephys"), ("b", "614910", dt.date(2024, 3, 5), "ecephys"),
         ("c", "1", dt.date(2024, 1, 5), "behavior")],
        "id string, subject_id string, date date, platform string",
    )
    assert [r.id for r in status.find_sessions(s, "614910", "2024-01-05").collect()] == ["a"]
    assert sorted(r.id for r in status.find_sessions(s, "x614910, 1", None, "2024-01-01").collect()) == ["a", "b"]
    assert status.find_sessions(s, "", "2024-01-05").count() == 0


def test_sorting_status(spark):
    sessions = spark.createDataFrame([("s1", "1"), ("s2", "1"), ("s3", "2")], "id string, subject_id string")
    assets = spark.createDataFrame(
        [("s1", "raw1", "raw", T0, False, None, None), ("s1", "srt1", "sorted", T0, True, ["A"], "old"),
         ("s1", "srt2", "sorted", T1, False, ["A", "B"], "log"), ("s2", "raw2", "raw", T0, False, None, None),
         ("s2", "srt3", "sorted", T1, False, ["A"], "x"), ("s3", "srt4", "sorted", T1, False, ["C"], "y")],
        "session_id string, asset_id string, kind string, created timestamp, failed boolean, "
        "sorted_probes array<string>, output string",
    )
    comps = spark.createDataFrame(
        [("job", "sorting", True, [("raw2",), ("raw2",)], []), ("done", "sorting", False, [("raw1",)], [])],
        "name string, capsule_or_pipeline_id string, in_progress boolean, data_assets array<struct<id:string>>, "
        "parameters array<struct<name:string,param_name:string,value:string>>",
    )
    rows = {r.session: r for r in status.sorting_status(sessions, assets, comps).collect()}
    s1, s2, s3 = rows["s1"], rows["s2"], rows["s3"]
    assert (s1.latest_sorted_asset, s1.jobs_running, s1.success, s1.complete_probe_data) == ("srt2", [], True, ["A", "B"])
    # the job names its asset twice and counts once
    assert (s2.jobs_running, s2.success, s2.complete_probe_data, s2.needs_attention) == (["job"], None, None, True)
    assert (s3.raw_asset, s3.latest_sorted_asset, s3.jobs_running) == (None, None, None)
    assert [r.session for r in status.sorting_status(sessions, assets, comps).collect()] == ["s1", "s2", "s3"]
    assert "sorting jobs in progress: job" in s2.detail and "output:\nlog" in s1.detail


def test_already_triggered(spark):
    comps = spark.createDataFrame(
        [("j1", "trigger", True, [], [("input data asset ID", None, "a1")]),
         ("j2", "trigger", True, [], [(None, "input_data_asset_ID", "a2")]),
         ("j3", "trigger", True, [], [("other", "other", "a3")]),
         ("j4", "trigger", False, [], [("input data asset ID", None, "a4")])],
        "name string, capsule_or_pipeline_id string, in_progress boolean, data_assets array<struct<id:string>>, "
        "parameters array<struct<name:string,param_name:string,value:string>>",
    )
    assert {(r.asset_id, r.job_name) for r in status.already_triggered(comps).collect()} == {("a1", "j1"), ("a2", "j2")}


def test_upload_status_header_variants(spark):
    folders = spark.createDataFrame([("DRpilot_644864_20230201", True), ("DRpilot_644865_20230301", False),
                                     ("DRpilot_644866_20230401", True)], "folder string, has_ephys boolean")
    v1 = spark.createDataFrame([("DRpilot_644864_20230201", 0, None), ("DRpilot_644864_20230201", 1, "2023-02-01 10:11:12")],
                               "folder string, row int, `acq-datetime\r` string")
    v2 = spark.createDataFrame([("DRpilot_644865_20230301", 0, "2023-03-01", None), ("DRpilot_644865_20230301", 1, None, "09:00:00")],
                               "folder string, row int, `acq-date` string, `acq-time` string")
    uploaded = spark.createDataFrame([("ecephys_644864_2023-02-01_10-11-12",)], "session_id string")
    rows = {r.folder: r for r in status.upload_status(folders, [v1, v2], uploaded).collect()}
    a, b, c = rows["DRpilot_644864_20230201"], rows["DRpilot_644865_20230301"], rows["DRpilot_644866_20230401"]
    assert (a.subject, a.date, a.started, a.upload_session_id, a.finished) == (
        "644864", dt.date(2023, 2, 1), True, "ecephys_644864_2023-02-01_10-11-12", True)
    assert (b.upload_session_id, b.finished) == ("ecephys_644865_2023-03-01_09-00-00", False)
    assert (c.started, c.upload_session_id, c.finished) == (False, None, None)
    un = status.upload_status(folders, [v1, v2], uploaded, ephys_only=True, unstarted_only=True).collect()
    assert [r.folder for r in un] == ["DRpilot_644866_20230401"]
    bad = spark.createDataFrame([("f", 0, "x")], "folder string, row int, other string")
    with pytest.raises(ValueError):
        status.manifest_datetime(bad)


def test_dates_in_folder_names(spark):
    names = {"DRpilot_1_20230201": dt.date(2023, 2, 1), "DRpilot_1": None, "DRpilot_12345678_20230201_1": dt.date(2023, 2, 1),
             "DRpilot_1_2023-02-01_5": dt.date(2023, 2, 1), "DRpilot_1_20230231": None, "DRpilot_1_120230201": None}
    folders = spark.createDataFrame([(n, True) for n in names], "folder string, has_ephys boolean")
    manifest = spark.createDataFrame([], "folder string, row int, `acq-datetime` string")
    out = status.upload_status(folders, [manifest], spark.createDataFrame([], "session_id string")).collect()
    assert {r.folder: r.date for r in out} == names
    assert {r.folder: r.subject for r in out}["DRpilot_12345678_20230201_1"] == "12345678"
    assert status.recording_folders(spark.createDataFrame([("DRpilot_366122_x", True), ("x", True), ("DRpilot_1", True)], folders.schema)).count() == 1


def test_column_filters_and_session_table(spark):
    df = spark.createDataFrame([("abc", 1, True), ("xbz", 5, False), ("b", 9, None)], "s string, n int, f boolean")
    got = status.column_filters(df, {"s": ("like", "b"), "n": ("<", 9), "f": ("bool", None)}).collect()
    assert sorted(r.s for r in got) == ["abc", "xbz"]
    assert [r.s for r in status.column_filters(df, {"f": ("bool", False)}).collect()] == ["xbz"]
    s = spark.createDataFrame([("a",), ("c",), ("b",)], "session_id string")
    assert [r.session_id for r in status.session_table(s).collect()] == ["c", "b", "a"]


CHANGE_COLS = ("serial_number string, changed_at timestamp, date_installed date, date_removed date, issue string, "
               "rig string, storage_location string, is_destroyed boolean")


def test_inventory_apply_and_store(spark, tmp_path):
    first, second, third = (str(tmp_path / x) for x in "abc")
    inventory.create_if_missing(spark, first)
    assert inventory.read_inventory(spark, first).count() == 0
    batch = spark.createDataFrame(
        [("P1", T0, dt.date(2024, 1, 1), None, "", "NP1", "", None),
         ("P1", T1, dt.date(2024, 1, 2), None, "bent", "NP2", "shelf", None),  # duplicate in one batch: last wins
         ("P2", T0, dt.date(2024, 1, 3), None, None, "NP3", None, True)],
        CHANGE_COLS,
    )
    inventory.write_inventory(inventory.inventory_apply(inventory.read_inventory(spark, first), batch, ["changed_at"]), second)
    inventory.create_if_missing(spark, second)  # leaves it as it is
    rows = {r.serial_number: r for r in inventory.read_inventory(spark, second).collect()}
    assert rows["P1"].rig == "NP2" and rows["P1"].issue == "bent" and rows["P1"].is_destroyed is False
    assert rows["P2"].is_destroyed is True and rows["P2"].issue is None
    edit = spark.createDataFrame([("P2", T1, dt.date(2024, 1, 3), dt.date(2024, 5, 1), "", "", "", False)], CHANGE_COLS)
    inventory.write_inventory(inventory.inventory_apply(inventory.read_inventory(spark, second), edit, ["changed_at"]), third)
    rows = {r.serial_number: r for r in inventory.read_inventory(spark, third).collect()}
    assert len(rows) == 2 and rows["P2"].rig is None and rows["P2"].date_removed == dt.date(2024, 5, 1)


def test_qc_prefix_shared_by_all_files(spark):
    files = spark.createDataFrame([("q/" + "a" * 3000 + f"{i}.png",) for i in range(20)], "path string")
    sessions = spark.createDataFrame([("a" * 3000 + "_0",), ("b_0",)], "session_id string")
    assert qc.qc_manifest(files, sessions, root="q").count() == 20


def test_qc_manifest(spark):
    files = spark.createDataFrame(
        [("/qc/636766_2023-01-23/probeA/unit_rates.png",), ("/qc/636766_2023-01-23/x.json",),
         ("/qc/636766_2023-01-23_plotly.json",), ("/qc/.vscode/636766_2023-01-23.png",),
         ("/qc/636766_2023-01-23_drift_map.png",), ("/qc/636766_2023-01-23_notes.txt",), ("/qc/999_x.png",)],
        "path string",
    )
    sessions = spark.createDataFrame([("636766_2023-01-23_0",), ("000_2023_01",)], "session_id string")
    out = {r.path: r for r in qc.qc_manifest(files, sessions, root="/qc").collect()}
    assert set(out) == {"/qc/636766_2023-01-23_plotly.json", "/qc/636766_2023-01-23_drift_map.png",
                        "/qc/636766_2023-01-23_notes.txt"}
    assert out["/qc/636766_2023-01-23_drift_map.png"].kind == "figure"
    assert out["/qc/636766_2023-01-23_drift_map.png"].title == "636766 2023-01-23 drift map"
    assert out["/qc/636766_2023-01-23_plotly.json"].kind is None
    assert out["/qc/636766_2023-01-23_drift_map.png"].depth == 0
    assert sum(r.is_first for r in out.values()) == 1


def test_upload_board_from_folders(spark, tmp_path):
    """Folders are listed (an empty one too), manifests of three headers are read, and one without a date-time is rejected."""
    recordings, uploads = tmp_path / "ephys", tmp_path / "uploads"
    for rel in ("DRpilot_100001_20240101/DRpilot_100001_20240101", "DRpilot_100002_20240102/x", "DRpilot_100003_20240103", "DRpilot_100004_20240104",
                "DRpilot_366122_20240105", "Other_1"):
        (recordings / rel).mkdir(parents=True)
    (recordings / "DRpilot_note.txt").write_text("x")
    for folder, data in {
        "DRpilot_100001_20240101": "platform,acq-datetime\necephys,\necephys,2024-01-01 10:00:00\n",
        "DRpilot_100002_20240102": "acq-datetime\r\n2024-01-02 11:00:00\r\n",
        "DRpilot_100003_20240103": "acq-date,acq-time\n2024-01-03,12:00:00\n",
    }.items():
        (uploads / folder).mkdir(parents=True)
        (uploads / folder / "upload.csv").write_bytes(data.encode())
    done = spark.createDataFrame([("ecephys_100002_2024-01-02_11-00-00",)], "session_id string")
    rows = status.upload_board(spark, str(recordings), str(uploads), done).collect()
    assert [(r.folder, r.ephys, r.started, r.upload_session_id, r.finished) for r in rows] == [
        ("DRpilot_100004_20240104", False, False, None, None),
        ("DRpilot_100003_20240103", False, True, "ecephys_100003_2024-01-03_12-00-00", False),
        ("DRpilot_100002_20240102", False, True, "ecephys_100002_2024-01-02_11-00-00", True),
        ("DRpilot_100001_20240101", True, True, "ecephys_100001_2024-01-01_10-00-00", False),
    ]
    (uploads / "DRpilot_100004_20240104").mkdir()
    (uploads / "DRpilot_100004_20240104" / "upload.csv").write_text("subject,platform\n1,2\n")
    with pytest.raises(ValueError, match="no datetime column"):
        status.upload_board(spark, str(recordings), str(uploads), done)


def test_inventory_table_in_place(spark):
    name = "probes_in_place"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    inventory.create_table(spark, name)
    inventory.create_table(spark, name)
    assert inventory.column_defaults(spark, name)["is_destroyed"] == "false"
    batch = spark.createDataFrame([("P1", T0, "NP1", ""), ("P1", T1, "NP2", "bent"), ("P2", T0, "NP3", None)], "serial_number string, changed_at timestamp, rig string, issue string")
    inventory.apply_to_table(spark, name, batch, ["changed_at"])
    read = lambda: {r.serial_number: r for r in spark.table(name).collect()}
    assert [(k, r.rig, r.issue, r.is_destroyed, r.date_installed) for k, r in sorted(read().items())] == [
        ("P1", "NP2", "bent", False, None), ("P2", "NP3", None, False, None)]
    # an edit that lacks columns keeps them; the table is replaced where it is read
    edit = spark.createDataFrame([("P2", T1, True), ("P3", T1, None)], "serial_number string, changed_at timestamp, is_destroyed boolean")
    inventory.apply_to_table(spark, name, edit, ["changed_at"])
    assert [(k, r.rig, r.is_destroyed) for k, r in sorted(read().items())] == [("P1", "NP2", False), ("P2", "NP3", True), ("P3", None, None)]
    before = read()
    # failing batches leave the old rows: a repeated key, a null key, an unknown column, a row that cannot be computed
    rows = spark.table(name)
    failing = F.when(F.col("serial_number") == "P2", F.raise_error(F.lit("bad row"))).otherwise(F.col("rig"))
    for bad in (rows.union(rows.limit(1)), rows.withColumn("serial_number", F.lit(None).cast("string")), rows.withColumn("colour", F.lit(1)), rows.withColumn("rig", failing)):
        with pytest.raises(Exception):
            inventory.replace_table(spark, name, bad)
        spark.catalog.refreshTable(name)
        assert read() == before
    inventory.replace_table(spark, name, rows.where("serial_number <> 'P1'").select("serial_number", "rig"))
    assert [(k, r.rig, r.is_destroyed) for k, r in sorted(read().items())] == [("P2", "NP3", False), ("P3", None, False)]
    spark.sql(f"DROP TABLE {name}")
