"""Status boards: sorting jobs, upload progress, session lookup
(C21, C22, C23, C24, C28, C31).

The dashboards built these boards with one thread-pool task and several
service calls per session. Here the services are input tables (sessions,
data assets, computations, folder listing, manifests) and the fan-out is
joins, so a board over millions of sessions is a handful of shuffles.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ephysframe.functions import all_of
from ephysframe.sources import exists_flag, list_entries, list_folders, parent_folder, read_csv_variants

# Parameter names that carry the input asset of a trigger job.
TRIGGER_PARAMETER_NAME = "input data asset ID"
TRIGGER_PARAMETER_KEY = "input_data_asset_ID"


def extract_subject(text: str) -> str | None:
    """Subject id typed by a user: the first run of digits, else None."""
    m = re.search(r"\d+", text or "")
    return m.group(0) if m else None


def find_sessions(
    sessions: DataFrame,
    subject_id: str = "",
    specific_date: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    platform: str = "ecephys",
) -> DataFrame:
    """Distinct sessions of the comma separated subjects on the
    platform; a specific date wins over a start/end range. No subject (or
    no filter at all) gives no rows."""
    subjects = sorted({s for s in (extract_subject(x) for x in (subject_id or "").split(",")) if s})
    if not subjects:
        return sessions.where(F.lit(False))
    preds: list[Column] = [F.col("subject_id").isin(*subjects), F.col("platform") == platform]
    if specific_date:
        preds.append(F.col("date") == F.to_date(F.lit(specific_date)))
    else:
        if start_date:
            preds.append(F.col("date") >= F.to_date(F.lit(start_date)))
        if end_date:
            preds.append(F.col("date") <= F.to_date(F.lit(end_date)))
    return sessions.where(all_of(preds)).distinct()


def _latest(assets: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """Latest asset of a kind per session (by created, then asset id)."""
    order = F.struct("created", "asset_id")
    return (
        assets.where(F.col("kind") == kind)
        .groupBy("session_id")
        .agg(F.max_by(F.struct(*fields), order).alias("a"))
        .select("session_id", *[F.col(f"a.{f}").alias(f) for f in fields])
    )


def sorting_status(
    sessions: DataFrame,
    assets: DataFrame,
    computations: DataFrame,
    pipeline_id: str = "sorting",
) -> DataFrame:
    """Per session: raw asset, latest sorted asset, running sorting
    jobs on the raw asset, success (= latest sorted asset not failed) and
    its completed probes.

    No raw asset → jobs and sorted asset stay null. A running job blanks
    success and probes. ``needs_attention`` flags rows whose success is not
    true; ``detail`` is the per-session text of the expanded row.

    ``jobs_running`` is the sorted list of the running jobs' names, bounded
    by the jobs of one raw asset; a job that names an asset twice counts
    once. Rows come sorted by session.
    """
    raw = _latest(assets, "raw", ["asset_id"]).withColumnRenamed("asset_id", "raw_asset")
    srt = _latest(assets, "sorted", ["asset_id", "failed", "sorted_probes", "output"]).withColumnRenamed(
        "asset_id", "sorted_asset"
    )
    running = (
        computations.where(F.col("in_progress") & (F.col("capsule_or_pipeline_id") == pipeline_id))
        .select("name", F.explode(F.array_distinct(F.col("data_assets.id"))).alias("raw_asset"))
    )
    jobs = raw.join(running, "raw_asset").groupBy("session_id").agg(F.array_sort(F.collect_list("name")).alias("_jobs"))
    has_raw = F.col("raw_asset").isNotNull()
    jobs_running = F.when(has_raw, F.coalesce(F.col("_jobs"), F.array().cast("array<string>")))
    busy = F.coalesce(F.size(F.col("_jobs")) > 0, F.lit(False))
    df = (
        sessions.select(F.col("id").alias("session"), F.col("subject_id").alias("subject"))
        .join(raw.withColumnRenamed("session_id", "session"), "session", "left")
        .join(srt.withColumnRenamed("session_id", "session"), "session", "left")
        .join(jobs.withColumnRenamed("session_id", "session"), "session", "left")
        .withColumn("jobs_running", jobs_running)
    )
    success = F.when(busy, F.lit(None).cast("boolean")).otherwise(~F.col("failed"))
    probes = F.when(busy, F.lit(None).cast("array<string>")).otherwise(F.col("sorted_probes"))
    # fixed values: the texts of the expanded row
    detail = F.concat_ws(
        "\n",
        F.when(has_raw, F.concat(F.lit("raw asset ID: "), F.col("raw_asset"))),
        F.when(busy, F.concat(F.lit("sorting jobs in progress: "), F.array_join("jobs_running", ", ")))
        .when(F.col("output").isNull(), F.lit("no sorted data found"))
        .otherwise(F.concat(F.lit("sorted asset ID: "), F.col("sorted_asset"), F.lit("\n\noutput:\n"), F.col("output"))),
    )
    return df.select(
        "subject",
        "session",
        "raw_asset",
        F.when(has_raw, F.col("sorted_asset")).alias("latest_sorted_asset"),
        "jobs_running",
        success.alias("success"),
        probes.alias("complete_probe_data"),
        (~F.coalesce(success, F.lit(False))).alias("needs_attention"),
        detail.alias("detail"),
    ).orderBy("session")


def already_triggered(computations: DataFrame, trigger_id: str = "trigger") -> DataFrame:
    """(asset_id, job_name) of running trigger jobs, from the parameter
    named ``input data asset ID`` or keyed ``input_data_asset_ID``. One
    job per asset (the greatest name, as a deterministic 'last wins')."""
    params = computations.where(F.col("in_progress") & (F.col("capsule_or_pipeline_id") == trigger_id)).select(
        "name", F.explode("parameters").alias("p")
    )
    hits = params.where((F.col("p.name") == TRIGGER_PARAMETER_NAME) | (F.col("p.param_name") == TRIGGER_PARAMETER_KEY))
    return hits.groupBy(F.col("p.value").alias("asset_id")).agg(F.max("name").alias("job_name"))


def manifest_datetime(manifest: DataFrame, folder_col: str = "folder", row_col: str = "row") -> DataFrame:
    """Acquisition date-time per folder from one manifest variant.

    Header drift is resolved from the schema: a column whose name contains
    ``acq-datetime`` gives its first non-null value (in row order);
    otherwise ``acq-date`` and ``acq-time`` give ``date_time``; otherwise
    the manifest is rejected.
    """
    cols = [c for c in manifest.columns if c not in (folder_col, row_col)]

    def first_non_null(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.min_by(c, F.when(c.isNotNull(), F.col(row_col)))

    dt_cols = [c for c in cols if "acq-datetime" in c]
    if dt_cols:
        value = first_non_null(dt_cols[0])
    elif "acq-date" in cols and "acq-time" in cols:
        value = F.concat(first_non_null("acq-date"), F.lit("_"), first_non_null("acq-time"))
    else:
        raise ValueError(f"no datetime column found in manifest columns {cols}")
    return manifest.groupBy(folder_col).agg(value.alias("acq_datetime"))


def read_manifests(spark: SparkSession, root: str, name: str = "upload.csv") -> list[DataFrame]:
    """C24's manifests ``<root>/<folder>/<name>``: one DataFrame for each header found, with ``folder`` and ``row``.

    A header without a date-time column is rejected here, with the header.
    """
    found = [m.withColumn("folder", parent_folder("file")).drop("file") for m in read_csv_variants(spark, f"{root.rstrip('/')}/*/{name}")]
    for m in found:
        manifest_datetime(m)
    return found


def upload_board(spark: SparkSession, recordings: str, uploads: str, uploaded: DataFrame, prefix: str = "DRpilot", exclude: str | None = "366122",
                 **shown) -> DataFrame:
    """C24 from the folders themselves: recordings are listed, empty ones too, and the manifests under ``uploads`` are read.

    A recording has ephys data if it holds a folder of its own name.
    """
    folders = list_folders(spark, recordings, f"{prefix}*", exclude).select("folder")
    inner = list_entries(spark, recordings, f"{prefix}*/{prefix}*").select(
        F.col("name").alias("folder"), F.element_at(F.split("path", "/"), -2).alias("outer"))
    own = inner.where(F.col("folder") == F.col("outer")).select("folder")
    folders = exists_flag(folders, own, "folder", "has_ephys")
    return upload_status(folders, read_manifests(spark, uploads), uploaded, **shown)


def recording_folders(folders: DataFrame, prefix: str = "DRpilot", exclude: str | None = "366122") -> DataFrame:
    """C24's folders: names with the prefix and without the excluded text."""
    out = folders.where(F.col("folder").startswith(prefix))
    return out.where(~F.col("folder").contains(exclude)) if exclude else out


#: A date with or without dashes, not part of a longer run of digits.
DATE_IN_NAME = r"(?:^|\D)((?:19|20)\d{2})-?(0[1-9]|1[0-2])-?(0[1-9]|[12]\d|3[01])(?:\D|$)"


def date_in_name(c: str | Column) -> Column:
    """The first date written in a name, or null."""
    parts = [F.regexp_extract(c, DATE_IN_NAME, i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")


def upload_status(
    folders: DataFrame,
    manifests: list[DataFrame],
    uploaded: DataFrame,
    *,
    ephys_only: bool = False,
    unstarted_only: bool = False,
) -> DataFrame:
    """Per recording folder: subject, ephys flag, date, whether the
    upload started (a manifest exists), the session id
    ``ecephys_{subject}_{datetime}`` and whether it finished (id present in
    ``uploaded``). Newest first; a folder without a date has a null date."""
    dts = reduce(DataFrame.unionByName, [manifest_datetime(m) for m in manifests]).withColumn(
        "dt", F.replace(F.replace(F.col("acq_datetime"), F.lit(":"), F.lit("-")), F.lit(" "), F.lit("_"))
    )
    subject = F.regexp_extract("folder", r"(\d+)", 1)
    ids = uploaded.select(F.col("session_id").alias("upload_session_id")).distinct().withColumn("_done", F.lit(True))
    df = (
        folders.join(dts.select("folder", "dt", F.lit(True).alias("_started")), "folder", "left")
        .withColumns(
            {
                "subject": subject,
                "date": date_in_name("folder"),
                "started": F.coalesce(F.col("_started"), F.lit(False)),
            }
        )
        .withColumn("upload_session_id", F.when(F.col("started"), F.concat(F.lit("ecephys_"), F.col("subject"), F.lit("_"), F.col("dt"))))
        .join(ids, "upload_session_id", "left")
        .withColumn("finished", F.when(F.col("started"), F.coalesce(F.col("_done"), F.lit(False))))
    )
    if ephys_only:
        df = df.where(F.col("has_ephys"))
    if unstarted_only:
        df = df.where(~F.col("started"))
    return df.select(
        "subject", F.col("has_ephys").alias("ephys"), "date", "folder", "started", "upload_session_id", "finished"
    ).orderBy(F.desc("date"), "folder")


def hide_columns(df: DataFrame, hidden: tuple[str, ...] | list[str], when: bool = True) -> DataFrame:
    """P10: drop display-only columns when a flag is set."""
    return df.drop(*hidden) if when else df


def column_filters(df: DataFrame, spec: dict[str, tuple[str, object]]) -> DataFrame:
    """Per-column table filters: ``like`` (substring), ``<``, ``>`` and a
    three-state boolean (``None`` = no filter)."""
    preds: list[Column] = []
    for name, (op, value) in spec.items():
        c = F.col(name)
        if op == "like":
            preds.append(c.contains(str(value)))
        elif op == "<":
            preds.append(c < value)
        elif op == ">":
            preds.append(c > value)
        elif op == "bool":
            if value is not None:
                preds.append(c == F.lit(bool(value)))
        else:
            raise ValueError(f"unknown filter {op!r}")
    return df.where(all_of(preds))


def session_table(sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """All sessions, id descending."""
    return sessions.orderBy(F.desc(key))
