"""QC file manifest per session.

The dashboard found QC files with a recursive glob of ``<session>*`` and
classified them while building HTML. Here the listing is a table (see
``sources.list_files``) and the session match is an equi-join on name
prefixes, so it scales with both the number of files and of sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# File classes of the QC page.
FIGURE_SUFFIX = ".png"
JSON_SUFFIX = ".json"
SKIPPED_FOLDER = ".vscode"
SKIPPED_JSON_WORD = "plotly"


def qc_manifest(files: DataFrame, sessions: DataFrame, root: str = "") -> DataFrame:
    """(session_id, path, name, suffix, kind, title, depth, is_first).

    A file belongs to a session when its name starts with the session id
    minus its last two characters. Files under a ``.vscode`` folder are
    skipped; ``kind`` is ``figure`` (.png), ``json`` (.json without
    ``plotly`` in the name) or null; ``title`` is the stem with ``_`` as
    spaces; ``depth`` is the folder depth below ``root``; ``is_first``
    marks the first path of each session. A path that is listed twice stays
    twice.
    """
    parts = F.split(F.col("path"), "/")
    f = (
        files.select("path")
        .withColumn("_parts", F.filter(parts, lambda p: p != ""))
        .where(~F.array_contains(F.col("_parts"), SKIPPED_FOLDER))
        .withColumn("name", F.element_at("_parts", -1))
        .withColumn("suffix", F.regexp_extract("name", r"(\.[^.]*)$", 1))
        .withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    )
    root_depth = len([p for p in root.split("/") if p])
    f = f.withColumn("depth", (F.size("_parts") - 1 - F.lit(root_depth)).cast("int"))
    sess = sessions.select("session_id", F.expr("substring(session_id, 1, length(session_id) - 2)").alias("prefix")).where(
        F.length("prefix") > 0
    ).distinct()
    # of each file name the beginnings that are as long as some session's
    lengths = sess.select(F.collect_set(F.length("prefix"))).scalar()
    sized = f.withColumn("_n", F.explode(lengths)).where(F.col("_n") <= F.length("name"))
    matched = sized.withColumn("prefix", F.substr("name", F.lit(1), F.col("_n"))).join(sess, "prefix")
    kind = (
        F.when(F.col("suffix") == FIGURE_SUFFIX, F.lit("figure"))
        .when((F.col("suffix") == JSON_SUFFIX) & ~F.col("name").contains(SKIPPED_JSON_WORD), F.lit("json"))
    )
    out = matched.select(
        "session_id", "path", "name", "suffix", kind.alias("kind"),
        F.trim(F.replace(F.col("stem"), F.lit("_"), F.lit(" "))).alias("title"), "depth",
    )
    first = out.groupBy("session_id").agg(F.min("path").alias("_first"))
    return out.join(first, "session_id").withColumn("is_first", F.col("path") == F.col("_first")).drop("_first")
