"""A corpus pipeline of five stages over ``documents``.

Toxic documents go, one document of each near-duplicate group stays,
documents with benchmark passages go, sources are mixed to target weights,
and what is left is put into shards. Each stage's rows are written to the
shared folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ephysframe.llm import hash_tree, lsh_forest, poisson_mix, toxicity_chain, winnowing
from ephysframe.llm.common import materialise, table
from ephysframe.llm.queries import MIX_WEIGHTS


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, any further ones included."""
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain does not reject.

    Each row is judged by its own text: repeated rows and ids stay or go by
    it, a null or empty text is judged by the intercepts alone. Without labels
    nothing goes.
    """
    return _columns(toxicity_chain.clean(docs, table(spark, sf_dir, "labels")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of a Jaccard similarity of 0.8 or more connect; rows without words all stay.

    Of rows equal in id and text one is left; a null id is an id like others.
    """
    return _columns(lsh_forest.deduplicate(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of a benchmark item; null, empty and wordless texts stay, and repeated rows stay repeated."""
    return _columns(winnowing.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its Poisson draw says, in hash order; a null source weighs 1 as one not listed does."""
    return _columns(poisson_mix.mix(docs, MIX_WEIGHTS), docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, its slot and the columns of :func:`hash_tree.assign`; copies of an id share a shard."""
    return hash_tree.assign(docs, hash_tree.grid(24))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A fitted classifier has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
