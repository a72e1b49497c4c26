"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fill_middle,
    hard_negatives,
    hash_tree,
    lattice_dedup,
    lsh_forest,
    oracle,
    poisson_mix,
    quality_features,
    secret_scan,
    suffix_dedup,
    token_blocks,
    toxicity_chain,
    url_ratio,
    winnowing,
)
from .common import scratch, table, text_or_empty


def op1_url_lm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_ratio.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-blocks")
    token_blocks.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), vocab=50_257)
    return token_blocks.read_digests(spark, path).withColumnRenamed("id", "doc_id")


def op3_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = text_or_empty("text")
    sized = docs.select("doc_id", "text", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = hash_tree.assign(sized, hash_tree.grid(24), hash_tree.grid(25))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity_chain.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "p_low_quality", "p_toxic", "rejected")


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["b"] - x["a"]))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsh_forest.join(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "component_id", "kept")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.join(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def listed(rules: tuple[secret_scan.Rule, ...]):
        kinds = [r.kind for r in rules]
        own = F.filter("secret_spans", lambda x: x["kind"].isin(kinds))
        return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(secret_scan.BASE_RULES), 256).alias("base_sha256"),
                        listed(secret_scan.RULES).alias("spans"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_features.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.withColumnRenamed("id", "doc_id")


#: Target weights by source; the other sources weigh 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}

QUERIES = {
    "op1_url_lm_ratio": op1_url_lm_ratio,
    "op2_rans_tokens": op2_rans_tokens,
    "op3_hash_tree": op3_hash_tree,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_poisson_mix": op5_poisson_mix,
    "op6_suffix_arrays": op6_suffix_arrays,
    "op7_lsh_forest": op7_lsh_forest,
    "op8_winnowing": op8_winnowing,
    "op9_lattice_hashing": op9_lattice_hashing,
    "op10_secret_trigrams": op10_secret_trigrams,
    "op11_fill_middle": op11_fill_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fourier_quality": op13_fourier_quality,
}
SQL: dict[str, str] = {
    "op1_url_lm_ratio": oracle.urls(),
    "op5_poisson_mix": oracle.mixed(MIX_WEIGHTS),
    "op8_winnowing": oracle.CONTAMINATED,
    "op10_secret_trigrams": oracle.secrets(),
    "op11_fill_middle": oracle.FILLED,
    "op12_hard_negatives": oracle.NEGATIVES,
}
