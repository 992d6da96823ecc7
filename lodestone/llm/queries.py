"""The registered queries of the operators, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.collocations import collocations
from lodestone.llm.columns import table, text_of, words_of
from lodestone.llm.decontam import contamination
from lodestone.llm.exact import exact_duplicates
from lodestone.llm.mincut import main_texts
from lodestone.llm.mixing import mix
from lodestone.llm.pii import counts, with_surrogates
from lodestone.llm.quality import quality
from lodestone.llm.rules import quality_rules
from lodestone.llm.simhash import near_duplicates
from lodestone.llm.spans import remove_repeats
from lodestone.llm.toxicity import toxicity, train
from lodestone.llm.warc import assemble, read_warc, write_warc
from lodestone.llm.whitening import whiten
from lodestone.plans.scratch import Scratch

FOLDS = 5


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.transform("removed", lambda r: r["end"] - r["begin"])
    return docs.select(
        "doc_id", F.octet_length(text_of("text")).cast("long").alias("n_bytes"),
        F.aggregate(gone, F.lit(0), lambda a, b: a + b).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("removed") > 0).alias("repeated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id", "lang"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
    model = train(docs, labels.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), toxicity(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"), *counts(F.col("pii")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').path}/archives"
    write_warc(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_warc(spark, path, keep_payload=False))
    header = lambda name: F.try_element_at("response.headers", F.lit(name))
    return captures.select(
        header("x-page-id").cast("long").alias("page_id"), F.col("response.payload_bytes"), F.col("response.payload_digest"),
        F.col("response.record_type"), header("x-refers-to-page-id").cast("long").alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"), F.size("metadata").cast("long").alias("n_metadata"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines_removed", "lost_chars")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_texts(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.size(words_of(text_of("text"))).cast("long").alias("size"), F.xxhash64("text").alias("content"))
    mixed, plan = mix(docs, F.array("source"), F.col("size"), ["doc_id", "content"])
    sources = spark.createDataFrame([(s, n, float(t)) for s, n, t in plan.sources],
                                    "name string, source_size long, target double")
    return mixed.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name")), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op8_html": op8_html,
    "op5_pii": op5_pii,
    "op3_quality": op3_quality,
    "op6_warc": op6_warc,
    "op2_decontamination": op2_decontamination,
    "op9_mixing": op9_mixing,
    "op4_toxicity": op4_toxicity,
    "op7_simhash": op7_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}
