"""The thin queries over the operators of this subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, extract, language, licenses, line_dedup, packing, quality, simhash
from .sql import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_remainder(4) != 2)
    model = quality.train(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), model, threshold=0.7)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), limit=2048)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = ann.Search(_table(spark, sf_dir, "embeddings"), k=20)
    return search.nearest(F.col("vec_id") % 20 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=4, shingle=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_chars=1, min_docs=10, keep="none")
    found = F.col("line_dedup")
    return lines.select("doc_id", found["n_lines"].alias("n_lines"), found["n_dropped"].alias("n_dropped"), F.sha2(found["text"], 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_turns(rows)).withColumnRenamed("conv", "conv_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)
    items = F.col("items")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), *licenses.catalogue(spark))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(_remainder(5) != 0))
    named = language.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_neighbours": op3_neighbours,
    "op4_simhash": op4_simhash,
    "op5_extract": op5_extract,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat": op7_chat,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_language": op10_language,
}
