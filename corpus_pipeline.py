"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again before the next one, so a lost executor costs a stage at
most. All stages but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, language, line_dedup, packing, simhash
from tagloom.llm.common import durable, shared_folder, small_side


# All stages take nulls in any column, empty and very long texts, repeated rows, empty tables
# and further columns; each row of a repeated document is judged on its own, but near_dedup
# keeps one. Null and empty texts have no letter, so they go in the first stage.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without a letter go."""
    model = language.train(docs)
    if not model.langs:  # nothing to learn from: only the letters are judged
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = language.identify(docs, model)
    return named.where(F.col("lang_pred") != language.UNDETERMINED).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more have; n_chars follows the text. A document that loses all lines stays, empty."""
    found = line_dedup.dedup_lines(docs, min_chars=1, min_docs=10, keep="none").withColumn("text", F.col("line_dedup.text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (four fifths of their five-word shingles in common): that with the smallest doc_id.

    Of rows that share a doc_id the first read stays. Null and empty texts are copies of each other.
    """
    # a row number, written once, tells documents apart that share an id
    own = next(n for n in (f"__row{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = durable(docs.withColumn(own, F.struct("doc_id", F.monotonically_increasing_id().alias("row"))))
    more = simhash.duplicates(rows, id_col=own, radius=4, shingle=5, min_similarity=0.8)
    more = small_side(durable(more.select(F.col(own)["row"].alias("__more"))))
    return rows.join(more, rows[own]["row"] == more["__more"], "left_anti").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 2048 tokens; null and empty texts are one end id each."""
    return packing.pack(docs, limit=2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]
#: SQL can't express the trained model of the first stage; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is kept in the shared folder of spark.checkpoint.dir."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
