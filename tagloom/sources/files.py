"""Markup from files and chunks, and back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import decode_as, decode_utf8, replace_nul


def read_markup(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(path, text): each file whole; invalid bytes become U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    text = decode_utf8(F.col("content")) if encoding.lower() in ("utf-8", "utf8") else decode_as(encoding)("content")
    return files.select("path", text.alias("text"))


def join_chunks(chunks: DataFrame, id_col: str, seq_col: str, chunk_col: str) -> DataFrame:
    """(id_col, text): the chunks of each document put together in order of seq_col.

    Chunks may be strings or bytes; bytes are joined before they are decoded, so a
    character may be cut between chunks.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq_col).alias("seq"), F.col(chunk_col).alias("chunk")))), lambda c: c["chunk"])
    if chunks.schema[chunk_col].dataType.simpleString() == "binary":
        hexed = F.array_join(F.transform(parts, lambda b: F.hex(b)), "")
        return chunks.groupBy(id_col).agg(decode_utf8(F.unhex(hexed)).alias("text"))
    return chunks.groupBy(id_col).agg(F.array_join(parts, "").alias("text"))


def write_text(df: DataFrame, text_col: str, path: str) -> None:
    """Texts one after another, each ended by NUL; a NUL within a text becomes U+FFFD, as parsers read it."""
    df.select(replace_nul(F.col(text_col)).alias(text_col)).write.text(path, lineSep="\x00")
