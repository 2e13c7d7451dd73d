"""Byte decoding that counts what was wrong."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_lossy(data: bytes, codec: str = "utf-8") -> tuple[str, int]:
    """Text with one U+FFFD for each maximal invalid part, and their number."""
    count = 0

    def replace(error):
        nonlocal count
        count += 1
        return "\ufffd", error.end

    codecs.register_error("tagloom.count", replace)
    return data.decode(codec, "tagloom.count"), count


def decode_with_errors(df: DataFrame, id_col: str, bytes_col: str, codec: str = "utf-8") -> DataFrame:
    """(id_col, text, n_errors)."""
    def task(batches):
        for batch in batches:
            out = [(None, 0) if b is None else decode_lossy(b, codec) for b in batch.column("b").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], ["id", "text", "n_errors"])

    read = df.select(F.col(id_col).alias("id"), F.col(bytes_col).alias("b"))
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_errors", T.IntegerType())])
    return read.mapInArrow(task, schema).withColumnRenamed("id", id_col)
