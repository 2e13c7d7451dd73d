"""What the operators share: bounded Arrow batches and tables that outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task handles at once: what it makes of them can be much larger than they are.
BATCH_ROWS = 1000


def map_arrow(rows: DataFrame, task, schema) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows; the bytes of a batch are bounded by Spark's own setting."""
    def parts(batches):
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), BATCH_ROWS):
                yield batch.slice(start, BATCH_ROWS)

    return rows.mapInArrow(lambda batches: task(parts(batches)), schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; under a temporary one only where that is unset and all runs locally."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp()
    folder = f"{top}/tagloom-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended; the cluster clears its folder itself
        pass


class WordHashes(dict):
    """64-bit hashes of words, each computed once; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Rows of a join's side up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def small_side(frame: DataFrame) -> DataFrame:
    """A table of keys with a broadcast hint if its rows, counted now, are few enough for one."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def durable(frame: DataFrame) -> DataFrame:
    """The frame as a table written once to the shared folder: computed once, and still there when executors go."""
    folder = shared_folder(frame.sparkSession)
    frame.write.parquet(folder)
    kept = frame.sparkSession.read.schema(frame.schema).parquet(folder)
    kept.kept_in = folder
    return kept


def release(frame: DataFrame) -> None:
    """Delete a durable table that nothing reads any more, before the session ends."""
    _remove(frame.sparkSession, frame.kept_in)
