"""Make the package importable on executors."""

from __future__ import annotations

import os
import uuid
import zipfile
from io import BytesIO
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application.

    The archive goes through Spark's own file server, so nothing has to be
    installed or shared on the workers.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return spark
    root = Path(__file__).resolve().parent
    data = BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, os.path.relpath(path, root.parent))
    sc.addPyFile(_stored(spark, data.getvalue()))
    _SHIPPED.add(sc.applicationId)
    return spark


def _stored(spark: SparkSession, data: bytes) -> str:
    """Where the archive lies: in the folder that all machines share, or a temporary one where none is named."""
    name = f"tagloom_{uuid.uuid4().hex}.zip"
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        path = Path(mkdtemp()) / name
        path.write_bytes(data)
        return str(path)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(data)
    out.close()
    return files.makeQualified(path).toString()
