import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(frame):
    """Rows as sorted tuples, columns by name."""
    names = sorted(frame.columns)
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


@pytest.fixture(scope="session")
def same_as_sql():
    import duckdb

    def check(frame, sql, sf_dir=SMALL):
        db = duckdb.connect()
        for path in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(frame.columns) == sorted(names)
        order = [names.index(n) for n in sorted(names)]
        def plain(row):
            return tuple(round(v, 9) if isinstance(v, float) else v for v in row)

        want = sorted((plain([r[i] for i in order]) for r in found.fetchall()), key=str)
        assert [plain(r) for r in rows_of(frame)] == want

    return check
