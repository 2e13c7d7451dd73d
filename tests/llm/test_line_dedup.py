import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.llm import line_dedup, queries, sql
from tests.conftest import SMALL
from tests.llm.helpers import DOCS, awkward, clashing, documents

WHITE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def brute(texts, min_docs, keep, min_chars=1):
    """Texts without their dropped lines; texts are in document order."""
    keys = [[line.strip(WHITE).translate(FOLD) for line in (t or "").split("\n")] for t in texts]
    docs, first = defaultdict(set), {}
    for d, own in enumerate(keys):
        for p, k in enumerate(own):
            if len(k) >= min_chars:
                docs[k].add(d)
                first.setdefault(k, (d, p))
    out = []
    for d, (t, own) in enumerate(zip(texts, keys, strict=True)):
        lines = (t or "").split("\n")
        stay = [line for p, (line, k) in enumerate(zip(lines, own, strict=True)) if len(docs.get(k, ())) < min_docs or keep == "first" and first[k] == (d, p)]
        out.append((("\n").join(stay), len(lines), len(lines) - len(stay)))
    return out


TEXTS = ["a\nB\nc", "b \nx\n\n", "\tb\nB\nz", None, "", "A\nq\nÉ", "a\né\nq", "q\nq\nq\nq", "\n".join(f"line {i % 7}" for i in range(300)), "line 1\nline 2\n" + "\n".join(map(str, range(500)))]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("min_docs", [1, 2, 3])
@pytest.mark.parametrize("heavy", [1, 3, 4096])
def test_like_brute_force(spark, keep, min_docs, heavy, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY_KEYS", heavy)
    docs = documents(spark, TEXTS).repartition(3)
    found = line_dedup.dedup_lines(docs, min_docs=min_docs, keep=keep).orderBy("doc_id").collect()
    assert [tuple(r["line_dedup"]) for r in found] == brute(TEXTS, min_docs, keep)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "doc", "th", "words", "h1", "n", "row", "pos", "line")
    found = line_dedup.dedup_lines(docs, min_docs=3)
    assert found.columns == [*docs.columns, "line_dedup"]
    got = {(r["doc_id"], r["line_dedup"]["text"], r["line_dedup"]["n_dropped"]) for r in found.collect()}
    assert (None, "", 0) in got and (1, "", 0) in got and (5, "", 1) in got and (6, "", 1) in got and found.count() == 9
    assert line_dedup.dedup_lines(docs.where("doc_id > 99")).count() == 0


def test_repeated_rows_keep_the_same_lines(spark):
    docs = spark.createDataFrame([(1, "x\ny", "", "", 0)] * 3 + [(2, "x", "", "", 0)], DOCS)
    got = line_dedup.dedup_lines(docs, min_docs=2, keep="first").select("doc_id", "line_dedup.text").collect()
    assert sorted(map(tuple, got)) == [(1, "x\ny")] * 3 + [(2, "")]


def test_bitmaps_hold_no_text(spark):
    maps = line_dedup.keep_bitmaps(documents(spark, TEXTS), min_docs=2)
    assert dict(maps.dtypes) == {"doc": "bigint", "th": "bigint", "words": "array<struct<w:int,bits:bigint>>"}


def test_query(spark, same_as_sql):
    frame = queries.op6_line_dedup(spark, SMALL)
    same_as_sql(frame, sql.OP6)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    want = brute([d["text"] for d in docs], 10, "none")
    got = frame.orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got] == [(n, k, hashlib.sha256(t.encode()).hexdigest()) for t, n, k in want]


def test_no_python_runs_on_executors(spark):
    plan = line_dedup.dedup_lines(documents(spark, TEXTS)).withColumn("x", F.lit(1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
