import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.functions import tables
from tagloom.operators import parse
from tagloom.operators import relational as R
from tagloom.operators.decode import decode_with_errors
from tagloom.sources.files import join_chunks, read_markup
from tests.conftest import ROOT, SMALL


def test_null_and_empty_markup(spark):
    given = spark.createDataFrame([(1, None), (2, "")], "id int, html string")
    found = parse.facts(parse.parse_html(given, "id", "html"), "id").collect()
    assert {(r["id"], r["n_nodes"], r["quirks_mode"]) for r in found} == {(1, 4, "quirks"), (2, 4, "quirks")}
    assert parse.parse_html(given.where("id > 5"), "id", "html").count() == 0


def test_joins_have_the_document_among_their_keys(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    nodes = parse.nodes(parse.parse_html(pages, "page_id", "html"), "page_id")
    plan = R.descendants(R.elements(nodes, "article"), R.elements(nodes, "p"), "page_id")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_only_needed_columns_are_read(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    plan = parse.parse_html(pages, "page_id", "html")._jdf.queryExecution().executedPlan().toString()
    assert "url" not in plan


def test_files_and_chunks(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>caf\xc3\xa9 \xff")
    assert read_markup(spark, str(tmp_path)).first()["text"] == "<p>café �"
    (tmp_path / "a.html").write_bytes("Привет".encode("koi8-r"))
    assert read_markup(spark, str(tmp_path), "koi8-r").first()["text"] == "Привет"
    chunks = spark.createDataFrame([(1, 1, b"\xa9</p>"), (1, 0, b"<p>\xc3"), (2, 0, b"x")], "id int, seq int, chunk binary")
    assert sorted(map(tuple, join_chunks(chunks, "id", "seq", "chunk").collect())) == [(1, "<p>é</p>"), (2, "x")]


@pytest.mark.parametrize(
    ("raw", "text", "errors"),
    [(b"ok \xff\xe4\xb8\xfe\xbf\x80b", "ok �����b", 5), (b"\xe2\x82", "�", 1), (b"\xed\xa0\x80", "���", 3), (b"ok", "ok", 0)],
)
def test_lossy_utf8(spark, raw, text, errors):
    given = spark.createDataFrame([(1, raw)], "id int, b binary")
    assert tuple(decode_with_errors(given, "id", "b").first()) == (1, text, errors)
    assert given.select(C.decode_utf8(F.col("b"))).first()[0] == text


def test_labels_that_are_no_web_encoding():
    assert [C.codec_of(x) for x in ("utf-7", "cp437", "rot13", "zlib", "nothing", "", "hz")] == [None] * 7


def test_written_texts_can_hold_any_character(spark, tmp_path):
    from tagloom.sources.files import write_text

    write_text(spark.createDataFrame([("a\0b\nc",), ("é",)], "t string").coalesce(1), "t", str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part*")).decode() == "a�b\nc\0é\0"


def test_units(spark):
    given = spark.createDataFrame([("aé€😀".encode(), i) for i in (0, 1, 2, 3, 6)] + [(b"\xed\xa0\x80", 0), (b"\xed\xb0\x80", 1), (b"\xe2\x82", 0), (b"\x82", 0)], "b binary, i int")
    assert [r[0] for r in given.select(C.classify_unit("b", "i")).collect()] == ["whole"] * 5 + ["lead surrogate", "trail surrogate", "prefix", "suffix"]
    wtf8 = spark.createDataFrame([(b"\xed\xa0\x80",), (b"\xed\xa0\x80\xed\xb0\x80",), (b"\xff",), (b"a",)], "b binary")
    assert [r[0] for r in wtf8.select(C.is_wtf8("b")).collect()] == [True, False, False, True]


def test_string_functions(spark):
    given = spark.createDataFrame([("aéb",)], "x string")
    assert given.select(C.byte_slice(F.col("x"), 0, 3), C.byte_slice(F.col("x"), 0, 2)).first() == ("aé", None)
    attrs = spark.sql("SELECT array(struct('' AS ns, 'id' AS local, '1' AS value), struct('' AS ns, 'b' AS local, '2' AS value)) AS a, array(struct('' AS ns, 'b' AS local, '2' AS value), struct('' AS ns, 'id' AS local, '1' AS value)) AS b")
    assert attrs.select(C.same_attributes(F.col("a"), F.col("b")), R.attribute("id", F.col("a")), R.attribute("x", F.col("a"))).first() == (True, "1", None)


def test_table_functions(spark):
    tables.register(spark)
    assert spark.sql("SELECT count(*) FROM html_nodes('<p>x') WHERE kind = 'element'").first()[0] == 4
    assert spark.sql("SELECT name FROM xml_tokens('<a/>') WHERE kind = 'empty_tag'").first()[0] == "a"
    assert spark.sql("SELECT count(*) FROM html_errors('<p')").first()[0] >= 1


@pytest.fixture
def rocks(spark):
    from tagloom.streaming.chunks import STATE_STORE

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream(rocks, tmp_path):
    from tagloom.streaming.chunks import parse_chunks

    spark = rocks

    schema = "doc_id long, seq int, chunk string, is_last boolean"
    parts = [[(1, 0, "<p>a", False), (2, 1, "</b>", True)], [(2, 0, "<b>x", False)], [(1, 1, "<p>b", True), (3, 0, "never", False)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "tmp"))
        next((tmp_path / "tmp").glob("*.parquet")).rename(tmp_path / f"{i}.parquet")
        shutil.rmtree(tmp_path / "tmp")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = parse_chunks(stream).writeStream.format("memory").queryName("parsed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r["doc_id"]: (r["complete"], r["n_chunks"], r["markup"]) for r in spark.table("parsed").collect()}
    assert found == {1: (True, 2, "<html><head></head><body><p>a</p><p>b</p></body></html>"), 2: (True, 2, "<html><head></head><body><b>x</b></body></html>")}


def test_idle_documents_are_parsed_as_they_are(rocks, tmp_path):
    from tagloom.streaming.chunks import parse_chunks

    schema = "doc_id long, seq int, chunk string, is_last boolean"
    rocks.createDataFrame([(1, 2, "</p>c", False), (1, 0, "x", False), (1, 0, "<p>a", False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = parse_chunks(rocks.readStream.schema(schema).parquet(str(tmp_path / "in")), timeout_ms=1000)
    query = stream.writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while not rocks.table("idle").count() and time.time() < until:
            time.sleep(1)
    finally:
        query.stop()
    assert [(r["complete"], r["n_chunks"], r["markup"]) for r in rocks.table("idle").collect()] == [(False, 2, "<html><head></head><body><p>a</p>c</body></html>")]


def test_stream_needs_its_state_store(spark):
    from tagloom.streaming.chunks import parse_chunks

    with pytest.raises(ValueError, match="providerClass"):
        parse_chunks(spark.createDataFrame([(1, 0, "x", True)], "doc_id long, seq int, chunk string, is_last boolean"))


def test_stream_of_bytes(rocks, tmp_path):
    from tagloom.streaming.chunks import parse_chunks

    spark = rocks

    given = spark.createDataFrame([(1, 0, b"<a>\xc3", False), (1, 1, b"\xa9</a>", True)], "doc_id long, seq int, chunk binary, is_last boolean")
    given.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    query = parse_chunks(stream, kind="xml").writeStream.format("memory").queryName("parsed_bytes").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["markup"] for r in spark.table("parsed_bytes").collect()] == ["<a>é</a>"]


def test_entry_without_the_llm_parts(tmp_path):
    for name in ("tagloom", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tagloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'html_title' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k.startswith("JAVA")}}, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert Path(SMALL).exists()
