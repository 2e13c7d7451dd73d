import hashlib
import pickle
import re

import pytest

from tagloom.llm import decontaminate, queries, sql
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, n):
    own = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        w = words(item_text)
        size = min(n, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1 if windows else 0):
            if tuple(own[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(own), len(hit), sorted(str(i) for i in found if i is not None)


def cases():
    texts = prose(1, 12)
    items = [(0, texts[0]), (1, " ".join(texts[1].split()[:15])), (2, "zebra quagga"), (3, ""), (4, None), (5, "Ünï 日本"), (6, texts[0]), (10, "zebra")]
    docs = [texts[0], "x " + texts[0][:200] + " y", texts[1], texts[2] + " ZEBRA, quagga! " + texts[3], None, "", "ünï 日本 Ünï-日本", texts[4], " ".join(texts[1].split()[3:14]), texts[0].upper()]
    return docs, items


@pytest.mark.parametrize("n", [2, 10])
@pytest.mark.parametrize("block_items", [2, 100])
def test_like_brute_force(spark, n, block_items):
    texts, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(documents(spark, texts), benchmark, n=n, block_items=block_items).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in found] == [brute(t, items, n) for t in texts]


@pytest.mark.parametrize("block_words", [1, 13, 40])
def test_items_larger_than_a_block(spark, block_words):
    texts, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate._blocks(benchmark, "item_id", "text", 10, 100, block_words))
    assert len(blocks) > 1 and all(len(w.text.split()) <= block_words + 9 for w in blocks)
    if block_words == 40:
        found = decontaminate.scan(documents(spark, texts), benchmark, block_words=block_words).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in found] == [brute(t, items, 10) for t in texts]
        clean = [i for i, t in enumerate(texts) if not brute(t, items, 10)[1]]
        assert sorted(r["doc_id"] for r in decontaminate.remove_documents(documents(spark, texts), benchmark, block_words=block_words).collect()) == clean


def test_a_large_benchmark_takes_little_memory():
    texts = prose(9, 2000, words=100)
    size = len(pickle.dumps(decontaminate.Windows(enumerate(texts))))
    assert size < 40 * 200_000 + (2 << 20) + 200_000


@pytest.mark.parametrize("block_items", [2, 100])
def test_removal(spark, block_items):
    texts, items = cases()
    docs = clashing(documents(spark, texts), "id", "items", "hits", "__hit")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = [i for i, t in enumerate(texts) if not brute(t, items, 10)[1]]
    kept = decontaminate.remove_documents(docs, benchmark, block_items=block_items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == clean
    cut = decontaminate.remove_spans(docs, benchmark, block_items=block_items)
    assert decontaminate.scan(cut, benchmark).where("n_hit > 0").count() == 0
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(got[i] == texts[i] for i in clean)
    assert got[3].count("!") == 1 and "quagga" not in got[3] and got[3].endswith(texts[3].partition("!")[2])
    assert got[0] == "" and got[6] == "ünï 日本 " and got[9] == ""


def test_awkward_rows(spark):
    docs = awkward(spark)
    benchmark = spark.createDataFrame([(None, "same text here"), (1, "same text here"), (1, "same text here")], "item_id long, text string")
    found = decontaminate.scan(docs, benchmark)
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in found.collect() if r["n_hit"]) == [(5, 3, ["1"]), (5, 3, ["1"]), (6, 3, ["1"])]
    assert found.count() == docs.count()
    empty = benchmark.where("item_id > 5")
    assert decontaminate.scan(docs, empty).where("n_hit > 0").count() == 0 and decontaminate.remove_documents(docs, empty).count() == docs.count()
    assert decontaminate.scan(docs.where("doc_id > 99"), benchmark).count() == 0


def test_query(spark, same_as_sql):
    frame = queries.op8_decontamination(spark, SMALL)
    same_as_sql(frame, sql.OP8)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    for r in frame.collect():
        n, hit, ids = brute(docs[r["doc_id"]], items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(ids), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
