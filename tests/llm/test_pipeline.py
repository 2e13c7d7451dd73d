import corpus_pipeline
from tagloom.llm import language, packing, tokens
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_groups


def test_stages_like_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SMALL)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        got = {r["doc_id"]: r.asDict() for r in frame.collect()}
        assert len(got) == frame.count()
        ids = sorted(rows)
        if name == "language_id":
            want = {i: rows[i] for i in ids if language.words_of(rows[i]["text"] or "")}
        elif name == "line_dedup":
            texts = brute_lines([rows[i]["text"] for i in ids], 10, "none")
            want = {i: rows[i] | {"text": t, "n_chars": len(t)} for i, (t, _, _) in zip(ids, texts, strict=True)}
        elif name == "near_dedup":
            first = brute_groups([(i, rows[i]["text"]) for i in ids])
            want = {i: rows[i] for i in ids if first[i] == i}
            assert len(want) < len(ids)
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            want = {i: rows[i] for i in ids if not brute_hits(rows[i]["text"], items, 10)[1]}
            assert len(want) < len(ids)
        assert got == want
        rows = want
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).collect()
    check(pieces, {i: [*tokens.encode(r["text"] or "").tolist(), packing.END] for i, r in rows.items()}, 2048)


def test_run_is_all_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    frame = corpus_pipeline.run(spark, SMALL)
    assert frame.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(frame.columns)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "row", "fp", "line_dedup_", "hits")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs.write.mode("overwrite").parquet(f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/awkward-{name}")
        docs = stage(spark, spark.read.parquet(f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/awkward-{name}"), SMALL)
        sizes.append(docs.count())
        empty = stage(spark, spark.createDataFrame([], awkward(spark).schema), SMALL)
        assert empty.count() == 0
    assert sizes[0] == 5 and sizes[2] == 3 and sizes[3] == 3
