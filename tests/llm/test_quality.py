import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np

from tagloom.llm import quality, queries
from tests.conftest import SMALL
from tests.llm.helpers import DOCS, awkward, clashing

SF = SMALL.replace("0.001", "0.1")


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    up = order[labels == 1]
    return (up.mean() - (len(up) - 1) / 2) / max(1, (labels == 0).sum())


def test_additive_and_pairwise_effects_are_learned():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 5))
    odds = 3 * (x[:, 0] > 0.2) - 1.5 + 4 * np.sign(x[:, 1]) * np.sign(x[:, 2])
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-odds))).astype(int)
    model = quality.fit(x[:3000], y[:3000])
    assert (1, 2) in model.pairs
    assert auc(model.scores(x[3000:]), y[3000:]) > 0.9
    flat = quality.fit(x[:3000], y[:3000], n_pairs=0)
    assert auc(flat.scores(x[3000:]), y[3000:]) < auc(model.scores(x[3000:]), y[3000:])


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200)
    model = quality.fit(x, y, rounds=5, n_pairs=2)
    for row, odds in zip(x[:20], model.log_odds(x[:20]), strict=True):
        total = model.base + sum(t[np.searchsorted(c, v, side="right")] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[np.searchsorted(model.pair_cuts[a], row[a], side="right"), np.searchsorted(model.pair_cuts[b], row[b], side="right")]
        assert np.isclose(total, odds)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "score", "predicted", "entropy", "id")
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (6, None), (7, 1), (4, 1), (None, 1), (9, 1), (2, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels, rounds=5, pair_rounds=2)
    found = quality.score(docs, model).collect()
    assert len(found) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    nothing = quality.train(docs, labels.where("doc_id > 99"))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.where("doc_id > 99"), model).count() == 0
    assert quality.features(b"") == [0.0] * len(quality.FEATURES) == quality.features(None)


def test_query(spark):
    found = queries.op1_quality(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(found) == 10_000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    y = np.array([labels[r["doc_id"]] for r in held])
    assert auc(np.array([r["score"] for r in held]), y) > 0.99
    assert np.mean([r["predicted"] == v for r, v in zip(held, y, strict=True)]) > 0.98


def test_only_the_text_counts(spark):
    docs = spark.createDataFrame([(1, "some text. And more.", "en", "a", 5), (2, "some text. And more.", "fr", "b", 999)], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    one, two = quality.score(docs, quality.train(docs, labels)).collect()
    assert one["score"] == two["score"]


def plain_features(text):
    """The features of a text, counted byte by byte."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(quality.FEATURES)
    n, words = len(data), re.findall(rb"[^ \t\n\r\x0b\x0c]+", data)
    lines, sizes = data.split(b"\n"), [len(w) for w in words] or [0]
    marks = b".,;:!?'\"()-"
    symbols = {b for b in range(33, 127) if not chr(b).isalnum() and b not in marks}
    mean, tally = sum(sizes) / len(sizes), Counter(words)
    m = max(1, len(words))
    share = lambda test: sum(map(test, data)) / n
    return [
        math.log1p(n), math.log1p(len(words)), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)), sum(s > 12 for s in sizes) / len(sizes),
        share(lambda b: chr(b).isascii() and chr(b).isalpha()), share(lambda b: 48 <= b <= 57), share(lambda b: b in b" \t\n\r\x0b\x0c"), share(lambda b: b in marks), share(lambda b: b in symbols), share(lambda b: b >= 128), share(lambda b: 65 <= b <= 90),
        math.log1p(len(lines)), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), len(tally) / m, max(tally.values(), default=0) / m, 1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
        -sum(c / n * math.log2(c / n) for c in Counter(data).values()), share(lambda b: b in b".!?"), sum(any(b in symbols for b in w) for w in tally) / max(1, len(tally)), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), sum(s <= 3 for s in sizes) / len(sizes), len(zlib.compress(data, 1)) / n,
    ]


def test_query_like_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("crc32(CAST(doc_id AS STRING)) % 4 <> 2"))
    found = {r["doc_id"]: r for r in queries.op1_quality(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        x = plain_features(r["text"])
        assert np.allclose(x, quality.features((r["text"] or "").encode()), rtol=1e-9, atol=1e-9)
        x = quality.features((r["text"] or "").encode())  # a value can lie on a cut, to the last bit
        odds = model.base + sum(t[bisect.bisect_right(c.tolist(), v)] for c, t, v in zip(model.cuts, model.tables, x, strict=True))
        odds += sum(t[bisect.bisect_right(model.pair_cuts[a].tolist(), x[a]), bisect.bisect_right(model.pair_cuts[b].tolist(), x[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        score = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        assert abs(found[r["doc_id"]]["score"] - score) < 1e-9 and found[r["doc_id"]]["predicted"] == (found[r["doc_id"]]["score"] >= 0.7)
