import itertools
import unicodedata
import zlib

import numpy as np
import pytest

from tagloom.llm import language, queries
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, prose

SF = SMALL.replace("0.001", "0.01")


def brute(scores, transitions, lengths):
    """Marginals and pair sums by adding up all label sequences."""
    gammas, pairs, at, k = [], np.zeros_like(transitions), 0, scores.shape[1]
    for n in lengths:
        own = scores[at : at + n]
        gamma, pair, total = np.zeros((n, k)), np.zeros((k, k)), 0
        for labels in itertools.product(range(k), repeat=n):
            weight = np.exp(sum(own[i, y] for i, y in enumerate(labels)) + sum(transitions[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            for i, y in enumerate(labels):
                gamma[i, y] += weight
            for a, b in itertools.pairwise(labels):
                pair[a, b] += weight
        gammas.append(gamma / total if n else gamma)
        pairs += pair / total if n else 0
        at += n
    return np.concatenate(gammas), pairs


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_forward_backward(block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = np.random.default_rng(0)
    lengths = [1, 5, 0, 3, 6]
    scores, transitions = rng.normal(size=(15, 3)), rng.normal(size=(3, 3))
    gamma, pairs = language.forward_backward(scores, transitions, lengths)
    want, want_pairs = brute(scores, transitions, lengths)
    assert np.allclose(gamma, want) and np.allclose(pairs, want_pairs)


def test_code_switched_text():
    a, b = prose(1, 60), [t.translate(str.maketrans("abcdefghij", "qrstuvwxyz")) for t in prose(2, 60)]
    model = language.fit([(t, "a") for t in a[:50]] + [(t, "b") for t in b[:50]], rounds=3)
    words = (a[55].split()[:20] + b[55].split()[:20] + a[56].split()[:20])
    labels = [model.langs[i] for i in model.marginals([words])[0].argmax(axis=1)]
    assert sum(x == y for x, y in zip(labels, ["a"] * 20 + ["b"] * 20 + ["a"] * 20, strict=True)) >= 57
    assert model.transitions[0, 0] > model.transitions[0, 1]


def test_same_rows_give_the_same_model():
    rows = [(t, "ab"[i % 2]) for i, t in enumerate(prose(3, 20))]
    one, two = language.fit(rows, rounds=1), language.fit(rows[::-1], rounds=1)
    assert (one.grams == two.grams).all() and (one.transitions == two.transitions).all()


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "lang_pred", "lang_score", "h", "words")
    model = language.fit([(t, "ab"[i % 2]) for i, t in enumerate(prose(4, 10))], rounds=1)
    found = language.identify(docs, model)
    assert found.count() == 9 and sorted(found.columns) == sorted([*docs.columns])
    got = {(r["doc_id"], r["lang_pred"] == "und", r["lang_score"] == 0.0) for r in found.collect()}
    assert got == {(None, True, True), (1, True, True), (2, True, True), (3, True, True), (4, False, False), (5, False, False), (6, False, False), (7, False, False)}
    nothing = language.train(docs.where("doc_id > 99"))
    assert nothing.langs == [] and {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.where("doc_id > 99"), model).count() == 0


def test_query(spark):
    found = queries.op10_language(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert sorted(r["doc_id"] for r in found) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.98


def test_what_a_word_is():
    assert language.words_of("Straße, l'été ²½① x_y 3d हिन्दी e\u0301a") == ["straße", "l", "été", "x", "y", "d", "हिन्दी", "e\u0301a"]
    model = language.fit([(t, "ab"[i % 2]) for i, t in enumerate(prose(4, 10))], rounds=1)
    assert model.predict(["²½① 12 _ \u0301", "٣", "ª"])[0][:2] == ["und", "und"] and model.predict(["ª"])[0] != ["und"]


@pytest.mark.parametrize("segment", [1, 7, 64, 100])
def test_segments_of_a_long_text(monkeypatch, segment):
    texts = prose(5, 12, words=80)
    model = language.fit([(t, "abc"[i % 3]) for i, t in enumerate(texts)], rounds=2)
    long = " ".join(texts[1:6])
    want = model.predict([long, "x", None])
    monkeypatch.setattr(language, "SEGMENT", segment)
    got = model.predict([long, "x", None])
    assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_words_are_scored_alike_whatever_came_before(monkeypatch):
    texts = prose(6, 20)
    model = language.fit([(t, "ab"[i % 2]) for i, t in enumerate(texts)], rounds=1)
    want = [model.emissions(t.split()) for t in texts]
    monkeypatch.setattr(language, "REMEMBERED", 50)
    assert all(np.allclose(model.remembered(t.split()), w) for t, w in zip(texts, want, strict=True))


def test_sample_has_a_share_of_each_language(spark):
    rows = [(i, f"text {i} " + "x" * (5000 if i % 50 == 0 else 5), "rare" if i % 100 == 1 else "common", "s", 0) for i in range(1000)]
    docs = spark.createDataFrame([*rows, *rows[:7]], "doc_id long, text string, lang string, source string, n_chars long")
    got = language.sample(docs, "text", "lang", "doc_id", 30, 8000)
    count = {lang: [t for t, own in got if own == lang] for lang in ("rare", "common")}
    assert len(count["rare"]) == 10 and 10 <= len(count["common"]) <= 15 and len(set(got)) == len(got)
    assert sum(map(len, count["common"])) <= 5015 + 4000


def plain_scores(model, words):
    """Scores of words, feature by feature."""
    out = []
    for word in words:
        data, total = b"\x02" + word.encode() + b"\x03", np.zeros(len(model.langs))
        count = 0
        for size in (1, 2, 3, 4):
            for i in range(len(data) - size + 1):
                h = 0
                for byte in data[i : i + size]:
                    h = (h + byte + 1) * 0x9E3779B1 & 0xFFFFFFFF
                h = (h ^ size * 0x05EBCA6B & 0xFFFFFFFF) * 0xC2B2AE35 & 0xFFFFFFFF
                total += model.grams[h >> 16]
                count += 1
        out.append(total / np.sqrt(count) + model.lexicon.get(word, 0))
    return out


def plain_prediction(model, text):
    """Language and score, letter by letter and word by word."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and word:
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return "und", 0.0
    scores, n = plain_scores(model, words), len(words)
    ahead = [scores[0]]
    for i in range(1, n):
        ahead.append(np.array([np.logaddexp.reduce(ahead[-1] + model.transitions[:, y]) for y in range(len(model.langs))]) + scores[i])
    behind = [np.zeros(len(model.langs))]
    for i in range(n - 1, 0, -1):
        behind.insert(0, np.array([np.logaddexp.reduce(model.transitions[y] + scores[i] + behind[0]) for y in range(len(model.langs))]))
    total = sum(len(w) * np.exp(a + b - np.logaddexp.reduce(a + b)) for w, a, b in zip(words, ahead, behind, strict=True))
    total = total / sum(map(len, words))
    return model.langs[int(total.argmax())], float(total.max())


def test_query_like_brute_force(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").limit(120)
    rows = [tuple(r) for r in given.collect()]
    rows += [(10_000 + i, t, None, "s", 0) for i, t in enumerate([None, "", "²½", "12 34", rows[0][1][:90] + " " + rows[5][1][:90], "हिन्दी"])]
    docs = spark.createDataFrame(rows, given.schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = language.train(docs.where(queries._remainder(5) != 0))
    got = {r["doc_id"]: r for r in queries.op10_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        lang, score = plain_prediction(model, text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-6
