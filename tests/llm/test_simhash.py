import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import queries, simhash
from tagloom.llm.components import components
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, documents


def brute_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """id -> smallest id of its component; prints: (id, fingerprint) pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        least[find(i)] = min(key, least.get(find(i), key))
    return {key: least[find(i)] for i, (key, _) in enumerate(prints)}


def brute_groups(texts, size=5, least=0.8):
    """id -> smallest id of its group of similar texts; texts: (id, text) pairs."""
    def runs(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))

    sets = [(i, runs(t)) for i, t in texts]
    group = {i: i for i, _ in sets}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if len(a & b) >= least * len(a | b) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_masks_cover_all_pairs_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = np.random.default_rng(0)
    for _ in range(3000):
        differing = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(m & differing == 0 for m in masks)


def test_fingerprints():
    for text in ("", None, " \n", "one", "one two three", "A b C d e f", "ünï 日本 x y z w", "x " * 20_000):
        assert simhash.fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text)


def planted(seed, n):
    """Fingerprints with chains and dense balls of near ones."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 12))):
            out.append(x)
            for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                x ^= 1 << int(b)
    return out


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_links_and_components(spark, block):
    prints = planted(3, 60)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(s,) for s in set(signed)], "fp long")
    edges = simhash.links(classes, 4, block).select("u", "v")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_components([(s, s & (1 << 64) - 1) for s in set(signed)])
    assert {s: roots.get(s, s) for s in set(signed)} == want


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 300), (300, 200), (7, 7)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(1, 101)} | {(300, 200)}
    assert components(edges.where("u > 999")).count() == 0


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "fp", "id", "component_id", "mask")
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(None, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7)}
    assert simhash.near_duplicates(docs).count() == 9 and simhash.near_duplicates(docs.where("doc_id > 99")).count() == 0


def test_near_copies_are_found(spark):
    base = " ".join(f"w{i}" for i in range(2000))
    docs = documents(spark, [base, base + " tail", "tip " + base, base.upper(), "other words only"])
    assert [r["component_id"] for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0, 4]


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d["doc_id"], brute_fingerprint(d["text"])) for d in docs]
    want = brute_components(prints)
    got = queries.op4_simhash(spark, SMALL)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect())) == sorted((i, f"{p:016x}", want[i]) for i, p in prints)
    assert got.select(F.countDistinct("component_id")).first()[0] < len(docs)


def test_similar_documents_are_grouped(spark):
    rng = np.random.default_rng(5)
    texts = []
    for size in (3, 40, 200, 1000, 3000):
        for _ in range(4):
            words = [f"w{int(x)}" for x in rng.integers(0, 5000, size)]
            texts.append(" ".join(words))
            for changes in (0, 1, size // 60, size // 45, size // 10, size // 3):
                copy = list(words)
                for at in rng.choice(size, min(changes, size), replace=False):
                    copy[at] = f"x{int(rng.integers(0, 10**9))}"
                texts.append(" ".join(copy).upper() if changes == 0 else " ".join(copy))
    docs = documents(spark, texts).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.duplicates(docs).collect()}
    want = brute_groups(list(enumerate(texts)))
    missed = [i for i in want if got.get(i, i) != want[i]]
    assert len(missed) <= 0.03 * sum(want[i] != i for i in want)
    assert all(want[i] == want[g] for i, g in got.items())  # nothing joins that is not similar


@pytest.mark.parametrize("members", [300, 2000])
def test_copies_that_only_a_hub_joins(spark, members):
    rng = np.random.default_rng(8)
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, 250)]
    texts = []
    for _ in range(1100):
        copy = list(base)
        for at in rng.choice(np.arange(5, 245, 6), 5, replace=False):
            copy[at] = f"x{int(rng.integers(0, 10**9))}"
        texts.append(" ".join(copy))
    texts.insert(700, " ".join(base))
    got = {r["doc_id"]: r["component_id"] for r in simhash.duplicates(documents(spark, texts).repartition(3), members=members).collect()}
    assert len(got) >= 0.97 * 1100 and len(set(got.values())) == 1


def test_similar_forest_like_all_pairs():
    rng = np.random.default_rng(4)
    sets = [rng.choice(np.arange(60, dtype="<u8"), int(rng.integers(0, 40)), replace=False) for _ in range(40)]
    sets = [np.sort(s) for s in sets + [s[: len(s) * 9 // 10] for s in sets] + [s[len(s) // 10 :] for s in sets]]
    group = list(range(len(sets)))
    for i, j in simhash._similar_forest(sets, 0.8):
        group = [group[j] if g == group[i] else g for g in group]
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(np.union1d(a, b)) and simhash.similarity(a, b) >= 0.8:
                want = [want[j] if g == want[i] else g for g in want]
    assert all((group[i] == group[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


def test_long_texts_are_compared_exactly():
    rng = np.random.default_rng(6)
    for changes, similar in [(66, True), (67, False)] * 15:  # of 3,000 words: similarity 0.8016 and 0.7989
        words = [f"w{int(x)}" for x in rng.integers(0, 10**9, 3000)]
        copy = list(words)
        for at in rng.choice(np.arange(5, 2990, 6), changes, replace=False):
            copy[at] = f"x{at}"
        sets = [simhash.shingle_set(" ".join(t).encode(), 5) for t in (words, copy)]
        assert len(simhash._similar_forest(sets, 0.8)) == similar
