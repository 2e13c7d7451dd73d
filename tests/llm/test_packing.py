import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import chat, packing, queries, tokens
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing


def check(pieces, documents, limit):
    """Every id in exactly one piece, sequences gapless and within the limit; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(documents)
    for doc, own in by_doc.items():
        ids = documents[doc]
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_ids_are_those_of_the_reference_tokenizer():
    given = ["", "a", "Hello  world\n\n x", "ünï 日本語 😀", "a<|endoftext|>b", "x" * 5000, "\x00﻿", "don't 123,456"]
    given += ["".join(np.random.default_rng(i).choice(list("aé <|endoftext|>\n1'"), 200)) for i in range(20)]
    for text in given:
        assert tokens.encode(text).tolist() == tokens.tokenizer().encode(text, add_special_tokens=False).ids
        plain = tokens.encode(text, plain=True)
        assert plain.tolist() == tokens.tokenizer(plain=True).encode(text, add_special_tokens=False).ids
        assert tokens.decode(plain) == text


@given(st.lists(st.integers(1, 700), max_size=60), st.integers(1, 8), st.integers(4, 128))
@settings(max_examples=150, deadline=None)
def test_all_limits_hold(sizes, segments, loss_limit):
    rng = np.random.default_rng(len(sizes))
    packer = packing.Packer(limit=128, segments=segments, loss_limit=loss_limit, pool=8)
    documents, sequences = {}, []
    for i, n in enumerate(sizes):
        ids, loss = rng.integers(0, 50_000, n).astype(np.uint32), rng.random(n) < 0.5
        documents[i] = (ids, loss)
        sequences += packer.add(packing.Piece(i, 0, ids, loss, n))
    sequences += packer.finish()
    seen = defaultdict(int)
    for sequence in sequences:
        assert 0 < sum(len(p.ids) for p in sequence) <= 128 and len(sequence) <= segments
        assert sum(int(p.loss.sum()) for p in sequence) <= loss_limit
        for p in sequence:
            assert (p.ids == documents[p.doc][0][p.start : p.start + len(p.ids)]).all()
            seen[p.doc] += len(p.ids)
    assert dict(seen) == dict(enumerate(sizes))


def plain_packing(pieces, limits, pool):
    """Sequences of (doc, first id, length) by the dot-product rule, one piece at a time; a piece is (doc, start, [bears loss])."""
    held, out = [], []

    def demand(piece):
        return len(piece[2]), 1, sum(piece[2])

    def fill():
        room, sequence = list(limits), []
        while held and room[0] >= 1 and room[1] >= 1:
            value = [sum(Fraction(d * r, m * m) for d, r, m in zip(demand(p), room, limits, strict=True)) for p in held]
            fits = [i for i, p in enumerate(held) if all(d <= r for d, r in zip(demand(p), room, strict=True))]
            i = max(fits or range(len(held)), key=lambda i: (value[i], -i))
            doc, start, loss = held[i]
            n = len(loss) if fits else max(k for k in range(min(len(loss), room[0]) + 1) if sum(loss[:k]) <= room[2])
            if not n:
                break
            held.pop(i)
            if n < len(loss):
                held.append((doc, start + n, loss[n:]))
            room = [r - d for r, d in zip(room, (n, 1, sum(loss[:n])), strict=True)]
            sequence.append((doc, start, n))
        out.append(sequence)

    for piece in pieces:
        held.append(piece)
        while len(held) >= pool:
            fill()
    while held:
        fill()
    return out


@pytest.mark.parametrize("seed", range(8))
def test_packer_like_brute_force(seed):
    rng = np.random.default_rng(seed)
    limits, pool = ((64, 4, 32), (64, 8, 64), (128, 16, 16))[seed % 3], int(rng.integers(2, 12))
    pieces = [(i, 0, (rng.random(int(rng.integers(1, limits[0]))) < rng.random()).tolist()) for i in range(40)]
    packer = packing.Packer(*limits, pool=pool)
    got = []
    for doc, start, loss in pieces:
        got += packer.add(packing.Piece(doc, start, np.zeros(len(loss), np.uint32), np.array(loss), len(loss)))
    got += packer.finish()
    got = [[(p.doc, p.start, len(p.ids)) for p in sequence] for sequence in got]
    want = plain_packing(pieces, limits, pool)
    last = len(want) - 1  # the last one is cut into powers of two
    assert got[:last] == want[:last]
    assert sum(n for sequence in got[last:] for *_, n in sequence) == sum(n for *_, n in want[last])


@pytest.mark.parametrize("partitions", [1, 5])
def test_query(spark, partitions):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r["doc_id"]: [*tokens.tokenizer().encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces = (queries.op2_packing(spark, SMALL) if partitions == 1 else packing.pack(docs.repartition(partitions))).collect()
    total = sum(map(len, ids.values()))
    assert check(pieces, ids, 2048) <= 0.001 * total


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "id", "start", "length", "sequence_id")
    found = packing.pack(docs).collect()
    lengths = defaultdict(int)
    for p in found:
        lengths[p["doc_id"]] += p["length"]
    one = len(tokens.encode("same text here")) + 1
    assert lengths[None] == lengths[1] == lengths[2] == 1 and lengths[5] == 2 * one and lengths[6] == one and lengths[4] > 40_000
    assert packing.pack(docs.where("doc_id > 99")).count() == 0


def test_instruction_turns(spark):
    turns = chat.format_turns(spark.read.parquet(f"{SMALL}/conversations.parquet")).cache()
    found = packing.pack_turns(turns, limit=512, segments=4, loss_limit=300).collect()
    given = {(r["conv"], r["position"]): r for r in turns.collect()}
    lengths, loss, by_sequence = defaultdict(int), defaultdict(int), defaultdict(list)
    for p in found:
        lengths[tuple(p["id"])] += p["length"]
        loss[tuple(p["id"])] += p["n_loss"]
        by_sequence[p["sequence_id"]].append(p)
    assert {k: r["n_tokens"] for k, r in given.items()} == lengths
    assert {k: r["loss_to"] - r["loss_from"] for k, r in given.items()} == loss
    for own in by_sequence.values():
        assert sum(p["length"] for p in own) <= 512 and len(own) <= 4 and sum(p["n_loss"] for p in own) <= 300
