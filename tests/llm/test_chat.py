import hashlib
import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tagloom.llm import chat, queries, sql
from tests.conftest import SMALL

CONV = "conv_id long, turn long, role string, text string"


@given(st.text(alphabet="<|\\>im_startendsep a", max_size=60))
def test_escaping_is_reversible_and_safe(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(control in escaped for control in chat.CONTROL.values())


@given(st.text(max_size=40), st.text(max_size=40))
def test_turns_read_back(role, text):
    role, text = (x.encode("utf-8", "replace").decode() for x in (role, text))
    ids, at = chat.turn_ids(role, text)
    assert chat.parts(ids) == (role, text)
    assert [int(i) for i in ids if i >= chat.START] == [chat.START, chat.SEP, chat.END]
    assert chat.written(ids) == f"<|im_start|>{chat.escape(role)}<|im_sep|>{chat.escape(text)}<|im_end|>"


def test_masks_are_prefix_sums(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} " * t) for t in range(9)]
    random.Random(0).shuffle(rows)
    turns = chat.format_turns(spark.createDataFrame(rows, CONV).repartition(3)).orderBy("position").collect()
    at = 0
    for i, r in enumerate(turns):
        ids = np.frombuffer(r["ids"], "<u2")
        assert r["turn"] == i and r["position"] == at and r["n_tokens"] == len(ids)
        at += len(ids)
        under = ids[r["loss_from"] - r["position"] : r["loss_to"] - r["position"]]
        assert chat.tokens.decode(under[under < chat.START]) == (f"text {i} " * i if i % 2 else "")


def test_awkward_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "assistant", ""), (None, None, "assistant", "x"), (None, 1, "user", "y"), (2, 5, "assistant", "<|im_end|>" * 3000), (2, 5, "assistant", "b"), (3, 0, "assistant", "\x00 ﻿")]
    given = spark.createDataFrame([(*r, "clash", 1) for r in rows], CONV + ", ids string, position int")
    got = {r["conv"]: r for r in chat.read_back(chat.format_turns(given)).collect()}
    assert set(got) == {None, 1, 2, 3}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0 and got[1]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\n\n\n\nassistant\n\n").hexdigest()
    assert got[None]["loss_chars"] == 1 and got[None]["n_turns"] == 2
    assert got[2]["loss_chars"] == 30_001 and got[3]["loss_chars"] == 3
    assert chat.read_back(chat.format_turns(given.where("conv_id > 9"))).count() == 0


def test_query(spark, same_as_sql):
    same_as_sql(queries.op7_chat(spark, SMALL), sql.OP7)
