"""Chat formatting at token level.

Method: role and text of each turn are encoded separately, as plain text, and
reserved ids beyond the vocabulary are spliced around them: START role SEP text
END. A turn is encoded where its row is read; a window then sums token counts over
the conversation, so each turn knows its place, and the loss mask of a turn is a
range of token positions from those prefix sums: the text of an assistant turn and
its END.

Content can never form a reserved id, since it is encoded apart. So that the
written-out form is safe too, control strings inside content are escaped: ``<``,
any backslashes and ``|`` get one more backslash between. :func:`unescape` takes
it away.

Output is a row for each turn, so no conversation has to fit in memory.

Defined cases: null role or text counts as empty; turns with equal numbers are
ordered by their tokens, and repeated rows stay; null conv_ids are one
conversation; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import map_arrow

START, SEP, END = 50257, 50258, 50259
CONTROL = {START: "<|im_start|>", SEP: "<|im_sep|>", END: "<|im_end|>"}
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def turn_ids(role: str | None, text: str | None) -> tuple[np.ndarray, int]:
    """The ids of a turn, and where those of its text begin."""
    head = tokens.encode(escape(role or ""), plain=True)
    body = tokens.encode(escape(text or ""), plain=True)
    ids = np.concatenate([[START], head, [SEP], body, [END]]).astype(np.uint16)  # all ids are below 2^16
    return ids, len(head) + 2


def parts(ids: np.ndarray) -> tuple[str, str]:
    """Role and text, unescaped, from the ids of a turn."""
    sep = int(np.flatnonzero(ids == SEP)[0])
    return unescape(tokens.decode(ids[1:sep])), unescape(tokens.decode(ids[sep + 1 : -1]))


def written(ids: np.ndarray) -> str:
    """The ids as a string, with control strings for reserved ids."""
    out, at = [], 0
    for i in np.flatnonzero(ids >= START).tolist():
        out += [tokens.decode(ids[at:i]), CONTROL[int(ids[i])]]
        at = i + 1
    return "".join([*out, tokens.decode(ids[at:])])


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv, turn, ids, n_tokens, position, loss_from, loss_to); ids: little-endian unsigned 16-bit; positions count the conversation's tokens, loss_to is exclusive."""
    def task(batches):
        for batch in batches:
            out = [turn_ids(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            learned = [r == learn for r in batch.column("role").to_pylist()]
            size = np.array([len(ids) for ids, _ in out], np.int64)
            loss = np.array([len(ids) - at if ok else 0 for (ids, at), ok in zip(out, learned, strict=True)], np.int64)
            ids = pa.array([ids.astype("<u2").tobytes() for ids, _ in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), ids, pa.array(size), pa.array(loss)], ["conv", "turn", "ids", "n_tokens", "n_loss"])

    read = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    conv, turn = (read.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    encoded = map_arrow(read, task, f"conv {conv}, turn {turn}, ids binary, n_tokens long, n_loss long")
    end = F.sum("n_tokens").over(Window.partitionBy("conv").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, 0))
    placed = encoded.withColumn("end", end)
    return placed.select("conv", "turn", "ids", "n_tokens", (F.col("end") - F.col("n_tokens")).alias("position"), (F.col("end") - F.col("n_loss")).alias("loss_from"), F.col("end").alias("loss_to"))


class _Reader:
    """Sums up one conversation while its turns stream by."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, ids: np.ndarray, marked: slice) -> None:
        role, text = parts(ids)
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode())
        self.chars += len(written(ids))
        under = ids[marked]
        learned = unescape(tokens.decode(under[under < START]))
        self.loss_chars += len(learned)
        self.loss.update(learned.encode())

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted ids and loss ranges alone."""
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def task(batches):
        conv, reader, out, kind = None, None, [], None

        def flush():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names)

        for batch in batches:
            kind = batch.schema.field("conv").type
            for key, ids, at, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv", "ids", "position", "loss_from", "loss_to")), strict=True):
                if reader is None or key != conv:
                    if reader:
                        out.append((conv, *reader.row()))
                    conv, reader = key, _Reader()
                reader.read(np.frombuffer(ids, "<u2"), slice(a - at, b - at))
            if out:
                yield flush()
        if reader:
            out.append((conv, *reader.row()))
            yield flush()

    in_order = turns.select("conv", "ids", "position", "loss_from", "loss_to").sortWithinPartitions("conv", "position")
    conv = turns.schema["conv"].dataType.simpleString()
    return map_arrow(in_order, task, f"conv {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
