"""Vector bin packing of documents into training sequences.

Method: a document's whole multiples of the length limit are full sequences at
once. What remains goes to a pool, and the dot-product heuristic fills one open
sequence at a time: of the pieces that fit under all limits (tokens, segments,
loss-bearing tokens), it takes the one whose demand has the largest dot product
with the room left, both as shares of the limits. If none fits, the piece with the
largest product is cut to the room. At the end of a task the last sequence is cut
into powers of two, which need no padding.

Each task packs its own rows, in a pool of ``pool`` pieces, so memory is bounded
and nothing is shuffled; sequence_ids are unique across tasks, and a task that runs
again gives the same ones.

Defined cases: null text counts as empty, and an empty text is the end id alone;
repeated rows are packed each; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import map_arrow

END = 1
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


class Piece:
    """A run of a document's ids; loss marks the ids that bear loss (None: all)."""

    __slots__ = ("doc", "start", "ids", "loss", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, loss: np.ndarray | None, total: int):
        self.doc, self.start, self.ids, self.loss, self.total = doc, start, ids, loss, total

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        loss = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.doc, self.start, self.ids[:n], loss[0], self.total), Piece(self.doc, self.start + n, self.ids[n:], loss[1], self.total)


class Packer:
    """Sequences as lists of pieces, from pieces in any order."""

    def __init__(self, limit: int = 2048, segments: int = 256, loss_limit: int | None = None, pool: int = 1024):
        self.limits = np.array([limit, segments, loss_limit or limit], float)
        self.limit, self.pool = limit, pool
        self.pieces: list[Piece | None] = []
        self.demands = np.zeros((2 * pool, 3))
        self.count = 0

    def _put(self, piece: Piece) -> None:
        if len(self.pieces) == len(self.demands):  # close the gaps that placed pieces left
            held = [i for i, p in enumerate(self.pieces) if p is not None]
            self.demands[: len(held)] = self.demands[held]
            self.pieces = [self.pieces[i] for i in held]
        self.demands[len(self.pieces)] = piece.demand()
        self.pieces.append(piece)
        self.count += 1

    def _take(self, i: int) -> Piece:
        piece, self.pieces[i] = self.pieces[i], None
        self.demands[i] = np.inf
        self.count -= 1
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece.ids) >= self.limit and (self.limits[2] >= self.limit or piece.loss is None):
            whole, piece = piece.cut(self.limit)
            if whole.demand()[2] > self.limits[2]:
                self._put(whole)
                continue
            yield [whole]
        if len(piece.ids):
            self._put(piece)
        while self.count >= self.pool:
            yield self._fill()

    def _cut_to(self, piece: Piece, room: np.ndarray) -> int:
        """How many of a piece's ids there is room for."""
        n = min(len(piece.ids), int(room[0]))
        over = np.cumsum(np.ones(len(piece.ids), bool) if piece.loss is None else piece.loss)[:n] > room[2]
        return n - int(over.sum())

    def _fill(self) -> list[Piece]:
        room, out = self.limits.copy(), []
        while self.count and room[0] >= 1 and room[1] >= 1:
            demands = self.demands[: len(self.pieces)]
            fits = (demands <= room).all(axis=1)
            value = np.where(np.isinf(demands), 0, demands) @ (room / self.limits**2)
            if fits.any():
                i = int(np.where(fits, value, -1).argmax())
                piece = self._take(i)
            else:
                i = int(value.argmax())
                n = self._cut_to(self.pieces[i], room)
                if not n:
                    break
                piece, rest = self._take(i).cut(n)
                self._put(rest)
            room -= piece.demand()
            out.append(piece)
        return out

    def finish(self) -> Iterator[list[Piece]]:
        while self.count:
            sequence = self._fill()
            used = sum(len(p.ids) for p in sequence)
            if used == self.limit or self.count:
                yield sequence
                continue
            size = 1 << (used.bit_length() - 1)
            while sequence:  # powers of two, the largest first
                part, room = [], size
                while room:
                    piece = sequence.pop(0)
                    if len(piece.ids) > room:
                        piece, rest = piece.cut(room)
                        sequence.insert(0, rest)
                    part.append(piece)
                    room -= len(piece.ids)
                yield part
                used -= size
                size = 1 << (used.bit_length() - 1) if used else 0


def rows_of(sequences: Iterable[list[Piece]], first: int) -> Iterator[tuple]:
    for number, sequence in enumerate(sequences, first):
        offset = 0
        for p in sequence:
            yield p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, number, offset, p.demand()[2]
            offset += len(p.ids)


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = 2048, segments: int = 256, loss_limit: int | None = None, pool: int = 1024) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss; all ids bear loss."""
    def pieces(batch):
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.append(tokens.encode(text or ""), np.uint32(END))
            yield Piece(doc, 0, ids, None, len(ids))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _packed(rows, pieces, limit, segments, loss_limit, pool).withColumnRenamed("id", id_col)


def pack_turns(turns: DataFrame, limit: int = 2048, segments: int = 64, loss_limit: int | None = None, pool: int = 1024) -> DataFrame:
    """The same for turns of :func:`chat.format_turns`, under all three limits; the id is struct(conv, position)."""
    def pieces(batch):
        columns = (batch.column(c).to_pylist() for c in ("id", "ids", "first", "last"))
        for turn, raw, first, last in zip(*columns, strict=True):
            ids = np.frombuffer(raw, "<u2").astype(np.uint32)
            loss = np.zeros(len(ids), bool)
            loss[first:last] = True
            yield Piece(turn, 0, ids, loss, len(ids))

    first, last = F.col("loss_from") - F.col("position"), F.col("loss_to") - F.col("position")
    rows = turns.select(F.struct("conv", "position").alias("id"), "ids", first.alias("first"), last.alias("last"))
    return _packed(rows, pieces, limit, segments, loss_limit, pool)


def _packed(rows: DataFrame, pieces, limit: int, segments: int, loss_limit: int | None, pool: int) -> DataFrame:
    """Pack the pieces(batch) of each task's own rows; rows have the id in column id."""
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]

    def task(batches):
        out, id_type = [], []

        def sequences(packer):
            for batch in batches:
                id_type[:] = [batch.schema.field("id").type]
                for start in range(0, batch.num_rows, 256):
                    for piece in pieces(batch.slice(start, 256)):
                        yield from packer.add(piece)
            yield from packer.finish()

        def flush():
            ids, *numbers = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type[0]), *(pa.array(c, pa.int64()) for c in numbers)], names)

        for row in rows_of(sequences(Packer(limit, segments, loss_limit, pool)), TaskContext.get().partitionId() << 40):
            out.append(row)
            if len(out) >= 8192:
                yield flush()
        if out:
            yield flush()

    return map_arrow(rows, task, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}")
