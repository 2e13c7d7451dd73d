"""Benchmark decontamination with a hash set of normalised test n-grams.

Method: benchmark items become windows of ``n`` words (a shorter item is one
window). Their hashes are sorted once, on the driver, and broadcast as arrays; each
Python worker holds one copy for all of its tasks. Documents are read in Arrow
batches, rolling window hashes are looked up in the set, and each hit is verified
word by word. Hit spans or documents can then be removed.

The hash set is broadcast only in blocks of at most ``block_items`` items and
``block_words`` words (about 30 bytes a word, and 150 for each different word); a larger benchmark takes one pass over
the documents for each block, and an item of more words is cut into parts that overlap
by n - 1 words. Each pass is written out before the next, so one block is held at a time.

Defined cases: null and empty texts have no words, so no hits; items without
words match nothing; repeated items and item_ids count once; items with a null
item_id mark words, but are not listed; an empty benchmark hits nothing; repeated
documents are scanned each on their own; further columns pass through
:func:`remove_documents` and :func:`remove_spans`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_arrow

_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """ASCII letters, digits and all beyond ASCII make words; A-Z is lower-cased."""
    return text.translate(_WORD_BYTES).split()


class Windows:
    """The windows of benchmark items, in sorted arrays that can be broadcast."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], n: int = 10):
        self.n, self.names = n, []
        self.number: dict[bytes, int] | None = {}  # the words, in the order of the text
        name_of: dict[str, int] = {}
        texts, at = [], 0
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            words = words_of((text or "").encode())
            if not words:
                continue
            name = -1
            if item is not None:
                name = name_of.setdefault(item, len(self.names))
                if name == len(self.names):
                    self.names.append(item)
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.uint64)
            size = min(n, len(words))
            ends = at + np.cumsum([len(w) + 1 for w in words])
            begins = np.concatenate([[at], ends[:-1]])
            count = len(words) - size + 1
            parts.setdefault(size, []).append((self._hash(ids[j : j + count] for j in range(size)), np.full(count, name, np.int32), begins[:count], ends[size - 1 :] - 1))
            texts.append(b" ".join(words) + b" ")
            at = int(ends[-1])
        self.text = b"".join(texts)
        self.tables = {}
        for size, found in parts.items():
            hashes, names, begins, ends = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.tables[size] = (hashes[order], names[order], begins[order], ends[order], self._bitmap(hashes))

    @staticmethod
    def _bitmap(hashes: np.ndarray) -> np.ndarray:
        """Which values of the upper bits occur: most lookups end here."""
        seen = np.zeros(1 << 20, bool)
        seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return seen

    def __getstate__(self):
        return self.__dict__ | {"number": None}  # each worker numbers the words again

    def _numbers(self) -> dict[bytes, int]:
        if self.number is None:
            self.number = {}
            for m in _WORD.finditer(self.text):
                self.number.setdefault(m[0], len(self.number) + 1)
        return self.number

    @staticmethod
    def _hash(columns) -> np.ndarray:
        total = 0
        for column in columns:
            total = (total + column + np.uint64(1)) * _MULTIPLIER
            total = total ^ (total >> np.uint64(29))
        return total

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, set[int]]]:
        """For each text: its words, which of them are hit, and the names of items found."""
        split = [words_of(t) if t else [] for t in texts]
        get = self._numbers().get
        own = np.array([get(w, 0) for words in split for w in words], np.uint64)
        ends = np.cumsum([len(words) for words in split])
        hit, found = np.zeros(len(own), bool), [set() for _ in texts]
        known = own != 0
        for size, (sorted_hashes, names, begins, stops, seen) in self.tables.items():
            if len(own) < size:
                continue
            count = len(own) - size + 1
            at = np.flatnonzero(known[:count] & known[size - 1 :])  # both ends are words of some item
            h = self._hash(own[at + j] for j in range(size))
            maybe = seen[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            low, high = np.searchsorted(sorted_hashes, h), np.searchsorted(sorted_hashes, h, "right")
            at, low, high = (x[low < high] for x in (at, low, high))
            doc = np.searchsorted(ends, at, side="right")
            for i, d, a, b in zip(at.tolist(), doc.tolist(), low.tolist(), high.tolist(), strict=True):
                if i + size > ends[d]:
                    continue
                start = i - int(ends[d]) + len(split[d])
                text = b" ".join(split[d][start : start + size])
                same = [j for j in range(a, b) if self.text[begins[j] : stops[j]] == text]
                if same:
                    hit[i : i + size] = True
                    found[d].update(names[same].tolist())
        for words, end, items in zip(split, ends, found, strict=True):
            yield words, hit[end - len(words) : end], items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, block_items: int, block_words: int) -> Iterator[Windows]:
    """The items in blocks that are small enough to broadcast, streamed to the driver one partition at a time."""
    block, size, given = [], 0, False
    for row in benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).distinct().toLocalIterator():
        words = words_of((row["text"] or "").encode())
        step = max(block_words - n + 1, 1)  # parts of a long item overlap, so that no window is cut
        for start in range(0, max(len(words) - n + 1, 1), step):
            part = words[start : start + step + n - 1]
            if block and (len(block) >= block_items or size + len(part) > block_words):
                yield Windows(block, n)
                block, size, given = [], 0, True
            block.append((row["item"], b" ".join(part).decode()))
            size += len(part)
    if block or not given:
        yield Windows(block, n)


RESULT = "text_hash long, n_words long, n_hit long, items array<string>, hits binary"


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_items: int = 100_000, block_words: int = 2_000_000) -> DataFrame:
    """Per document row: the id, n_words, n_hit, items (sorted ids found), hits (bit for each word, packed; null if none)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    passes: list[DataFrame] = []
    shared = None
    for windows in _blocks(benchmark, item_col, item_text_col, n, block_items, block_words):
        if shared is not None:  # there is another block: what this one finds is kept
            passes[-1] = durable(passes[-1])
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def task(batches, shared=shared):
            windows = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    out = {"n_words": [], "n_hit": [], "items": [], "hits": []}
                    for words, hit, names in windows.scan(part.column("text").cast(pa.binary()).to_pylist()):
                        count = int(hit.sum())
                        out["n_words"].append(len(words))
                        out["n_hit"].append(count)
                        out["items"].append(sorted(windows.names[i] for i in names if i >= 0))
                        out["hits"].append(np.packbits(hit).tobytes() if count else None)
                    types = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "hits": pa.binary()}
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), *(pa.array(out[k], t) for k, t in types.items())], ["id", "text_hash", *types])

        passes.append(map_arrow(rows, task, f"id {kind}, {RESULT}"))
    if len(passes) == 1:
        return passes[0].drop("text_hash").withColumnRenamed("id", id_col)
    return _merged(passes, kind).withColumnRenamed("id", id_col)


def _merged(passes: list[DataFrame], kind: str) -> DataFrame:
    """One row for each document from several blocks; rows that share an id keep a row each."""
    found = passes[0].withColumn("block", F.lit(0))
    for i, more in enumerate(passes[1:], 1):
        found = found.unionByName(more.withColumn("block", F.lit(i)))
    copies = F.row_number().over(Window.partitionBy("id", "text_hash", "block").orderBy("n_words"))
    found = found.withColumn("copy", copies).groupBy("id", "text_hash", "copy").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.collect_list("hits").alias("maps"))

    def task(batches):
        for batch in batches:
            n_hit, hits = [], []
            for maps in batch.column("maps").to_pylist():
                total = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in maps]) if maps else np.zeros(0, np.uint8)
                n_hit.append(int(np.bitwise_count(total).sum()))
                hits.append(total.tobytes() if maps else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), batch.column("items"), pa.array(hits, pa.binary())], ["id", "n_words", "n_hit", "items", "hits"])

    return map_arrow(found.select("id", "n_words", "items", "maps"), task, f"id {kind}, {RESULT.removeprefix('text_hash long, ')}")


def _passes(docs: DataFrame, benchmark: DataFrame, change, item_col: str, item_text_col: str, text_col: str, n: int, block_items: int, block_words: int) -> DataFrame:
    """docs after change(windows, batch, its texts) of each block of the benchmark, one after another."""
    at = docs.columns.index(text_col)
    shared = None
    for windows in _blocks(benchmark, item_col, item_text_col, n, block_items, block_words):
        if shared is not None:
            docs = durable(docs)
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def task(batches, shared=shared):
            windows = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    yield change(windows, part, part.column(at).cast(pa.binary()).to_pylist())

        docs = map_arrow(docs, task, docs.schema)
    return docs


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_items: int = 100_000, block_words: int = 2_000_000) -> DataFrame:
    """The documents without any hit, with all their columns."""
    def change(windows, part, texts):
        return part.filter(pa.array([not hit.any() for _, hit, _ in windows.scan(texts)], pa.bool_()))

    return _passes(docs, benchmark, change, item_col, item_text_col, text_col, n, block_items, block_words)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_items: int = 100_000, block_words: int = 2_000_000) -> DataFrame:
    """All documents, without the text from the first to the last word of each run of hit words."""
    names, at = docs.columns, docs.columns.index(text_col)
    marks = next(m for m in (f"hits_{i}" for i in range(len(names) + 1)) if m not in names)  # bits of hit words so far

    def mark(windows, part, texts):
        bits = [np.packbits(hit) for _, hit, _ in windows.scan(texts)]
        before = part.column(len(names)).to_pylist()
        merged = [b.tobytes() if old is None else (b | np.frombuffer(old, np.uint8)).tobytes() for b, old in zip(bits, before, strict=True)]
        return part.set_column(len(names), part.schema.field(len(names)), pa.array(merged, part.schema.field(len(names)).type))

    def clean(text: bytes | None, bits: bytes | None) -> str | None:
        if text is None or not bits or not any(bits):
            return None if text is None else text.decode()
        out, end, inside = [], 0, False
        for word, gone in zip(_WORD.finditer(text), np.unpackbits(np.frombuffer(bits, np.uint8)).tolist(), strict=False):
            if gone and not inside:
                out.append(text[end : word.start()])
            if gone:
                end = word.end()
            inside = gone
        return b"".join([*out, text[end:]]).decode()

    def task(batches):
        for part in batches:
            cleaned = [clean(t, b) for t, b in zip(part.column(at).cast(pa.binary()).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
            columns = part.columns[: len(names)]
            columns[at] = pa.array(cleaned, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    marked = _passes(docs.withColumn(marks, F.lit(None).cast("binary")), benchmark, mark, item_col, item_text_col, text_col, n, block_items, block_words)
    return map_arrow(marked, task, docs.schema)
