"""Documents that arrive in chunks, parsed when their last chunk is there.

The state of a document is its chunks so far, an entry of its own for each, so a chunk
is written once whatever came before. They are joined by number: chunks may come in any
order, in several micro-batches and repeatedly (the last one counts). With a timeout, a
document that stays idle longer is parsed as it is; such a query looks for its timers
again and again, so it has to be stopped, also with an availableNow trigger.

The state lies in RocksDB: the session needs ``spark.sql.streaming.stateStore.providerClass``
set to STATE_STORE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..kernel import html_tree, serialize, xml
from ..operators.decode import decode_lossy

OUTPUT = "doc_id long, complete boolean, n_chunks int, n_errors int, quirks_mode string, markup string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Documents(StatefulProcessor):
    def __init__(self, kind: str, binary: bool, timeout_ms: int | None):
        self.kind, self.binary, self.timeout_ms = kind, binary, timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "seq int", f"chunk {'binary' if self.binary else 'string'}")
        self.facts = handle.getValueState("facts", "n int, last int, timer long")  # chunks held, number of the last one (-1: unknown)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last, timer = self.facts.get() if self.facts.exists() else (0, -1, -1)
        for batch in rows:
            for seq, chunk, is_last in zip(batch["seq"], batch["chunk"], batch["is_last"], strict=True):
                place = (int(seq),)
                n += not self.chunks.containsKey(place)
                self.chunks.updateValue(place, ((bytes(chunk) if self.binary else chunk) if chunk is not None else b"" if self.binary else "",))
                if is_last:
                    last = int(seq)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if last >= 0 and n == last + 1:
            yield self._finished(key[0], True)
            return
        if self.timeout_ms is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(timer)
        self.facts.update((n, last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._finished(key[0], False)

    def _finished(self, doc_id: int, complete: bool) -> pd.DataFrame:
        parts = [chunk[0] for _, chunk in sorted(self.chunks.iterator())]
        self.chunks.clear()
        self.facts.clear()
        text = decode_lossy(b"".join(map(bytes, parts)))[0] if self.binary else "".join(parts)
        doc = html_tree.parse_document(text) if self.kind == "html" else xml.parse_xml(text)
        markup = serialize.serialize_html(doc.root) if self.kind == "html" else xml.serialize_xml(doc.root)
        return pd.DataFrame([(doc_id, complete, len(parts), len(doc.errors), doc.quirks_mode, markup)], columns=["doc_id", "complete", "n_chunks", "n_errors", "quirks_mode", "markup"])


def parse_chunks(chunks: DataFrame, kind: str = "html", timeout_ms: int | None = None) -> DataFrame:
    """Chunks (doc_id long, seq int, chunk string or binary, is_last boolean) to a row for each document, with the tree written out.

    Bytes are joined before they are decoded, so a character may be cut between chunks.
    """
    if chunks.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    binary = chunks.schema["chunk"].dataType.simpleString() == "binary"
    grouped = chunks.select("doc_id", "seq", "chunk", "is_last").groupBy("doc_id")
    return grouped.transformWithStateInPandas(_Documents(kind, binary, timeout_ms), OUTPUT, "Append", "None" if timeout_ms is None else "ProcessingTime")
