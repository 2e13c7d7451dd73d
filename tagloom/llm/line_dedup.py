"""Line deduplication over hashed lines, with per-document keep bitmaps.

Method: every line becomes a row of two 64-bit hashes, its document and its
position, never its text. The rows are range-partitioned by hash with a
secondary sort by document and position; a window streams over each key, so that
its first row is the first occurrence and its number of documents is known. What
comes back per document is a compressed bitmap of lines to keep: 64-line words,
those that keep all their lines left out. Text is joined to it once, at the end.

Hot keys are settled beforehand by a count that is combined before its shuffle:
only HEAVY_KEYS keys can be the key of over 1/HEAVY_KEYS of all lines, so the
HEAVY_KEYS most frequent ones hold all of those, and a table of that proven
size is broadcast. The limit there drops nothing; all other keys take the window.

Only DataFrame functions are used.

Defined cases: null or empty text is one empty line; keys shorter than
``min_chars`` are never dropped; each row counts as a document, also a repeated
one, and repeated rows (same doc_id and text) get the same bitmap; null doc_ids
match each other; an empty table gives no rows; further columns of the input pass
through :func:`dedup_lines`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

HEAVY_KEYS = 4096
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def _identity(docs: DataFrame, text_col: str, id_col: str) -> list[Column]:
    """Tells rows apart that share a doc_id."""
    return [docs[id_col].alias("doc"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("th")]


def _lines(docs: DataFrame, text_col: str, id_col: str, min_chars: int) -> DataFrame:
    """A row for each line: doc, th, row (its document row), pos, h1, h2."""
    rows = docs.select(*_identity(docs, text_col, id_col), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc", "th", "row", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return rows.select("doc", "th", "row", "pos", *_hashes(F.col("key")))


def _heavy(lines: DataFrame, min_docs: int) -> DataFrame:
    """The most frequent keys, HEAVY_KEYS at most: h1, h2, n."""
    tallies = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return tallies.where(F.col("n") >= min_docs).orderBy(F.desc("n"), "h1", "h2").limit(HEAVY_KEYS)


def keep_bitmaps(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 1, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """Lines to keep: doc, th, words (array of structs: w, the word's number, and bits; other words keep all).

    ``keep="none"`` drops each line whose key at least ``min_docs`` documents have;
    ``keep="first"`` spares its first occurrence, by document and position.
    Documents that lose nothing have no row.
    """
    if keep not in ("none", "first") or min_docs < 1:
        raise ValueError("keep is 'none' or 'first'; min_docs is at least 1")
    lines = durable(_lines(docs, text_col, id_col, min_chars))
    place = F.struct("doc", "th", "pos")
    marked = lines.join(F.broadcast(_heavy(lines, min_docs)), ["h1", "h2"], "left")

    hot = marked.where(F.col("n").isNotNull()).drop("n")
    known = hot.groupBy("h1", "h2").agg(F.count_distinct("row").alias("n_docs"), F.min(place).alias("first")).where(F.col("n_docs") >= min_docs)
    hot = hot.join(F.broadcast(known), ["h1", "h2"])
    if keep == "first":
        hot = hot.where(place != F.col("first"))

    by_key = Window.partitionBy("h1", "h2")
    in_order = by_key.orderBy("doc", "th", "row", "pos")
    rest = marked.where(F.col("n").isNull()).select("h1", "h2", "doc", "th", "row", "pos").repartitionByRange("h1", "h2")
    rest = rest.withColumns({"new_doc": F.coalesce((F.lag("row").over(in_order) != F.col("row")).cast("int"), F.lit(1)), "first": F.first(place).over(in_order)})
    rest = rest.withColumn("n", F.sum("new_doc").over(by_key)).where(F.col("n") >= min_docs)
    if keep == "first":
        rest = rest.where(place != F.col("first"))

    dropped = hot.select("doc", "th", "pos").unionByName(rest.select("doc", "th", "pos")).repartition("doc", "th")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = dropped.groupBy("doc", "th", F.floor(F.col("pos") / 64).cast("int").alias("w")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("doc", "th").agg(F.collect_list(F.struct("w", "bits")).alias("words"))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **rule) -> DataFrame:
    """The input's columns, and a struct ``line_dedup``: text (without dropped lines), n_lines, n_dropped."""
    maps = keep_bitmaps(docs, text_col, id_col, **rule).select("doc", "th", F.map_from_entries("words").alias("words"))
    doc, th = _identity(docs, text_col, id_col)
    rows = docs.join(maps, doc.eqNullSafe(maps["doc"]) & (th == maps["th"]), "left")
    lines, words = lines_of(docs[text_col]), maps["words"]
    n_dropped = F.aggregate(F.map_values(words), F.lit(0).cast("long"), lambda n, bits: n + F.bit_count(F.bitwise_not(bits)))
    stays = lambda _, i: F.call_function("getbit", F.coalesce(F.try_element_at(words, F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), i % 64) == 1
    kept = F.when(words.isNull(), F.coalesce(docs[text_col], F.lit(""))).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    breaks = F.char_length(docs[text_col]) - F.char_length(F.replace(docs[text_col], F.lit("\n"), F.lit("")))
    result = F.struct(kept.alias("text"), (F.coalesce(breaks, F.lit(0)) + 1).cast("long").alias("n_lines"), F.coalesce(n_dropped, F.lit(0).cast("long")).alias("n_dropped"))
    return rows.select(*[docs[c] for c in docs.columns], result.alias("line_dedup"))
