"""Parsing as DataFrame operators: one Python stage over Arrow batches, all else relational.

Only an id and the markup are sent to Python. A parse gives one row for each
document with nested arrays; write or cache that row and explode what is needed,
so that nothing is parsed twice. No operator here shuffles: a document is the unit
of work. Null markup is an empty document.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..kernel import html_tree, rows, serialize, xml
from ..kernel.chars import HTML
from ..kernel.tree import Document
from .schemas import DOCUMENT, TOKEN

#: Documents of a batch in Python; one page can have tens of thousands of nodes.
STEP = 64


def _map(df: DataFrame, id_col: str, text_col: str, make: Callable[[str], object], kind: T.DataType, name: str) -> DataFrame:
    """(id_col, name) with make(text) of each row."""
    arrow = to_arrow_type(kind)

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                out = [make(text or "") for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, arrow)], ["id", name])

    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), T.StructField(name, kind)])
    return read.mapInArrow(task, schema).withColumnRenamed("id", id_col)


#: What a parse can hand over: a page's nodes and its log are far larger than its errors.
PARTS = ("nodes", "errors", "actions")


def _document(doc: Document, parts: Collection[str]) -> dict:
    nodes = rows.node_rows(doc) if "nodes" in parts else None
    return {
        "quirks_mode": doc.quirks_mode,
        "n_nodes": None if nodes is None else len(nodes),
        "n_errors": len(doc.errors),
        "encodings": doc.encodings,
        "scripts": None if nodes is None else rows.script_ids(doc, nodes),
        "nodes": nodes,
        "errors": [{"seq": i, "line": line, "stage": stage, "message": message} for i, (line, stage, message) in enumerate(doc.errors)] if "errors" in parts else None,
        "actions": [{"seq": i, "op": op, "target": target, "other": other, "name": name, "text": text} for i, (op, target, other, name, text) in enumerate(doc.actions or ())] if "actions" in parts else None,
    }


def parse_html(df: DataFrame, id_col: str, html_col: str, parts: Collection[str] = PARTS, **options) -> DataFrame:
    """(id_col, doc): documents; only the named parts are handed over, the others are null (with the nodes go their number and the scripts).

    Options: scripting, iframe_srcdoc, drop_doctype, log, exact_errors, discard_bom.
    """
    return _map(df, id_col, html_col, lambda text: _document(html_tree.parse_document(text, **options), parts), DOCUMENT, "doc")


def parse_html_fragment(df: DataFrame, id_col: str, html_col: str, context: str = "body", context_ns: str = HTML, parts: Collection[str] = PARTS, **options) -> DataFrame:
    """(id_col, doc): fragments within a context element; options: context_attrs, form, scripting, quirks_mode, log."""
    return _map(df, id_col, html_col, lambda text: _document(html_tree.parse_fragment(text, context, context_ns, **options), parts), DOCUMENT, "doc")


def parse_xml(df: DataFrame, id_col: str, xml_col: str, parts: Collection[str] = PARTS, log: bool = False) -> DataFrame:
    return _map(df, id_col, xml_col, lambda text: _document(xml.parse_xml(text, log), parts), DOCUMENT, "doc")


def html_token_arrays(df: DataFrame, id_col: str, html_col: str, with_tree: bool = False, **options) -> DataFrame:
    """(id_col, tokens): the tokens of each document in one array."""
    return _map(df, id_col, html_col, lambda text: rows.html_tokens(text, with_tree, **options), T.ArrayType(TOKEN), "tokens")


def xml_token_arrays(df: DataFrame, id_col: str, xml_col: str, **options) -> DataFrame:
    return _map(df, id_col, xml_col, lambda text: rows.xml_tokens(text, **options), T.ArrayType(TOKEN), "tokens")


def tokenize_html(df: DataFrame, id_col: str, html_col: str, with_tree: bool = False, **options) -> DataFrame:
    """A row for each token; with_tree: as a tree builder sees them (raw text in script, style and the like)."""
    return html_token_arrays(df, id_col, html_col, with_tree, **options).select(id_col, F.inline("tokens"))


def tokenize_xml(df: DataFrame, id_col: str, xml_col: str, **options) -> DataFrame:
    return xml_token_arrays(df, id_col, xml_col, **options).select(id_col, F.inline("tokens"))


def nodes(parsed: DataFrame, id_col: str) -> DataFrame:
    return parsed.select(id_col, F.inline("doc.nodes"))


def errors(parsed: DataFrame, id_col: str) -> DataFrame:
    return parsed.select(id_col, F.inline("doc.errors"))


def actions(parsed: DataFrame, id_col: str) -> DataFrame:
    return parsed.select(id_col, F.inline("doc.actions"))


def facts(parsed: DataFrame, id_col: str) -> DataFrame:
    return parsed.select(id_col, *[F.col(f"doc.{c}").alias(c) for c in ("quirks_mode", "n_nodes", "n_errors", "encodings", "scripts")])


def normalise_html(df: DataFrame, id_col: str, html_col: str, scripting: bool = True) -> DataFrame:
    """(id_col, html): parsed and written out again, below a plain doctype."""
    def make(text: str) -> str:
        return "<!DOCTYPE html>\n" + serialize.serialize_html(html_tree.parse_document(text, scripting=scripting, drop_doctype=True).root, scripting=scripting)

    return _map(df, id_col, html_col, make, T.StringType(), "html")


def reserialize_html(df: DataFrame, id_col: str, html_col: str, context: str | None = None, scripting: bool = True) -> DataFrame:
    """(id_col, html): the serialization of a document, or of a fragment in a context."""
    def make(text: str) -> str:
        if context is None:
            return serialize.serialize_html(html_tree.parse_document(text, scripting=scripting).root, scripting=scripting)
        return serialize.serialize_html(html_tree.parse_fragment(text, context, scripting=scripting).root.children[0], scripting=scripting)

    return _map(df, id_col, html_col, make, T.StringType(), "html")


def reserialize_xml(df: DataFrame, id_col: str, xml_col: str, compat: bool = True) -> DataFrame:
    return _map(df, id_col, xml_col, lambda text: xml.serialize_xml(xml.parse_xml(text).root, compat), T.StringType(), "xml")


def serialize_parsed(parsed: DataFrame, id_col: str, scripting: bool = True, templates: bool = False) -> DataFrame:
    """(id_col, html) of parsed documents, from their node arrays."""
    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                out = [serialize.serialize_html(rows.tree_of(nodes or []), scripting=scripting, templates=templates) for nodes in part.column("nodes").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.string())], ["id", "html"])

    read = parsed.select(F.col(id_col).alias("id"), F.col("doc.nodes").alias("nodes"))
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), T.StructField("html", T.StringType())])
    return read.mapInArrow(task, schema).withColumnRenamed("id", id_col)


def dump_html(df: DataFrame, id_col: str, html_col: str, context: str | None = None, scripting: bool = True) -> DataFrame:
    """(id_col, tree): the indented form of a tree, a line for each node."""
    def make(text: str) -> str:
        if context is None:
            return serialize.dump(html_tree.parse_document(text, scripting=scripting).root)
        return serialize.dump(html_tree.parse_fragment(text, context, scripting=scripting).root.children[0])

    return _map(df, id_col, html_col, make, T.StringType(), "tree")
