"""Table functions for SQL: SELECT ... FROM pages, LATERAL html_nodes(html)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import html_tree, rows, xml
from ..operators.schemas import ERROR, NODE, TOKEN


def _ordered(schema: T.StructType, found: dict) -> tuple:
    return tuple(found[name] for name in schema.names)


class HtmlTokens:
    def eval(self, html: str):
        for row in rows.html_tokens(html or ""):
            yield _ordered(TOKEN, row)


class HtmlNodes:
    def eval(self, html: str):
        for row in rows.node_rows(html_tree.parse_document(html or "")):
            yield _ordered(NODE, row)


class HtmlErrors:
    def eval(self, html: str):
        for i, (line, stage, message) in enumerate(html_tree.parse_document(html or "").errors):
            yield i, line, stage, message


class XmlTokens:
    def eval(self, text: str):
        for row in rows.xml_tokens(text or ""):
            yield _ordered(TOKEN, row)


class XmlNodes:
    def eval(self, text: str):
        for row in rows.node_rows(xml.parse_xml(text or "")):
            yield _ordered(NODE, row)


TABLES = {"html_tokens": (HtmlTokens, TOKEN), "html_nodes": (HtmlNodes, NODE), "html_errors": (HtmlErrors, ERROR), "xml_tokens": (XmlTokens, TOKEN), "xml_nodes": (XmlNodes, NODE)}


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session."""
    for name, (function, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(function, returnType=schema))
