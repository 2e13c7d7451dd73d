"""Schemas of what parsing gives."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS.get(kind, kind) if isinstance(kind, str) else kind) for name, kind in fields.items()])


ATTRIBUTE = _struct(prefix="string", ns="string", local="string", value="string")
ATTRIBUTES = T.ArrayType(ATTRIBUTE)
NODE = _struct(
    node_id="int", parent_id="int", ordinal="int", depth="int", pre="int", post="int", content_of="int", kind="string", prefix="string", ns="string", local="string", attrs=ATTRIBUTES,
    text="string", public_id="string", system_id="string", target="string", mathml_ip="boolean", had_duplicate_attributes="boolean", line="int", form_id="int",
)
ERROR = _struct(seq="int", line="int", stage="string", message="string")
ACTION = _struct(seq="int", op="string", target="int", other="int", name="string", text="string")
TOKEN = _struct(
    seq="int", line="int", kind="string", name="string", prefix="string", self_closing="boolean", had_duplicate_attributes="boolean", attrs=ATTRIBUTES, data="string", public_id="string", system_id="string", force_quirks="boolean",
)
DOCUMENT = _struct(
    quirks_mode="string", n_nodes="int", n_errors="int", encodings=T.ArrayType(T.StringType()), scripts=T.ArrayType(T.IntegerType()), nodes=T.ArrayType(NODE), errors=T.ArrayType(ERROR), actions=T.ArrayType(ACTION),
)
