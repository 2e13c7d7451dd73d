"""Relational operators over node tables.

Nodes carry an interval: a node's descendants have ``pre`` between its own ``pre``
and ``post``. Ancestor joins always have the document's id among their keys, so
that Spark hashes on it and the interval is only a residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import escape_attribute, escape_text
from ..kernel.chars import HTML, XLINK, XML, XMLNS
from ..kernel.names import RAW_TEXT, VOID


def attribute(name: str, attrs: str | Column = "attrs") -> Column:
    """The value of the first attribute of this name without a namespace; null if there is none."""
    attrs = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.try_element_at(F.filter(attrs, lambda a: (a["ns"] == "") & (a["local"] == name)), F.lit(1))["value"]


def attributes(nodes: DataFrame, id_col: str) -> DataFrame:
    """A row for each attribute, with its place."""
    return nodes.select(id_col, "node_id", F.col("local").alias("element"), F.posexplode("attrs").alias("place", "a")).select(id_col, "node_id", "element", "place", "a.*")


def elements(nodes: DataFrame, *names: str, ns: str = HTML) -> DataFrame:
    found = nodes.where((F.col("kind") == "element") & (F.col("ns") == ns))
    return found.where(F.col("local").isin(*names)) if names else found


def descendants(outer: DataFrame, inner: DataFrame, id_col: str) -> DataFrame:
    """Pairs of an ancestor (columns outer_*) and a descendant (inner_*)."""
    a = outer.select(id_col, *[F.col(c).alias(f"outer_{c}") for c in ("node_id", "pre", "post", "depth", "local")])
    b = inner.select(id_col, *[F.col(c).alias(f"inner_{c}") for c in ("node_id", "pre", "depth", "kind", "local", "text")])
    within = (F.col("inner_pre") > F.col("outer_pre")) & (F.col("inner_pre") <= F.col("outer_post"))
    return a.join(b, id_col).where(within)


def nearest_ancestor(inner: DataFrame, outer: DataFrame, id_col: str) -> DataFrame:
    """Each inner node with the closest of the outer nodes around it."""
    order = Window.partitionBy(id_col, "inner_node_id").orderBy(F.desc("outer_depth"))
    return descendants(outer, inner, id_col).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def text_of(outer: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """(id_col, node_id, text): the text below each outer node, in document order."""
    texts = nodes.where(F.col("kind") == "text")
    found = descendants(outer, texts, id_col).groupBy(id_col, F.col("outer_node_id").alias("node_id"))
    joined = found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inner_pre", "inner_text"))), lambda t: t["inner_text"]), "").alias("text"))
    return outer.select(id_col, "node_id").join(joined, [id_col, "node_id"], "left").select(id_col, "node_id", F.coalesce("text", F.lit("")).alias("text"))


def children(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id_col, node_id, n_children)."""
    return nodes.where("parent_id IS NOT NULL").groupBy(id_col, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))


def siblings(nodes: DataFrame, id_col: str) -> DataFrame:
    """Each node with its neighbours: previous_id and next_id."""
    order = Window.partitionBy(id_col, "parent_id").orderBy("ordinal")
    return nodes.where("parent_id IS NOT NULL").select(id_col, "node_id", F.lag("node_id").over(order).alias("previous_id"), F.lead("node_id").over(order).alias("next_id"))


def _attribute_text(a: Column) -> Column:
    name = F.when(a["ns"] == XML, F.concat(F.lit("xml:"), a["local"]))
    name = name.when((a["ns"] == XMLNS) & (a["local"] != "xmlns"), F.concat(F.lit("xmlns:"), a["local"]))
    name = name.when(a["ns"] == XLINK, F.concat(F.lit("xlink:"), a["local"])).when((a["ns"] == "") | (a["ns"] == XMLNS), a["local"])
    return F.concat(F.lit(" "), name.otherwise(F.concat(F.lit("unknown_namespace:"), a["local"])), F.lit('="'), escape_attribute(a["value"]), F.lit('"'))


def text_within(nodes: Column, outer: Column) -> Column:
    """The text below a node of a node array, in document order."""
    texts = F.filter(nodes, lambda n: (n["kind"] == "text") & (n["pre"] > outer["pre"]) & (n["pre"] <= outer["post"]))
    return F.array_join(F.transform(texts, lambda n: n["text"]), "")


def _opened(n: Column, over: Column, scripting: bool) -> Column:
    """What a node writes where it begins."""
    raw = (over["ns"] == HTML) & over["local"].isin(*sorted(RAW_TEXT), *(["noscript"] if scripting else []))
    return (
        F.when(n["kind"] == "element", F.concat(F.lit("<"), n["local"], F.array_join(F.transform(n["attrs"], _attribute_text), ""), F.lit(">")))
        .when(n["kind"] == "text", F.when(raw, n["text"]).otherwise(escape_text(n["text"])))
        .when(n["kind"] == "comment", F.concat(F.lit("<!--"), n["text"], F.lit("-->")))
        .when(n["kind"] == "doctype", F.concat(F.lit("<!DOCTYPE "), n["local"], F.lit(">")))
        .otherwise(F.concat(F.lit("<?"), n["target"], F.lit(" "), n["text"], F.lit(">")))
    )


def _closed(n: Column) -> Column:
    """What a node writes where it ends."""
    void = (n["ns"] == HTML) & n["local"].isin(*sorted(VOID))
    return F.when((n["kind"] == "element") & ~void, F.concat(F.lit("</"), n["local"], F.lit(">"))).otherwise(F.lit(""))


def serialize_array(nodes: Column, scripting: bool = True) -> Column:
    """The serialization of a document from its node array, without a shuffle; template contents are left out."""
    contents = F.filter(nodes, lambda n: n["content_of"].isNotNull())
    shown = F.filter(nodes, lambda n: (n["kind"] != "document") & ~F.exists(contents, lambda c: n["pre"].between(c["pre"], c["post"])))

    def events(n):  # a node's id is its place in the array
        opened = _opened(n, F.get(nodes, n["parent_id"]), scripting)
        return F.array(F.struct(n["pre"].alias("at"), F.lit(0).alias("step"), F.lit(0).alias("order"), opened.alias("text")), F.struct(n["post"].alias("at"), F.lit(1).alias("step"), (-n["depth"]).alias("order"), _closed(n).alias("text")))

    return F.array_join(F.transform(F.array_sort(F.flatten(F.transform(shown, events))), lambda e: e["text"]), "")


def serialize(nodes: DataFrame, id_col: str, scripting: bool = True) -> DataFrame:
    """(id_col, html) of whole documents, by built-in functions alone; template contents are left out.

    A node opens at its ``pre`` and closes at its ``post``; deeper nodes close first.
    """
    templates = nodes.where("content_of IS NOT NULL").select(id_col, F.col("pre").alias("c_pre"), F.col("post").alias("c_post"))
    inside = (nodes[id_col] == templates[id_col]) & nodes["pre"].between(templates["c_pre"], templates["c_post"])
    shown = nodes.join(templates, inside, "left_anti").where("kind <> 'document'")
    over = nodes.select(id_col, F.col("node_id").alias("parent_id"), F.col("local").alias("over"), F.col("ns").alias("over_ns"))
    shown = shown.join(over, [id_col, "parent_id"], "left")
    node = {c: F.col(c) for c in ("kind", "ns", "local", "text", "target", "attrs")}
    opened = _opened(node, {"ns": F.col("over_ns"), "local": F.col("over")}, scripting)
    closed = _closed(node)
    events = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("step"), F.lit(0).alias("order"), opened.alias("text")), F.struct(F.col("post").alias("at"), F.lit(1).alias("step"), (-F.col("depth")).alias("order"), closed.alias("text")))
    events = shown.select(id_col, F.inline(events)).where("text <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "step", "order", "text"))), lambda e: e["text"]), "")
    return events.groupBy(id_col).agg(text.alias("html"))


def serialize_tokens(tokens: DataFrame, id_col: str) -> DataFrame:
    """(id_col, html) of a token list as it is, balanced or not; text after a raw text start tag is not escaped."""
    before = Window.partitionBy(id_col).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    is_tag = F.col("kind").isin("start_tag", "end_tag")
    last = F.last(F.when(is_tag, F.struct("kind", "name")), ignorenulls=True).over(before)
    raw = F.coalesce((last["kind"] == "start_tag") & last["name"].isin(*sorted(RAW_TEXT)), F.lit(False))
    text = (
        F.when(F.col("kind") == "start_tag", F.concat(F.lit("<"), F.col("name"), F.array_join(F.transform("attrs", _attribute_text), ""), F.lit(">")))
        .when(F.col("kind") == "end_tag", F.concat(F.lit("</"), F.col("name"), F.lit(">")))
        .when(F.col("kind") == "characters", F.when(raw, F.col("data")).otherwise(escape_text(F.col("data"))))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), F.col("data"), F.lit("-->")))
        .when(F.col("kind") == "doctype", F.concat(F.lit("<!DOCTYPE "), F.coalesce("name", F.lit("")), F.lit(">")))
        .when(F.col("kind") == "instruction", F.concat(F.lit("<?"), F.col("name"), F.lit(" "), F.col("data"), F.lit(">")))
        .otherwise(F.lit(""))
    )
    written = tokens.select(id_col, "seq", text.alias("text")).groupBy(id_col)
    return written.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), "").alias("html"))


def short_tokens(tokens: Column) -> Column:
    """A token array in one line, errors and the end left out: 'text' <name key=value> </name> !comment D(name,public,system,forced)."""
    def one(t):
        attrs = F.array_join(F.transform(t["attrs"], lambda a: F.concat(F.lit(" "), a["local"], F.lit("="), a["value"])), "")
        ids = F.concat_ws(",", *[F.coalesce(t[c], F.lit("-")) for c in ("name", "public_id", "system_id")], F.coalesce(t["force_quirks"], F.lit(False)).cast("string"))
        return (
            F.when(t["kind"].isin("start_tag", "empty_tag"), F.concat(F.lit("<"), t["name"], attrs, F.when(t["self_closing"], "/").otherwise(""), F.lit(">")))
            .when(t["kind"] == "end_tag", F.concat(F.lit("</"), t["name"], F.lit(">")))
            .when(t["kind"] == "characters", F.concat(F.lit("'"), t["data"], F.lit("'")))
            .when(t["kind"] == "comment", F.concat(F.lit("!"), t["data"]))
            .when(t["kind"] == "doctype", F.concat(F.lit("D("), ids, F.lit(")")))
            .when(t["kind"] == "instruction", F.concat(F.lit("instruction:"), t["name"], F.lit(":"), t["data"]))
            .otherwise(t["kind"])
        )

    return F.array_join(F.transform(F.filter(tokens, lambda t: ~t["kind"].isin("error", "eof")), one), " ")


def indented(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id_col, tree): element names and text, four spaces for each level, in document order."""
    line = F.when(F.col("kind") == "element", F.concat(F.lit("<"), F.col("local"), F.lit(">"))).when(F.col("kind") == "text", F.concat(F.lit("#text: "), F.col("text"))).when(F.col("kind") == "document", F.lit("#Document")).otherwise(F.concat(F.lit("#"), F.col("kind"), F.lit(": "), F.coalesce("text", "local", F.lit(""))))
    lines = nodes.select(id_col, "pre", F.concat(F.repeat(F.lit("    "), F.col("depth")), line).alias("line"))
    return lines.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "line"))), lambda x: x["line"]), "\n").alias("tree"))
