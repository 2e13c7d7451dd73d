"""Trees and tokens as rows of plain values, and back."""

from __future__ import annotations

from . import html_tokenizer, html_tree, xml
from .tokens import Attribute, Characters, Comment, Doctype, Error, Instruction, Null, Tag
from .tree import Document, Node

NODE_FIELDS = ("node_id", "parent_id", "ordinal", "depth", "pre", "post", "content_of", "kind", "prefix", "ns", "local", "attrs", "text", "public_id", "system_id", "target", "mathml_ip", "had_duplicate_attributes", "line", "form_id")


def node_rows(doc: Document) -> list[dict]:
    """A dict for each node in document order; pre is its number there, post the largest number in its subtree."""
    rows: list[dict] = []
    number: dict[int, int] = {}
    todo: list[tuple] = [(doc.root, None, 0, 0, None)]
    open_rows: list[dict] = []
    while todo:
        node, parent, ordinal, depth, content_of = todo.pop()
        pre = len(rows)
        while open_rows and open_rows[-1]["depth"] >= depth:
            open_rows.pop()["post"] = pre - 1
        number[id(node)] = pre
        element = node.kind == "element"
        row = dict.fromkeys(NODE_FIELDS) | {
            "node_id": pre, "parent_id": parent, "ordinal": ordinal, "depth": depth, "pre": pre, "post": pre, "content_of": content_of, "kind": node.kind, "prefix": node.prefix,
            "ns": node.ns if element else None, "local": node.name if element or node.kind == "doctype" else None, "attrs": [a._asdict() for a in node.attrs], "text": node.data, "public_id": node.public_id, "system_id": node.system_id,
            "target": node.name if node.kind == "instruction" else None, "mathml_ip": node.mathml_ip, "had_duplicate_attributes": node.had_duplicates, "line": node.line, "form_id": node.form,
        }
        rows.append(row)
        open_rows.append(row)
        todo += [(c, pre, i, depth + 1, None) for i, c in reversed(list(enumerate(node.children)))]
        if node.content is not None:
            todo.append((node.content, None, 0, depth + 1, pre))
    for row in open_rows:
        row["post"] = len(rows) - 1
    for row in rows:
        if row["form_id"] is not None:
            row["form_id"] = number.get(id(row["form_id"]))
    return rows


def script_ids(doc: Document, rows: list[dict]) -> list[int]:
    """Numbers of the script elements that ended, in that order."""
    wanted = {id(s) for s in doc.scripts}
    found: dict[int, int] = {}
    todo: list[Node] = [doc.root]
    n = 0
    while todo:
        node = todo.pop()
        if id(node) in wanted:
            found[id(node)] = n
        n += 1
        todo += reversed(node.children)
        if node.content is not None:
            todo.append(node.content)
    return [found[id(s)] for s in doc.scripts if id(s) in found]


def tree_of(rows: list[dict]) -> Node:
    """The document node of rows that node_rows made."""
    nodes: dict[int, Node] = {}
    for r in sorted(rows, key=lambda r: r["pre"]):
        name = r["target"] if r["kind"] == "instruction" else r["local"]
        node = Node(r["kind"], name, r["ns"] or "", [Attribute(a["prefix"], a["ns"], a["local"], a["value"]) for a in r["attrs"] or ()], r["text"])
        node.prefix, node.public_id, node.system_id = r["prefix"], r["public_id"], r["system_id"]
        nodes[r["node_id"]] = node
        if r["content_of"] is not None:
            nodes[r["content_of"]].content = node
        elif r["parent_id"] is not None:
            node.parent = nodes[r["parent_id"]]
            node.parent.children.append(node)
    return nodes[0] if nodes else Node("document")


TOKEN_FIELDS = ("seq", "line", "kind", "name", "prefix", "self_closing", "had_duplicate_attributes", "attrs", "data", "public_id", "system_id", "force_quirks")


def token_rows(tokens: list[tuple]) -> list[dict]:
    rows = []
    for seq, (t, line) in enumerate(tokens):
        row = dict.fromkeys(TOKEN_FIELDS) | {"seq": seq, "line": line, "kind": type(t).__name__.lower(), "attrs": []}
        if isinstance(t, Tag):
            attrs = [a if isinstance(a, Attribute) else Attribute(None, "", *a) for a in t.attrs]
            row |= {"kind": f"{t.kind}_tag", "name": t.name, "prefix": t.prefix, "self_closing": t.self_closing, "had_duplicate_attributes": t.had_duplicates, "attrs": [a._asdict() for a in attrs]}
        elif isinstance(t, Doctype):
            row |= {"name": t.name, "public_id": t.public_id, "system_id": t.system_id, "force_quirks": t.force_quirks}
        elif isinstance(t, (Characters, Comment)):
            row["data"] = t.data
        elif isinstance(t, Instruction):
            row |= {"name": t.target, "data": t.data}
        elif isinstance(t, Error):
            row["data"] = t.message
        elif isinstance(t, Null):
            row["data"] = "\0"
        rows.append(row)
    return rows


def html_tokens(text: str, with_tree: bool = False, **options) -> list[dict]:
    """Token rows; with_tree: as a tree builder sees them, so that raw text states apply."""
    if not with_tree:
        return token_rows(html_tokenizer.tokenize(text, **options))
    builder = html_tree.TreeBuilder(Document())
    seen: list[tuple] = []

    def sink(token, line):
        if isinstance(token, Characters) and seen and isinstance(seen[-1][0], Characters):
            seen[-1] = (Characters(seen[-1][0].data + token.data), seen[-1][1])
        else:
            seen.append((token, line))
        builder(token, line)

    builder.tokenizer = html_tokenizer.Tokenizer(text, sink, **options)
    builder.tokenizer.run()
    return token_rows(seen)


def xml_tokens(text: str, **options) -> list[dict]:
    return token_rows(xml.tokenize(text, **options))
