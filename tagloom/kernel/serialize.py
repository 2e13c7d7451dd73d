"""Trees back to text."""

from __future__ import annotations

from .chars import HTML, MATHML, SVG, XLINK, XML, XMLNS
from .names import RAW_TEXT, VOID
from .tree import Node, walk

_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "\xa0": "&nbsp;"})
_VALUE = _TEXT | {ord('"'): "&quot;"}


def escape_text(text: str) -> str:
    return text.translate(_TEXT)


def escape_value(text: str) -> str:
    return text.translate(_VALUE)


def _attribute(a) -> str:
    if a.ns == "":
        name = a.local
    elif a.ns == XML:
        name = f"xml:{a.local}"
    elif a.ns == XMLNS:
        name = a.local if a.local == "xmlns" else f"xmlns:{a.local}"
    elif a.ns == XLINK:
        name = f"xlink:{a.local}"
    else:
        name = f"unknown_namespace:{a.local}"
    return f' {name}="{escape_value(a.value)}"'


def serialize_html(top: Node, include: bool = False, scripting: bool = True, templates: bool = False) -> str:
    """The children of a node, or with ``include`` the node too; template contents only with ``templates``."""
    out: list[str] = []
    hidden = 0  # within a void element
    for step, node, depth in walk(top, contents=templates):
        if node.kind == "document" or not include and depth == 0:
            continue
        if node.kind == "element":
            void = node.ns == HTML and node.name in VOID
            if step == "open":
                if not hidden:
                    out.append(f"<{node.name}{''.join(map(_attribute, node.attrs))}>")
                hidden += void
            else:
                hidden -= void
                if not hidden and not void:
                    out.append(f"</{node.name}>")
        elif step == "open" and not hidden:
            if node.kind == "text":
                over = node.parent
                raw = over is not None and over.ns == HTML and (over.name in RAW_TEXT or over.name == "noscript" and scripting)
                out.append(node.data if raw else escape_text(node.data))
            elif node.kind == "comment":
                out.append(f"<!--{node.data}-->")
            elif node.kind == "doctype":
                out.append(f"<!DOCTYPE {node.name}>")
            else:
                out.append(f"<?{node.name} {node.data}>")
    return "".join(out)


_SHOWN = {SVG: "svg ", MATHML: "math ", XLINK: "xlink ", XML: "xml ", XMLNS: "xmlns "}


def dump(top: Node) -> str:
    """A line for each node below, indented by depth; template contents under "content"."""
    out = []
    for step, node, depth in walk(top):
        if step == "close" or depth == 0:
            continue
        pad = "| " + "  " * (depth - 1)
        if node.kind == "element":
            out.append(f"{pad}<{_SHOWN.get(node.ns, '')}{node.name}>")
            shown = sorted((a.local, f"{_SHOWN.get(a.ns, '')}{a.local}", a.value) for a in node.attrs)
            out += [f'{pad}  {name}="{value}"' for _, name, value in shown]
        elif node.kind == "text":
            out.append(f'{pad}"{node.data}"')
        elif node.kind == "comment":
            out.append(f"{pad}<!-- {node.data} -->")
        elif node.kind == "doctype":
            ids = f' "{node.public_id}" "{node.system_id}"' if node.public_id or node.system_id else ""
            out.append(f"{pad}<!DOCTYPE {node.name}{ids}>")
        elif node.kind == "instruction":
            out.append(f"{pad}<?{node.name} {node.data}>")
        else:
            out.append(f"{pad}content")
    return "\n".join(out)
