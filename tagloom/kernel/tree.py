"""The tree that parsers build, and its log of edits."""

from __future__ import annotations

from collections.abc import Iterator

from .chars import HTML
from .tokens import Attribute


class Node:
    """kind: document, doctype, element, text, comment or instruction; data: text, or an instruction's content."""

    # what most nodes never change
    prefix = public_id = system_id = parent = content = line = form = None
    had_duplicates = mathml_ip = False
    number = at = html_below = -1  # at, html_below: places among the open elements

    def __init__(self, kind: str, name: str | None = None, ns: str = "", attrs=(), data: str | None = None):
        self.kind, self.name, self.ns, self.data = kind, name, ns, data
        self.attrs: list[Attribute] = list(attrs)
        self.children: list[Node] = []

    def get(self, local: str) -> str | None:
        return next((a.value for a in self.attrs if a.local == local and not a.ns), None)

    def html(self, *names: str) -> bool:
        return self.ns == HTML and self.name in names


def _place(children: list[Node], node: Node) -> int:
    """Searched from the end, where most edits are."""
    at = len(children) - 1
    while children[at] is not node:
        at -= 1
    return at


class Document:
    """Edits of a tree; with ``log`` each edit is kept as (op, target, other, name, text)."""

    def __init__(self, log: bool = False):
        self.root = Node("document")
        self.quirks_mode = "no-quirks"
        self.errors: list[tuple[int, str, str]] = []
        self.encodings: list[str] = []
        self.scripts: list[Node] = []
        self.actions: list[tuple] | None = [] if log else None
        self._numbers = 0
        self._number(self.root)

    def _number(self, node: Node) -> Node:
        node.number = self._numbers
        self._numbers += 1
        return node

    def note(self, op: str, target: Node | None = None, other: Node | None = None, name: str | None = None, text: str | None = None) -> None:
        if self.actions is not None:
            self.actions.append((op, target.number if target else None, other.number if other else None, name, text))

    def error(self, line: int, stage: str, message: str) -> None:
        self.errors.append((line, stage, message))
        self.note("parse_error", text=message)

    def element(self, name: str, ns: str, attrs, line: int | None = None, had_duplicates: bool = False) -> Node:
        node = Node("element", name, ns, attrs)
        node.number, node.line = self._numbers, line
        self._numbers += 1
        if had_duplicates:
            node.had_duplicates = True
        if name == "template" and ns == HTML:
            node.content = self._number(Node("document"))
        if self.actions is not None:
            self.note("create_element", node, name=name, text=ns)
        return node

    def comment(self, data: str) -> Node:
        node = self._number(Node("comment", data=data))
        self.note("create_comment", node, text=data)
        return node

    def instruction(self, target: str, data: str) -> Node:
        node = self._number(Node("instruction", name=target, data=data))
        self.note("create_pi", node, name=target, text=data)
        return node

    def doctype(self, name: str, public_id: str, system_id: str) -> None:
        node = self._number(Node("doctype", name=name))
        node.public_id, node.system_id = public_id, system_id
        node.parent = self.root
        self.root.children.append(node)
        self.note("append_doctype_to_document", node, name=name)

    def append(self, parent: Node, child: Node) -> None:
        if child.parent is not None:
            self.detach(child)
        child.parent = parent
        parent.children.append(child)
        if self.actions is not None:
            self.note("append", parent, child)

    def append_text(self, parent: Node, text: str) -> None:
        """Text joins a text node that is there already."""
        if self.actions is not None:
            self.note("append", parent, text=text)
        if parent.children and parent.children[-1].kind == "text":
            parent.children[-1].data += text
        else:
            node = self._number(Node("text", data=text))
            node.parent = parent
            parent.children.append(node)

    def insert_before(self, sibling: Node, child: Node) -> None:
        self.detach(child)
        siblings = sibling.parent.children
        child.parent = sibling.parent
        siblings.insert(_place(siblings, sibling), child)
        self.note("append_before_sibling", sibling, child)

    def insert_text_before(self, sibling: Node, text: str) -> None:
        self.note("append_before_sibling", sibling, text=text)
        siblings = sibling.parent.children
        at = _place(siblings, sibling)
        if at and siblings[at - 1].kind == "text":
            siblings[at - 1].data += text
        else:
            node = self._number(Node("text", data=text))
            node.parent = sibling.parent
            siblings.insert(at, node)

    def detach(self, node: Node) -> None:
        if node.parent is not None:
            del node.parent.children[_place(node.parent.children, node)]
            self.note("remove_from_parent", node)
            node.parent = None

    def move_children(self, old: Node, new: Node) -> None:
        for child in old.children:
            child.parent = new
        new.children += old.children
        old.children = []
        self.note("reparent_children", old, new)

    def add_missing_attributes(self, node: Node, attrs: list[Attribute]) -> None:
        have = {(a.ns, a.local) for a in node.attrs}
        node.attrs += [a for a in attrs if (a.ns, a.local) not in have]
        self.note("add_attrs_if_missing", node)


def walk(top: Node, contents: bool = True) -> Iterator[tuple[str, Node, int]]:
    """("open" or "close", node, depth) in document order, without recursion; contents: visit template contents too."""
    todo: list[tuple[str, Node, int]] = [("open", top, 0)]
    while todo:
        step, node, depth = todo.pop()
        yield step, node, depth
        if step == "open":
            todo.append(("close", node, depth))
            todo += [("open", c, depth + 1) for c in reversed(node.children)]
            if contents and node.content is not None:
                todo.append(("open", node.content, depth + 1))
