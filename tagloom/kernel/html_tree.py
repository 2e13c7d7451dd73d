"""HTML tree construction: the insertion modes of the standard over a stack of nodes.

A mode is a method that handles one token and returns True if the token has to be
processed again, since the mode has changed. All walks are loops, and searches of the
stack go through its index, so deep input takes no more than wide input.
"""

from __future__ import annotations

import re

from . import html_tokenizer as lex
from .chars import HTML, MATHML, REPLACEMENT, SVG, WHITE, ascii_lower
from .names import (
    BLOCK_ENDS, BLOCKS, BREAKOUT, BUTTON_SCOPE, FOREIGN_ATTRIBUTES, FORM_OWNED, FORMATTING, HEADINGS, HTML4_PREFIXES, IMPLIED_END, IMPLIED_END_THOROUGH, INTEGRATION_MATHML, INTEGRATION_SVG, LIMITED_PREFIXES,
    LIST_SCOPE, MATHML_ATTRIBUTES, MAY_STAY_OPEN, QUIRKS_PREFIXES, QUIRKS_PUBLIC, QUIRKS_SYSTEM, SCOPE, SPECIAL, SVG_ATTRIBUTES, SVG_TAGS, TABLE_SCOPE,
)
from .tokens import Attribute, Characters, Comment, Doctype, Eof, Error, Null, Tag
from .stack import ITEM_BOUND, MODAL, OpenElements
from .tree import Document, Node

_RUNS = re.compile(r"[\t\n\f\r ]+|[^\t\n\f\r ]+")
_CHARSET = re.compile(r"charset[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\t\n\f\r ;][^\t\n\f\r ;]*))", re.IGNORECASE | re.ASCII)
MARKER = None
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
TABLE_PARENTS = TABLE_PARTS | {"template"}
INTEGRATION = INTEGRATION_MATHML | INTEGRATION_SVG
HEAD_VOID = frozenset("base basefont bgsound link meta".split())


def extract_charset(content: str) -> str | None:
    """The encoding that a content attribute names, as it stands there."""
    at = 0
    while (m := re.compile("charset[\t\n\f\r ]*=?", re.IGNORECASE | re.ASCII).search(content, at)) is not None:
        if not m[0].endswith("="):
            at = m.start() + 7
            continue
        found = _CHARSET.match(content, m.start())
        return next((g for g in found.groups() if g is not None), None) if found else None
    return None


def quirks_of(token: Doctype, iframe_srcdoc: bool = False) -> str:
    """The document mode that a doctype asks for: "quirks", "limited-quirks" or "no-quirks"."""
    if token.force_quirks or token.name != "html":
        return "quirks"
    if iframe_srcdoc:
        return "no-quirks"
    public = None if token.public_id is None else ascii_lower(token.public_id)
    system = None if token.system_id is None else ascii_lower(token.system_id)
    if public in QUIRKS_PUBLIC or system in QUIRKS_SYSTEM:
        return "quirks"
    if public is not None:
        if public.startswith(QUIRKS_PREFIXES):
            return "quirks"
        if public.startswith(LIMITED_PREFIXES):
            return "limited-quirks"
        if public.startswith(HTML4_PREFIXES):
            return "quirks" if system is None else "limited-quirks"
    return "no-quirks"


class TreeBuilder:
    def __init__(self, doc: Document, scripting: bool = True, iframe_srcdoc: bool = False, drop_doctype: bool = False):
        self.doc, self.scripting, self.iframe_srcdoc, self.drop_doctype = doc, scripting, iframe_srcdoc, drop_doctype
        self.tokenizer: lex.Tokenizer | None = None
        self.mode = self.original = self.initial
        self.template_modes: list = []
        self.stack = OpenElements()
        self.formatting: list[tuple[Node, Tag, tuple] | None] = []  # with a key that equal entries of a segment share
        self.alike: dict[tuple, list[Node]] = {}
        self.segments = [0]  # a number for what lies between two markers
        self.n_segments = 0
        self.head: Node | None = None
        self.form: Node | None = None
        self.context: Node | None = None
        self.frameset_ok, self.fostering, self.skip_newline = True, False, False
        self.pending: list[str] = []
        self.line = 1
        self.acknowledged = False

    # dispatch -----------------------------------------------------------------

    def __call__(self, token, line: int) -> None:
        self.line = line
        kind = type(token)
        if kind is Tag:
            self.skip_newline = False
            self._process(token)
            if self.stack.foreign or self.context is not None or self.tokenizer.foreign:
                node = self._adjusted()
                self.tokenizer.foreign = node is not None and node.ns != HTML
            return
        if kind is Error:
            self.doc.error(line, "tokenizer", token.message)
            return
        if kind is Doctype:
            self._doctype(token)
            return
        if kind is Characters:
            text = token.data
            if self.skip_newline:
                self.skip_newline = False
                text = text.removeprefix("\n")
            if text:
                self._characters(text)
        else:
            self.skip_newline = False
            self._process(token)

    def _characters(self, text: str) -> None:
        """White space and other text apart, where the mode tells them apart."""
        at = 0
        while at < len(text):
            whole = self.mode.__func__ in WHOLE_TEXT and not ((self.stack.foreign or self.context is not None) and self._is_foreign(Characters("")))
            data = (text[at:] if at else text) if whole else _RUNS.match(text, at)[0]
            at += len(data)
            self._process(Characters(data))

    def _process(self, token) -> None:
        self.acknowledged = False
        again = True
        while again:
            foreign = (self.stack.foreign or self.context is not None) and self._is_foreign(token)
            again = self.in_foreign(token) if foreign else self.mode(token)
        if type(token) is Tag and token.kind == "start" and token.self_closing and not self.acknowledged:
            self.error("unacknowledged self-closing tag")

    def _is_foreign(self, token) -> bool:
        node = self._adjusted()
        if node is None or node.ns == HTML or type(token) is Eof:
            return False
        start = type(token) is Tag and token.kind == "start"
        text = type(token) in (Characters, Null)
        key = (node.ns, node.name)
        if key in INTEGRATION_MATHML and (text or start and token.name not in ("mglyph", "malignmark")):
            return False
        if key == (MATHML, "annotation-xml") and start and token.name == "svg":
            return False
        return not ((key in INTEGRATION_SVG or node.mathml_ip) and (text or start))

    def _adjusted(self) -> Node | None:
        if len(self.stack) == 1 and self.context is not None:
            return self.context
        return self.stack[-1] if self.stack else None

    def error(self, message: str) -> None:
        self.doc.error(self.line, "tree", message)

    def unexpected(self, token) -> bool:
        what = f"{token.kind} tag {token.name}" if type(token) is Tag else type(token).__name__.lower()
        self.error(f"unexpected {what} in mode {self.mode.__name__.replace('_', ' ')}")
        return False

    def to(self, mode) -> bool:
        """Change the mode and process the token again."""
        self.mode = mode
        return True

    # the stack ------------------------------------------------------------------

    @property
    def current(self) -> Node:
        return self.stack[-1]

    def pop(self) -> Node:
        node = self.stack.pop()
        if self.doc.actions is not None:
            self.doc.note("pop", node)
        return node

    def pop_until(self, *names: str) -> None:
        while self.stack:
            if self.pop().html(*names):
                break

    def pop_to_context(self, *names: str) -> None:
        while not self.current.html(*names, "html", "template"):
            self.pop()

    def in_scope(self, *names: str, scope=SCOPE) -> bool:
        place = self.stack.last(*names)
        return place >= 0 and place >= self.stack.last_of(scope)

    def implied_ends(self, names=IMPLIED_END, but: str | None = None) -> None:
        while self.stack and self.current.ns == HTML and self.current.name in names and self.current.name != but:
            self.pop()

    def close(self, *names: str, but: str | None = None) -> None:
        """Generate implied end tags, then pop to the element, with an error if it is not current."""
        self.implied_ends(but=but)
        if not self.current.html(*names):
            self.error(f"open elements at the end of {names[0]}")
        self.pop_until(*names)

    def close_p(self) -> None:
        if self.in_scope("p", scope=BUTTON_SCOPE):
            self.close("p", but="p")

    def is_open(self, node: Node) -> bool:
        return node.at >= 0

    def has_template(self) -> bool:
        return self.stack.last("template") >= 0

    # insertion --------------------------------------------------------------------

    def place(self, target: Node | None = None) -> tuple[Node, Node | None]:
        """Where to insert: a parent, and the child to go before (None: at the end)."""
        target = target or self.current
        if self.fostering and target.ns == HTML and target.name in TABLE_PARTS:
            template, table = self.stack.last("template"), self.stack.last("table")
            if template > table:
                return self.stack[template].content, None
            if table < 0:
                target = self.stack[0]
            elif self.stack[table].parent is not None:
                return self.stack[table].parent, self.stack[table]
            else:
                target = self.stack[table - 1]
        return (target.content if target.content is not None else target), None

    def put(self, node: Node, target: Node | None = None) -> None:
        if target is None and not self.fostering:
            parent = self.stack[-1]
            self.doc.append(parent if parent.content is None else parent.content, node)
            return
        parent, before = self.place(target)
        if before is not None:
            self.doc.insert_before(before, node)
        else:
            self.doc.append(parent, node)

    def put_text(self, text: str) -> None:
        parent, before = self.place()
        if before is not None:
            self.doc.insert_text_before(before, text)
        elif parent.kind != "document" or parent is not self.doc.root:
            self.doc.append_text(parent, text)

    def put_comment(self, token: Comment, parent: Node | None = None) -> bool:
        node = self.doc.comment(token.data)
        if parent is None:
            self.put(node)
        else:
            self.doc.append(parent, node)
        return False

    def create(self, tag: Tag, ns: str = HTML) -> Node:
        attrs = [a if isinstance(a, Attribute) else Attribute(None, "", *a) for a in tag.attrs] if tag.attrs else ()
        node = self.doc.element(tag.name, ns, attrs, self.line, tag.had_duplicates)
        if ns == MATHML and tag.name == "annotation-xml":
            node.mathml_ip = ascii_lower(node.get("encoding") or "") in ("text/html", "application/xhtml+xml")
        return node

    def insert(self, tag: Tag, ns: str = HTML) -> Node:
        node = self.create(tag, ns)
        if self.form is not None:
            self._own_form(tag, node)
        self.put(node)
        self.stack.append(node)
        return node

    def insert_void(self, tag: Tag, ns: str = HTML) -> Node:
        node = self.insert(tag, ns)
        self.pop()
        self.acknowledged = True
        return node

    def insert_named(self, name: str) -> Node:
        return self.insert(Tag("start", name))

    def _own_form(self, tag: Tag, node: Node) -> None:
        if node.ns != HTML or tag.name not in FORM_OWNED or self.has_template():
            return
        if tag.name != "img" and any(a[-2] == "form" for a in tag.attrs):
            return
        node.form = self.form
        self.doc.note("associate_with_form", node, self.form)

    def raw_text(self, tag: Tag, state: str) -> bool:
        self.insert(tag)
        self.tokenizer.state = state
        self.original, self.mode = self.mode, self.text
        return False

    # active formatting elements ------------------------------------------------------

    def push_marker(self) -> None:
        self.formatting.append(MARKER)
        self.n_segments += 1
        self.segments.append(self.n_segments)

    def push_formatting(self, node: Node, tag: Tag) -> None:
        key = (self.segments[-1], tag.name, frozenset(tag.attrs))
        same = self.alike.setdefault(key, [])
        if len(same) >= 3:
            self._forget(min(map(self._formatted, same)))
        self.formatting.append((node, tag, key))
        same.append(node)

    def _forget(self, at: int) -> None:
        node, _, key = self.formatting.pop(at)
        self.alike[key].remove(node)

    def _renew(self, at: int, node: Node) -> None:
        """Another element takes the place of an entry."""
        old, tag, key = self.formatting[at]
        self.formatting[at] = (node, tag, key)
        same = self.alike[key]
        same[same.index(old)] = node

    def reconstruct(self) -> None:
        i = len(self.formatting)
        while i and self.formatting[i - 1] is not MARKER and not self.is_open(self.formatting[i - 1][0]):
            i -= 1
        for j in range(i, len(self.formatting)):
            self._renew(j, self.insert(self.formatting[j][1]))

    def clear_formatting(self) -> None:
        while self.formatting:
            entry = self.formatting.pop()
            if entry is MARKER:
                self.segments.pop()
                break
            self.alike.pop(entry[2], None)

    def _formatted(self, node: Node) -> int | None:
        for i in range(len(self.formatting) - 1, -1, -1):
            if self.formatting[i] is not MARKER and self.formatting[i][0] is node:
                return i
        return None

    def formatting_named(self, name: str) -> Node | None:
        for entry in reversed(self.formatting):
            if entry is MARKER:
                return None
            if entry[1].name == name:
                return entry[0]
        return None

    def adopt(self, tag: Tag) -> None:
        """The adoption agency algorithm, for the end of a formatting element."""
        name = tag.name
        if self.current.html(name) and self._formatted(self.current) is None:
            self.pop()
            return
        for _ in range(8):
            element = self.formatting_named(name)
            if element is None:
                self.other_end(tag)
                return
            at = self._formatted(element)
            if not self.is_open(element):
                self.error("formatting element not open")
                self._forget(at)
                return
            if not self.in_scope_node(element):
                self.error("formatting element not in scope")
                return
            if element is not self.current:
                self.error("formatting element not current")
            depth = element.at
            block_at = self.stack.first_after(SPECIAL, depth)
            if block_at is None:
                while self.pop() is not element:
                    pass
                self._forget(at)
                return
            block, ancestor = self.stack[block_at], self.stack[depth - 1]
            bookmark, last, i, inner = at, block, block_at, 0
            while True:
                i, inner = i - 1, inner + 1
                node = self.stack[i]
                if node is element:
                    break
                listed = self._formatted(node)
                if inner > 3 and listed is not None:
                    self._forget(listed)
                    bookmark -= listed < bookmark
                    listed = None
                if listed is None:
                    del self.stack[i]
                    continue
                own = self.formatting[listed][1]
                copy = self.create(own)
                self._renew(listed, copy)
                self.stack[i] = copy
                if last is block:
                    bookmark = listed + 1
                self.doc.append(copy, last)
                last = copy
            self.doc.detach(last)
            self.put(last, ancestor)
            at = self._formatted(element)
            own, key = self.formatting[at][1:]
            copy = self.create(own)
            self.doc.move_children(block, copy)
            self.doc.append(block, copy)
            self._forget(at)
            self.formatting.insert(bookmark - (at < bookmark), (copy, own, key))
            self.alike[key].append(copy)
            self.stack.remove(element)
            self.stack.insert(block.at + 1, copy)

    def in_scope_node(self, wanted: Node) -> bool:
        return wanted.at >= 0 and wanted.at >= self.stack.last_of(SCOPE)

    def other_end(self, tag: Tag) -> None:
        place = self.stack.last(tag.name)
        if place >= 0 and place >= self.stack.last_of(SPECIAL):
            node = self.stack[place]
            self.implied_ends(but=tag.name)
            if node is not self.current:
                self.error(f"open elements at the end of {tag.name}")
            while self.stack and self.pop() is not node:
                pass
        elif self.stack.last_of(SPECIAL) >= 0:
            self.error(f"unexpected end tag {tag.name}")

    # modes: before the body -------------------------------------------------------------

    def _doctype(self, token: Doctype) -> None:
        if self.mode != self.initial:
            self.error("doctype in the wrong place")
            return
        if token.name != "html" or token.public_id is not None or token.system_id not in (None, "about:legacy-compat"):
            self.error("obsolete or unknown doctype")
        if not self.drop_doctype:
            self.doc.doctype(token.name or "", token.public_id or "", token.system_id or "")
        self._set_quirks(quirks_of(token, self.iframe_srcdoc))
        self.mode = self.before_html

    def _set_quirks(self, mode: str) -> None:
        self.doc.quirks_mode = mode
        self.doc.note("set_quirks_mode", text=mode)

    def initial(self, t) -> bool:
        if type(t) is Characters and t.data[0] in WHITE:
            return False
        if type(t) is Comment:
            return self.put_comment(t, self.doc.root)
        if not self.iframe_srcdoc:
            self.error("no doctype")
            self._set_quirks("quirks")
        return self.to(self.before_html)

    def _make_root(self, tag: Tag) -> None:
        node = self.create(tag)
        self.stack.append(node)
        self.doc.append(self.doc.root, node)
        self.mode = self.before_head

    def before_html(self, t) -> bool:
        if type(t) is Comment:
            return self.put_comment(t, self.doc.root)
        if type(t) is Characters and t.data[0] in WHITE:
            return False
        if type(t) is Tag:
            if t.kind == "start" and t.name == "html":
                self._make_root(t)
                return False
            if t.kind == "end" and t.name not in ("head", "body", "html", "br"):
                return self.unexpected(t)
        self._make_root(Tag("start", "html"))
        return True

    def before_head(self, t) -> bool:
        if type(t) is Characters and t.data[0] in WHITE:
            return False
        if type(t) is Comment:
            return self.put_comment(t)
        if type(t) is Tag:
            if t.kind == "start" and t.name == "html":
                return self.in_body(t)
            if t.kind == "start" and t.name == "head":
                self.head = self.insert(t)
                self.mode = self.in_head
                return False
            if t.kind == "end" and t.name not in ("head", "body", "html", "br"):
                return self.unexpected(t)
        self.head = self.insert_named("head")
        return self.to(self.in_head)

    def in_head(self, t) -> bool:
        if type(t) is Characters and t.data[0] in WHITE:
            self.put_text(t.data)
            return False
        if type(t) is Comment:
            return self.put_comment(t)
        if type(t) is Tag and t.kind == "start":
            name = t.name
            if name == "html":
                return self.in_body(t)
            if name in HEAD_VOID:
                self._encoding(self.insert_void(t))
                return False
            if name == "title":
                return self.raw_text(t, lex.RCDATA)
            if name in ("noframes", "style") or name == "noscript" and self.scripting:
                return self.raw_text(t, lex.RAWTEXT)
            if name == "noscript":
                self.insert(t)
                self.mode = self.in_head_noscript
                return False
            if name == "script":
                node = self.create(t)
                if self.context is not None:
                    self.doc.note("mark_script_already_started", node)
                self.put(node)
                self.stack.append(node)
                self.tokenizer.state = lex.SCRIPT
                self.original, self.mode = self.mode, self.text
                return False
            if name == "template":
                self.push_marker()
                self.frameset_ok = False
                self.insert(t)
                self.mode = self.in_template
                self.template_modes.append(self.in_template)
                return False
            if name == "head":
                return self.unexpected(t)
        elif type(t) is Tag:
            if t.name == "head":
                self.pop()
                self.mode = self.after_head
                return False
            if t.name == "template":
                return self._end_template(t)
            if t.name not in ("body", "html", "br"):
                return self.unexpected(t)
        self.pop()
        return self.to(self.after_head)

    def _end_template(self, t: Tag) -> bool:
        if not self.has_template():
            return self.unexpected(t)
        self.implied_ends(IMPLIED_END_THOROUGH)
        if not self.current.html("template"):
            self.error("open elements at the end of template")
        self.pop_until("template")
        self.clear_formatting()
        self.template_modes.pop()
        self.reset_mode()
        return False

    def _encoding(self, node: Node) -> None:
        charset = node.get("charset")
        if charset is None and ascii_lower(node.get("http-equiv") or "") == "content-type" and node.get("content") is not None:
            charset = extract_charset(node.get("content"))
        if charset is not None:
            self.doc.encodings.append(charset)

    def in_head_noscript(self, t) -> bool:
        if type(t) is Comment or type(t) is Characters and t.data[0] in WHITE:
            return self.in_head(t)
        if type(t) is Tag and t.kind == "start":
            if t.name == "html":
                return self.in_body(t)
            if t.name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
                return self.in_head(t)
            if t.name in ("head", "noscript"):
                return self.unexpected(t)
        elif type(t) is Tag:
            if t.name == "noscript":
                self.pop()
                self.mode = self.in_head
                return False
            if t.name != "br":
                return self.unexpected(t)
        self.unexpected(t)
        self.pop()
        return self.to(self.in_head)

    def after_head(self, t) -> bool:
        if type(t) is Characters and t.data[0] in WHITE:
            self.put_text(t.data)
            return False
        if type(t) is Comment:
            return self.put_comment(t)
        if type(t) is Tag and t.kind == "start":
            if t.name == "html":
                return self.in_body(t)
            if t.name == "body":
                self.insert(t)
                self.frameset_ok = False
                self.mode = self.in_body
                return False
            if t.name == "frameset":
                self.insert(t)
                self.mode = self.in_frameset
                return False
            if t.name in HEAD_VOID or t.name in ("noframes", "script", "style", "template", "title"):
                self.unexpected(t)
                self.stack.append(self.head)
                self.in_head(t)
                self.stack.remove(self.head)
                return False
            if t.name == "head":
                return self.unexpected(t)
        elif type(t) is Tag:
            if t.name == "template":
                return self.in_head(t)
            if t.name not in ("body", "html", "br"):
                return self.unexpected(t)
        self.insert_named("body")
        return self.to(self.in_body)

    # mode: in body -----------------------------------------------------------------------

    def in_body(self, t) -> bool:
        kind = type(t)
        if kind is Characters:
            self.reconstruct()
            self.put_text(t.data)
            if self.frameset_ok and t.data.strip(WHITE):
                self.frameset_ok = False
            return False
        if kind is Tag:
            rule = (self._body_start if t.kind == "start" else self._body_end)(t)
            return bool(rule)
        if kind is Comment:
            return self.put_comment(t)
        if kind is Null:
            return self.unexpected(t)
        if kind is Eof:
            if self.template_modes:
                return self.in_template(t)
            self._check_open()
        return False

    def _check_open(self) -> None:
        if any(not (n.ns == HTML and n.name in MAY_STAY_OPEN) for n in self.stack):
            self.error("open elements at the end of the body")

    def _body_start(self, t: Tag) -> bool | None:
        name = t.name
        if name in BLOCKS or name == "menu":
            self.close_p()
            self.insert(t)
        elif name == "a":
            if (old := self.formatting_named("a")) is not None:
                self.error("a inside of a")
                self.adopt(Tag("end", "a"))
                if (at := self._formatted(old)) is not None:
                    self._forget(at)
                if old.at >= 0:
                    self.stack.remove(old)
            self.reconstruct()
            self.push_formatting(self.insert(t), t)
        elif name in FORMATTING:
            self.reconstruct()
            self.push_formatting(self.insert(t), t)
        elif name in HEADINGS:
            self.close_p()
            if self.current.ns == HTML and self.current.name in HEADINGS:
                self.error("heading inside of a heading")
                self.pop()
            self.insert(t)
        elif name in ("li", "dd", "dt"):
            self._item(t)
        elif name in ("area", "br", "embed", "img", "keygen", "wbr"):
            self.reconstruct()
            self.insert_void(t)
            self.frameset_ok = False
        elif name in HEAD_VOID or name in ("noframes", "script", "style", "template", "title"):
            return self.in_head(t)
        elif name in ("pre", "listing"):
            self.close_p()
            self.insert(t)
            self.skip_newline = True
            self.frameset_ok = False
        elif name == "table":
            if self.doc.quirks_mode != "quirks":
                self.close_p()
            self.insert(t)
            self.frameset_ok = False
            self.mode = self.in_table
        elif name == "form":
            if self.form is not None and not self.has_template():
                self.error("form inside of a form")
                return False
            self.close_p()
            node = self.insert(t)
            if not self.has_template():
                self.form = node
        elif name == "button":
            if self.in_scope("button"):
                self.error("button inside of a button")
                self.implied_ends()
                self.pop_until("button")
            self.reconstruct()
            self.insert(t)
            self.frameset_ok = False
        elif name == "input":
            if self.context is not None and self.context.html("select"):
                return self.unexpected(t)
            if self.in_scope("select"):
                self.error("input inside of a select")
                self.pop_until("select")
            self.reconstruct()
            node = self.insert_void(t)
            if ascii_lower(node.get("type") or "") != "hidden":
                self.frameset_ok = False
        elif name == "select":
            if self.context is not None and self.context.html("select"):
                return self.unexpected(t)
            if self.in_scope("select"):
                self.error("select inside of a select")
                self.pop_until("select")
                return False
            self.reconstruct()
            self.insert(t)
            self.frameset_ok = False
        elif name in ("option", "optgroup"):
            if self.in_scope("select"):
                self.implied_ends(but="optgroup" if name == "option" else None)
                if self.in_scope("option") or name == "optgroup" and self.in_scope("optgroup"):
                    self.error(f"open option at the start of {name}")
            elif self.current.html("option"):
                self.pop()
            self.reconstruct()
            self.insert(t)
        elif name == "hr":
            self.close_p()
            if self.in_scope("select"):
                self.implied_ends()
                if self.in_scope("option", "optgroup"):
                    self.error("hr inside of an option")
            self.insert_void(t)
            self.frameset_ok = False
        elif name in ("param", "source", "track"):
            self.insert_void(t)
        elif name == "textarea":
            self.raw_text(t, lex.RCDATA)
            self.skip_newline = True
            self.frameset_ok = False
        elif name == "xmp":
            self.close_p()
            self.reconstruct()
            self.frameset_ok = False
            return self.raw_text(t, lex.RAWTEXT)
        elif name == "iframe":
            self.frameset_ok = False
            return self.raw_text(t, lex.RAWTEXT)
        elif name == "noembed" or name == "noscript" and self.scripting:
            return self.raw_text(t, lex.RAWTEXT)
        elif name == "plaintext":
            self.close_p()
            self.insert(t)
            self.tokenizer.state = lex.PLAINTEXT
        elif name == "nobr":
            self.reconstruct()
            if self.in_scope("nobr"):
                self.error("nobr inside of a nobr")
                self.adopt(Tag("end", "nobr"))
                self.reconstruct()
            self.push_formatting(self.insert(t), t)
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(t)
            self.push_marker()
            self.frameset_ok = False
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.implied_ends(but=None if name in ("rb", "rtc") else "rtc")
                if not self.current.html("ruby", *(() if name in ("rb", "rtc") else ("rtc",))):
                    self.error("ruby text outside of ruby")
            self.insert(t)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.insert_foreign(t, MATHML if name == "math" else SVG)
        elif name == "html":
            self.unexpected(t)
            if not self.has_template():
                self.doc.add_missing_attributes(self.stack[0], [Attribute(None, "", *a) for a in t.attrs])
        elif name == "body":
            self.unexpected(t)
            if len(self.stack) > 1 and self.stack[1].html("body") and not self.has_template():
                self.frameset_ok = False
                self.doc.add_missing_attributes(self.stack[1], [Attribute(None, "", *a) for a in t.attrs])
        elif name == "frameset":
            self.unexpected(t)
            if len(self.stack) > 1 and self.stack[1].html("body") and self.frameset_ok:
                self.doc.detach(self.stack[1])
                self.stack.cut(1)
                self.insert(t)
                self.mode = self.in_frameset
        elif name == "image":
            self.error("image instead of img")
            return self.in_body(Tag("start", "img", t.attrs, t.self_closing, t.had_duplicates))
        elif name in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return self.unexpected(t)
        else:
            self.reconstruct()
            self.insert(t)
        return False

    def _item(self, t: Tag) -> None:
        """li, dd and dt end an open one of their kind."""
        self.frameset_ok = False
        ends = ("li",) if t.name == "li" else ("dd", "dt")
        place = self.stack.last(*ends)
        if place >= 0 and place >= self.stack.last_of(ITEM_BOUND):
            name = self.stack[place].name
            self.close(name, but=name)
        self.close_p()
        self.insert(t)

    def _body_end(self, t: Tag) -> bool | None:
        name = t.name
        if name in BLOCK_ENDS:
            if not self.in_scope(name):
                return self.unexpected(t)
            self.close(name)
        elif name == "p":
            if not self.in_scope("p", scope=BUTTON_SCOPE):
                self.error("p ends that was not open")
                self.insert_named("p")
            self.close("p", but="p")
        elif name in FORMATTING or name in ("a", "nobr"):
            self.adopt(t)
        elif name in HEADINGS:
            if not self.in_scope(*HEADINGS):
                return self.unexpected(t)
            self.implied_ends()
            if not self.current.html(name):
                self.error("open elements at the end of a heading")
            self.pop_until(*HEADINGS)
        elif name == "li":
            if not self.in_scope("li", scope=LIST_SCOPE):
                return self.unexpected(t)
            self.close("li", but="li")
        elif name in ("dd", "dt"):
            if not self.in_scope(name):
                return self.unexpected(t)
            self.close(name, but=name)
        elif name in ("body", "html"):
            if not self.in_scope("body"):
                return self.unexpected(t)
            self._check_open()
            self.mode = self.after_body
            return name == "html"
        elif name == "form":
            return self._end_form(t)
        elif name in ("applet", "marquee", "object"):
            if not self.in_scope(name):
                return self.unexpected(t)
            self.close(name)
            self.clear_formatting()
        elif name == "br":
            self.unexpected(t)
            return self._body_start(Tag("start", "br"))
        elif name == "template":
            return self.in_head(t)
        else:
            self.other_end(t)
        return False

    def _end_form(self, t: Tag) -> bool:
        if self.has_template():
            if not self.in_scope("form"):
                return self.unexpected(t)
            self.close("form")
            return False
        node, self.form = self.form, None
        if node is None or not self.in_scope_node(node):
            return self.unexpected(t)
        self.implied_ends()
        if self.current is not node:
            self.error("open elements at the end of form")
        self.stack.remove(node)
        return False

    def text(self, t) -> bool:
        if type(t) is Characters:
            self.put_text(t.data)
            return False
        if type(t) is Eof:
            self.error("end of file in raw text")
            if self.current.html("script"):
                self.doc.note("mark_script_already_started", self.current)
            self.pop()
            return self.to(self.original)
        if type(t) is Tag:
            node = self.pop()
            if node.html("script"):
                self.doc.scripts.append(node)
            self.mode = self.original
        return False

    # modes: tables --------------------------------------------------------------------------

    def in_table(self, t) -> bool:
        kind = type(t)
        if kind in (Characters, Null) and self.current.ns == HTML and self.current.name in TABLE_PARENTS:
            self.pending = []
            self.original = self.mode
            return self.to(self.in_table_text)
        if kind is Comment:
            return self.put_comment(t)
        if kind is Tag and t.kind == "start":
            name = t.name
            if name == "caption":
                self.pop_to_context("table")
                self.push_marker()
                self.insert(t)
                self.mode = self.in_caption
                return False
            if name == "colgroup":
                self.pop_to_context("table")
                self.insert(t)
                self.mode = self.in_column_group
                return False
            if name == "col":
                self.pop_to_context("table")
                self.insert_named("colgroup")
                return self.to(self.in_column_group)
            if name in ("tbody", "tfoot", "thead"):
                self.pop_to_context("table")
                self.insert(t)
                self.mode = self.in_table_body
                return False
            if name in ("td", "th", "tr"):
                self.pop_to_context("table")
                self.insert_named("tbody")
                return self.to(self.in_table_body)
            if name == "table":
                self.unexpected(t)
                if not self.in_scope("table", scope=TABLE_SCOPE):
                    return False
                self.pop_until("table")
                self.reset_mode()
                return True
            if name in ("style", "script", "template"):
                return self.in_head(t)
            if name == "input" and ascii_lower(t.get("type") or "") == "hidden":
                self.unexpected(t)
                self.insert_void(t)
                return False
            if name == "form":
                self.unexpected(t)
                if self.form is None and not self.has_template():
                    self.form = self.insert(t)
                    self.pop()
                return False
        elif kind is Tag:
            if t.name == "table":
                if not self.in_scope("table", scope=TABLE_SCOPE):
                    return self.unexpected(t)
                self.pop_until("table")
                self.reset_mode()
                return False
            if t.name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return self.unexpected(t)
            if t.name == "template":
                return self.in_head(t)
        elif kind is Eof:
            return self.in_body(t)
        self.unexpected(t)
        return self._fostered(t)

    def _fostered(self, t) -> bool:
        self.fostering = True
        again = self.in_body(t)
        self.fostering = False
        return again

    def in_table_text(self, t) -> bool:
        if type(t) is Null:
            return self.unexpected(t)
        if type(t) is Characters:
            self.pending.append(t.data)
            return False
        text, self.pending = "".join(self.pending), []
        if text.strip(WHITE):
            self.error("text inside of a table")
            for run in _RUNS.findall(text):
                self._fostered(Characters(run))
        elif text:
            self.put_text(text)
        return self.to(self.original)

    def in_caption(self, t) -> bool:
        parts = ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if type(t) is Tag:
            ends = t.kind == "end" and t.name in ("caption", "table")
            if ends or t.kind == "start" and t.name in parts:
                if not self.in_scope("caption", scope=TABLE_SCOPE):
                    return self.unexpected(t)
                self.close("caption")
                self.clear_formatting()
                self.mode = self.in_table
                return t.name != "caption" or t.kind == "start"
            if t.kind == "end" and t.name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return self.unexpected(t)
        return self.in_body(t)

    def in_column_group(self, t) -> bool:
        if type(t) is Characters and t.data[0] in WHITE:
            self.put_text(t.data)
            return False
        if type(t) is Comment:
            return self.put_comment(t)
        if type(t) is Eof:
            return self.in_body(t)
        if type(t) is Tag:
            if t.kind == "start" and t.name == "html":
                return self.in_body(t)
            if t.kind == "start" and t.name == "col":
                self.insert_void(t)
                return False
            if t.kind == "end" and t.name == "colgroup":
                if not self.current.html("colgroup"):
                    return self.unexpected(t)
                self.pop()
                self.mode = self.in_table
                return False
            if t.kind == "end" and t.name == "col":
                return self.unexpected(t)
            if t.name == "template":
                return self.in_head(t)
        if not self.current.html("colgroup"):
            return self.unexpected(t)
        self.pop()
        return self.to(self.in_table)

    def in_table_body(self, t) -> bool:
        sections = ("tbody", "tfoot", "thead")
        if type(t) is Tag:
            start = t.kind == "start"
            if start and t.name == "tr":
                self.pop_to_context(*sections)
                self.insert(t)
                self.mode = self.in_row
                return False
            if start and t.name in ("td", "th"):
                self.unexpected(t)
                self.pop_to_context(*sections)
                self.insert_named("tr")
                return self.to(self.in_row)
            if not start and t.name in sections:
                if not self.in_scope(t.name, scope=TABLE_SCOPE):
                    return self.unexpected(t)
                self.pop_to_context(*sections)
                self.pop()
                self.mode = self.in_table
                return False
            if start and t.name in ("caption", "col", "colgroup", *sections) or not start and t.name == "table":
                if not self.in_scope(*sections, scope=TABLE_SCOPE):
                    return self.unexpected(t)
                self.pop_to_context(*sections)
                self.pop()
                return self.to(self.in_table)
            if not start and t.name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
                return self.unexpected(t)
        return self.in_table(t)

    def in_row(self, t) -> bool:
        if type(t) is Tag:
            start = t.kind == "start"
            if start and t.name in ("td", "th"):
                self.pop_to_context("tr")
                self.insert(t)
                self.mode = self.in_cell
                self.push_marker()
                return False
            ends_row = start and t.name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr") or not start and t.name in ("tr", "table", "tbody", "tfoot", "thead")
            if ends_row:
                wanted = t.name if not start and t.name in ("tbody", "tfoot", "thead") else "tr"
                if not self.in_scope(wanted, scope=TABLE_SCOPE):
                    return self.unexpected(t)
                if not self.in_scope("tr", scope=TABLE_SCOPE):
                    return False
                self.pop_to_context("tr")
                self.pop()
                self.mode = self.in_table_body
                return start or t.name != "tr"
            if not start and t.name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
                return self.unexpected(t)
        return self.in_table(t)

    def _close_cell(self) -> None:
        self.implied_ends()
        if not self.current.html("td", "th"):
            self.error("open elements at the end of a cell")
        self.pop_until("td", "th")
        self.clear_formatting()
        self.mode = self.in_row

    def in_cell(self, t) -> bool:
        if type(t) is Tag:
            start = t.kind == "start"
            if not start and t.name in ("td", "th"):
                if not self.in_scope(t.name, scope=TABLE_SCOPE):
                    return self.unexpected(t)
                self.close(t.name)
                self.clear_formatting()
                self.mode = self.in_row
                return False
            if start and t.name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
                if not self.in_scope("td", "th", scope=TABLE_SCOPE):
                    return self.unexpected(t)
                self._close_cell()
                return True
            if not start and t.name in ("body", "caption", "col", "colgroup", "html"):
                return self.unexpected(t)
            if not start and t.name in TABLE_PARTS:
                if not self.in_scope(t.name, scope=TABLE_SCOPE):
                    return self.unexpected(t)
                self._close_cell()
                return True
        return self.in_body(t)

    # modes: templates, framesets, the end -----------------------------------------------------

    def in_template(self, t) -> bool:
        if type(t) is Tag and t.kind == "start":
            name = t.name
            if name in HEAD_VOID or name in ("noframes", "script", "style", "template", "title"):
                return self.in_head(t)
            if name in ("caption", "colgroup", "tbody", "tfoot", "thead"):
                mode = self.in_table
            elif name == "col":
                mode = self.in_column_group
            elif name == "tr":
                mode = self.in_table_body
            elif name in ("td", "th"):
                mode = self.in_row
            else:
                mode = self.in_body
            self.template_modes[-1] = mode
            return self.to(mode)
        if type(t) is Tag:
            return self.in_head(t) if t.name == "template" else self.unexpected(t)
        if type(t) is Eof:
            if not self.has_template():
                return False
            self.error("end of file in template")
            self.pop_until("template")
            self.clear_formatting()
            self.template_modes.pop()
            self.reset_mode()
            return True
        return self.in_body(t)

    def after_body(self, t) -> bool:
        if type(t) is Characters and t.data[0] in WHITE:
            return self.in_body(t)
        if type(t) is Comment:
            return self.put_comment(t, self.stack[0])
        if type(t) is Eof:
            return False
        if type(t) is Tag and t.name == "html":
            if t.kind == "start":
                return self.in_body(t)
            if self.context is not None:
                return self.unexpected(t)
            self.mode = self.after_after_body
            return False
        self.unexpected(t)
        return self.to(self.in_body)

    def in_frameset(self, t) -> bool:
        if type(t) is Characters and t.data[0] in WHITE:
            self.put_text(t.data)
            return False
        if type(t) is Comment:
            return self.put_comment(t)
        if type(t) is Eof:
            if len(self.stack) > 1:
                self.error("end of file in frameset")
            return False
        if type(t) is Tag and t.kind == "start":
            if t.name == "html":
                return self.in_body(t)
            if t.name == "frameset":
                self.insert(t)
                return False
            if t.name == "frame":
                self.insert_void(t)
                return False
            if t.name == "noframes":
                return self.in_head(t)
        elif type(t) is Tag and t.name == "frameset":
            if len(self.stack) == 1:
                return self.unexpected(t)
            self.pop()
            if self.context is None and not self.current.html("frameset"):
                self.mode = self.after_frameset
            return False
        return self.unexpected(t)

    def after_frameset(self, t) -> bool:
        if type(t) is Characters and t.data[0] in WHITE:
            self.put_text(t.data)
            return False
        if type(t) is Comment:
            return self.put_comment(t)
        if type(t) is Eof:
            return False
        if type(t) is Tag:
            if t.kind == "start" and t.name == "html":
                return self.in_body(t)
            if t.kind == "end" and t.name == "html":
                self.mode = self.after_after_frameset
                return False
            if t.kind == "start" and t.name == "noframes":
                return self.in_head(t)
        return self.unexpected(t)

    def after_after_body(self, t) -> bool:
        if type(t) is Comment:
            return self.put_comment(t, self.doc.root)
        if type(t) is Eof:
            return False
        if type(t) is Characters and t.data[0] in WHITE or type(t) is Tag and t.kind == "start" and t.name == "html":
            return self.in_body(t)
        self.unexpected(t)
        return self.to(self.in_body)

    def after_after_frameset(self, t) -> bool:
        if type(t) is Comment:
            return self.put_comment(t, self.doc.root)
        if type(t) is Eof:
            return False
        if type(t) is Characters and t.data[0] in WHITE or type(t) is Tag and t.kind == "start" and t.name == "html":
            return self.in_body(t)
        if type(t) is Tag and t.kind == "start" and t.name == "noframes":
            return self.in_head(t)
        return self.unexpected(t)

    def reset_mode(self) -> None:
        """The mode that the open elements ask for."""
        i = max(self.stack.last_of(MODAL), 0)
        last = i == 0
        node = self.context if last and self.context is not None else self.stack[i]
        name = node.name if node.ns == HTML else None
        if name in ("td", "th") and not last:
            self.mode = self.in_cell
        elif name == "tr":
            self.mode = self.in_row
        elif name in ("tbody", "thead", "tfoot"):
            self.mode = self.in_table_body
        elif name == "caption":
            self.mode = self.in_caption
        elif name == "colgroup":
            self.mode = self.in_column_group
        elif name == "table":
            self.mode = self.in_table
        elif name == "template":
            self.mode = self.template_modes[-1]
        elif name == "head" and not last:
            self.mode = self.in_head
        elif name == "frameset":
            self.mode = self.in_frameset
        elif name == "html":
            self.mode = self.before_head if self.head is None else self.after_head
        else:
            self.mode = self.in_body

    # foreign content -----------------------------------------------------------------------------

    def insert_foreign(self, t: Tag, ns: str) -> None:
        """Insert an SVG or MathML element, with names in their right case."""
        fixed = SVG_ATTRIBUTES if ns == SVG else MATHML_ATTRIBUTES
        attrs = [Attribute(*FOREIGN_ATTRIBUTES[k], v) if k in FOREIGN_ATTRIBUTES else Attribute(None, "", fixed.get(k, k), v) for k, v in t.attrs]
        name = SVG_TAGS.get(t.name, t.name) if ns == SVG else t.name
        tag = Tag("start", name, attrs, t.self_closing, t.had_duplicates)
        (self.insert_void if t.self_closing else self.insert)(tag, ns)

    def in_foreign(self, t) -> bool:
        if type(t) is Null:
            self.unexpected(t)
            self.put_text(REPLACEMENT)
        elif type(t) is Characters:
            self.put_text(t.data)
            if t.data.strip(WHITE):
                self.frameset_ok = False
        elif type(t) is Comment:
            self.put_comment(t)
        elif t.kind == "start":
            font = t.name == "font" and any(k in ("color", "face", "size") for k, _ in t.attrs)
            if t.name in BREAKOUT or font:
                self.unexpected(t)
                return self._leave_foreign(t)
            self.insert_foreign(t, self._adjusted().ns)
        elif t.name in ("br", "p"):
            self.unexpected(t)
            return self._leave_foreign(t)
        else:
            self._end_foreign(t)
        return False

    def _leave_foreign(self, t: Tag) -> bool:
        while not (self.current.ns == HTML or (self.current.ns, self.current.name) in INTEGRATION or self.current.mathml_ip):
            self.pop()
        return self.mode(t)

    def _end_foreign(self, t: Tag) -> None:
        if ascii_lower(self.current.name) != t.name:
            self.error("end tag does not match in foreign content")
        if len(self.stack) < 2:
            return
        place, below = self.stack.last_foreign(t.name), self.current.html_below
        if place > max(below, 0):
            node = self.stack[place]
            while self.pop() is not node:
                pass
        elif below > 0:
            again = True
            while again:
                again = self.mode(t)


#: Modes that take text whole, white space and all.
WHOLE_TEXT = frozenset((TreeBuilder.in_body, TreeBuilder.text, TreeBuilder.in_table_text, TreeBuilder.in_cell, TreeBuilder.in_caption))


def parse_document(text: str, scripting: bool = True, iframe_srcdoc: bool = False, drop_doctype: bool = False, log: bool = False, exact_errors: bool = False, discard_bom: bool = True) -> Document:
    doc = Document(log)
    builder = TreeBuilder(doc, scripting, iframe_srcdoc, drop_doctype)
    builder.tokenizer = lex.Tokenizer(text, builder, discard_bom=discard_bom, exact_errors=exact_errors)
    builder.tokenizer.run()
    _finish(builder)
    return doc


def _finish(builder: TreeBuilder) -> None:
    while builder.stack:
        builder.pop()


_CONTEXT_STATES = {name: lex.RCDATA for name in ("title", "textarea")} | {name: lex.RAWTEXT for name in ("style", "xmp", "iframe", "noembed", "noframes")} | {"script": lex.SCRIPT, "plaintext": lex.PLAINTEXT}


def parse_fragment(text: str, context: str = "body", context_ns: str = HTML, context_attrs=(), form: bool = False, scripting: bool = True, quirks_mode: str = "no-quirks", log: bool = False) -> Document:
    """Children of a context element: they end up in the html element below the document."""
    doc = Document(log)
    doc.quirks_mode = quirks_mode
    builder = TreeBuilder(doc, scripting)
    builder.context = doc.element(context, context_ns, [Attribute(None, "", *a) for a in context_attrs])
    if context_ns == MATHML and context == "annotation-xml":
        builder.context.mathml_ip = ascii_lower(builder.context.get("encoding") or "") in ("text/html", "application/xhtml+xml")
    if form or builder.context.html("form"):
        builder.form = builder.context if builder.context.html("form") else doc.element("form", HTML, [])
    root = doc.element("html", HTML, [])
    doc.append(doc.root, root)
    builder.stack.append(root)
    if builder.context.html("template"):
        builder.template_modes.append(builder.in_template)
    builder.reset_mode()
    state = lex.DATA
    if context_ns == HTML:
        state = lex.RAWTEXT if context == "noscript" and scripting else _CONTEXT_STATES.get(context, lex.DATA)
    builder.tokenizer = lex.Tokenizer(text, builder, state, context if context_ns == HTML else None)
    builder.tokenizer.foreign = builder._adjusted().ns != HTML
    builder.tokenizer.run()
    _finish(builder)
    return doc
