"""Forgiving XML: tokenizer, namespace-aware tree, serializer.

Nothing is rejected: what is not well formed gives an error and the most plausible
tree. No document type definition is read. Unlike HTML, a tag that the file ends
in is emitted.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .chars import REPLACEMENT, WHITE, XML, XMLNS, ascii_lower, normalise_newlines, reference
from .tokens import Attribute, Characters, Comment, Doctype, Eof, Error, Instruction, Tag
from .tree import Document, Node, walk

_QNAME = re.compile(r"([^:]+):([^:]+)")
_NAME = re.compile(r"[^\t\n >/]*")
_ATTRIBUTE_NAME = re.compile(r"[^\t\n =>/][^=\t\n >/]*")
_SPACE = re.compile(r"[\t\n ]*")
_DOCTYPE_SPACE = re.compile(r"[\t\n\f ]*")
_COMMENT_END = re.compile(r"--!?>")


def split_qname(name: str) -> tuple[str | None, str]:
    """(prefix, local): a name is split at its only colon, if that is inside."""
    m = _QNAME.fullmatch(name)
    return (m[1], m[2]) if m else (None, name)


class Tokenizer:
    """Feeds tokens to ``sink(token, line)``."""

    def __init__(self, text: str, sink: Callable, discard_bom: bool = True):
        if discard_bom and text.startswith("\ufeff"):
            text = text[1:]
        self.text, self.sink, self.at = normalise_newlines(text).replace("\0", REPLACEMENT), sink, 0
        self._line, self._counted = 1, 0

    def emit(self, token) -> None:
        if self.at > self._counted:
            self._line += self.text.count("\n", self._counted, self.at)
            self._counted = self.at
        self.sink(token, self._line)

    def error(self, message: str) -> None:
        self.emit(Error(message))

    def run(self) -> None:
        text, n = self.text, len(self.text)
        while self.at < n:
            stop = min((i for i in (text.find("<", self.at), text.find("&", self.at)) if i >= 0), default=n)
            if stop > self.at:
                data, self.at = text[self.at : stop], stop
                self.emit(Characters(data))
            elif text[stop] == "<":
                self._markup(stop + 1)
            else:
                chars, self.at, error = reference(text, stop + 1, False)
                if error:
                    self.error(error)
                self.emit(Characters("&" if chars is None else chars))
        self.emit(Eof())

    def _literal(self, data: str, at: int) -> None:
        self.at = at
        self.error("unexpected character after <")
        self.emit(Characters(data))

    def _markup(self, at: int) -> None:
        text = self.text
        first = text[at : at + 1]
        if first == "!":
            self._declaration(at + 1)
        elif first == "?":
            self._instruction(at + 1)
        elif first == "/":
            after = text[at + 1 : at + 2]
            if after == ">":
                self.at = at + 2
                self.emit(Tag("short", ""))
            elif after == "" or after in "\t\n <:":
                self._literal("</", at + 1)
            else:
                self._end_tag(at + 1)
        elif first == "" or first in "\t\n :<>":
            self._literal("<", at)
        else:
            self._start_tag(at)

    def _end_tag(self, at: int) -> None:
        text, n = self.text, len(self.text)
        m = _NAME.match(text, at + 1)  # any character may come first
        name, at = text[at : m.end()], m.end()
        end = text.find(">", at)
        rest = text[at : end if end >= 0 else n]
        self.at = end + 1 if end >= 0 else n
        if rest.strip("\t\n ") or end < 0:
            self.error("unexpected characters in end tag" if end >= 0 else "end of file in tag")
        prefix, local = split_qname(name)
        self.emit(Tag("end", local, prefix=prefix))

    def _start_tag(self, at: int) -> None:
        text, n = self.text, len(self.text)
        m = _NAME.match(text, at + 1)
        name, at = text[at : m.end()], m.end()
        kind, attrs, duplicates = "start", [], False
        key = value = ""

        def finish():
            nonlocal key, value, duplicates
            if key:
                if any(a.local == key for a in attrs):
                    duplicates = True
                    self.error("duplicate attribute")
                else:
                    prefix, local = split_qname(key)
                    a = Attribute(prefix, "", local, value)
                    attrs.insert(0 if local == "xmlns" or prefix == "xmlns" else len(attrs), a)
            key = value = ""

        while True:
            at = _SPACE.match(text, at).end()
            if at >= n:
                self.at = n
                self.error("end of file in tag")
                break
            c = text[at]
            if c == ">":
                at += 1
                break
            if c == "/":
                kind = "empty"
                if text.startswith(">", at + 1):
                    at += 2
                    break
                if at + 1 < n:
                    value, at = self._value(at + 1)
                    finish()
                else:
                    at += 1
                continue
            if c == ":" and not key:
                self.error("attribute name begins with a colon")
                at += 1
                continue
            finish()
            if c == "=":
                # only a first character can get here: it is part of the name
                m = re.compile(r"=[^=\t\n >/]*").match(text, at)
            else:
                m = _ATTRIBUTE_NAME.match(text, at)
            key, at = m[0], m.end()
            after = _SPACE.match(text, at).end()
            if text.startswith("=", after):
                value, at = self._value(after + 1)
                finish()
            elif after >= n and after == at:
                kind = "start"
        finish()
        self.at = min(at, n)
        prefix, local = split_qname(name)
        self.emit(Tag(kind, local, attrs, kind == "empty", duplicates, prefix))

    def _value(self, at: int) -> tuple[str, int]:
        """An attribute value and where it ends."""
        text = self.text
        at = _SPACE.match(text, at).end()
        quote = text[at : at + 1]
        if quote in ("", ">"):
            return "", at
        if quote in ("'", '"'):
            end = text.find(quote, at + 1)
            raw, after = (text[at + 1 :], len(text)) if end < 0 else (text[at + 1 : end], end + 1)
        else:
            end = re.compile(r"[\n\t >]").search(text, at + 1)
            after = end.start() if end else len(text)
            raw = text[at:after]
        out, i = [], 0
        while (amp := raw.find("&", i)) >= 0:
            out.append(raw[i:amp])
            chars, i, error = reference(raw, amp + 1, quote in ("'", '"'))
            if error:
                self.error(error)
            out.append("&" if chars is None else chars)
        return "".join([*out, raw[i:]]), after

    def _instruction(self, at: int) -> None:
        text, n = self.text, len(self.text)
        if at >= n or text[at] in "\t\n ":
            self.error("missing target of a processing instruction")
            self._bogus(at)
            return
        m = re.compile(r"[^\t\n ?]*").match(text, at + 1)
        target, at = text[at : m.end()], _SPACE.match(text, m.end()).end()
        mark = text.find("?", at)
        if mark < 0:
            data, self.at = text[at:], n
        else:
            end = text.find(">", mark)
            data = text[at:mark] + text[mark : end if end >= 0 else n].replace("?", "")
            self.at = end + 1 if end >= 0 else n
        if mark < 0 or text.find(">", mark) < 0:
            self.error("end of file in a processing instruction")
        self.emit(Instruction(target, data))

    def _bogus(self, at: int) -> None:
        end = self.text.find(">", at)
        data = self.text[at : end if end >= 0 else len(self.text)]
        self.at = end + 1 if end >= 0 else len(self.text)
        self.emit(Comment(data))

    def _declaration(self, at: int) -> None:
        text, n = self.text, len(self.text)
        if text.startswith("--", at):
            self._comment(at + 2)
        elif ascii_lower(text[at : at + 7]) == "[cdata[":
            end = text.find("]]>", at + 7)
            data = text[at + 7 : end if end >= 0 else n]
            self.at = end + 3 if end >= 0 else n
            if end < 0:
                self.error("end of file in CDATA section")
                data = data[:-2] if data.endswith("]]") else data.removesuffix("]")
            if data:
                self.emit(Characters(data))
        elif ascii_lower(text[at : at + 7]) == "doctype":
            self._doctype(at + 7)
        else:
            self.error("incorrectly opened comment")
            self._bogus(at)

    def _comment(self, at: int) -> None:
        text = self.text
        if text.startswith((">", "->"), at):
            self.at = text.index(">", at) + 1
            self.error("abrupt closing of empty comment")
            self.emit(Comment(""))
            return
        m = _COMMENT_END.search(text, at)
        data, self.at = (text[at : m.start()], m.end()) if m else (text[at:], len(text))
        if m is None:
            self.error("end of file in comment")
            data = next((data.removesuffix(e) for e in ("--!", "--", "-") if data.endswith(e)), data)
        elif m[0] == "--!>":
            self.error("incorrectly closed comment")
        self.emit(Comment(data))

    def _doctype(self, at: int) -> None:
        text, n, token = self.text, len(self.text), Doctype()

        def skip(at):
            return _DOCTYPE_SPACE.match(text, at).end()

        def done(at, error=None):
            self.at = min(at, n)
            if error:
                self.error(error)
            self.emit(token)

        def bogus(at):
            end = text.find(">", at)
            done(n if end < 0 else end + 1, "unexpected characters in doctype")

        at = skip(at)
        m = re.compile(r"[^\t\n\f >]*").match(text, at)
        token.name, at = ascii_lower(m[0]) or None, skip(m.end())
        keyword = ascii_lower(text[at : at + 6])
        if keyword in ("public", "system") and token.name:
            at += 6
            for which in ("public_id", "system_id") if keyword == "public" else ("system_id",):
                spaced = skip(at)
                if text[spaced : spaced + 1] not in ("'", '"'):
                    break
                end = re.compile(f"[{text[spaced]}>]").search(text, spaced + 1)
                value = text[spaced + 1 : end.start() if end else n]
                between = which == "system_id" and keyword == "public" and spaced > at
                setattr(token, which, value if value or not between else None)
                if end is None or end[0] == ">":
                    return done(end.end() if end else n, "abrupt doctype identifier")
                at = end.end()
            at = skip(at)
        if at >= n:
            return done(n, "end of file in doctype")
        if text[at] == ">":
            return done(at + 1, None if token.name else "missing doctype name")
        return bogus(at)


def tokenize(text: str, discard_bom: bool = True, coalesce: bool = True) -> list[tuple]:
    """(token, line) pairs; neighbouring characters are joined."""
    out: list[tuple] = []

    def sink(token, line):
        if coalesce and isinstance(token, Characters) and out and isinstance(out[-1][0], Characters):
            out[-1] = (Characters(out[-1][0].data + token.data), out[-1][1])
        else:
            out.append((token, line))

    Tokenizer(text, sink, discard_bom).run()
    return out


class TreeBuilder:
    """Three phases: before, inside and after the root element."""

    def __init__(self, doc: Document):
        self.doc, self.phase, self.line = doc, "start", 1
        self.stack: list[Node] = []
        self.scopes: list[dict[str | None, str | None]] = []
        self.base: dict[str | None, str | None] = {None: None, "xml": XML, "xmlns": XMLNS}

    def error(self, message: str, stage: str = "tree") -> None:
        self.doc.error(self.line, stage, message)

    def __call__(self, token, line: int) -> None:
        self.line = line
        kind = type(token)
        if kind is Error:
            self.error(token.message, "tokenizer")
        elif kind is Comment:
            self.doc.append(self._parent(), self.doc.comment(token.data))
        elif kind is Instruction:
            self.doc.append(self._parent(), self.doc.instruction(token.target, token.data))
        elif kind is Eof:
            if self.phase == "start":
                self.error("end of file before the root element")
            while self.stack:
                self._pop()
            self.phase = "end"
        elif kind is Characters:
            if self.phase == "main":
                self.doc.append_text(self.stack[-1], token.data)
            elif token.data.strip(WHITE):
                self.error(f"text in phase {self.phase}")
        elif kind is Doctype and self.phase == "start":
            self.doc.doctype(token.name or "", token.public_id or "", token.system_id or "")
        elif kind is Tag and (self.phase == "main" or self.phase == "start" and token.kind in ("start", "empty")):
            self._tag(token)
        else:
            self.error(f"unexpected {token.kind + ' tag' if kind is Tag else 'doctype'} in phase {self.phase}")

    def _parent(self) -> Node:
        return self.stack[-1] if self.phase == "main" else self.doc.root

    def _pop(self) -> Node:
        node = self.stack.pop()
        self.scopes.pop()
        self.doc.note("pop", node)
        return node

    def _declare(self, a: Attribute, scope: dict) -> None:
        """A namespace declaration; an empty value takes a prefix back."""
        if a.value == XMLNS:
            self.error("the xmlns namespace can't be declared")
        elif a.prefix == "xmlns" and a.local == "xml":
            if a.value != XML:
                self.error("the xml prefix can't be declared anew")
        elif a.prefix == "xmlns" and a.local == "xmlns":
            self.error("the xmlns prefix can't be declared")
        elif a.prefix not in ("xmlns", None):
            self.error("invalid namespace declaration")
        else:
            prefix = None if a.local == "xmlns" else a.local
            if a.value and prefix in scope:
                self.error("namespace declared twice")
            else:
                scope[prefix] = a.value or None

    def _bind(self, prefix: str | None, own: dict) -> str:
        for scope in (own, *reversed(self.scopes), self.base):
            if prefix in scope:
                return scope[prefix] or ""
        self.error("undeclared namespace prefix")
        return ""

    def _tag(self, t: Tag) -> None:
        if t.kind == "short":
            self._pop()
        else:
            own: dict[str | None, str | None] = {}
            declarations = [a for a in t.attrs if a.prefix == "xmlns" or a.local == "xmlns"]
            for a in declarations:
                self._declare(a, own)
            seen, attrs = set(), []
            for a in t.attrs:
                if a in declarations:
                    continue
                if a.prefix is not None:
                    a = a._replace(ns=self._bind(a.prefix, own))
                    if (a.ns, a.local) in seen:
                        continue
                    seen.add((a.ns, a.local))
                attrs.append(a)
            ns = self._bind(t.prefix, own)
            if t.kind == "end":
                self._close(ns, t.name)
            else:
                node = self.doc.element(t.name, ns, attrs, self.line, t.had_duplicates)
                node.prefix = t.prefix
                self.doc.append(self._parent(), node)
                self.phase = "main"
                if t.kind == "start":
                    self.stack.append(node)
                    self.scopes.append(own)
                else:
                    self.doc.note("pop", node)
                    if t.name == "script":
                        self.doc.scripts.append(node)
        if not self.stack:
            self.phase = "end"

    def _close(self, ns: str, name: str) -> None:
        if self.stack[-1].name != name:
            self.error("end tag does not match the open element")
        if any(n.ns == ns and n.name == name for n in reversed(self.stack)):
            if name == "script":
                self.doc.scripts.append(self.stack[-1])
            while True:
                node = self._pop()
                if node.ns == ns and node.name == name:
                    break


def parse_xml(text: str, log: bool = False) -> Document:
    doc = Document(log)
    Tokenizer(text, TreeBuilder(doc)).run()
    return doc


_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_VALUE = str.maketrans({"&": "&amp;", "'": "&apos;", '"': "&quot;"})


def escape_text(text: str) -> str:
    return text.translate(_TEXT)


def escape_value(text: str) -> str:
    return text.translate(_VALUE)


def _qname(prefix: str | None, local: str) -> str:
    return f"{prefix}:{local}" if prefix is not None else local


def serialize_xml(top: Node, compat: bool = True) -> str:
    """The children of a node. With ``compat``, declarations are written as other writers of this
    dialect do: none for prefixes that only attributes have, and an end tag declares its prefix
    for what follows; without it every prefix is declared where it is needed."""
    out: list[str] = []
    scopes: list[dict[str | None, str]] = [{}]

    def missing(prefix: str | None, ns: str) -> bool:
        if prefix is None and not ns:
            return False
        return next((scope[prefix] for scope in reversed(scopes) if prefix in scope), None) != ns

    for step, node, depth in walk(top, contents=False):
        if node.kind == "document" or depth == 0:
            continue
        if node.kind == "element" and step == "open":
            scopes.append({})
            if missing(node.prefix, node.ns):
                scopes[-1][node.prefix] = node.ns
            if not compat:
                for a in node.attrs:
                    if a.prefix is not None and a.ns not in (XML, XMLNS) and missing(a.prefix, a.ns):
                        scopes[-1][a.prefix] = a.ns
            declared = sorted(scopes[-1].items(), key=lambda kv: (kv[0] is not None, kv[0] or ""))
            names = "".join(f' xmlns{"" if p is None else ":" + p}="{uri}"' for p, uri in declared)
            if compat:
                for a in node.attrs:
                    if (a.prefix is not None or a.ns) and missing(a.prefix, a.ns):
                        scopes[-1][a.prefix] = a.ns
            attrs = "".join(f' {_qname(a.prefix, a.local)}="{escape_value(a.value)}"' for a in node.attrs)
            out.append(f"<{_qname(node.prefix, node.name)}{names}{attrs}>")
        elif node.kind == "element":
            scopes.pop()
            if compat and len(scopes) > 1 and missing(node.prefix, node.ns):
                scopes[-1][node.prefix] = node.ns
            out.append(f"</{_qname(node.prefix, node.name)}>")
        elif step == "open":
            if node.kind == "text":
                out.append(escape_text(node.data))
            elif node.kind == "comment":
                out.append(f"<!--{node.data}-->")
            elif node.kind == "doctype":
                out.append(f"<!DOCTYPE {node.name}>")
            else:
                out.append(f"<?{node.name} {node.data}?>")
    return "".join(out)
