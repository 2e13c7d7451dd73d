"""HTML tokenizer: regular expressions take runs, never single characters.

Input is a whole document, so each construct is matched at once and its end-of-file
rule is a branch of its own: an open tag is dropped, an open comment or doctype is
emitted, an open raw text end tag turns into text.

The consumer may change ``state`` and ``foreign`` while it handles a token; that is
how a tree builder steers the tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .chars import REPLACEMENT, ascii_lower, normalise_newlines, reference
from .tokens import Characters, Comment, Doctype, Eof, Error, Null, Tag

DATA, RCDATA, RAWTEXT, SCRIPT, PLAINTEXT, CDATA = "data", "rcdata", "rawtext", "script", "plaintext", "cdata"

_TEXT = re.compile(r"[^<\0]+")
_TAG_NAME = re.compile(r"[^\t\n\f />]*")
_SPACE = re.compile(r"[\t\n\f ]*")
_SPACE_SLASH = re.compile(r"[\t\n\f /]*")
_ATTRIBUTE_NAME = re.compile(r"=?[^\t\n\f />=]*")
_UNQUOTED = re.compile(r"[^\t\n\f >]*")
_COMMENT_END = re.compile(r"--!?>")
_SCRIPT_MARK = re.compile(r"-->|<!--|<(/?)([A-Za-z]+)(?=[\t\n\f />])")
_ODD_INPUT = re.compile("[\x01-\x08\x0b\x0e-\x1f\x7f-\x9f\ufdd0-\ufdef\ufffe\uffff" + "".join(chr(p * 0x10000 + o) for p in range(1, 17) for o in (0xFFFE, 0xFFFF)) + "]")
#: A tag as most are: a name in lower case, attributes in double quotes without references.
_PLAIN_TAG = re.compile(r"<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z-]*=\"[^\"&\0]*\")*)>")
_PLAIN_ATTRIBUTE = re.compile(r" ([a-z-]+)=\"([^\"]*)\"")
_ODD_IN_NAME, _ODD_IN_VALUE = re.compile(r"[\"'<]"), re.compile(r"[\"'<=`]")


class Tokenizer:
    """Feeds tokens to ``sink(token, line)``; see :func:`tokenize` for a list."""

    def __init__(self, text: str, sink: Callable, state: str = DATA, last_start_tag: str | None = None, discard_bom: bool = True, exact_errors: bool = False):
        if discard_bom and text.startswith("\ufeff"):
            text = text[1:]
        self.text, self.sink = normalise_newlines(text), sink
        self.state, self.last_start_tag, self.foreign = state, last_start_tag, False
        self.at, self.exact_errors = 0, exact_errors
        self._line, self._counted = 1, 0 if "\n" in self.text else len(self.text)

    def emit(self, token) -> None:
        if self.at > self._counted:
            self._line += self.text.count("\n", self._counted, self.at)
            self._counted = self.at
        self.sink(token, self._line)

    def error(self, message: str) -> None:
        self.emit(Error(message))

    def run(self) -> None:
        n = len(self.text)
        if self.exact_errors:
            for m in _ODD_INPUT.finditer(self.text):
                self.sink(Error("control or noncharacter in the input"), 1 + self.text.count("\n", 0, m.start()))
        states = {name: getattr(self, f"_{name}") for name in (DATA, RCDATA, RAWTEXT, SCRIPT, PLAINTEXT, CDATA)}
        while self.at < n:
            states[self.state]()
        self.emit(Eof())

    # text ---------------------------------------------------------------------

    def _chars(self, data: str) -> None:
        """Raw text: NUL is replaced."""
        if "\0" in data:
            self.error("NUL character")
            data = data.replace("\0", REPLACEMENT)
        if data:
            self.emit(Characters(data))

    def _data(self) -> None:
        text, begin = self.text, self.at
        m = _TEXT.match(text, begin)
        if m:
            self.at, data = m.end(), m[0]
            self.emit(Characters(self._decoded(begin, self.at) if "&" in data else data))
        elif text[begin] == "<":
            m = _PLAIN_TAG.match(text, begin)
            if m is None:
                self._markup()
                return
            end, name, given = m.groups()
            attrs = _PLAIN_ATTRIBUTE.findall(given) if given else []
            if attrs and (end or len(attrs) > 1 and len(dict(attrs)) < len(attrs)):
                self._markup()  # there is something to report
                return
            self.at = m.end()
            if not end:
                self.last_start_tag = name
            self.emit(Tag("end" if end else "start", name, attrs))
        else:
            self.at += 1
            self.error("NUL character")
            self.emit(Null())

    def _decoded(self, at: int, end: int) -> str:
        """Text between two places, with its character references decoded."""
        text, out = self.text, []
        while (amp := text.find("&", at, end)) >= 0:
            chars, after, error = reference(text, amp + 1, False)
            if error:
                self.error(error)
            out += [text[at:amp], "&" if chars is None else chars]
            at = after
        return "".join([*out, text[at:end]])

    def _plaintext(self) -> None:
        data, self.at = self.text[self.at :], len(self.text)
        self._chars(data)

    def _cdata(self) -> None:
        end = self.text.find("]]>", self.at)
        data = self.text[self.at : end if end >= 0 else len(self.text)]
        self.at = end + 3 if end >= 0 else len(self.text)
        self.state = DATA
        if end < 0:
            self.error("end of file in CDATA section")
        for i, part in enumerate(data.split("\0")):
            if i:
                self.emit(Null())
            if part:
                self.emit(Characters(part))

    def _end_tag_at(self, at: int) -> bool:
        """Does an end tag of the last start tag begin here?"""
        name = self.last_start_tag
        if not name or not self.text.startswith("</", at):
            return False
        end = at + 2 + len(name)
        return ascii_lower(self.text[at + 2 : end]) == name and end < len(self.text) and self.text[end] in "\t\n\f />"

    def _rawtext(self, references: bool = False) -> None:
        text, at = self.text, self.at
        while True:
            stop = text.find("<", at)
            if stop < 0:
                stop = len(text)
                break
            if self._end_tag_at(stop):
                break
            at = stop + 1
        data, begin = text[self.at : stop], self.at
        if references and "&" in data:
            while (amp := text.find("&", self.at, stop)) >= 0:
                before, self.at = text[self.at : amp], amp
                self._chars(before)
                chars, self.at, error = reference(text, amp + 1, False)
                if error:
                    self.error(error)
                self.emit(Characters("&" if chars is None else chars))
            data = text[self.at : stop]
        self.at = stop
        self._chars(data)
        if stop < len(text):
            self._end_tag(stop + 2)
        elif begin == stop:
            self.at = len(text)

    def _rcdata(self) -> None:
        self._rawtext(references=True)

    def _script(self) -> None:
        """Script text to its end tag; "<!--" hides end tags after a "<script"."""
        text, begin, at, level = self.text, self.at, self.at, 0
        stop = None
        while stop is None:
            m = _SCRIPT_MARK.search(text, at)
            if m is None:
                stop = len(text)
                if level:
                    self.error("end of file in a script's comment-like text")
            elif m[0] == "-->":
                level, at = 0, m.end()
            elif m[0] == "<!--":
                # its dashes can be those of a "-->"
                level, at = level or 1, m.end() if level else m.end() - 2
            else:
                name = ascii_lower(m[2])
                at = m.end()
                if m[1] and level < 2:
                    if name == self.last_start_tag:
                        stop = m.start()
                elif name == "script":
                    if level == 1 and not m[1]:
                        level = 2
                    elif level == 2 and m[1]:
                        level = 1
        self.at = stop
        self._chars(text[begin:stop])
        if stop < len(text):
            self._end_tag(stop + 2)

    # tags -----------------------------------------------------------------------

    def _markup(self) -> None:
        text, at = self.text, self.at
        following = text[at + 1 : at + 2]
        if following.isascii() and following.isalpha():
            self._tag("start", at + 1)
        elif following == "/":
            after = text[at + 2 : at + 3]
            if after.isascii() and after.isalpha():
                self._end_tag(at + 2)
            elif after == ">":
                self.at = at + 3
                self.error("missing end tag name")
            elif after == "":
                self.at = len(text)
                self.error("end of file before tag name")
                self.emit(Characters("</"))
            else:
                self.error("invalid first character of tag name")
                self._bogus_comment(at + 2)
        elif following == "!":
            self._declaration(at + 2)
        elif following == "?":
            self.error("unexpected question mark")
            self._bogus_comment(at + 1)
        else:
            self.at = at + 1
            self.error("invalid first character of tag name" if following else "end of file before tag name")
            self.emit(Characters("<"))

    def _end_tag(self, at: int) -> None:
        self._tag("end", at)

    def _tag(self, kind: str, at: int) -> None:
        """A tag from its name on; a tag that the file ends in is dropped."""
        text, n = self.text, len(self.text)
        m = _TAG_NAME.match(text, at)
        name, at = ascii_lower(m[0]).replace("\0", REPLACEMENT), m.end()
        if text.startswith(">", at):
            self.at, self.state = at + 1, DATA
            if kind == "start":
                self.last_start_tag = name
            self.emit(Tag(kind, name))
            return
        attrs: list[tuple[str, str]] = []
        seen: set[str] = set()
        self_closing = duplicates = False
        while True:
            m = _SPACE_SLASH.match(text, at)
            gap, at = m[0], m.end()
            if at >= n:
                self.at = n
                self.error("end of file in tag")
                self.state = DATA
                return
            if text[at] == ">":
                self_closing = gap.endswith("/")
                at += 1
                break
            if "/" in gap:
                self.error("unexpected solidus in tag")
            m = _ATTRIBUTE_NAME.match(text, at)
            key, at = ascii_lower(m[0]).replace("\0", REPLACEMENT), m.end()
            if _ODD_IN_NAME.search(key) or key.startswith("="):
                self.error("unexpected character in attribute name")
            value = ""
            after = _SPACE.match(text, at).end()
            if text[after : after + 1] == "=":
                at = _SPACE.match(text, after + 1).end()
                quote = text[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = text.find(quote, at + 1)
                    if end < 0:
                        self.at = n
                        self.error("end of file in tag")
                        self.state = DATA
                        return
                    value, at = text[at + 1 : end], end + 1
                    if at < n and text[at] not in "\t\n\f />":
                        self.error("missing white space between attributes")
                elif quote == ">":
                    self.error("missing attribute value")
                else:
                    m = _UNQUOTED.match(text, at)
                    value, at = m[0], m.end()
                    if _ODD_IN_VALUE.search(value):
                        self.error("unexpected character in unquoted attribute value")
                if "\0" in value:
                    self.error("NUL character")
                    value = value.replace("\0", REPLACEMENT)
                if "&" in value:
                    value = self._unescaped(value)
            if key in seen:
                duplicates = True
                self.error("duplicate attribute")
            else:
                seen.add(key)
                attrs.append((key, value))
        self.at = at
        self.state = DATA
        if kind == "start":
            self.last_start_tag = name
        else:
            if attrs:
                self.error("end tag with attributes")
            if self_closing:
                self.error("end tag with trailing solidus")
        self.emit(Tag(kind, name, attrs, self_closing, duplicates))

    def _unescaped(self, value: str) -> str:
        out, at = [], 0
        while (amp := value.find("&", at)) >= 0:
            out.append(value[at:amp])
            chars, at, error = reference(value, amp + 1, True)
            if error:
                self.error(error)
            out.append("&" if chars is None else chars)
        return "".join([*out, value[at:]])

    # comments, doctypes, CDATA ----------------------------------------------------

    def _bogus_comment(self, at: int) -> None:
        end = self.text.find(">", at)
        data = self.text[at : end if end >= 0 else len(self.text)]
        self.at = end + 1 if end >= 0 else len(self.text)
        self.emit(Comment(data.replace("\0", REPLACEMENT)))

    def _declaration(self, at: int) -> None:
        text = self.text
        if text.startswith("--", at):
            self._comment(at + 2)
        elif text[at : at + 7].lower() == "doctype":
            self._doctype(at + 7)
        elif self.foreign and text.startswith("[CDATA[", at):
            self.at, self.state = at + 7, CDATA
            if self.at >= len(text):
                self.state = DATA
                self.error("end of file in CDATA section")
        else:
            self.error("incorrectly opened comment")
            self._bogus_comment(at)

    def _comment(self, at: int) -> None:
        text = self.text
        if text.startswith((">", "->"), at):
            self.at = text.index(">", at) + 1
            self.error("abrupt closing of empty comment")
            self.emit(Comment(""))
            return
        m = _COMMENT_END.search(text, at)
        if m:
            data, self.at = text[at : m.start()], m.end()
            if m[0] == "--!>":
                self.error("incorrectly closed comment")
        else:
            data, self.at = text[at:], len(text)
            self.error("end of file in comment")
            for open_end in ("--!", "--", "-"):
                if data.endswith(open_end):
                    data = data[: -len(open_end)]
                    break
        self.emit(Comment(data.replace("\0", REPLACEMENT)))

    def _doctype(self, at: int) -> None:
        text, n = self.text, len(self.text)
        token = Doctype()

        def done(at: int, quirks: bool = False, error: str | None = None) -> None:
            self.at = min(at, n)
            if error:
                self.error(error)
            token.force_quirks |= quirks
            self.emit(token)

        def to_end(at: int) -> int:
            end = text.find(">", at)
            return n if end < 0 else end + 1

        if at < n and text[at] not in "\t\n\f >":
            self.error("missing white space before doctype name")
        at = _SPACE.match(text, at).end()
        if at >= n or text[at] == ">":
            return done(at + 1, True, "missing doctype name")
        m = re.compile(r"[^\t\n\f >]+").match(text, at)
        token.name, at = ascii_lower(m[0]).replace("\0", REPLACEMENT), _SPACE.match(text, m.end()).end()
        if at >= n:
            return done(at, True, "end of file in doctype")
        if text[at] == ">":
            return done(at + 1)
        keyword = text[at : at + 6].lower()
        if keyword not in ("public", "system"):
            return done(to_end(at), True, "invalid characters after doctype name")
        at += 6
        wanted = ["public_id", "system_id"] if keyword == "public" else ["system_id"]
        for which in wanted:
            spaced = _SPACE.match(text, at).end()
            missing = spaced == at
            at = spaced
            if at >= n:
                return done(at, True, "end of file in doctype")
            if text[at] == ">":
                # a public id may stand alone
                alone = which == "system_id" and keyword == "public"
                return done(at + 1, not alone, None if alone else "missing doctype identifier")
            if text[at] not in "\"'":
                return done(to_end(at), True, "missing quote before doctype identifier")
            if missing:
                self.error("missing white space before doctype identifier")
            quote, start = text[at], at + 1
            end = next((i for i in range(start, n) if text[i] == quote or text[i] == ">"), n)
            setattr(token, which, text[start:end].replace("\0", REPLACEMENT))
            if end >= n:
                return done(n, True, "end of file in doctype")
            if text[end] == ">":
                return done(end + 1, True, "abrupt doctype identifier")
            at = end + 1
        at = _SPACE.match(text, at).end()
        if at >= n:
            return done(at, True, "end of file in doctype")
        if text[at] == ">":
            return done(at + 1)
        return done(to_end(at), False, "unexpected characters after doctype identifier")


def tokenize(text: str, state: str = DATA, last_start_tag: str | None = None, discard_bom: bool = True, coalesce: bool = True, exact_errors: bool = False) -> list[tuple]:
    """(token, line) pairs of a tokenizer without tree builder; neighbouring characters are joined."""
    out: list[tuple] = []

    def sink(token, line):
        if coalesce and isinstance(token, Characters) and out and isinstance(out[-1][0], Characters):
            out[-1] = (Characters(out[-1][0].data + token.data), out[-1][1])
        else:
            out.append((token, line))

    Tokenizer(text, sink, state, last_start_tag, discard_bom, exact_errors).run()
    return out
