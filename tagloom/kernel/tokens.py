"""Tokens of HTML and XML, one class for each kind."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple


class Attribute(NamedTuple):
    prefix: str | None
    ns: str
    local: str
    value: str


@dataclass(slots=True)
class Doctype:
    name: str | None = None
    public_id: str | None = None
    system_id: str | None = None
    force_quirks: bool = False


@dataclass(slots=True)
class Tag:
    kind: str  # "start" or "end"; in XML also "empty" and "short"
    name: str
    attrs: list = field(default_factory=list)  # (name, value) pairs in HTML, Attribute in XML
    self_closing: bool = False
    had_duplicates: bool = False
    prefix: str | None = None
    ns: str = ""

    def get(self, name: str) -> str | None:
        """The value of the first attribute of this name."""
        return next((a[-1] for a in self.attrs if a[-2] == name), None)


@dataclass(slots=True)
class Comment:
    data: str


@dataclass(slots=True)
class Characters:
    data: str


@dataclass(slots=True)
class Null:
    """U+0000 in a place where the tree builder has a say."""


@dataclass(slots=True)
class Instruction:
    target: str
    data: str


@dataclass(slots=True)
class Eof:
    pass


@dataclass(slots=True)
class Error:
    message: str
