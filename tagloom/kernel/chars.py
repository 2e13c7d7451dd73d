"""Characters, names and namespaces that markup parsing needs."""

from __future__ import annotations

import re
from html.entities import html5 as ENTITIES

#: The namespaces of the standards.
HTML = "http://www.w3.org/1999/xhtml"
MATHML = "http://www.w3.org/1998/Math/MathML"
SVG = "http://www.w3.org/2000/svg"
XLINK = "http://www.w3.org/1999/xlink"
XML = "http://www.w3.org/XML/1998/namespace"
XMLNS = "http://www.w3.org/2000/xmlns/"

WHITE = "\t\n\f\r "
REPLACEMENT = "\ufffd"
_UPPER = {c: c + 32 for c in range(65, 91)}
_LONGEST = max(map(len, ENTITIES))
_NAME = re.compile(r"[0-9A-Za-z]{1,%d};?" % _LONGEST)
_NUMBER = re.compile(r"#(?:[xX]([0-9A-Fa-f]+)|([0-9]+))(;?)")


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def normalise_newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def code_point(number: int) -> tuple[str, bool]:
    """What a numeric reference stands for, and whether it is a parse error."""
    if number == 0 or number > 0x10FFFF or 0xD800 <= number <= 0xDFFF:
        return REPLACEMENT, True
    if 0x80 <= number <= 0x9F:
        try:
            return bytes([number]).decode("cp1252"), True
        except UnicodeDecodeError:
            return chr(number), True
    odd = number & 0xFFFE == 0xFFFE or 0xFDD0 <= number <= 0xFDEF or number < 0x20 and chr(number) not in "\t\n\f " or number == 0x7F
    return chr(number), odd


def reference(text: str, at: int, in_attribute: bool) -> tuple[str | None, int, str | None]:
    """A character reference whose "&" ends at ``at``: its characters (None: it is plain text), its end, an error."""
    if at >= len(text):
        return None, at, None
    if text[at] == "#":
        m = _NUMBER.match(text, at)
        if m is None:
            return None, at, "numeric character reference without digits"
        digits = m[1] or m[2]
        # more digits than any code point needs would only cost time
        number = int(digits[-32:], 16 if m[1] else 10) if len(digits.lstrip("0")) <= 8 else 0x110000
        chars, odd = code_point(number)
        error = "invalid numeric character reference" if odd else None if m[3] else "semicolon missing from character reference"
        return chars, m.end(), error
    m = _NAME.match(text, at)
    if m is None:
        return None, at, None
    found = m[0]
    for size in range(len(found), 1, -1):
        chars = ENTITIES.get(found[:size])
        if chars is None:
            continue
        end = at + size
        if found[size - 1] == ";":
            return chars, end, None
        if in_attribute and end < len(text) and (text[end] == "=" or text[end].isascii() and text[end].isalnum()):
            return None, at, None
        return chars, end, "semicolon missing from character reference"
    return None, at, "unknown named character reference" if found.endswith(";") else None


def unescape(text: str, in_attribute: bool = False) -> str:
    """Decode all character references of a text."""
    if "&" not in text:
        return text
    out, at = [], 0
    while (amp := text.find("&", at)) >= 0:
        out.append(text[at:amp])
        chars, end, _ = reference(text, amp + 1, in_attribute)
        out.append("&" if chars is None else chars)
        at = end
    return "".join([*out, text[at:]])
