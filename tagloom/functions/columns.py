"""Scalar functions as Spark columns; all but the last few stay in the JVM."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import chars, html_tree
from ..kernel.names import HTML4_PREFIXES, LIMITED_PREFIXES, QUIRKS_PREFIXES, QUIRKS_PUBLIC, QUIRKS_SYSTEM

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _replaced(x: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escape_text(x: Column) -> Column:
    return _replaced(x, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\xa0", "&nbsp;"))


def escape_attribute(x: Column) -> Column:
    return _replaced(escape_text(x), ('"', "&quot;"))


def xml_escape_text(x: Column) -> Column:
    return _replaced(x, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def xml_escape_attribute(x: Column) -> Column:
    return _replaced(x, ("&", "&amp;"), ("'", "&apos;"), ('"', "&quot;"))


def ascii_lower(x: Column) -> Column:
    """A-Z only; lower() would fold other letters too."""
    return F.translate(x, UPPER, LOWER)


def normalise_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def replace_nul(x: Column) -> Column:
    return F.replace(x, F.char(F.lit(0)), F.lit("\ufffd"))


def decode_utf8(binary: Column) -> Column:
    """Lossy: one U+FFFD for each maximal invalid part."""
    return F.make_valid_utf8(binary.cast("string"))


def is_ascii(x: Column) -> Column:
    return ~x.rlike(r"[^\x00-\x7F]")


def white_runs(x: Column) -> Column:
    """Alternating runs of HTML white space and other text."""
    return F.regexp_extract_all(x, F.lit("[ \t\n\f\r]+|[^ \t\n\f\r]+"), F.lit(0))


def byte_slice(x: Column, offset: int, length: int) -> Column:
    """Bytes of a string, null where the cuts are not between characters."""
    return F.try_validate_utf8(F.substring(x.cast("binary"), offset + 1, length).cast("string"))


def nonmember_prefix(x: Column, members: str) -> Column:
    """Bytes before the first of the member characters."""
    return F.octet_length(F.regexp_extract(x, f"^[^{re.escape(members)}]*", 0))


def qname_prefix(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "^([^:]+):([^:]+)$", 1), F.lit(""))


def qname_local(x: Column) -> Column:
    return F.when(x.rlike("^[^:]+:[^:]+$"), F.regexp_extract(x, "^([^:]+):([^:]+)$", 2)).otherwise(x)


def same_attributes(a: Column, b: Column) -> Column:
    """Equal but for their order."""
    return F.array_sort(a) == F.array_sort(b)


def quirks_mode(name: Column, public_id: Column, system_id: Column, force_quirks: Column) -> Column:
    """The mode that a doctype asks for."""
    public, system = ascii_lower(public_id), ascii_lower(system_id)

    def starts(prefixes):
        found = F.lit(False)
        for p in prefixes:
            found = found | F.coalesce(public.startswith(p), F.lit(False))
        return found

    quirks = F.coalesce(force_quirks, F.lit(False)) | ~F.coalesce(name == "html", F.lit(False))
    quirks = quirks | F.coalesce(public.isin(*QUIRKS_PUBLIC), F.lit(False)) | F.coalesce(system.isin(*QUIRKS_SYSTEM), F.lit(False)) | starts(QUIRKS_PREFIXES)
    html4 = starts(HTML4_PREFIXES)
    return F.when(quirks, "quirks").when(starts(LIMITED_PREFIXES), "limited-quirks").when(html4, F.when(system_id.isNull(), "quirks").otherwise("limited-quirks")).otherwise("no-quirks")


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    """Character references decoded as in text."""
    return x.map(chars.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def charset_of(x: pd.Series) -> pd.Series:
    """The encoding that a meta element's content names."""
    return x.map(html_tree.extract_charset, na_action="ignore")


#: The encodings of the web, by Python's names.
WEB_ENCODINGS = frozenset(
    "utf-8 cp866 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 koi8-r koi8-u mac-roman cp874 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 mac-cyrillic gb18030 big5hkscs euc_jp iso2022_jp cp932 cp949 utf-16-be utf-16-le".split()
)
#: What the web reads in a wider range than the label says.
WIDER = {"ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "tis-620": "cp874", "gb2312": "gb18030", "gbk": "gb18030", "big5": "big5hkscs", "shift_jis": "cp932", "euc_kr": "cp949", "utf-16": "utf-16-le"}
#: Labels that Python does not know.
LABELS = {"unicode-1-1-utf-8": "utf-8", "unicode11utf8": "utf-8", "unicode20utf8": "utf-8", "dos-874": "cp874", "mac-ukrainian": "mac-cyrillic", "windows-949": "cp949", "ks_c_5601-1989": "cp949", "windows-31j": "cp932", "sjis": "cp932", "unicode": "utf-16-le", "unicodefeff": "utf-16-le", "unicodefffe": "utf-16-be", "csunicode": "utf-16-le", "ucs-2": "utf-16-le", "iso-10646-ucs-2": "utf-16-le", "logical": "iso8859-8", "visual": "iso8859-8"}


def codec_of(label: str) -> str | None:
    """The Python codec for a web encoding's label; null for what is none."""
    label = label.strip(chars.WHITE).lower()
    for name in (label, label.removeprefix("x-"), label.removesuffix("-i"), label.removesuffix("-e")):
        try:
            found = codecs.lookup(LABELS.get(name, name)).name
        except LookupError:
            continue
        found = WIDER.get(found, found)
        return found if found in WEB_ENCODINGS else None
    return None


def decode_as(label: str):
    """A column function: bytes in a web encoding to text, with U+FFFD for what is invalid."""
    codec = codec_of(label)
    if codec is None:
        raise ValueError(f"unknown encoding {label}")

    @F.pandas_udf(T.StringType())
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda b: bytes(b).decode(codec, "replace"), na_action="ignore")

    return decode


def _units(data: bytes, at: int) -> str:
    """What stands at a byte offset of generalised UTF-8."""
    if not 0 <= at < len(data):
        return "none"
    start = at
    while start > 0 and at - start < 3 and data[start] & 0xC0 == 0x80:
        start -= 1
    lead = data[start]
    size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    if not size:
        return "suffix" if data[at] & 0xC0 == 0x80 else "none"
    if start + size <= at:
        return "suffix" if data[at] & 0xC0 == 0x80 else "none"
    if start + size > len(data):
        return "prefix"
    try:
        point = ord(data[start : start + size].decode("utf-8", "surrogatepass"))
    except UnicodeDecodeError:
        return "none"
    return "lead surrogate" if 0xD800 <= point < 0xDC00 else "trail surrogate" if 0xDC00 <= point < 0xE000 else "whole"


@F.pandas_udf(T.StringType())
def classify_unit(data: pd.Series, at: pd.Series) -> pd.Series:
    """Kind of the character around a byte: whole, a surrogate, or cut off at an end."""
    return pd.Series([None if b is None else _units(bytes(b), int(i)) for b, i in zip(data, at, strict=True)])


@F.pandas_udf(T.BooleanType())
def is_wtf8(data: pd.Series) -> pd.Series:
    """UTF-8 that may hold surrogates, but no pair of them."""
    def ok(b):
        try:
            text = bytes(b).decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return False
        return re.search("[\ud800-\udbff][\udc00-\udfff]", text) is None

    return data.map(ok, na_action="ignore")
