import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.kernel.html_tokenizer import tokenize
from tagloom.kernel.tokens import Characters, Comment, Doctype, Eof, Error, Tag


def plain(text, **options):
    """Tokens in short, without errors, and the number of errors."""
    out, errors = [], 0
    for token, _ in tokenize(text, **options):
        if isinstance(token, Error):
            errors += 1
        elif isinstance(token, Tag):
            out.append(("end", token.name) if token.kind == "end" else ("start", token.name, dict(token.attrs)))
        elif isinstance(token, Doctype):
            out.append(("doctype", token.name, token.public_id, token.system_id, token.force_quirks))
        elif isinstance(token, Comment):
            out.append(("comment", token.data))
        elif isinstance(token, Characters):
            out.append(token.data)
    joined = []
    for t in out:
        if isinstance(t, str) and joined and isinstance(joined[-1], str):
            joined[-1] += t
        else:
            joined.append(t)
    return joined, errors


@pytest.mark.parametrize(
    ("text", "tokens", "errors"),
    [
        ("<em class=\r\n>", [("start", "em", {"class": ""})], 1),
        ("<!doctype\thtml\r\nsystem\"", [("doctype", "html", None, "", True)], 2),
        ("<p title=&amp\r", [], 2),
        ("<q\ncite=&lt\rid='", [], 2),
        ("1 &x\r\n2", ["1 &x\n2"], 0),
        ("<li id=a Id=b ID=c>", [("start", "li", {"id": "a"})], 2),
        ("<li id=a class=b>", [("start", "li", {"id": "a", "class": "b"})], 0),
        ("<!DOCTYPE html>", [("doctype", "html", None, None, False)], 0),
        ("<!DOCTYPE HTML PUBLIC \"a\" 'b'>", [("doctype", "html", "a", "b", False)], 0),
        ("<!DOCTYPE>", [("doctype", None, None, None, True)], 1),
        ("a<b", ["a"], 1),
        ("</>x", ["x"], 1),
        ("<3", ["<3"], 1),
        ("<!--a--", [("comment", "a")], 1),
        ("<!-- a -- b -->", [("comment", " a -- b ")], 0),
        ("<?php x?>", [("comment", "?php x?")], 1),
        ("&lt;&ampx&#65;&#x42", ["<&xAB"], 2),
        ("&notin;&notit;", ["∉¬it;"], 1),
        ("<a b='&copy=1' c='&copy;'>", [("start", "a", {"b": "&copy=1", "c": "©"})], 0),
    ],
)
def test_tokens(text, tokens, errors):
    assert plain(text) == (tokens, errors)


@pytest.mark.parametrize("state", ["data", "rcdata", "rawtext", "script"])
@pytest.mark.parametrize(("text", "errors"), [("</title\t><?x y>", 1), ("</title/><?x y>", 2)])
def test_end_tag_of_raw_text(state, text, errors):
    assert plain(text, state=state, last_start_tag="title") == ([("end", "title"), ("comment", "?x y")], errors)


def test_script_states():
    assert plain("a<!--<script></script>--></script>b", state="script", last_start_tag="script")[0] == ["a<!--<script></script>-->", ("end", "script"), "b"]
    assert plain("<!--></script>", state="script", last_start_tag="script")[0] == ["<!-->", ("end", "script")]
    assert plain("<!--<script>x</script>", state="script", last_start_tag="script")[0] == ["<!--<script>x</script>"]


def test_lines():
    for end in ("\n", "\r\n", "\r"):
        lines = [line for token, line in tokenize(end.join(["<a>", "<b>", "</b>", "</a>"])) if isinstance(token, Tag)]
        assert lines == [1, 2, 3, 4]


def test_byte_order_mark():
    assert plain("﻿a")[0] == ["a"]
    assert plain("﻿a", discard_bom=False)[0] == ["﻿a"]


def test_exact_errors():
    assert plain("a\x01\ufdd0b")[1] == 0 and plain("a\x01\ufdd0b", exact_errors=True) == (["a\x01\ufdd0b"], 2)


_SOUP = st.text(alphabet="<>/!-?&;#='\"ab \n\r\0[]xscriptstyle", max_size=60)


@given(_SOUP, st.sampled_from(["data", "rcdata", "rawtext", "script", "plaintext", "cdata"]))
@settings(max_examples=300, deadline=None)
def test_any_text_gives_tokens(text, state):
    tokens = tokenize(text, state=state, last_start_tag="script")
    assert isinstance(tokens[-1][0], Eof)
    for token, line in tokens:
        assert 1 <= line <= 1 + text.count("\n") + text.count("\r")
        if isinstance(token, Tag):
            names = [k for k, _ in token.attrs]
            assert len(names) == len(set(names))
