import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.kernel import rows, xml
from tagloom.kernel.html_tree import extract_charset, parse_document, parse_fragment
from tagloom.kernel.serialize import dump, serialize_html
from tagloom.plans import vectors as V


def html(text, **options):
    return serialize_html(parse_document(text, **options).root)


@pytest.mark.parametrize(("name", "text", "want"), V.FRAGMENTS)
def test_fragments(name, text, want):
    assert serialize_html(parse_fragment(text).root.children[0]) == want


@pytest.mark.parametrize(("name", "text", "want", "mode"), V.DOCUMENTS)
def test_documents(name, text, want, mode):
    doc = parse_document(text)
    assert (serialize_html(doc.root), doc.quirks_mode) == (want, mode)


@pytest.mark.parametrize(("name", "text", "want"), V.XML)
def test_xml(name, text, want):
    assert xml.serialize_xml(xml.parse_xml(text).root) == want


@pytest.mark.parametrize(("content", "charset"), V.CHARSETS)
def test_charsets(content, charset):
    assert extract_charset(content) == charset


def test_contexts():
    def inner(text, context, ns=None):
        return serialize_html(parse_fragment(text, context, **({"context_ns": ns} if ns else {})).root.children[0])

    assert inner("<td>x", "tr") == "<td>x</td>"
    assert inner("<td>x", "div") == "x"
    assert inner("<b>&amp;", "title") == "&lt;b&gt;&amp;"
    assert inner("<b>&amp;", "style") == "&lt;b&gt;&amp;amp;"
    assert inner("<option>a<input>", "select") == "<option>a</option>"
    assert inner("<![CDATA[a]]><lineargradient>", "svg", "http://www.w3.org/2000/svg") == "a<linearGradient></linearGradient>"
    assert inner("<tr><td>x", "template") == "<tr><td>x</td></tr>"


def test_scripting_decides_on_noscript():
    text = "<head><noscript><link><p>x</noscript>"
    assert html(text) == "<html><head><noscript><link><p>x</noscript></head><body></body></html>"
    assert html(text, scripting=False) == "<html><head><noscript><link></noscript></head><body><p>x</p></body></html>"


def test_templates_have_contents_of_their_own():
    doc = parse_document("<template><p>a<template>b</template></template>")
    assert dump(doc.root).splitlines() == ["| <html>", "|   <head>", "|     <template>", "|       content", "|         <p>", '|           "a"', "|           <template>", "|             content", '|               "b"', "|   <body>"]
    assert "<p>" not in serialize_html(doc.root)
    assert "<p>a<template>b</template></p>" in serialize_html(doc.root, templates=True)


@pytest.mark.parametrize(
    "text",
    ["<div>" * 60_000, "".join(f"<font color={i}>" for i in range(60_000)), "<span>" * 60_000 + "</b>" * 60_000, "<div>" * 60_000 + "<li></li>" * 20_000, "<blockquote>" * 30_000 + "</p>" * 30_000, "<svg>" * 30_000 + "</g>" * 30_000, "<table>" + "x<tr>" * 20_000, "<div>" * 30_000 + "<table></table>" * 20_000],
    ids=["blocks", "fonts", "stray ends", "items", "paragraphs", "foreign", "foster", "modes"],
)
def test_deep_input_takes_no_more_than_wide_input(text):
    began = time.process_time()
    doc = parse_document(text)
    assert time.process_time() - began < 12  # a walk of the stack for each tag would take minutes
    assert len(rows.node_rows(doc)) >= 20_000


def test_deep_input():
    assert serialize_html(parse_document("<div>" + "<b>" * 60_000).root).count("</b>") == 60_000
    assert sum(r["kind"] == "document" for r in rows.node_rows(parse_document("<template>" * 9_999))) == 10_000


def test_lines_and_duplicates():
    doc = parse_document("<a>\n</a>\n<b id=1 id=2>\n</b>")
    found = {r["local"]: (r["line"], r["had_duplicate_attributes"]) for r in rows.node_rows(doc) if r["kind"] == "element"}
    assert found == {"html": (1, False), "head": (1, False), "body": (1, False), "a": (1, False), "b": (3, True)}


def test_encodings_scripts_and_forms():
    doc = parse_document("<meta charset=a><meta http-equiv=Content-Type content='text/html; charset=b'><script>1</script><form><input><input form=x>")
    found = rows.node_rows(doc)
    assert doc.encodings == ["a", "b"]
    assert [found[i]["local"] for i in rows.script_ids(doc, found)] == ["script"]
    form = next(r["node_id"] for r in found if r["local"] == "form")
    assert [r["form_id"] for r in found if r["local"] == "input"] == [form, None]


def test_action_log():
    ops = [op for op, *_ in parse_document("<p>x", log=True).actions]
    assert ops.count("create_element") == 4 and "set_quirks_mode" in ops and ops[-1] == "pop"


def test_namespaces():
    doc = xml.parse_xml("<a xmlns='u' xmlns:p='v' p:x='1' y='2'><p:b/><q:c/></a>")
    found = [(r["ns"], r["prefix"], r["local"], [(a["ns"], a["local"]) for a in r["attrs"]]) for r in rows.node_rows(doc) if r["kind"] == "element"]
    assert found == [("u", None, "a", [("v", "x"), ("", "y")]), ("v", "p", "b", []), ("", "q", "c", [])]
    assert [m for *_, m in doc.errors] == ["undeclared namespace prefix"]
    text = "<a xmlns:p='v' p:x='1'/>"
    assert xml.serialize_xml(xml.parse_xml(text).root) == '<a p:x="1"></a>'
    assert xml.serialize_xml(xml.parse_xml(text).root, compat=False) == '<a xmlns:p="v" p:x="1"></a>'


_SOUP = st.lists(
    st.sampled_from("<p> </p> <b> </b> <i> <a> </a> <table> </table> <tr> <td> </td> <caption> <col> <select> <option> </select> <svg> </svg> <math> <mi> <desc> <template> </template> <form> </form> <li> <ul> </ul> <h1> </h1> <br> <input> <frameset> <body> </body> </html> <script> </script> <style> </style> <title> x & \n <!--c--> <!doctype> <button> </button> <nobr> <object> </object> <ruby> <rt>".split(" ")),
    max_size=40,
).map("".join)


@given(_SOUP)
@settings(max_examples=400, deadline=None)
def test_any_markup_gives_a_tree(text):
    doc = parse_document(text)
    found = rows.node_rows(doc)
    assert [r["pre"] for r in found] == list(range(len(found)))
    by_id = {r["node_id"]: r for r in found}
    for r in found:
        over = by_id.get(r["content_of"] if r["parent_id"] is None else r["parent_id"])
        if over is not None:
            assert over["pre"] < r["pre"] <= r["post"] <= over["post"] and r["depth"] == over["depth"] + 1
        names = [(a["ns"], a["local"]) for a in r["attrs"]]
        assert len(names) == len(set(names))
    assert serialize_html(rows.tree_of(found)) == serialize_html(doc.root)
    assert sum(r["local"] == "html" and r["kind"] == "element" and r["depth"] == 1 for r in found) == 1


@given(st.text(alphabet="<>/!?&;:='\" ab\n[]-x", max_size=50))
@settings(max_examples=300, deadline=None)
def test_any_text_gives_an_xml_tree(text):
    doc = xml.parse_xml(text)
    assert sum(c.kind == "element" for c in doc.root.children) <= 1
    xml.serialize_xml(doc.root)
