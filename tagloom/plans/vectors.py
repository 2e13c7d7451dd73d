"""Small inputs with known outcomes, for rules that the given pages do not exercise."""

from __future__ import annotations

#: (name, fragment within body, its serialization)
FRAGMENTS = (
    ("misnested formatting", "<p>one <em>two<p>three</em> four", "<p>one <em>two</em></p><p><em>three</em> four</p>"),
    ("attribute escapes", "<link title='a<b \" c>d'>", '<link title="a&lt;b &quot; c&gt;d">'),
    ("bare ampersand reference", "<link title=&lt>", '<link title="&lt;">'),
    ("no-break space", "<link title='1\xa0kg'>1\xa0kg", '<link title="1&nbsp;kg">1&nbsp;kg'),
    ("quotes in attributes", "<i title='say \"no\" to &amp;apos;' id=k>", '<i title="say &quot;no&quot; to &amp;apos;" id="k"></i>'),
    ("script text is raw", "<script>if (1 < 2 && 3 > 2) f(\"x\", 'y')</script>", "<script>if (1 < 2 && 3 > 2) f(\"x\", 'y')</script>"),
    ("one newline after a listing", "<listing>\nrow one\nrow two</listing>", "<listing>row one\nrow two</listing>"),
    ("two newlines after pre", "<pre>\n\n  indented</pre>", "<pre>\n  indented</pre>"),
    ("foreign attributes", '<svg><use xlink:href="#top" xml:lang="de"/></svg>', '<svg><use xlink:href="#top" xml:lang="de"></use></svg>'),
    ("tag that never ends", "kept<img src=\n", "kept"),
    ("duplicate attributes", "<li id=a Id=b ID=c class=d>x", '<li id="a" class="d">x</li>'),
    ("NUL in the body", "a\0b", "ab"),
    ("NUL in foreign content", "<svg>a\0b</svg>", "<svg>a�b</svg>"),
    ("names in math", "<math definitionurl=u><mi>x</math>", '<math definitionURL="u"><mi>x</mi></math>'),
    ("stray ends in svg", "<svg><g></p>x", "<svg><g></g></svg><p></p>x"),
    ("adoption agency", "<b><i><p>1</b>2</i>3", "<b><i></i></b><i></i><p><i><b>1</b>2</i>3</p>"),
    ("anchor in anchor", "<a href=a>x<a href=b>y", '<a href="a">x</a><a href="b">y</a>'),
    ("three equal elements at most", "<p><b><b><b><b>x<p>y", "<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p>"),
    ("list items end each other", "<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
    ("definition list", "<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("table parts are made", "<table><td>a<td>b<tr><td>c", "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>"),
    ("foster parenting", "<table><b>x</b><tr><td>y</table>", "<b>x</b><table><tbody><tr><td>y</td></tr></tbody></table>"),
    ("caption and columns", "<table><caption>t<col><tr><th>h", "<table><caption>t</caption><colgroup><col></colgroup><tbody><tr><th>h</th></tr></tbody></table>"),
    ("hidden input in a table", "<table><input type=hidden><tr><td>x", '<table><input type="hidden"><tbody><tr><td>x</td></tr></tbody></table>'),
    ("select closes select", "<select><option>a<select><option>b", "<select><option>a</option></select><option>b</option>"),
    ("input closes select", "<select><hr><input>", "<select><hr></select><input>"),
    ("optgroup", "<select><optgroup><option>a<optgroup><option>b</select>", "<select><optgroup><option>a</option></optgroup><optgroup><option>b</option></optgroup></select>"),
    ("ruby", "<ruby>a<rb>b<rt>c<rp>d</ruby>", "<ruby>a<rb>b</rb><rt>c</rt><rp>d</rp></ruby>"),
    ("svg names", "<svg viewbox=1><foreignobject><p>x</p></foreignobject><lineargradient/></svg>", '<svg viewBox="1"><foreignObject><p>x</p></foreignObject><linearGradient></linearGradient></svg>'),
    ("CDATA in svg", "<svg><![CDATA[x<y]]></svg>", "<svg>x&lt;y</svg>"),
    ("CDATA in html", "<p><![CDATA[x]]>", "<p><!--[CDATA[x]]--></p>"),
    ("breakout", "<svg><g><p>x", "<svg><g></g></svg><p>x</p>"),
    ("math text", "<math><mi>a<b>c</b></mi></math>", "<math><mi>a<b>c</b></mi></math>"),
    ("image is img", "<image src=x>", '<img src="x">'),
    ("stray ends", "a</br>b</p>c", "a<br>b<p></p>c"),
    ("headings", "<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
    ("button in button", "<button>a<button>b", "<button>a</button><button>b</button>"),
    ("form in form", "<form><input><form></form></form>", "<form><input></form>"),
    ("nobr in nobr", "<nobr>a<nobr>b", "<nobr>a</nobr><nobr>b</nobr>"),
    ("object bounds formatting", "<b><object>x</b>y</object>z", "<b><object>xy</object>z</b>"),
    ("textarea", "<textarea>\n<b>&amp;</textarea>", "<textarea>&lt;b&gt;&amp;</textarea>"),
    ("xmp", "<xmp><b>&amp;</xmp>", "<xmp><b>&amp;</xmp>"),
    ("plaintext", "a<plaintext><b></plaintext>", "a<plaintext><b></plaintext></plaintext>"),
    ("double escaped script", "<script><!--<script></script>--></script>z", "<script><!--<script></script>--></script>z"),
    ("comments", "<!--a--!>b<!-->c<!--->d<!x>e", "<!--a-->b<!---->c<!---->d<!--x-->e"),
    ("template contents are left out", "a<template><p>b</template>c", "a<template></template>c"),
    ("references", "&notit;&not;&#x80;&#0;&CounterClockwiseContourIntegral;&bogus;", "¬it;¬€\ufffd∳&amp;bogus;"),
    ("reference before =", "<a href='?a=b&copy=1&copy;'>x</a>", '<a href="?a=b&amp;copy=1©">x</a>'),
)

#: (name, document, its serialization, mode)
DOCUMENTS = (
    ("implied elements", "<base href=/>words", '<html><head><base href="/"></head><body>words</body></html>', "quirks"),
    ("frameset after text-free body", "<b><frameset><frame>", "<html><head></head><frameset><frame></frameset></html>", "quirks"),
    ("after the frameset", "<frameset></frameset></html><!--c--> <noframes>n</noframes>x", "<html><head></head><frameset></frameset> <noframes>n</noframes></html><!--c-->", "quirks"),
    ("after the root", "<p>a</body> b<!--c--></html> d", "<html><head></head><body><p>a b<!--c--> d</p></body></html>", "quirks"),
    ("doctype", "<!doctype html><p>x", "<!DOCTYPE html><html><head></head><body><p>x</p></body></html>", "no-quirks"),
    ("table closes p without quirks", "<!doctype html><p>a<table></table>", "<!DOCTYPE html><html><head></head><body><p>a</p><table></table></body></html>", "no-quirks"),
    ("table stays in p with quirks", "<p>a<table></table>", "<html><head></head><body><p>a<table></table></p></body></html>", "quirks"),
    ("frameset", "<frameset><frame></frameset><noframes>x", "<html><head></head><frameset><frame></frameset><noframes>x</noframes></html>", "quirks"),
    ("head again", "<head><head><base><body>x<body a=1>", '<html><head><base></head><body a="1">x</body></html>', "quirks"),
    ("text after the body", "<body>a</body>b</html>c<!--d-->", "<html><head></head><body>abc<!--d--></body></html>", "quirks"),
    ("comments around", "<!--a--><html><!--b--><head></head><!--c--></html><!--d-->", "<!--a--><html><!--b--><head></head><!--c--><body></body></html><!--d-->", "quirks"),
    ("limited quirks", "<!DOCTYPE html PUBLIC '-//W3C//DTD XHTML 1.0 Transitional//EN' 'x'>", "<!DOCTYPE html><html><head></head><body></body></html>", "limited-quirks"),
    ("noscript with scripting", "<head><noscript><p>x</noscript>", "<html><head><noscript><p>x</noscript></head><body></body></html>", "quirks"),
)

#: (name, XML, its serialization)
XML = (
    ("attributes", "<note lang='en' n='2'>Hi", '<note lang="en" n="2">Hi</note>'),
    ("short end tags", "<a><b></></a>", "<a><b></b></a>"),
    ("namespaces", "<a xmlns='u' xmlns:p='v'><p:b/>x&amp;y</a>", '<a xmlns="u"><p:b xmlns:p="v"></p:b>x&amp;y</a>'),
    ("instruction", "<?t d?><r/>", "<?t d?><r></r>"),
    ("CDATA", "<a><![CDATA[x<y]]></a>", "<a>x&lt;y</a>"),
    ("case matters", "<A><a></A></a>", "<A><a></a></A>"),
    ("duplicate attribute", "<a b='1' b='2'/>", '<a b="1"></a>'),
    ("unclosed", "<a><b>x", "<a><b>x</b></a>"),
    ("doctype", "<!DOCTYPE foo SYSTEM 's'><foo/>", "<!DOCTYPE foo><foo></foo>"),
    ("escapes", "<a b=\"'&lt;&quot;\">&lt;&gt;</a>", '<a b="&apos;<&quot;">&lt;&gt;</a>'),
)

#: (content attribute, encoding named)
CHARSETS = (
    ("utf-16", None),
    ("x-charset=koi8-r; y", "koi8-r"),
    ("CHARSET =\n'iso-8859-2'", "iso-8859-2"),
    ('charset="gbk"extra', "gbk"),
    ('charset="gbk', None),
    ("charset=ascii\tmore", "ascii"),
    ("charset=big5;x", "big5"),
    ("a; charset=", None),
    ("charset charset charset=x1", "x1"),
    ("charsets=a charset=b", "b"),
)

#: (name, prefix, local)
QNAMES = (
    ("svg:rect", "svg", "rect"),
    ("x:y", "x", "y"),
    (":rect", None, ":rect"),
    ("svg:", None, "svg:"),
    ("svg::rect", None, "svg::rect"),
    (":", None, ":"),
    ("one:two:three", None, "one:two:three"),
    ("rect", None, "rect"),
    ("", None, ""),
)

#: (name, public id, system id, force quirks, mode)
DOCTYPES = (
    ("html", None, None, False, "no-quirks"),
    ("html", None, None, True, "quirks"),
    ("svg", None, None, False, "quirks"),
    (None, None, None, False, "quirks"),
    ("html", "-//W3C//DTD HTML 4.01//EN", "http://www.w3.org/TR/html4/strict.dtd", False, "no-quirks"),
    ("html", "-//W3C//DTD HTML 4.01 Transitional//EN", None, False, "quirks"),
    ("html", "-//W3C//DTD HTML 4.01 Transitional//EN", "http://www.w3.org/TR/html4/loose.dtd", False, "limited-quirks"),
    ("html", "-//W3C//DTD XHTML 1.0 Frameset//EN", None, False, "limited-quirks"),
    ("html", "-//IETF//DTD HTML 2.0//EN", None, False, "quirks"),
    ("html", "HTML", None, False, "quirks"),
    ("html", None, "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd", False, "quirks"),
    ("html", None, "about:legacy-compat", False, "no-quirks"),
)


#: (name, first state, last start tag, report bad characters, text, tokens in short, number of errors)
TOKENS = (
    ("NUL and its reference", "data", None, False, "a\0b&#0;", "'a' null 'b�'", 2),
    ("title text", "rcdata", "title", False, "<b>&lt;</titles></TITLE >x", "'<b><</titles>' </title> 'x'", 0),
    ("style text", "rawtext", "style", False, "<b>&lt;</style/>x", "'<b>&lt;' </style> 'x'", 1),
    ("escaped script", "script", "script", False, "a<!--<script></script>--></script>b", "'a<!--<script></script>-->' </script> 'b'", 0),
    ("plain text", "plaintext", None, False, "<b></plaintext>&amp;\0", "'<b></plaintext>&amp;�'", 1),
    ("CDATA section", "cdata", None, False, "x]]y]]>z<b>", "'x]]yz' <b>", 0),
    ("duplicate attributes", "data", None, False, "<li id=a Id=b ID=c>", "<li id=a>", 2),
    ("self-closing", "data", None, False, "<a/><b / c>", "<a/> <b c=>", 1),
    ("no space between attributes", "data", None, False, "<p a='1'b=\"2\"c=3>", "<p a=1 b=2 c=3>", 2),
    ("doctype with an identifier", "data", None, False, "<!DOCTYPE html SYSTEM 'about:legacy-compat'>", "D(html,-,about:legacy-compat,false)", 0),
    ("empty doctype", "data", None, False, "<!doctype>", "D(-,-,-,true)", 1),
    ("comment ends", "data", None, False, "<!--a--!>b<!-->c<!--x", "!a 'b' ! 'c' !x", 3),
    ("references", "data", None, False, "&#x41;&#128;&#xD800;&#1114112;&notin;&notit &ampx", "'A€��∉\xacit &x'", 5),
    ("line ends", "data", None, False, "a\r\nb\rc", "'a\nb\nc'", 0),
    ("byte order mark at the start only", "data", None, False, "﻿a﻿b", "'a﻿b'", 0),
    ("bogus comments", "data", None, False, "<?php x?></ x></3><4>", "!?php x? ! x !3 '<4>'", 4),
    ("bad characters", "data", None, True, "a\x01﷐b", "'a\x01﷐b'", 2),
    ("bad characters unreported", "data", None, False, "a\x01﷐b", "'a\x01﷐b'", 0),
    ("cut name of a reference", "data", None, False, "&am", "'&am'", 0),
    ("cut reference by number", "data", None, False, "&#x", "'&#x'", 1),
    ("reference at the end", "data", None, False, "&notit", "'\xacit'", 1),
    ("cut tag", "data", None, False, "x<q\ncite=&lt\rid='", "'x'", 2),
)

#: (name, document, (id, parent, template, kind, namespace's end, local, text, line, form, duplicates) of its nodes)
NODES = (
    (
        "templates", "<template><td>1</td></template>x",
        ((0, None, None, "document", None, None, None, None, None, False), (1, 0, None, "element", "xhtml", "html", None, 1, None, False), (2, 1, None, "element", "xhtml", "head", None, 1, None, False), (3, 2, None, "element", "xhtml", "template", None, 1, None, False), (4, None, 3, "document", None, None, None, None, None, False), (5, 4, None, "element", "xhtml", "td", None, 1, None, False), (6, 5, None, "text", None, None, "1", None, None, False), (7, 1, None, "element", "xhtml", "body", None, 1, None, False), (8, 7, None, "text", None, None, "x", None, None, False)),
    ),
    (
        "forms own controls", "<form><input><table><td><img></table>",
        ((0, None, None, "document", None, None, None, None, None, False), (1, 0, None, "element", "xhtml", "html", None, 1, None, False), (2, 1, None, "element", "xhtml", "head", None, 1, None, False), (3, 1, None, "element", "xhtml", "body", None, 1, None, False), (4, 3, None, "element", "xhtml", "form", None, 1, None, False), (5, 4, None, "element", "xhtml", "input", None, 1, 4, False), (6, 4, None, "element", "xhtml", "table", None, 1, None, False), (7, 6, None, "element", "xhtml", "tbody", None, 1, None, False), (8, 7, None, "element", "xhtml", "tr", None, 1, None, False), (9, 8, None, "element", "xhtml", "td", None, 1, None, False), (10, 9, None, "element", "xhtml", "img", None, 1, 4, False)),
    ),
    (
        "lines and duplicates", "<p>a\n<b id=1 id=2>b\n</p>\n<i>c",
        ((0, None, None, "document", None, None, None, None, None, False), (1, 0, None, "element", "xhtml", "html", None, 1, None, False), (2, 1, None, "element", "xhtml", "head", None, 1, None, False), (3, 1, None, "element", "xhtml", "body", None, 1, None, False), (4, 3, None, "element", "xhtml", "p", None, 1, None, False), (5, 4, None, "text", None, None, "a\n", None, None, False), (6, 4, None, "element", "xhtml", "b", None, 2, None, True), (7, 6, None, "text", None, None, "b\n", None, None, False), (8, 3, None, "element", "xhtml", "b", None, 4, None, True), (9, 8, None, "text", None, None, "\n", None, None, False), (10, 8, None, "element", "xhtml", "i", None, 4, None, False), (11, 10, None, "text", None, None, "c", None, None, False)),
    ),
    (
        "integration points", "<math><annotation-xml encoding=text/html><p>x",
        ((0, None, None, "document", None, None, None, None, None, False), (1, 0, None, "element", "xhtml", "html", None, 1, None, False), (2, 1, None, "element", "xhtml", "head", None, 1, None, False), (3, 1, None, "element", "xhtml", "body", None, 1, None, False), (4, 3, None, "element", "MathML", "math", None, 1, None, False), (5, 4, None, "element", "MathML", "annotation-xml", None, 1, None, False), (6, 5, None, "element", "xhtml", "p", None, 1, None, False), (7, 6, None, "text", None, None, "x", None, None, False)),
    ),
)

#: (name, document, (line, stage, message) of its errors)
ERRORS = (
    ("stray end", "\n</p><b><p></b>", ((2, "tree", "no doctype"), (2, "tree", "unexpected end tag p in mode before html"), (2, "tree", "formatting element not current"))),
    ("end without start", "<!doctype html><p>a</div>", ((1, "tree", "unexpected end tag div in mode in body"),)),
    ("table text", "<!doctype html><table>x</table>", ((1, "tree", "text inside of a table"),)),
    ("open at the body's end", "<!doctype html><div></body>", ((1, "tree", "open elements at the end of the body"),)),
    ("after the body", "<!doctype html><p></body><p>", ((1, "tree", "unexpected start tag p in mode after body"),)),
    ("open template", "<!doctype html><template>", ((1, "tree", "end of file in template"),)),
    ("control in select", "<!doctype html><select><input>", ((1, "tree", "input inside of a select"),)),
)

#: (name, document, (edit, target, other, name, text) of its log)
ACTIONS = (
    (
        "adoption", "<!doctype html><b><p>x</b>",
        (("append_doctype_to_document", 1, None, "html", None), ("set_quirks_mode", None, None, None, "no-quirks"), ("create_element", 2, None, "html", "http://www.w3.org/1999/xhtml"), ("append", 0, 2, None, None), ("create_element", 3, None, "head", "http://www.w3.org/1999/xhtml"), ("append", 2, 3, None, None), ("pop", 3, None, None, None), ("create_element", 4, None, "body", "http://www.w3.org/1999/xhtml"), ("append", 2, 4, None, None), ("create_element", 5, None, "b", "http://www.w3.org/1999/xhtml"), ("append", 4, 5, None, None), ("create_element", 6, None, "p", "http://www.w3.org/1999/xhtml"), ("append", 5, 6, None, None), ("append", 6, None, None, "x"), ("parse_error", None, None, None, "formatting element not current"), ("remove_from_parent", 6, None, None, None), ("append", 4, 6, None, None), ("create_element", 8, None, "b", "http://www.w3.org/1999/xhtml"), ("reparent_children", 6, 8, None, None), ("append", 6, 8, None, None), ("pop", 8, None, None, None), ("pop", 6, None, None, None), ("pop", 4, None, None, None), ("pop", 2, None, None, None)),
    ),
)

#: (name, fragment, context, its namespace, attributes, within a form, scripting, mode, serialization)
_HTML, _SVG, _MATH = "http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/svg", "http://www.w3.org/1998/Math/MathML"
CONTEXTS = (
    ("row", "<td>x", "tr", _HTML, (), False, True, "no-quirks", "<td>x</td>"),
    ("section", "<td>x<tr><td>y", "tbody", _HTML, (), False, True, "no-quirks", "<tr><td>x</td></tr><tr><td>y</td></tr>"),
    ("column group", "<col><td>", "colgroup", _HTML, (), False, True, "no-quirks", "<col>"),
    ("block", "<td>x", "div", _HTML, (), False, True, "no-quirks", "x"),
    ("title", "<b>&amp;", "title", _HTML, (), False, True, "no-quirks", "&lt;b&gt;&amp;"),
    ("style", "<b>&amp;</style>", "style", _HTML, (), False, True, "no-quirks", "&lt;b&gt;&amp;amp;"),
    ("select", "<option>a<input>b", "select", _HTML, (), False, True, "no-quirks", "<option>ab</option>"),
    ("template", "<tr><td>x", "template", _HTML, (), False, True, "no-quirks", "<tr><td>x</td></tr>"),
    ("table", "<caption>c<td>d", "table", _HTML, (), False, True, "no-quirks", "<caption>c</caption><tbody><tr><td>d</td></tr></tbody>"),
    ("cell", "</td>x<td>y", "td", _HTML, (), False, True, "no-quirks", "xy"),
    ("root", "<head>a<body>b", "html", _HTML, (), False, True, "no-quirks", "<head></head><body>ab</body>"),
    ("frameset", "<frame><p>", "frameset", _HTML, (), False, True, "no-quirks", "<frame>"),
    ("svg", "<![CDATA[a]]><lineargradient>", "svg", _SVG, (), False, True, "no-quirks", "a<linearGradient></linearGradient>"),
    ("integration point", "<p>x<mi>", "annotation-xml", _MATH, (("encoding", "text/html"),), False, True, "no-quirks", "<p>x<mi></mi></p>"),
    ("within a form", "<form><input></form>", "div", _HTML, (), True, True, "no-quirks", "<input>"),
    ("quirks", "<p>a<table>", "body", _HTML, (), False, True, "quirks", "<p>a<table></table></p>"),
    ("noscript with scripting", "<b>x</b>", "noscript", _HTML, (), False, True, "no-quirks", "&lt;b&gt;x&lt;/b&gt;"),
    ("noscript without scripting", "<b>x</b>", "noscript", _HTML, (), False, False, "no-quirks", "<b>x</b>"),
)

#: (name, document, its tree in lines, without scripting)
DUMPS = (
    ("noscript in the head", "<noscript><link><p>x</noscript>", "| <html>\n|   <head>\n|     <noscript>\n|       <link>\n|   <body>\n|     <p>\n|       \"x\""),
    ("template modes", "<template><col><b>", "| <html>\n|   <head>\n|     <template>\n|       content\n|         <col>\n|   <body>"),
    ("nested templates", "<template><p>a<template>b</template></template>", "| <html>\n|   <head>\n|     <template>\n|       content\n|         <p>\n|           \"a\"\n|           <template>\n|             content\n|               \"b\"\n|   <body>"),
    ("foreign", "<svg viewbox=1 xlink:href=#a><desc><b>x", "| <html>\n|   <head>\n|   <body>\n|     <svg svg>\n|       xlink href=\"#a\"\n|       viewBox=\"1\"\n|       <svg desc>\n|         <b>\n|           \"x\""),
    ("doctype", "<!DOCTYPE html PUBLIC 'p' ''><!--c-->", '| <!DOCTYPE html "p" "">\n| <!-- c -->\n| <html>\n|   <head>\n|   <body>'),
)

#: (name, XML, (id, parent, kind, prefix, namespace, name, attributes, text) of its nodes)
XML_NODES = (
    ("namespaces", "<a xmlns='u' xmlns:p='v' p:x='1' y='2'><p:b/><q:c/></a>", ((0, None, "document", None, None, None, "", None), (1, 0, "element", None, "u", "a", "{v}x=1 {}y=2", None), (2, 1, "element", "p", "v", "b", "", None), (3, 1, "element", "q", "", "c", "", None))),
    ("after the root", "<a><b></a>x</b>", ((0, None, "document", None, None, None, "", None), (1, 0, "element", None, "", "a", "", None), (2, 1, "element", None, "", "b", "", None))),
    ("prolog", "<?xml version='1.0'?><!--c--><!DOCTYPE r PUBLIC 'p' 's'><r><![cdata[<]]></r><!--d-->", ((0, None, "document", None, None, None, "", None), (1, 0, "instruction", None, None, "xml", "", "version='1.0'"), (2, 0, "comment", None, None, None, "", "c"), (3, 0, "doctype", None, None, "r", "", None), (4, 0, "element", None, "", "r", "", None), (5, 4, "text", None, None, None, "", "<"), (6, 0, "comment", None, None, None, "", "d"))),
    ("references", "<r>&#65;&lt;&bogus;</r>", ((0, None, "document", None, None, None, "", None), (1, 0, "element", None, "", "r", "", None), (2, 1, "text", None, None, None, "", "A<&bogus;"))),
    ("cut", "<a><b>x", ((0, None, "document", None, None, None, "", None), (1, 0, "element", None, "", "a", "", None), (2, 1, "element", None, "", "b", "", None), (3, 2, "text", None, None, None, "", "x"))),
    ("NUL", "<a>\0b</a>", ((0, None, "document", None, None, None, "", None), (1, 0, "element", None, "", "a", "", None), (2, 1, "text", None, None, None, "", "�b"))),
)

#: (name, XML, tokens in short, number of errors)
XML_TOKENS = (
    ("kinds", "<a b='1'><c/>x</></a>", "<a b=1> <c/> 'x' short_tag </a>", 0),
    ("instruction and section", "<?t d?><!--c--><![CDATA[<&]]>", "instruction:t:d !c '<&'", 0),
    ("duplicates", "<r a='1' a='2'/>", "<r a=1/>", 1),
    ("cut tag", "<a>b</a", "<a> 'b' </a>", 1),
    ("cut attribute", "<a b", "<a b=>", 1),
    ("cut comment", "<!--x", "!x", 1),
    ("cut section", "<![CDATA[x", "'x'", 1),
    ("cut instruction", "<?t d", "instruction:t:d", 1),
    ("doctype", "<!DOCTYPE r PUBLIC 'p' 's'>", "D(r,p,s,false)", 0),
)

#: (name, document, numbers of its ended scripts, encodings that it names)
HINTS = (
    ("scripts", "<script>1</script><p><script src=x></script><script>never", "3,7", ""),
    ("encodings", "<meta charset=a><meta http-equiv=content-type content='x; charset=b'><meta content=charset=c>", "", "a,b"),
)

#: (encoding label, bytes in hex, text)
ENCODINGS = (
    ("koi8-r", "f0d2c9d7c5d4", "Привет"),
    ("latin1", "80e9", "€é"),
    ("shift_jis", "93fa967b", "日本"),
    ("gb2312", "c4e3bac3", "你好"),
    ("windows-1251", "cff0e8", "При"),
    ("utf-16le", "61003d20", "a‽"),
    ("euc-kr", "b0a1ff", "가�"),
    ("x-cp1251", "cff0e8", "При"),
    ("csisolatin1", "80e9", "€é"),
    ("iso-8859-8-i", "f9ece5ed", "שלום"),
    ("windows-31j", "8740", "①"),
    ("big5", "a741a66e", "你好"),
    ("iso-8859-9", "f0fd", "ğı"),
    ("x-mac-cyrillic", "8fe0e8", "Паи"),
    ("unicodefffe", "203d", "‽"),
    (" UTF8\n", "c3a9ff", "é�"),
)

def values_sql(rows, *columns: str) -> str:
    """A SELECT of rows, for DuckDB."""
    def literal(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, row)) + ')' for row in rows)}) AS v({', '.join(columns)})"
