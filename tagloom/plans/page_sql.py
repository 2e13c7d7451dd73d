"""SQL for the trees of the given pages.

Those pages have one shape: nothing in them is misnested but ``b``, which an article's
paragraphs open and never close, and nothing is cut but the ends of ``p``, ``body`` and
``html``. So their well-formed text can be put together with string functions: open
``b`` elements come back in each later paragraph and in the footer, three at most. Nodes
follow from well-formed text by counting. Nothing here parses; other pages need a parser.
"""

from __future__ import annotations

_HTML_NS = "http://www.w3.org/1999/xhtml"
_VOID = "('meta', 'br')"

#: The tags that the tree of a page has, in order; "</p>" within the script is marked by a control character.
TAGS = r"""
raw AS (
  SELECT page_id, replace(regexp_replace(replace(replace(replace(replace(html, '"</p>"', '"' || chr(1) || '"'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), '&', '&amp;') AS h FROM pages),
cut AS (
  SELECT page_id, regexp_extract(h, '(?s)^(.*<article>)', 1) AS head, string_split(regexp_extract(h, '(?s)<article>(.*?)(</article>|$)', 1), '<p>') AS ps,
         regexp_extract(h, '(?s)<footer>(.*?)(</footer>|$)', 1) AS foot FROM raw),
marked AS (
  SELECT *, list_transform(ps, lambda p, i: {'bold': starts_with(p, '<b>'), 'closed': ends_with(p, '</p>'), 'text': regexp_replace(regexp_replace(p, '^<b>', ''), '</p>$', ''),
    'b': least(3, len(list_filter(ps[1:i - 1], lambda q: starts_with(q, '<b>')))) + starts_with(p, '<b>')::INTEGER}) AS parts,
    least(3, len(list_filter(ps, lambda q: starts_with(q, '<b>')))) AS left_open FROM cut),
norm AS (
  SELECT page_id, parts, left_open, foot, head || ps[1] || array_to_string(list_transform(parts[2:], lambda p: '<p>' || repeat('<b>', p.b) || p.text || repeat('</b>', p.b) || '</p>'), '')
    || '</article><footer>' || repeat('<b>', left_open) || foot || repeat('</b>', left_open) || '</footer></body></html>' AS n FROM marked)"""

#: A row for each node but the document, by counting over the tags.
NODES = (
    "WITH "
    + TAGS
    + rf""",
tags AS (SELECT page_id, unnest(ts) AS t, unnest(range(len(ts))) AS s FROM (SELECT page_id, regexp_extract_all(n, '(?s)<!--.*?-->|<[^>]*>|[^<]+') AS ts FROM norm)),
named AS (SELECT *, regexp_extract(t, '^</?([a-z0-9]+)', 1) AS tag FROM tags),
stepped AS (
  SELECT *, 1 + coalesce(sum(CASE WHEN tag = '' OR tag IN {_VOID} THEN 0 WHEN t LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM named),
nodes0 AS (
  SELECT page_id, t, tag, depth::INTEGER AS depth, (row_number() OVER (PARTITION BY page_id ORDER BY s))::INTEGER AS pre,
         CASE WHEN tag <> '' THEN 'element' WHEN t LIKE '<!--%' THEN 'comment' WHEN t LIKE '<!%' THEN 'doctype' ELSE 'text' END AS kind
  FROM stepped WHERE t NOT LIKE '</%'),
placed AS (
  SELECT a.*, (SELECT coalesce(max(b.pre), 0) FROM nodes0 b WHERE b.page_id = a.page_id AND b.pre < a.pre AND b.depth = a.depth - 1)::INTEGER AS parent_id,
         (SELECT coalesce(min(b.pre) - 1, (SELECT max(c.pre) FROM nodes0 c WHERE c.page_id = a.page_id)) FROM nodes0 b WHERE b.page_id = a.page_id AND b.pre > a.pre AND b.depth <= a.depth)::INTEGER AS post
  FROM nodes0 a),
nodes AS (
  SELECT page_id, pre AS node_id, parent_id, (row_number() OVER (PARTITION BY page_id, parent_id ORDER BY pre) - 1)::INTEGER AS ordinal, depth, pre, post, kind,
         CASE WHEN kind = 'element' THEN '{_HTML_NS}' END AS ns, CASE kind WHEN 'element' THEN tag WHEN 'doctype' THEN 'html' END AS local,
         CASE kind WHEN 'text' THEN replace(replace(t, chr(1), '</p>'), '&amp;', '&') WHEN 'comment' THEN t[5:-4] END AS text, t AS source
  FROM placed)"""
)

HTML_NODES = (
    NODES
    + """
SELECT page_id, node_id, parent_id, ordinal, depth, pre, post, kind, ns, local, text FROM nodes
UNION ALL SELECT page_id, 0, NULL, 0, 0, 0, max(pre)::INTEGER, 'document', NULL, NULL, NULL FROM nodes GROUP BY page_id"""
)

_ATTRIBUTES = """,
found AS (SELECT page_id, node_id, local AS element, regexp_extract_all(source, ' ([a-z]+)="([^"]*)"', 1) AS ks, regexp_extract_all(source, ' ([a-z]+)="([^"]*)"', 2) AS vs FROM nodes WHERE kind = 'element')"""
HTML_ATTRIBUTES = (
    NODES
    + _ATTRIBUTES
    + """
SELECT page_id, node_id, element, unnest(range(len(ks)))::INTEGER AS place, '' AS ns, unnest(ks) AS local, unnest(vs) AS value FROM found"""
)

HTML_SIBLINGS = (
    NODES
    + """
SELECT page_id, node_id, lag(node_id) OVER w AS previous_id, lead(node_id) OVER w AS next_id FROM nodes WINDOW w AS (PARTITION BY page_id, parent_id ORDER BY ordinal)"""
)

HTML_OUTLINE = (
    NODES
    + """
SELECT page_id, '#Document' || chr(10) || string_agg(repeat('    ', depth) || CASE kind WHEN 'element' THEN '<' || local || '>' WHEN 'text' THEN '#text: ' || text ELSE '#' || kind || ': ' || coalesce(text, local) END, chr(10) ORDER BY pre) AS tree
FROM nodes GROUP BY page_id"""
)

HTML_DUMP = (
    NODES
    + _ATTRIBUTES
    + """,
lines AS (
  SELECT page_id, pre, 0 AS place, '' AS sort, '| ' || repeat('  ', depth - 1) || CASE kind WHEN 'element' THEN '<' || local || '>' WHEN 'text' THEN '"' || text || '"' WHEN 'comment' THEN '<!-- ' || text || ' -->' ELSE '<!DOCTYPE ' || local || '>' END AS line FROM nodes
  UNION ALL SELECT page_id, pre, 1, k, '| ' || repeat('  ', depth) || k || '="' || v || '"' FROM (SELECT page_id, node_id, unnest(ks) AS k, unnest(vs) AS v FROM found) JOIN nodes USING (page_id, node_id))
SELECT page_id, string_agg(line, chr(10) ORDER BY pre, place, sort) AS tree FROM lines GROUP BY page_id"""
)

HTML_NORMALISED = f"WITH {TAGS} SELECT page_id, '<!DOCTYPE html>' || chr(10) || replace(replace(n, '<!DOCTYPE html>', ''), chr(1), '</p>') AS html FROM norm"

HTML_WRITTEN = f"WITH {TAGS} SELECT page_id, replace(n, chr(1), '</p>') AS html FROM norm"
HTML_ROUNDTRIP = f"WITH {TAGS} SELECT page_id, replace(n, chr(1), '</p>') AS html, replace(n, chr(1), '</p>') AS again FROM norm"

# What the tokenizer alone sees: "</p>" within the script is an end tag.
HTML_TOKENS = r"""
WITH tags AS (SELECT page_id, unnest(ts) AS t, unnest(range(len(ts)))::INTEGER AS place FROM (
  SELECT page_id, list_append(regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|[^<]+'), '') AS ts FROM pages)),
named AS (SELECT *, regexp_extract(t, '^</?([a-z0-9]+)', 1) AS tag FROM tags)
SELECT page_id, place, CASE WHEN t = '' THEN 'eof' WHEN t LIKE '<!--%' THEN 'comment' WHEN t LIKE '<!%' THEN 'doctype' WHEN t LIKE '</%' THEN 'end_tag' WHEN t LIKE '<%' THEN 'start_tag' ELSE 'characters' END AS kind,
       CASE WHEN tag <> '' THEN tag WHEN t LIKE '<!D%' THEN 'html' END AS name, len(regexp_extract_all(t, '^<[a-z].*')) * len(regexp_extract_all(t, '="'))::INTEGER AS n_attributes,
       CASE WHEN t LIKE '<!--%' THEN t[5:-4] WHEN t NOT LIKE '<%' AND t <> '' THEN regexp_replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') END AS data
FROM named"""

# Each paragraph with an open b ends with an error, and so does the footer; an article does if its last paragraph is not closed.
_ERRORS = f"""WITH {TAGS},
counted AS (
  SELECT page_id, len(list_filter(parts[2:], lambda p: p.b > 0)) - (NOT parts[-1].closed AND parts[-1].b > 0)::INTEGER AS p, (NOT parts[-1].closed AND parts[-1].b > 0)::INTEGER AS article, (left_open > 0 AND foot <> '')::INTEGER AS footer FROM norm),
errors AS (SELECT page_id, unnest(['p', 'article', 'footer']) AS name, unnest([p, article, footer]) AS n FROM counted)"""
HTML_ERRORS = _ERRORS + """ SELECT 'tree' AS stage, 'open elements at the end of ' || name AS message, sum(n)::BIGINT AS n, count(*)::BIGINT AS n_pages FROM errors WHERE n > 0 GROUP BY name"""

PAGE_ERRORS = _ERRORS + " SELECT page_id, sum(n)::BIGINT AS n FROM errors GROUP BY page_id HAVING sum(n) > 0"

HTML_ACTIONS = (
    NODES
    + _ERRORS.replace("WITH " + TAGS, "")
    + """
SELECT page_id, CASE kind WHEN 'element' THEN 'create_element' WHEN 'comment' THEN 'create_comment' ELSE 'append_doctype_to_document' END AS op, count(*)::BIGINT AS n FROM nodes WHERE kind <> 'text' GROUP BY ALL
UNION ALL SELECT page_id, 'pop', count(*)::BIGINT FROM nodes WHERE kind = 'element' GROUP BY page_id
UNION ALL SELECT page_id, 'set_quirks_mode', 1 FROM pages
UNION ALL SELECT page_id, 'parse_error', sum(n)::BIGINT FROM errors GROUP BY page_id HAVING sum(n) > 0"""
)

_XML_TAGS = r"""
WITH tags AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|[^<]+')) AS t FROM pages),
kinds AS (SELECT page_id, CASE WHEN t LIKE '<!--%' THEN 'comment' WHEN t LIKE '<!%' THEN 'doctype' WHEN t LIKE '</%' THEN 'end_tag' WHEN t LIKE '<%' THEN 'start_tag' ELSE 'characters' END AS kind FROM tags)"""
XML_TOKENS = _XML_TAGS + " SELECT page_id, kind, count(*)::BIGINT AS n FROM kinds GROUP BY ALL UNION ALL SELECT page_id, 'eof', 1 FROM pages"
# The stray end tag within the script is left out, so the texts around it are one.
XML_NODES = (
    _XML_TAGS
    + """
SELECT page_id, CASE kind WHEN 'start_tag' THEN 'element' WHEN 'characters' THEN 'text' ELSE kind END AS kind, count(*)::BIGINT - (kind = 'characters')::INTEGER AS n FROM kinds WHERE kind <> 'end_tag' GROUP BY page_id, kinds.kind
UNION ALL SELECT page_id, 'document', 1 FROM pages"""
)
