import os
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import extract, queries, sql, suffixes
from tests.conftest import SMALL

ROW = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><nav>menu</nav><article><h1>T</h1><p>a <b>b</b>\n c<br>d<p>e</article><footer>f", "T\n\na b c d\n\ne"),
        ("<main><header><h1>T</h1></header><p>x</p><aside>y</aside><form><p>z</form></main>", "T\n\nx"),
        ("<article><p>x</p><div class='share-buttons share'>s</div><section id=comments><article class=comment><p>c</article></section></article>", "x"),
        ("<div role=main><p>x &amp; y&nbsp;z &#x41;</p><script>var a = '<p>no</p>'</script><style>p{}</style></div>", "x & y z A"),
        ("<body class='has-sidebar'><div class=cookie-notice>c</div><article><p>x</article>", "x"),
        ("<article><p>loaded threads</p><p class=lead>x</p><div class='ad'>no</div><div class=addition>yes</div></article>", "loaded threads\n\nx\n\nyes"),
        ("<article><table><tr><td>a<td>b</table><ul><li>c<li>d</ul><pre>e\nf</pre></article>", "a\n\nb\n\nc\n\nd\n\ne f"),
        ("<body><header>h</header><p>plain</p><footer>f</footer>", "plain"),
        ("<article><p hidden>h</p><div hidden>h</div><p>x <!-- c --> y", "x y"),
        ("<article><h1 class=banner>T</h1><p class=advert>no<p>yes</p><ul><li>a<li class=share>b<li>c</ul><h2 id=comments>no</h2><p>end", "T\n\nyes\n\na\n\nc\n\nend"),
        ("<article><p>x <math><mi>y</mi></math> z</p><div class=widget><p>no</p></div></div><p>yes</p></article><p>no", "x y z\n\nyes"),
        ("no markup < at all", "no markup < at all"),
        ('<article><p title=5">Text with "quote" here</p><p><a href=x" class=y>b</a>', 'Text with "quote" here\n\nb'),
        ('<script>var s="<main>"</script><p>plain <em>text</em><article', "plain text"),
        ('<div class="ad-free"><p>hello', "hello"),
        ('<article><section class="social"><p>on society</p></section><p class="search results">found</p><p class="related">x</p><div class="story-comments-free note">y</div>', "on society\n\nfound\n\nx\n\ny"),
        ('<article><p>x</p><div class="related"><a href=1>one more</a> <a href=2>another</a></div><div class="ad-box_2">no</div><div id="ad_300x250">no</div>', "x"),
        ("<div><article><p>x<table><tr><td></div>y</table></article></div><p>no", "x\n\ny"),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul><dl><dt>e<dd>f<p>g</dl><select><option>no</select>h", "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng\n\nh"),
        ("<article><p>x<b></article>y</p>z", "x"),
        ("<p>a<svg><path><p>b<svg><foreignObject><p>no</p></foreignObject><g/></svg>c<svg/>d", "a\n\nb c d"),
        ("<p>a<table><tr><td>b</table><svg><text>no</text></svg><noscript>no</noscript><select><option>no</select>", "a\n\nb"),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(html, text):
    assert extract.main_text(html) == text


def brute_shared(streams, depth, least):
    """The runs of depth tokens in so many streams, with their counts."""
    count = Counter()
    for blocks in streams:
        count.update({tuple(w[i : i + depth]) for w in blocks for i in range(len(w) - depth + 1)})
    return {run: n for run, n in count.items() if n >= least}


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_like_sorting(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 1 + seed, int(rng.integers(0, 80)))
    if seed == 5:
        ids = np.tile(rng.integers(0, 9, 30), 3)
    order, common = suffixes.suffix_array(ids)
    want = sorted(range(len(ids)), key=lambda i: ids[i:].tolist())
    assert order.tolist() == want
    for k in range(1, len(want)):
        a, b = ids[want[k - 1] :].tolist(), ids[want[k] :].tolist()
        assert common[k] == len(os.path.commonprefix([a, b]))


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_shared_prefixes_like_counting(depth):
    rng = np.random.default_rng(depth)
    streams = [[[f"w{x}" for x in rng.integers(0, 4, int(rng.integers(1, 12)))] for _ in range(int(rng.integers(1, 4)))] for _ in range(12)]
    for least in (1, 2, 4):
        hashes = suffixes.TokenHashes()
        given = [extract.stream_of([("", " ".join(words)) for words in blocks], depth, hashes) for blocks in streams]
        got = dict(zip(*(x.tolist() for x in suffixes.shared_prefixes(given, depth, least)), strict=True))
        want = brute_shared(streams, depth, least)
        assert got == {int(suffixes.window_hashes(hashes.of(list(run)), depth)[0]): n for run, n in want.items()}


def test_shared_runs_go_where_no_article_is_marked(spark):
    boiler = "subscribe now to get all of our news by mail every single day"
    unique = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(i, f"http://h.example/{i}", f"<body><div>{boiler}</div><p>{u}</p><p>{u[:39]} {boiler}</p></body>") for i, u in enumerate(unique)]
    rows += [(10, "http://other.example/", f"<p>{boiler}</p>"), (11, "http://other.example/1", f"<p>{boiler}</p>"), (12, "http://h.example/a", f"<article><p>{boiler}</p></article>")]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, ROW).repartition(3)).collect()}
    for i, u in enumerate(unique):
        assert got[i] == f"{u}\n\n{u[:39]}"
    assert got[10] == got[11] == got[12] == boiler


def test_deep_pages():
    for text in ("<div>" * 60_000 + "t" + "</span>" * 60_000, "<div>" * 30_000 + "</p>" * 30_000 + "t", "<td>" * 30_000 + "</div>" * 30_000 + "t", "<ul><li>" * 20_000 + "t" + "</li>" * 20_000):
        began = time.process_time()
        assert extract.main_text(text) == "t" and time.process_time() - began < 6


def test_exact_copies_of_a_page_do_not_count_as_repetition(spark):
    text = " ".join(f"word{j}" for j in range(40))
    rows = [(i, f"http://h.example/{i}", f"<p>{text}</p>") for i in range(5)]
    assert {r["text"] for r in extract.extract(spark.createDataFrame(rows, ROW)).collect()} == {text}


def test_awkward_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<p>" + "x " * 50_000), (3, "http://a/", "<article>" + "<div>" * 3000 + "t"), (4, "", "<script>never ends <p>x")]
    given = spark.createDataFrame(rows, ROW).withColumns({c: F.lit("clash") for c in ("id", "marked", "key", "host", "text", "covered")})
    got = sorted(((r["page_id"], len(r["text"])) for r in extract.extract(given).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 99_999), (3, 1), (4, 0), (None, 0)]
    assert extract.extract(given.where("page_id > 9")).count() == 0


def test_query(spark, same_as_sql):
    frame = queries.op5_extract(spark, SMALL)
    same_as_sql(frame, sql.OP5)
    assert np.all([r["n_chars"] == len(r["text"]) for r in frame.collect()])


def test_what_few_pages_share_and_short_blocks_stay(spark):
    boiler = "all rights reserved by the owners of this site and by those who write for it"
    quote = "it is a truth that all who read this far will know by heart and can repeat"
    pages = []
    for i in range(40):
        unique = " ".join(f"w{i}x{j}" for j in range(30))
        said = f"{unique} {quote} {unique[::-1]}" if i < 4 else unique
        pages.append((i, f"http://h.example/{i}", f"<p>Introduction</p><p>{said}</p><p>a short paragraph</p><p>{boiler}</p>", f"Introduction\n\n{said}\n\na short paragraph"))
    # a part of the site with words of its own, on a quarter of the pages
    pages = [(i, u, h + f"<p>part {boiler[::-1]}</p>" if i % 4 == 0 else h, t) for i, u, h, t in pages]
    found = extract.extract(spark.createDataFrame([p[:3] for p in pages], ROW).repartition(3)).collect()
    assert {r["page_id"]: r["text"] for r in found} == {i: t for i, _, _, t in pages}


def many_pages(n):
    """Pages of two hosts with runs that 8, 11, 15, 25 and 55 % of them share, in unmarked and in marked pages."""
    rng = np.random.default_rng(7)
    boiler = {share: " ".join(f"b{share}x{j}" for j in range(15)) for share in (8, 11, 15, 25, 55)}
    pages = []
    for i in range(n):
        own = " ".join(f"u{i}x{j}" for j in range(20))
        found = [boiler[s] for s in boiler if rng.random() < s / 100]
        body = "".join(f"<p>{t}</p>" for t in [own, *found])
        pages.append((i, f"http://{'ab'[i % 3 == 0]}.example/{i}", f"<article>{body}</article>" if i % 4 == 0 else body, [own, *found]))
    return pages


def brute_texts(pages, depth=12, min_pages=3, enough=10):
    """id -> text, by counting runs over whole hosts."""
    out = {}
    for host in {u.split("/")[2] for _, u, *_ in pages}:
        own = [p for p in pages if p[1].split("/")[2] == host]
        counts = brute_shared([[t.split(" ") for t in texts] for *_, texts in own], depth, 1)
        least, half = extract.needed(len(own), min_pages, enough), max(enough, len(own) / 2)
        for i, _, html, texts in own:
            kept = []
            for text in texts:
                words, bound = text.split(" "), half if "<article>" in html else least
                gone = {j + d for j in range(len(words) - depth + 1) if counts[tuple(words[j : j + depth])] >= bound for d in range(depth)}
                if "<article>" in html:
                    kept.append("" if len(gone) == len(words) else text)
                else:
                    kept.append(" ".join(w for j, w in enumerate(words) if j not in gone))
            out[i] = "\n\n".join(t for t in kept if t)
    return out


@pytest.mark.parametrize(("unit", "shard", "broadcast"), [(1 << 20, 512, 10_000), (1 << 20, 40, 0), (1500, 40, 10_000), (700, 1000, 10_000)])
def test_split_hosts_like_whole_ones(spark, monkeypatch, unit, shard, broadcast):
    monkeypatch.setattr(extract, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(extract, "UNIT_TOKENS", unit)
    monkeypatch.setattr(extract, "SHARD_ROWS", shard)
    pages = many_pages(300)
    given = spark.createDataFrame([p[:3] for p in [*pages, pages[0], pages[7]]], ROW).repartition(3)
    found = extract.extract(given).collect()
    assert len(found) == 302
    want = brute_texts(pages)
    assert {r["page_id"]: r["text"] for r in found} == want
    assert any("b25x" in h and "b25x" not in want[i] for i, _, h, _ in pages) and any("b55x" in h and "b55x" not in want[i] for i, _, h, _ in pages if i % 4 == 0)
    assert all(("b25x" in h) == ("b25x" in want[i]) for i, _, h, _ in pages if i % 4 == 0)


def test_weak_blocks_take_the_vote_of_repeats(spark):
    pages = [(i, f"http://h.example/{i}", f"<article><p>own {i}</p><p class=notice>the same for all</p><p class=notice>only here {i}</p></article>") for i in range(12)]
    found = extract.extract(spark.createDataFrame(pages, ROW)).collect()
    assert {r["page_id"]: r["text"] for r in found} == {i: f"own {i}\n\nonly here {i}" for i in range(12)}
