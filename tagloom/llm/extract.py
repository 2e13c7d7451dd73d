"""Main text of web pages, by the votes of structure and of a host suffix array.

Structure: a page is read by the engine's own HTML tokenizer over a stack of open
elements (whose end tags act within their scope, as in a tree; the whole tree builder
takes twice the time), and its blocks get a zone.
``main`` is what article or main elements (or the equal roles) hold; ``aside`` is menus,
adverts, notices, forms, comments and the like by element, role, class or id; ``weak``
is a block within an article whose name is as often an ordinary word (social, search,
related); all else is plain. A name counts only if all of its parts are known words, so
that "ad-free" is no advert.

Repeats: the token streams of a host's pages are concatenated and their suffixes
sorted; neighbours with a common prefix of ``depth`` tokens or more are a repeat, and
what enough different pages of the host share is boilerplate. Enough is half of the
pages, from ``enough`` on a fifth of them but no fewer than ``enough``; and always
``min_pages``. What a few pages quote of each other stays.

All pages take both votes. Plain blocks, where a page marks no article, lose the runs
that repeats cover and keep the runs between them. Weak blocks go if repeats cover them
or most of them are links. Main blocks go only if runs that half of the host's pages
(and ``enough``) share cover them wholly: an advert within the article that nothing
marks. Asides go in any case, and plain blocks do where an article is marked.

A host is dealt into shards, each sorted by one task in units of at most
``UNIT_TOKENS`` tokens, so a host that holds a third of all pages is spread. A unit
reports the runs that a tenth of its pages share, with their counts. A run that all
units report is counted exactly; for others the unreported counts have a bound, and
where that bound leaves a decision open, the run is counted over all pages. A host that
is one unit is decided there. The result is that of one suffix array of the whole host.

Defined cases: null and empty html give empty text; markup that never closes
reaches to the page's end; pages that repeat exactly count as one page for the
repeats and get a row each; null urls are a host of their own; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernel import html_tokenizer as lex
from ..kernel.names import BREAKOUT
from ..kernel.tokens import Characters, Tag
from .common import BROADCAST_ROWS, durable, map_arrow, small_side
from .suffixes import BLOCK_END, FILL, TokenHashes, shared_prefixes, window_hashes

#: Elements whose content is not shown: raw text to the tokenizer, and others.
STATES = {"script": lex.SCRIPT, "title": lex.RCDATA, "textarea": lex.RCDATA} | dict.fromkeys("style noscript iframe noembed noframes xmp".split(), lex.RAWTEXT)
HIDDEN = frozenset("template svg select object canvas audio video datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol option p plaintext pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: End tags of other elements do not act beyond these.
SCOPE = frozenset("table td th caption button object template svg foreignobject desc".split())
#: Start tags that end an open element, unless it is beyond one of a set.
_ENDS = {"li": (("li",), frozenset("ul ol menu".split()))} | dict.fromkeys(("dt", "dd"), (("dt", "dd"), frozenset(("dl",)))) | dict.fromkeys(("td", "th"), (("td", "th"), frozenset(("table", "tr")))) | dict.fromkeys(("tr", "tbody", "thead", "tfoot"), (("tr", "caption"), frozenset(("table",))))
ASIDE = frozenset("nav footer aside form head button dialog menu fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words in class and id names. STRONG: what is not the article; WEAK: so only outside of it, or if more speaks for it; NEUTRAL: what such names are put together with.
STRONG = frozenset(
    "ad ads adslot adbox adunit adcontainer adwrapper adbanner adblock adspace advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions banner banners sidebar sidebars nav navbar navlist topnav subnav mainnav sitenav sidenav navigation menu menus breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus cookie cookies consent gdpr popup popups paywall modal overlay newsletter subscribe subscription signup share sharing widget widgets pagination pager toolbar login".split()
)
WEAK = frozenset("social related recommended recommendations search notice notices alert alerts announcement announcements disclaimer disclaimers respond replies skip".split())
NEUTRAL = frozenset("site page main top bottom left right side box bar block container wrapper wrap inner outer area section list item items unit slot space panel link links button buttons form content text body header head post article entry story media".split())
_COMMENTS = frozenset("comment comments".split())
_HEADERS = frozenset("header site-header page-header".split())
#: Tokens that one unit of a host's suffix array takes, and rows of a host's shard.
UNIT_TOKENS, SHARD_ROWS = 1 << 20, 512


def name_vote(names: str) -> str:
    """What class and id names say: "strong", "weak" or ""."""
    vote = ""
    for token in names.lower().split():
        parts = [p for p in re.split("[-_]+", token) if p and not re.fullmatch(r"\d+(x\d+)?", p)]
        if token in ("side-bar", "side_bar"):
            return "strong"
        if parts and all(p in STRONG or p in WEAK or p in NEUTRAL for p in parts):
            if any(p in STRONG for p in parts):
                return "strong"
            if any(p in WEAK for p in parts):
                vote = "weak"
    return vote


def _zone(tag: str, attrs: list[tuple[str, str]], zone: str) -> str:
    """The zone within an element, from the zone around it."""
    if zone == "aside":
        return zone
    inside = zone in ("main", "weak")
    if not attrs:
        return zone if inside and tag in ("article", "main") else "main" if tag in ("article", "main") else "aside" if tag in ASIDE or tag == "header" and not inside else zone
    given = dict(attrs)
    role = given.get("role", "").lower().split()
    names = f"{given.get('class', '')} {given.get('id', '')}"
    if tag in ("article", "main") or "main" in role or given.get("itemprop", "").lower() == "articlebody":
        return "aside" if inside and not _COMMENTS.isdisjoint(names.lower().split()) else zone if inside else "main"
    if tag in ASIDE or not _ROLES.isdisjoint(role) or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", "").lower()):
        return "aside"
    if tag in ("html", "body", "h1"):
        return zone
    if not inside and (tag == "header" or not _HEADERS.isdisjoint(names.lower().split())):
        return "aside"
    vote = name_vote(names) if names != " " else ""
    if vote == "strong" or vote == "weak" and not inside:
        return "aside"
    return "weak" if vote else zone


class _Blocks:
    """Takes tokens; the stack holds (name, zone around, within a link, within hidden content) of open elements."""

    def __init__(self):
        self.out: list[tuple[str, str, bool]] = []
        self.text: list[str] = []
        self.linked = 0
        self.zone, self.in_link, self.hidden = "", False, False
        self.stack: list[tuple[str, str, bool, bool]] = []
        self.places: dict[str, list[int]] = {}  # of the open elements, by name
        self.scopes: list[int] = []
        self.tokenizer: lex.Tokenizer | None = None
        self.raw = False

    def __call__(self, token, line: int) -> None:
        kind = type(token)
        if kind is Characters:
            if not (self.raw or self.hidden):
                self.text.append(token.data)
                if self.in_link:
                    self.linked += len(token.data)
        elif kind is Tag:
            if self.raw:  # the end of raw text
                self.raw = False
                self.text.append(" ")
            elif token.kind == "start":
                self.start(token)
            else:
                self.end(token.name)

    def flush(self) -> None:
        if self.hidden or not self.text:
            return
        joined = "".join(self.text)
        if words := joined.split():
            self.out.append((self.zone, " ".join(words), 2 * self.linked >= len(joined)))
        self.text.clear()
        self.linked = 0

    def start(self, token: Tag) -> None:
        name = token.name
        if name in STATES:
            if not self.places.get("svg"):
                self.tokenizer.state, self.raw = STATES[name], True
            return
        if name == "plaintext":
            self.tokenizer.state = lex.PLAINTEXT
        if name in BREAKOUT and (svg := self.places.get("svg")) and svg[-1] > max((p[-1] for n in ("foreignobject", "desc") if (p := self.places.get(n))), default=-1):
            self.pop_to(svg[-1])  # what an image can't hold ends it
        if name in BLOCK:
            self.flush()
            if self.places.get("p"):
                self.close("p")
        if name in _ENDS:
            ends, bounds = _ENDS[name]
            at = max((p[-1] for e in ends if (p := self.places.get(e))), default=-1)
            if at > max((p[-1] for b in bounds if (p := self.places.get(b))), default=-1):
                self.pop_to(at)
        if name in VOID or token.self_closing and self.places.get("svg"):
            if name == "br":
                self.text.append(" ")
            return
        zone = _zone(name, token.attrs, self.zone)
        hides = name in HIDDEN
        link = name == "a" and any(k == "href" for k, _ in token.attrs)
        if not (zone != self.zone or name in BLOCK or hides or link or name in SCOPE):
            return  # such an element changes nothing, nor does its end
        if hides:
            self.text.append(" ")
            if token.self_closing and name == "svg":
                return
        elif zone != self.zone:
            self.flush()
        if name in SCOPE:
            self.scopes.append(len(self.stack))
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, self.zone, self.in_link, self.hidden))
        self.zone, self.in_link, self.hidden = zone, self.in_link or link, self.hidden or hides

    def close(self, name: str) -> None:
        places = self.places.get(name)
        if places and (name in SCOPE or not self.scopes or places[-1] > self.scopes[-1]):
            self.pop_to(places[-1])

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        self.close(name)

    def pop_to(self, place: int) -> None:
        zone = self.zone
        while len(self.stack) > place:
            name, around, self.in_link, self.hidden = self.stack.pop()
            if around != zone:
                self.flush()  # in the zone that it was read in
            zone = self.zone = around
            self.places[name].pop()
            if name in SCOPE:
                self.scopes.pop()


def blocks(html: str) -> list[tuple[str, str, bool]]:
    """(zone, text, mostly links) of a page's blocks in order; zone: "main", "weak", "aside" or ""."""
    found = _Blocks()
    found.tokenizer = lex.Tokenizer(html, found)
    found.tokenizer.run()
    found.hidden = False
    found.flush()
    return found.out


def candidates(found: list[tuple[str, str, bool]]) -> list[tuple[str, str]]:
    """(zone, text) of the blocks that structure leaves: those of the article where one is marked, else the plain ones."""
    marked = any(zone in ("main", "weak") for zone, *_ in found)
    return [(zone, text) for zone, text, links in found if (zone == "main" or zone == "weak" and not links if marked else zone == "")]


def _tokens(zone: str, text: str, depth: int, hashes: TokenHashes) -> np.ndarray:
    """The token hashes of a block; short weak blocks are filled up, so that they are compared as wholes."""
    own = hashes.of(text.split(" "))
    return np.concatenate([own, np.full(depth - len(own), FILL, np.uint32)]) if zone == "weak" and len(own) < depth else own


def stream_of(kept: list[tuple[str, str]], depth: int, hashes: TokenHashes) -> np.ndarray:
    """The blocks' tokens one after another, with ends between; blocks of fewer than ``depth`` can't repeat."""
    end, out = np.array([BLOCK_END], np.uint32), []
    for zone, text in kept:
        own = _tokens(zone, text, depth, hashes)
        if len(own) >= depth:
            out += [own, end]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _covered(tokens: np.ndarray, runs: np.ndarray, depth: int) -> np.ndarray:
    """Which tokens lie within one of the runs (sorted hashes of their first tokens)."""
    marks = np.zeros(len(tokens) + 1, np.int64)
    if len(tokens) >= depth and len(runs):
        own = window_hashes(tokens, depth)
        at = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, own), len(runs) - 1)] == own)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + depth, -1)
    return np.cumsum(marks[:-1]) > 0


def main_text(html: str | None) -> str:
    """The text of a page that has no host: by its structure alone."""
    return cut_text(candidates(blocks(html or "")), np.zeros(0, np.uint64), np.zeros(0, np.uint64), 1, TokenHashes())


def cut_text(kept: list[tuple[str, str]], shared: np.ndarray, by_most: np.ndarray, depth: int, hashes: TokenHashes) -> str:
    """Blocks joined by blank lines; shared, by_most: sorted hashes of runs that enough, and that most pages of the host have."""
    out = []
    if not len(shared):
        return "\n\n".join(text for _, text in kept)
    for zone, text in kept:
        gone = _covered(_tokens(zone, text, depth, hashes), by_most if zone == "main" else shared, depth)
        if zone == "" and gone.any():
            text = " ".join(w for w, g in zip(text.split(" "), gone.tolist(), strict=True) if not g)
        elif gone.all():
            text = ""
        if text:
            out.append(text)
    return "\n\n".join(out)


def needed(pages: int, min_pages: int, enough: int) -> float:
    """How many of a host's pages make a run boilerplate."""
    return max(min_pages, min(pages / 2, max(pages / 5, enough)))


def _streams(pages: DataFrame, depth: int) -> DataFrame:
    """(host, content, stream) of the pages that have text: a hash of it, and its tokens' hashes."""
    def task(batches):
        hashes = TokenHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                hosts, contents, streams = [], [], []
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    kept = candidates(blocks(html or ""))
                    if kept:
                        hosts.append(host)
                        contents.append(xxhash.xxh64_intdigest("\n".join(text for _, text in kept)))
                        streams.append(stream_of(kept, depth, hashes).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(np.array(contents, np.uint64).view(np.int64)), pa.array(streams, pa.binary())], ["host", "content", "stream"])

    return map_arrow(pages.select("host", "html"), task, "host string, content long, stream binary")


_REPORT = "host string, run long, n long, pages long, whole boolean"


def _reports(streams: DataFrame, depth: int, min_pages: int, enough: int) -> DataFrame:
    """(host, run, n, pages, whole): runs that n pages of a unit share, of so many; without a run: each unit. whole: the unit is the host."""
    def task(batches):
        unit: list[np.ndarray] = []
        key, last, size, alone = None, None, 0, True

        def report(host, is_whole):
            n = len(unit)
            least = needed(n, min_pages, enough) if is_whole else max(2, n / 10)
            runs, counts = shared_prefixes(unit, depth, int(np.ceil(least))) if n >= least else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            k = len(runs) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([host] * k, pa.string()), pa.array([None, *runs.view(np.int64).tolist()], pa.int64()), pa.array([0, *counts.tolist()], pa.int64()), pa.array([n] * k, pa.int64()), pa.array([is_whole] * k)], ["host", "run", "n", "pages", "whole"]
            )

        for batch in batches:
            for host, salts, content, stream in zip(*(batch.column(c).to_pylist() for c in ("host", "salts", "content", "stream")), strict=True):
                if key is None or host != key[0]:
                    if unit:
                        yield report(key[0], alone and key[1] == 1)
                    unit, key, last, size, alone = [], (host, salts), None, 0, True
                elif size > UNIT_TOKENS:
                    yield report(key[0], False)
                    unit, size, alone = [], 0, False
                if content != last:  # an exact copy counts once
                    last = content
                    unit.append(np.frombuffer(stream, np.uint32))
                    size += len(unit[-1])
        if unit:
            yield report(key[0], alone and key[1] == 1)

    return map_arrow(streams.select("host", "salts", "content", "stream"), task, _REPORT)


def _counted(streams: DataFrame, open_runs: DataFrame, depth: int) -> DataFrame:
    """(host, run, n): the pages with each of the runs that units leave open, over all pages."""
    def task(batches):
        for batch in batches:
            for host, content, stream in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "stream")), strict=True):
                tokens = np.frombuffer(stream, np.uint32)
                parts = np.split(tokens, np.flatnonzero(tokens == BLOCK_END) + 1)
                runs = np.unique(np.concatenate([window_hashes(part[:-1], depth) for part in parts])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(runs), pa.string()), pa.array([content] * len(runs), pa.int64()), pa.array(runs)], ["host", "content", "run"])

    rows = streams.join(small_side(durable(open_runs.select("host").distinct())), "host", "left_semi")
    rows = map_arrow(rows.select("host", "content", "stream"), task, "host string, content long, run long")
    return rows.join(open_runs.select("host", "run"), ["host", "run"], "left_semi").groupBy("host", "run").agg(F.count_distinct("content").alias("n"))


def repeats(pages: DataFrame, depth: int, min_pages: int, enough: int) -> DataFrame:
    """(host, run, most): hashes of the runs of ``depth`` tokens that enough pages of a host (columns host, html) share; most: half of them do."""
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > SHARD_ROWS)
    hosts = hosts.select("host", F.ceil(F.col("rows") / SHARD_ROWS).cast("int").alias("salts"))
    streams = _streams(pages, depth).join(small_side(durable(hosts)), "host", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.pmod(F.xxhash64("content"), F.col("salts"))
    dealt = streams.repartition("host", salt).sortWithinPartitions("host", salt, "content")
    found = durable(_reports(dealt, depth, min_pages, enough))
    half = F.greatest(F.lit(float(enough)), F.col("total") / 2)
    least = F.greatest(F.lit(float(min_pages)), F.least(F.col("total") / 2, F.greatest(F.col("total") / 5, F.lit(float(enough)))))
    totals = found.where("run IS NULL").groupBy("host").agg(F.sum("pages").alias("total"), F.count(F.lit(1)).alias("units"))
    runs = found.where("run IS NOT NULL").groupBy("host", "run").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("reports"), F.max("whole").alias("whole"))
    runs = runs.join(totals, "host").withColumns({"half": half, "least": least})
    # a unit that does not report a run has it on fewer than a tenth of its pages, or on one
    at_most = F.col("n") + (F.col("total") - F.col("pages")) / 10 + (F.col("units") - F.col("reports"))
    runs = runs.withColumn("at_most", at_most).where("at_most >= least")
    unclear = "NOT whole AND at_most > n AND (n < least OR n < half AND at_most >= half)"
    runs = durable(runs.withColumn("open", F.expr(unclear)))
    decided, unsure = runs.where("NOT open"), runs.where("open")
    if not unsure.isEmpty():
        exact = _counted(streams, unsure, depth)
        decided = decided.unionByName(unsure.drop("n").join(exact, ["host", "run"]).select(decided.columns))
    return decided.where("n >= least").select("host", "run", (F.col("n") >= F.col("half")).alias("most"))


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = 12, min_pages: int = 3, enough: int = 10) -> DataFrame:
    """(id_col, url_col, text) for each page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    runs = durable(repeats(rows, depth, min_pages, enough))
    grouped = runs.groupBy("host").agg(F.array_sort(F.collect_list("run")).alias("shared"), F.array_sort(F.collect_list(F.when(F.col("most"), F.col("run")))).alias("by_most"))
    ids = f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}"
    if runs.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(grouped), "host", "left")
    else:  # both sides are shuffled: the blocks, since markup is larger
        joined = map_arrow(rows, _kept, f"{ids}, host string, kept {_BLOCKS}").join(grouped, "host", "left")

    given_col = "kept" if "kept" in joined.columns else "html"

    def texts(batches):
        hashes = TokenHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out, host, shared, by_most = [], None, None, None
                for name, given, own, most in zip(*(part.column(c).to_pylist() for c in ("host", given_col, "shared", "by_most")), strict=True):
                    if name != host:
                        host, shared, by_most = name, *(np.sort(np.array(x or (), np.int64).view(np.uint64)) for x in (own, most))
                    kept = [(b["zone"], b["text"]) for b in given] if isinstance(given, list) else candidates(blocks(given or ""))
                    out.append(cut_text(kept, shared, by_most, depth, hashes))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    return map_arrow(joined, texts, f"{ids}, text string").withColumnsRenamed({"id": id_col, "url": url_col})


_BLOCKS = "array<struct<zone: string, text: string>>"


def _kept(batches):
    """(id, url, host, kept): the blocks that structure leaves."""
    kind = pa.list_(pa.struct([("zone", pa.string()), ("text", pa.string())]))
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [[{"zone": zone, "text": text} for zone, text in candidates(blocks(html or ""))] for html in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), part.column("host"), pa.array(found, kind)], ["id", "url", "host", "kept"])
