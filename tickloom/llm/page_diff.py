"""Main text of web pages: lines shared with the nearest page of the same host are told apart by longest common subsequences."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_texts

# How HTML elements are treated.
_RAW = frozenset("script style noscript template textarea title iframe object svg select".split())
_CONTAINER = frozenset("article main nav header footer aside form section div ul ol dl table figure fieldset menu dialog body details".split())
_BLOCK = _CONTAINER | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot blockquote pre hr address summary figcaption legend option center html".split())
#: What the start of an element ends, where its own end tag was left out; a p ends before any block.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_EMPTY = frozenset("hr html".split())
_OFF = frozenset("nav footer aside form menu dialog button".split())
_ON = frozenset("article main".split())
# Names in class, id and role that mark what is not, or is, the main text: whole ones, without hyphens and underscores.
_OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup "
    "login sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar topbar comment comments commentlist respond reply replies disqus share sharing social related "
    "recommended recommendations popup modal overlay pagination pager skip copyright disclaimer legal search searchbox form contentinfo complementary tags tagcloud "
    "adbox adcontainer adunit adwrapper sitefooter pagefooter mainfooter footerwidgets footernav footermenu footerlinks copyrightnotice mainnav mainmenu sitenav sitenavigation mainnavigation sitemenu primarynav primarymenu primarynavigation topnav topmenu subnav submenu navmenu navlinks "
    "postnavigation postnav pagenav pagenavigation leftsidebar rightsidebar sidebarleft sidebarright primarysidebar mainsidebar sidebarwidget widgetarea "
    "cookiebanner cookiebar cookieconsent cookienotice cookiepolicy gdprbanner consentbanner newslettersignup newsletterform emailsignup signupform subscribeform loginform searchform searchbar commentlist commentform commentsarea commentbody commentrespond "
    "socialshare socialsharing sociallinks socialmedia socialicons socialbuttons sharebuttons sharebar sharelinks relatedposts relatedarticles relatedcontent relatedlinks relatedstories recommendedposts recommendedarticles taglist taglinks skiplink skiplinks skiptocontent".split()
)
_HEAD_WORDS = frozenset("header topheader pageheader siteheader".split())
_ON_WORDS = frozenset("article articlebody articlecontent articletext main maincontent post postcontent postbody entry entrycontent story storybody".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


# Elements that are not switched off at all, and those that are even where they hold an article.
_NEVER_OFF = frozenset("html body main".split())
_OFF_ANYWAY = _OFF - {"form"}


def _kind(tag: str, attributes: str, around: int, holds: Callable[[], bool] = lambda: False) -> int:
    """Of what stands in an element: 1 main text, -1 not, 0 unmarked; around: that of the element around it; holds: whether it holds an article or main."""
    if around < 0 or tag in _OFF_ANYWAY or attributes and tag not in ("html", "body") and _HIDDEN.search(attributes):
        return -1
    words: set[str] = set()
    for name, value in _MARKS.findall(attributes) if attributes else ():
        words.update(re.sub(r"[-_]", "", x) for x in html.unescape(value.strip("\"'")).lower().split())
    off = tag in _OFF or words & _OFF_WORDS or around == 0 and (tag == "header" or tag in _CONTAINER and words & _HEAD_WORDS)
    if off and tag not in _NEVER_OFF and not holds():
        return -1
    return 1 if around == 1 or tag in _ON or tag not in ("html", "body") and not off and words & _ON_WORDS else 0


def _holders(page: str) -> set[int]:
    """Where the tags end that open elements with an article or main somewhere in them, other than articles that are switched off themselves (comments)."""
    out: set[int] = set()
    stack: list[tuple[str, int]] = []
    at, end = 0, len(page)
    while at < end and (m := _TAG.search(page, at)):
        at, tag = m.end(), (m[2] or "").lower()
        if tag in _RAW and not m[1]:
            at = _raw_end(page, m)
        elif tag in _CONTAINER or tag == "button":
            if not m[1]:
                if tag in _ON and _kind(tag, m[3], 0) > 0:
                    for _, k in reversed(stack):
                        if k in out:
                            break
                        out.add(k)
                stack.append((tag, at))
            elif any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
    return out


def _raw_end(page: str, m: re.Match) -> int:
    """Where a raw element ends that the tag m opens."""
    if m[3].endswith("/"):
        return m.end()
    close = re.compile(rf"</{re.escape(m[2])}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, m.end())
    return close.end() if close else len(page)


def page_lines(page: str) -> list[tuple[str, int]]:
    """Blocks of text in page order, with their kind. White space within a block is one space; character references are decoded."""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    kind, text, at, end = 0, [], 0, len(page)
    holders: list[set[int]] = []

    def holds() -> bool:
        if not holders:
            holders.append(_holders(page))
        return at in holders[0]

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split()) if text else ""
        text.clear()
        if line:
            lines.append((line, kind))

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in _RAW and not m[1]:
            flush()
            at = _raw_end(page, m)
        elif tag in _BLOCK:
            flush()
            if tag in _EMPTY:
                continue
            while stack and not m[1] and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(tag, ())):
                kind = stack.pop()[1]
            if not m[1]:
                stack.append((tag, kind))
                kind = _kind(tag, m[3], kind, holds)
            elif any(t == tag for t, _ in stack):
                while stack:
                    t, kind = stack.pop()
                    if t == tag:
                        break
        elif tag in ("br", "img", "input", "wbr"):
            text.append(" " if tag != "wbr" else "")
        elif tag == "button":
            flush()
            stack.append((tag, kind)) if not m[1] else None
            if not m[1]:
                kind = -1
            elif any(t == tag for t, _ in stack):
                while stack:
                    t, kind = stack.pop()
                    if t == tag:
                        break
    flush()
    return lines


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b: what both start and end with, and between them by matches,
    not by all pairs of lines (Hunt and Szymanski)."""
    top = 0
    while top < min(len(a), len(b)) and a[top] == b[top]:
        top += 1
    tail = 0
    while tail < min(len(a), len(b)) - top and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if top or tail:
        inner = common_lines(a[top : len(a) - tail], b[top : len(b) - tail])
        return [*range(top), *(top + x for x in inner), *range(len(a) - tail, len(a))]
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []  # smallest end in b of a common subsequence of each length
    last: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            elif ends[k] > j:
                ends[k], last[k] = j, link
    out, link = [], last[-1] if last else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def shared_lines(own: list[int | None], neighbours: list[list[int | None] | None]) -> list[int]:
    """Positions of own lines that are shared with a neighbour; lines that are None take no part."""
    places = [k for k, x in enumerate(own) if x is not None]
    a = [own[k] for k in places]
    return sorted({places[k] for other in neighbours if other for k in common_lines(a, [x for x in other if x is not None])})


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html, ...).

    Pages are put in order of host, path and page_id over all tasks, which gives each its rank. Pages with the same lines
    that follow each other are a run, so that a page's neighbours are the nearest ones before and after of its host that say
    something else; lines marked as off don't count, pages without others have no rank. Runs are paired by equality joins;
    what they lose goes back to their pages by blocks of ranks, so that a run may have any size. Lines in the longest common
    subsequence of the unmarked lines of both are shared and go, on every page. Markup is a guard on top: lines in article,
    main and the like stay, lines in menus, footers, forms, adverts, comments and so on go, whatever a neighbour shares.
    Classes, ids and roles count as whole names. They and form switch nothing off at html, body and main, nor at an element
    that holds an article or main; nav, footer, aside, menu, dialog, button and hidden elements are off with all they hold.
    Pages are parsed once, and their lines, without those marked as off, written.

    Defined results: null or empty html gives the empty text; a null url is a host of its own; pages alone on their host
    have no pair; of equal rows each gets the same text; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    p = pages.select(pages["page_id"], pages["url"], pages["html"])

    def parsed(batch: pa.RecordBatch) -> dict:
        lines = [[x for x in page_lines(page or "") if x[1] >= 0] for page in batch.column("html").to_pylist()]
        said = ["".join(f"{x}\n{k}\n" for x, k in y) if y else None for y in lines]
        return {"lines": [[x for x, _ in y] for y in lines], "open": [[k == 0 for _, k in y] for y in lines], "said": [x and blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in said]}

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^#]*)", 1)
    made = map_texts(p, ["page_id", "url"], parsed, "lines array<string>, open array<boolean>, said binary").withColumn("row", F.monotonically_increasing_id())
    made = scratch.write(made, "parsed")
    keyed = made.filter("said is not null").withColumn("host", F.when(F.col("url").isNull(), F.lit("\x00")).otherwise(host)).withColumn("path", path)
    hashes = F.transform(F.arrays_zip("lines", "open"), lambda x: F.when(x["open"], F.xxhash64(x["lines"])))
    placed = scratch.write(keyed.select("row", "page_id", "host", "path", "said", hashes.alias("lines")).orderBy("host", "path", "page_id", "row").withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.max("place").alias("most"))  # a row per partition of the sort
    start = counts.select(F.col("part").alias("_part"), F.coalesce(F.sum(F.col("most") - F.shiftleft(F.col("part"), 33) + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ranked = placed.join(start, part == start["_part"]).withColumn("rank", F.col("start") + F.col("place") - F.shiftleft(part, 33)).drop("_part", "start")
    ranked = scratch.write(ranked.withColumn("part", part).drop("place"), "ranked")

    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("host").alias("_host"), F.col("said").alias("_said"))
    slim = ranked.select("rank", "part", "host", "said").join(before.hint("merge"), "rank", "left")
    slim = scratch.write(slim.select("rank", "part", F.coalesce((F.col("_host") != F.col("host")) | (F.col("_said") != F.col("said")), F.lit(True)).alias("first")), "firsts")
    counts = slim.groupBy("part").agg(F.count_if("first").alias("n"))
    start = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    runs = slim.withColumn("run", F.sum(F.col("first").cast("long")).over(within)).join(start, "part").select("rank", (F.col("start") + F.col("run")).alias("run"), "first")
    runs = scratch.write(runs.filter("first").select("rank", "run").join(ranked.select("rank", "host", "lines").hint("merge"), "rank"), "runs")

    near = lambda step, name: runs.select((F.col("run") + step).alias("run"), F.col("host").alias(f"{name}_host"), F.col("lines").alias(name), F.col("rank").alias(f"{name}_rank"))
    pairs = runs.join(near(1, "before").hint("merge"), "run", "left").join(near(-1, "after").hint("merge"), "run", "left")
    pairs = pairs.select("rank", F.col("after_rank").alias("stop"), "lines", *(F.when(F.col(f"{x}_host") == F.col("host"), F.col(x)).alias(x) for x in ("before", "after")))

    def shared(batch: pa.RecordBatch) -> dict:
        own, before, after = (batch.column(x).to_pylist() for x in ("lines", "before", "after"))
        return {"shared": [shared_lines(a, [b, c]) for a, b, c in zip(own, before, after, strict=True)]}

    lost = map_texts(pairs, ["rank", "stop"], shared, "shared array<int>").filter(F.size("shared") > 0)
    n_ranks = ranked.agg(F.max("rank")).first()[0] or 0
    lost = lost.select(F.col("rank").alias("from"), F.coalesce("stop", F.lit(n_ranks + 1)).alias("stop"), "shared")
    lost = lost.withColumn("block", F.explode(F.sequence(F.shiftright("from", 6), F.shiftright(F.col("stop") - 1, 6))))
    pages_of = ranked.select("row", "rank", F.shiftright("rank", 6).alias("block"))
    lost = pages_of.hint("merge").join(lost, "block").filter("rank >= `from` and rank < stop").select(F.col("row").alias("_row"), "shared")
    lost = scratch.write(lost, "lost")
    out = made.join(lost, made["row"] == lost["_row"], "left")
    kept = F.filter("lines", lambda x, k: ~F.array_contains("shared", k))
    text = F.array_join(F.when(F.col("shared").isNull(), F.col("lines")).otherwise(kept), "\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
