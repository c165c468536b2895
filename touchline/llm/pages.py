"""Main text of web pages: hosts agree on the path of their article, then every page is read by it."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .select import join_group

# Fixed values. Elements by what they do to text: those whose content is no markup, those whose text is no
# part of an article, those that end a block, those that hold others, those that leave a space, and those that hold nothing.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("nav footer aside button dialog menu head datalist audio video map noscript template svg object canvas select annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CONTAINERS = frozenset("html body article blockquote center details div dl fieldset figure form header li main ol section table tbody tfoot thead tr td th ul".split()) | LEFT_OUT
WITHIN = frozenset("blockquote dl ol ul li figure details fieldset table tbody tfoot thead tr header".split())  # parts of an article, never all of it
SPACES = frozenset("br td th img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Fixed values. Words in class, id or role that name what surrounds an article; words that may stand beside
# them in a name; and words that name an article.
SURROUNDINGS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs byline comment comments commentlist "
    "complementary consent contentinfo cookie cookies disclaimer discussion disqus feedback footer gdpr header masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination paywall popup recommended related replies reply respond responses search share sharing sidebar sidenav signup skip "
    "social subscribe subscription tagcloud tags toc toolbar tooltip widget widgets".split()
)
BESIDE = frozenset(
    "area articles bar block bottom box button buttons col column container content entry footer form global group header icons inner item items left links list main middle "
    "outer page panel post posts primary right row secondary section site slot stories top unit wrap wrapper zone article story".split()
)
ARTICLE_WORDS = frozenset("article content entry main post story".split())
# Fixed values. Words among the surroundings that an id of a part of an article may well be; words in names of what
# comes before an article's text; words that make them with an article's word.
TOPICS = frozenset("banner disclaimer discussion feedback footer header notice notices notification overlay pager reply respond response responses search share sharing skip tags toc toolbar tooltip widget widgets".split())
LEADS = frozenset("abstract deck dek excerpt intro introduction lead lede preamble standfirst subheading subtitle summary".split())
HEADS = frozenset("head header heading headline title top".split())

_NAME = re.compile(r"[a-z][^\s/>]*", re.I)
_QUOTE_OR_END = re.compile(r"""=\s*(["'])|>""")
_ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)

#: Elements below this depth count as part of the one at it, so paths stay short.
DEEPEST = 60
#: Share of a page's text that its article holds at least; less where the element says what it is.
MOST, SOME = 0.8, 0.4
#: Share of an element's text from which one within it stands for it.
ALL_BUT = 0.95
#: Share of a page's text that may be left when what looks like surroundings has gone; below, it stays.
LITTLE = 0.1
#: Share of a host's votes (of its pages) from which a path counts as one of its layouts (as beside its articles).
LAYOUT = 0.2
#: Share of what a page's own best path holds that a path of its host must hold to stand for it.
ENOUGH = 0.5
#: Characters outside links from which a part of an article is prose.
PROSE = 40
#: Hosts up to which the table of paths is sent to every executor (about 100 bytes a host).
BROADCAST_HOSTS = 100_000


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class _Element:
    """An open element: is its text left out for certain (out), by the look of an element around it (look:
    its number), or from within a block that goes on (silent)?"""

    __slots__ = ("tag", "path", "out", "look", "silent", "article", "depth")

    def __init__(self, tag, path, out, look, silent, article, depth):
        self.tag, self.path, self.out, self.look, self.silent, self.article, self.depth = tag, path, out, look, silent, article, depth


@lru_cache(100_000)
def is_surrounding(name: str) -> bool:
    """Does a class, id or role say that its element surrounds an article? All its words must: "has-sidebar",
    "search-and-rescue" or "article-header" don't."""
    words = [w.lower() for w in _WORD.findall(name)]
    named = [w for w in words if w in SURROUNDINGS]
    if not named or not all(w in SURROUNDINGS or w in BESIDE for w in words):
        return False
    return not (set(named) <= {"header", "footer"} and not ARTICLE_WORDS.isdisjoint(words))


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """start, end, name (lower case; empty for comments and the like), attributes, is it an end tag: the
    markup of a page in order. What is looked for in vain once is not looked for again, so time is linear."""
    size, at = len(page), 0
    missing: set[str] = set()
    low = page.lower()
    if len(low) != size:  # a few capital letters become longer; those are not part of any tag
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)

    def find(what: str, begin: int) -> int:
        if what in missing:
            return -1
        found = low.find(what, begin)
        if found < 0:
            missing.add(what)
        return found

    while (start := find("<", at)) >= 0:
        after = low[start + 1 : start + 2]
        if low.startswith("<!--", start):
            end = find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", "", False
        elif low.startswith("<![cdata[", start):
            end = find("]]>", start + 9)
            at = size if end < 0 else end + 3
            yield start, at, "", "", False
        elif after in ("!", "?"):
            end = find(">", start + 1)
            at = size if end < 0 else end + 1
            yield start, at, "", "", False
        elif name := _NAME.match(low, start + 2 if after == "/" else start + 1):
            first = find(">", start)
            if first < 0:  # the tag never ends
                yield start, size, "", "", False
                return
            closing, end = after == "/", name.end()
            while not closing:
                stop = _QUOTE_OR_END.search(page, end)
                if stop is None or stop[1] is None:
                    end = stop.start() if stop else first
                    break
                quote = find(stop[1], stop.end())
                if quote < 0:  # never closed
                    end = find(">", stop.end())
                    end = first if end < 0 else end
                    break
                end = quote + 1
            if closing:
                end = first
            at = end + 1
            yield start, at, name[0], page[name.end() : end], closing
            if not closing and name[0] in RAW and not page[end - 1 : end] == "/":
                close = find(f"</{name[0]}", at)
                if close >= 0:
                    yield at, close, "", "", False
                    at = close
        else:
            at = start + 1


def _names(attributes: str) -> tuple[list[str], str, bool, list[str]]:
    """Classes, ids and role; the role; is the element hidden? its ids."""
    names: list[str] = []
    ids: list[str] = []
    hidden, role = False, ""
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names += value.split()
            if name == "id":
                ids += value.split()
        elif name == "role":
            role = value.lower()
            names.append(role)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return names, role, hidden, ids


def _is_topic(name: str) -> bool:
    return all(w.lower() in TOPICS for w in _WORD.findall(name))


def _opened(tag: str, attributes: str, parent: _Element, number: int, topics: dict[int, int]) -> _Element:
    """The element for a start tag: its generalised path and whether its text is left out. The look of a
    form has a negative number; an id that may be the topic of an article's part is noted in topics, with the
    look around it: see _settled."""
    names, role, hidden, ids = _names(attributes)
    if tag in LEFT_OUT and tag not in BLOCKS:
        return _Element(tag, parent.path, parent.out, parent.look, True, parent.article, parent.depth)
    out = parent.out or hidden or tag in LEFT_OUT or (tag == "header" and not parent.article)
    look = parent.look
    if tag not in ("html", "body", "main"):
        looks = [n for n in names if is_surrounding(n)]
        if looks:
            look = number
            if parent.article and tag in ("div", "section") and all(n in ids and _is_topic(n) for n in looks):
                topics[look] = parent.look
        elif tag == "form" and not look:
            look = -number
    article = parent.article or tag in ("article", "main") or role in ("main", "article")
    # digits are dropped from names, so numbered elements of one kind share a path
    words = {w.lower() for n in names for w in _WORD.findall(n)}
    path = f"{parent.path}>{tag}" + "".join(f".{n}" for n in sorted(words)) if parent.depth < DEEPEST else parent.path
    return _Element(tag, path, out, look, parent.silent, article, parent.depth + 1)


def blocks_of(page: str | None) -> list[tuple[str, str, int, bool, bool]]:
    """(text, path of the container, characters in links, is it left out, is it a main heading) in page order.

    What is left out by the look of a class, id or role alone comes back if hardly any text is left
    without it.
    """
    blocks: list[tuple[str, str, int, bool, bool, int]] = []
    if not page:
        return []
    stack = [_Element("", "", False, 0, False, False, 0)]
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked: list[str] = []
    in_link = heading = False
    own_look = own_out = 0  # of a paragraph or heading, which is no container
    number = 0
    topics: dict[int, int] = {}

    def end_block() -> None:
        nonlocal own_look, own_out
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                top = stack[-1]
                links = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
                blocks.append((text, top.path, links, bool(top.out or own_out or (top.tag == "header" and not heading)), heading, own_look or top.look))
            held.clear()
            linked.clear()
        own_look = own_out = 0

    at = 0
    for begin, end, tag, attributes, closing in _tokens(page):
        if begin > at and not stack[-1].silent:
            held.append(page[at:begin])
            if in_link:
                linked.append(page[at:begin])
        at = end
        if not tag:
            continue
        if closing and tag in CONTAINERS and opened[tag]:
            while stack[-1].silent and stack[-1].tag != tag:  # never closed
                opened[stack.pop().tag] -= 1
        if stack[-1].silent and tag not in CONTAINERS:
            continue
        if tag in BLOCKS and not stack[-1].silent:
            end_block()
            in_link = False
        elif tag in SPACES:
            held.append(" ")
        if closing:
            if tag == "a":
                in_link = False
            elif tag in ("h1", "h2"):
                heading = False
            if tag in CONTAINERS and opened[tag]:
                last = None
                while last != tag:
                    last = stack.pop().tag
                    opened[last] -= 1
            continue
        if tag == "a":
            in_link = True
        elif tag in CONTAINERS:
            heading = False
            if tag in ("li", "td", "th", "tr") and opened[tag]:
                # an item ends where the next one of the same list begins
                inner = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag)
                if not any(e.tag in ("ul", "ol", "menu", "table") for e in stack[inner + 1 :]):
                    opened.subtract(e.tag for e in stack[inner:])
                    del stack[inner:]
            if not attributes.endswith("/") or tag in ("div", "article", "section"):
                number += 1
                stack.append(_opened(tag, attributes, stack[-1], number, topics))
                opened[tag] += 1
        elif tag in BLOCKS:
            heading = tag in ("h1", "h2")
            if attributes:
                number += 1
                names, _, hidden, _ = _names(attributes)
                own_out = hidden
                own_look = number if any(map(is_surrounding, names)) else 0
    if at < len(page) and not stack[-1].silent:
        held.append(page[at:])
    end_block()
    return _settled(blocks, topics)


def _settled(blocks: list[tuple[str, str, int, bool, bool, int]], topics: dict[int, int]) -> list[tuple[str, str, int, bool, bool]]:
    """Blocks with the last word on those that only look left out.

    A part of an article whose id alone has the look is like what is around it if it is prose: a block of
    PROSE characters outside links, and no more than half in links. The largest element that looks left out
    comes back if what is shown is LITTLE beside it and in nothing that says it is an article; a form, if it
    holds more than is shown.
    """
    own = lambda b: max(0, len(b[0]) - 2 * b[2])
    if topics:
        outside, whole, prose = Counter(), Counter(), set()
        for b in blocks:
            if not b[3] and b[5] in topics:
                outside[b[5]] += own(b)
                whole[b[5]] += len(b[0])
                if own(b) >= PROSE:
                    prose.add(b[5])
        kept = {t for t in prose if 2 * outside[t] >= whole[t]}

        def look_of(look: int) -> int:
            while look in kept:
                look = topics[look]
            return look

        blocks = [(*b[:5], look_of(b[5])) for b in blocks]
    by_look: Counter[int] = Counter()
    for b in blocks:
        if not b[3] and b[5]:
            by_look[b[5]] += own(b)
    shown = sum(own(b) for b in blocks if not b[3] and not b[5])
    stated = any(not b[3] and not b[5] and any(map(_says_article, _ancestors(b[1]))) for b in blocks) if by_look else False
    back = {look for look, n in by_look.most_common(1) if not stated and (shown < LITTLE * (shown + n) or (look < 0 and shown < n))}
    return [(text, path, links, out or (look != 0 and look not in back), heading) for text, path, links, out, heading, look in blocks]


def _ancestors(path: str) -> list[str]:
    parts = path.split(">")
    return [">".join(parts[:n]) for n in range(len(parts), 0, -1)]


def best_path(blocks: list[tuple[str, str, int, bool, bool]]) -> tuple[str, int] | None:
    """The path that holds a page's article, and its characters, by the text outside links.

    Of the containers that say they are an article and hold SOME of the page, the outermost article
    element (or else the outermost at all), or one within that holds ALL_BUT of it; if none says so,
    the innermost container that holds MOST of the page.
    """
    score: Counter[str] = Counter()
    total = 0
    for text, path, links, out, _ in blocks:
        if not out and (own := len(text) - 2 * links) > 0:
            total += own
            for p in _ancestors(path):
                score[p] += own
    if not total:
        return None
    named = [p for p, s in score.items() if s >= SOME * total and _says_article(p)]
    articles = [p for p in named if p.rpartition(">")[2].split(".")[0] == "article"]
    if named:
        outer = min(articles or named, key=lambda p: (p.count(">"), -score[p], p))
        held = [p for p in named if p == outer or (p.startswith(outer + ">") and score[p] >= ALL_BUT * score[outer])]
    else:
        held = [p for p, s in score.items() if s >= MOST * total and p.rpartition(">")[2].split(".")[0] not in WITHIN]
    path = max(held, key=lambda p: (p.count(">"), score[p], p))
    return path, score[path]


def _leads(part: str, top: str) -> bool:
    """Does an element beside (or beside what is around) the text's container belong to the article? Leads and
    heads by their names do, and further article elements beside one."""
    tag, *names = part.split(".")
    words = set(names)
    return not words.isdisjoint(LEADS) or (not words.isdisjoint(HEADS) and not words.isdisjoint(ARTICLE_WORDS)) or (tag == "article" and top.rpartition(">")[2].split(".")[0] == "article")


def _belongs(path: str, top: str, around: set[str]) -> bool:
    """Is a block of this path part of the article under top? In top, in a lead beside it or beside what is
    around it, or between such parts (directly in what is around it, below body)."""
    if path == top or path.startswith(top + ">"):
        return True
    parent = path
    while parent and parent not in around:
        parent, _, part = parent.rpartition(">")
    if parent == path:
        return False
    return (parent in around or not parent) and parent != top and _leads(part, top)


def _says_article(path: str) -> bool:
    tag, *names = path.rpartition(">")[2].split(".")
    return tag in ("article", "main") or not ARTICLE_WORDS.isdisjoint(names)


def held(blocks: list[tuple[str, str, int, bool, bool]], top: str) -> int:
    """Characters outside links that are shown under a path."""
    return sum(max(0, len(text) - 2 * links) for text, path, links, out, _ in blocks if not out and (path == top or path.startswith(top + ">")))


def extract(blocks: list[tuple[str, str, int, bool, bool]], paths: list[str] | None, beside: list[str] | None = None) -> str:
    """The text of the blocks under one of a host's paths, or else under the page's own best path.

    The path of the host is the one of paths that holds most of the page (the first of equals). It gives way
    to the page's own if it holds less than ENOUGH of what that holds, unless the host knows the own path as
    one that is beside its articles. Leads beside the path belong to it (see _leads), and main headings that
    stand before it, around it.
    """
    shown = [b for b in blocks if not b[3]]
    within = lambda path, top: path == top or path.startswith(top + ">")
    of_host = [p for p in paths or () if any(within(b[1], p) for b in shown)]
    own = best_path(blocks)
    top = max(of_host, key=lambda p: (held(blocks, p), -of_host.index(p)), default=None)
    if own and (top is None or (held(blocks, top) < ENOUGH * own[1] and not any(within(own[0], p) for p in beside or ()))):
        top = own[0]
    top = top or ""
    around = set(_ancestors(top))
    first = next((i for i, b in enumerate(shown) if within(b[1], top)), 0)
    headed = any(b[4] for b in shown[first:] if within(b[1], top))
    return "\n\n".join(b[0] for i, b in enumerate(shown) if _belongs(b[1], top, around) or (i < first and b[4] and b[1] in around and not headed))


def beside_of(blocks: list[tuple[str, str, int, bool, bool]], top: str) -> set[str]:
    """The outermost containers that hold shown text beside a page's article."""
    around, out = set(_ancestors(top)), set()
    for _, path, _, hidden, _ in blocks:
        if not hidden and path not in around and not path.startswith(top + ">") and not _belongs(path, top, around):
            while (parent := path.rpartition(">")[0]) and parent not in around:
                path = parent
            out.add(path)
    return out


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths, beside: what the pages (url, html) of each host vote for, most votes first, and what
    many of them have beside their articles.

    Each page votes for its best path, with the logarithm of the text it holds, and names the containers
    that hold other text. Votes are summed in the tasks before they are dealt out, so a host with a third
    of all pages is a few rows a task. Shares are of the host's sums, joined with each host dealt over
    salted keys, so neither are the paths of a host with generated class names gathered.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                blocks = blocks_of(page)
                if found := best_path(blocks):
                    host = host_of(url)
                    mine = votes.setdefault((host, found[0]), [0, 0, 0])
                    mine[0] += round(1000 * math.log1p(found[1]))
                    mine[1] += 1
                    for path in beside_of(blocks, found[0]):
                        votes.setdefault((host, path), [0, 0, 0])[2] += 1
            if len(votes) > 100_000:
                yield _votes(votes)
                votes.clear()
        yield _votes(votes)

    counted = pages.select("url", "html").mapInArrow(vote, "host string, path string, votes long, voters long, others long")
    summed = materialize(counted.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("votes", "voters", "others"))))
    totals = summed.groupBy(F.col("host").alias("its")).agg(F.sum("votes").alias("all_votes"), F.sum("voters").alias("pages"))
    shares = join_group(summed, totals, {"host": "its"}, "path")
    layout = (F.col("votes") > 0) & (F.col("votes") >= LAYOUT * F.col("all_votes"))
    beside = (F.col("others") >= LAYOUT * F.col("pages")) & (F.col("others") > F.col("voters"))
    few = shares.withColumns({"layout": layout, "side": beside & ~layout}).filter("layout or side")
    return few.groupBy("host").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("layout"), F.struct((-F.col("votes")).alias("less"), "path")))), lambda s: s["path"]).alias("paths"),
        F.array_sort(F.collect_list(F.when(F.col("side"), F.col("path")))).alias("beside"),
    )


def _votes(votes: dict[tuple[str, str], list[int]]) -> pa.RecordBatch:
    names = [pa.array([k[i] for k in votes], pa.string()) for i in range(2)]
    return pa.RecordBatch.from_arrays([*names, *(pa.array([v[i] for v in votes.values()], pa.int64()) for i in range(3))], names=["host", "path", "votes", "voters", "others"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages (page_id, url, html).

    Null and empty pages, and pages without text, give the empty text. Pages whose url is null or
    names no host vote together. The table of paths holds at most 1 / LAYOUT paths a host, and as many
    beside them for each container that a page has beside its article; up to BROADCAST_HOSTS hosts it goes to every executor, beyond that it is joined with each
    host dealt over salted keys.
    """
    paths = materialize(host_paths(pages))
    rows = pages.select("page_id", "url", "html")
    name = F.lower(F.coalesce(F.regexp_extract("url", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = rows.withColumn("of", name)
    if paths.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(paths), rows["of"] == paths["host"], "left")
    else:
        rows = join_group(rows, paths, {"of": "host"}, "page_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(blocks_of(page), known, beside) for page, known, beside in zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "beside")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "paths", "beside").mapInArrow(read, "page_id long, url string, text string, n_chars long")
