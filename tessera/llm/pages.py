"""Main text of web pages by consensus host paths.

First pass: each page is parsed, its containers are scored (text in blocks, without links
and with a low weight in boilerplate) and the best one votes for its generalised
tag-class path. Spark sums the votes per host and path and picks each host's winner.
Second pass: the page is parsed again and the elements at its host's winning path are
extracted without the boilerplate in them; a page without such an element gives its own
best container, and one that is all boilerplate keeps it.

All of it is linear in the page: what an element passes to its ancestors is summed once per
element, children before parents, and a path is spelled out for the best container only.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpoint

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[A-Za-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg canvas select option button".split())
BOILER_TAGS = frozenset("nav header footer aside form dialog menu head".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                    "summary table tbody td tfoot th thead tr ul").split())
CONTAINERS = frozenset("article main section div td body html".split())
#: Elements that a new start tag of the second kind closes.
CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
             "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"})}
#: Words that mark what is not the article, where a whole name in a class, id or role is made of them.
BOILER_WORDS = frozenset(("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav "
                          "navigation navbar menu breadcrumb breadcrumbs sidebar side aside footer header masthead topbar "
                          "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
                          "subscription signup login share sharing social related recommended comment comments respond "
                          "disqus replies reply widget pagination pager toolbar contentinfo complementary search").split())

#: Those that mark an article or main element too.
NOT_AN_ARTICLE = frozenset("comment comments reply replies related ad ads advert promo sponsored teaser".split())
#: Those, besides them, that hold also where their element has most of the page's text.
NEVER_THE_PAGE = NOT_AN_ARTICLE | frozenset("cookie cookies consent gdpr newsletter subscribe subscription".split())
#: What text in boilerplate counts for a container.
BOILER_WEIGHT = 0.1
#: Marks of an element: none, one that does not hold for most of the page's text, and one that holds.
PLAIN, SOFT, FIRM = range(3)


#: Elements that something closes, and what closes any of them.
_CLOSERS = frozenset().union(*CLOSED_BY.values())


class Element:
    __slots__ = ("tag", "step", "parent", "mark", "held", "own", "boiler", "flow", "link", "depth", "near", "inside", "hidden")

    def __init__(self, tag: str, step: str, parent: Element | None, mark: int) -> None:
        self.tag, self.step, self.parent, self.mark = tag, step, parent, mark
        self.held = 0                                      # characters outside links in it
        self.own = self.boiler = False                     # its mark holds; or that of an element around it (``read``)
        self.flow = 0.0                                    # what its text is worth
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        # the innermost element that a start tag may close, itself or above, up to the next container
        up = None if tag in CONTAINERS or not parent else parent.near
        self.near = self if tag in CLOSED_BY and tag not in CONTAINERS else up
        self.inside = self.hidden = False                  # in the extracted element; in boilerplate within it

    @property
    def path(self) -> str:
        steps, e = [], self
        while e:
            steps.append(e.step)
            e = e.parent
        return "/".join(reversed(steps))


def _step(tag: str, attrs: str) -> tuple[str, int]:
    """The generalised path step (tag and class words, digits dropped) and the element's mark."""
    marks = BOILER_WORDS
    if tag in ("html", "body"):
        marks = frozenset()
    elif tag in ("article", "main"):
        marks = NOT_AN_ARTICLE
    classes: set[str] = set()
    mark = (SOFT if tag == "form" else FIRM) if tag in BOILER_TAGS else PLAIN
    if "=" in attrs:
        for name, *value in _ATTR.findall(attrs):
            if name.lower() not in ("class", "id", "role"):
                continue
            for token in "".join(value).lower().split():
                words = set(_WORDS.findall(token))
                if name.lower() == "class":
                    classes |= words
                if words and words <= marks:
                    mark = max(mark, FIRM if words & NEVER_THE_PAGE else SOFT)
    return ".".join([tag, *sorted(classes)]), mark


def walk(page: str) -> tuple[list[Element], list[tuple[Element, str, bool]]]:
    """(elements, parts): the elements, parents first, and (element, raw text, new block before it) for each
    stretch of text, in page order."""
    root = Element("", "", None, PLAIN)
    elements, parts = [root], []
    open_tags: dict[str, int] = {}
    top, at, fresh, end = root, 0, True, len(page)

    def close(to: Element) -> Element:
        """Up to the element ``to``, which stays open."""
        e = top
        while e is not to:
            open_tags[e.tag] -= 1
            e = e.parent
        return to
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append((top, page[at:stop], fresh))
            fresh = False
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:                                           # an end tag closes its element and all within
            if open_tags.get(tag):
                e = top
                while e.tag != tag:
                    e = e.parent
                top = close(e.parent)
            fresh = fresh or tag in BLOCKS
            continue
        if tag == "br":
            parts.append((top, " ", fresh))
            fresh = False
            continue
        if tag in RAW:                                     # skip to its end tag
            if not m[3].endswith("/"):
                found = _raw_end(tag).search(page, at)
                at = found.end() if found else end
            continue
        if tag in BLOCKS:
            fresh = True
        if tag in _CLOSERS:                                # what the start tag closes, up to the next container
            e = top.near
            while e:
                if tag in CLOSED_BY[e.tag]:
                    top = close(e.parent)
                    if e.tag == "p":
                        break
                e = e.parent.near
        if tag not in VOID and not m[3].endswith("/"):
            step, mark = _step(tag, m[3])
            top = Element(tag, step, top, mark)
            elements.append(top)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return elements, parts


@lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def read(page: str) -> tuple[list[Element], list[tuple[Element, str, bool]]]:
    """What ``walk`` gives, with the elements' boilerplate decided: a soft mark does not hold for
    an element with most of the page's text."""
    elements, parts = walk(page)
    total = 0
    for e, raw, _ in parts:
        if not e.link:
            n = len(raw.strip())
            e.held += n
            total += n
    for e in reversed(elements[1:]):
        e.parent.held += e.held
    for e in elements:
        e.own = e.mark == FIRM or e.mark == SOFT and 2 * e.held <= total
        e.boiler = e.own or bool(e.parent and e.parent.boiler)
    return elements, parts


def best_path(page: str) -> str | None:
    """The path of the page's best container: the text of its blocks outside links, little of
    it in boilerplate, where a block gives its all to the nearest container and less the
    farther up; ties go to the deeper one, then the first. None if the page has no text."""
    elements, parts = read(page)
    for e, raw, _ in parts:
        if not e.link:
            e.flow += len(raw.strip()) * (BOILER_WEIGHT if e.boiler else 1.0)
    best, most = None, (0.0, 0)
    for e in reversed(elements):
        passed = e.flow
        if passed and (e.tag in CONTAINERS or not e.parent):     # the page itself is the outermost container
            score = (round(passed * (1.1 if e.tag in ("article", "main") else 1.0), 6), e.depth)
            if score >= most:
                best, most = e, score
            passed *= 0.9
        if e.parent:
            e.parent.flow += passed
    return best.path if best else None


def extract(page: str, path: str | None, keep: bool = False) -> str:
    """The text of the elements at ``path``, without boilerplate inside them unless ``keep``: character
    references decoded, white space within a block one space, blocks joined by newlines."""
    if path is None:
        return ""
    steps = path.split("/")[1:]
    elements, parts = read(page)
    along = {id(elements[0])}                              # elements whose own path begins ``path``
    for e in elements:
        up = e.parent
        if up and id(up) in along and e.depth <= len(steps) and e.step == steps[e.depth - 1]:
            along.add(id(e))
        here = e.depth == len(steps) and id(e) in along
        e.inside = here or bool(up and up.inside)
        e.hidden = not here and e.inside and (e.own or up.hidden)
    blocks: list[list[str]] = []
    open_block = False
    for e, raw, fresh in parts:
        if fresh:
            open_block = False
        if not e.inside or (e.hidden and not keep):
            continue
        if not open_block:
            blocks.append([])
            open_block = True
        blocks[-1].append(html.unescape(raw) if "&" in raw else raw)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL ('' if it has none)."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: Host tables (a host name and a path each) up to this many bytes may be broadcast.
MAX_BROADCAST_BYTES = 16 << 20


def host_paths(df: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes, pages): each host's winning path; ties go to the smaller path."""
    src = df.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    voted = arrow_map(src, lambda b: pa.RecordBatch.from_arrays(
        [b.column("host"), pa.array([best_path(x) if x else None for x in b.column("html").to_pylist()], pa.string())],
        names=["host", "path"]), "host string, path string")
    votes = voted.where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    first = F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), F.col("path")))
    return votes.groupBy("host").agg(first.alias("w"), F.sum("votes").alias("pages")).select("host", "w.path", "w.votes", "pages")


def extract_pages(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. A null or empty page has no text; a null
    url has the host ''; repeated rows are extracted each; other columns are ignored. Time and memory
    are linear in a page, however deep its elements lie."""
    winners = checkpoint(host_paths(df, url_col=url_col, html_col=html_col).select("host", "path"))
    size = winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0))).first()[0]
    small = size <= MAX_BROADCAST_BYTES
    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                    F.col(f"`{html_col}`").alias("html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    joined = src.join(F.broadcast(winners) if small else winners, "host", "left").select("page_id", "url", "html", "path")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist()):
            text = extract(page or "", path)
            if not text:
                own = best_path(page or "")
                text = extract(page or "", own) or extract(page or "", own, keep=True)
            out.append(text)
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()),
                                           pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return arrow_map(joined, run, "page_id long, url string, text string, n_chars long")
