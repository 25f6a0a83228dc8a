"""Main-text extraction by consensus host paths.

Every page's containers are scored by how much of the page's own prose they
hold; each container votes for its generalised path of tags and classes, and
the votes of a host are summed. Pages are then extracted again below the path
that won at their host. Where that path is missing, or holds less than nearly
all of what the page's own best container has, that container is taken too,
so that a page whose layout differs from its host's loses nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.llm.common import cut, small, table

#: Hosts' winning paths are broadcast up to so many hosts, and joined by a shuffle beyond.
BROADCAST_HOSTS = 200_000
#: A host's path stands alone on pages where it holds this share of the best container's prose.
LEAST_COVERAGE = 0.9
#: Containers below this share of a page's prose don't vote.
VOTE_COVERAGE = 0.3

# Elements and name parts by their role on a page.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noframes", "select", "audio", "video")
#: Containers inside more than so many others count as part of the last: browsers end there too.
MOST_DEPTH = 512
CONTAINERS = frozenset("html body div article main section aside nav header footer form ul ol dl table tbody thead tr td th fieldset dialog figure details center menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr address figcaption caption tfoot legend summary hgroup option head".split())
EXCLUDED_TAGS = frozenset("nav aside footer form header dialog menu button select label fieldset head".split())
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
EXCLUDED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promoted promotion banner "
    "nav navbar navigation menu menus submenu topnav subnav breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside rail footer header masthead topbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login register "
    "share sharing social comment comments commentlist disqus reply replies respond responses discussion related recommended recommendations widget widgets form forms search toolbar skip".split()
)
PROSE_NAMES = frozenset("article content post entry story main body text page maintext bodytext articlebody".split())
NEVER_EXCLUDED = frozenset(("html", "body", "main"))
NEGATORS = frozenset(("has", "no", "with", "without", "not", "hide", "show", "category", "tag", "type", "status", "format"))
SMALL_ARTICLES = frozenset("comment comments reply ad ads advert advertisement sponsored promo related recommended".split())
ITEMS = frozenset("li dd dt blockquote pre figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<empty>svg|select|audio|video|template|iframe|noscript)(?![\w:-])(?:[^<>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+/>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?![\w:-])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+[^>]*+(?:>.*?(?:</(?P=raw)(?![\w:-])[^<>]*>?|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>|<[/!?][^>]*(?:>|\Z)|<(?P<odd>/?)(?P<oddtag>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def beside(name: str, parts: list[str]) -> bool:
    """Whether a name stands for something other than the article.

    Any part tells, unless a part also names prose: then the first and the
    last do (comment-body and page-header, but not post-with-comments), save
    for an article's own header.
    """
    if not NEGATORS.isdisjoint(parts):
        return False
    if name in EXCLUDED_NAMES:
        return True
    if PROSE_NAMES.isdisjoint(parts):
        return not EXCLUDED_NAMES.isdisjoint(parts)
    if parts[-1] == "header" and parts[0] in ("article", "post", "entry", "story"):
        return False
    return parts[0] in EXCLUDED_NAMES or parts[-1] in EXCLUDED_NAMES


class Page:
    """Containers and text blocks of a page, in page order."""

    def __init__(self, source: str):
        self.parent, self.name, self.weight, self.depth = [-1], [""], [0.2], [0]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, excluded
        opened: dict[str, int] = {}  # how often each tag is in the stack
        buffer: list[str] = []
        linked = in_link = 0
        skipped = False  # the block that is open stands beside the article
        blocks = self.blocks

        def end_block() -> None:
            nonlocal linked, skipped
            if buffer:
                if not (skipped or stack[-1][2]):
                    text = " ".join(html.unescape("".join(buffer)).split())
                    if text:
                        blocks.append((stack[-1][1], text, linked))
                buffer.clear()
            linked, skipped = 0, False

        def open_one(tag: str, container: int, excluded: bool) -> None:
            stack.append((tag, container, excluded))
            opened[tag] = opened.get(tag, 0) + 1

        def close_to(tag: str) -> None:
            while opened.get(tag):
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    return

        for token in _TOKEN.finditer(source):
            kind = token.lastgroup
            if kind == "text":
                text = token["text"]
                if in_link:
                    linked += len(text)
                buffer.append(text)
                continue
            if kind in ("raw", "empty", None):
                continue
            tag, closing = (token["tag"], token["close"]) if token["tag"] else (token["oddtag"], token["odd"])
            tag = tag.lower()
            if tag not in BLOCKS:
                if tag == "a":
                    in_link = 0 if closing else 1
                elif tag in ("br", "img", "input"):
                    buffer.append(" ")
                elif tag == "button":
                    if not closing:
                        end_block()
                        open_one(tag, stack[-1][1], True)
                    elif opened.get(tag):
                        end_block()
                        close_to(tag)
                elif tag == "label" and closing:
                    buffer.append(" ")
                continue
            end_block()
            if tag in ITEMS and not closing and stack[-1][0] == tag:
                close_to(tag)
            if tag not in CONTAINERS and not (closing and stack[-1][0] == tag):
                in_link = 0
                if not closing and token["attributes"] and self._names(token["attributes"], tag)[1]:
                    if tag in ITEMS:
                        open_one(tag, stack[-1][1], True)
                    else:
                        skipped = True
                continue
            if closing:
                close_to(tag)
                in_link = 0
                continue
            _, outer, excluded = stack[-1]
            prose, aside, generalised = self._names(token["attributes"] or "", tag)
            if not excluded and tag == "article":
                excluded = not SMALL_ARTICLES.isdisjoint(re.findall(r"(?:^|[\s\"'=])([a-z]+)", (token["attributes"] or "").lower())) and aside
            elif not excluded and tag not in NEVER_EXCLUDED:
                inside = opened.get("article") or opened.get("main")
                excluded = aside or tag in EXCLUDED_TAGS and not (tag == "header" and inside)
            if self.depth[outer] >= MOST_DEPTH:
                open_one(tag, outer, excluded)
                continue
            self.parent.append(outer)
            self.name.append(f"/{tag}{generalised}")
            self.depth.append(self.depth[outer] + 1)
            self.weight.append(1.0 if tag == "article" else 0.95 if tag == "main" else 0.4 if tag == "html" else 0.5 if tag == "body" else 0.9 if prose else 0.6)
            open_one(tag, len(self.parent) - 1, excluded)
        end_block()

    @staticmethod
    def _names(attributes: str, tag: str = "div") -> tuple[bool, bool, str]:
        """Whether class, id or role name prose, whether they name something beside it, and the classes with digits generalised.

        Ids of sections are made from headings, so only a whole one tells, and
        those of headings and paragraphs don't tell. Classes of these tell if
        they have no part that names nothing beside the article.
        """
        prose = aside = False
        classes: list[str] = []
        for what, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            if what.lower() == "role":
                aside |= value.strip().lower() in EXCLUDED_ROLES
                continue
            for name in value.split():
                parts = [x.lower() for x in _PARTS.findall(name)]
                prose |= not PROSE_NAMES.isdisjoint(parts)
                if tag in CONTAINERS and not (tag == "section" and what.lower() == "id"):
                    aside |= beside(name.lower(), parts)
                elif tag in CONTAINERS:
                    aside |= name.lower() in EXCLUDED_NAMES
                elif what.lower() == "class":
                    aside |= name.lower() in EXCLUDED_NAMES or bool(parts) and EXCLUDED_NAMES.issuperset(parts)
                if what.lower() == "class":
                    classes.append(_DIGITS.sub("#", name.lower()))
        return prose, aside, "".join("." + c for c in sorted(set(classes)))

    def path(self, container: int) -> str:
        names = []
        while container > 0:
            names.append(self.name[container])
            container = self.parent[container]
        return "".join(reversed(names))

    def scores(self) -> tuple[list[float], list[float]]:
        """Of each container: score and share of the page's prose. Text inside links is no prose."""
        prose = [0.0] * len(self.parent)
        for container, text, linked in self.blocks:
            prose[container] += max(0, len(text) - 2 * linked)
        for k in range(len(prose) - 1, 0, -1):  # parents come first
            prose[self.parent[k]] += prose[k]
        whole = prose[0] or 1.0
        share = [p / whole for p in prose]
        return [s * w for s, w in zip(share, self.weight, strict=True)], share

    def votes(self) -> dict[str, float]:
        scores, share = self.scores()
        out: dict[str, float] = {}
        for k in range(1, len(share)):
            if share[k] >= VOTE_COVERAGE:
                path = self.path(k)
                out[path] = out.get(path, 0.0) + scores[k]
        return out

    def _inside(self, chosen: set[int]) -> list[bool]:
        inside = [False] * len(self.parent)
        for k in range(len(inside)):
            inside[k] = k in chosen or k > 0 and inside[self.parent[k]]
        return inside

    def text(self, path: str | None = None) -> str:
        """Blocks below the containers of that path, and below the best one if they don't hold nearly all of its prose.

        Of containers that score alike the innermost is the best.
        """
        scores, _ = self.scores()
        best = self._inside({max(range(len(scores)), key=lambda k: (round(scores[k], 9), self.depth[k], -k))})
        inside = self._inside({k for k in range(1, len(self.name)) if path and path.endswith(self.name[k]) and self.path(k) == path})
        held = whole = 0
        for container, text, linked in self.blocks:
            if best[container]:
                whole += max(0, len(text) - 2 * linked)
                held += max(0, len(text) - 2 * linked) * inside[container]
        if not any(inside) or held < LEAST_COVERAGE * whole:
            inside = [a or b for a, b in zip(inside, best, strict=True)]
        return "\n".join(text for container, text, _ in self.blocks if inside[container])


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_votes(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes, pages): what each host's pages vote for. Tasks sum their pages' votes before they send them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], list[float]] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                for path, vote in Page(source.as_py() or "").votes().items():
                    entry = sums.setdefault((host, path), [0.0, 0])
                    entry[0] += vote
                    entry[1] += 1
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([v[0] for v in sums.values()], pa.float64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["host", "path", "votes", "pages"])

    rows = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html"))
    votes = rows.mapInArrow(part, "host string, path string, votes double, pages bigint")
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))


def winners(votes: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes at each host, of equal ones the first in code-point order."""
    best = F.max_by("path", F.struct(F.round("votes", 6), -F.length("path"), F.col("path")))
    return votes.groupBy("host").agg(best.alias("path"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (page_id, url, text, n_chars) for every row.

    Blocks are joined by line feeds; white space inside one is a single space.
    Null and empty pages: empty text. Pages without a host form a host of
    their own. Repeated rows vote and are extracted each. Of paths with equal
    votes the shortest wins, then the last in code-point order. Pages are read
    once from end to end, whatever their length and however broken their
    markup. Other columns are left out. Empty table: no rows.
    """
    won = cut(winners(host_votes(pages, url_col=url_col, html_col=html_col)))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col).alias("host"))
    rows = rows.join(small(won, BROADCAST_HOSTS), "host", "left").drop("host")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            texts = [Page(source.as_py() or "").text(path) for source, path in zip(batch.column("html"), paths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(part, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op2_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
