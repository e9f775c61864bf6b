"""Main text of web pages by consensus paths: pages of a host agree on where its articles stand.

1. Each page's containers are scored by the text of their blocks (a block counts for its container, and half for the
   container above), links and boilerplate aside; the best one gives its page's vote for a generalised path of tags
   and classes (digits removed, class names sorted).
2. Votes are summed per (host, path); the paths with a hundredth of their host's votes or more stay (``SHARE``).
3. Each page is read again: its text is that of the elements on the leading path that it has; a page with none of
   them uses its own best container. From there it rises to the article around it, or to an ancestor whose other
   blocks are text too, so that headings, leads and parts beside the container stay.

Boilerplate inside them (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) is
left out by tag, by role, and for wrappers by class or id word; an id marks a wrapper only as a whole, and no section of
an article. An article's own header stays, as it holds the title; so do captions, formulas and the text of drawings and embedded objects. Blocks are joined by a line feed; white space inside a block is one space;
``<br>`` counts as white space.

Defined results: a null or empty page has an empty text; a null url has the empty host; markup that isn't closed ends
with the page; repeated pages keep a row each; ties between containers go to the first on the page, between paths to
the one with more text, then the first in order; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_BYTES, stage
from factloom.llm.url_cascade import host_of

#: A path counts for a host if one in so many of its pages votes for it.
SHARE = 100
_CONTAINERS = frozenset("article main section div td body center blockquote".split())
_BLOCKS = _CONTAINERS | frozenset(
    "html p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr th caption pre figure figcaption hr address details summary "
    "fieldset nav aside header footer form dialog".split()
)
_DROPPED_TAGS = frozenset("nav aside header footer form dialog head button select option menu".split())
_RAW = "script|style|textarea|title|noscript|template|iframe|select|button"
#: Words of a class or id that mark boilerplate.
_DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer form header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promos "
    "promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar topbar widget".split()
)
#: Words that may stand beside those in a class name; with any other word the name is one of content.
_LAYOUT_WORDS = frozenset(
    "site page main global top bottom left right inner outer list box bar area block wrap wrapper container content section group item items row "
    "links link buttons button icons post posts article articles entry".split()
)
#: Blocks that a class or id word can mark; headings, paragraphs and list items are content whatever their names.
_WRAPPERS = frozenset("div section center td ul ol dl table fieldset details".split())
_VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
#: What an opening tag closes first.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b.*?(?:</\1\s*+[^>]*+>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|</\Z|<\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_WORD = re.compile(r"[a-z]+")


class _Open:
    """An open element. path: the number of its generalised path on the page; holder: the nearest container, itself
    included; inside: whether it is an article or main, or lies in one."""

    __slots__ = ("above", "dropped", "holder", "inside", "path", "score", "tag")

    def __init__(self, tag: str, path: int, above: _Open | None, dropped: bool) -> None:
        self.tag, self.path, self.above, self.score = tag, path, above, 0
        self.dropped = dropped or bool(above and above.dropped)
        self.inside = tag in ("article", "main") or bool(above and above.inside)
        self.holder = self if tag in _CONTAINERS else above.holder if above else None


def _marked(kind: str, value: str, inside: bool) -> bool:
    """Whether a class or id says boilerplate: as a whole name, or for a class beside words of layout only.

    inside: whether it stands in an article, whose own header holds its title.
    """
    for name in value.split():
        words = [w for w in _WORD.findall(name) if not (inside and w == "header")]
        if not _DROPPED_WORDS.isdisjoint(words) and (len(words) == 1 or (kind == "class" and all(w in _DROPPED_WORDS or w in _LAYOUT_WORDS for w in words))):
            return True
    return False


def _step(tag: str, rest: str, inside: bool) -> tuple[str, bool]:
    """The generalised step of an opening tag, and whether it is boilerplate; inside: whether it lies in an article."""
    names: list[str] = []
    dropped = tag in _DROPPED_TAGS and not (inside and tag == "header")
    for kind, *values in _ATTRIBUTE.findall(rest) if rest else ():
        value, kind = "".join(values).lower(), kind.lower()
        if kind in ("class", "id"):
            if tag in _WRAPPERS and not (kind == "id" and tag == "section" and inside):
                dropped = dropped or _marked(kind, value, inside)
            if kind == "class":
                names = sorted({re.sub(r"\d+", "", x) for x in value.split()})
        elif kind == "role":
            dropped = dropped or value in ("navigation", "banner", "contentinfo", "complementary", "search", "form")
    return ".".join([tag, *names]), dropped


class Page:
    """A page's blocks, and its generalised paths as numbers, each with the number of the path above (0: none).

    Memory is linear in the page, whatever the depth: a path is one step beyond another, and a block knows its innermost
    element only. Numbers above are smaller, so what holds for a path's ancestors follows in one run over all paths.
    """

    def __init__(self, page: str, paths: list[str] = ()) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.above, self.steps = [0], [""]
        #: Numbers of the given paths, in their order.
        self.given = []
        for path in paths:
            at = 0
            for step in path.split(">"):
                at = self._path(at, step)
            self.given.append(at)
        #: (text, characters of it inside links, path, whether it is a title) of each block that is no boilerplate.
        self.held: list[tuple[str, int, int, bool]] = []
        #: Containers with text in the order in which they got some.
        self.scored: list[_Open] = []
        self._read(page)

    def _path(self, above: int, step: str) -> int:
        at = self.number.setdefault((above, step), len(self.above))
        if at == len(self.above):
            self.above.append(above)
            self.steps.append(step)
        return at

    def name(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.steps[path])
            path = self.above[path]
        return ">".join(reversed(steps))

    def tag(self, path: int) -> str:
        return self.steps[path].partition(".")[0]

    def _keep(self, parts: list[str], linked: int, inner: _Open | None) -> None:
        text = " ".join("".join(parts).split())
        if not text or (inner and inner.dropped):
            return
        linked = min(linked, len(text))
        self.held.append((text, linked, inner.path if inner else 0, bool(inner and inner.tag == "h1")))
        # A block counts for its container, and half for the one above.
        weight, holder = max(0, len(text) - 2 * linked) * 2, inner and inner.holder
        for _ in range(2):
            if not holder:
                break
            if not holder.score:
                self.scored.append(holder)
            holder.score += weight
            weight >>= 1
            holder = holder.above and holder.above.holder

    def _read(self, page: str) -> None:
        inner: _Open | None = None
        #: Open elements by tag, to find what an end tag closes without a walk.
        open_tags: dict[str, int] = {}
        parts: list[str] = []
        in_link = linked = at = 0

        def close() -> None:
            nonlocal inner
            open_tags[inner.tag] -= 1
            inner = inner.above

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                piece = html.unescape(page[at : m.start()])
                parts.append(piece)
                if in_link:
                    linked += len(piece)
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in _BLOCKS:
                if tag == "br":
                    parts.append(" ")
                elif tag == "a":
                    in_link = 0 if m[2] else 1
                continue
            self._keep(parts, linked, inner)
            parts.clear()
            linked = 0
            if m[2]:
                if open_tags.get(tag):
                    while inner.tag != tag:
                        close()
                    close()
                continue
            while inner and inner.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (inner.tag == "p" or tag[0] == "h"):
                close()
            while inner and inner.tag in _CLOSES.get(tag, ()):
                close()
            if tag in _VOID:
                continue
            step, dropped = _step(tag, m[4], bool(inner and inner.inside))
            inner = _Open(tag, self._path(inner.path if inner else 0, step), inner, dropped)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        if at < len(page):
            parts.append(html.unescape(page[at:]))
        self._keep(parts, linked, inner)

    def best(self) -> _Open | None:
        """The best container: that of the highest score, the first of those alike."""
        return max(self.scored, key=lambda e: e.score, default=None)

    def first_given(self) -> int:
        """The first of the given paths with a block under it, else 0."""
        rank = {p: k for k, p in reversed([*enumerate(self.given)])}
        least = [len(self.given)] * len(self.above)
        for path in range(1, len(least)):
            least[path] = min(least[self.above[path]], rank.get(path, least[0]))
        k = min((least[path] for _, _, path, _ in self.held), default=least[0])
        return self.given[k] if k < least[0] else 0

    def rise(self, path: int) -> int:
        """The path of the ancestor that holds the whole text of which the elements on ``path`` are a part, else ``path``.

        That is the nearest article; without one, containers up to main or body while all they add is text outside
        links. Body is risen to only for a title (h1) that the elements lack, as unmarked sidebars stand there too.
        """
        chain = [path]
        while chain[-1]:
            chain.append(self.above[chain[-1]])
        chain.pop()
        article = next((p for p in chain if self.tag(p) == "article"), None)
        if article is not None:
            return article
        # Where each path joins the chain; beyond its end if nowhere.
        place = {p: k for k, p in enumerate(chain)}
        joins = [len(chain)] * len(self.above)
        for p in range(1, len(joins)):
            joins[p] = place.get(p, joins[self.above[p]])
        by_place: list[list[tuple[str, int, int, bool]]] = [[] for _ in range(len(chain) + 1)]
        for block in self.held:
            by_place[joins[block[2]]].append(block)
        if self.tag(path) == "main":
            return path
        titled = any(b[3] for b in by_place[0])
        added: list[tuple[str, int, int, bool]] = []
        for k, p in enumerate(chain[1:], 1):
            added += by_place[k]
            tag = self.tag(p)
            if tag not in _CONTAINERS:
                continue
            if any(2 * linked > len(text) for text, linked, _, _ in added):
                break
            lacking = any(b[3] for b in added)
            if tag == "body" and (titled or not lacking):
                break
            if added:
                path, titled, added = p, titled or lacking, []
            if tag == "main":
                break
        return path

    def under(self, path: int) -> list[str]:
        """The texts of the blocks under a path; of all for 0."""
        inside = [path == 0] * len(self.above)
        for p in range(1, len(inside)):
            inside[p] = p == path or inside[self.above[p]]
        return [text for text, _, p, _ in self.held if inside[p]]


def best_container(page: str) -> tuple[str, int]:
    """(path, score) of the page's best container; an empty path if it has no text."""
    read = Page(page)
    best = read.best()
    return (read.name(best.path), best.score) if best else ("", 0)


def extract(page: str, paths: list[str]) -> str:
    """The text around the elements on the first of the paths that holds any, else around the page's best container."""
    read = Page(page, paths)
    path = read.first_given()
    if not path:
        best = read.best()
        path = best.path if best else 0
    return "\n".join(read.under(read.rise(path) if path else 0))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            path, score = best_container(page or "")
            if path:
                hosts.append(host)
                paths.append(path)
                scores.append(score)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], names=["host", "path", "score"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page or "", paths or []) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, paths): the paths of each host with at least 1 / ``SHARE`` of its votes, best first."""
    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("html")).mapInArrow(_vote, "host string, path string, score long")
    counted = stage(votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score")), "votes")
    totals = counted.groupBy("host").agg(F.sum("votes").alias("total")).withColumnRenamed("host", "t_host")
    leading = counted.join(totals, F.col("host") == F.col("t_host")).filter(SHARE * F.col("votes") >= F.col("total"))
    # At most SHARE paths of a host are left.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    return leading.groupBy("host").agg(ranked.alias("p")).select("host", F.transform("p", lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    paths = stage(host_paths(pages, url, page), "paths").withColumnRenamed("host", "p_host")
    size = paths.agg(F.sum(F.length("p_host") + F.length(F.array_join("paths", "")) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        paths = F.broadcast(paths)
    picked = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    joined = picked.join(paths, host_of(F.col("url")) == F.col("p_host"), "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(_read, "page_id long, url string, text string, n_chars long")
