"""Main text of web pages: what a site repeats on many pages goes first, structure decides about the rest."""

from __future__ import annotations

import html as entities
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches

#: A subtree is a template where it stands on so many different pages of its host, and on log2 of their number.
MIN_PAGES = 5
#: Templates are sent to all tasks (8 bytes each) up to so many, and joined to their pages by a shuffle beyond.
FEW_TEMPLATES = 100_000
#: Shuffle keys over which the pages of one template are spread in that join.
SALTS = 16

#: Elements without main text.
DROPPED = set(
    """head script style noscript template iframe object embed svg canvas nav footer aside form button select textarea
    input dialog menu audio video map title""".split()
)
#: Class names, ids and roles of elements without main text, alone or joined to each other and to NEUTRAL_NAMES.
DROPPED_NAMES = set(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar
    navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal newsletter subscribe
    subscription share sharing social related comment comments disqus widget pagination pager toolbar skip search login
    signup complementary contentinfo dialog alert""".split()
)
#: Name parts that tell nothing of their own: `share-buttons` shares, `share-price` does not.
NEUTRAL_NAMES = set(
    """area banner bar block bottom box btn button buttons col column container content desktop fixed form global group header
    icon icons inner item items left link links list mobile module outer panel posts primary right row secondary section
    site slot sticky text title top unit wrap wrapper""".split()
)
#: Dropped outside an article or main element; inside one they hold its own title.
OUTER = {"header", "banner", "masthead", "topbar"}
BLOCKS = set(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
    thead title tr ul br""".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements a start tag ends.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
#: Elements an implied end does not reach across.
SCOPES = {"table", "ul", "ol", "dl", "select", "div", "section", "article", "main", "aside", "nav", "body", "html", "td", "th"}
#: Elements that are looked at as templates. Paragraphs and headings of an article are its text, however often repeated.
CONTAINERS = set("div section ul ol dl table aside header footer figure details center fieldset nav form menu".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|svg|template)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden(?=[\s/>=]|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[^a-z0-9]+")


class _Element:
    __slots__ = ("article", "children", "dropped", "first", "main", "tag", "worded")

    def __init__(self, tag: str, dropped: bool, article: bool, main: bool, first: int):
        self.tag, self.dropped, self.article, self.main, self.first = tag, dropped, article, main, first
        self.children = xxhash.xxh64(tag)
        self.worded = False  # holds some text, of its own or below


class Page:
    """Pieces of text of a page that structure leaves, and all its subtrees, of the page's host."""

    def __init__(self, source: str, host: str = ""):
        self.host = xxhash.xxh64(host.encode("utf-8", "replace")).digest()
        self.pieces: list[str] = []  # blanks at block ends are pieces too
        self.kinds: list[int] = []  # 2: in an article, 1: in the main element, 0: elsewhere
        self.subtrees: list[tuple[int, int, int]] = []  # digest, first piece, piece behind the last
        stack = [_Element("", False, False, False, 0)]
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()], stack[-1])
            at = m.end()
            tag = m[3] or m[6]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCKS:
                self._text(" ", stack[-1])
            if m[2] or m[5]:
                self._end(tag, stack)
            else:
                self._start(tag, m[4] or m[7] or "", stack)
        if at < len(source):
            self._text(source[at:], stack[-1])
        while len(stack) > 1:
            self._close(stack)
        sizes = [0, 0, 0]
        for kind, piece in zip(self.kinds, self.pieces, strict=True):
            sizes[kind] += len(piece.strip())
        # articles are the text unless they are the smaller part of a main element, such as teasers below an essay
        least = 2 if sizes[2] and sizes[2] >= sizes[1] else 1 if sizes[1] else 2 if sizes[2] else max(self.kinds, default=0)
        self.used = [k >= least for k in self.kinds]

    def _text(self, text: str, inside: _Element) -> None:
        if text.strip():
            inside.worded = True
            inside.children.update(" ".join(text.split()).encode("utf-8", "replace"))
        if not inside.dropped:
            self.pieces.append(entities.unescape(text) if "&" in text else text)
            self.kinds.append(2 if inside.article else 1 if inside.main else 0)

    def _start(self, tag: str, attributes: str, stack: list[_Element]) -> None:
        ended = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            open_tag = stack[k].tag
            if open_tag in ended or (open_tag == "p" and tag in BLOCKS and tag != "br"):
                while len(stack) > k:
                    self._close(stack)
                if tag not in CLOSES:
                    break
            elif open_tag in SCOPES and open_tag not in ended:
                break
        if tag in VOID:
            return
        top = stack[-1]
        inner = top.article or top.main
        dropped = top.dropped or tag in DROPPED or (tag in OUTER and not inner)
        article, main = top.article or tag == "article", top.main or tag == "main"
        if attributes and not dropped:
            dropped = bool(_HIDDEN.search(attributes))
            for m in _NAMES.finditer(attributes):
                for name in (m[2] or m[3] or m[4] or "").lower().split():
                    if tag not in ("body", "html", "article", "main") and _tells(name, inner):
                        dropped = True
                    elif name == "main" and m[1].lower() == "role":
                        main = True
                if tag == "article" and "comment" in m.group().lower():
                    dropped = True
        stack.append(_Element(tag, dropped, article, main, len(self.pieces)))

    def _end(self, tag: str, stack: list[_Element]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                while len(stack) > k:
                    self._close(stack)
                return
            if stack[k].tag in SCOPES and tag not in SCOPES:
                return

    def _close(self, stack: list[_Element]) -> None:
        done = stack.pop()
        digest = done.children.intdigest()
        stack[-1].children.update(digest.to_bytes(8, "little"))
        stack[-1].worded |= done.worded
        if done.worded and done.tag in CONTAINERS and not (done.dropped and stack[-1].dropped):
            key = xxhash.xxh64(self.host + digest.to_bytes(8, "little")).intdigest()
            self.subtrees.append((key - (1 << 64) if key >= 1 << 63 else key, done.first, len(self.pieces)))

    def candidates(self) -> list[int]:
        """Digests of subtrees (of this host) that don't hold most of the text structure leaves."""
        sizes = [len(p.strip()) if u else 0 for p, u in zip(self.pieces, self.used, strict=True)]
        before = [0]
        for s in sizes:
            before.append(before[-1] + s)
        return sorted({d for d, a, b in self.subtrees if 2 * (before[b] - before[a]) < before[-1]})

    def text(self, templates: set[int] | frozenset[int]) -> tuple[str, int, int]:
        """The text without templates, how many stand on the page, and the characters structure would have left of them."""
        here = templates.intersection(self.candidates()) if templates else ()
        used = list(self.used)
        for digest, a, b in self.subtrees:
            if digest in here:
                used[a:b] = [False] * (b - a)
        gone = sum(len(p.strip()) for p, u, v in zip(self.pieces, self.used, used, strict=True) if u and not v)
        return " ".join("".join([p if u else " " for p, u in zip(self.pieces, used, strict=True)]).split()), len(here), gone


def _tells(name: str, inner: bool) -> bool:
    """Whether a class name, id or role marks an element without main text."""
    parts = [p for p in _PART.split(name) if p and not p.isdigit()]
    known = [p in DROPPED_NAMES or (p in OUTER and not inner) for p in parts]
    return any(known) and all(k or p in NEUTRAL_NAMES for k, p in zip(known, parts, strict=True))


def _host():
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host.alias("host")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, few: int = FEW_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_templates, n_template_chars of each row of pages (page_id, url, html).

    Site templates go first: every container element of the whole page, menus and notices included, is hashed with all it
    holds, hashes are counted per host over different pages (copies of a page count once), and what stands on `min_pages`
    pages or more, and on log2 of the host's pages or more, is deleted wherever it stands on that host. So the bar hardly
    rises with the host (5 up to 32 pages, 20 at a million), and a block of one section of a large site is a template too.
    n_templates counts the different ones of a page. Structure (tag, class, id, role) decides about what counts can't tell,
    such as a menu that differs on every page: the main text is what stands in article elements, else in the main element,
    else in the body, without menus, headers, footers, sidebars, notices, adverts, forms, code and comments.
    n_template_chars are the characters that structure alone would have left. Paragraphs and headings stay, however
    often they recur, and so does a container that holds most of a page's text.

    Hashes are counted with map-side sums by host, subtree and page first, so a large host is spread. Pages are not
    shuffled while there are `few` templates or less; beyond, each page is joined to its own.

    A null html is an empty one and gives the empty text; pages without a host in their url share the empty host. Each
    row is treated on its own, rows of one page_id or none included. Other columns are not read; an empty table gives an
    empty result.
    """
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host()).withColumn(
        "version", F.xxhash64("html")
    )

    def subtrees(batches):
        for batch in batches:
            found = [Page(h, host).candidates() for h, host in zip(batch["html"], batch["host"], strict=True)]
            yield {"host": batch["host"], "version": batch["version"], "subtrees": found}

    seen = checkpoint(map_batches(
        source.select("host", "version", "html"), subtrees, "host string, version long, subtrees array<long>"
    ))
    # a digest has its host in it
    pairs = seen.select("host", "version", F.explode("subtrees").alias("subtree")).distinct()
    sizes = seen.select("host", "version").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    shared = checkpoint((
        pairs.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
        .join(sizes, "host").filter(F.expr("pages <= shiftleft(1L, CAST(least(n, 62) AS INT))")).select("subtree")
    ))
    known = frozenset(r.subtree for r in shared.limit(few + 1).collect())
    if len(known) <= few:
        marked = source.withColumn("templates", F.lit(None).cast("array<long>"))
    else:
        known = frozenset()
        salted = pairs.withColumn("salt", F.pmod("version", F.lit(SALTS)))
        spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = salted.join(spread, ["subtree", "salt"]).groupBy("host", "version").agg(F.collect_set("subtree").alias("templates"))
        marked = source.join(hits, ["host", "version"], "left")

    def extract(batches):
        for batch in batches:
            columns = (batch["html"], batch["host"], batch["templates"])
            found = [Page(h, host).text(known or frozenset(t or ())) for h, host, t in zip(*columns, strict=True)]
            text, n, gone = zip(*found, strict=True) if found else ((), (), ())
            yield {
                "page_id": batch["page_id"], "url": batch["url"], "text": list(text), "n_templates": list(n),
                "n_template_chars": list(gone),
            }

    return map_batches(
        marked.select(F.col("page_id").cast("long"), "url", "html", "host", "templates"),
        extract,
        "page_id long, url string, text string, n_templates long, n_template_chars long",
    )
