"""Main text of raw pages, from their structure and from suffix arrays over the token streams of each host.

A page is cut into blocks.  Elements that name their purpose (menus, adverts, forms, ...) go, unless they are the article or hold most
of the page's text; where a page has an article or main element, what lies outside goes too.  The streams of all blocks
that are left are concatenated host by host: one suffix array for a host, in which suffixes with a common beginning of RUN tokens
are neighbours.  Long substrings that a SHARE of the host's distinct pages hold (LEAST_PAGES at least) are its boilerplate.
From articles the blocks that such runs cover whole are removed, unless that is most of the article; from pages without an article or main
element all covered runs go, unless that is the whole page.  The other runs stay.

A run of at least RUN tokens is covered exactly by its windows of RUN tokens, and each such window is a run.  So a host with more than
ARRAY_PAGES pages, which may be most of them, is dealt over several arrays by the text of its pages.  A window that reaches the share among
all its pages reaches it in some array; such windows are counted in all arrays of the host, which gives what one array would
give.  At most 1 / SHARE windows for each token of an average page can reach the share, so what goes back to the arrays is
small.  Pages of a host with equal text count once.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bare, mix, partitions, span_hashes, stored, word_bounds

#: Tokens of the shortest run that counts as repeated.
RUN = 8
#: Share of a host's distinct pages that hold a repeated run, and such pages at least.
SHARE, LEAST_PAGES = 0.5, 3
#: Pages in one suffix array.
ARRAY_PAGES = 2000
#: Hashes of texts that a task remembers (100 bytes each) to pass equal ones on once.
SEEN = 200_000
#: Large hosts up to which their numbers (16 bytes each) are broadcast.
BROADCAST_HOSTS = 1_000_000
#: Share of a page's text up to which a named element, and of an article's up to which repeated blocks are taken for boilerplate.
MOST = 0.5

# Elements by their part in a page, and names that classes, ids and roles give to what isn't the article.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROPPED = {"head", "script", "style", "nav", "footer", "aside", "noscript", "template", "iframe", "svg", "button", "select", "option", "dialog", "menu", "object", "canvas", "audio", "video", "textarea", "input", "map", "annotation", "annotation-xml", "title"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form", "note", "status"}
_PURPOSES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "newsletter", "subscribe", "signup", "popup", "modal", "overlay", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "comment", "comments", "replies", "disqus", "respond", "share", "sharing", "social", "related", "recommended", "recommendations", "footer", "masthead", "toolbar", "pagination", "pager", "widget", "widgets", "login", "search", "copyright", "disclaimer"}
_PARTS = {"area", "author", "banner", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "count", "entry", "form", "header", "item", "items", "left", "link", "links", "list", "message", "messages", "meta", "modal", "notice", "overlay", "popup", "right", "section", "slot", "text", "thread", "title", "top", "unit", "widget", "wrap", "wrapper"}
_LAST = {"comment", "comments", "replies", "responses", "sidebar", "nav", "navigation", "menu", "footer", "breadcrumbs", "ad", "ads", "banner", "newsletter", "cookies"}
_OWNERS = {"article", "author", "blog", "entry", "guest", "left", "main", "page", "post", "reader", "readers", "right", "side", "site", "story", "top", "user", "users", "visitor", "visitors"}
_NEVER = {"comment", "comments", "replies", "responses", "disqus", "respond", "sidebar", "nav", "navbar", "navigation", "menu", "footer", "breadcrumb", "breadcrumbs", "pagination", "cookie", "cookies", "consent", "gdpr"}
_WHOLE_NAMES = {"site-header", "site-footer", "site-nav", "page-header", "page-footer", "main-nav", "main-menu", "top-nav", "top-bar", "skip-link", "side-bar", "newsletter-signup", "related-posts", "related-articles", "related-stories", "comment-respond", "adsbygoogle", "adbox", "cookie-consent"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)

KEPT, OPEN, OUTSIDE = 0, 1, 2


def names_purpose(name: str) -> str | None:
    """The purpose that a whole class name or id names: alone, with a part of a page (`ad-slot`, `comments_list-2`) or with an owner (`user-comments`)."""
    name = re.sub(r"[-_]?\d+$", "", name.lower()).replace("_", "-")
    if name in _WHOLE_NAMES:
        return name
    first, *rest = name.split("-")
    if first in _PURPOSES and all(x in _PARTS for x in rest):
        return first
    if rest and rest[-1] in _LAST and all(x in _OWNERS or x in _PURPOSES for x in (first, *rest[:-1])):
        return rest[-1]
    return None


def _is_dropped(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the element goes by what it is."""
    if tag in _DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes.strip() or tag in ("html", "body", "main"):
        return False
    named = _attributes(attributes)
    return "hidden" in named or named.get("aria-hidden") == "true" or bool(_UNSEEN.search(named.get("style", "")))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


#: How an element goes that isn't dropped for what it is: by a name, by a name of what is never the article, or as a form.
WEAK, STRONG, FORM = 0, 1, 2


def _kind(tag: str, attributes: str) -> int | None:
    """Whether and how the element goes by its name, if the page's text allows it."""
    if tag == "form":
        return FORM
    if not attributes.strip() or tag in ("html", "body", "main"):
        return None
    named = _attributes(attributes)
    purposes = [p for k in ("class", "id") for x in named.get(k, "").split() if (p := names_purpose(x))]
    if any(p in _NEVER for p in purposes):
        return STRONG
    return WEAK if purposes or named.get("role", "").lower() in _ROLES else None


def _gone_by_name(out: list, kinds: list[int], with_main: list[bool], with_text: list[bool]) -> set[int]:
    """Numbers of the named elements that go.

    One of a strong name stays if it holds the main part or nothing else has text; of the others one that holds most of the
    text that is left, and a form only with paragraphs, an article or the main part in it.
    """
    strong = {k for k, kind in enumerate(kinds) if kind == STRONG and not with_main[k]}
    if not any(not d and not strong.intersection(names) for d, names, *_ in out):
        strong = set()
    held, total = [0] * len(kinds), 0
    for d, names, _, _, t in out:
        if not d and not strong.intersection(names):
            total += len(t)
            for k in names:
                held[k] += len(t)
    gone = set(strong)
    for k, kind in enumerate(kinds):
        if kind != STRONG and (held[k] <= MOST * total or (kind == FORM and not with_text[k])):
            gone.add(k)
    return gone


def blocks(page: str) -> list[tuple[int, str]]:
    """(part, text) of the blocks in page order: KEPT is the article, OPEN may be, OUTSIDE isn't.  Text is decoded, white space single.

    The article is the main part, if articles hold no more than MOST of it; else the article with most text, and others at least MOST as long.
    """
    out: list[tuple[bool, tuple[int, ...], int, bool, str]] = []
    buffer: list[str] = []
    stack: list[str] = []
    roles: list[bool] = []  # of the elements in stack: whether it is the main part
    named: list[tuple[int, int]] = []  # of the elements in stack that go by their names: (depth, number)
    kinds: list[int] = []  # of all such elements
    with_main: list[bool] = []
    with_text: list[bool] = []
    drop_from = None  # depth of the outermost dropped element
    article = main = n_articles = 0
    at, n = 0, len(page)

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((drop_from is not None, tuple(k for _, k in named), n_articles if article else 0, main > 0, text))

    def cut(depth: int):
        nonlocal drop_from, article, main
        article -= stack[depth:].count("article")
        main -= sum(roles[depth:])
        del stack[depth:], roles[depth:]
        while named and named[-1][0] >= depth:
            named.pop()
        if drop_from is not None and depth <= drop_from:
            drop_from = None

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCKS or tag in _DROPPED:
                flush()
            if tag in stack:
                cut(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag == "br":
            buffer.append("\n")
            continue
        dropped, kind = _is_dropped(tag, m[3], article > 0), _kind(tag, m[3])
        if tag in _BLOCKS or dropped or kind is not None:
            flush()
        if tag in _BLOCKS and "p" in stack:
            p = len(stack) - 1 - stack[::-1].index("p")
            if not any(x in _BLOCKS for x in stack[p + 1 :]):
                cut(p)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1] == tag:
            cut(len(stack) - 1)
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(tag)
        roles.append(tag == "main" or bool(_MAIN_ROLE.search(m[3])))
        n_articles += tag == "article" and not article  # an article within another is part of it
        article += tag == "article"
        main += roles[-1]
        for _, k in named:
            with_main[k] |= roles[-1]
            with_text[k] |= roles[-1] or tag in ("p", "article")
        if kind is not None:
            named.append((len(stack) - 1, len(kinds)))
            kinds.append(kind)
            with_main.append(roles[-1])
            with_text.append(roles[-1])
        if dropped and drop_from is None:
            drop_from = len(stack) - 1
    flush()
    gone = _gone_by_name(out, kinds, with_main, with_text)
    left = [(not d and gone.isdisjoint(names), a, m, t) for d, names, a, m, t in out]
    in_article: dict[int, int] = {}
    for ok, a, _, t in left:
        if ok and a:
            in_article[a] = in_article.get(a, 0) + len(t)
    in_main = sum(len(t) for ok, _, m, t in left if ok and m)
    by_main = in_main and sum(len(t) for ok, a, m, t in left if ok and m and a) <= MOST * in_main
    articles = {a for a, size in in_article.items() if size >= MOST * max(in_article.values())}

    def part(ok: bool, a: int, m: bool) -> int:
        if not ok or (by_main and not m) or (not by_main and articles and a not in articles):
            return OUTSIDE
        return KEPT if by_main or articles else OPEN

    return [(part(ok, a, m), t) for ok, a, m, t in left]


# -- suffix array -------------------------------------------------------------------------------------------------


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array down to `depth` tokens, by prefix doubling: (places in order, rank of each place).

    Suffixes with equal first `depth` tokens have one rank (their common prefix is at least so long) and stand in the order of place.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    done = 1
    while done < depth:
        step = min(done, depth - done)
        later = np.zeros(len(rank), np.int64)
        later[: len(rank) - step] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 2) + later, return_inverse=True)
        done += step
    return np.argsort(rank, kind="stable"), rank


class Streams:
    """Token streams of some pages, one after another; the pages of one host come to few such arrays."""

    def __init__(self, hosts: np.ndarray, streams: np.ndarray, pages: list[tuple[str, list[str]]]):
        """hosts, streams: hashes of each page's host and text.  pages: (parts, lines) of the blocks that are left."""
        self.hosts, self.pages = hosts, pages
        texts = [line.encode("utf-8", "surrogatepass") for _, lines in pages for line in lines]
        sizes = [len(lines) for _, lines in pages]
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, ends = word_bounds(data)
        #: of each token: its block (counted over all pages) and page
        self.block = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right") if texts else np.empty(0, np.int64)
        self.page = np.repeat(np.arange(len(pages)), sizes)[self.block]
        self.first_block = np.cumsum(sizes) - sizes if sizes else np.empty(0, np.int64)
        self.n_blocks = len(texts)
        #: tokens of different hosts differ
        self.tokens = mix(span_hashes(data, starts, ends) ^ mix(hosts.astype(np.int64).view(np.uint64))[self.page])
        _, once = np.unique(np.stack((hosts, streams)), axis=1, return_index=True) if len(hosts) else (None, np.empty(0, np.int64))
        self.distinct = np.zeros(len(pages), bool)
        self.distinct[once] = True
        #: places at which a window of RUN tokens lies within a page, in the order of the suffix array, and the neighbours' groups
        n = len(self.tokens)
        order, rank = suffix_order(self.tokens, RUN) if n else (np.empty(0, np.int64), np.empty(0, np.int64))
        fits = order + RUN <= n
        order = order[fits]
        order = order[self.page[order] == self.page[order + RUN - 1]]
        self.order = order
        ranks = rank[order]
        self.begins = np.concatenate(([True], ranks[1:] != ranks[:-1])) if len(order) else np.empty(0, bool)
        self.group = np.cumsum(self.begins) - 1

    def keys(self) -> np.ndarray:
        """A hash of the window of each group, the same in every array."""
        at = self.order[self.begins]
        out = np.zeros(len(at), np.uint64)
        for j in range(RUN):
            out += self.tokens[at + j] * mix(np.array([j + 1], np.uint64))[0]
        return mix(out).view(np.int64)

    def holders(self) -> np.ndarray:
        """Distinct pages that hold the window of each group: neighbours of one group are in the order of their pages."""
        page = self.page[self.order]
        fresh = self.begins | np.concatenate(([True], page[1:] != page[:-1])) if len(page) else np.empty(0, bool)
        return np.bincount(self.group, fresh & self.distinct[page], self.begins.sum()).astype(np.int64)

    def distinct_pages(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.hosts[self.distinct], return_counts=True)

    def counted(self, known: np.ndarray | None = None) -> pd.DataFrame:
        """host, window, distinct pages that hold it; without a window, the distinct pages of the host.

        known: windows to count.  Without them, those that reach the host's SHARE among the pages of this array: what reaches it among
        all pages of a host reaches it in some array.
        """
        own, n = self.distinct_pages()
        host, keys, holders = self.hosts[self.page[self.order[self.begins]]], self.keys(), self.holders()
        take = np.isin(keys, known) if known is not None else holders >= SHARE * n[np.searchsorted(own, host)]
        found = pd.DataFrame({"host": host[take], "window": pd.array(keys[take], "Int64"), "pages": holders[take]})
        return pd.concat((pd.DataFrame({"host": own, "window": pd.array([None] * len(own), "Int64"), "pages": n.astype(np.int64)}), found), ignore_index=True)

    def repeated(self) -> np.ndarray:
        """Groups that are boilerplate, where each host lies in this array alone."""
        own, n = self.distinct_pages()
        pages = n[np.searchsorted(own, self.hosts[self.page[self.order[self.begins]]])] if len(self.order) else np.empty(0, np.int64)
        return is_boilerplate(self.holders(), pages)

    def texts(self, repeated: np.ndarray) -> Iterator[tuple[str, int]]:
        """Text of each page and its covered tokens.  repeated: of each group whether its window is boilerplate."""
        covered = np.zeros(len(self.tokens), bool)
        hit = self.order[repeated[self.group]] if len(self.order) else self.order
        for j in range(RUN):
            covered[hit + j] = True
        size = np.bincount(self.block, minlength=self.n_blocks)
        hidden = np.bincount(self.block, covered, self.n_blocks)
        whole = (size > 0) & (hidden == size)
        ends = np.concatenate((self.first_block[1:], [self.n_blocks])) if len(self.pages) else []
        at = np.searchsorted(self.block, np.arange(self.n_blocks))
        for (parts, lines), lo, hi in zip(self.pages, self.first_block, ends, strict=True):
            n_covered = int(hidden[lo:hi].sum())
            if not n_covered:
                yield "\n\n".join(lines), 0
                continue
            # runs that cover most of an article, or a whole page, are what other pages have too
            boilerplate = size[lo:hi][whole[lo:hi]].sum() <= MOST * size[lo:hi].sum() if parts[0] == KEPT else n_covered < size[lo:hi].sum()
            texts = []
            for k, (part, line) in enumerate(zip(parts, lines, strict=True)):
                if whole[lo + k] and boilerplate:
                    continue
                if part == OPEN and boilerplate and hidden[lo + k]:
                    gone = covered[at[lo + k] : at[lo + k] + size[lo + k]]
                    line = " ".join(w for w, g in zip(line.split(" "), gone, strict=True) if not g)
                if line:
                    texts.append(line)
            yield "\n\n".join(texts), n_covered


def is_boilerplate(holders, pages):
    """Whether so many of a host's distinct pages make a run its boilerplate (numbers or columns)."""
    return (holders >= LEAST_PAGES) & (holders >= SHARE * pages)


_PARSED = "page_id long, url string, host long, array long, stream long, packed binary"
_TEXTS = "page_id long, url string, text string, n_chars long, n_repeated int"


def _parsed(batches: Iterator[pd.DataFrame], once: bool) -> Iterator[pd.DataFrame]:
    """Blocks that structure leaves of each page, packed, and the array of the page.

    once: arrays go by the text, and equal texts of a host come (nearly always) once from a task, so that no array gets a
    large group of copies; otherwise arrays go by the page.
    """
    import zstandard

    squeeze, seen = zstandard.ZstdCompressor(level=9, write_content_size=True), set()
    for batch in batches:
        streams, packed = [], []
        for host, html in zip(batch["host"], batch["html"], strict=True):
            left = [(p, t) for p, t in (blocks(html) if isinstance(html, str) else []) if p != OUTSIDE]
            raw = ("".join(str(p) for p, _ in left) + "\n" + "\n".join(t for _, t in left)).encode("utf-8", "surrogatepass")
            streams.append(int.from_bytes(hashlib.blake2b(str(host).encode() + raw, digest_size=8).digest(), "big", signed=True))
            packed.append(raw)
        if once:
            fresh = []
            for s in streams:
                fresh.append(s not in seen)
                seen.add(s)
            if len(seen) > SEEN:
                seen.clear()
            batch, streams, packed = batch[fresh], [s for s, f in zip(streams, fresh, strict=True) if f], [r for r, f in zip(packed, fresh, strict=True) if f]
        streams = np.array(streams, np.int64)
        host = batch["host"].to_numpy(np.int64)
        piece = (streams if once else batch["dealt"].to_numpy(np.int64)).view(np.uint64) % batch["pieces"].to_numpy(np.int64).astype(np.uint64)
        yield pd.DataFrame({"page_id": batch["page_id"].to_numpy(), "url": batch["url"].to_numpy(), "host": host, "array": _array(host, piece, batch["arrays"].to_numpy(np.int64)), "stream": streams, "packed": [squeeze.compress(r) for r in packed]})


def _array(host: np.ndarray, piece: np.ndarray, arrays) -> np.ndarray:
    return (mix(host.view(np.uint64) ^ mix(piece.astype(np.uint64) + np.uint64(1))) % np.asarray(arrays, np.uint64)).astype(np.int64)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _parsed(batches, False)


def _parse_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _parsed(batches, True)


def _streams(batch: pd.DataFrame) -> Streams:
    import zstandard

    loosen, pages = zstandard.ZstdDecompressor(), []
    for packed in batch["packed"]:
        parts, _, lines = loosen.decompress(bytes(packed)).decode("utf-8", "surrogatepass").partition("\n")
        pages.append(([int(p) for p in parts], lines.split("\n") if parts else []))
    return Streams(batch["host"].to_numpy(np.int64), batch["stream"].to_numpy(np.int64), pages)


def _texts(batch: pd.DataFrame, streams: Streams, repeated: np.ndarray) -> pd.DataFrame:
    rows = [(text, len(text), n) for text, n in streams.texts(repeated)]
    out = pd.DataFrame(rows, columns=["text", "n_chars", "n_repeated"])
    return pd.concat((batch[["page_id", "url"]].reset_index(drop=True), out), axis=1)


def _known(batch: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    if not len(batch):
        return pd.DataFrame({"page_id": [], "url": [], "text": [], "n_chars": [], "n_repeated": []})
    streams = _streams(batch)
    return _texts(batch, streams, np.isin(streams.keys(), told["window"].to_numpy(np.int64)))


def main_text(pages: DataFrame, array_pages: int = ARRAY_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_repeated (tokens that structure leaves and that lie in runs which the host repeats).

    pages: page_id, url, html; further columns are ignored.  A null or empty html gives an empty text; a null url is a host of its own.
    Repeated rows are pages of their own (which count once among the host's distinct pages), an empty table gives an empty result.
    """

    def local(batch: pd.DataFrame) -> pd.DataFrame:
        streams = _streams(batch)
        return _texts(batch, streams, streams.repeated())

    spark = pages.sparkSession
    host = F.xxhash64(F.lower(F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^\w+://|[/?#].*$", "")))
    rows = bare(pages, "page_id", "url", "html").withColumns({"host": host, "dealt": F.xxhash64("page_id", "url")})
    sizes = stored(rows.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    arrays = max(1, -(-n // array_pages), partitions(spark))
    # hosts with more pages than an array takes: one in array_pages pages at most, so few
    large = sizes.filter(F.col("n") > array_pages).select("host", F.ceil(F.col("n") / array_pages).alias("pieces"))
    dealt = rows.join(F.broadcast(large) if n // array_pages <= BROADCAST_HOSTS else large, "host", "left").withColumn("arrays", F.lit(arrays).cast("long"))
    small = dealt.filter("pieces is null").withColumn("pieces", F.lit(1).cast("long")).mapInPandas(_parse, _PARSED)
    whole = small.repartition(arrays, "array").groupBy("array").applyInPandas(local, _TEXTS)
    # large hosts: windows that may be repeated, their pages over all arrays, and then the texts; parsed each time, which costs less
    # than keeping the texts as a table
    large_pages = dealt.filter("pieces is not null")
    counted = "host long, window long, pages long"
    once = large_pages.mapInPandas(_parse_once, _PARSED).repartition(arrays, "array")
    likely = stored(once.groupBy("array").applyInPandas(lambda b: _streams(b).counted(), counted), "windows").filter("window is not null").select("host", "window").distinct()
    places = large.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            host = batch["host"].to_numpy(np.int64)
            yield pd.DataFrame({"host": host, "array": _array(host, batch["piece"].to_numpy(np.int64), arrays)})

    places = places.mapInPandas(placed, "host long, array long").distinct()

    def told(windows: DataFrame) -> DataFrame:
        """To all arrays that may hold pages of the host."""
        return places.join(windows, "host").select("array", "window").distinct().repartition(arrays, "array").groupBy("array")

    def count(batch: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        return _streams(batch).counted(windows["window"].to_numpy(np.int64)) if len(batch) else pd.DataFrame({"host": [], "window": [], "pages": []})

    counts = stored(once.groupBy("array").cogroup(told(likely)).applyInPandas(count, counted), "window-pages")
    all_pages = counts.filter("window is null").groupBy("host").agg(F.sum("pages").alias("all"))
    sums = counts.filter("window is not null").groupBy("host", "window").agg(F.sum("pages").alias("holders"))
    repeated = sums.join(all_pages, "host").filter(is_boilerplate(F.col("holders"), F.col("all"))).select("host", "window")
    by_page = large_pages.mapInPandas(_parse, _PARSED).repartition(arrays, "array")
    merged = by_page.groupBy("array").cogroup(told(repeated)).applyInPandas(_known, _TEXTS)
    return whole.unionByName(merged)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
