"""Main text of web pages by site template removal (operator 1).

Pass 1 hashes every element subtree of a page that could be part of a site's template, and the shells (name and attributes)
of elements that markup names as a site's furniture, such as menus; Spark counts, for each host and hash, the pages of
different content that hold it. Pass 2 deletes the subtrees and shells that recur across many pages of their host; the
blocks that are left are the text. Only hosts of too few pages to count go by their markup alone.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, small_batches, stored

#: A subtree is a template's if it stands on so many pages of a host that differ in content, and on this share of them.
MANY_PAGES, SHARE = 5, 0.1
#: The hash that stands on every page: what it counts is the host's pages, and it is a template's where they are many.
SITE = -(1 << 63)

TOKEN = re.compile(r"""<(?:!--(?P<c>.*?)(?:--!?>|\Z)|(?P<e>/?)(?P<t>[a-zA-Z][^\s/>]*)(?P<a>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<e2>/?)(?P<t2>[a-zA-Z][^\s/>]*)(?P<a2>[^>]*)>|[!?/][^>]*>)""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math select".split())
#: Elements whose ends are lines of their own.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "option", "legend"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Elements, and words in classes or identifiers, that are a page's own but no part of its article.
NOT_TEXT = frozenset("form script style noscript template iframe button select textarea svg math dialog head title object canvas audio video input label fieldset xmp noembed noframes".split())
OWN_NAME = frozenset("ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion promoted comment comments commentlist respond disqus replies login popup modal overlay".split())
#: Elements, roles and words that are a site's furniture.
FURNITURE = frozenset("nav footer aside menu".split())
NOT_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist tooltip".split())
NOT_NAME = frozenset(
    "banner cookie cookies consent gdpr notice notices sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "share sharing social newsletter subscribe subscription signup related recommended recommendations widget widgets pagination pager skip skiplink toolbar".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt figcaption tr tbody caption summary".split())


class Page:
    """A page's elements in order of their starts, and the pieces of text with the element each stands in."""

    __slots__ = ("tag", "parent", "last", "attrs", "text", "hash", "chars", "linked")

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs = ["#"], [-1], [""]
        #: in page order: (element, its text), or (element, None) where a block or a line break starts
        self.text: list[tuple[int, str | None]] = []
        self.last = [0]
        self._parse(html)

    def _parse(self, html: str) -> None:
        tag, parent, attrs, text, last = self.tag, self.parent, self.attrs, self.text, self.last
        stack, at, low = [0], 0, None
        parts: list[list[str]] = [[]]
        self.hash, self.chars, self.linked = [0], [0], [0]
        hashes, chars, linked = self.hash, self.chars, self.linked
        opened: dict[str, int] = {}

        def close() -> None:
            e = stack.pop()
            held = parts.pop()
            opened[tag[e]] -= 1
            last[e] = len(tag) - 1
            if chars[e]:
                hashes[e] = xxhash.xxh64_intdigest((tag[e] + "\0" + "\0".join(held)).encode("utf-8", "surrogatepass"))
                up = stack[-1]
                chars[up] += chars[e]
                linked[up] += chars[e] if tag[e] == "a" else linked[e]
                parts[-1].append(f"<{hashes[e]:x}>")

        def add(raw: str) -> None:
            got = unescape(raw) if "&" in raw else raw
            text.append((stack[-1], got))
            words = " ".join(got.split())
            if words:
                parts[-1].append(words)
                chars[stack[-1]] += len(words)

        for m in TOKEN.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            name = m["t"] or m["t2"]
            if not name:
                continue
            name = name.lower()
            if m["e"] or m["e2"]:
                if not opened.get(name):
                    continue
                if name == "p" or name in BLOCK or name in ("a", "span", "b", "i", "em", "strong", "u", "small", "button", "label", "select"):
                    for depth in range(len(stack) - 1, 0, -1):
                        held = tag[stack[depth]]
                        if held == name:
                            while len(stack) > depth:
                                close()
                            break
                        if held in BLOCK and name not in BLOCK:
                            break
                else:
                    for depth in range(len(stack) - 1, 0, -1):
                        if tag[stack[depth]] == name:
                            while len(stack) > depth:
                                close()
                            break
                        if tag[stack[depth]] in BLOCK:
                            break
                continue
            if name in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    held = tag[stack[depth]]
                    if held == "p" or held[0] == "h" and held in ("h1", "h2", "h3", "h4", "h5", "h6") and name[0] == "h" and len(name) == 2 and name != "hr":
                        while len(stack) > depth:
                            close()
                        break
                    if held in BLOCK:
                        break
            if name in SAME:
                for depth in range(len(stack) - 1, 0, -1):
                    if tag[stack[depth]] in FENCE[name]:
                        break
                    if tag[stack[depth]] in SAME[name]:
                        while len(stack) > depth:
                            close()
                        break
            if name == "body" and "body" in tag:
                continue
            if name in ("body", "article", "main", "div", "section") and len(stack) > 1 and tag[stack[-1]] == "head":
                close()
            found = m["a"] if m["t"] else m["a2"]
            e = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            attrs.append(found or "")
            last.append(e)
            hashes.append(0)
            chars.append(0)
            linked.append(0)
            if name in BLOCK or name == "br":
                text.append((e, None))
            if name in VOID or (found or "").endswith("/") and name in RAW:
                continue
            if name in RAW:
                if low is None:
                    low = html.lower()
                    if len(low) != len(html):  # a few letters grow when lower-cased
                        low = re.sub("[A-Z]", lambda x: x[0].lower(), html)
                end = low.find("</" + name, at)
                at = len(html) if end < 0 else end
                continue
            stack.append(e)
            parts.append([])
            opened[name] = opened.get(name, 0) + 1
        if at < len(html):
            add(html[at:])
        while len(stack) > 1:
            close()
        last[0] = len(tag) - 1

    def marked(self, e: int) -> int:
        """1 if the markup says that the element is the page's own but no part of an article, 2 if it is a site's furniture, else 0."""
        name, raw = self.tag[e], self.attrs[e]
        if name in NOT_TEXT:
            return 1
        mark = 2 if name in FURNITURE else 0
        if not raw or name in ("html", "body"):
            return mark
        for key, a, b, c in ATTR.findall(raw):
            key, value = key.lower(), (a or b or c).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                return 1
            if key == "role" and value in NOT_ROLE:
                mark = 2
            if key in ("class", "id") and name != "main":
                for word in value.split():
                    parts = {word} if word.startswith(("has-", "no-", "with-")) else {word, *re.split("[-_]+", word)}
                    if parts & OWN_NAME:
                        return 1
                    if parts & NOT_NAME:
                        mark = 2
        return mark

    def main(self) -> tuple[list[int], list[int]]:
        """(elements that markup says are articles, outermost ones; the mark of each element, 0 if it holds an article)."""
        n = len(self.tag)
        mark, out = [0] * n, [False] * n
        for e in range(1, n):
            mark[e] = self.marked(e)
            out[e] = out[self.parent[e]] or mark[e] > 0
        roots = self._outermost(e for e in range(1, n) if self.tag[e] == "article" and not out[e] and self.chars[e])
        if not roots:
            roots = self._outermost(e for e in range(1, n) if (self.tag[e] == "main" or "role" in self.attrs[e] and re.search(r"""role\s*=\s*["']?main""", self.attrs[e])) and not out[e] and self.chars[e])
        if not roots:
            # a marked element that holds the article, such as a form around the page, is none
            inner = [e for e in range(1, n) if self.tag[e] == "article" and self.chars[e] and not mark[e] and not any(self.tag[u] in FURNITURE or self.attrs[u] and mark[u] for u in self._ups(e))]
            roots = [max(inner, key=lambda e: (self.chars[e], -e))] if inner else []
        for r in roots:
            for u in self._ups(r):
                mark[u] = 0
        inside = self._inside(roots)
        for e in range(1, n):
            # a page's header is no part of the article; the article's own is, if it holds the heading
            if self.tag[e] == "header" and not mark[e] and not (inside[e] and any(self.tag[k] in ("h1", "h2") for k in range(e, self.last[e] + 1))):
                mark[e] = 2
        return roots, mark

    def _outermost(self, found) -> list[int]:
        out: list[int] = []
        for e in found:  # in order of their starts
            if not out or e > self.last[out[-1]]:
                out.append(e)
        return out

    def _ups(self, e: int):
        while (e := self.parent[e]) > 0:
            yield e

    def _inside(self, roots: list[int]) -> list[bool]:
        """Whether each element is one of ``roots`` or lies in one."""
        out = [False] * len(self.tag)
        for r in roots:
            out[r : self.last[r] + 1] = [True] * (self.last[r] + 1 - r)
        return out

    def shell(self, e: int) -> int:
        """A hash of an element's name and attributes."""
        return xxhash.xxh64_intdigest(f"{self.tag[e]}\1{' '.join(self.attrs[e].split()).lower()}".encode("utf-8", "surrogatepass"))

    def candidates(self, roots: list[int], mark: list[int]) -> dict[int, list[int]]:
        """element -> hashes of which one being a template's deletes it: its subtree's, and its shell's if it is marked as furniture.

        Every block element that holds no article. Inside one only what is marked, lists and containers mostly made of links: its
        prose is never a template, however often a site repeats it. Without a marked article all block elements are.
        """
        inside, found = self._inside(roots), {}
        holds = {u for r in roots for u in (r, *self._ups(r))}
        for e in range(1, len(self.tag)):
            if not self.chars[e] or e in holds or self.tag[e] in ("html", "body"):
                continue
            if mark[e] == 2:
                found[e] = [self.hash[e], self.shell(e)]
            elif self.tag[e] in BLOCK and not (inside[e] and (self.tag[e] in PROSE or 2 * self.linked[e] < self.chars[e])):
                found[e] = [self.hash[e]]
        return found

    def trees(self) -> tuple[set[int], int]:
        """(hashes that could be a template's, hash of the page's content that tells copies of a page apart)."""
        roots, mark = self.main()
        able = self.candidates(roots, mark)
        if roots:
            content = 0
            for r in roots:
                content = (content * 31 + self.hash[r]) % (1 << 64)
        else:
            leaf = [e for e in able if self.tag[e] in PROSE and not mark[e]] or list(able)
            content = self.hash[max(leaf, key=lambda e: (self.chars[e], -e))] if leaf else 0
        return {h for hashes in able.values() for h in hashes}, content

    def content(self, templates: set[int] | None) -> str:
        """The blocks of the page without the subtrees and shells whose hash is in ``templates``, and without what is marked as the
        page's own but no part of its article. None: the host's pages are too few to count; then markup alone tells what is
        furniture, and if it marks articles, only they are the text."""
        roots, mark = self.main()
        tag, n, settled = self.tag, len(self.tag), templates is not None
        able = self.candidates(roots, mark) if settled else {}
        gone, block = [False] * n, [0] * n
        inside = self._inside(roots) if roots and not settled else [True] * n
        for e in range(1, n):
            gone[e] = gone[self.parent[e]] or mark[e] == 1 or not settled and mark[e] == 2 or any(h in templates for h in able.get(e, ()))
            block[e] = e if tag[e] in BLOCK else block[self.parent[e]]
        lines, held, now = [], [], None
        for e, words in self.text:
            if not inside[e]:
                continue
            if words is None:
                if tag[e] == "br":
                    held.append(" ")
                else:
                    lines.append(held)
                    held, now = [], None
            elif not gone[e]:
                if now is not None and block[e] != now:
                    lines.append(held)
                    held = []
                now = block[e]
                held.append(words)
        lines.append(held)
        joined = (" ".join("".join(x).split()) for x in lines if x)
        return "\n".join(x for x in joined if x)


def host_of(url: str | None) -> str:
    """The lower-cased host of a URL, without user, port and a leading www.; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    host = m[1].lower().rstrip(".") if m else ""
    return host.removeprefix("www.")


def row_hash(url: str | None, html: str | None) -> int:
    """Tells rows of one identifier apart by all that extraction reads; rows that repeat it have the same result."""
    h = xxhash.xxh64_intdigest(f"{url}\0{html}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def subtrees(pages: DataFrame) -> DataFrame:
    """Pass 1 over (page_id, url, html): a row a page with its host, the hashes of the subtrees that a template could consist
    of and the hash of its content. Pages without a host have no site, and so no row."""

    def run(batches):
        for batch in batches:
            at, hashes, hosts, trees, contents = [], [], [], [], []
            for i, (url, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                host = host_of(url)
                if not html or not host:
                    continue
                able, content = Page(html).trees()
                at.append(i)
                hashes.append(row_hash(url, html))
                hosts.append(host)
                trees.append(sorted({SITE, *(h - (1 << 63) for h in able)}))
                contents.append(content - (1 << 63))
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(hashes, pa.int64()), pa.array(hosts, pa.string()), pa.array(trees, pa.list_(pa.int64())), pa.array(contents, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "row", "host", "trees", "content"])

    return pages.mapInArrow(run, "page_id long, row long, host string, trees array<long>, content long")


def site_templates(found: DataFrame, many: int = MANY_PAGES, share: float = SHARE) -> DataFrame:
    """(host, tree) of the hashes that recur on at least ``many`` pages of their host with different content, and on at least
    ``share`` of those; SITE is one of them for hosts of at least ``many`` such pages, and for no others.

    Copies of one page count once, so an article that a site repeats is no template. Counts are pre-aggregated.
    """
    held = found.select("host", F.explode("trees").alias("tree"), "content")
    counted = held.groupBy("host", "tree", "content").count().groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= many)
    counted = stored(counted, "trees")  # of hashes on single pages nothing is left
    pages = counted.filter(F.col("tree") == SITE).select(F.col("host").alias("h"), F.col("n").alias("pages"))
    return counted.join(pages, F.col("host") == F.col("h")).filter(F.col("n") >= share * F.col("pages")).select("host", "tree")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", many: int = MANY_PAGES, share: float = SHARE) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text. On hosts of at least ``many`` pages of different content what recurs decides: menus,
    headers, footers, sidebars and notices go if their subtree or, where markup names them, their shell does; of marked elements only
    scripts, forms, hidden ones, adverts and reader comments go by their marks. Pages of other hosts and without a host are
    cleaned by markup. Repeated rows and null
    identifiers are kept; other columns are ignored; an empty table gives an empty result. Unclosed elements, comments and
    tags are closed where browsers would; malformed character references stay as they are. White space in a block
    is one space, a line break element too; blocks are joined by one line feed in page order.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    with batches_of(pages.sparkSession, 256):
        found = stored(subtrees(rows), "subtrees")
    small_batches(pages.sparkSession, 256)
    seen = found.select("page_id", "row", "host", F.explode("trees").alias("tree"))
    held = seen.join(site_templates(found, many, share), ["host", "tree"]).groupBy("page_id", "row").agg(F.collect_set("tree").alias("trees"))
    held = held.select(F.col("page_id").alias("p"), F.col("row").alias("r"), "trees")

    def shrink(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            url, html = (batch.column(i).to_pylist() for i in (1, 2))
            blob = [None if h is None else squeeze(h.encode("utf-8", "surrogatepass")) for h in html]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row_hash(u, h) for u, h in zip(url, html, strict=True)], pa.int64()), pa.array(blob, pa.binary())], ["page_id", "url", "row", "blob"])

    # pages travel to their templates compressed
    packed = rows.mapInArrow(shrink, "page_id long, url string, row long, blob binary")
    joined = packed.join(held, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("row") == F.col("r")), "left").select("page_id", "url", "blob", "trees")

    def run(batches):
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = []
            for blob, trees in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                html = grow(blob).decode("utf-8", "surrogatepass") if blob else ""
                texts.append(Page(html).content({t + (1 << 63) for t in trees} if trees else None) if html else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
