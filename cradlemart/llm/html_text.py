"""Main text of web pages, with removal of each site's template.

A page is parsed into a tree of elements. Scripts, menus, headers, footers, sidebars, notices,
adverts, forms and reader comments go by element name, role and class; an element that holds the
article, or most of a page without one, does not go. What else a site repeats is found by counting:
the subtree of every block element is hashed, the hashes are counted per host over distinct articles
in Spark (pages with the same main element are one, whatever their url), and subtrees that stand on
many pages of their host are deleted. Inside an article these are whole sections only (``div``,
``section``), never a paragraph, list entry or table cell that other articles have too. The main
text is the largest article of what is left with the articles beside it (else the main element, else
the body), block by block. Parsing takes time in proportion to the page, however it is nested.

Only hashes are shuffled for the counts, combined on the map side; a host keeps at most (subtrees a
page has) / ``share`` hashes, whatever its size. These lists are joined back to the pages by host;
pages of a hot host are spread by the join's skew handling, so nothing groups the pages of a host.

Rules for odd input: a null html gives an empty text; broken markup is closed as browsers do, an
unfinished tag at the end is dropped; a page without a host has no template; rows that repeat an
article count once for the template and give a row each. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stored

MIN_PAGES = 5  # a subtree on fewer pages of its host is never a template
SHARE = 0.5  # of the host's pages

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe textarea title svg math object canvas audio video".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul br".split()
)
_DROPPED = _RAW | set("nav footer aside form button select option input menu dialog head search label".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTAINERS = set("div section ul ol dl table p header blockquote details figure center span td li address".split())
_DROPPED_ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
_DROPPED_WORDS = set(
    "nav navbar navigation menu submenu sidebar sidebars footer masthead ad ads advert adverts advertisement advertising "
    "adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe subscription signup comment comments disqus reply replies respond related recommended share "
    "sharing social breadcrumb breadcrumbs pagination pager widget widgets toolbar login search copyright disclaimer"
    .split()
)
# Class words do not drop these, which carry text rather than page furniture.
_TEXT = {"blockquote", "code", "dd", "dt", "figcaption", "figure", "p", "pre", "td", "th", "tr"} | _HEADINGS
_WITHOUT = {"has", "have", "is", "no", "non", "not", "with", "without"}  # "no-sidebar" is not a sidebar
_SECTIONS = {"div", "section"}  # what may be a site's template inside an article
# Which open elements a start tag ends, and where the search for them stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_P_STAYS = {"br", "body", "html"}


class Element:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children = name, attrs, []


class _Open:
    """The elements open at a point of the page, with the places of each name among them."""

    def __init__(self, root: Element):
        self.stack, self.places, self.blocks = [root], {}, [0]

    def push(self, e: Element) -> None:
        self.places.setdefault(e.name, []).append(len(self.stack))
        if e.name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def cut(self, at: int) -> None:
        """Close all elements from a place on."""
        while len(self.stack) > at:
            name = self.stack.pop().name
            self.places[name].pop()
            if name in _BLOCK:
                self.blocks.pop()

    def last(self, names: set[str]) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, name: str) -> None:
        at = self.last({name})
        if at and (name in _BLOCK or at > self.blocks[-1]):  # an inline end tag never closes a block
            self.cut(at)

    def imply_ends(self, name: str) -> None:
        if name in _BLOCK and name not in _P_STAYS and self.stack[self.blocks[-1]].name == "p":
            self.cut(self.blocks[-1])
        ends, stops = _ENDS.get(name, ((), ()))
        while ends and (at := self.last(ends)) > self.last(stops):
            self.cut(at)
            if name != "tr":
                break


def parse(source: str) -> Element:
    """The tree of a page; children are elements and pieces of text."""
    root = Element("html")
    opened, at = _Open(root), 0
    while True:
        tag = _TAG.search(source, at)
        piece = source[at : tag.start() if tag else len(source)]
        if piece:
            opened.stack[-1].children.append(html_lib.unescape(piece))
        if not tag:
            return root
        at = tag.end()
        name = tag["name"] or tag["name2"]
        if not name:
            if tag[0].startswith("<![CDATA["):
                opened.stack[-1].children.append(tag[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if tag["close"] or tag["close2"]:
            opened.close(name)
            continue
        if tag.end() == len(source) and not tag[0].endswith(">"):
            return root  # an unfinished tag
        attrs = tag["attrs"] if tag["attrs"] is not None else tag["attrs2"]
        if name in ("html", "body") and opened.places.get(name):
            continue
        opened.imply_ends(name)
        element = Element(name, attrs)
        opened.stack[-1].children.append(element)
        if name in _RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name not in _VOID and not (attrs.rstrip().endswith("/") and name not in _BLOCK):
            opened.push(element)


def _is_furniture(value: str) -> bool:
    """Does a class or id name a part of the page that is not its article?"""
    for name in value.split():
        words = _TOKEN.findall(name)
        if words and words[0] not in _WITHOUT and not _DROPPED_WORDS.isdisjoint(words):
            return True
    return False


def _is_boilerplate(e: Element, in_article: bool) -> bool:
    if e.name in _DROPPED:
        return True
    if e.name == "header" and not (in_article and _has_heading(e)):
        return True
    if not e.attrs or e.name in ("html", "body"):
        return False
    for key, a, b, c in _ATTR.findall(e.attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id") and e.name not in _TEXT and e.name != "main" and _is_furniture(value):
            return True
        if key == "role" and value.strip() in _DROPPED_ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _has_heading(e: Element) -> bool:
    todo = [e]
    while todo:
        x = todo.pop()
        if x.name in _HEADINGS:
            return True
        todo += [c for c in x.children if isinstance(c, Element)]
    return False


def _lengths(root: Element) -> dict[int, int]:
    """Length of the text below every element, raw and hidden parts left out, by id of the element."""
    out: dict[int, int] = {}
    for e in reversed(_ordered(root)):
        own = sum(len(c.strip()) if isinstance(c, str) else out[id(c)] for c in e.children)
        out[id(e)] = 0 if e.name in _RAW or e.name in ("nav", "head") else own
    return out


def _held(root: Element) -> set[int]:
    """The elements that must stay: the largest article (else the part with most of the text) and what holds it.

    Articles in furniture by name (comments, teasers) count only where the page has no other.
    """
    lengths, largest, todo = _lengths(root), {}, [(root, (), False, False)]
    while todo:
        e, above, inside, furniture = todo.pop()
        if e.name in _RAW or e.name in ("nav", "footer", "aside", "dialog"):
            continue
        if e.attrs and not furniture and e.name != "form":
            furniture = _is_boilerplate(e, True)
        is_main = e.name in ("article", "main") or _role(e) in ("article", "main")
        if is_main and not inside and lengths[id(e)]:
            rank = (not furniture, lengths[id(e)])
            if not largest or rank > largest["rank"]:
                largest = {"rank": rank, "path": (e, above)}
        if not inside:
            link = (e, above)
            todo += [(c, link, is_main, furniture) for c in reversed(e.children) if isinstance(c, Element)]
    total, stay = lengths[id(root)], set()
    if largest and (largest["rank"][0] or 2 * largest["rank"][1] > total):
        link = largest["path"]
        while link:
            stay.add(id(link[0]))
            link = link[1]
        return stay
    if not largest:
        e = root
        while e is not None:  # down to where the text divides
            stay.add(id(e))
            e = next((c for c in e.children if isinstance(c, Element) and 2 * lengths[id(c)] > total), None)
    return stay


def prune(root: Element) -> None:
    """Delete boilerplate by name, role and class, but nothing that holds the main text."""
    held, todo = _held(root), [(root, False)]
    while todo:
        e, inside = todo.pop()
        inside = inside or e.name in ("article", "main")
        e.children = [c for c in e.children if isinstance(c, str) or id(c) in held or not _is_boilerplate(c, inside)]
        todo += [(c, inside) for c in e.children if isinstance(c, Element)]


def _ordered(root: Element) -> list[Element]:
    """All elements, parents before children."""
    out = [root]
    for e in out:
        out += [c for c in e.children if isinstance(c, Element)]
    return out


def subtree_hashes(root: Element) -> dict[int, int]:
    """64-bit hash of every element's subtree (names and words), by id of the element."""
    digests: dict[int, bytes] = {}
    out = {}
    for e in reversed(_ordered(root)):
        h = hashlib.blake2b(e.name.encode(), digest_size=8)
        for c in e.children:
            if isinstance(c, str):
                words = c.split()
                if words:
                    h.update(b"\x01" + " ".join(words).encode("utf-8", "replace"))
            else:
                h.update(b"\x02" + digests[id(c)])
        digests[id(e)] = h.digest()
        out[id(e)] = int.from_bytes(digests[id(e)], "big", signed=True)
    return out


def text_of(root: Element) -> str:
    """Blocks in page order, white space collapsed, joined by single spaces."""
    parts: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        edge = x.name in _BLOCK
        if edge:
            parts.append(" ")
            todo.append(" ")
        todo.extend(reversed(x.children))
    return " ".join("".join(parts).split())


def _main(root: Element) -> list[Element]:
    """The largest article that is in no other, with its neighbours under the same parent; else the main element, else all."""
    for name in ("article", "main"):
        found, todo = [], [(root, None)]
        while todo:
            e, parent = todo.pop()
            if e.name == name or _role(e) == name:
                found.append((len(text_of(e)), len(found), e, parent))
            else:
                todo += [(c, e) for c in reversed(e.children) if isinstance(c, Element)]
        if found and max(found, key=lambda f: (f[0], -f[1]))[0]:
            parent = max(found, key=lambda f: (f[0], -f[1]))[3]
            return [e for _, _, e, p in found if p is parent]
    return [root]


def _role(e: Element) -> str:
    if "role" not in e.attrs and "articleBody" not in e.attrs:
        return ""
    for key, a, b, c in _ATTR.findall(e.attrs):
        if key.lower() == "role":
            return (a or b or c).lower()
        if key.lower() == "itemprop" and (a or b or c) == "articleBody":
            return "article"
    return ""


def _candidates(root: Element) -> list[Element]:
    """The block subtrees that may be a site's template: outside the article all, inside it whole sections."""
    out, todo = [], [(root, False)]
    while todo:
        e, inside = todo.pop()
        inside = inside or e.name in ("article", "main") or _role(e) in ("article", "main")
        for c in e.children:
            if isinstance(c, Element):
                if c.name in (_SECTIONS if inside else _CONTAINERS):
                    out.append(c)
                todo.append((c, inside))
    return out


def main_text(source: str | None, template: frozenset[int] = frozenset()) -> str:
    """Main text of one page without the subtrees whose hash is in the site's template."""
    if not source:
        return ""
    root = parse(source)
    prune(root)
    if template:
        hashes = subtree_hashes(root)
        gone = {id(e) for e in _candidates(root) if hashes[id(e)] in template}
        for e in _ordered(root):
            e.children = [c for c in e.children if isinstance(c, str) or id(c) not in gone]
    return " ".join(filter(None, map(text_of, _main(root))))


def page_hashes(source: str | None) -> tuple[int, set[int]]:
    """Hash of the article, and hashes of the block subtrees with text that prune leaves."""
    if not source:
        return 0, set()
    root = parse(source)
    prune(root)
    hashes, lengths = subtree_hashes(root), _lengths(root)
    article = hashlib.blake2b(digest_size=8)
    for e in _main(root):
        article.update(hashes[id(e)].to_bytes(8, "big", signed=True))
    return int.from_bytes(article.digest(), "big", signed=True), {hashes[id(e)] for e in _candidates(root) if lengths[id(e)]}


def _host():
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, template: hashes of subtrees that recur on many pages of the host), for (url, html)."""
    keyed = pages.select(_host().alias("host"), "html").where("host <> ''")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_hashes(x) for x in batch.column(1).to_pylist()]
            articles, hashes = [a for a, _ in found], [list(h) for _, h in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(articles, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["host", "page", "hashes"],
            )

    hashed = stored(keyed.mapInArrow(rows, "host string, page bigint, hashes array<bigint>"))
    once = hashed.select("host", "page", F.explode("hashes").alias("hash")).distinct()  # copies may differ around the article
    sizes = hashed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = once.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") >= min_pages).join(sizes, "host").where(F.col("n") >= F.col("pages") * share)
    return stored(often.groupBy("host").agg(F.collect_list("hash").alias("template")))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_pages: int = MIN_PAGES, share: float = SHARE,
) -> DataFrame:
    """One row per page row: id, url, text."""
    pages = only(pages, id=id_col, url=url_col, html=html_col)
    templates = site_templates(pages, min_pages, share)
    joined = pages.withColumn("host", _host()).join(templates, "host", "left").select("id", "url", "html", "template")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(source, frozenset(template or ()))
                for source, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(rows, f"id {kinds['id']}, url {kinds['url']}, text string")
