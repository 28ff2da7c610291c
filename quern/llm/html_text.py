"""HTML extraction with site template removal.

Each page becomes a tree of block elements. Every subtree with text is hashed (tags, classes and text), menus, footers
and adverts as well as the rest; Spark counts how many pages of its host hold each hash, and subtrees that recur on
`least` pages and on `share` of the host's pages, or on `many` pages whatever their share, go. Sites have several
layouts, so the share is small. Pages with equal main text count as one page, so that copies of an article don't make
a template of its parts.

Paragraphs, headings and other prose directly inside an article or main element are never taken for template: a
passage that many articles of a site quote is part of each of them. Neither are those elements and what holds them.

Of hosts with few pages there is nothing to count, so what is left then loses, as a fallback, elements that by name,
class, id or role never hold main text (menus, headers, footers, forms, notices, adverts, comments); and where a page
has article or main elements, their text is the result.

The pages' parsed blocks move once, compressed, keyed by page, so a host of any size is no hot key; the counts of
(host, hash) are summed before they move.

Cases: null html is empty; pages without text give an empty text; a null url is a host of its own; malformed and cut
markup is read as far as it goes, and a tag with an unclosed quote ends at its first >; rows with one page_id are told
apart by a hash of their url and html; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by what they mean here.
RAW = ("title", "script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "noembed", "noframes", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav footer aside form button select option menu dialog fieldset label legend datalist output progress meter canvas audio video map applet marquee figcaption".split()) - {"figcaption"} | frozenset(RAW)
BLOCK = frozenset("html body main article section header hgroup div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary center hr search".split()) | NEVER
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt ul ol dl td th tr table caption tbody thead tfoot figure figcaption".split())
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Fixed value: for an element, those that it closes when it opens, and those that stop the search for them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Fixed value: words of a class, id or role that mark what isn't main text.
MARKED = re.compile(
    r"^(?:ads?|advert\w*|adsense|adslot|adbox|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|notification\w*|alerts?|sidebar\w*|aside|menus?|nav|navbar|navigation|navi|topbar|footer\w*|masthead|breadcrumbs?|"
    r"comments?|commentlist|replies|reply|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|popup|modal|overlay|pagination|pager|widget\w*|toolbar|skip|contentinfo|complementary|search|login|signup|paywall)$"
)
HEADERS = re.compile(r"^(?:header|siteheader|pageheader|topheader)$")
#: Fixed value: words that turn a mark around, as in has-sidebar.
NOT_MARKED = frozenset("with has no without".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|$)|'[^']*'(?=[\s/>]|$))*)(?:>|$)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|$)", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
#: A subtree is template if it is on LEAST pages and on SHARE of its host's pages at least, or on MANY.
LEAST, SHARE, MANY = 3, 0.005, 30


class Node:
    """An element: name, words of its class, id and role, and its children: nodes and texts."""

    __slots__ = ("hidden", "kids", "marks", "name")

    def __init__(self, name: str, marks: tuple[str, ...] = (), hidden: bool = False):
        self.name, self.marks, self.hidden, self.kids = name, marks, hidden, []


def parse(text: str) -> Node:
    """The tree of block elements; other elements leave only their text. Never fails."""
    root = Node("#root")
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if not m:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        shut_tag, name, given = (m[4], m[5], m[6]) if m[5] else (m[1], m[2], m[3])
        name = (name or "").lower()
        if not name:
            continue
        if shut_tag:
            if name in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
                    if stack[k].name in ("article", "main", "body") and name in ("p", "li", "div", "ul", "section"):
                        break
            elif name == "br":
                stack[-1].kids.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
            at = end.end() if end else n
            continue
        if name == "br":
            stack[-1].kids.append(" ")
        if name not in BLOCK or name in VOID:
            if name == "hr":
                stack[-1].kids.append(Node("hr"))
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in ("td", "th", "li", "article", "div", "section", "body"):
                    break
        if name in CLOSES:
            shut, stop = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in stop:
                    break
                if stack[k].name in shut:
                    del stack[k:]
        marks, hidden = [], False
        if given and given.strip():
            for a in ATTR.finditer(given):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() in ("class", "id", "role"):
                    marks += value.lower().split()
                elif a[1].lower() == "hidden" or "display:none" in value.replace(" ", "").lower():
                    hidden = True
        node = Node(name, tuple(marks), hidden)
        stack[-1].kids.append(node)
        if name != "hr":
            stack.append(node)
    return root


def holds_main(node: Node) -> bool:
    """Whether an article or main element lies below: wrappers are never left out by their class."""
    todo = [k for k in node.kids if not isinstance(k, str)]
    while todo:
        k = todo.pop()
        if k.name in ("article", "main") and not any(MARKED.match(m) for m in k.marks):
            return True
        todo += [x for x in k.kids if not isinstance(x, str)]
    return False


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element never holds main text. inside: it lies in an article or main element."""
    if node.name in NEVER or node.hidden or node.name == "header" and not inside:
        return True
    for mark in node.marks:
        words = [mark, *re.split(r"[-_]+", mark)]
        if NOT_MARKED.intersection(words) or holds_main(node):
            continue
        if any(MARKED.match(w) for w in words[1:]) or not inside and any(HEADERS.match(w) for w in words):
            return node.name not in ("html", "body", "main") and not (node.name == "article" and not inside and mark not in ("comment", "comments", "ad", "related"))
    return False


@dataclass
class Block:
    """A maximal run of text without a block border: hashes of the subtrees that hold it and may be template, whether an
    element around it never holds main text by its name or class, and whether it lies in an article or main element."""

    text: str
    units: list[int]
    named: bool
    inner: bool


def blocks(root: Node) -> list[Block]:
    """The blocks of a page in order."""
    out: list[tuple[str, list[Node], bool, bool]] = []
    digest: dict[int, int] = {}

    def walk(node: Node, above: list[Node], named: bool, inside: bool) -> tuple[int, bool]:
        """The subtree's hash and whether it holds an article or main element."""
        named = named or boilerplate(node, inside)
        inner = inside or not named and node.name in ("article", "main")
        unit = above if node.name in ("#root", "html", "body") or not named and (node.name in ("article", "main") or inner and node.name in PROSE) else [*above, node]
        parts, run, holds = [node.name, " ".join(node.marks)], [], not named and node.name in ("article", "main")

        def flush() -> None:
            t = SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if t:
                parts.append(t)
                out.append((t, unit, named, inner))

        for kid in node.kids:
            if isinstance(kid, str):
                run.append(kid)
            else:
                flush()
                h, more = walk(kid, unit, named, inner)
                holds |= more
                if h:
                    parts.append(str(h))
        flush()
        raw = "\x1f".join(parts).encode("utf-8", "replace")
        h = zlib.crc32(raw) << 32 | zlib.adler32(raw)
        digest[id(node)] = 0 if holds else h - (1 << 63)
        return h or 1, holds

    import sys

    was = sys.getrecursionlimit()
    sys.setrecursionlimit(max(was, 20_000))
    try:
        walk(root, [], False, False)
    finally:
        sys.setrecursionlimit(was)
    return [Block(t, [d for u in unit if (d := digest[id(u)])], named, inner) for t, unit, named, inner in out]


def flat(root: Node, deepest: int = 2_000) -> Node:
    """The tree with elements below so many levels lifted to that level, so that walking it can't run out of stack."""
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if depth >= deepest:
            lifted, rest = [], list(reversed(node.kids))
            while rest:
                kid = rest.pop()
                if isinstance(kid, str):
                    lifted.append(kid)
                else:
                    lifted.append(Node(kid.name, kid.marks, kid.hidden))
                    if not boilerplate(kid, False):
                        rest += reversed(kid.kids)
            node.kids = lifted
        else:
            todo += [(k, depth + 1) for k in node.kids if not isinstance(k, str)]
    return root


def join(page: list[Block], template: set[int], lists: bool = True) -> tuple[str, int]:
    """The text of a page without the template units, and how many code points of it were in them. lists: whether the
    fallback by names and classes and the preference for article or main elements apply."""
    left = [b for b in page if not template.intersection(b.units)]
    gone = sum(len(b.text) for b in page) - sum(len(b.text) for b in left)
    if lists:
        left = [b for b in left if not b.named]
        if any(b.inner for b in left):
            left = [b for b in left if b.inner]
    return "\n".join(b.text for b in left), gone


def main_key(page: list[Block]) -> int:
    """A hash of the page's main text, as far as the page itself tells."""
    return zlib.crc32(join(page, set())[0].encode("utf-8", "replace"))


def host(url: str | None) -> str:
    return (re.match(r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", url or "") or ["", ""])[1].lower()


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST, many: int = MANY, lists: bool = True) -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_template (code points in subtrees that the counts tell are template)."""
    from quern.llm.common import Scratch

    s = Scratch(pages.sparkSession, "html-text")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                b = batch.slice(lo, 200)
                urls, keys, mains, hashes, data = b.column("url").to_pylist(), [], [], [], []
                for url, text in zip(urls, b.column("html").to_pylist()):
                    page = blocks(flat(parse(text or "")))
                    place: dict[int, int] = {}  # units by their place in the page's list of them, which is shorter
                    # of text that the fallback takes anyway only the length matters
                    near = [("x" * len(x.text) if lists and x.named else x.text, [place.setdefault(u, len(place)) for u in x.units], int(x.named), int(x.inner)) for x in page]
                    raw = json.dumps(near, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")
                    data.append(zlib.compress(raw, 6))
                    keys.append((zlib.crc32((text or "").encode("utf-8", "replace")) << 32 | zlib.adler32((url or "").encode("utf-8", "replace"))) - (1 << 63))
                    mains.append(main_key(page))
                    hashes.append(list(place))
                arrays = [b.column("page_id"), b.column("url"), pa.array(map(host, urls), pa.string()), pa.array(keys, pa.int64()), pa.array(mains, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "row", "main", "hashes", "data"])

    parsed = s.write(rows.mapInArrow(run, "page_id long, url string, host string, row long, main long, hashes array<long>, data binary"), "parsed")
    counts = parsed.select("host", "main", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.countDistinct("main").alias("n")).where(F.col("n") >= least)
    sites = parsed.groupBy(F.col("host").alias("site")).agg(F.countDistinct("main").alias("pages"))
    enough = F.least(F.lit(many), F.greatest(F.lit(least), F.ceil(share * F.col("pages"))))
    template = counts.join(sites, F.col("host") == F.col("site")).where(F.col("n") >= enough).select(F.col("host").alias("of"), F.col("hash").alias("known"))
    # dealt by host and hash, whatever the number of templates; a hot pair can be split
    units = parsed.select("page_id", "row", "host", F.posexplode("hashes").alias("place", "hash"))
    gone = units.join(s.write(template, "template").hint("merge"), (F.col("host") == F.col("of")) & (F.col("hash") == F.col("known"))).groupBy("page_id", "row").agg(F.collect_set("place").alias("gone"))
    gone = s.write(gone.select(F.col("page_id").alias("id"), F.col("row").alias("key"), "gone"), "gone")
    both = parsed.drop("hashes", "host", "main").join(gone.hint("merge"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("key")), "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [join([Block(*x) for x in json.loads(zlib.decompress(d))], set(g or ()), lists) for d, g in zip(b.column("data").to_pylist(), b.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template"])

    return both.select("page_id", "url", "data", "gone").mapInArrow(finish, "page_id long, url string, text string, n_chars long, n_template long")
