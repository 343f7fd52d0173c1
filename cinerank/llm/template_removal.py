"""Main text of web pages by site template removal.

Every page is parsed to a tree (unclosed, stray and implied tags as browsers
treat the common ones); each element's subtree gets a hash of its tag, class,
id, text and children. Spark counts on how many pages of its host each subtree
occurs; subtrees recurring on many pages of the host are deleted. What elements
say about themselves is used besides, for boilerplate that differs from page to
page or stands on few: scripts, styles, menus, headers, footers, sidebars, notices,
adverts, forms and comment sections go by tag, role, class or id, and where a page
has an article or main element its text lies there.
Inside that element a recurring subtree is deleted only if it is no heading or
paragraph, as articles may quote the same passage.

The text: character references decoded, white space inside a block turned into
one space, blocks joined in page order by one space.

Cases: null or empty html gives an empty text, plain text without markup is
itself; a page cut off in the middle of a tag ends there; a quote in a tag opens a
value only after an equals sign; a page of very many elements takes time in
proportion to them (to their number times depth where blocks are deeply nested); an
empty table gives an empty result; pages without host
form one group; equal rows are one page for the counts, so copies of one page
do not make its text a template; extra columns pass through; added columns
replace columns of the same name.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import add_columns, materialise
from cinerank.llm.host_reputation import url_host

MIN_PAGES, MIN_SHARE, SALTS = 5, 0.2, 64

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
            "pre search section summary table tbody td tfoot th thead tr ul".split())
# an opening tag of the key's kind closes an open element of these kinds
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
ENDS_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "caption", "li", "dd", "dt"} | {"li", "dd", "dt"}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "tbody": {"table"}, "option": {"select", "datalist"}, "p": {"table", "button", "td", "th", "caption"}}
DROPPED = set("head script style textarea title xmp iframe noembed noframes noscript template svg math nav footer aside "
              "form button select dialog menu search object canvas audio video".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                    "toolbar".split())
_WORDS = (r"(?:ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|"
          r"masthead|topbar|footer|sidebar|aside|widgets?|related|recommend\w*|share|sharing|social|cookies?|consent|gdpr|"
          r"notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|comments?|commentlist|"
          r"disqus|replies|reply|respond|pagination|pager|legal|copyright)")
_PLAIN = r"(?:area|list|section|box|wrapper|container|block|form|bar|links?|buttons?|text|content|thread|item|row|main|top|bottom|left|right|\d+)"
_HINT = re.compile(rf"(?:^|[\s_-]){_WORDS}(?=$|[\s_-])")  # as a part of a class name or id
_SURE = re.compile(rf"(?:^|\s){_WORDS}(?:[_-](?:{_WORDS}|{_PLAIN}))*(?=$|\s)")  # as a whole one
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "article", "main", "body", "html"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"
                    r"((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S)  # a quote opens a value after = only
# one attribute: its name, then its whole value
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "name", "role", "hidden", "children", "hash", "size", "holds", "title")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children, self.hash = tag, [], 0
        self.name, self.role, self.hidden = "", "", False
        self.size, self.holds, self.title = 0, False, tag == "h1"
        if attrs:
            seen = set()
            for k, a, b, c in _ATTR.findall(attrs):
                k, v = k.lower(), (a or b or c).lower()
                if k in seen:  # the first one of a name counts
                    continue
                seen.add(k)
                if k == "role":
                    self.role = v
                elif k in ("class", "id"):
                    self.name += f" {v}"
                elif k == "hidden" or (k == "aria-hidden" and v == "true"):
                    self.hidden = True


def parse(source: str) -> Node:
    """The element tree; children are nodes or text (still with references)."""
    root = Node("#root")
    stack = [root]
    pos, end = 0, len(source)

    def close(names: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while pos < end:
        m = _TOKEN.search(source, pos)
        if not m:
            stack[-1].children.append(source[pos:])
            break
        if m.start() > pos:
            stack[-1].children.append(source[pos:m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                close({tag}, SCOPE.get(tag, set()) if tag in ("p", "li") else {"table"} if tag not in BLOCK else set())
            continue
        if m[0][-1:] != ">":
            break  # cut off inside a tag
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE.get(tag, set()))
        if tag in ENDS_P:
            close({"p"}, SCOPE["p"])
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(source, pos)
            pos = stop.end()
            if stop.start() == end:
                break
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def boilerplate(node: Node, in_main: bool, page_size: int = 0) -> bool:
    """Whether the element says of itself that it is not the article's text. A
    class or id that merely mentions such a word ("has-sidebar") is not believed
    of an element that holds an article or over half of the page's text, and
    none is of one with the headline inside the article."""
    if node.tag in DROPPED or node.hidden or node.role in DROPPED_ROLES:
        return True
    if node.tag == "header":
        return not in_main
    if not node.name or node.tag in ("html", "body", "main", "h1") or (in_main and node.title):
        return False
    if _SURE.search(node.name):
        return True
    return bool(_HINT.search(node.name)) and not node.holds and 2 * node.size <= page_size


def _measure(node: Node) -> int:
    """Bottom-up, without recursion: subtree hashes, text sizes, and whether an
    article, main element or headline is inside."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if not isinstance(c, str)]
    for x in reversed(order):
        h = blake2b(f"{x.tag}|{x.name}|{x.role}".encode("utf-8", "replace"), digest_size=8)
        for c in x.children:
            if isinstance(c, str):
                t = " ".join(c.split())
                x.size += len(t)
                h.update(b"t" + t.encode("utf-8", "replace"))
            else:
                h.update(c.hash.to_bytes(8, "little", signed=True))
                if c.tag not in DROPPED:
                    x.size += c.size
                    x.title |= c.title
                    x.holds |= c.holds or c.tag in ("article", "main") and not _HINT.search(c.name)
        x.hash = int.from_bytes(h.digest(), "little", signed=True)
    return node.hash


def _main(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, that are not
    boilerplate or inside it; else the whole tree."""
    for want in (("article",), ("main",)):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if (x.tag in want or x.role == want[0]) and not boilerplate(x, False, root.size):
                found.append(x)
                continue
            for c in reversed(x.children):
                if not isinstance(c, str) and (c.tag in want or c.role == want[0] or not boilerplate(c, False, root.size)):
                    todo.append(c)
        if found:
            return found
    return [root]


def tree(source: str | None) -> Node:
    root = parse(source or "")
    _measure(root)
    return root


def blocks(source: str | None) -> list[tuple[str, list[int]]]:
    return blocks_of(tree(source))


def blocks_of(root: Node) -> list[tuple[str, list[int]]]:
    """(text, hashes of the deletable elements around it) per block of the main
    content, in page order. A block ends where a block element starts or ends,
    and where the set of deletable elements changes."""
    mains = _main(root)
    inside = mains[0] is not root
    out: list[tuple[str, list[int]]] = []
    text: list[str] = []

    def flush(path: list[int]) -> None:
        t = _SPACE.sub(" ", htmllib.unescape("".join(text))).strip()
        text.clear()
        if t:
            out.append((t, path))

    for top in mains:
        todo: list = [(top, [], False)]
        while todo:
            x, path, leaving = todo.pop()
            if isinstance(x, str):
                text.append(x)
                continue
            wall = x.tag in BLOCK or x.tag == "#root"
            if leaving:
                flush(path)
                continue
            if x is not top and boilerplate(x, inside, root.size):
                if wall:
                    text.append(" ")
                continue
            deletable = x.tag not in ("#root", "html", "body", "br") and x is not top and not (inside and (
                x.tag in _PROSE or not wall))
            if wall:
                flush(path)
            own = path + [x.hash] if deletable and wall else path
            if wall:
                todo.append((x, own, True))
            todo += [(c, own, False) for c in reversed(x.children)]
        flush([])
    return out


def named_parts(root: Node) -> list[int]:
    """Hashes of the outermost elements with text that say of themselves that they are boilerplate."""
    out, todo = [], [(root, False)]
    while todo:
        x, inside = todo.pop()
        inside = inside or x.tag in ("article", "main")
        for c in x.children:
            if not isinstance(c, str) and c.size:
                if boilerplate(c, inside, root.size):
                    out.append(c.hash)
                else:
                    todo.append((c, inside))
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, copies, hashes = [], [], []
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            page = int.from_bytes(blake2b((source or "").encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            root = tree(source)
            found = {h for _, path in blocks_of(root) for h in path} | {0, *named_parts(root)}
            hosts += [host] * len(found)
            copies += [page] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(copies, pa.int64()),
                                          pa.array(hashes, pa.int64())], names=["host", "page", "hash"])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees on at least min_pages different pages and
    min_share of the pages of the host. Rows (host, html). Hash 0 stands for
    the page itself, which every page has, so it counts the pages."""
    seen = pages.select("host", "html").mapInArrow(_subtrees, "host string, page long, hash long")
    # two steps, so that a host with very many pages is pre-aggregated by subtree
    counts = seen.distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = materialise(counts.where((F.col("hash") == 0) | (F.col("n") >= min_pages)), "subtrees")
    total = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    return (counts.where("hash <> 0").join(total, "host")
            .where(F.col("n") >= min_share * F.col("pages")).select("host", "hash"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url", **options) -> DataFrame:
    """All rows and columns but the html, plus text, n_chars, n_templates (elements
    of the page that recur on its host) and n_by_name (those that only their name
    tells from the article). A host has at
    most 1 / min_share times as many templates as its pages have subtrees on
    average, so its list is short; it is copied to SALTS places, over which the
    pages of the host are spread."""
    src = pages.withColumn("_host", url_host(F.col(f"`{url}`")))
    found = templates(src.select(F.col("_host").alias("host"), F.col(f"`{html}`").alias("html")), **options)
    per_host = found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("hash").alias("_templates")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def make():
        def run(sources):
            trees = [tree(s) for s in sources]
            return ([[{"t": t, "path": p} for t, p in blocks_of(x)] for x in trees], [named_parts(x) for x in trees])
        return run

    cut = add_columns(src, make, [html], {"_blocks": "array<struct<t:string,path:array<long>>>", "_named": "array<long>"}, drop=(html,))
    known = F.coalesce("_templates", F.array().cast("array<long>"))
    kept = F.filter("_blocks", lambda b: ~F.arrays_overlap(b["path"], known))
    elements = F.array_union(F.flatten(F.transform("_blocks", lambda b: b["path"])), "_named")
    spread = cut.withColumn("_salt", F.pmod(F.xxhash64("_blocks"), F.lit(SALTS)).cast("int"))
    out = spread.join(per_host, ["_host", "_salt"], "left").withColumn(
        "text", F.array_join(F.transform(kept, lambda b: b["t"]), " "))
    out = out.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "n_templates", F.size(F.array_intersect(elements, known)).cast("long")).withColumn(
        "n_by_name", F.size(F.array_except("_named", known)).cast("long"))
    return out.drop("_blocks", "_named", "_templates", "_host", "_salt")
