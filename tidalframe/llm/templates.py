"""HTML main text by site template removal.

Element subtrees are hashed, the hashes are counted per host in Spark over pages of different
content, and subtrees that ``MIN_PAGES`` pages of their host have are deleted, whatever they are
called and however large the host is. The article is then looked for in what remains: article
elements, else the main part, else a content division, else the whole body.

* Outside the article every block element counts. A subtree that holds the article stays.
* Inside the article only containers (sections, divisions, lists, tables) are deleted, as a
  sentence or heading may recur by right, and none if they hold half of its text, so that
  copies of an article on a host stay whole. A body is kept whole if nothing else would be left.
* Menus, headers, footers, sidebars, adverts, forms, scripts, styles and reader comments are
  also known by element, role, class and id, which covers hosts with few pages. Inside the
  article a class or id counts only if a whole name of a container is beyond doubt
  (``STRONG``), or if containers of that element, class and id recur on the host as well.

Blocks are joined in page order by one line feed; white space inside a block, line breaks
included, becomes one space; character references are decoded. A null or empty page has an
empty text; a null url counts as one host; repeated rows give equal texts; an empty table gives
an empty result; extra columns are not read. The time of a page is linear in its length: tags
are read in one pass and elements nest ``MAX_DEPTH`` deep at most, deeper ones become
neighbours. Ties do not arise.
"""

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A subtree is template if at least so many pages of different content on the host have it.
MIN_PAGES = 5
#: Digests of all hosts that are broadcast at most; beyond, each page gets its own by a join.
BROADCAST_DIGESTS = 2_000_000
MAX_DEPTH = 512

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# Inside a tag a quote opens a value only after an equals sign; elsewhere it is an ordinary sign.
REST = re.compile(r"""((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|))*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# Fixed values of the HTML standard: elements without content, with raw text, of blocks, and
# the start tags that close an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body html caption tbody td tfoot th thead tr li dd dt option optgroup legend".split())
SCOPE = set("article aside blockquote body div dl td th table ul ol main section nav header footer form figure details fieldset html button object caption".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}

# What is never main text, by element, role and word of a class or id.
DROP = set("nav footer aside form script style noscript template iframe svg canvas button select input textarea dialog menu object embed head title video audio map link meta".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form status toolbar".split())
STRONG = set("ad ads adv advert adverts advertisement advertisements advertising adsense sponsored promo cookie cookies gdpr sidebar sidebars navbar topnav breadcrumb breadcrumbs comments commentlist comment-list disqus share sharing newsletter subscribe subscription popup modal login signup searchbox pagination pager paywall".split())
WORDS = STRONG | set("banner banners sponsor promotion consent notice notices alert alerts menu menus nav navigation comment reply replies respond discussion social related recommended recommendations overlay footer masthead toolbar".split())
PAGE_WORDS = set("header topbar site-header page-header".split())
GUARDED = set("html body main article p h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("div section nav aside ul ol dl table form header footer figure details span center".split())
MAIN_WORDS = {"content", "main", "article", "post", "entry", "story"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "digest", "size", "depth", "holds")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.digest, self.size, self.holds = 0, 0, False
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> Node:
    """A forgiving tree: implied ends of paragraphs, items and cells; stray end tags are ignored.

    One pass: the first tag with an open quote up to the end of the page turns quotes off for
    the rest, and a tag without an end takes the rest with it, as in browsers.
    """
    root = node = Node("html", {}, None)
    at, end, quoted = 0, len(page), True
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            node.kids.append(html.unescape(page[at:start]))
        if start == end:
            break
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith(("<!", "<?"), start):
            close = page.find(">", start)
            at = close + 1 if close >= 0 else end
            continue
        name = NAME.match(page, start)
        if not name:
            node.kids.append("<")
            at = start + 1
            continue
        tag, at = name[2].lower(), name.end()
        rest = REST.match(page, at) if quoted else None
        if rest:
            at, rest = rest.end(), rest[1]
        else:
            quoted, close = False, page.find(">", at)
            if close < 0:
                break
            at, rest = close + 1, page[at:close]
        if name[1]:
            up = node
            while up and up.tag != tag:
                up = None if up.tag in SCOPE and tag not in BLOCK else up.parent
            if up and up.parent:
                node = up.parent
            continue
        if tag in ("html", "body") and (tag == "html" or node is root):
            if tag == "body":
                node.kids.append(node := Node("body", attributes(rest), node))
            continue
        if tag in CLOSES_P:
            node = closed(node, {"p"})
        if tag in ENDED_BY:
            node = closed(node, ENDED_BY[tag])
        child = Node(tag, attributes(rest), node)
        node.kids.append(child)
        if tag in RAW:
            close = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not rest.endswith("/") and child.depth < MAX_DEPTH:
            node = child
    return root


def closed(node: Node, tags: set[str]) -> Node:
    """The node after open elements of ``tags`` within scope have ended."""
    up, found = node, None
    while up and up.parent:
        if up.tag in tags:
            found = up
        elif up.tag in SCOPE:
            break
        up = up.parent
    return found.parent if found else node


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def marks(node: Node) -> set[str]:
    return set(re.split(r"[\s_]+|(?<=[a-z])(?=[A-Z])", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".strip())) if node.attrs else set()


def words_of(names: set[str]) -> set[str]:
    return {w.lower() for name in names for w in (name, *name.split("-"))}


def shape(node: Node) -> int:
    """Digest of element, class and id, without the content."""
    return xxhash.xxh3_64_intdigest("\x1e".join(("shape", node.tag, node.attrs.get("class", ""), node.attrs.get("id", "")))) - (1 << 63)


def junk(node: Node, inside: bool, template: set[int]) -> bool:
    """Whether the element is known to be no main text; ``inside``: it lies in the article."""
    a = node.attrs
    if node.tag in DROP or (node.tag == "header" and not inside):
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*+:\s*+none", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    names = marks(node)
    if not inside:
        return (node.tag not in GUARDED or node.tag == "p") and bool(words_of(names) & (WORDS | PAGE_WORDS))
    if node.tag in GUARDED and node.tag != "article":
        return False
    return bool({n.lower() for n in names} & STRONG) or bool(words_of(names) & WORDS) and shape(node) in template


def measure(node: Node) -> None:
    """Digest and text size of every subtree, and whether it holds an article or main part; children first."""
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(k for k in n.kids if isinstance(k, Node))
    for n in reversed(order):
        parts, size = [n.tag, n.attrs.get("class", ""), n.attrs.get("id", "")], 0
        n.holds = n.tag in ("html", "body", "article", "main") or n.attrs.get("role", "").lower() == "main"
        for k in n.kids:
            if isinstance(k, Node):
                parts.append(str(k.digest))
                size += k.size
                n.holds = n.holds or (k.holds and k.tag not in DROP)
            elif words := k.split():
                parts.append(" ".join(words))
                size += sum(map(len, words))
        n.digest, n.size = xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63), size


def subtrees(root: Node) -> set[int]:
    """Digests of what can be template: blocks outside the article, containers inside, shapes of doubtful names."""
    out, stack = set(), [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag in ("article", "main")
        if n.size and not n.holds and (n.tag in CONTAINERS or (n.tag in BLOCK and not inside)):
            out.add(n.digest)
        if inside and n.attrs and n.tag not in GUARDED and words_of(marks(n)) & WORDS:
            out.add(shape(n))
        stack.extend((k, inside) for k in n.kids if isinstance(k, Node))
    return out


def without_templates(root: Node, template: set[int]) -> None:
    """Cuts template subtrees that lie outside article and main elements."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag in ("article", "main"):
            continue
        n.kids = [k for k in n.kids if isinstance(k, str) or k.holds or k.digest not in template]
        stack.extend(k for k in n.kids if isinstance(k, Node))


def outermost(root: Node, wanted) -> list[Node]:
    """First elements on each path that are wanted and not inside known junk, in page order."""
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        if n is not root and n.tag in DROP:
            continue
        if n is not root and wanted(n):
            if not junk(n, False, set()):
                found.append(n)
            continue
        stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return found


def main_parts(root: Node) -> tuple[list[Node], bool]:
    """The article, else the main part, else the body; and whether it is more than the body."""
    for wanted in (
        lambda n: n.tag == "article",
        lambda n: n.tag == "main" or n.attrs.get("role", "").lower() == "main",
        lambda n: n.tag in ("div", "section") and {w.lower() for name in marks(n) for w in name.split("-")} & MAIN_WORDS and not junk(n, False, set()),
    ):
        if (parts := outermost(root, wanted)) and any(p.size for p in parts):
            return parts, True
    return [root], False


def blocks(part: Node, inside: bool, template: set[int], cut: set[int]) -> list[str]:
    """Texts of the blocks in page order, without junk and the subtrees of ``cut``."""
    out, run = [], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [part]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            run.append(n)
        elif n is not part and (id(n) in cut or junk(n, inside, template)):
            if n.tag in BLOCK:
                flush()
        elif n.tag == "br":
            run.append(" ")
        else:
            if n.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(n.kids))
    flush()
    return out


def recurring(parts: list[Node], template: set[int]) -> set[int]:
    """Containers of the article that are template, unless they hold half of its text."""
    cut, size, stack = set(), 0, list(parts)
    while stack:
        n = stack.pop()
        if n not in parts and n.tag in CONTAINERS and n.digest in template:
            cut.add(id(n))
            size += n.size
        else:
            stack.extend(k for k in n.kids if isinstance(k, Node))
    return cut if 2 * size < sum(p.size for p in parts) else set()


def text_of(page: str | None, template: set[int]) -> str:
    if not page:
        return ""
    for known in (template, set()) if template else (template,):
        root = parse(page)
        measure(root)
        without_templates(root, known)
        parts, inside = main_parts(root)
        cut = recurring(parts, known) if inside else set()
        if text := "\n".join(b for p in parts for b in blocks(p, inside, known, cut)):
            return text
    return ""


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, content, page in zip(batch["host"], batch["content"], batch["html"], strict=True):
            if page:
                root = parse(page)
                measure(root)
                rows += [(host, content, digest) for digest in subtrees(root)]
        yield pd.DataFrame(rows, columns=["host", "content", "subtree"]).astype({"subtree": "int64", "content": "int64"})


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [text_of(page, set() if t is None else set(t)) for page, t in zip(batch["__html"], batch["__template"], strict=True)]
        yield pd.DataFrame({"page_id": batch["__id"], "url": batch["__url"], "text": texts})


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, content, subtree): the digests of each page; content names pages of equal html."""
    common.tune(pages.sparkSession)
    rows = pages.select(host_of(url_col).alias("host"), F.xxhash64(html_col).alias("content"), F.col(html_col).alias("html"))
    return rows.mapInPandas(_hashes, "host string, content long, subtree long").distinct()


def templates(seen: DataFrame) -> DataFrame:
    """(host, subtree): digests that recur on a host. Pages of equal content count once."""
    return seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAGES).select("host", "subtree")


def _with_template(rows: DataFrame, seen: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with digests of their host's template: all of them by broadcast after a check of their
    number, else those that the page has, so that no list is longer than a page's."""
    if found.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        lists = found.groupBy("host").agg(F.collect_set("subtree").alias("__template"))
        return rows.join(F.broadcast(lists), rows["__host"] == lists["host"], "left")
    lists = common.stored(seen.join(found, ["host", "subtree"]).groupBy("host", "content").agg(F.collect_set("subtree").alias("__template")))
    return rows.join(lists, (rows["__host"] == lists["host"]) & (rows["__content"] == lists["content"]), "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    seen = page_subtrees(pages, url_col, html_col)
    found = common.stored(templates(seen))
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"), host_of(url_col).alias("__host"), F.xxhash64(html_col).alias("__content"))
    joined = _with_template(rows, seen, found).select("__id", "__url", "__html", "__template")
    out = joined.mapInPandas(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
