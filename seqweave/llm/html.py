"""Main text of web pages by wrapper induction.

Pages of a host follow one template. REFERENCES different pages of each host (those of the smallest hashes, all if there
are fewer) are turned into element trees and aligned two at a time by simple tree matching: nodes of one tag are paired by
the order-preserving alignment of their children that matches most nodes. Elements and texts that all references share are
the template's constant nodes; texts that vary are its slots. Runs of like siblings (paragraphs, list items, rows) are one
repeated node, so long pages stay cheap; the texts of its items are constant if they are in the run of every page.

The content is the deepest template node that holds most of the varying text. Links do not count, neither does text in
elements that are menus, forms or footers by tag; marks of the article (article, main, role, itemprop) count in favour of
a node and words like `sidebar` in its class against it, but neither decides alone. Where the references agree in most of
the content node itself, they are copies of one article, and nothing in it is taken for template. Each page of the host is aligned with
the template in turn; its text is that of the node paired with the content node, without what falls on constant texts,
and without menus, forms, asides, adverts and reader comments nested inside.

Pages that a template cannot place (too few pages of the host, another layout) fall back on the marks, then on all
that is outside of menus, headers and footers.

Defined results: null and empty pages have an empty text, so do pages without content; a host of fewer than LEAST
different pages has no template; cut-off pages are read as far as they go; repeated rows are treated alike; null urls
are one host; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.llm.common import reliable, small
from seqweave.llm.urlfilter import parsed

REFERENCES, LEAST = 8, 3
#: Deeper elements are taken as children of the one at this depth. A node goes on to its largest child while that holds this share of the text.
DEPTH, SHARE = 150, 0.7
#: Child lists with more pairs than CELLS are cut at subtrees that are equal and single in both, and in pieces of PIECE pairs.
CELLS, PIECE = 10_000, 1024
#: How much the text of a node counts that is marked as an article, and of one that is named as boilerplate.
MARKED, NAMED = 2, 0.25
#: Like siblings in a row that become one repeated node: any number of these elements, else this many.
REPEATED, RUN = frozenset("p li dt dd tr option h1 h2 h3 h4 h5 h6".split()), 4

# Element names of HTML, and words that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math object canvas audio video select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside form menu button dialog fieldset".split()) | RAW
CLOSED_BY = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "option", "optgroup", "legend", "summary"}
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions".split())
BOILERPLATE = ADVERTS | frozenset(
    "banner banners sidebar sidebars nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer masthead comment comments respond disqus cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations widget "
    "widgets toolbar pagination pager search login skip copyright disclaimer reactions replies".split()
)
#: Words that may stand beside those in a name.
BESIDE = frozenset("list box area wrapper wrap container section site page block inner outer item items top bottom left right link links bar panel group unit slot main primary secondary global user reader".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Never boilerplate by their class or id: what a heading or an inline element is called says what it is about.
NAMED_FREELY = frozenset("html body article main h1 h2 h3 h4 h5 h6 b i em strong a span q cite code mark u s small sub sup time abbr dfn kbd".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    """An element. drop: no content by its tag or attributes; named: by a word in its class or id only; main: marked as content."""

    __slots__ = ("tag", "kids", "drop", "named", "main")

    def __init__(self, tag: str, drop: bool = False, named: bool = False, main: bool = False):
        self.tag, self.kids, self.drop, self.named, self.main = tag, [], drop, named, main


@lru_cache(4096)
def judged(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    drop, named, main = tag in DROPPED, False, tag in ("article", "main")
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            named |= any(boilerplate(tag, word) for word in value.split())
        elif name == "role":
            drop |= value in ROLES
            main |= value in ("main", "article")
        elif name == "itemprop":
            main |= value == "articlebody"
        else:
            drop |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    return drop and tag not in ("html", "body"), named, main


def boilerplate(tag: str, name: str) -> bool:
    """Whether a name says boilerplate: words of that kind, and no others but those that say nothing. Of paragraphs, only adverts."""
    words = {w for w in PARTS.split(name) if w and not w.isdigit()}
    kind = ADVERTS if tag == "p" else BOILERPLATE
    return tag not in NAMED_FREELY and bool(words & kind) and words <= BOILERPLATE | BESIDE


def tree(html: str) -> Node:
    """The element tree. Text is decoded; elements that never hold content are left out."""
    root = Node("#")
    stack, at, end = [root], 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if not m:
            add_text(stack[-1], html[at:])
            break
        if m.start() > at:
            add_text(stack[-1], html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
            continue
        if tag in CLOSED_BY:
            names, limits = CLOSED_BY[tag]
            shut(stack, names.split(), limits)
        if tag in ENDS_P:
            shut(stack, ["p"], {"article", "main", "td", "th", "li", "div", "section", "body", "blockquote"})
        node = Node(tag, *judged(tag, attributes))
        stack[-1].kids.append(node)
        if tag not in VOID and not attributes.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return root


def add_text(node: Node, text: str) -> None:
    text = unescape(text)
    if node.kids and isinstance(node.kids[-1], str):
        node.kids[-1] += text
    else:
        node.kids.append(text)


def shut(stack: list[Node], names: list[str], limits: set[str]) -> None:
    """Closes the nearest open element of these names, unless one of the limits is nearer."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in names:
            del stack[k:]
            return
        if stack[k].tag in limits:
            return


def plain(text: str) -> str:
    return " ".join(text.split())


# Trees to align: [tag, volume, weight, child, ...], with the volume of the text below, links apart; a child is such a list, a
# string, None (a slot), or for a run [tag*, volume, set of constant texts].
KIDS = 3


class Shape:
    """A page's tree as one to align, and the page's nodes behind its lists: of an element one, of a run several."""

    def __init__(self, root: Node):
        self.nodes: dict[int, list[Node]] = {}
        self.tree = self.shaped(root, False)

    def shaped(self, node: Node, link: bool) -> list:
        link |= node.tag == "a" or node.drop
        out: list = [node.tag, 0, MARKED if node.main else NAMED if node.named else 1]
        for items in runs(node.kids):
            x = items[0]
            if isinstance(x, str):
                if t := plain(x):
                    out.append(t)
                    out[1] += 0 if link else len(t)
                continue
            if len(items) > 1 or x.tag in REPEATED:
                texts = [plain(words_of(y)) for y in items]
                x = [x.tag + "*", 0 if link else sum(len(t) for y, t in zip(items, texts) if not y.drop), {t for t in texts if t}]
                self.nodes[id(x)] = items
            else:
                x = self.shaped(x, link)
            out.append(x)
            out[1] += x[1]
        self.nodes[id(out)] = [node]
        return out


def runs(kids: list):
    """The children in lists, of like siblings in a row or of one; blank text between like siblings is passed over."""
    k, n = 0, len(kids)
    while k < n:
        x = kids[k]
        items = [x]
        end = k + 1
        if not isinstance(x, str):
            like = likeness(x)
            for j in range(k + 1, n):
                y = kids[j]
                if isinstance(y, str):
                    if y.strip():
                        break
                elif likeness(y) != like or y.main:
                    break
                else:
                    items.append(y)
                    end = j + 1
            if x.tag not in REPEATED and len(items) < RUN:
                items, end = [x], k + 1
        yield items
        k = end


def likeness(x: Node):
    return x.tag if x.tag in REPEATED else (x.tag, frozenset(y.tag for y in x.kids if not isinstance(y, str)))


def words_of(x) -> str:
    return x if isinstance(x, str) else " ".join(map(words_of, x.kids))


class Aligner:
    """Simple tree matching of pairs of shapes; what pairs of subtrees give is computed once."""

    def __init__(self):
        self.known: dict = {}

    def weight(self, a, b) -> int:
        """How many nodes of a and b are paired; equal texts count double."""
        if not isinstance(a, list):
            return 0 if isinstance(b, list) else 2 if a == b else 1
        if not isinstance(b, list) or a[0] != b[0]:
            return 0
        if a[0].endswith("*"):
            return 1 + 2 * len(a[2] & b[2])
        return 1 + sum(w for _, _, w in self.pairs(a, b))

    def pairs(self, a: list, b: list) -> list[tuple[int, int, int]]:
        """The children of a and b that are paired, as indices, with their weights."""
        key = id(a), id(b)
        if key not in self.known:
            self.known[key] = [x for span in cut(a, b) for x in self.aligned(a, b, *span)]
        return self.known[key]

    def aligned(self, a, b, alo, ahi, blo, bhi):
        table = [[0] * (bhi - blo + 1)]
        for i in range(alo, ahi):
            last, row, x = table[-1], [0], a[i]
            for j in range(blo, bhi):
                row.append(max(last[j - blo + 1], row[-1], last[j - blo] + self.weight(x, b[j])))
            table.append(row)
        i, j, out = ahi - alo, bhi - blo, []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((alo + i, blo + j, table[i + 1][j + 1] - table[i][j]))
        return out[::-1]


def cut(a: list, b: list):
    """Spans of the children of a and b that are aligned with each other: all at once if the table has up to CELLS cells.

    Else children that are equal, and single in both, are paired where they come in the same order in both (the longest such
    sequence), and spans between them are halved, down to tables of PIECE cells. So the cost is linear in long lists.
    """
    todo = [(KIDS, len(a), KIDS, len(b))]
    if (len(a) - KIDS) * (len(b) - KIDS) > CELLS:
        ka, kb = [frozen(x) for x in a[KIDS:]], [frozen(x) for x in b[KIDS:]]
        single = (set(ka) & set(kb)) - repeats(ka) - repeats(kb)
        place = {k: j for j, k in enumerate(kb) if k in single}
        todo, ai, bj = [], KIDS, KIDS
        for i, j in rising([(i, place[k]) for i, k in enumerate(ka) if k in single]):
            todo += [(ai, i + KIDS, bj, j + KIDS), (i + KIDS, i + KIDS + 1, j + KIDS, j + KIDS + 1)]
            ai, bj = i + KIDS + 1, j + KIDS + 1
        todo.append((ai, len(a), bj, len(b)))
        todo.reverse()
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            if (ahi - alo) * (bhi - blo) > PIECE:
                i, j = (alo + ahi) // 2, (blo + bhi) // 2
                todo += [(i, ahi, j, bhi), (alo, i, blo, j)]
            else:
                yield alo, ahi, blo, bhi
    else:
        yield todo[0]


def repeats(keys: list) -> set:
    seen: set = set()
    return {k for k in keys if k in seen or seen.add(k)}


def frozen(x):
    """A subtree as a hashable value."""
    if isinstance(x, list):
        return hash((x[0], frozenset(x[2]))) if x[0].endswith("*") else hash((x[0], *map(frozen, x[KIDS:])))
    return hash(x)


def rising(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of points, given by rising first number, whose second number rises too."""
    from bisect import bisect_left

    ends: list[int] = []
    last: list[int] = []
    before = []
    for at, (_, j) in enumerate(points):
        k = bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [j], [at]
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(points[at])
        at = before[at]
    return out[::-1]


def common(a: list, b: list, by: Aligner) -> list:
    """The template of two aligned trees: texts that differ become slots, volumes add up."""
    if a[0].endswith("*"):
        return [a[0], a[1] + b[1], a[2] & b[2]]
    out: list = [a[0], a[1] + b[1], max(a[2], b[2])]
    for i, j, _ in by.pairs(a, b):
        x, y = a[i], b[j]
        out.append(common(x, y, by) if isinstance(x, list) else x if x == y else None)
    return out


def constant(x, inside: bool = False) -> int:
    """The volume of a template's constant texts, links apart; unless `inside`, also apart from what is marked as an article."""
    if not isinstance(x, list):
        return len(x or "")
    if x[0].endswith("*"):
        return sum(map(len, x[2])) if x[1] else 0
    return 0 if x[0] == "a" or not x[1] or x[2] == MARKED and not inside else sum(constant(y, inside) for y in x[KIDS:])


def loosened(x):
    """A template without constant texts."""
    if not isinstance(x, list):
        return None
    return [x[0], x[1], set()] if x[0].endswith("*") else [*x[:KIDS], *map(loosened, x[KIDS:])]


def induced(pages: list[str]) -> str | None:
    """The wrapper of pages of a host, as JSON: the template, and the path to its content node. None if there is none."""
    n = len(pages)
    if n < LEAST:
        return None
    shapes = [Shape(tree(p)) for p in pages]
    shared = shapes[0].tree
    for other in shapes[1:]:
        shared = common(shared, other.tree, Aligner())

    def varying(x: list) -> float:
        return x[1] - n * constant(x)

    path, above, at = [], None, shared
    while True:
        lists = [k for k in range(KIDS, len(at)) if isinstance(at[k], list) and not at[k][0].endswith("*")]
        best = max(lists, key=lambda k: varying(at[k]) * at[k][2], default=None)
        if best is None or varying(at[best]) * at[best][2] < SHARE * varying(at):
            break
        path.append(best)
        above, at = at, at[best]
    if not path or varying(at) <= 0:
        return None
    if 2 * n * constant(at, True) > at[1]:  # the references are copies of one article
        above[path[-1]] = loosened(at)
    return json.dumps([shared, path], ensure_ascii=False, separators=(",", ":"), default=sorted)


@lru_cache(64)
def wrapper_of(text: str) -> tuple[list, list[int]]:
    def sets(x):
        if isinstance(x, list):
            return [x[0], x[1], set(x[2])] if x[0].endswith("*") else [*x[:KIDS], *map(sets, x[KIDS:])]
        return x

    template, path = json.loads(text)
    return sets(template), path


def content(root: Node, wrapper: str) -> Node | None:
    """The page's node that the wrapper's content node is paired with, emptied of the template's constant texts."""
    at, path = wrapper_of(wrapper)
    shape, by = Shape(root), Aligner()
    page = shape.tree
    for k in path:
        i = next((i for i, j, _ in by.pairs(page, at) if j == k), None)
        if i is None:
            return None
        page, at = page[i], at[k]
    found = shape.nodes[id(page)][0]
    emptied(page, at, shape, by)
    return found


def emptied(page: list, template: list, shape: Shape, by: Aligner) -> None:
    """Takes texts of the page that fall on constant texts of the template out of its nodes."""
    if page[0].endswith("*"):
        for x in shape.nodes[id(page)]:
            if plain(words_of(x)) in template[2]:
                x.kids = []
        return
    node = shape.nodes[id(page)][0]
    for i, j, _ in by.pairs(page, template):
        if isinstance(template[j], list):
            emptied(page[i], template[j], shape, by)
        elif template[j] is not None and page[i] == template[j]:
            node.kids = [" " if isinstance(x, str) and plain(x) == page[i] else x for x in node.kids]


def blocks(node: Node, inside: bool, out: list[list[str]]) -> None:
    """Adds the node's blocks to out, each a list of pieces; the last one is open."""
    for x in node.kids:
        if isinstance(x, str):
            out[-1].append(x)
        elif x.tag == "br":
            out[-1].append(" ")
        elif not ((x.drop or x.named) and not holds_main(x)) and (inside or x.tag != "header"):
            if x.tag in BLOCK:
                out.append([])
                blocks(x, inside, out)
                out.append([])
            else:
                blocks(x, inside, out)


def holds_main(node: Node) -> bool:
    """Whether something below is marked as main content, so that the node is a wrapper."""
    return not node.drop and any(not isinstance(x, str) and (x.main and not x.drop or holds_main(x)) for x in node.kids)


def mains(node: Node) -> list[Node]:
    out = []
    for x in node.kids:
        if not isinstance(x, str) and not ((x.drop or x.named) and not x.main and not holds_main(x)):
            out += [x] if x.main else mains(x)
    return out


def main_text(html: str | None, wrapper: str | None = None) -> str:
    if not html:
        return ""
    root = tree(html)
    if wrapper and (node := content(root, wrapper)) and (text := joined([node], True)):
        return text
    roots = mains(root)
    return roots and joined(roots, True) or joined([root], False)


def joined(nodes: list[Node], inside: bool) -> str:
    out: list[list[str]] = [[]]
    for n in nodes:
        out.append([])
        blocks(n, inside, out)
    return "\n\n".join(t for t in (plain("".join(b)) for b in out) if t)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, for hosts that have one; of REFERENCES different pages of each host, whatever its size.

    The window keeps so many hashes of a host in each task before the shuffle.
    """
    rows = pages.filter(F.col("html").isNotNull()).select(F.coalesce(parsed(F.col("url"))[0], F.lit("")).alias("host"), F.xxhash64("html").alias("h"), "html")
    nth = F.row_number().over(W.partitionBy("host").orderBy("h"))
    least = rows.select("host", "h").distinct().withColumn("nth", nth).filter(F.col("nth") <= REFERENCES)
    least = reliable(least.select(F.col("host").alias("host_"), F.col("h").alias("h_")))
    chosen = rows.join(small(least), (F.col("host") == F.col("host_")) & (F.col("h") == F.col("h_"))).dropDuplicates(["host", "h"]).select("host", "h", "html")

    def induce(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": pdf.host[:1], "wrapper": [induced(pdf.sort_values("h").html.tolist())]})

    return chosen.groupBy("host").applyInPandas(induce, "host string, wrapper string").filter("wrapper is not null")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = reliable(wrappers(pages))
    rows = pages.select("page_id", "url", "html", F.coalesce(parsed(F.col("url"))[0], F.lit("")).alias("host")).join(small(found, most=10_000), "host", "left")

    def run(batches):
        for b in batches:
            text = [main_text(h, t) for h, t in zip(b.html, b.wrapper)]
            yield pd.DataFrame({"page_id": b.page_id, "url": b.url, "text": text, "n_chars": np.fromiter(map(len, text), np.int64, len(text))})

    kind = dict(pages.dtypes)["page_id"]
    return rows.select("page_id", "url", "html", "wrapper").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
