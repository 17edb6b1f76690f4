"""Main text of web pages with a site style tree.

The pages of one host are merged into a tree whose element nodes are paths of tags and classes.
Of each node the tree knows in how many pages it occurs, with which presentations (sequences of
children) and which contents.  What looks and reads the same in all pages is template, what
differs is content: the importance of a node is the entropy of its contents, mixed with that of
its presentation and of its children, from 0 (the same everywhere) to 1 (always different).

Roles that a page declares shift a node's importance, and the threshold then decides on every
branch.  Elements for menus, adverts, comments and the like lose more than any importance can make
up for; one whose class merely contains such a word (``share-price``) loses half a point.  Where
most of the page's text stands in declared articles they gain, and all else loses, the more the larger
that share; a page whose text is one article is cut to it.  Where most stands elsewhere the articles,
as teaser cards beside a story, lose instead.  A
form or wrapper that holds a declared article is judged by its parts.

The tree is a table of node statistics, counted by Spark with partial sums, so a host that has
a third of all pages burdens no task.  Pages meet only the nodes that they have themselves.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.llm.common import named, small_batches
from glyphmill.session import written

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no markup.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style noscript textarea title iframe xmp noframes".split()}
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# An opening tag ends an open element of these, up to the nearest of those.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = set("aside button canvas dialog footer form head iframe map menu nav noscript object audio video select svg template textarea title script style".split())
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related replies respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Class words that only say how a box is laid out.
LAYOUT_WORDS = set(
    "area bar block body bottom box btn button buttons card cell center col column container content controls fixed footer form full global group header inner item items js "
    "left link links list main mobile module outer panel position primary right row secondary section sidebar site slot small space sticky tabs text title top unit wrap wrapper zone".split()
)
LOW, GAMMA = 0.2, 0.9
# What roles add to an importance between 0 and 1.
STRONG, WEAK, DECLARED = -4.0, -0.5, 1.5


@dataclass
class Node:
    parent: int
    step: str
    role: str = ""
    content: str = ""
    children: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape((m[2] or "").strip("\"'")) for m in reversed(list(_ATTRIBUTE.finditer(text)))} if text.strip() else {}


def _role(name: str, own: dict[str, str]) -> tuple[str, str]:
    """The role that an element declares (tag, form, word, weak, header or none), and what content."""
    content = name if name in ("article", "main") else own.get("role", "").lower() if own.get("role", "").lower() in ("article", "main") else ""
    if name in DROPPED or "hidden" in own or own.get("aria-hidden", "").lower() == "true":
        return ("form" if name == "form" else "tag"), content
    role = ""
    for token in f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}".lower().split():
        words = set(filter(None, re.split(r"[^a-z]+", token)))
        if words & DROPPED_WORDS and name not in ("html", "body"):
            if words <= DROPPED_WORDS | LAYOUT_WORDS:
                return "word", content
            role = "weak"
        elif "header" in words and not role:
            role = "header"
    return ("header" if name == "header" else role), content


class Page:
    """A page as nodes and blocks of text, in page order."""

    def __init__(self, html: str):
        self.nodes = [Node(-1, "")]
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._open: list[str] = []
        self._read(html)
        self._flush()
        self._settle()

    def _flush(self) -> None:
        text = " ".join("".join(self._open).split())
        self._open.clear()
        if text:
            at = self._stack[-1][1]
            self.blocks.append((at, text))
            self.nodes[at].texts.append(text)

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = _MARKUP.search(html, at)
            self._open.append(_html.unescape(html[at : m.start() if m else len(html)]))
            if not m:
                return
            at = m.end()
            if m[1]:
                self._end(m[1].lower())
            elif m[2]:
                name = m[2].lower()
                self._start(name, m[3])
                if name in RAW:
                    end = RAW[name].search(html, at)
                    at = end.start() if end else len(html)

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._open.append(" ")
            return
        if name in VOID:
            if name == "hr":
                self._flush()
                self._close({"p"}, {"article", "body"})
            return
        own = _attributes(attributes)
        role, content = _role(name, own)
        if name in INLINE and not role and not content:
            return
        self._flush()
        if name in CLOSES_P:
            self._close({"p"}, {"td", "th", "article", "button"})
        if name in ENDS:
            self._close(*ENDS[name])
        up = self._stack[-1][1]
        step = ".".join([name, *sorted(own.get("class", "").split())])
        self.nodes[up].children.append(step)
        self.nodes.append(Node(up, step, role, content))
        self._stack.append((name, len(self.nodes) - 1))

    def _close(self, names: set[str], upto: set[str]) -> None:
        """End the outermost open element of these names below the nearest of the others."""
        found = None
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in names:
                found = k
            elif self._stack[k][0] in upto:
                break
        if found:
            del self._stack[found:]

    def _end(self, name: str) -> None:
        if name == "br":
            self._open.append(" ")
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == name:
                self._flush()
                del self._stack[k:]
                return
        if name not in INLINE:
            self._flush()

    def _settle(self) -> None:
        """What roles add to each node's importance, and which nodes hold declared content and are judged by their parts."""
        own = [n.content if n.role not in ("tag", "word") else "" for n in self.nodes]
        self.holds, inside = [k == 0 for k in range(len(self.nodes))], []
        self.lost = lost = []
        for k, node in enumerate(self.nodes):
            at = node.parent
            while own[k] and at >= 0 and not self.holds[at]:
                self.holds[at] = True
                at = self.nodes[at].parent
        for k, node in enumerate(self.nodes):
            up = node.parent
            inside.append({own[k]} | (inside[up] if up >= 0 else set()))
            free = self.holds[k] or node.role == "header" and up >= 0 and inside[up] != {""}
            strong = node.role == "tag" or node.role in ("form", "word", "header") and not free
            lost.append(strong or up >= 0 and lost[up])
        # An article outweighs the main part around it.
        there = {kind for k in range(len(self.nodes)) if not lost[k] for kind in inside[k]}
        declared = next((kind for kind in ("article", "main") if kind in there), None)
        self.shift = [STRONG if lost[k] else WEAK if node.role == "weak" and not self.holds[k] else 0.0 for k, node in enumerate(self.nodes)]
        if declared:
            sizes = [(len(text), declared in inside[k]) for k, text in self.blocks if not lost[k]]
            total = sum(n for n, _ in sizes)
            lead = 2 * sum(n for n, within in sizes if within) / total - 1 if total else 0.0
            for k in range(len(self.nodes)):
                self.shift[k] += DECLARED * (lead if declared in inside[k] else -max(lead, 0.0))

    def keys(self, host: str) -> list[int]:
        """The site tree's node of each node: the path of steps from the root, on that host."""
        states = []
        for node in self.nodes:
            states.append(xxhash.xxh64_intdigest(f"{states[node.parent] if node.parent >= 0 else host}>{node.step}") - (1 << 63))
        return states

    def statistics(self, host: str) -> Iterator[tuple[int, int, int]]:
        """``(node, kind, value)``, once per page: kind 0 a presentation, kind 1 a content."""
        style: dict[int, list[str]] = {}
        content: dict[int, list[str]] = {}
        for key, node in zip(self.keys(host), self.nodes):
            runs = [s for s, before in zip(node.children, [None, *node.children]) if s != before]
            style.setdefault(key, []).append(",".join(runs))
            content.setdefault(key, []).extend(node.texts)
        for kind, values in ((0, style), (1, content)):
            for key, own in values.items():
                if own:
                    yield key, kind, xxhash.xxh64_intdigest("\n".join(own)) - (1 << 63)

    def importance(self, keys: list[int], tree: dict[int, tuple[float, int, float | None]]) -> list[float]:
        """Of each node, from the leaves up: its contents' entropy, or its children's mean mixed with its presentation's."""
        below: list[list[float]] = [[] for _ in self.nodes]
        out = [1.0] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            presentation, styles, content = tree.get(keys[k], (1.0, 1, None))
            own = below[k] + ([content] if self.nodes[k].texts and content is not None else [])
            if own:
                weight = 1 - GAMMA**styles if below[k] else 0.0
                out[k] = (1 - weight) * sum(own) / len(own) + weight * presentation
            else:
                out[k] = presentation
            if self.nodes[k].parent >= 0:
                below[self.nodes[k].parent].append(out[k])
        return out

    def main_text(self, importance: list[float], low: float = LOW) -> tuple[str, float]:
        """The blocks of branches whose shifted importance is not low, and the mean importance that the site's tree gives them."""
        gone: list[bool] = []
        for k, node in enumerate(self.nodes):
            own = self.lost[k] or importance[k] + self.shift[k] < low and not self.holds[k]
            gone.append(own or node.parent >= 0 and gone[node.parent])
        kept = [(k, text) for k, text in self.blocks if not gone[k] and importance[k] + self.shift[k] >= low]
        return "\n".join(t for _, t in kept), sum(importance[k] for k, _ in kept) / len(kept) if kept else 0.0


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[int, str, Page]]:
    for row, url, text in zip(*(batch.column(n).to_pylist() for n in ("row", "url", "html"))):
        yield row, host_of(url), Page(text or "")


def _tree_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html"):
        counts = Counter(x for _, host, page in _pages(batch) for x in page.statistics(host))
        columns = list(zip(*counts)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns], pa.array(list(counts.values()), pa.int64())], ["node", "kind", "value", "n"]
        )


def site_tree(pages: DataFrame) -> DataFrame:
    """``node, presentation, styles, content``: the merged trees' importance statistics, one row per node of a host.

    An entropy is taken to the base of the number of pages; with one page it is 1.
    """
    counts = pages.mapInArrow(_tree_counts, "node long, kind long, value long, n long").groupBy("node", "kind", "value").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")

    def entropy(kind: int):
        pages_with = F.sum(F.when(F.col("kind") == kind, n))
        inner = F.sum(F.when(F.col("kind") == kind, n * F.log(n)))
        return F.when(pages_with > 1, (F.log(pages_with) - inner / pages_with) / F.log(pages_with)).when(pages_with == 1, 1.0)

    return counts.groupBy("node").agg(
        entropy(0).alias("presentation"), F.count_if(F.col("kind") == 0).cast("int").alias("styles"), entropy(1).alias("content")
    )


TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("importance", T.DoubleType())])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _node_keys(urls: pa.Array, pages: pa.Array) -> pa.Array:
    return pa.array([sorted(set(Page(p or "").keys(host_of(u)))) for u, p in zip(urls.to_pylist(), pages.to_pylist())], pa.list_(pa.int64()))


@F.arrow_udf(TEXT)
def _texts(urls: pa.Array, pages: pa.Array, nodes: pa.Array) -> pa.Array:
    out = []
    for url, html, own in zip(urls.to_pylist(), pages.to_pylist(), nodes.to_pylist()):
        page = Page(html or "")
        tree = {n["node"]: (n["presentation"], n["styles"], n["content"]) for n in own or []}
        text, importance = page.main_text(page.importance(page.keys(host_of(url)), tree))
        out.append({"text": text, "importance": importance})
    return pa.array(out, to_arrow_type(TEXT))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, importance`` per row.

    * null or empty html: empty text; null url: the pages without a host are one site;
    * null page_id: keeps its row; repeated rows each get their row and count as pages of their own;
    * unclosed and stray tags follow the usual rules; a page cut off in a tag loses that tag only;
    * no rows give no rows; other columns are ignored, whatever their names.
    """
    rows = named(pages, page_id=id_col, url=url_col, html=html_col).withColumn("row", F.monotonically_increasing_id())
    tree = written(site_tree(rows), "site-tree")
    wanted = rows.select("row", F.explode(_node_keys("url", "html")).alias("node"))
    met = wanted.join(tree, "node").groupBy("row").agg(F.collect_list(F.struct("node", "presentation", "styles", "content")).alias("nodes"))
    found = rows.join(met, "row", "left").withColumn("_t", _texts("url", "html", "nodes"))
    return found.select("page_id", "url", "_t.text", "_t.importance")
