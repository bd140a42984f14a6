"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in a block is a node with a hidden
label: a run is main text or not, an element holds main text or not. Potentials
between parent and child depend on the child's kind (a telling word of its class or
id, else its tag) and on the sort of its parent (a frame of the page, a plain container,
or an element of text). Text runs have evidence from the element around them, their
length, the share of link text and their last character; it counts by the run's length,
so that short runs don't outweigh sentences. The potentials are smoothed counts over
labelled pages, gathered by Spark. On a page, sum-product messages pass from the leaves to
the root and back, which yields each node's exact marginal; runs whose marginal is at least
one half are kept. All pages of a batch pass messages together, one tree level at a time.

A name of several words tells its kind only if its other words say nothing ("site-nav-box");
with further words ("river-navigation-history") it is a kind of its own, of which the labelled
pages have both sorts. Line breaks, images, ruby and unknown hyphenated elements don't end a run.

Defined cases: null, empty and text-free pages give an empty string; markup may be
badly nested, and a tag or comment cut off by the end of the page is left out; a quote
that is not the beginning of an attribute's value is an ordinary character; white space
(also non-breaking) is collapsed; very long and very deep pages are handled whole, one
at a time; a marginal of exactly one half counts as main text; repeated rows give
repeated rows; an empty table gives no rows; further columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces
from .labelled_pages import labelled_pages

#: Fixed values of HTML: elements by their role.
VOID = frozenset("base col embed hr input link meta param".split())
RAW = frozenset("script style noscript template svg iframe object canvas math textarea".split())
INLINE = frozenset("a abbr acronym area audio b bdi bdo big br cite code data del dfn em font i img ins kbd map mark nobr picture q rb rp rt rtc ruby s samp small source span strike strong sub sup time track tt u var video wbr".split())
TAGS = "html head title body header nav main article section aside footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset label button select option address details summary hgroup center".split()
#: Elements whose tag says more than a name with further words.
OWN_KIND = frozenset("article main nav header footer aside form p h1 h2 h3 h4 h5 h6 li".split())
#: A start tag ends an open element of these kinds, up to a boundary.
CLOSES = {t: ("p",) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
CLOSES |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "body": ("head",)}
BOUNDS = frozenset("html body article aside div section main nav header footer ul ol dl table form blockquote figure select".split())
#: Telling words of class and id names, in the order in which they are tried.
NAME_KINDS = {
    "comment": "comments?|disqus|reply|replies|responses?|discussion",
    "ad": "ads?|advert[a-z]*|sponsor(?:s|ed)?|promo[a-z]*|banner",
    "notice": "cookies?|notices?|consent|alert|popup|modal|newsletter|subscribe|subscription|gdpr",
    "side": "sidebar|side|widgets?|rail|related|shar(?:e|ing)|social|recommend[a-z]*",
    "menu": "menu|nav|navigation|breadcrumbs?|toc|pagination|pager",
    "foot": "foot|footer|copyright|legal",
    "head": "header|masthead|topbar",
    "main": "article|post|entry|story|stories|content|body|text|main",
}
#: Words beside a telling one that say nothing, and telling words that say little beside another.
FILLERS = "site|page|box|wrap|wrapper|inner|outer|block|container|area|section|list|item|items|group|panel|row|col|column|bar|top|bottom|left|right|global|primary|secondary|the"
WEAK = "content|body|text|main"
_NAME_WORDS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_FILLER = re.compile(f"(?:{FILLERS})+|[a-z]")
_WEAK = re.compile(f"(?:{WEAK})")
_NAME_KINDS = {k: re.compile(f"(?:{FILLERS})?(?:{words})(?:{FILLERS})?") for k, words in NAME_KINDS.items()}
_BASE_KINDS = [*TAGS, *(f"#{k}" for k in NAME_KINDS), *(f"?{k}" for k in NAME_KINDS), "other", "text"]
KINDS = {k: i for i, k in enumerate(_BASE_KINDS)}
#: Sorts of parents: 0 frames, 1 plain containers, 2 all else. A node's kind is its own one by its parent's sort.
SORTS = 3
_SORT = [0 if k in ("html", "body", "head", "center", "form") else 1 if k in ("div", "section", "main", "other", "table", "tbody", "tr", "td", "fieldset") or k[0] == "?" else 2 for k in KINDS]
N_EDGES = len(KINDS) * SORTS
#: Elements around a run of text, by what they say of it.
AROUND = ("h1 h2", "h3 h4 h5 h6", "p blockquote pre", "ul ol li dl dt dd", "table tbody tr td th", "caption figcaption figure", "label button option select")
_AROUND = [next((i + 1 for i, tags in enumerate(AROUND) if k in tags.split()), 0) for k in KINDS]
#: Bounds of the lengths of runs, and how much the evidence of each length counts.
LENGTHS = (8, 25, 60, 150, 400)
WEIGHTS = (0.1, 0.25, 0.6, 1, 1, 1)
N_FEATURES = (len(AROUND) + 1) * len(WEIGHTS) * 3 * 2


@lru_cache(1 << 14)
def named_kind(names: str) -> str | None:
    """``#kind`` where a name tells the kind, ``?kind`` where it has further words, else None."""
    sure, unsure = set(), set()
    for name in names.split():
        kinds, further = [], False
        for word in _NAME_WORDS.findall(_CAMEL.sub(" ", name)):
            word = word.lower()
            kind = next((k for k, p in _NAME_KINDS.items() if p.fullmatch(word)), None)
            if kind:
                kinds.append((bool(_WEAK.fullmatch(word)), kind))
            elif not _FILLER.fullmatch(word):
                further = True
        if kinds:
            strong = [k for weak, k in kinds if not weak] or [k for _, k in kinds]
            (unsure if further else sure).add(strong[-1])
    for mark, found in (("#", sure), ("?", unsure)):
        for kind in NAME_KINDS:
            if kind in found:
                return mark + kind
    return None


#: Comments; tags (quotes open a value only right after an equals sign); declarations; tags whose quote is never closed; markup cut off by the end.
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|{_VALUE})*+)>|<(?:[!?]|/[^a-zA-Z>])[^>]*+>|</>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<(?:/?[a-zA-Z]|[!?])[^>]*+\Z",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MARK = re.compile(r"data-main\s*=\s*\"([01])\"")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
#: Only these may close themselves by a slash.
_FOREIGN = ("svg", "math")


class Trees:
    """The nodes of several pages: parents always stand before their children."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.kind: list[int] = []
        self.mark: list[int] = []  # 0 or 1 where a labelled page says so, else -1
        self.text: dict[int, str] = {}
        self.linked: dict[int, int] = {}
        self.roots: list[int] = []

    def add(self, parent: int, kind: int, mark: int = -1) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind * SORTS + (_SORT[self.kind[parent] // SORTS] if parent >= 0 else 0))
        self.mark.append(mark)
        return len(self.parent) - 1

    def read(self, html: str) -> None:
        """Adds one page."""
        root = self.add(-1, KINDS["html"])
        self.roots.append(root)
        stack: list[tuple[str, int]] = [("html", root)]
        run: list[str] = []
        links = in_link = 0

        def close_run() -> None:
            nonlocal links
            if run:
                text = " ".join("".join(run).split())
                if text:
                    node = self.add(stack[-1][1], KINDS["text"])
                    self.text[node], self.linked[node] = text, links
                run.clear()
            links = 0

        def words(piece: str) -> None:
            nonlocal links
            if piece:
                run.append(unescape(piece) if "&" in piece else piece)
                if in_link:
                    links += len(piece)

        at, search = 0, _TOKEN.search
        while (found := search(html, at)) is not None:
            words(html[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
            if name in RAW:
                if not closing and not (name in _FOREIGN and attributes.endswith("/")):
                    end = _RAW_END[name].search(html, at)
                    at = end.end() if end else len(html)
                continue
            if name in INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
                elif name == "br":
                    words(" ")
                continue
            if "-" in name and not named_kind(name):
                continue
            close_run()
            if name in VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        in_link = 0
                        break
                continue
            if name == "html":
                continue
            for closed in (CLOSES.get(name, ()),):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        del stack[k:]
                        in_link = 0
                        continue
                    if stack[k][0] in BOUNDS:
                        break
            kind = KINDS.get(name, KINDS["other"])
            mark = -1
            if "-" in name:
                kind = KINDS[named_kind(name)]
            if attributes:
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
                told = named_kind(names) if names else None
                if told and not (told[0] == "?" and name in OWN_KIND):
                    kind = KINDS[told]
                marked = _MARK.search(attributes)
                mark = int(marked[1]) if marked else -1
            stack.append((name, self.add(stack[-1][1], kind, mark)))
        words(html[at:])
        close_run()

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Text nodes and the number of their combination of element, length, link share and ending."""
        nodes = np.array(list(self.text), np.int64)
        sizes = np.array([len(t) for t in self.text.values()], np.int64)
        share = np.array(list(self.linked.values()), np.int64) / np.maximum(sizes, 1)
        ends = np.array([t[-1] in ".!?…:;\"'»”)" for t in self.text.values()], np.int64)
        around = np.array([_AROUND[self.kind[self.parent[n]] // SORTS] for n in self.text], np.int64)
        return nodes, ((around * len(WEIGHTS) + np.searchsorted(LENGTHS, sizes)) * 3 + np.searchsorted((0.2, 0.8), share)) * 2 + ends


class TreeModel:
    """Log potentials: ``edge[kind, parent label, child label]`` and ``evidence[combination, label]``."""

    def __init__(self, edge_counts: np.ndarray, evidence_counts: np.ndarray, smooth: float = 0.5):
        edge = edge_counts + smooth
        self.edge = np.log(edge / edge.sum(axis=2, keepdims=True))
        evidence = evidence_counts + smooth
        weight = np.array(WEIGHTS)[np.arange(len(evidence)) // 6 % len(WEIGHTS)]
        self.evidence = np.log(evidence / evidence.sum(axis=0, keepdims=True)) * weight[:, None]

    def marginals(self, trees: Trees) -> np.ndarray:
        """P(main) of every node by messages up and down the trees."""
        n = len(trees.parent)
        parent, depth, kind = (np.array(x, np.int64) for x in (trees.parent, trees.depth, trees.kind))
        local = np.zeros((n, 2))
        nodes, features = trees.features()
        local[nodes] = self.evidence[features]
        edge = self.edge[kind]  # of each node to its parent
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))
        up = np.zeros((n, 2))
        for level in reversed(levels[1:]):
            up[level] = np.logaddexp.reduce(edge[level] + local[level][:, None, :], axis=2)
            np.add.at(local, parent[level], up[level])
        belief = local
        for level in levels[1:]:
            rest = belief[parent[level]] - up[level]
            belief[level] += np.logaddexp.reduce(edge[level] + rest[:, :, None], axis=1)
            belief[level] -= belief[level].max(axis=1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def _labels(trees: Trees) -> np.ndarray:
    """Labels of all nodes of labelled pages: text by its nearest mark, elements by whether they hold main text; -1 without text."""
    n = len(trees.parent)
    label, size, main = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for node in range(n):
        parent = trees.parent[node]
        label[node] = trees.mark[node] if trees.mark[node] >= 0 else (label[parent] if parent >= 0 else 0)
    for node, text in trees.text.items():
        size[node], main[node] = len(text), len(text) * label[node]
    for node in range(n - 1, -1, -1):
        if trees.parent[node] >= 0:
            size[trees.parent[node]] += size[node]
            main[trees.parent[node]] += main[node]
        if node not in trees.text:
            label[node] = main[node] > 0 if size[node] else -1
    return label


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (kind, parent's label, label) and of (combination, label) in labelled pages."""
    edges, evidence = np.zeros((N_EDGES, 2, 2), np.int64), np.zeros((N_FEATURES, 2), np.int64)
    for batch in pieces(batches, 0):
        trees = Trees()
        for html in batch.column(0).to_pylist():
            trees.read(html or "")
        if not trees.parent:
            continue
        label, parent, kind = _labels(trees), np.array(trees.parent), np.array(trees.kind)
        inner = (parent >= 0) & (label >= 0)
        np.add.at(edges, (kind[inner], label[parent[inner]], label[inner]), 1)
        nodes, features = trees.features()
        np.add.at(evidence, (features, label[nodes]), 1)
    counts = np.concatenate([edges.ravel(), evidence.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["cell", "n"])


def fit(labelled: DataFrame, html_col: str = "html") -> TreeModel:
    """Potentials from labelled pages; a few hundred sums reach the driver, however many pages there are."""
    rows = labelled.select(html_col).mapInArrow(_counting, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(N_EDGES * 4 + N_FEATURES * 2)
    counts[rows["cell"].to_numpy(int)] = rows["n"].to_numpy(float)
    return TreeModel(counts[: N_EDGES * 4].reshape(-1, 2, 2), counts[N_EDGES * 4 :].reshape(-1, 2))


def default_model(spark: SparkSession, n_pages: int = 1500) -> TreeModel:
    """A model fitted on the invented labelled pages."""
    return fit(spark.createDataFrame(labelled_pages(n_pages), "page_id long, html string"))


def main_texts(pages: list[str | None], model: TreeModel, least: float = 0.5) -> list[str]:
    """Main text of each page."""
    trees = Trees()
    for html in pages:
        trees.read(html or "")
    if not trees.parent:
        return []
    chance = model.marginals(trees)
    page = np.searchsorted(trees.roots, list(trees.text), "right") - 1
    out: list[list[str]] = [[] for _ in pages]
    for at, (node, text) in zip(page.tolist(), trees.text.items()):
        if chance[node] >= least:
            out[at].append(text)
    return [" ".join(parts) for parts in out]


def _extracting(handle) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 2 << 20):
            texts = main_texts(batch.column(1).to_pylist(), handle.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return run


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``id_col, url_col, text, n_chars`` for each row; one narrow pass over whole pages."""
    handle = pages.sparkSession.sparkContext.broadcast(model)
    kinds = dict(pages.dtypes)
    found = pages.select(id_col, html_col, url_col).mapInArrow(_extracting(handle), f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
