"""Main text of HTML pages by gradient-boosted trees over features of DOM nodes.

A page becomes a tree of block elements whose leaves are the runs of inline text between block borders.
Features of a node: length and link share of its text, text per tag in its subtree, depth, place among and
likeness to its siblings, punctuation, marks of main text or of boilerplate in tags and attribute tokens of
the node and its ancestors. The trees are trained with Spark ML on the nodes of a bounded sample of pages
that mark their main text (article or main elements); two copies of each page hide the marks of main text, or
all marks, from the learner, so that it also judges by shape. Decoding is hierarchical: the labels of a page
maximise the sum of log probabilities under the rule that nothing is kept inside a dropped node.

Cases: a null or empty page gives an empty text; broken and unclosed markup is closed by the usual rules;
repeated rows give the same text; without a marked page in the sample the written marks decide.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Pages learned from, drawn by a hash of the page; every page is extracted.
SAMPLE_PAGES = 600
ROUNDS = 10
DEPTH = 4

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "template", "noscript", "svg", "iframe", "select")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MAIN_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset("nav footer aside form dialog menu button".split())
MAIN_WORDS = frozenset("article main content post story entry body text".split())
OTHER_WORDS = frozenset(
    "nav navbar menu header footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies "
    "consent notice alert popup modal newsletter subscribe signup share sharing social comment comments reply replies disqus related "
    "recommended breadcrumb breadcrumbs pagination pager widget login form search toolbar navigation contentinfo complementary "
    "masthead skip legal copyright".split()
)
FEATURES = 20


class Node:
    __slots__ = ("tag", "parent", "children", "text", "linked", "tags", "depth", "main", "other", "own_other", "controls", "p")

    def __init__(self, tag: str, parent: Node | None, main: bool = False, other: bool = False) -> None:
        self.tag, self.parent, self.children, self.text, self.linked, self.tags, self.controls = tag, parent, [], "", 0, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        self.main = main or bool(parent and parent.main)
        self.own_other = other
        self.other = other or bool(parent and parent.other)
        self.p = 0.0
        if parent:
            parent.children.append(self)


def marks(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool]:
    """Whether an element is marked as main text, and whether as something else."""
    words, hidden = set(), False
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        value = value.strip("\"'").lower()
        if name.lower() in ("class", "id", "role"):
            words.update(re.split(r"[^a-z]+", value))
        else:
            hidden |= name.lower() == "hidden" or "display:none" in value.replace(" ", "")
    bad = words & OTHER_WORDS
    if words & MAIN_WORDS:
        bad -= {"header", "text"}
    other = tag in OTHER_TAGS or bool(bad) or hidden or (tag == "header" and not inside_main)
    return (tag in MAIN_TAGS or bool(words & MAIN_WORDS)) and not other, other


def parse(page: str) -> Node:
    """Tree of block elements; leaves have the tag ``#`` and hold the text of one block."""
    root = Node("html", None)
    stack: list[tuple[str, Node]] = [("html", root)]
    pieces: list[str] = []
    linked = inline_tags = links = 0

    def flush() -> None:
        nonlocal linked, inline_tags
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            leaf = Node("#", stack[-1][1])
            leaf.text, leaf.linked, leaf.tags = text, min(linked, len(text)), inline_tags
        pieces.clear()
        linked = inline_tags = 0

    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            pieces.append(page[at:stop])
            linked += (stop - at) if links else 0
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closing = found[1]
        if tag in RAW and not closing:
            close = RAW[tag].search(page, at)
            at = close.end() if close else end
            stack[-1][1].controls += tag in ("textarea", "select")
        elif tag not in BLOCKS:
            inline_tags += 1
            links = max(0, links + (-1 if closing else 1)) if tag == "a" else links
            if tag in ("br", "hr", "img"):
                pieces.append(" ")
            elif tag in ("input", "button"):
                stack[-1][1].controls += 1
        elif tag in ("html", "body"):
            flush()
        elif closing:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            flush()
            links = 0
            while len(stack) > 1 and stack[-1][0] in CLOSES.get(tag, {"p"}):
                stack.pop()
            parent = stack[-1][1]
            stack.append((tag, Node(tag, parent, *marks(tag, found[3], parent.main))))
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes with text, parents first; lengths, link lengths and tags of subtrees are added up."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(order):
        if node.tag != "#":
            node.children = [c for c in node.children if c.text]
            node.linked = sum(c.linked for c in node.children)
            node.tags = 1 + sum(c.tags for c in node.children)
            node.controls += sum(c.controls for c in node.children)
            node.text = "\n" * bool(node.children)
    return [n for n in order if n.text]


def lengths(order: list[Node]) -> dict[int, int]:
    """Characters of text in each subtree."""
    out: dict[int, int] = {}
    for node in reversed(order):
        out[id(node)] = len(node.text) if node.tag == "#" else sum(out[id(c)] for c in node.children)
    return out


def features(order: list[Node]) -> np.ndarray:
    size = lengths(order)
    place = {id(c): j for node in order for j, c in enumerate(node.children)}
    rows = np.zeros((len(order), FEATURES), np.float32)
    for i, node in enumerate(order):
        n = size[id(node)]
        parent = node.parent
        siblings = parent.children if parent and parent.children else [node]
        shape = node if node.tag != "#" else parent
        text = node.text if node.tag == "#" else ""
        rows[i] = (
            math.log1p(n), node.linked / n if n else 0, math.log1p(n / (node.tags + 1)), node.depth, math.log1p(len(siblings)),
            place.get(id(node), 0) / len(siblings),
            math.log1p(size[id(parent)] / len(siblings)) if parent else math.log1p(n),
            len(node.children), node.main, node.own_other, node.other, shape.tag == "p", shape.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            shape.tag in ("li", "td", "th", "dt", "option"), node.tag != "#",
            (text.count(".") + text.count(",") + text.count("!") + text.count("?")) / len(text) if text else 0,
            math.log1p(text.count(" ")), node.tag == "#", node.controls, parent is None,
        )
    return rows


def labels(order: list[Node]) -> np.ndarray:
    """Written marks: main text is inside a main mark and outside other marks; a container follows most of its text."""
    size, kept = lengths(order), {}
    for node in reversed(order):
        kept[id(node)] = (size[id(node)] if node.main and not node.other else 0) if node.tag == "#" else sum(kept[id(c)] for c in node.children)
    return np.array([kept[id(n)] * 2 > size[id(n)] if n.tag == "#" else kept[id(n)] > 0 for n in order], np.float64)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = [], []
        for page in batch.column(0).to_pylist():
            order = nodes_of(parse(page or ""))
            truth = labels(order)
            if not len(order) or not truth.any():
                continue
            shown = features(order)
            for hidden in ((), (8,), (8, 9, 10)):
                rows = shown.copy()
                rows[:, hidden] = 0
                x += rows.tolist()
                y += truth.tolist()
            # The same shapes inside other marks are no main text, whatever else they look like.
            for own in (0, 1):
                rows = shown[(truth == 1) & (shown[:, 19] == 0)]
                rows[:, 9], rows[:, 10] = own, 1
                x += rows.tolist()
                y += [0.0] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), pa.array(y, pa.float64())], ["x", "label"])


class Boosted:
    """Trees as arrays, evaluated for many rows at once."""

    def __init__(self, model) -> None:
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            feature, threshold, left, right, value = [], [], [], [], []

            def add(node) -> int:
                at = len(feature)
                for column in (feature, threshold, left, right, value):
                    column.append(0)
                value[at] = node.prediction()
                if node.subtreeDepth() > 0:
                    feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
                    left[at], right[at] = add(node.leftChild()), add(node.rightChild())
                else:
                    left[at] = right[at] = at
                return at

            add(tree._java_obj.rootNode())
            self.trees.append((weight, np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value, float)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Boosted | None:
    """Train on a bounded sample of pages that carry marks of their main text."""
    drawn = pages.where("html is not null").orderBy(F.xxhash64("html"), "html").limit(sample).select("html")
    rows = drawn.mapInArrow(_training_rows, "x array<float>, label double").select(array_to_vector("x").alias("features"), "label").cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        return Boosted(GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.5, seed=7).fit(rows))
    finally:
        rows.unpersist()


def decode(order: list[Node], p: np.ndarray) -> str:
    """Text of the best labelling in which nothing is kept inside a dropped node."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log1p(-p)
    place = {id(n): i for i, n in enumerate(order)}
    dropped, best = np.array(drop), np.array(keep)
    chosen = np.ones(len(order), bool)
    for i in range(len(order) - 1, -1, -1):
        for child in order[i].children:
            j = place[id(child)]
            dropped[i] += dropped[j]
            best[i] += best[j]
        chosen[i] = best[i] > dropped[i] or i == 0
        best[i] = best[i] if chosen[i] else dropped[i]
    out = []
    for i, node in enumerate(order):
        if i and not chosen[place[id(node.parent)]]:
            chosen[i] = False
        if node.tag == "#" and chosen[i]:
            out.append(node.text)
    return "\n".join(out)


def extract(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = [f.dataType.simpleString() for f in pages.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for first in range(0, batch.num_rows, 100):
                trees = [nodes_of(parse(h or "")) for h in batch.column(2).slice(first, 100).to_pylist()]
                found = [features(t) if t else np.zeros((0, FEATURES), np.float32) for t in trees]
                p = shared.value.probability(np.concatenate(found)) if shared.value else np.concatenate([labels(t) for t in trees])
                cut = np.cumsum([0, *map(len, found)])
                texts += [decode(t, p[a:b]) if t else "" for t, a, b in zip(trees, cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())
            ], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op4_boosted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
