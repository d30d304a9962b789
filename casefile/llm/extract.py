"""Main text of HTML pages by boosted trees over DOM nodes with hierarchical decoding.

Every node gets features: its tag, depth, words of its attributes and of its ancestors', density of text, links and
sentence marks in its subtree, its place among its siblings and its share of the page. A boosted model, trained on
made-up pages with known main text, gives the log-odds that the subtree holds main text. A node can be kept only if
its parent is, so the decoder takes the closed set of nodes with the largest sum: from the leaves upwards a subtree
is worth its own log-odds plus what its children are worth, and is cut off where that is below zero. Text is kept
if its node is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import gbt, htmlpages
from .dom import HIDDEN, TAGS, TOKEN_NAMES, Page, parse
from .held import drop, tidy

#: Pages and seed of the training set.
TRAIN_PAGES, SEED = 1200, 11
#: Characters of pages that are read together, and nodes that are scored together.
HELD, ROWS = 1 << 20, 8192
#: The fitted trees.
MODEL = Path(__file__).with_name("main_text_model.npz")


def subtree(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[start]


class Nodes:
    """What the model sees of the nodes of some pages; feature rows are made for a few nodes at a time."""

    def __init__(self, pages: list[Page]):
        self.starts = starts = np.cumsum([0, *(len(p.tag) for p in pages)])

        def column(name: str) -> np.ndarray:
            return np.concatenate([np.asarray(getattr(p, name), np.int64) for p in pages])

        shift = np.repeat(starts[:-1], np.diff(starts))
        self.tag, self.before, self.depth, self.bits, self.above, self.index, self.children = (column(c) for c in ("tag", "before", "depth", "bits", "above", "index", "children"))
        self.parent, self.end, self.n = column("parent") + shift, column("end") + shift, len(self.tag)
        self.parent[starts[:-1]] = starts[:-1]
        at = np.arange(self.n)
        self.own = column("text")
        self.text, self.links, self.marks, self.anchors = (subtree(column(c), at, self.end) for c in ("text", "links", "marks", "anchors"))
        self.paragraphs = subtree((self.tag == TAGS.index("p")).astype(np.int64), at, self.end)
        self.first = shift  # the first node of the node's page
        self.done = np.concatenate([[0], np.cumsum(self.own)])
        self.words = [np.concatenate([[0], np.cumsum((self.bits >> i) & 1, dtype=np.int32)]) for i in range(len(TOKEN_NAMES))]

    def rows(self, a: int, b: int) -> np.ndarray:
        """The feature rows of nodes a to b."""
        at = np.arange(a, b)
        parent, end, tag, bits, above = self.parent[a:b], self.end[a:b], self.tag[a:b], self.bits[a:b], self.above[a:b]
        text, links, marks, anchors, paragraphs = (x[a:b].astype(float) for x in (self.text, self.links, self.marks, self.anchors, self.paragraphs))
        nodes = (end - at).astype(float)
        page_text = self.text[self.first[a:b]] + 1.0
        into = (self.done[at] - self.done[self.first[a:b]]) / page_text
        text_above, links_above = self.text[parent].astype(float), self.links[parent].astype(float)
        columns = [
            tag, self.tag[parent], self.before[a:b], self.depth[a:b], self.index[a:b], self.children[parent] - self.index[a:b], self.children[a:b],
            np.log1p(text), np.log1p(self.own[a:b].astype(float)), links / (text + 1), marks / (text + 1) * 100, text / (nodes + 1), np.log1p(nodes), np.log1p(anchors),
            paragraphs / nodes, text / (paragraphs + 1), text / page_text, text / (text_above + 1), into, links_above / (text_above + 1),
            *(((bits >> i) & 1) for i in range(len(TOKEN_NAMES))), *(((above >> i) & 1) for i in range(len(TOKEN_NAMES))),
            *((w[end] - w[at]) / nodes for w in self.words), (bits & HIDDEN) > 0, *((tag == t).astype(float) for t in range(len(TAGS))),
        ]
        return np.stack([np.asarray(c, float) for c in columns], axis=1)

    def margins(self, model: gbt.Model) -> np.ndarray:
        """The model's log-odds of every node."""
        return np.concatenate([model.margin(self.rows(at, min(self.n, at + ROWS))) for at in range(0, self.n, ROWS)])


def labels(page: Page) -> np.ndarray:
    """1 where the subtree of a made-up page's node holds main text."""
    own = np.array(["data-main" in a for a in page.attrs], np.int64)
    return (subtree(own, np.arange(len(own)), np.array(page.end)) > 0).astype(float)


def refitted(n_pages: int = TRAIN_PAGES, seed: int = SEED) -> gbt.Model:
    """The model, fitted anew; a node counts by the root of its text."""
    pages = [parse(h) for h in htmlpages.pages(n_pages, seed)]
    nodes = Nodes(pages)
    x = nodes.rows(0, nodes.n)
    y = np.concatenate([labels(p) for p in pages])
    return gbt.fit(x, y, 1.0 + np.exp(x[:, 7] / 3))


@lru_cache(maxsize=1)
def trained() -> gbt.Model:
    """The model as ``refitted`` made it and ``python -m casefile.llm.extract`` stored it."""
    with np.load(MODEL) as stored:
        return gbt.Model(stored["feature"], stored["threshold"], stored["leaf"], float(stored["base"]))


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """The nodes kept: the subset closed under parents with the largest sum of log-odds; the root is always in."""
    worth = margin.tolist()
    parent = page.parent
    for n in range(len(worth) - 1, 0, -1):
        if worth[n] > 0:
            worth[parent[n]] += worth[n]
    kept = [True] * len(worth)
    for n in range(1, len(worth)):
        kept[n] = kept[parent[n]] and worth[n] > 0
    return np.array(kept)


def join_blocks(page: Page, kept: np.ndarray) -> str:
    """Kept text: white space in a block as one space, blocks that are not empty joined by a line feed."""
    out: list[str] = []
    now, parts = -1, []
    for node, block, text in [*page.pieces, (0, -2, "")]:
        if block != now:
            line = " ".join("".join(parts).split())
            if line:
                out.append(line)
            now, parts = block, []
        if kept[node]:
            parts.append(text)
    return "\n".join(out)


def extract_texts(htmls: list[str], model: gbt.Model) -> list[str]:
    pages = [parse(h) for h in htmls]
    if not pages:
        return []
    nodes = Nodes(pages)
    margin, starts = nodes.margins(model), nodes.starts
    return [join_blocks(p, decode(p, margin[a:b])) for p, a, b in zip(pages, starts, starts[1:], strict=False)]


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep`` columns, text, n_chars (its code points) of every page.

    The whole html is read, in time and memory in proportion to its length; null is as empty and gives an empty text, so
    does html without main text. A tag that is never closed goes on to the end. Repeated rows give a row each, an empty
    table none; other columns are not read.
    """
    model = trained()
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    n_keep = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for batch in tidy(batches):
            at = 0
            while at < batch.num_rows:
                some, held = [], 0
                while at + len(some) < batch.num_rows and (held < HELD or not some):
                    html = batch.column(n_keep)[at + len(some)].as_py() or ""
                    some.append(html)
                    held += len(html)
                texts = extract_texts(some, model)
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keep)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return pages.select(*keep, html_col).mapInArrow(work, schema)


if __name__ == "__main__":
    new = refitted()
    np.savez_compressed(MODEL, feature=new.feature.astype(np.int16), threshold=new.threshold, leaf=new.leaf, base=new.base)
