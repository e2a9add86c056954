"""Main text of HTML pages by a linear-chain conditional random field.

A page is a chain of leaf blocks, each of them content or not.  Features are
the tags, class and id words above a block and the shape of its text; edges
know whether neighbours share their container.  Pages that do not mark their
article have weights of their own for the shapes of texts.  The field is trained on
labelled pages by gradient ascent on the likelihood and decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hushscan.llm.blocks import Block, read_blocks
from hushscan.llm.common import Memo
from hushscan.llm.samples import labelled_samples

#: containers whose text is not the article, as tags or class words
NOISE = frozenset(
    "nav footer aside form menu dialog noscript select button fieldset .ad .ads .advert .advertisement .banner .sponsored "
    ".promo .nav .navbar .navigation .menu .breadcrumb .breadcrumbs .sidebar .footer .cookie .cookies .consent .notice "
    ".popup .modal .newsletter .subscribe .signup .comments .comment .disqus .reply .related .share .social "
    "role=navigation role=banner role=contentinfo role=complementary role=search role=dialog =hidden".split()
)
#: tags and class words by which a page marks its article
MARKS = frozenset("article main role=main .content .post .entry .article .story".split())
#: words that short blocks beside an article often hold
_CUES = frozenset("cookie cookies subscribe copyright © comment comments reply share login advertisement newsletter privacy".split())


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled pages and of the fit."""

    #: pages of the table whose <article> or <main> labels their blocks
    pages: int = 600
    #: longer pages are not learnt from (they are extracted like any other)
    page_bytes: int = 1 << 20
    #: drawn pages of many layouts, labelled as they are built
    samples: int = 900
    longest: int = 200
    steps: int = 160
    rate: float = 0.15
    penalty: float = 0.005
    seed: int = 5


def text_features(block: Block) -> tuple[str, ...]:
    words = block.text.split()
    size = min(6, len(words).bit_length())
    found = [f"size{size}", f"linked{round(4 * block.linked)}", f"tag:{block.tag}"]
    if block.text[-1] in ".!?…\"”":
        found.append("sentence")
    if any(w.lower().strip(".,:!") in _CUES for w in words[:12]):
        found.append("cue")
    return tuple(found)


def shape_features(blocks: list[Block]) -> list[tuple[str, ...]]:
    """Text features of the blocks of a whole page.

    Where nothing marks the article, only the shapes of the texts and of their
    neighbours can tell it, and they are told apart from shapes on marked pages.
    """
    own = [text_features(b) for b in blocks]
    if any(not MARKS.isdisjoint(b.path) for b in blocks):
        return own
    # size, share of links and tag of the blocks before and after
    near = [names[:3] for names in own]
    before, after = [("start",), *near[:-1]], [*near[1:], ("end",)]
    return [
        (*mine, *("plain:" + n for n in mine), *("before:" + n for n in a), *("after:" + n for n in b))
        for mine, a, b in zip(own, before, after)
    ]


@dataclass
class Field:
    """Weights: two scores a feature, and 2 x 2 scores for edges that leave or stay in a container."""

    features: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def __post_init__(self):
        self.paths, self.shapes = Memo(self.score, 50_000), Memo(self.score, 50_000)

    def score(self, names) -> tuple[float, float]:
        known = [self.features[n] for n in names if n in self.features]
        return tuple(self.weights[known].sum(axis=0).tolist()) if known else (0.0, 0.0)

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the likeliest labels of the whole chain."""
        if not blocks:
            return []
        edges = self.edges.tolist()
        scores, back, before = (0.0, 0.0), [], None
        for block, shape in zip(blocks, shape_features(blocks)):
            (a, b), (c, d) = self.paths[block.path], self.shapes[shape]
            if before is None:
                scores = (a + c, b + d)
            else:
                edge = edges[before.path == block.path]
                off = (scores[0] + edge[0][0], scores[1] + edge[1][0])
                on = (scores[0] + edge[0][1], scores[1] + edge[1][1])
                back.append((off[1] > off[0], on[1] > on[0]))
                scores = (max(off) + a + c, max(on) + b + d)
            before = block
        label = scores[1] > scores[0]
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]

    def extract(self, html: str | None) -> str:
        blocks = read_blocks(html)
        return "\n\n".join(b.text for b, keep in zip(blocks, self.decode(blocks)) if keep)


def tagged(html: str | None) -> list[tuple[Block, bool]]:
    """Blocks of a page that marks its article, labelled by the marks; else none."""
    blocks = read_blocks(html)
    labels = [bool(b.path & {"article", "main"}) and not b.path & NOISE for b in blocks]
    return list(zip(blocks, labels)) if any(labels) else []


def train(pages: list[list[tuple[Block, bool]]], options: Training = Training()) -> Field:
    """Fit the field to labelled pages; long pages are cut into chains of ``longest`` blocks."""
    shaped = [list(zip(p, shape_features([block for block, _ in p]))) for p in pages]
    chains = [p[i : i + options.longest] for p in shaped for i in range(0, len(p), options.longest)]
    names: dict[str, int] = {}
    flat, owner, labels, same = [], [], [], []
    for chain in chains:
        before = None
        for (block, keep), shape in chain:
            for name in (*sorted(block.path), *shape):
                flat.append(names.setdefault(name, len(names)))
                owner.append(len(labels))
            labels.append(int(keep))
            same.append(0 if before is None else int(before.path == block.path))
            before = block
    flat, owner, labels, same = map(np.array, (flat, owner, labels, same))
    sizes = np.array([len(c) for c in chains])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    weights, edges = np.zeros((len(names), 2)), np.zeros((2, 2, 2))
    speed_w, speed_e = np.full_like(weights, 1e-6), np.full_like(edges, 1e-6)
    for _ in range(options.steps):
        emitted = np.stack([np.bincount(owner, weights[flat, k], len(labels)) for k in (0, 1)], axis=1)
        node, edge = _gradient(emitted, edges, starts, sizes, labels, same)
        slope_w = np.stack([np.bincount(flat, node[owner, k], len(names)) for k in (0, 1)], axis=1) - options.penalty * weights
        slope_e = edge - options.penalty * edges
        speed_w += slope_w**2
        speed_e += slope_e**2
        weights += options.rate * slope_w / np.sqrt(speed_w)
        edges += options.rate * slope_e / np.sqrt(speed_e)
    return Field(names, weights, edges)


def _gradient(emitted, edges, starts, sizes, labels, same):
    """Observed minus expected counts, by forward-backward over all chains at once."""
    node, edge = np.zeros_like(emitted), np.zeros_like(edges)
    alive = [int((sizes > t).sum()) for t in range(sizes[0])]
    ahead = [emitted[starts[: alive[0]]]]
    for t in range(1, sizes[0]):
        at = starts[: alive[t]] + t
        step = ahead[-1][: alive[t], :, None] + edges[same[at]]
        ahead.append(np.logaddexp(step[:, 0], step[:, 1]) + emitted[at])
    behind = np.zeros((0, 2))
    total = np.zeros(len(sizes))
    for t in range(sizes[0] - 1, -1, -1):
        behind = np.concatenate([behind, np.zeros((alive[t] - len(behind), 2))])
        at = starts[: alive[t]] + t
        ends = sizes[: alive[t]] == t + 1
        total[: alive[t]][ends] = np.logaddexp(*ahead[t][ends].T)
        node[at] -= np.exp(ahead[t] + behind - total[: alive[t], None])
        node[at, labels[at]] += 1
        if t:
            before = ahead[t - 1][: alive[t], :, None]
            joint = before + edges[same[at]] + (emitted[at] + behind)[:, None, :]
            expected = np.exp(joint - total[: alive[t], None, None])
            np.add.at(edge, same[at], -expected)
            np.add.at(edge, (same[at], labels[at - 1], labels[at]), 1)
            step = edges[same[at]] + (emitted[at] + behind)[:, None, :]
            behind = np.logaddexp(step[:, :, 0], step[:, :, 1])
    return node, edge


def fit(pages: DataFrame, options: Training = Training(), *, html: str = "html") -> Field:
    """Train on drawn samples and on a bounded number of the table's pages that mark their article.

    Those are ``options.pages`` different pages, the first by a hash, of at
    most ``options.page_bytes`` each; copies of a page count once.
    """
    marked = pages.select(F.col(html).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    marked = marked.where(F.octet_length("html") <= options.page_bytes).withColumn("h", F.xxhash64("html"))
    n = marked.count()
    # twice as many as wanted, so that copies among them do not leave too few
    some = marked.where(F.pmod("h", F.lit(1 << 20)) < F.lit(min(1.0, 2 * options.pages / max(n, 1)) * (1 << 20)))
    found = some.distinct().orderBy("h", "html").limit(options.pages).toArrow().column("html").to_pylist()
    learnt = [tagged(page) for page in found]
    return train([p for p in learnt if p] + labelled_samples(options.samples, options.seed), options)


def main_text(pages: DataFrame, field: Field, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of every page.

    The text is the content blocks in page order, joined by two line ends;
    white space in a block is one space.  Null and empty pages, and pages
    without content, give an empty text.  Whole pages are read, whatever
    their length; other columns are not.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)
    plain = pages.select(*[pages[c].alias(f"k{i}") for i, c in enumerate(keep)], pages[html].alias("html"))
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        for batch in batches:
            texts = [learnt.extract(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=kept + ["text", "n_chars"],
            )

    schema = "".join(f"{k} {plain.schema[k].dataType.simpleString()}, " for k in kept)
    return plain.mapInArrow(run, schema + "text string, n_chars long").toDF(*keep, "text", "n_chars")
