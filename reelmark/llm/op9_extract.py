"""HTML extraction: a tree-structured graphical model over DOM blocks, solved by sum-product.

Every block has a label, content or not. A block's evidence (its element, what its class and id say, how
much text and how many links it and its descendants hold) gives a node potential; each parent-child pair
has a potential for agreeing or not. Messages go from the leaves up and from the root down once; their
products are the exact marginals, and text runs of blocks that are more likely content than not are
the page's text.

Potentials are counted from labelled pages: a bounded sample of the given ones (at most ``SAMPLE``, by
least hash), labelled where they name their parts themselves (``article`` or ``main``, and in them no
``nav``, ``aside``, ``form`` and the like), and the labelled skeletons below, for parts the sample lacks.

Defined results: a null or empty html, or a page without content, has an empty text of length 0; broken
markup is read as far as it goes; repeated rows are extracted row by row; an empty table gives an empty
result. Input columns other than id, url and html are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.llm import dom

SAMPLE = 200
BATCH = 64
#: Words in class, id or role that say what a block is.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|header|masthead|foot\w*|copyright|sidebar\w*|side|"
    r"aside|widget\w*|comment\w*|reply|replies|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|"
    r"signup|login|cookie\w*|consent|notice\w*|alert|popup|modal|breadcrumb\w*|pagination|pager|toolbar|tags|search\w*|form|"
    r"complementary|navigation|contentinfo|skip|legal|disclaimer)(?=$|[\s_-])"
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|text|body|main|prose|articlebody)(?=$|[\s_-])")
GROUPS = {
    **{n: "landmark" for n in ("article", "main")},
    **{n: n for n in ("nav", "header", "footer", "aside", "form", "p")},
    **{n: "heading" for n in ("h1", "h2", "h3", "h4", "h5", "h6")},
    **{n: "list" for n in ("ul", "ol", "dl", "li", "dt", "dd", "menu")},
    **{n: "quote" for n in ("blockquote", "pre", "figure", "figcaption")},
    **{n: "table" for n in ("table", "tbody", "thead", "tr", "td", "th", "caption")},
    **{n: "root" for n in ("html", "body")},
}
OUTSIDE = frozenset("nav header footer aside form fieldset dialog".split())
#: Pages with their labels, made for this module: ``+`` opens content, ``-`` what is not.
SKELETONS = (
    "-body(-div.header(-h1:8:0 -ul(-li:6:6 -li:6:6)) +div.content(+h1:40:0 +p:300:0 +p:420:9 +ul(+li:60:0 +li:80:0) -div.ad(-p:60:0) "
    "+p:260:0 -div.share(-a:20:20)) -div.sidebar(-h3:12:0 -ul(-li:30:30 -li:24:24) -p:90:0) -div.comments(-p:120:0 -p:240:0) -div.footer(-p:80:20))",
    "-body(-nav(-ul(-li:6:6)) +main(+article(+header(+h1:50:0) +p:350:0 +blockquote(+p:90:0) +p:200:0 -aside(-p:120:0) "
    "-section.comments(-h2:9:0 -div.comment(-p:150:0) -form(-label:12:0))) -div.related(-ul(-li:40:40))) -footer(-p:70:10))",
    "-body(-div.cookie-notice(-p:140:10) -div.menu(-ul(-li:8:8)) +div.post(+h2:45:0 +div.entry(+p:500:20 +p:80:0 +h3:20:0 +p:240:0 "
    "+table(+tr(+td:12:0 +td:9:0))) -div.newsletter(-form(-p:60:0))) -aside(-div.widget(-p:100:40)) -div.copyright(-p:60:0))",
)


def grown(nodes: list[dom.Node]) -> list[tuple[int, int]]:
    """Characters of text, and of links, in each block with its descendants."""
    sums = [[n.chars, n.linked] for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        up = sums[nodes[k].parent]
        up[0] += sums[k][0]
        up[1] += sums[k][1]
    return [tuple(s) for s in sums]


def evidence(nodes: list[dom.Node]) -> list[tuple]:
    """What is seen of each block; one entry per feature."""
    out = []
    for n, (chars, linked) in zip(nodes, grown(nodes)):
        marks = n.marks
        out.append((
            GROUPS.get(n.name, "other"),
            ("boilerplate" if BOILERPLATE.search(marks) else "content" if CONTENT.search(marks) else "named") if marks else "",
            min(6, chars.bit_length() // 2),
            0 if not chars else 1 + min(4, int(5 * linked / max(chars, linked, 1))),
        ))
    return out


def weak_labels(nodes: list[dom.Node]) -> list[bool] | None:
    """Labels of a page that names its parts; None for others."""
    if not any(n.name in ("article", "main") for n in nodes):
        return None
    out = [False]
    for n in nodes[1:]:
        aside = n.name in OUTSIDE or bool(n.marks and BOILERPLATE.search(n.marks))
        out.append(not aside and (n.name in ("article", "main") or out[n.parent]))
    return out


def skeleton(text: str) -> tuple[list[dom.Node], list[bool]]:
    nodes, labels, stack = [dom.Node("html", "", -1)], [False], [0]
    for sign, name, mark, size, linked, open_, close in re.findall(r"([+-])(\w+)(?:\.([\w-]+))?(?::(\d+):(\d+))?(\()?|(\))", text):
        if close:
            stack.pop()
            continue
        node = dom.Node(name, mark, stack[-1])
        node.chars, node.linked = int(size or 0), int(linked or 0)
        nodes.append(node)
        labels.append(sign == "+")
        if open_:
            stack.append(len(nodes) - 1)
    return nodes, labels


class Model:
    """Potentials, as logarithms, from labelled pages."""

    def __init__(self, pages: list[tuple[list[dom.Node], list[bool]]], smooth: float = 0.5):
        seen: list[list[Counter]] = [[Counter(), Counter()] for _ in range(4)]
        pairs = [[smooth, smooth], [smooth, smooth]]
        for nodes, labels in pages:
            for n, label, values in zip(nodes, labels, evidence(nodes)):
                for counts, value in zip(seen, values):
                    counts[label][value] += 1
                if n.parent >= 0:
                    pairs[labels[n.parent]][label] += 1
        self.nodes = []
        for counts in seen:
            values = {*counts[0], *counts[1]}
            sums = [smooth * (len(values) + 1) + sum(c.values()) for c in counts]
            self.nodes.append((
                {v: tuple(math.log((c[v] + smooth) / s) for c, s in zip(counts, sums)) for v in values},
                tuple(math.log(smooth / s) for s in sums),
            ))
        self.pairs = [[x / sum(row) for x in row] for row in pairs]

    def marginals(self, nodes: list[dom.Node]) -> list[float]:
        """The chance of each block to be content: one pass up, one pass down."""
        own = []
        for values in evidence(nodes):
            a = b = 0.0
            for (known, other), value in zip(self.nodes, values):
                x, y = known.get(value, other)
                a += x
                b += y
            top = max(a, b)
            own.append((math.exp(a - top), math.exp(b - top)))
        (p00, p01), (p10, p11) = self.pairs
        up = [(1.0, 1.0)] * len(nodes)  # message of each block to its parent
        below = list(own)  # potential times the messages of its children
        for k in range(len(nodes) - 1, 0, -1):
            x, y = below[k]
            m0, m1 = p00 * x + p01 * y, p10 * x + p11 * y
            s = m0 + m1
            up[k] = m0, m1 = m0 / s, m1 / s
            parent = nodes[k].parent
            u, v = below[parent]
            u, v = u * m0, v * m1
            s = u + v
            below[parent] = (u / s, v / s) if s > 0 else own[parent]
        full = [below[0]]  # potential times all messages
        for k in range(1, len(nodes)):
            u, v = full[nodes[k].parent]
            m0, m1 = up[k]
            u, v = u / max(m0, 1e-300), v / max(m1, 1e-300)  # without what came from here
            x, y = below[k]
            x, y = x * (u * p00 + v * p10), y * (u * p01 + v * p11)
            s = x + y
            full.append((x / s, y / s) if s > 0 else below[k])
        return [y / (x + y) for x, y in full]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, runs = dom.parse(page)
        chance = self.marginals(nodes)
        return "\n\n".join(run for block, run in runs if chance[block] > 0.5)


def fit(pages: DataFrame, *, id_column: str = "page_id", html: str = "html", sample: int = SAMPLE) -> Model:
    """Potentials from at most ``sample`` pages and the skeletons."""
    rows = pages.where(F.col(html).isNotNull()).select(F.xxhash64(id_column).alias("key"), F.col(html).alias("html"))
    ids = rows.select("key").orderBy("key").limit(sample)
    chosen = rows.join(ids.distinct(), "key", "left_semi").orderBy("key", "html").limit(sample).collect()
    labelled = []
    for row in chosen:
        nodes, _ = dom.parse(row["html"])
        labels = weak_labels(nodes)
        if labels:
            labelled.append((nodes, labels))
    # As many skeletons as sampled pages, so that neither outweighs the other.
    return Model(labelled + [skeleton(s) for s in SKELETONS] * max(1, sample // len(SKELETONS)))


def extract(pages: DataFrame, model: Model, *, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                texts = [shared.value.text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[id_column, url, "text", "n_chars"],
                )

    rows = pages.select(F.col(id_column), F.col(url), F.col(html))
    kind = pages.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(work, f"`{id_column}` {kind}, `{url}` string, text string, n_chars long")
