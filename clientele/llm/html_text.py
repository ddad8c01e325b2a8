"""Main text of web pages: a graphical model on the tree of a page's blocks."""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import text_or_empty

# Pages that training looks at, at most, and rounds over them.
TRAINING_PAGES = 1_000
ROUNDS = 60

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "script style noscript template svg math iframe object canvas video audio head title textarea select button".split()
)
# Elements whose text holds no tags: without an end tag they reach to the end of the page.
RAW = frozenset("script style textarea title".split())
# What shows that the element was never closed, if it comes before the end tag.
UNCLOSED_BY = {"head": "body", "button": "button", "select": "select"}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
MAIN_TAGS = frozenset("article main".split())
SIDE_TAGS = frozenset("nav footer aside header form menu dialog fieldset".split())
TEXT_TAGS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li td th dd dt figcaption caption".split())
# Parts of class and id names that tell what a block is for.
MAIN_NAMES = frozenset("article content post entry story body main text".split())
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner promo promoted sponsor sponsored nav navbar navigation menu breadcrumb "
    "breadcrumbs footer header masthead topbar sidebar side aside rail widget related recommended popular comment "
    "comments reply replies discussion disqus respond cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login search form share sharing social toolbar pagination pager copyright "
    "legal disclaimer".split()
)
# Elements that end an open paragraph or item of the same kind when they begin.
CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none\b", re.I)

FEATURES = (
    "bias", "main_tag", "side_tag", "main_name", "side_name", "text_tag", "hidden", "no_text", "short", "middle",
    "long", "ends_sentence", "mostly_links", "some_links", "root",
)
_AT = {name: i for i, name in enumerate(FEATURES)}
# Beliefs before training, towards which the weights are held.
PRIOR = np.array([0.0, 8, -25, 3, -25, 0.5, -25, 0, -0.5, 0, 0.5, 0.3, -2, -0.5, -1])
# Parent-child potentials by kind of edge and (parent, child); 0 side, 1 main.  Blocks
# whose markup names their role, the second kind, say little about their parents.
PAIR_PRIOR = np.array([[[1.5, -1.5], [-1.5, 1.5]], [[0.0, 0], [0, 0]]])
MARKED = [_AT[n] for n in ("main_tag", "side_tag", "main_name", "side_name", "hidden")]


def _is_hidden(attributes: str) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and NO_DISPLAY.search(value):
            return True
    return False


class Page:
    """Blocks of a page: parents, features, and their runs of text in page order."""

    __slots__ = ("parents", "features", "runs", "labels")

    def __init__(self, source: str):
        self.parents, tags, names, hidden = [-1], ["html"], [frozenset()], [False]
        size, linked, sentence = [0], [0], [False]
        stack, runs, pieces = [0], [], []
        anchors = 0
        # Silent elements that no end tag follows any more.
        endless = set()

        def flush():
            if pieces:
                text = " ".join("".join(t for t, _ in pieces).split())
                node = stack[-1]
                if text:
                    runs.append((node, text))
                    size[node] += len(text)
                    linked[node] += min(len(text), sum(len(t) for t, a in pieces if a))
                    sentence[node] = text[-1] in ".!?…。"
                pieces.clear()

        at = 0
        while at < len(source):
            match = TAG.search(source, at)
            end = match.start() if match else len(source)
            if end > at:
                pieces.append((html.unescape(source[at:end]), anchors > 0))
            if not match:
                break
            at = match.end()
            closing, tag, rest = match.group(1), match.group(2), match.group(3)
            if tag is None:
                continue
            tag = tag.lower()
            if tag in INLINE:
                if tag == "a":
                    anchors = max(0, anchors + (-1 if closing else 1))
                elif tag == "br":
                    pieces.append((" ", False))
                continue
            flush()
            if closing:
                if any(tags[n] == tag for n in stack[1:]):
                    while tags[stack.pop()] != tag:
                        pass
                anchors = 0
                continue
            if tag in SILENT and not rest.endswith("/"):
                other = rf"|<{UNCLOSED_BY[tag]}\b" if tag in UNCLOSED_BY else ""
                close = None
                if tag not in endless:
                    close = re.compile(rf"(</{re.escape(tag)}\b[^>]*>){other}", re.I).search(source, at)
                    if not close:
                        endless.add(tag)
                if close and close.group(1):
                    at = close.end()
                elif tag in RAW:
                    at = len(source)
                # Any other element without its end tag hides nothing.
                continue
            if tag in VOID:
                continue
            # A block ends an open paragraph; an item ends the one before it.
            if tags[stack[-1]] == "p" or tags[stack[-1]] == tag and tag in CLOSED_BY_SAME:
                stack.pop()
            self.parents.append(stack[-1])
            tags.append(tag)
            words = " ".join(x for m in NAMED.findall(rest) for x in m).lower() if rest else ""
            known = words and tag not in ("html", "body")
            names.append(frozenset(re.split(r"[^a-z]+", words)) if known else frozenset())
            hidden.append(bool(rest) and _is_hidden(rest))
            for values in (size, linked):
                values.append(0)
            sentence.append(False)
            if not rest.endswith("/"):
                stack.append(len(tags) - 1)
        flush()
        self.runs = runs
        self.labels = [self._label(t, n) for t, n in zip(tags, names, strict=True)]
        self.features = []
        for i, tag in enumerate(tags):
            found = [_AT["bias"]]
            links = linked[i] / size[i] if size[i] else 0
            for name, holds in (
                ("main_tag", tag in MAIN_TAGS), ("side_tag", tag in SIDE_TAGS),
                ("main_name", names[i] & MAIN_NAMES), ("side_name", names[i] & SIDE_NAMES),
                ("text_tag", tag in TEXT_TAGS), ("hidden", hidden[i]), ("no_text", not size[i]),
                ("short", 0 < size[i] < 40), ("middle", 40 <= size[i] < 200), ("long", size[i] >= 200),
                ("ends_sentence", sentence[i]), ("mostly_links", links > 0.5), ("some_links", 0.1 < links <= 0.5),
                ("root", tag in ("html", "body")),
            ):
                if holds:
                    found.append(_AT[name])
            self.features.append(found)

    @staticmethod
    def _label(tag: str, names: frozenset) -> int:
        """1 where main text begins, 0 where it ends, -1: as the parent."""
        if tag in SIDE_TAGS or names & SIDE_NAMES:
            return 0
        return 1 if tag in MAIN_TAGS else -1

    def truth(self) -> list[int] | None:
        """Labels of all blocks, on pages whose markup names the main part."""
        if 1 not in self.labels:
            return None
        out = []
        for i, own in enumerate(self.labels):
            up = out[self.parents[i]] if i else 0
            # Nothing below a side block is main text.
            inside = i and self.labels[i] != 1 and not up
            side_above = i and out[self.parents[i]] == 2
            if own == 0 or side_above:
                out.append(2)
            elif own == 1:
                out.append(1)
            else:
                out.append(0 if inside else up)
        return [int(x == 1) for x in out]


class Forest:
    """Trees of many pages side by side, passed level by level."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parents) for p in pages])
        self.starts = np.cumsum(sizes) - sizes
        parents = np.concatenate([np.array(p.parents) + s for p, s in zip(pages, self.starts, strict=True)])
        self.roots = self.starts
        parents[self.roots] = -1
        self.parents = parents
        self.x = np.zeros((len(parents), len(FEATURES)))
        rows = np.repeat(np.arange(len(parents)), [len(f) for p in pages for f in p.features])
        self.x[rows, [f for p in pages for found in p.features for f in found]] = 1
        self.kinds = (self.x[:, MARKED].sum(1) > 0).astype(int)
        # Parents come before their children, so depths are found in one pass a level.
        current = self.roots
        self.levels = [self.roots]
        children = np.argsort(parents, kind="stable")
        ordered = parents[children]
        while True:
            low, high = np.searchsorted(ordered, current), np.searchsorted(ordered, current, side="right")
            counts = high - low
            if not counts.sum():
                break
            offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            current = np.sort(children[np.repeat(low, counts) + offsets])
            self.levels.append(current)

    def marginals(self, weights: np.ndarray, pair: np.ndarray):
        """P(main) of every block, and P(parent, child) of every edge, by sum-product.

        Messages go from the leaves up to the roots and back down.
        """
        n = len(self.parents)
        own = np.stack([np.zeros(n), self.x @ weights], axis=1)
        up = own.copy()
        message = np.zeros((n, 2))
        for nodes in reversed(self.levels[1:]):
            edge = pair[self.kinds[nodes]]
            m = np.logaddexp(edge[:, :, 0] + up[nodes, :1], edge[:, :, 1] + up[nodes, 1:])
            message[nodes] = m
            np.add.at(up, self.parents[nodes], m)
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for nodes in self.levels[1:]:
            parents = self.parents[nodes]
            rest = up[parents] + down[parents] - message[nodes]
            edge = pair[self.kinds[nodes]]
            both = rest[:, :, None] + edge + up[nodes][:, None, :]
            down[nodes] = np.logaddexp(rest[:, :1] + edge[:, 0], rest[:, 1:] + edge[:, 1])
            both -= both.max(axis=(1, 2), keepdims=True)
            both = np.exp(both)
            joint[nodes] = both / both.sum(axis=(1, 2), keepdims=True)
        total = up + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50))), joint


def fit(pages: list[Page], rounds: int = ROUNDS, rate: float = 1.0, hold: float = 0.01):
    """Weights and potentials from pages that say where their main text is.

    Gradient ascent on the likelihood of the labels, held towards the prior.  Every page
    is used twice, the second time without the features of its markup's names, so that
    size, links and neighbours count as well.
    """
    weights, pair = PRIOR.astype(float), PAIR_PRIOR.astype(float)
    known = [(p, t) for p in pages if (t := p.truth()) is not None]
    if not known:
        return weights, pair
    plain = Forest([p for p, _ in known])
    masked = Forest([p for p, _ in known])
    masked.x[:, [_AT["main_tag"], _AT["main_name"]]] = 0
    truth = np.concatenate([t for _, t in known])
    edges = np.flatnonzero(plain.parents >= 0)
    observed = np.zeros((len(truth), 2, 2))
    observed[edges, truth[plain.parents[edges]], truth[edges]] = 1
    memory, memory2 = np.zeros_like(weights) + 1e-6, np.zeros_like(pair) + 1e-6
    for _ in range(rounds):
        slope, slope2 = hold * (PRIOR - weights), hold * (PAIR_PRIOR - pair)
        for forest, part in ((plain, 0.8), (masked, 0.2)):
            p, joint = forest.marginals(weights, pair)
            slope = slope + part * (forest.x * (truth - p)[:, None]).mean(0)
            for kind in (0, 1):
                of_kind = edges[forest.kinds[edges] == kind]
                slope2[kind] += part * (observed - joint)[of_kind].sum(0) / len(truth)
        memory, memory2 = memory + slope**2, memory2 + slope2**2
        weights = weights + 0.3 * rate * slope / np.sqrt(memory)
        pair = pair + 0.3 * rate * slope2 / np.sqrt(memory2)
    return weights, pair


def extract(sources: list[str], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    """Main texts: runs of blocks that are likelier main text than not, one a line."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    p, _ = forest.marginals(weights, pair)
    out = []
    for page, start in zip(pages, forest.starts.tolist(), strict=True):
        out.append("\n".join(text for node, text in page.runs if p[start + node] >= 0.5))
    return out


def _extract_batches(weights, pair, portion: int = 500):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("html").to_pylist()
            texts = []
            for at in range(0, len(column), portion):
                texts += extract(column[at : at + portion], weights, pair)
            names = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(texts, pa.string())], names + ["text"]
            )

    return run


def train(pages: DataFrame, html_col: str = "html", limit: int = TRAINING_PAGES):
    """Fit on at most ``limit`` pages, chosen by a hash of their source.

    Pages are labelled by their own markup: text of <article> or <main> is main text,
    but for navigation, footers, asides, headers, forms, adverts, notices and comments.
    """
    # A hash thins the table out to a few times the limit before anything is gathered.
    place = F.pmod(F.xxhash64("html", F.lit(11)), F.lit(1 << 30))
    bound = int((1 << 30) * min(1.0, 4 * limit / max(1, pages.count())))
    sample = (
        pages.select(F.col(html_col).alias("html"))
        .filter((place < bound) & (F.length("html") < 200_000))
        .filter(F.col("html").rlike("(?i)<(article|main)\\b"))
        .orderBy(place, F.xxhash64("html"))
        .limit(limit)
    )
    return fit([Page(r.html) for r in sample.toLocalIterator()])


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the column ``text`` (its main text) in place of the source.

    Null or empty sources give an empty text, as do pages without main text.
    Character references are decoded, white space within a block becomes one space, and
    blocks stand on lines of their own in page order.  Nothing is cut, however long; only an
    unclosed script, style, textarea or title hides the rest of its page, as in browsers.
    Rows that repeat are extracted each; a column named ``text`` is replaced.
    """
    weights, pair = train(pages, html_col)
    names = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.select(*(F.col(f"`{c}`") for c in names), text_or_empty(F.col(f"`{html_col}`")).alias("html"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "html")
    return rows.mapInArrow(_extract_batches(weights, pair), f"{schema}, text string" if schema else "text string")
