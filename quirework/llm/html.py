"""HTML extraction by tag-path ratios: paths whose text nodes are long and punctuated hold the content.

For each root-to-leaf path of tags, the characters and the punctuation of its text nodes are added up and divided by the
number of those nodes. Over the sequence of nodes both ratios are smoothed with a Gaussian and multiplied; a path is
content if the mean of that over its nodes reaches ``LEVEL`` standard deviations of the sequence.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, text string, n_nodes int, content_nodes int, content_paths array<string>"
LEVEL, RADIUS, SIGMA = 0.7, 1, 0.4
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe".split())
#: A start tag ends an open element of these.
ENDS = {t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
ENDS |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Elements beyond which a start tag ends nothing.
SCOPE = frozenset("html body table td th ul ol dl div article section aside main nav header footer button".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><\"']*)", re.DOTALL)
ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.DOTALL)
#: Tags of a path that are written out; of a longer one the last, after the number of the others.
WRITTEN = 64
SPACE = re.compile(r"\s+")
MARKS = re.compile("[.,;:!?…。，、；：！？،؛؟।]")


class Ends:
    """Where tags end. Once one was found not to end, all others are looked up: a page of them takes linear time."""

    def __init__(self, page: str) -> None:
        self.page, self.at, self.end = page, None, []

    def of(self, p: int) -> int:
        """The end of a tag whose attributes begin at p, or -1."""
        if self.at is None:
            if m := ATTRIBUTES.match(self.page, p):
                return m.end()
            self.at = [m.start() for m in re.finditer("[>\"']", self.page)]
            # from the last sign to the first: the end outside of quotes, within double and within single ones
            out = double = single = -1
            for i in reversed(self.at):
                c = self.page[i]
                out, double, single = (i + 1, double, single) if c == ">" else (double, out, single) if c == '"' else (single, double, out)
                self.end.append(out)
            self.end.reverse()
        i = bisect_left(self.at, p)
        return self.end[i] if i < len(self.at) else -1


class Paths:
    """The root-to-leaf tag paths of a page as numbers: each is a tag below another path; 0 is the root."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.up, self.tag, self.depth, self.head = [0], [""], [0], [False]

    def below(self, path: int, tag: str) -> int:
        n = self.number.setdefault((path, tag), len(self.up))
        if n == len(self.up):
            self.up.append(path)
            self.tag.append(tag)
            self.depth.append(self.depth[path] + 1)
            self.head.append(self.head[path] or (tag.startswith("head") and self.depth[path] == 1 and self.tag[path] == "html"))
        return n

    def written(self, path: int) -> str:
        tags, deep = [], self.depth[path]
        while path and len(tags) < WRITTEN:
            tags.append(self.tag[path])
            path = self.up[path]
        return ">".join(([f"({deep - WRITTEN})"] if path else []) + tags[::-1])


def numbered_nodes(page: str) -> tuple[list[tuple[int, str, int]], Paths]:
    """(number of the path, text, number of its block) of the text nodes with other than blanks, in order, and the paths.
    Never fails, and takes linear time and space whatever the markup."""
    out: list[tuple[int, str, int]] = []
    paths, ends = Paths(), Ends(page)
    stack: list[tuple[str, int]] = []  # open tags, each with its path
    where: dict[str, list[int]] = {}  # their places in it
    path, at, seek, block, end = 0, 0, 0, 0, len(page)

    def add(a: int, b: int) -> None:
        if a < b and (t := SPACE.sub(" ", entities.unescape(page[a:b])).strip()):
            out.append((path, t, block))

    def close(keep: int) -> None:
        while len(stack) > keep:
            where[stack.pop()[0]].pop()

    while at < end:
        m = TAG.search(page, seek)
        if m is None:
            add(at, end)
            break
        name, stop = (m[2] or "").lower(), m.end()
        if name and (stop := ends.of(stop)) < 0:
            seek = m.start() + 1
            continue
        add(at, m.start())
        at = seek = stop
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m.start() + 9, at - 3 if m[0].endswith("]]>") else at)
            continue
        alone = page[stop - 2] == "/"
        if name not in INLINE:
            block += 1
        if m[1]:
            if where.get(name):
                close(where[name][-1])
        elif name in RAW:
            if not alone:
                shut = re.compile(f"</{re.escape(name)}\\b", re.IGNORECASE).search(page, at)
                at = seek = page.find(">", shut.end()) + 1 or end if shut else end
        elif name not in VOID and not alone:
            if over := ENDS.get(name):
                low = max((where[t][-1] for t in SCOPE if t not in over and where.get(t)), default=-1)
                close(min((where[t][bisect_right(where[t], low)] for t in over if where.get(t) and where[t][-1] > low), default=len(stack)))
            where.setdefault(name, []).append(len(stack))
            stack.append((name, paths.below(stack[-1][1] if stack else 0, name)))
        path = stack[-1][1] if stack else 0
    return out, paths


def text_nodes(page: str) -> list[tuple[str, str, int]]:
    """``numbered_nodes`` with their paths as they are written."""
    nodes, paths = numbered_nodes(page)
    return [(paths.written(p), t, block) for p, t, block in nodes]


def smooth(x: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means; at the ends, over what there is."""
    w = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(x, w)[radius : radius + len(x)] / np.convolve(np.ones(len(x)), w)[radius : radius + len(x)]


def ratios(nodes: list[tuple[str | int, str, int]], level: float) -> dict[str | int, float]:
    """The paths of which the mean fused ratio reaches the level, with that mean."""
    if not nodes:
        return {}
    number: dict[str | int, int] = {}
    of = np.array([number.setdefault(p, len(number)) for p, _, _ in nodes])
    count = np.bincount(of)
    length = np.bincount(of, [len(t) for _, t, _ in nodes]) / count
    marks = np.bincount(of, [len(MARKS.findall(t)) for _, t, _ in nodes]) / count
    fused = smooth(length[of]) * smooth(1 + marks[of])
    mean, least = np.bincount(of, fused) / count, level * fused.std()
    return {p: float(mean[i]) for p, i in number.items() if mean[i] >= least}


def content_paths(nodes: list[tuple[str, str, int]], level: float = LEVEL) -> dict[str, float]:
    """The paths taken for content, with their fused ratios."""
    return {p: x for p, x in ratios(nodes, level).items() if not p.startswith("html>head")}


def extract(page: str | None, level: float = LEVEL) -> tuple[str, int, int, list[str]]:
    """(text, text nodes, content nodes, content paths); a line for each block of content."""
    nodes, named = numbered_nodes(page or "")
    paths = {p for p in ratios(nodes, level) if not named.head[p]}
    lines: list[str] = []
    before = n = 0
    for p, t, block in nodes:
        if p in paths:
            if n and block == before:
                lines[-1] += " " + t
            else:
                lines.append(t)
            before, n = block, n + 1
    return "\n".join(lines), len(nodes), n, sorted(map(named.written, paths))


def extract_pages(pages: DataFrame, level: float = LEVEL) -> DataFrame:
    """(page_id, text, n_nodes, content_nodes, content_paths) of every row: no shuffle, whole pages.

    Null and empty pages and those of blanks or tags only: empty text, no nodes. Text without a tag: one node, of the
    empty path, which is content. Broken markup: tags that don't end are text; end tags that match nothing are passed
    over. Ties: a path at the threshold is content, so with equal ratios all paths are. Null id and repeated rows: a row
    each. Very long pages: whole, in linear time; a path of more than ``WRITTEN`` tags is written as the number of those
    left out and the last ones. No rows: none. Extra columns aren't passed on.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                rows = [extract(x, level) for x in part.column(1).to_pylist()]
                text, nodes, n, paths = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(nodes, pa.int32()), pa.array(n, pa.int32()), pa.array(paths, pa.list_(pa.string()))], ["page_id", "text", "n_nodes", "content_nodes", "content_paths"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(one, SCHEMA)
