"""HTML extraction by tag-path ratios.

Text leaves are grouped by their path of tags from the root. For each path the
mean length of its leaves, and the mean number of punctuation marks in them, say how
much its nodes look like prose. Both ratios are smoothed along the page with Gaussian
weights, weakened by the edit distance of the paths, then fused by their
product; a path is content if the mean of its leaves reaches a threshold that
follows the spread of the page's values.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.cluster import batches

#: Leaves on either side that smoothing reaches, and its width.
RADIUS, WIDTH = 2, 1.0
#: The threshold as a share of the standard deviation of the fused values.
SHARE = 0.5

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)(?:[^>"']|"[^"]*"|'[^']*')*+>|(!--)|[!?][^>]*>)""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)[^>]*>")
_SPACES = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "noscript", "noframes", "textarea", "iframe", "title", "xmp")}
#: What may hold its own kind: its end is the one that its start is paired with.
_NESTED = {
    t: re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(/?){t}(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>""", re.I | re.S)
    for t in ("svg", "select", "template")
}
#: What takes the rest of the page where it has no end.
_ENDLESS = frozenset(("script", "style"))
#: Tags that may stand in a head; any other, or text, ends it.
_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr img ins del label".split())
#: What an opening tag closes, and how far out it looks for it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_WALLS = frozenset("html body div article section main aside header footer nav td th li dd table ul ol dl form blockquote figure button".split())
_CLOSE_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _open(stack: list[str], name: str) -> None:
    """Closes what the opening of a tag closes."""
    closes, walls = ({"p"}, _WALLS) if name in _CLOSE_P else _CLOSES.get(name, (None, None))
    if closes:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in closes:
                del stack[i:]
                return
            if stack[i] in walls:
                return


def _ends(page: str, name: str) -> dict[int, int]:
    """Where each element of a kind in _NESTED that has an end starts and ends."""
    out: dict[int, int] = {}
    begun: list[int] = []
    for m in _NESTED[name].finditer(page):
        if m[2]:
            if begun:
                out[begun.pop()] = m.end()
        elif m[2] == "" and not (name == "svg" and m[0].endswith("/>")):
            begun.append(m.start())
    return out


def leaves(page: str) -> list[tuple[tuple[str, ...], str, bool]]:
    """(path, text, whether a block begins before it) of the text leaves of a page, outside its head."""
    out: list[tuple[tuple[str, ...], str, bool]] = []
    stack: list[str] = []
    pos, broken = 0, True
    last = page.rfind(">")
    ends: dict[str, dict[int, int]] = {}
    endless: set[str] = set()

    def text(upto: int) -> None:
        nonlocal broken
        if upto > pos and (found := _SPACES.sub(" ", page[pos:upto])):
            if "head" in stack:
                if found == " ":
                    return
                del stack[stack.index("head") :]
            if found != " ":
                out.append((tuple(stack), entities.unescape(found) if "&" in found else found, broken))
                broken = False
            elif not broken and out:
                out[-1] = (out[-1][0], out[-1][1] + " ", out[-1][2])

    at = 0
    while (m := _TAG.search(page, at)) or ((m := _LOOSE.search(page, at)) if at <= last else None):
        text(m.start())
        pos = at = m.end()
        if m.re is _TAG and m[3]:
            end = page.find("-->", m.end())
            if end < 0:
                return out
            pos = at = end + 3
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        if name not in _INLINE:
            broken = True
        if m[1]:
            if name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
            continue
        if "head" in stack and name not in _HEAD:
            del stack[stack.index("head") :]
        if name in _VOID:
            if name == "hr":
                _open(stack, name)
            continue
        if name in _NESTED:
            if name not in ends:
                ends[name] = _ends(page, name)
            pos = at = ends[name].get(m.start(), at)
            continue
        if name in _RAW and (name != "noframes" or "head" in stack):
            end = None if name in endless else _RAW[name].search(page, at)
            if end:
                pos = at = end.end()
            elif name in _ENDLESS:
                return out
            else:
                endless.add(name)
            continue
        _open(stack, name)
        stack.append(name)
    text(len(page))
    return out


def distance(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Edit distance of two paths."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def content(found: list[tuple[tuple[str, ...], str, bool]], radius: int = RADIUS, width: float = WIDTH, share: float = SHARE) -> np.ndarray:
    """Which leaves are content."""
    n = len(found)
    if not n:
        return np.zeros(0, bool)
    number: dict[tuple[str, ...], int] = {}
    path = np.array([number.setdefault(p, len(number)) for p, _, _ in found])
    paths = list(number)
    count = np.bincount(path)
    length = (np.bincount(path, weights=[len(t) for _, t, _ in found]) / count)[path]
    marks = (np.bincount(path, weights=[len(_PUNCTUATION.findall(t)) for _, t, _ in found]) / count)[path]
    known: dict[tuple[int, int], float] = {}
    near: list[tuple[int, np.ndarray]] = []
    for d in range(1, radius + 1):
        if d < n:
            pairs = list(zip(path[:-d].tolist(), path[d:].tolist()))
            for p in set(pairs):
                if p not in known:
                    known[p] = 1.0 / (1 + distance(paths[p[0]], paths[p[1]]))
            near.append((d, np.exp(-d * d / (2 * width * width)) * np.array([known[p] for p in pairs])))
    smooth = []
    for value in (length, marks):
        total, weight = value.copy(), np.ones(n)
        for d, w in near:
            total[d:] += w * value[:-d]
            weight[d:] += w
            total[:-d] += w * value[d:]
            weight[:-d] += w
        smooth.append(total / weight)
    fused = smooth[0] * smooth[1]
    mean = np.bincount(path, weights=fused) / count
    return (mean >= max(share * fused.std(), 1e-9))[path]


def extract(page: str) -> tuple[str, int, int]:
    """The content of a page, its number of text leaves, and of those kept."""
    found = leaves(page)
    keep = content(found)
    out: list[str] = []
    block = True
    for (_, text, broken), k in zip(found, keep):
        block |= broken
        if k:
            if block and out:
                out[-1] = out[-1].rstrip()
                out.append("\n")
            out.append(text.lstrip() if block else text)
            block = False
    return "".join(out).strip(), len(found), int(keep.sum())


def _extracted(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        made = [extract(p) if p is not None else (None, 0, 0) for p in batch.column("html").to_pylist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int64()))] if made else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], ["page_id", "text", "n_leaves", "n_kept"])


def extracted(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each row of df: (page_id, text, n_leaves, n_kept).

    A null page has a null text; one that is empty, or has no prose, an empty text. Unclosed and crossed tags are closed as
    browsers do with paragraphs, list items and table cells, and a head at the first tag or text that may not stand in
    it; an unclosed comment, script or style takes the rest of the page, any other element no more than its own tag. Texts of inline tags are joined, blocks are put on lines of their own. A path whose value is
    just the threshold is content. Null and repeated ids stay. An empty table gives no rows. Other columns are not read.
    """
    batches(df.sparkSession)
    slim = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(_extracted, "page_id long, text string, n_leaves long, n_kept long")
