"""The main text of web pages by tag-path ratios.

Every block of text has a root-to-leaf tag path. Text length and punctuation are
aggregated per path, the two ratios are smoothed along the page and fused, and paths
above a threshold are content. What a page marks as furniture (menus, forms, hidden parts
and the like) takes no part. A class or id that names furniture is a hint only: the ratios
of the whole page decide whether it is followed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLOCKS = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
    "td th caption blockquote pre figure figcaption header footer nav aside form fieldset address hr details "
    "summary center dialog menu".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas video audio select".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
FURNITURE = frozenset("head nav footer aside form fieldset button label dialog menu option".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu form".split())
# Words of class names and ids that name furniture, and names that only speak of it.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsor(?:s|ed)?|promos?|promotions?|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|sidebars?|aside|"
    r"widgets?|related|recommend(?:ed|ations)|shar(?:e|ing)|social|menus?|nav|navbar|navigation|breadcrumbs?|toolbar|"
    r"pagination|pager|footer|comments?|commentlist|replies|reply|respond|discussion|disqus|login|signup|search|"
    r"skip|disclaimer|copyright)(?:$|[\s_-])", re.I)
LAYOUT = re.compile(r"(?<![^\s_-])(?:no|non|not|with|without|has|have)[_-]\S*", re.I)
TOP = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# A start tag ends open elements of these kinds, down to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"})}
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？؟،]")
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PHRASE = HEADING | frozenset("p li dt dd td th caption figcaption blockquote pre".split())
WHOLE = frozenset(("html", "body", "article", "main"))
# Standard deviation of the smoothing along the page in blocks; share of the highest path
# score from which a path is content; share of link text from which it never is.
SMOOTH, THRESHOLD, LINKED = 1.0, 0.15, 0.5


class Blocks:
    """The text blocks of a page in order, with the path each one hangs on."""

    def __init__(self, html: str):
        self.parent, self.label, self.ids = [-1], [""], {}
        self.path, self.text, self.linked, self.rank, self.hint = [], [], [], [], []
        # Elements named like furniture: the one around each, and its rank.
        self.hints: list[tuple[int, int]] = []
        # Name, path, whether it is furniture, its rank (2 in an article, 1 in main, else 0),
        # the innermost element named like furniture.
        self.stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, -1)]
        # Depths of the open elements by name, and of all open blocks under "*".
        self.depths: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.links = self.in_link = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, end = 0, html.rfind(">") + 1
        while True:
            match = MARKUP.search(html, at, end)
            self._add(html[at:match.start()] if match else html[at:].split("<!--")[0])
            if not match:
                break
            at = match.end()
            close, name, rest = match.group(1, 2, 3) if match[2] else match.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if close:
                self._close(name)
            elif name in RAW and not rest.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                self.parts.append(" ")
                at = stop.end() if stop else len(html)
            else:
                self._open(name, rest)
        self._flush()

    def _add(self, raw: str) -> None:
        if raw and not self.stack[-1][2]:
            text = unescape(raw)
            self.parts.append(text)
            if self.in_link:
                self.links += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.path.append(self.stack[-1][1])
            self.text.append(text)
            self.linked.append(min(self.links, len(text)))
            self.rank.append(self.stack[-1][3])
            self.hint.append(self.stack[-1][4])
        self.parts, self.links = [], 0

    def _open(self, name: str, rest: str) -> None:
        if name == "br" or name in VOID:
            self.parts.append(" ")
        if name in VOID and name != "hr":
            return
        if name == "a":
            self.in_link += 1
        found = {m[1]: m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest else {}
        out = self._furniture(name, found)
        named = not out and self._named(name, found)
        if name not in BLOCKS and not out and not named:
            return
        self._flush()
        if name in BLOCKS:
            self._pop({"p"}, {"td", "th", "table", "button"})
        if name in ENDS:
            self._pop(*ENDS[name])
        if name == "hr" or rest.endswith("/"):
            return
        label = name + "." + ".".join(found.get("class", "").split())
        _, path, furniture, rank, hint = self.stack[-1]
        if named:
            self.hints.append((hint, rank))
            hint = len(self.hints) - 1
        rank = max(rank, {"article": 2, "main": 1}.get(name, 0))
        for key in (name, "*") if name in BLOCKS else (name,):
            self.depths.setdefault(key, []).append(len(self.stack))
        self.stack.append((name, self._child(path, label), out or furniture, rank, hint))

    def _child(self, parent: int, label: str) -> int:
        key = (parent, label)
        if key not in self.ids:
            self.ids[key] = len(self.label)
            self.parent.append(parent)
            self.label.append(label)
        return self.ids[key]

    def _furniture(self, name: str, found: dict[str, str]) -> bool:
        if name in FURNITURE:
            return True
        inside = self.stack[-1][3]
        if name == "header":
            return not inside
        if not found:
            return False
        if "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "")):
            return True
        return name not in WHOLE and found.get("role") in ROLES

    def _named(self, name: str, found: dict[str, str]) -> bool:
        """Whether class or id name furniture; not asked of headings and of phrases in an article."""
        above, _, _, inside, _ = self.stack[-1]
        if not found or name in WHOLE or name in HEADING or above in HEADING:
            return False
        if inside and name not in BLOCKS and above in PHRASE:
            return False
        names = LAYOUT.sub(" ", f"{found.get('class', '')} {found.get('id', '')}")
        return bool(HINT.search(names) or (not inside and TOP.search(names)))

    def _innermost(self, names: set[str]) -> int:
        """The depth of the innermost open element of these names; 0 for none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def _cut(self, depth: int) -> None:
        """End the element at this depth and all in it, so each is looked at once."""
        for name, *_ in self.stack[depth:]:
            self.depths[name].pop()
            if name in BLOCKS:
                self.depths["*"].pop()
        del self.stack[depth:]

    def _pop(self, kinds: set[str], limit: set[str]) -> None:
        depth = self._innermost(kinds)
        if depth and depth >= self._innermost(limit | {"*"} if kinds == {"p"} else limit):
            self._cut(depth)

    def _close(self, name: str) -> None:
        if name == "a":
            self.in_link = max(0, self.in_link - 1)
        depth = self._innermost({name})
        if name in BLOCKS or depth:
            self._flush()
        if depth:
            self._cut(depth)


def _smoothed(values: np.ndarray) -> np.ndarray:
    reach = np.arange(-2, 3)
    kernel = np.exp(-reach**2 / (2 * SMOOTH**2))
    weight = np.convolve(np.ones(len(values)), kernel, "same")
    return (np.convolve(values, kernel, "same") / weight)[:len(values)] if len(values) >= 5 else values


class Ratios:
    """Score and share of link text of every path, and the paths that are content."""

    def __init__(self, page: Blocks):
        self.path = path = np.array(page.path)
        self.length = np.array([len(t) for t in page.text], float)
        self.linked = np.array(page.linked, float)
        marks = np.array([len(PUNCTUATION.findall(t)) for t in page.text], float)
        n = len(page.label)
        count = np.maximum(np.bincount(path, minlength=n), 1)
        by_text = np.bincount(path, self.length, n) / count
        by_marks = np.bincount(path, marks, n) / count
        self.links = links = np.bincount(path, self.linked, n) / np.maximum(np.bincount(path, self.length, n), 1)
        # Smooth both ratios along the page, fuse them, and take their mean per path.
        fused = _smoothed(by_text[path]) * (1 + _smoothed(by_marks[path])) * (1 - links[path])
        own = by_text[path] * (1 + by_marks[path]) * (1 - links[path])
        self.score = np.bincount(path, np.sqrt(fused * own), n) / count
        self.good = (self.score >= THRESHOLD * self.score.max()) & (links < LINKED)


def _without_furniture(page: Blocks) -> Blocks:
    """The page without those elements named like furniture whose name the ratios do not refute.

    Inside an article or main, the name counts where the text is mostly links or no path in
    the element is content. Elsewhere it counts unless the element holds most of the score
    of the page. Beside text of a higher rank (article, main, neither) it always counts.
    """
    ratios = Ratios(page)
    score, good = ratios.score[ratios.path], ratios.good[ratios.path]
    text = ratios.links[ratios.path] < LINKED
    # Per element, the last row for none: length, linked length, score, blocks of content,
    # and blocks that are no links by rank. First of the blocks right in it, then of all within.
    rank = np.array(page.rank)
    right = np.zeros((len(page.hints) + 1, 7))
    np.add.at(right, page.hint, np.column_stack(
        [ratios.length, ratios.linked, score, good, *[text & (rank == k) for k in range(3)]]).astype(float))
    within, beside = right.copy(), np.zeros((len(right), 3))
    for number in range(len(page.hints) - 1, -1, -1):
        within[page.hints[number][0]] += within[number]
    dropped: set[int] = set()
    for number, (above, level) in enumerate(page.hints):
        beside[number] = beside[above] + right[above, 4:]
        length, linked, held, content = within[number, :4]
        refuted = content > 0 and linked < LINKED * length if level else held > 0.5 * score.sum()
        if above in dropped or beside[number, level + 1:].any() or not refuted:
            dropped.add(number)
    left = [k for k, h in enumerate(page.hint) if h not in dropped]
    for name in ("path", "text", "linked", "rank", "hint"):
        values = getattr(page, name)
        setattr(page, name, [values[k] for k in left])
    return page


def _home(page: Blocks, nodes: list[int]) -> int:
    """The path of the element that holds the content, given the good paths."""
    # A path has a higher number than those around it.
    home, known = nodes[0], set()
    for node in nodes[1:]:
        # What lies below the home so far stays below it, so no path is walked twice.
        while home != node and node not in known:
            if home > node:
                known.add(home)
                home = page.parent[home]
            else:
                known.add(node)
                node = page.parent[node]
    if len(nodes) == 1:
        home = max(page.parent[home], 0)
    node = home
    while node > 0:
        if page.label[node].split(".")[0] in ("article", "main"):
            home = node
        node = page.parent[node]
    return home


def main_text(html: str | None) -> str:
    """The content blocks of one page, joined by line breaks."""
    page = Blocks(html or "")
    if page.text and page.hints:
        page = _without_furniture(page)
    if not page.text:
        return ""
    ratios = Ratios(page)
    path, length, links, good = ratios.path, ratios.length, ratios.links, ratios.good
    n = len(page.label)
    if not good[path].any():
        return "\n".join(page.text)
    # The lowest element around all good paths, or the article or main around it, holds the
    # content: short blocks in it belong to it too.
    home = _home(page, sorted(set(path[good[path]].tolist())))
    inside = np.zeros(n, bool)
    inside[home] = True
    for node in range(home + 1, n):
        inside[node] = inside[page.parent[node]]

    def belongs(node: int) -> bool:
        return bool(good[node] or (inside[node] and links[node] < LINKED))

    kept = {node for node in set(page.path) if belongs(node)}
    return "\n".join(t for node, t in zip(page.path, page.text) if node in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def extract_pages(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row (the ``keep`` columns, text, n_chars) for each row of ``pages``.

    Character references are decoded, white space in a block becomes one space, blocks
    are trimmed and joined in page order by one line break. Null and empty html, and html
    without content, give the empty text. Unclosed and misnested elements are closed as
    browsers do. Repeated rows stay; an empty table gives an empty result; other columns
    are ignored, also one named ``text`` or ``n_chars``.
    """
    rows = pages.select(*keep, F.col(html_column).alias("__html"))
    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes[:-1])
    found = rows.mapInArrow(_extract, f"{fields}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
