"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each with its path of
block-level elements from the root.  What is marked as navigation, advert, form, comments and so on is
set aside.  Per page and path, text length and punctuation are added up and divided by the path's
number of blocks.  Both ratios are smoothed by a Gaussian over the blocks in page order, as far as they
stand close in the tree, and multiplied; paths whose mean is at least the threshold (a share of the
standard deviation) are selected.

The article is the lowest element that holds all selected blocks and the heading above them, and the
<article> or <main> closest around it where there is one.  Where selected blocks stand on both sides of
an <article> or <main> that holds most of their text, that is the article.  All blocks in it are kept that
aren't marked.  A mark by a part of a class or id that also names subjects of articles (``related-work``,
``search-results``) only holds for boxes whose paths aren't selected.  So ratios decide where the article is,
and which boxes in it belong to it.

Pages are handled one by one, so memory follows the largest page and a lost task is simply run again.

Defined results
---------------
* Null and empty pages, and pages without any text, give an empty string.
* Unclosed and misplaced tags are tolerated; an unclosed comment, script or tag lasts to the end.
* ``<br>`` counts as white space.  White space of any kind (no-break spaces too) becomes one blank.
* Text in hidden elements, scripts, styles, templates and form controls is no content.
* Only id, URL and HTML are read, so further columns may have any names; repeated rows stay repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches

#: The threshold for a path's fused ratio, as a share of the standard deviation over the page's blocks.
THRESHOLD = 1.0
#: Blocks on either side that ratios are smoothed over.
REACH = 2
#: An <article> or <main> with more than this share of the selected text is the article, where none holds all of it.
MOST = 0.5

# Fixed values of HTML.
_RAW = frozenset("script style template textarea title iframe noembed noframes noscript xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var nobr".split()
)
_GROUPS = frozenset("html body div article main section td tr tbody table center blockquote ul ol dl li dd".split())
_CLOSES = {  # an opening tag ends these open elements, if no element in the second set stands between
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What never belongs to the article, by tag, role and word of a class or id.
_OTHER_TAGS = frozenset("nav footer aside form head select button menu dialog object svg math canvas audio video map datalist".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_OTHER_WORDS = frozenset(
    # menus
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar skip"
    # headers and footers
    " header masthead topbar footer copyright"
    # sidebars
    " sidebar widget widgets related recommended recommendations share sharing social"
    # notices
    " notice notices cookie cookies consent gdpr popup modal overlay"
    # adverts
    " ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion"
    # forms
    " newsletter subscribe subscription signup login search"
    # reader comments
    " comment comments commentlist disqus replies respond".split()
)

# Of these words, those that are marks for sure only as a whole class or id: as a part of one they may be an article's subject.
_SUBJECTS = frozenset(
    "nav navigation menu pager skip header banner related recommended recommendations share sharing social notice notices overlay"
    " search login signup respond replies".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote counts only behind "="; possessive, so that broken tags cost no backtracking
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)|([^<]+)|<""",
    re.DOTALL,
)
# Names are only looked for where they begin, so that long ones cost no backtracking.
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])(?:([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))|((?i:hidden))(?![\w-]))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.IGNORECASE) for t in _RAW}


def _punctuation(text: str) -> int:
    return sum(map(text.count, ".,;:!?。，、；：！？"))


class _Page:
    """Elements and blocks of a page, in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.other, self.by_word, self.by_part, self.path = ["#"], [-1], [False], [False], [False], [0]
        self.paths = {(-1, "#"): 0}
        self.texts: list[str] = []
        self.owner: list[int] = []
        self._stack, self._parts = [0], []
        self._depths: dict[str, list[int]] = {}  # of the open elements of each tag
        self._read(html)
        self._flush()

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.texts.append(text)
                self.owner.append(self._stack[-1])
            self._parts = []

    def _pop_to(self, depth: int) -> None:
        self._flush()
        for e in self._stack[depth:]:
            self._depths[self.tag[e]].pop()
        del self._stack[depth:]

    def _deepest(self, tags: set[str]) -> int:
        """The depth of the innermost open element with one of the tags, or 0."""
        return max((d[-1] for t in tags if (d := self._depths.get(t))), default=0)

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        if tag not in _INLINE:
            if self.tag[self._stack[-1]] == "p":
                self._pop_to(len(self._stack) - 1)
            if tag in _CLOSES:
                ends, stop = _CLOSES[tag]
                if (depth := self._deepest(ends)) > self._deepest(stop):
                    self._pop_to(depth)
        above, i = self._stack[-1], len(self.tag)
        other, by_word, by_part, name = tag in _OTHER_TAGS, False, False, tag
        for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            key, value = key.lower(), a or b or c
            if hidden or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                other = True
            elif key == "role":
                other |= value.lower() in _OTHER_ROLES
            elif key in ("class", "id"):
                name += f".{value}" if key == "class" else ""
                for label in value.split():
                    words = {w.lower() for w in _WORD.findall(label)} & _OTHER_WORDS
                    if label.lower() in _OTHER_WORDS or words - _SUBJECTS:
                        by_word = True
                    elif words:
                        by_part = True
        if tag == "header":
            by_word = True
        if tag in ("html", "body", "main", "article") and not re.search("comment", attributes, re.IGNORECASE):
            by_word = by_part = False
        self.tag.append(tag)
        self.parent.append(above)
        self.other.append(other or self.other[above])
        self.by_word.append(by_word)
        self.by_part.append(by_part)
        self.path.append(self.paths.setdefault((self.path[above], name), len(self.paths)))
        self._depths.setdefault(tag, []).append(len(self._stack))
        self._stack.append(i)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.match(html, at)
            at = m.end()
            text = m[4]
            if text is not None:
                text = unescape(text)
                self._parts.append(text)
                continue
            closing, tag, attributes = m[1], m[2], m[3]
            if not tag:
                whole = m[0]
                if whole == "<":
                    self._parts.append(whole)
                elif whole.startswith("<![CDATA["):
                    self._parts.append(whole[9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if closing:
                if tag not in _INLINE:
                    if depth := self._deepest({tag}):
                        self._pop_to(depth)
                    elif tag in ("p", "br"):
                        self._flush()
            elif tag in _RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else size
            elif tag in _VOID:
                if tag == "hr":
                    self._flush()
                else:
                    self._parts.append(" ")
            elif tag in _INLINE:
                pass
            elif not attributes.endswith("/") or tag not in ("svg", "math"):
                self._open(tag, attributes)

    def article(self) -> list[str]:
        if not self.texts:
            return []
        marked = self._marked()
        own = [i for i, e in enumerate(self.owner) if not marked[e]]
        if not own:  # only marked text: then classes and ids say nothing
            marked = self.other
            own = [i for i, e in enumerate(self.owner) if not marked[e]]
        if not own:
            return []
        chosen, rich = self._chosen(own)
        void = self._void(rich)
        own = [i for i in own if not void[self.owner[i]]]
        chosen &= set(own)
        top = self._container(own, chosen)
        inside = np.zeros(len(self.tag), bool)
        inside[top] = True
        for e in range(top + 1, len(self.tag)):
            inside[e] |= inside[self.parent[e]]
        return [self.texts[i] for i in own if inside[self.owner[i]]]

    def _void(self, rich: set[int]) -> list[bool]:
        """Elements in boxes that a part of their class or id marks and that hold no block of a path that reaches the threshold."""
        holds = [False] * len(self.tag)
        for i in rich:
            holds[self.owner[i]] = True
        for e in range(len(self.tag) - 1, 0, -1):
            holds[self.parent[e]] |= holds[e]
        void = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            void[e] = void[self.parent[e]] or (self.by_part[e] and not holds[e])
        return void

    def _marked(self) -> list[bool]:
        """Elements under a mark.  A mark by class or id is void around the article or its heading."""
        holds = [False] * len(self.tag)
        for e in range(len(self.tag) - 1, 0, -1):
            if self.tag[e] in ("article", "main", "h1") and not self.other[e] and not self.by_word[e]:
                holds[e] = True
            if holds[e]:
                holds[self.parent[e]] = True
        within = [False] * len(self.tag)  # an article
        header = [False] * len(self.tag)  # of an article, and not in another marked element below it
        marked = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            up, tag = self.parent[e], self.tag[e]
            within[e] = within[up] or tag in ("article", "main")
            if tag == "header":
                header[e] = True
            elif tag not in ("article", "main") and not self.by_word[e]:
                header[e] = header[up]
            marked[e] = marked[up] or self.other[e] or (self.by_word[e] and not holds[e])
            if tag == "header" or (self.by_word[e] and holds[e] and within[up]):
                # of a header, only headings within an article belong to it
                marked[e] = True
            if marked[e] and within[up] and tag in _HEADINGS and not self.other[e] and header[up]:
                marked[e] = False
        return marked

    def _chosen(self, own: list[int]) -> tuple[set[int], set[int]]:
        """Blocks of paths whose smoothed and fused ratios reach the threshold, and of those that reach it without their neighbours."""
        path = np.array([self.path[self.owner[i]] for i in own])
        _, group = np.unique(path, return_inverse=True)
        blocks = np.bincount(group)
        text = np.bincount(group, [len(self.texts[i]) for i in own]) / blocks
        marks = np.bincount(group, [_punctuation(self.texts[i]) for i in own]) / blocks
        up = np.array([self.parent[self.owner[i]] for i in own])
        above = np.array([self.parent[e] if e >= 0 else -1 for e in up])

        def smooth(x: np.ndarray) -> np.ndarray:
            """The Gaussian mean of each block and those up to REACH places away with the same parent or grandparent."""
            total, weight = x.astype(float), np.ones(len(x))
            for k in range(1, min(REACH, len(x) - 1) + 1):
                w = np.exp(-0.5 * k * k) * ((up[k:] == up[:-k]) | (above[k:] == above[:-k]))
                total[k:] += w * x[:-k]
                total[:-k] += w * x[k:]
                weight[k:] += w
                weight[:-k] += w
            return total / weight

        fused = smooth(text[group]) * smooth(marks[group])
        mean = np.bincount(group, fused) / blocks
        least = min(THRESHOLD * fused.std(), mean.max())  # the best path is always selected
        bare = text * marks
        return {i for i, g in zip(own, group) if mean[g] >= least}, {i for i, g in zip(own, group) if bare[g] >= least}

    def _container(self, own: list[int], chosen: set[int]) -> int:
        """The element that is the article."""

        def sums(of: dict[int, int]) -> list[int]:
            out = [0] * len(self.tag)
            for i, x in of.items():
                out[self.owner[i]] += x
            for e in range(len(self.tag) - 1, 0, -1):
                out[self.parent[e]] += out[e]
            return out

        hinted = [e for e in range(1, len(self.tag)) if self.tag[e] in ("article", "main")]
        held = sums({i: len(self.texts[i]) for i in chosen})
        whole = [e for e in hinted if held[e] == held[0]]
        if whole:
            return whole[-1]
        most = max(hinted, key=lambda e: held[e], default=0)  # of equals the outermost, which comes first
        if most and held[most] > MOST * held[0]:
            return most
        needed = sums(dict.fromkeys(chosen | self._title(own, chosen), 1))
        top, e = 0, 0
        below: dict[int, list[int]] = {}
        for c in range(1, len(self.tag)):
            below.setdefault(self.parent[c], []).append(c)
        while True:
            e = next((c for c in below.get(e, ()) if self.tag[c] in _GROUPS and needed[c] == needed[0]), 0)
            if not e:
                return top
            if self.tag[e] not in ("ul", "ol", "dl", "li", "dd", "td", "blockquote"):
                top = e

    def _title(self, own: list[int], chosen: set[int]) -> set[int]:
        """The block of the highest heading above the selected blocks, of equals the last; or none."""
        heading = [0] * len(self.tag)  # the element itself or the nearest one around it
        for e in range(1, len(self.tag)):
            heading[e] = e if self.tag[e] in _HEADINGS else heading[self.parent[e]]
        best, level = set(), 7
        for i in own:
            e = heading[self.owner[i]]
            if e and int(self.tag[e][1]) <= level:
                best, level = {i}, int(self.tag[e][1])
            if i in chosen:
                break
        return best


def main_text(html: str | None) -> str:
    """The main text of one page, its blocks joined by line feeds."""
    return "\n".join(_Page(html).article()) if html else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, URL, text, n_chars."""
    small_batches(pages.sparkSession)
    chosen = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    out = chosen.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
