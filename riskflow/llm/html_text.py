"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks (runs of text between block tags)
with features of the block (words, link density, where it stands, what its
containers are called) and the word counts and link densities of its two
neighbours.  A decision tree, grown by Gini impurity on the labelled table
``LABELLED``, keeps or drops each block.

Defined results: null, empty or markup-free html is read like any other (text
without tags is one block); character references are decoded, white space in a
block becomes one space, kept blocks are joined by one line end; repeated rows
give repeated results; other input columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a text block (fixed values of HTML's block-level elements).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript "
    "object ol option optgroup p pre search section select summary table tbody td template textarea tfoot th thead "
    "title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is never prose.
HIDDEN_TAGS = frozenset(
    "head title script style noscript template svg math object iframe select option optgroup textarea button canvas "
    "audio video datalist".split())
#: Tags around a page's furniture.
FRAME_TAGS = frozenset("nav footer aside form menu dialog header search".split())
#: Words in class, id or role names of furniture.
FRAME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|"
    r"overlay|newsletter|subscri\w+|share|sharing|social|related|recommend\w*|sidebar|side|widget|nav\w*|menu|"
    r"breadcrumbs?|pagination|pager|footer|foot|masthead|header|comments?|comment\w+|replies|reply|discuss\w*|disqus|"
    r"respond|login|signup|search|toolbar|skip|copyright|legal|navigation|complementary|contentinfo|alert)(?:$|[\s_-])", re.I)
#: Containers that hold the article.
MAIN_TAGS = frozenset(["article", "main"])

FEATURES = ("hidden", "frame", "named", "inside", "outside", "words", "link", "prev_words", "prev_link", "next_words", "next_link")
#: Labelled blocks: the features above, then 1 (main text) or 0.  ``inside`` and
#: ``outside`` tell where a block stands on a page that marks its article.
LABELLED = [
    # article pages
    (0, 0, 0, 1, 0, 40, 0.0, 30, 0.0, 25, 0.0, 1), (0, 0, 0, 1, 0, 120, 0.02, 40, 0.0, 60, 0.1, 1),
    (0, 0, 0, 1, 0, 1, 0.0, 50, 0.0, 60, 0.0, 1), (0, 0, 0, 1, 0, 6, 0.0, 0, 0.0, 80, 0.0, 1),
    (0, 0, 0, 1, 0, 2, 0.0, 1, 0.0, 1, 0.0, 1), (0, 0, 0, 1, 0, 9, 1.0, 40, 0.0, 30, 0.0, 1),
    (0, 0, 0, 1, 0, 3, 0.0, 1, 1.0, 7, 0.0, 1), (0, 0, 0, 1, 0, 4, 0.5, 10, 0.0, 0, 0.0, 1),
    (0, 0, 0, 1, 0, 15, 0.0, 4, 1.0, 4, 1.0, 1), (0, 0, 0, 1, 0, 300, 0.3, 5, 1.0, 5, 1.0, 1),
    (0, 1, 0, 1, 0, 5, 0.0, 0, 0.0, 30, 0.0, 0), (0, 1, 0, 1, 0, 40, 0.0, 60, 0.0, 20, 0.0, 0),
    (0, 1, 0, 1, 0, 200, 0.1, 50, 0.0, 50, 0.0, 0), (0, 0, 1, 1, 0, 12, 0.0, 70, 0.0, 50, 0.0, 0),
    (0, 0, 1, 1, 0, 80, 0.0, 70, 0.0, 50, 0.0, 0), (0, 0, 1, 1, 0, 2, 1.0, 70, 0.0, 2, 1.0, 0),
    (0, 1, 1, 1, 0, 30, 0.0, 20, 0.0, 30, 0.0, 0), (1, 0, 0, 1, 0, 30, 0.0, 40, 0.0, 60, 0.0, 0),
    (0, 0, 0, 0, 1, 20, 0.0, 10, 0.0, 60, 0.0, 0), (0, 0, 0, 0, 1, 1, 1.0, 1, 1.0, 1, 1.0, 0),
    (0, 0, 0, 0, 1, 150, 0.0, 80, 0.0, 5, 0.0, 0), (0, 0, 0, 0, 1, 45, 0.2, 10, 0.0, 6, 1.0, 0),
    (0, 1, 0, 0, 1, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 1, 0, 0, 1, 12, 0.0, 60, 0.0, 0, 0.0, 0),
    (0, 0, 1, 0, 1, 14, 0.0, 1, 1.0, 6, 0.0, 0), (1, 0, 0, 0, 1, 8, 0.0, 0, 0.0, 1, 1.0, 0),
    # pages without an article element
    (0, 0, 0, 0, 0, 60, 0.0, 30, 0.0, 50, 0.0, 1), (0, 0, 0, 0, 0, 25, 0.1, 60, 0.0, 40, 0.0, 1),
    (0, 0, 0, 0, 0, 6, 0.0, 2, 1.0, 60, 0.0, 1), (0, 0, 0, 0, 0, 3, 0.0, 40, 0.0, 30, 0.0, 1),
    (0, 0, 0, 0, 0, 1, 0.0, 12, 0.0, 25, 0.0, 1), (0, 0, 0, 0, 0, 90, 0.25, 0, 0.0, 0, 0.0, 1),
    (0, 0, 0, 0, 0, 5, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 0, 18, 0.0, 3, 1.0, 2, 1.0, 1),
    (0, 0, 0, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 0, 0, 0, 0, 3, 1.0, 2, 1.0, 40, 0.0, 0),
    (0, 0, 0, 0, 0, 8, 0.9, 40, 0.0, 3, 1.0, 0), (0, 0, 0, 0, 0, 20, 0.8, 5, 1.0, 4, 1.0, 0),
    (0, 0, 0, 0, 0, 2, 0.6, 1, 1.0, 60, 0.0, 0), (0, 0, 0, 0, 0, 4, 1.0, 0, 0.0, 0, 0.0, 0),
    (0, 1, 0, 0, 0, 30, 0.0, 50, 0.0, 0, 0.0, 0), (0, 1, 0, 0, 0, 2, 1.0, 2, 1.0, 2, 1.0, 0),
    (0, 1, 0, 0, 0, 150, 0.0, 50, 0.0, 60, 0.0, 0), (0, 0, 1, 0, 0, 40, 0.0, 60, 0.0, 10, 0.0, 0),
    (0, 0, 1, 0, 0, 3, 0.0, 60, 0.0, 5, 0.0, 0), (0, 1, 1, 0, 0, 25, 0.0, 20, 0.0, 25, 0.0, 0),
    (1, 0, 0, 0, 0, 12, 0.0, 0, 0.0, 20, 0.0, 0), (1, 0, 0, 0, 0, 200, 0.0, 30, 0.0, 60, 0.0, 0),
]


def _gini(rows: list) -> float:
    p = sum(r[-1] for r in rows) / len(rows)
    return 2 * p * (1 - p)


def grow(rows: list):
    """A decision tree: a label, or (feature, threshold, tree if <=, tree if >)."""
    labels = {r[-1] for r in rows}
    if len(labels) == 1:
        return labels.pop()
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:]):
            cut = (lo + hi) / 2
            left, right = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            score = (len(left) * _gini(left) + len(right) * _gini(right)) / len(rows)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, cut, left, right)
    if best is None:
        return int(2 * sum(r[-1] for r in rows) >= len(rows))
    return best[1], best[2], grow(best[3]), grow(best[4])


@lru_cache(maxsize=1)
def trained():
    return grow(LABELLED)


def decide(tree, row) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


class _Blocks(HTMLParser):
    """Flat text blocks: [text pieces, linked characters, all characters, hidden, frame, named, main]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.open: list[tuple[str, tuple]] = []  # open containers and the state inside them
        self.state = (0, 0, 0, 0)  # hidden, frame, named, main
        self.links = 0
        self.page_main = 0
        self.silent = 0  # open tags whose content is no text
        self._new()

    def _new(self):
        self.now = [[], 0, 0, self.state]

    def _end(self):
        if self.now[2]:
            self.blocks.append(self.now)
        self._new()

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.links = 1
            return
        if tag in HIDDEN_TAGS and tag not in VOID_TAGS:
            if tag in BLOCK_TAGS:
                self._end()
            self.open.append((tag, self.state))
            self.silent += 1
            return
        named = hidden = 0
        for name, value in attrs:
            if value and name in ("class", "id", "role") and FRAME_NAMES.search(value):
                named = 1
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                hidden = 1
        if tag not in BLOCK_TAGS and not named and not hidden:
            if tag == "br":
                self.now[0].append(" ")
            return
        self._end()
        if tag in BLOCK_TAGS:
            self.links = 0
        if tag in VOID_TAGS:
            return
        if tag in ("p", "li", "option", "td", "th", "tr", "dd", "dt"):
            self._close_same(tag)
        if tag == "body":
            while self.open and self.open[-1][0] in HIDDEN_TAGS:
                self._leave(len(self.open) - 1)
        h, f, n, m = self.state
        self.open.append((tag, self.state))
        if tag in ("body", "html", "article", "main"):
            named = 0  # a whole page or article is never furniture by its name
        if tag in MAIN_TAGS and not (h or f or n):
            m = self.page_main = 1
        self.state = (h or hidden, f or int(tag in FRAME_TAGS), n or named, m)
        self.now[3] = self.state

    def _close_same(self, tag):
        """An open p, li, .. ends where the next one starts (its list or table is not left)."""
        walls = ("ul", "ol", "menu", "dl", "table", "select", "article", "main", "section", "div", "body", "td", "th",
                 "blockquote", "nav", "footer", "aside", "form", "header", "figure")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._leave(i)
                return
            if self.open[i][0] in walls:
                return

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = 0
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                break
        else:
            if tag in BLOCK_TAGS:
                self._end()
            return
        if tag not in HIDDEN_TAGS or tag in BLOCK_TAGS:
            self._end()
        self._leave(i)
        if not self.now[2]:
            self._new()

    def _leave(self, i):
        """Close the i-th open container and all inside it."""
        self.silent -= sum(t in HIDDEN_TAGS for t, _ in self.open[i:])
        self.state = self.open[i][1]
        del self.open[i:]

    def handle_data(self, data):
        if self.silent:
            return
        n = len(data) - data.count(" ") if not data.isspace() else 0
        self.now[0].append(data)
        self.now[2] += n
        self.now[1] += n * self.links

    def finish(self):
        self.close()
        self._end()


def text_blocks(html: str | None) -> list[tuple[str, tuple]]:
    """(text, features) of the blocks of a page, in page order."""
    p = _Blocks()
    p.feed(html or "")
    p.finish()
    flat = []
    for pieces, linked, chars, state in p.blocks:
        text = " ".join("".join(pieces).split())
        if text:
            flat.append((text, state, len(text.split(" ")), linked / chars))
    out = []
    for i, (text, state, words, link) in enumerate(flat):
        before = flat[i - 1][2:] if i else (0, 0.0)
        after = flat[i + 1][2:] if i + 1 < len(flat) else (0, 0.0)
        out.append((text, (*state[:3], state[3], int(p.page_main and not state[3]), words, link, *before, *after)))
    return out


def main_text(html: str | None) -> str:
    tree = trained()
    return "\n".join(t for t, row in text_blocks(html) if decide(tree, row))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "id bigint, url string, text string, n_chars bigint").withColumnRenamed(
        "id", id_col).withColumnRenamed("url", url_col)
