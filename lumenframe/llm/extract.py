"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one a block element, each with a length. Markup only
weighs: text in an article or main element counts in full, on pages with such an
element text outside counts OUTSIDE of it, on others lines that are mostly links count
zero. Parts that the markup itself names as menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments leave one line of length
zero, the edges of an article as many as a window has.

The lengths are summed over sliding windows of lines. A text begins at a surge
point, where the sum rises over the level of running text, a share of the page's
densest window; it reaches back and on over the lines with length next to it, to dive points, where
the sum of a whole window falls to nothing. What lies in such a stretch is kept; on
pages without an article also what lies between two of them.

Defined results: a null or empty page, and one without text, gives the empty
text. Unclosed, misnested or cut-off markup is read as far as it goes: a
boilerplate element ends where HTML implies it, or with the element around it. A class
or id names boilerplate if all its words do or are of common use with them
(`site-footer`, but not `related-work`). Drawings, and what browsers show only where
they lack a feature (noscript, object, canvas, audio, video), hold no text; formulas do.
Character references are decoded; white space within a block becomes one space. NUL
characters go, as HTML has it. Repeated rows are each extracted. Columns other than the
named ones are not looked at.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, named, sliced, table

_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|object|canvas|annotation|annotation-xml)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>?""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemtype)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that are never main text.
DROPPED = frozenset("head title nav footer aside form button select option menu dialog label input fieldset audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in class or id that name boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion related respond "
    "share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that go with them in such names.
WITH = frozenset(
    "site main page top bottom left right upper lower bar box list block container wrapper wrap inner outer inside panel area section item items row col column content links link posts post articles "
    "article entry entries stories story bottom primary secondary global local mobile desktop header head title body menu form button buttons btn policy message msg slot unit text icon icons media "
    "network networks tag tags thread reply replies author feed more next prev previous the by in on 1 2 3 4".split()
)
WINDOW = 3
#: What a character outside the article counts on pages with one.
OUTSIDE = 1e-7
#: Share of the densest window that is running text, with and without an article.
LEVEL = {True: 0.02, False: 0.25}
#: Elements that end at the next start tag of one of these, or where the element around them ends.
_P_END = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_GROUPS = frozenset("tbody thead tfoot".split())
IMPLIED = {"p": _P_END, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"} | _GROUPS, "td": {"td", "th", "tr"} | _GROUPS, "th": {"td", "th", "tr"} | _GROUPS, "option": {"option", "optgroup"}, "tbody": _GROUPS, "thead": _GROUPS, "tfoot": _GROUPS, "optgroup": {"optgroup"}}


def _named(attrs: str) -> bool:
    for name, *values in _ATTR.findall(attrs):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for token in re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", value).lower().split():
                words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
                if not NAMES.isdisjoint(words) and all(w in NAMES or w in WITH for w in words):
                    return True
    return False


def _close_implied(stack: list[str], name: str) -> None:
    """Drops from the open elements what a start tag of this name ends."""
    for i in range(len(stack) - 1, -1, -1):
        if name in IMPLIED.get(stack[i], ()):
            del stack[i:]
            return
        if stack[i] in BLOCKS and stack[i] not in IMPLIED:
            return


def lines(page: str) -> list[tuple[str, bool, float]]:
    """(text, within an article or main element, share of text in links) of each line of the stripped page."""
    page = _SKIP.sub(" ", page.replace("\x00", ""))
    tags = list(_TAG.finditer(page))
    ends: dict[str, int] = {}
    for k, m in enumerate(tags):
        if m[1]:
            ends[m[2].lower()] = k  # the last closing tag of this name
    out: list[tuple[str, bool, float]] = []
    parts: list[str] = []
    linked = total = inside = hidden = link = 0
    around: list[str] = []  # open block elements
    within: list[str] = []  # open elements from the hidden one on

    def add(text: str) -> None:
        nonlocal linked, total
        if text and not hidden:
            parts.append(text)
            n = len(text.strip())
            total += n
            linked += n if link else 0

    def line(gap: bool = False) -> None:
        nonlocal linked, total, parts
        text = " ".join(html.unescape("".join(parts)).split())
        if text or (gap and not (out and not out[-1][0])):  # parts that go in a row leave one line
            out.append((text, inside > 0, linked / total if total else 0.0))
        parts, linked, total = [], 0, 0

    def edge() -> None:
        if not inside:
            out.extend([("", False, 0.0)] * WINDOW)

    at = 0
    for k, m in enumerate(tags):
        add(page[at : m.start()])
        at = m.end()
        name, close = m[2].lower(), bool(m[1])
        if hidden:
            if name in VOID:
                continue
            if not close:
                _close_implied(within, name)
                if within:
                    within.append(name)
                    continue
            elif name in within:
                while within.pop() != name:
                    pass
                if not within:
                    hidden = 0
                    line(True)
                continue
            elif name not in around:
                continue
            hidden, within = 0, []  # by a sibling, or by the end of an element around it
            line(True)
        if name == "a":
            link = 0 if close else 1
        if name == "br":
            add(" ")
        if name not in BLOCKS and not (not close and name in DROPPED):
            if not close and name not in VOID and m[3] and _named(m[3]) and ends.get(name, -1) > k:
                hidden, within = 1, [name]
            continue
        line()
        if not close:
            _close_implied(around, name)
        elif name in around:
            while around.pop() != name:
                pass
        if close:
            if name in ("article", "main"):
                inside = max(0, inside - 1)
                edge()
            continue
        bad = name in DROPPED or (name == "header" and not inside) or (name not in ("article", "main", "body", "html") and bool(m[3]) and _named(m[3]))
        if bad and name not in VOID and (name == "p" or ends.get(name, -1) > k):
            hidden, within = 1, [name]
            continue
        if name in BLOCKS and name not in VOID:
            around.append(name)
        if name in ("article", "main"):
            edge()
            inside += 1
    add(page[at:])
    line()
    return out


def blocks(size: np.ndarray, window: int) -> np.ndarray:
    """The distribution: for each line the sum of its length and those of the window - 1 lines after it."""
    total = np.r_[np.cumsum(size), np.full(window - 1, size.sum())]
    return total[window - 1 :] - np.r_[0, total[: len(size) - 1]]


def main_lines(found: list[tuple[str, bool, float]], window: int = WINDOW) -> list[str]:
    """The lines between surge and dive points of the line-block distribution."""
    marked = any(inside and text for text, inside, _ in found)
    size = np.array([len(t) * ((1.0 if inside else OUTSIDE) if marked else share <= 0.5) for t, inside, share in found])
    if not size.any():
        return []
    block = blocks(size, window)
    level = LEVEL[marked] * block.max()
    at = np.flatnonzero(size)
    dives = np.flatnonzero(np.diff(at) > window) + 1  # between these lines a window holds nothing
    spans = [(int(part[0]), int(part[-1])) for part in np.split(at, dives) if (block[part] > level).any()]
    if not marked:
        spans = [(spans[0][0], spans[-1][1])]
    return [t for a, b in spans for t, _, _ in found[a : b + 1] if t]


def main_text(page: str | None) -> str:
    return "\n".join(main_lines(lines(page))) if page else ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row."""
    bound_batches(df.sparkSession)
    kind = df.select(named(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        for b in sliced(batches, 2):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return df.select(named(id_col).alias("id"), named(url_col).alias("url"), named(html_col).alias("html")).mapInArrow(run, f"id {kind}, url string, text string")


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_extract": op8_extract}
ORACLES: dict[str, str] = {}
