"""The main text of web pages by line-block distribution.

Markup is stripped to lines: each tag of a block ends one, so that tags which follow each other leave blank
lines, and parts of a page that are wrapped apart lie apart. What is no text of the page (scripts, menus, forms,
adverts, comments and the like, by element, role and whole class names) is stripped with its markup. The lengths
of what is left, without links, are summed over sliding windows of lines. A region begins where the sum surges
to ``SURGE`` characters (on pages of short lines, to a third of the page's densest window), and ends where it
dives to nothing. The lines of all regions are joined; what lies between them, such as lone lines of a site's
name, of rights or of menus without a name, goes. An article or main element is itself worth a surge, so short
articles are found, and lines beside them.

Defined results: null, empty or textless html gives the empty string; cut-off markup ends with the page;
equal rows are extracted each; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import small_batches, table

#: Lines in a window, and characters in it from which a region begins.
WINDOW, SURGE = 4, 80
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select dialog menu head".split())
MAIN = frozenset(("article", "main"))
#: Elements that a following block of these kinds closes.
OPEN_ENDED = {"p": BLOCKS, "li": frozenset(("li",)), "dd": frozenset(("dt", "dd")), "dt": frozenset(("dt", "dd")), "option": frozenset(("option",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",))}
CLOSES: dict[str, list[str]] = {}
for _tag, _ends in OPEN_ENDED.items():
    for _end in _ends:
        CLOSES.setdefault(_end, []).append(_tag)
#: A class or id is unwanted if its hyphenated parts are these words, with none but BESIDE or digits besides.
NAMED = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist reply replies disqus share sharing social related recommended newsletter subscribe signup pagination pager skiplink toolbar widget".split())
BESIDE = frozenset("left right top bottom site page post user reader global primary secondary list bar box area block wrapper wrap container inner outer link links button buttons icons posts articles stories items form section body skip".split())
HEADERS = frozenset("header masthead siteheader site-header site_header pageheader page-header page_header".split())
REMARKS = frozenset("comment comments commentlist reply replies disqus".split())
#: What makes an article or main itself unwanted.
NAMED_MAIN = REMARKS | frozenset("ad ads advert promo related".split())
PARTS = re.compile(r"[_-]+")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
SPACE = re.compile(r"\s+")


def _named(value: str, words: frozenset[str]) -> set[str]:
    """The words in those tokens of a class or id that are nothing else."""
    out: set[str] = set()
    for token in value.lower().split():
        parts = {x for x in PARTS.split(token) if x and not x.isdigit()}
        if parts <= words | BESIDE:
            out |= parts & words
    return out


def _unwanted(tag: str, attributes: str, inside: bool, holds_main: bool = False, holds_most: bool = False) -> bool:
    """holds_main: an article or main is in it; holds_most: most of the page's text is. Neither goes for a name,
    a role or a form's sake; remarks may be most of a page."""
    if (tag in DROPPED and not (tag == "form" and (holds_main or holds_most))) or (tag == "header" and not inside):
        return True
    if not attributes.strip() or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if holds_main:
            continue
        if name == "role" and value.lower() in ROLES and not holds_most:
            return True
        if name in ("class", "id"):
            named = _named(value, NAMED_MAIN if tag in MAIN else NAMED)
            if named & REMARKS or (named and not holds_most):
                return True
            if tag not in MAIN and not inside and not holds_most and not HEADERS.isdisjoint(value.lower().split()):
                return True
    return False


def _extents(html: str) -> dict[int, tuple[bool, bool]]:
    """Of elements with attributes, and forms, by where they start: whether they hold a wanted article or main,
    and whether they hold most of the page's text. An element ends where skipping it would."""
    opened: dict[str, list[tuple[int, int, int]]] = {}
    found: list[tuple[int, int, int]] = []
    at = text = mains = 0

    def end(tag: str):
        if stack := opened.get(tag):
            start, t, n = stack.pop()
            found.append((start, text - t, mains - n))

    for m in TOKEN.finditer(html):
        text += len(html[at : m.start()].strip())
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in VOID:
            continue
        if m[2]:
            end(tag)
            continue
        for ended in CLOSES.get(tag, ()):
            end(ended)
        wanted = tag in MAIN and not _unwanted(tag, m[4] or "", True)
        opened.setdefault(tag, []).append((m.start(), text, mains + wanted))
        mains += wanted
    text += len(html[at:].strip())
    for tag, stack in opened.items():
        while stack:
            end(tag)
    return {start: (n > 0, 2 * t > text) for start, t, n in found if n or 2 * t > text}


def lines_of(html: str) -> list[tuple[str, int]]:
    """(line, its weight): blank lines and those of mere links outside an article have none; others as many as
    characters outside links, one at least, and in an article those of a surge besides."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = [0, 0]  # characters in links, and in all
    inside = skipping = depth = links = 0

    def close():
        text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip() if parts else ""
        if inside:
            lines.append((text, SURGE + len(text) if text else 0))
        else:
            lines.append((text, max(1, linked[1] - linked[0]) if text and linked[0] < 0.6 * linked[1] else 0))
        parts.clear()
        linked[:] = 0, 0

    def text_at(raw: str):
        if raw and not skipping:
            parts.append(raw)
            n = len(raw.strip())
            linked[1] += n
            linked[0] += n if links else 0

    at, skipped_tag, extents = 0, "", _extents(html)
    for m in TOKEN.finditer(html):
        text_at(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closing = bool(m[2])
        if skipping:
            ends = OPEN_ENDED.get(skipped_tag)
            if tag == skipped_tag and not (ends and not closing):
                depth += -1 if closing else tag not in VOID
                if depth <= 0:
                    skipping = 0
                continue
            if not (ends and not closing and tag in ends):
                continue
            skipping = 0
        if not closing and tag not in VOID and _unwanted(tag, m[4] or "", inside > 0, *extents.get(m.start(), (False, False))):
            if parts and tag in BLOCKS:
                close()
            skipping, depth, skipped_tag = 1, 1, tag
            continue
        if tag in BLOCKS:
            close()
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        if closing:
            inside -= tag in MAIN and inside > 0
        else:
            inside += tag in MAIN
    text_at(html[at:])
    close()
    return lines


def regions(weights: list[int]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each region between a surge and the next dive."""
    n = len(weights)
    total = [0, *accumulate(weights)]
    window = [total[min(n, k + WINDOW)] - total[k] for k in range(n)]
    surge = max(1, min(SURGE, max(window, default=0) // 3))
    out, k = [], 0
    while k < n:
        if window[k] < surge or not weights[k]:
            k += 1
            continue
        first = k
        while k < n and window[k]:
            k += 1
        out.append((first, k))
    return out


def main_text(html: str | None) -> str:
    lines = lines_of(html or "")
    return "\n".join(text for a, b in regions([w for _, w in lines]) for text, w in lines[a:b] if w)


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page; no shuffle."""
    pages = small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLES: dict[str, str] = {}
