"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page; lines inside navigation, headers, footers, side bars,
notices, adverts, forms, scripts, styles and comment sections, and lines that are mostly links, count as length zero.
Text lengths are summed over sliding windows of lines; where the sum surges an article begins, where it dives to zero
it ends, and the text between is kept. Lines in a page's own <article> or <main>, if any, weigh once more.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import map_arrow, table

#: Lines of a window; weighted characters of a window that are a surge, whatever larger windows the page has.
WINDOW, SURGE_CHARS = 3, 80
LINK_SHARE = 0.6

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head script style noscript template iframe object svg canvas math audio video nav footer aside form button select textarea dialog menu title".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"))
#: Words of class, id or role that mark what is no article.
_CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent footer header masthead menu nav navbar navigation newsletter notice notices alert popup modal overlay pagination pager promo promotion related recommended share sharing sidebar sidebars social sponsor sponsored subscribe subscription toolbar widget widgets signup login complementary contentinfo search replies reply discussion respond".split()
)
#: Of these, words that also name parts of an article: a long line without many links stays under them.
_WEAK_CUES = frozenset("header masthead banner search alert widget widgets toolbar menu nav promo".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?)(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
# <p> ends at these; <li>, <dt>, <dd>, <td>, <tr>, <option> end at their like.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPES = frozenset("ul ol dl table select article section div nav aside header footer main form body".split())


#: How an element marks its lines: not at all, unless they are long, or in any case.
NO, WEAK, YES = 0, 1, 2


def _boilerplate(name: str, attributes: str, inside_article: bool) -> int:
    if name in _DROPPED or (name == "header" and not inside_article):
        return YES
    if not attributes:
        return NO
    mark = NO
    for m in _ATTRIBUTE.finditer(attributes):
        what, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if what in ("class", "id", "role"):
            if name not in ("html", "body", "article", "main"):
                for w in _WORD.findall(value):
                    if w in _CUES:
                        mark = max(mark, WEAK if inside_article and w in _WEAK_CUES else YES)
        elif what == "hidden" or (what == "aria-hidden" and value == "true") or (what == "style" and "display:none" in value.replace(" ", "")):
            return YES
    return mark


def lines_of(page: str) -> list[tuple[str, bool, bool, int]]:
    """(text, boilerplate, inside an article, characters in links) of each block, in page order; nothing is left out."""
    out: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, int]] = []  # open elements and how they mark their lines
    held: Counter[str] = Counter()  # how many of each name are open
    marked = [0, 0, 0]
    articles = links = 0
    buffer: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _SPACES.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                short = len(text) < SURGE_CHARS or linked >= LINK_SHARE * len(text)
                out.append((text, marked[YES] > 0 or (marked[WEAK] > 0 and short), articles > 0, linked))
            buffer.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal articles, links
        while stack:
            top, mark = stack.pop()
            marked[mark] -= 1
            held[top] -= 1
            articles -= top in ("article", "main")
            links -= top == "a"
            if top == name:
                break

    def words(text: str) -> None:
        nonlocal linked
        if text:
            buffer.append(text)
            if links:
                linked += len(text.strip())

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        name = m.group(2).lower()
        if m.group(1):
            if name in _BLOCKS:
                flush()
            if held[name]:
                close(name)
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in _VOID:
            if name in _BLOCKS:
                flush()
            continue
        if name in _BLOCKS:
            flush()
            if any(top == "p" for top, _ in stack[-6:]):  # a block ends an open paragraph and what hangs in it
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close("p")
                        break
                    if stack[i][0] in _BLOCKS:
                        break
            like = _SIBLINGS.get(name)
            if like and any(held[x] for x in like):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in like:
                        close(stack[i][0])
                        break
                    if stack[i][0] in _SCOPES:
                        break
        if m.group(3).endswith("/") and name in ("svg", "path", "object", "iframe"):
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if name in _BLOCKS:
                flush()
            at = end.end() if end else len(page)
            continue
        mark = _boilerplate(name, m.group(3), articles > 0)
        if mark and name not in _BLOCKS:
            flush()
        stack.append((name, mark))
        marked[mark] += 1
        held[name] += 1
        articles += name in ("article", "main")
        links += name == "a"
    flush()
    return out


def main_text(page: str) -> str:
    """Blocks between the surges and the dives of the line-block distribution, one a line; empty without any."""
    # boilerplate within an article doesn't interrupt it; elsewhere it is a line of length zero
    lines = [(text, 0 if bad else (inside + (linked < LINK_SHARE * len(text))) * len(text)) for text, bad, inside, linked in lines_of(page) if not (bad and inside)]
    n = len(lines)
    sums = [sum(weight for _, weight in lines[i : i + WINDOW]) for i in range(n)]
    least = min(SURGE_CHARS, max(sums, default=0))
    out: list[str] = []
    i = 0
    while i < n:
        j = i
        while j < n and sums[j]:  # the dive: the first window of length zero
            j += 1
        if j > i and max(sums[i:j]) >= least:
            out += [text for text, weight in lines[i:j] if weight]
        i = j + 1
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html).

    A null page, one without text and one whose text is all boilerplate give an empty text; repeated rows stay; other
    columns are not read.
    """

    def run(part: dict) -> dict:
        texts = [main_text(p or "") for p in part["html"]]
        return {"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long", "html")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
