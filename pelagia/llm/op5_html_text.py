"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides what it can from the block alone: blocks in menus, headers, footers, sidebars, forms, notices,
adverts and reader comments are boilerplate, and outside an article so are blocks made of links; long blocks with enough stop words are text. The second pass gives
the rest, short blocks and those without stop words, the label of the nearest decided neighbours of the same region; what is long and has hardly a link stays, whatever
its language. Inside an article or the main part a class or id makes an element boilerplate only if all of its name says so (``share-buttons``, but not
``share-price``). Stop words are those of four languages; on a page where they decide no block as text, long blocks with few links are text.

Scale: one scan, a page at a time, no shuffle. The scanner reads a page once from left to right.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

#: Frequent function words of the languages looked at.
STOP_WORDS = {
    "en": "a about after all an and are as at be but by can for from had has have he her his i if in is it its more not of on or she that the their there they this to was we were which who will with would you",
    "de": "als am auch auf aus bei das dem den der des die ein eine einen einer es für hat ich im in ist mit nach nicht noch oder sein sich sie sind so um und uns von war wie wird zu zum zur über",
    "fr": "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous à été",
    "es": "al como con de del el ella en entre era es esta este fue ha la las le lo los más no o para pero por que se si sin son su sus también un una y ya",
}
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and elements whose content is never text of a page.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = RAW | frozenset("applet audio button canvas datalist head map math noscript object select svg template video".split())
BOILER_TAGS = frozenset("aside dialog footer form menu nav search".split())
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
BOILER_NAMES = frozenset(
    "ad ads adsbygoogle adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentary commentlist comments consent cookie cookies copyright disqus dropdown footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall popup privacy promo promoted promotion recommended recommendations register related replies reply respond rss search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription teaser toast toolbar topbar tracking widget widgets".split()
)
#: What alone can make an article or the main part boilerplate; and words that say that a name is about a layout.
BOILER_ARTICLES = frozenset("ad ads advert advertisement comment comments promo related reply sponsored teaser".split())
LAYOUT_NAMES = frozenset("a and at by for from has hide how in layout no of on open our page the to with without wrapper your".split())
#: What a boilerplate name may be put together with and stay one.
PLAIN_NAMES = frozenset(
    "actions after area articles aside author bar before block body bottom box btn button buttons buy center close column container content count cta desktop entry facebook feed fixed follow footer form global group head header holder hook icon icons image inline inner item items js label left letter like link linkedin links list logo mail main media message mobile module more news outer panel post posts primary reader readers region right row secondary section sign site slot small space sticky story tab table text thread title tools top twitter unit up us user users view wrap".split()
)
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>", re.DOTALL)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)")
_WORD = re.compile(r"[^\W\d_]+")
_RIGHTS = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.IGNORECASE)
#: Characters of a long block; shares of stop words and of linked characters.
LONG, STOPS, LINKED, LINKS = 70, 0.2, 0.33, 0.8


class Block:
    __slots__ = ("text", "linked", "boiler", "region", "heading")

    def __init__(self, text: str, linked: int, boiler: bool, region: int, heading: bool):
        self.text, self.linked, self.boiler, self.region, self.heading = text, linked, boiler, region, heading


def boiler(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element, from its tag and attributes, holds none of the page's text. inside: it is within an article or the main part."""
    if tag in BOILER_TAGS or (tag == "header" and not inside):
        return True
    if not attrs or attrs.isspace() or tag in ("html", "body"):
        return False
    found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return True
    if found.get("role", "").lower() in BOILER_ROLES:
        return True
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2".replace(" ", "-"), f"{found.get('class', '')} {found.get('id', '')}").lower()
    each = [{t for t in re.split(r"[^a-z]+", name) if len(t) > 1} for name in names.split()]
    tokens = set().union(*each)
    if tag in ("article", "main"):
        return bool(tokens & BOILER_ARTICLES)
    if inside or tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p"):
        return any(t & BOILER_NAMES and t <= BOILER_NAMES | PLAIN_NAMES for t in each)
    if tokens & LAYOUT_NAMES:
        return False
    return bool(tokens & BOILER_NAMES) or "header" in tokens


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. region: 0 outside, 1 in the main part, 2 in an article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, boilerplate, region, in a link
    depth: Counter = Counter()
    text: list[str] = []
    linked, breaks, at, lower = 0, 0, 0, None
    hide, region, link = False, 0, False
    heading = False

    def close() -> None:
        nonlocal linked, breaks
        if text:
            joined = "".join(text)
            joined = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if joined:
                out.append(Block(joined, linked, hide, region, heading))
        text.clear()
        linked = breaks = 0

    def add(piece: str) -> None:
        nonlocal linked, breaks
        if breaks and not piece.isspace():
            breaks = 0
        text.append(piece)
        if link:
            linked += len(piece.strip())

    last = page.rfind(">") + 1  # a tag that doesn't end is no text
    tail = re.search(r"<[a-zA-Z/!?]", page[last:])
    stop_at = last + tail.start() if tail else len(page)
    while m := _TOKEN.search(page, at, last):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:  # a comment or declaration
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                text.append(" ")
            elif tag == "p" and not depth["p"]:
                close()
            elif depth[tag]:
                if tag in BLOCK:
                    close()
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                after = stack[k - 1][1:] if k else (False, 0, False)
                if after[:2] != (hide, region):
                    close()  # an inline element with text of its own kind ends
                for s in stack[k:]:
                    depth[s[0]] -= 1
                del stack[k:]
                hide, region, link = after
                heading = any(depth[h] for h in ("h1", "h2", "h3", "h4", "h5", "h6"))
            continue
        if tag in UNSEEN and not m[3].endswith("/"):
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at)
            if tag == "head":
                body = lower.find("<body", at)
                if 0 <= body and (end < 0 or body < end):
                    at = body
                    continue
            if end >= 0:
                stop = page.find(">", end)
                at = len(page) if stop < 0 else stop + 1
            elif tag in RAW:
                at = len(page)
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            else:
                text.append(" ")
            continue
        if tag in BLOCK:
            close()
            if depth["p"]:  # a block ends an open paragraph and what is open in it
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p")
                for s in stack[k:]:
                    depth[s[0]] -= 1
                del stack[k:]
                hide, region, link = stack[-1][1:] if stack else (False, 0, False)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                depth[tag] -= 1
                stack.pop()
                hide, region, link = stack[-1][1:] if stack else (False, 0, False)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        own = boiler(tag, m[3], region > 0)
        main = tag == "main" or ("role" in m[3] and bool(re.search(r"role\s*=\s*[\"']?main\b", m[3], re.IGNORECASE)))
        if own and not hide and text:
            close()
        hide = own or (hide and not main)  # the main part isn't within boilerplate, whatever a wrapper is called
        if tag == "article":
            region = 2
        elif main and not region:
            region = 1
        link = link or tag == "a"
        heading = heading or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")
        stack.append((tag, hide, region, link))
        depth[tag] += 1
    if at < stop_at:
        add(page[at:stop_at])
    close()
    return out


def first_pass(b: Block) -> bool | None:
    """True for text, False for boilerplate, None if a block alone doesn't tell."""
    n = len(b.text)
    if b.boiler:
        return False
    words = _WORD.findall(b.text.lower()) if n >= LONG and not b.heading else []
    text = bool(words) and sum(w in _STOP for w in words) >= STOPS * len(words)
    if b.linked > LINKED * n and not b.heading:
        if text and (b.region == 2 or b.linked <= LINKS * n):
            return True
        return None if b.region == 2 or (b.region == 1 and b.linked <= LINKS * n) else False
    if not b.region and n < 200 and _RIGHTS.search(b.text):
        return False
    return True if text else None


def main_text(page: str) -> str:
    """The blocks that are the article's text, joined by two line feeds. With an article element, or else a main part, that has text, only its blocks are asked."""
    found = [b for b in blocks(page) if b.text]
    for region in (2, 1, 0):
        own = [b for b in found if b.region >= region and not b.boiler]
        if own:
            break
    labels = [first_pass(b) for b in own]
    if True not in labels:
        # no stop words known: another language, a table or code; long blocks without many links are text
        labels = [True if x is None and len(b.text) >= LONG and not b.heading else x for b, x in zip(own, labels, strict=True)]
    decided = [i for i, x in enumerate(labels) if x is not None]
    kept = []
    for i, b in enumerate(own):
        keep = labels[i]
        if keep is None and len(b.text) >= 2 * LONG and b.linked <= 0.1 * len(b.text):
            keep = True
        elif keep is None:
            # second pass: the nearest decided blocks before and after; the nearer one counts, of equally near ones a text block
            k = int(np.searchsorted(decided, i))
            near = [(abs(j - i), not labels[j]) for j in decided[max(0, k - 1) : k + 1]]
            keep = not min(near)[1] if near else True
            if not keep and any(not bad for _, bad in near) and b.heading:
                keep = True  # a heading beside text belongs to it
        if keep:
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: page_id, url, text (empty if there is none) and n_chars (its code points). Null pages count as empty; null ids and urls are
    passed on; repeated rows stay. An empty table gives an empty result. Other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(t or "") for t in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), df[html_col].cast("string").alias("html"))
    return map_arrow(rows, run, "page_id bigint, url string, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
