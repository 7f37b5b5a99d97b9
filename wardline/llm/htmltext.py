"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at its block-level tags. What markup names as furniture (menus, headers,
footers, asides, forms, adverts, notices, reader comments, scripts, styles) is left out. Where a page
marks its article, the blocks inside it are the candidates. A container that only its class or id name, or a form tag,
makes furniture is none if it holds the page's longest article, or, on a page without articles, more than half of its
text; what names reader comments always is.

First pass: a block with many link characters is bad; a long block with many common words is good; one
with some is near-good; one with few is bad; short blocks are undecided. Inside a marked article the
words decide nothing: what the first pass calls bad for want of common words is undecided there. Second
pass: near-good and short blocks take the label of the nearest decided blocks on both sides; where these
differ, the nearer one counts, and a near-good block is good. With nothing decided around it a block is
good inside a marked article and bad outside, unless near-good.

Null and empty pages have an empty text. Rows alike in everything each have their result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import slices

#: Common words of English, French, Spanish and German.
STOP_WORDS = frozenset(
    """a about after all also am an and any are as at be because been but by can could did do does for from had has have he
    her him his how i if in into is it its just me more most my no not of on only or other our out over she so some such
    than that the their them then there these they this those to too up us was we were what when where which who will with
    would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus
    pour qu que qui sa se ses si son sont sur un une vous
    al como con del el ella era es esta este fue ha hay las lo los muy nos o para pero por porque sin sobre su sus también
    tiene todo y ya
    aber als am auch auf aus bei bin bis das dass dem den der die durch ein eine einem einen einer eines er für hat ich ihr
    im ist man mit nach nicht noch nur oder sich sie sind über um und uns von vor war was wenn wie wir wird zu zum zur""".split()
)
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINKS_MOST = 0.25

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z))", re.S)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_FURNITURE = set("head nav header footer aside button select option script style noscript template textarea title svg canvas iframe object menu dialog datalist fieldset audio video map".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar", "alertdialog"}
#: Parts of class and id names, cut at anything but letters and digits, that name furniture.
_NAMES = set(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside widget widgets footer header masthead topbar
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login
    share sharing social related recommended comment comments commentlist discussion disqus respond reply replies""".split()
)
_COMMENT_NAMES = {"comment", "comments", "commentlist", "discussion", "disqus", "respond", "reply", "replies"}
#: Words that say what a page's layout has or lacks beside this block, not what the block is.
_LAYOUT = re.compile(r"^(?:has|with|no|without)(?=[^a-z0-9])")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I | re.S)
_ARTICLE = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    linked: int
    heading: bool
    in_article: bool
    place: int = 0
    label: str = ""


#: What a tag is: text, furniture whatever it holds, furniture unless it holds the article, reader comments.
_TEXT, _NEVER, _MAYBE, _COMMENTS = range(4)


@dataclass
class _Place:
    """A container that may be furniture, or an outermost article, inside another one."""

    parent: int
    kind: int
    article: bool
    length: int = 0
    dropped: bool = False


def _is_furniture(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _FURNITURE:
        # An article's own header holds its title.
        return _TEXT if tag == "header" and in_article else _NEVER
    found = _MAYBE if tag == "form" else _TEXT
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "").lower()
        kind = name.lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "role" and value in _ROLES):
            return _NEVER
        if kind in ("class", "id") and tag not in ("html", "body", *_ARTICLE):
            parts = {part for word in value.split() if not _LAYOUT.match(word) for part in re.split(r"[^a-z0-9]+", word)}
            if parts & _NAMES:
                found = _COMMENTS if found == _COMMENTS or parts & _COMMENT_NAMES else _MAYBE
    # Inside a line of text there is no article to hold.
    return _NEVER if found and tag in _INLINE else found


def _drop_furniture(blocks: list[Block], places: list[_Place]) -> list[Block]:
    """The blocks outside what turns out to be furniture."""
    for block in blocks:
        places[block.place].length += len(block.text)
    for place in reversed(places[1:]):
        places[place.parent].length += place.length
    articles = [k for k, place in enumerate(places) if place.article]
    holds = set()
    if articles:
        at = max(articles, key=lambda k: places[k].length)
        while at:
            holds.add(at)
            at = places[at].parent
    else:
        holds = {k for k, place in enumerate(places) if 2 * place.length > places[0].length}
    for k, place in enumerate(places):
        bad = place.kind == _COMMENTS or place.kind == _MAYBE and k not in holds
        place.dropped = k > 0 and (bad or places[place.parent].dropped)
    return [block for block in blocks if not places[block.place].dropped]


def blocks_of(page: str) -> list[Block]:
    """The page's blocks without furniture, in order, their text decoded and its white space made single."""
    out: list[Block] = []
    open_tags: list[tuple[str, bool, bool, int]] = []  # tag, furniture, article, the place around it
    n_open: Counter[str] = Counter()
    places = [_Place(0, _TEXT, False)]
    furniture = articles = links = heading = here = 0
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, len(" ".join("".join(linked).split())), heading > 0, articles > 0, here))
        parts.clear()
        linked.clear()

    def close(tag: str) -> None:
        nonlocal furniture, articles, links, heading, here
        # Each tag is closed once, and a tag that is not open closes none.
        while n_open[tag]:
            name, bad, article, here = open_tags.pop()
            n_open[name] -= 1
            furniture -= bad
            articles -= article
            links -= name == "a"
            heading -= name in _HEADINGS
            if name == tag:
                return

    at = 0
    while at < len(page):
        begin = page.find("<", at)
        begin = len(page) if begin < 0 else begin
        if begin > at and not furniture:
            text = html.unescape(page[at:begin])
            parts.append(text)
            if links:
                linked.append(text)
        if begin == len(page):
            break
        tag_match = _TAG.match(page, begin)
        if not tag_match:
            # A sign that opens no tag is text.
            if not furniture:
                parts.append("<")
            at = begin + 1
            continue
        at = tag_match.end()
        closing, tag, attributes = tag_match[1], (tag_match[2] or "").lower(), tag_match[3] or ""
        if not tag:
            continue
        if tag not in _INLINE:
            flush()
        if closing:
            close(tag)
            continue
        if tag in _VOID or attributes.rstrip().endswith("/") and tag not in _INLINE and tag in ("svg", "path"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            close("a")
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_tags and open_tags[-1][0] == tag:
            close(tag)
        kind, article = _is_furniture(tag, attributes, articles > 0), tag in _ARTICLE
        bad = kind == _NEVER
        open_tags.append((tag, bad, article, here))
        n_open[tag] += 1
        if kind in (_MAYBE, _COMMENTS) or article and not articles:
            places.append(_Place(here, kind, article and not articles and not furniture))
            here = len(places) - 1
        furniture += bad
        articles += article
        links += tag == "a"
        heading += tag in _HEADINGS
    flush()
    return _drop_furniture(out, places)


_EDGES = re.compile(r"^\W+|\W+$")


def _first_pass(block: Block) -> str:
    n = len(block.text)
    if block.linked / n > LINKS_MOST:
        return "bad"
    if n < LENGTH_LOW:
        return "short"
    words = block.text.lower().split()
    density = sum(_EDGES.sub("", w) in STOP_WORDS for w in words) / len(words)
    if density >= STOP_HIGH:
        return "good" if n > LENGTH_HIGH else "near-good"
    if density >= STOP_LOW:
        return "near-good"
    return "short" if block.in_article else "bad"


def classify(blocks: list[Block]) -> list[Block]:
    """Both passes; every block ends up good or bad."""
    for block in blocks:
        block.label = _first_pass(block)
    decided = [(k, b.label) for k, b in enumerate(blocks) if b.label in ("good", "bad")]
    labels, right = [], 0
    for k, block in enumerate(blocks):
        while right < len(decided) and decided[right][0] < k:
            right += 1
        if block.label in ("good", "bad"):
            labels.append(block.label)
            continue
        before, after = decided[right - 1] if right else None, decided[right] if right < len(decided) else None
        known = [d for d in (before, after) if d]
        if not known:
            labels.append("good" if block.in_article or block.label == "near-good" else "bad")
        elif block.in_article or block.label == "near-good":
            # Bad neighbours count only on both sides, and only lists of links are bad in an article.
            labels.append("bad" if len(known) == 2 and {d[1] for d in known} == {"bad"} and block.label != "near-good" else "good")
        elif len({d[1] for d in known}) == 1:
            labels.append(known[0][1] if len(known) == 2 or known[0][1] == "bad" else "good")
        else:
            labels.append(min(known, key=lambda d: abs(d[0] - k))[1])
    for block, label in zip(blocks, labels, strict=True):
        block.label = label
    return blocks


def main_text(page: str) -> str:
    """The good blocks of a page, joined by a blank."""
    blocks = blocks_of(page)
    if any(b.in_article for b in blocks):
        blocks = [b for b in blocks if b.in_article]
    return " ".join(b.text for b in classify(blocks) if b.label == "good")


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` without ``html_col`` and with the main text."""
    kept = [c for c in df.columns if c not in (html_col, text_col)]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n in kept) + f", `{text_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__html"):
                texts = [main_text(page.as_py() or "") for page in part.column("__html")]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*kept, text_col])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(html_col), F.lit("")).alias("__html")).mapInArrow(run, schema)
