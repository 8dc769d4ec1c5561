"""Operator 10, HTML extraction: two passes of rules over blocks.

A page is cut into blocks at block-level tags. What the markup itself sets apart (menus, page headers and footers, asides,
forms, scripts, hidden parts, and elements whose class, id or role names them as adverts, notices, comments and the like)
is boilerplate. Pass one decides the other blocks: many link characters make a block bad; length and the density of stop
words make it good. Where stop words say nothing (another script, or a page in none of the languages of STOP_WORDS), length
and the mark that ends a sentence do; a character of a script without spaces counts for several. Short blocks and those of
middling density stay open. Pass two gives each open block the label of the nearest decided block of its part of the page, the
earlier one at equal distance, headings that of the next one; with none decided it is good if it is in an article, or if the
page has none. Where a page has an article or main element with text, only long prose outside of it is good.

Names alone never take all of a page's text: where nothing but headings is left, and elements that only their names
condemn hold a block of SHORT characters, the outermost of these are pardoned (a wrapper with a class of "has-sidebar"), those within them not, and
so on. A page is in a language of the lists only if its blocks that are outweigh those that read as sentences in none of them.

Character references are decoded once; white space inside a block, line breaks too, becomes one space; blocks without text
go; the rest is joined in page order by a newline. Null, empty and text-free pages give the empty text. Broken markup is
read as far as it goes: stray end tags are skipped, an unclosed comment or script lasts to the end. Repeated rows and equal
or null ids stay rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

#: Stop words of English, French, German and Spanish; names of HTML elements; words that classes and ids of boilerplate hold.
STOP_WORDS = frozenset(
    """the of and to in is that it for with as was on be by this are from at an or not but have he they his her which you we
    de la le et les des en un du une que est pour qui dans par sur au pas avec ce il plus se ne son aux ou mais
    der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    el y a los del las por con no una su para es al lo como más o pero sus le ya este sí porque""".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody
    td tfoot th thead tr ul""".split()
)
CLOSES_P = BLOCK - {"button", "option", "optgroup", "html", "body", "head"}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article aside body details dialog div fieldset figure footer form header html main menu nav ol section table td th ul".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog noscript select button template svg canvas object head audio video math".split())
BAD_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
BAD_NAME = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adsense banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr
    notice notices notification alert popup modal overlay subscribe subscription newsletter signup login sidebar sidebars rail widget widgets
    related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager menu nav navbar navigation navigations topbar toolbar
    footer foot copyright masthead skip comment comments commentlist disqus respond reply replies hidden paywall teaser trending""".split()
)
BAD_NAME_OUTSIDE = frozenset("header head logo search top".split())

LONG, SHORT = 200, 70
STOP_DENSITY, LINK_DENSITY = 0.2, 0.4
#: What a character of a script without spaces counts; marks that end a sentence (fixed values).
DENSE, SENTENCE_ENDS = 3, frozenset(".!?…。！？｡؟۔।॥։።")

_TAG_END = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/$")  # the slash belongs to a value
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


@dataclass
class Block:
    article: int  # which article element it is in, 0: none
    bad: bool
    heading: bool = False
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    names: int = 0  # how many elements that only their names condemn it is in


def _condemned(attributes: str, inside: bool) -> str:
    """What speaks against an element: "set apart" (hidden, or by its role), "named", or nothing."""
    named = ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return "set apart"
        if name == "role" and value.lower() in BAD_ROLE:
            return "set apart"
        if name in ("class", "id"):
            parts = {p.lower() for p in _PART.findall(value)}
            if parts & BAD_NAME or not inside and parts & BAD_NAME_OUTSIDE:
                named = "named"
    return named


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # element, in boilerplate, article, condemned names
    articles, links, quotes = 0, 0, True
    now = Block(0, False)

    def flush() -> None:
        nonlocal now
        if now.pieces:
            now.text = " ".join(html.unescape("".join(now.pieces)).split())
            if now.text:
                out.append(now)
        name, bad, article, names = stack[-1] if stack else ("", False, 0, 0)
        now = Block(article, bad, name in HEADING, names=names)

    def close(name: str, bounded: bool) -> None:
        nonlocal links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                links -= sum(x[0] == "a" for x in stack[k:])
                del stack[k:]
                return
            if bounded and stack[k][0] in CONTAINER:
                return

    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            tag = size
        if tag > at:
            piece = page[at:tag]
            now.pieces.append(piece)
            if links:
                now.linked += len(piece)
        if tag == size:
            break
        after = page[tag + 1 : tag + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", tag):
                end = page.find("-->", tag + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", tag)
                at = size if end < 0 else end + 1
            continue
        named = _NAME.match(page, tag + 1)
        if not named:  # no tag
            now.pieces.append("<")
            at = tag + 1
            continue
        found = _TAG_END.match(page, named.end()) if quotes else None
        if found:
            at = found.end()
        else:
            quotes = False  # a quote is open; from here on the next > ends a tag
            end = page.find(">", named.end())
            at = size if end < 0 else end + 1
        name, attributes = named[0].lower(), page[named.end() : at - 1]
        if name[0] == "/":
            name = name[1:]
            if name in BLOCK:
                flush()
            close(name, name not in CONTAINER)
            if name in BLOCK:
                flush()
            continue
        if name == "br":
            now.pieces.append(" ")
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = size if not end else end.end() + 1 + max(page.find(">", end.end()) - end.end(), 0)
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                close("p", True)
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(name, True)
        if name in VOID or attributes.endswith("/") and name not in BLOCK and not _UNQUOTED.search(attributes):
            continue
        _, bad, article, names = stack[-1] if stack else ("", False, 0, 0)
        if name in ("article", "main") and not article:
            articles += 1
            article = articles
        against = _condemned(attributes, bool(article)) if attributes and name not in ("html", "body", "article", "main") else ""
        bad = bad or name in BOILERPLATE or name == "header" and not article or against == "set apart"
        names += against == "named"
        links += name == "a"
        stack.append((name, bad, article, names))
        if name in BLOCK or bad != now.bad or names != now.names:
            flush()
    flush()
    return out


def stop_density(text: str) -> float:
    words = [w.strip(".,;:!?()\"'#$%&*|").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def script(text: str) -> tuple[int, bool]:
    """(length, where a character of a script without spaces counts as DENSE, whether most letters are of a script other than Latin)."""
    dense = sum(c >= "\u2e80" or "\u0e00" <= c < "\u10a0" or "\u1780" <= c < "\u1800" for c in text)
    letters = sum(map(str.isalpha, text))
    foreign = sum(c >= "\u0370" and c.isalpha() and not "\u1e00" <= c < "\u1f00" for c in text)
    return len(text) + (DENSE - 1) * dense, 2 * foreign > letters


def decided(found: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    pardoned, most = 0, max((b.names for b in found if not b.bad), default=0)
    if not most:
        return _decided(found)
    while True:
        good = _decided([replace(b, bad=b.bad or b.names > pardoned) for b in found])
        held = any(b.names > pardoned and not b.bad and len(b.text) >= SHORT for b in found)
        if pardoned == most or not held or any(g and not b.heading for b, g in zip(found, good, strict=True)):
            return good
        pardoned += 1


def _decided(found: list[Block]) -> list[bool]:
    has_article = any(b.article and not b.bad for b in found)
    density = [0.0 if b.bad else stop_density(b.text) for b in found]
    prose = [(b, d) for b, d in zip(found, density, strict=True) if len(b.text) >= SHORT and not b.bad]
    read = sum(len(b.text) for b, d in prose if d >= STOP_DENSITY)
    unread = sum(len(b.text) for b, d in prose if d < STOP_DENSITY / 2 and b.text[-1] in SENTENCE_ENDS and b.linked <= LINK_DENSITY * len(b.text) and (b.text.isascii() or not script(b.text)[1]))
    known = read > 0 and read >= unread
    label: list[bool | None] = []
    for b, d in zip(found, density, strict=True):
        if b.bad or b.linked > LINK_DENSITY * max(len(b.text), 1) or b.text[0] == "©":
            label.append(False)
            continue
        n, foreign = (len(b.text), False) if d >= STOP_DENSITY or b.text.isascii() else script(b.text)
        mute = foreign or not known  # stop words say nothing
        if n < SHORT:
            good = None
        elif b.article:
            good = True if mute or d >= STOP_DENSITY / 2 else None
        elif d >= STOP_DENSITY or mute and (n >= LONG or b.text[-1] in SENTENCE_ENDS):
            good = True
        else:
            good = None if mute or n >= LONG and d >= STOP_DENSITY / 2 else False
        label.append(good if b.article or not has_article else bool(good) and n >= LONG)
    before, after = [None] * len(found), [None] * len(found)
    for order, near in ((range(len(found)), before), (range(len(found) - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for k in order:
            part = found[k].article
            near[k] = last.get(part)
            if label[k] is not None and not found[k].bad:
                last[part] = k
    out = []
    for k, b in enumerate(found):
        if label[k] is not None:
            out.append(label[k])
            continue
        p, q = before[k], after[k]
        best = p if q is None or p is not None and k - p <= q - k and not b.heading else q
        out.append(bool(b.article) or not has_article if best is None else label[best])
    return out


def extract(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, decided(found), strict=True) if good)


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    prepare(pages.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
