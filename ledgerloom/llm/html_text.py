"""Operator 9: main text of web pages by two passes of block rules.

A tolerant scanner cuts a page into blocks of text at block-level tags, with each block's words, stop words and
characters inside links. What stands in parts that name themselves as menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or comments (by tag, role, class or id) is boilerplate from the start, unless it is
only a name around the page's main element or around most of its text; where a page marks its article, so is everything
outside it.

Pass 1 decides blocks by link density, length and stop-word density: many links: boilerplate; long, or medium with
stop words: text; long without stop words: boilerplate, unless it stands in a marked article; short: undecided.
Pass 2 gives each undecided block the label of its nearest decided neighbours in the same part (both agree: theirs; if
not: the nearer one's, text on a tie; none: text in a marked article, else boilerplate).

Null and empty pages: empty text. Pages may be cut off anywhere, tags unclosed. White space inside a block becomes one
space, blocks are joined by one line feed, character references are decoded once. Repeated rows are read row by row;
null page_ids and urls are kept; other columns are ignored. An empty table gives an empty result. Time is linear in a
page's length.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import fields, table

BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea iframe title svg math object noembed noframes xmp".split())
OUT = frozenset("nav footer aside select button dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Names of parts that are no text of the article. A class or id names such a part if all words of one of its values
#: are names or qualifiers, one a name at least: "site-footer", "left sidebar"; not "no-sidebar" or "post-header".
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead banner ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager skiplink copyright".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond commentlist".split())
QUALIFIERS = frozenset(
    "site page main global primary secondary left right top bottom inner outer box bar block section list wrapper wrap container area links link item items form group row col column slot unit side pop up sign log in skip reader readers user buttons button icons icon content body text msg message policy the us posts articles stories".split()
)
#: Stop words of the corpus' languages.
STOP = frozenset(
    "a an and are as at be by for from has he in is it its not of on or she that the their they this to was were which will with you "
    "der die das und ist ein eine einer den dem des zu mit von auf für im nicht sich als auch es an werden aus er hat dass sie nach wird bei "
    "le la les un une de du des et est en que qui dans pour pas sur au par avec il ce plus ne se son sont ou mais "
    "el los las unos unas y del al por con para una su se lo como más pero sus este ya o cuando muy sin sobre no".split()
)
MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.20, 0.30
TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)", re.S)
ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORD = re.compile(r"\w+")


class Block:
    __slots__ = ("text", "links", "out", "part")

    def __init__(self, text: str, links: int, out: bool, part: int):
        self.text, self.links, self.out, self.part = text, links, out, part


#: Kinds of boilerplate parts: by tag or role; by name, which a part that holds the article may only happen to bear;
#: readers' comments.
PLAIN, NAMED, READERS = 1, 2, 3


@functools.lru_cache(1 << 14)
def _names_a_part(value: str) -> int:
    """The kind of part that a value of class or id names, 0 if none."""
    words = [w.rstrip("0123456789") for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", value)]
    words = [w.lower() for w in words if w]
    if any(w in COMMENTS for w in words) and all(w in COMMENTS or w in QUALIFIERS or w in NAMES for w in words):
        return READERS
    return NAMED if any(w in NAMES for w in words) and all(w in NAMES or w in QUALIFIERS for w in words) else 0


def _part(tag: str, attrs: str, in_article: bool) -> int:
    """The kind of boilerplate part that a tag opens, 0 if none."""
    if tag == "form":
        return NAMED
    if tag in OUT or tag == "header" and not in_article:
        return PLAIN
    if tag in ("html", "body", "main") or not attrs.strip():
        return 0
    found = 0
    for name, *values in ATTRIBUTES.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return PLAIN
        if name in ("class", "id"):
            found = max([found, *map(_names_a_part, value.split())])
    return found


class Reader:
    """Cuts a page into blocks; every step takes constant time, but for text and tags that are passed once."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.inside: list[int] = []  # each block's innermost boilerplate part, -1 without one
        self.held: list[tuple[str, bool]] = []
        self.stack: list[tuple[str, int, bool, int]] = []  # tag, its part or -1, whether it opens an article, block tags so far
        self.at: dict[str, list[int]] = {}  # places of each tag in the stack
        self.parts: list[tuple[int, int]] = []  # kind, and the part around it
        self.holds_main: set[int] = set()
        self.around = -1
        self.articles = self.links = self.part = self.part_no = 0
        self.hard = 0  # open parts that are more than a name

    def flush(self) -> None:
        if self.held:
            text = " ".join(html.unescape("".join(t for t, _ in self.held)).split())
            if text:
                linked = sum(len(t) for t, inside in self.held if inside)
                total = sum(len(t) for t, _ in self.held)
                self.out.append(Block(text, round(linked / total * len(text)), False, self.part if self.articles else 0))
                self.inside.append(self.around)
            self.held.clear()

    def push(self, tag: str, kind: int, is_article: bool) -> None:
        mine = -1
        if kind:
            mine = len(self.parts)
            self.parts.append((kind, self.around))
            self.around = mine
            self.hard += kind != NAMED
        if is_article:
            self.part_no += 1
            self.part = self.part_no
            self.articles += 1
        if tag == "main" and self.around >= 0:
            self.holds_main.add(self.around)
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, mine, is_article, (self.stack[-1][3] if self.stack else 0) + (tag in BLOCKS)))

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, mine, was_article, _ = self.stack.pop()
            self.at[tag].pop()
            if mine >= 0:
                kind, self.around = self.parts[mine]
                self.hard -= kind != NAMED
            self.articles -= was_article

    def end(self, tag: str, through_blocks: bool) -> None:
        """Closes the last open tag of this name, unless block tags are open inside and may not be closed with it."""
        if places := self.at.get(tag):
            depth = places[-1]
            if through_blocks or self.stack[-1][3] == self.stack[depth][3] - (tag in BLOCKS):
                self.flush()
                self.close(depth)

    def finish(self) -> list[Block]:
        """Blocks in page order. A part by name that holds the page's main element, or over half of the text outside
        links and comments, is no boilerplate."""
        self.flush()
        text = [0] * len(self.parts)
        total = 0
        for b, i in zip(self.out, self.inside, strict=True):
            own = len(b.text) - b.links
            total += own
            if i >= 0:
                text[i] += own
        for i in range(len(self.parts) - 1, -1, -1):  # a part comes after the one around it
            kind, around = self.parts[i]
            if around >= 0:
                text[around] += text[i]
                if i in self.holds_main:
                    self.holds_main.add(around)
        readers = sum(t for t, (kind, around) in zip(text, self.parts, strict=True) if kind == READERS and (around < 0 or self.parts[around][0] != READERS))
        gone: list[bool] = []
        for i, (kind, around) in enumerate(self.parts):
            spared = kind == NAMED and (i in self.holds_main or 2 * text[i] > total - readers)
            gone.append(not spared or around >= 0 and gone[around])
        for b, i in zip(self.out, self.inside, strict=True):
            b.out = i >= 0 and gone[i]
        return self.out


_CUT_OFF = re.compile(r"</?[a-zA-Z]")


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    r = Reader()
    held, at, end = r.held, 0, len(page)
    last_end = page.rfind(">")
    raw_end: dict[str, int] = {}  # raw tags whose end the rest of the page lacks
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            held.append((page[at:], r.links > 0))
            break
        if lt > at:
            held.append((page[at:lt], r.links > 0))
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        m = TAG.match(page, lt) if lt < last_end else None
        if m is None:  # no tag: a bare sign, or a tag that the page's end cuts off
            if last_end < lt and _CUT_OFF.match(page, lt):
                break
            held.append(("<", r.links > 0))
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            held.append((" ", r.links > 0))
            continue
        if tag == "a":
            r.links = 0 if closing else 1
            continue
        if tag not in BLOCKS and tag not in RAW:
            kind = 0 if closing or tag in VOID else _part(tag, attrs, r.articles > 0)
            if not kind:
                if closing:
                    r.end(tag, False)
                continue
            r.flush()
            r.push(tag, kind, False)
            continue
        r.flush()
        if closing:
            r.links = 0
            r.end(tag, True)
            continue
        if tag in RAW:
            if raw_end.get(tag, end) > at:
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if stop is None:
                    raw_end[tag] = at
            else:
                stop = None
            at = stop.end() if stop else (end if tag in ("script", "style") else at)
            continue
        if tag in VOID:
            continue
        if tag == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):  # a new one ends the one that is open
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            place = max((r.at[t][-1] for t in same if r.at.get(t)), default=-1)
            if place >= 0 and r.stack[-1][3] == r.stack[place][3]:  # no block tag is open inside
                r.close(place)
        elif r.stack and r.stack[-1][0] == "p":
            r.close(len(r.stack) - 1)
        r.push(tag, _part(tag, attrs, r.articles > 0), tag in ("article", "main") and not r.hard)
    return r.finish()


def labels(found: list[Block]) -> list[bool]:
    """True for text; two passes."""
    marked = any(b.part and not b.out for b in found)
    first: list[bool | None] = []
    for b in found:
        if b.out or marked and not b.part:
            first.append(False)
            continue
        size = len(b.text)
        words = WORD.findall(b.text.lower())
        stop = sum(w in STOP for w in words) / len(words) if words else 0.0
        if b.links > MAX_LINKS * size:
            first.append(False)
        elif size < SHORT:
            first.append(None)
        elif stop >= STOP_HIGH or size >= LONG and stop >= STOP_LOW:
            first.append(True)
        else:
            first.append(None if b.part or stop >= STOP_LOW else False)
    n = len(found)
    known = lambda i: first[i] is not None and not found[i].out and (not marked or found[i].part > 0)
    before, after = [-1] * n, [-1] * n
    for i in range(n):
        before[i] = i if known(i) else before[i - 1] if i else -1
    for i in range(n - 1, -1, -1):
        after[i] = i if known(i) else after[i + 1] if i + 1 < n else -1
    out = []
    for i, b in enumerate(found):
        if first[i] is not None:
            out.append(bool(first[i]))
            continue
        p, q = (before[i - 1] if i else -1), (after[i + 1] if i + 1 < n else -1)
        if p < 0 and q < 0:
            out.append(b.part > 0)
        elif p < 0 or q < 0:
            out.append(bool(first[max(p, q)]))
        elif first[p] == first[q]:
            out.append(bool(first[p]))
        else:
            out.append(bool(first[p]) if i - p < q - i else bool(first[q]) if q - i < i - p else True)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 256):
            part = b.slice(s, 256)
            text = [main_text(x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to page_id, url, text, n_chars."""
    return fields(pages, page_id="long", url="string", html="string").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
