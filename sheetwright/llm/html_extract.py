"""Main-text extraction from HTML by two-pass block rules.

A page is cut into blocks at block-level tags, by a scanner that never looks at a stretch twice.  Pass 1 classifies each by itself: its place in the markup, its length,
its density of stop words and of links make it good, bad, or, when it is short, undecided.  In pass 2 undecided blocks
take the label of the nearest decided neighbours, within the article if the page marks one.  Where the words of a page's
long blocks belong to no language with stop words here, long blocks with few links are good.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Characters under which a block is short; share of characters in links over which it is bad; shares of stop words.
SHORT, LINKS, STOP_LOW, STOP_HIGH, LONG = 70, 0.4, 0.10, 0.25, 200
#: Share of stop words in a page's long blocks under which its language isn't one of those below.
FOREIGN = 0.2

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can for from had has have he her his if in into is it its more not of on one or our out
    she so some than that the their them then there these they this to was we were what when which who will with would you
    aber als am an auch auf aus bei das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in
    ist mit nach nicht noch nur oder sein sich sie sind so über um und von vor war wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour
    qu que qui sa se ses son sont sur un une vous
    al como con de del el en era es esta este fue ha la las lo los más me muy no o para pero por que se si sin sobre son su
    sus también un una y ya""".split()
)
#: Fixed values of the HTML language: elements that begin and end blocks, that hold no text to read, that never have content.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_RAW = ("script", "style", "textarea", "title")  # hold no tags, and run to the page's end if they aren't closed
_DEAD = frozenset("noscript template svg math canvas iframe object audio video select button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEST = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form header main menu nav ol section table tbody td tfoot th thead tr ul".split())
_OUTSIDE = frozenset("nav footer aside form menu dialog".split())
#: Words in class, id or role that mark a part beside the article.
_BESIDE = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent
    contentinfo cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu modal nav navbar navigation
    newsletter notice notices notification pager pagination popup promo promoted recommended related replies reply respond
    search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget""".split()
)
#: Words of these that say little as a part of a longer name (`tags-x`): there the text's density decides.
_VAGUE = frozenset(
    "ads banner complementary copyright disclaimer legal login modal navigation notice notices notification pager pagination popup recommended reply replies respond search signup skip subscribe tags teaser toolbar widget".split()
)
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")  # what no backtracking repeats
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _RAW}
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_WORD = re.compile(r"[^\W\d_]+")
_white = re.compile(r"\s+")


class Block:
    __slots__ = ("counted", "links", "outside", "parts", "perhaps", "room", "text")

    def __init__(self, room: int, outside: bool, perhaps: bool = False) -> None:
        self.parts: list[str] = []
        self.links = 0
        self.room, self.outside, self.perhaps = room, outside, perhaps  # which marked article it lies in (0: none), whether beside the main text, or perhaps so
        self.text = ""
        self.counted: tuple[int, int] | None = None

    def stops(self) -> tuple[int, int]:
        """(stop words, words)."""
        if self.counted is None:
            words = _WORD.findall(self.text.lower())
            self.counted = sum(map(STOP_WORDS.__contains__, words)), len(words)
        return self.counted


class Token:
    """A tag, with name, end and attrs, or a stretch without text (name None)."""

    __slots__ = ("attrs", "end", "name", "start", "stop")

    def __init__(self, start: int, stop: int, name: str | None = None, end: bool = False, attrs: str = "") -> None:
        self.start, self.stop, self.name, self.end, self.attrs = start, stop, name, end, attrs


def tokens_of(page: str) -> list[Token]:
    """Tags, comments and raw elements in order, in time that grows with the page's length.

    A tag ends at the first > outside quotes.  Where none follows, quotes don't count from there on; a < that begins
    nothing is text.
    """
    out: list[Token] = []
    quotes = True
    last = page.rfind(">")
    at = page.find("<")

    def tag_end(p: int) -> int:
        nonlocal quotes
        m = _REST.match(page, p) if quotes else None
        quotes = m is not None
        return m.end() if m else page.find(">", p) + 1

    while 0 <= at:
        nxt = at + 1
        if page.startswith("<!--", at):
            nxt = page.find("-->", at + 4) + 3
            nxt = nxt if nxt > 2 else len(page)
            out.append(Token(at, nxt))
        elif page.startswith("<![CDATA[", at):
            nxt = page.find("]]>", at + 9) + 3
            nxt = nxt if nxt > 2 else len(page)
            out.append(Token(at, nxt))
        elif page.startswith(("<!", "<?"), at):
            nxt = page.find(">", at) + 1 or len(page)
            out.append(Token(at, nxt))
        elif at < last and (m := _NAME.match(page, at + 1)):
            nxt = tag_end(m.end())
            name, end = m[2].lower(), bool(m[1])
            attrs = page[m.end() : nxt - 1]
            if name in _RAW and not end:
                closed = _RAW_END[name].search(page, nxt)
                nxt = closed.end() if closed else len(page)
                out.append(Token(at, nxt, attrs="raw"))
            else:
                out.append(Token(at, nxt, name, end, attrs))
        at = page.find("<", nxt)
    return out


def _beside(name: str, attrs: str, in_article: bool) -> bool | None:
    """Whether an element lies beside the main text; None: perhaps, its text's density decides."""
    if name in _OUTSIDE or name == "header" and not in_article:
        return True
    if not attrs.strip():
        return False
    perhaps = False
    for key, *values in _ATTR.findall(attrs):
        value = "".join(values).lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            for token in value.split():
                words = _WORD.findall(token)
                marks = _BESIDE.intersection(words)
                if not in_article and "header" in words or len(marks) > 1 or marks - _VAGUE or marks and len(words) == 1:
                    return True
                perhaps |= bool(marks)
    return None if perhaps else False


def _closed(tokens: list[Token]) -> dict[int, int]:
    """Of the dead elements that are closed, where they begin and end among the tokens; each end tag closes the nearest open one."""
    begun: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, t in enumerate(tokens):
        if t.name not in _DEAD:
            continue
        if t.end:
            if begun.get(t.name):
                ends[begun[t.name].pop()] = i
        elif t.name not in ("svg", "math") or not t.attrs.endswith("/"):
            begun.setdefault(t.name, []).append(i)
    return ends


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, those without text left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, whether beside the main text, perhaps so, whether an article
    outside = perhaps = articles = rooms = links = 0
    open_now: dict[str, int] = {}
    block = Block(0, False)

    def close() -> None:
        nonlocal block
        if block.parts:
            text = _white.sub(" ", "".join(block.parts)).strip()
            if text:
                block.text = text
                out.append(block)
        block = Block(rooms if articles else 0, outside > 0, perhaps > 0)

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            block.parts.append(text)
            if links:
                block.links += len("".join(text.split()))

    tokens = tokens_of(page)
    dead = _closed(tokens)
    last = through = 0
    for i, t in enumerate(tokens):
        if i < through:
            continue
        say(page[last : t.start])
        last = t.stop
        name = t.name
        if name is None:
            if t.attrs:
                block.parts.append(" ")
            continue
        if name in _DEAD:  # one that isn't closed hides only its tag
            block.parts.append(" ")
            if i in dead:
                through, last = dead[i] + 1, tokens[dead[i]].stop
            continue
        if name == "a":
            links = max(0, links - 1) if t.end else 1
        elif name == "br":
            block.parts.append(" ")
        if name not in _BLOCK:
            continue
        if name in _NEST:
            if t.end:
                while open_now.get(name):  # closes what was opened since, too
                    n, b, p, a = stack.pop()
                    open_now[n] -= 1
                    outside -= b
                    perhaps -= p
                    articles -= a
                    if n == name:
                        break
            elif not t.attrs.endswith("/") or name not in _VOID:
                article = name in ("article", "main")
                beside = _beside(name, t.attrs, articles > 0)
                stack.append((name, beside is True, beside is None, article))
                open_now[name] = open_now.get(name, 0) + 1
                rooms += article
                outside += beside is True
                perhaps += beside is None
                articles += article
        links = 0
        close()
        if name not in _NEST and not t.end and t.attrs:
            beside = _beside(name, t.attrs, articles > 0)
            block.outside |= beside is True
            block.perhaps |= beside is None
    say(page[last:])
    close()
    return out


def _linked(b: Block) -> float:
    return b.links / max(1, len(b.text) - b.text.count(" "))


def _size(text: str) -> int:
    """Characters, those of scripts with a syllable or a word a character threefold."""
    return len(text) + 2 * len(_WIDE.findall(text))


def _foreign(blocks: list[Block]) -> bool:
    """Whether the words of the long blocks belong to no language of STOP_WORDS."""
    counts = [b.stops() for b in blocks if not b.outside and (len(b.text) >= SHORT or _size(b.text) >= SHORT) and _linked(b) <= LINKS]
    return sum(n for n, _ in counts) < FOREIGN * sum(n for _, n in counts)


def judge(b: Block, foreign: bool = False) -> bool | None:
    """Pass 1: True good, False bad, None undecided; of a foreign page by length and links alone."""
    if b.outside:
        return False
    size = _size(b.text) if foreign else len(b.text)
    dense = _linked(b)
    if dense > LINKS and not (b.room and size < SHORT):
        return False
    if not b.room and ("©" in b.text or "all rights reserved" in b.text.lower()):
        return False
    if size < SHORT:
        return False if b.perhaps else None if b.room or not b.links else False
    if foreign:
        return not b.perhaps
    found, words = b.stops()
    stop = found / max(1, words)
    if stop >= STOP_HIGH or stop >= STOP_LOW and size >= LONG:
        return True
    if b.perhaps:
        return False
    return None if b.room or stop >= STOP_LOW or size < LONG else False


def main_text(page: str) -> str:
    """The text of the good blocks, joined by empty lines."""
    blocks = blocks_of(page)
    if any(b.room and not b.outside for b in blocks):  # the page marks its article
        blocks = [b for b in blocks if b.room]
    foreign = _foreign(blocks)
    first = [judge(b, foreign) for b in blocks]
    decided = [i for i, x in enumerate(first) if x is not None]
    kept = []
    for i, (b, good) in enumerate(zip(blocks, first, strict=True)):
        if good is None:
            at = bisect_left(decided, i)
            near = [decided[k] for k in (at - 1, at) if 0 <= k < len(decided)]
            near = [k for k in near if blocks[k].room == b.room and not blocks[k].outside] if b.room else near
            if not near:
                good = b.room > 0
            else:
                least = min(abs(k - i) for k in near)
                good = any(first[k] for k in near if abs(k - i) == least)
        if good:
            kept.append(b.text)
    return "\n\n".join(kept)


def _extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([main_text(t) if isinstance(t, str) else "" for t in s], index=s.index, dtype=object)


def with_main_text(pages: DataFrame) -> DataFrame:
    """pages with `text` (string, empty if there is none) and `n_chars` (its code points); all other columns stay.

    Reads the column html, null taken for empty.  No shuffle; a page is held whole, whatever its length.
    """
    prepare(pages.sparkSession)
    extract = F.pandas_udf(_extracted, "string")
    columns = [pages[f"`{c}`"] for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*columns, extract(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
