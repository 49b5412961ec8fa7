"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. The first pass labels each block: menus, headers,
footers, sidebars, notices, adverts, forms and comments are never text. Their tags and roles tell
them, or a class or id that is their name; a name with such a word among its parts is a hint, which
an article or most of the page's text inside overrules. The others go by their length, the share of their characters inside links and the share of their words that are stop words.
An article (or main) element that holds at least as much text as passes these rules outside of it
lowers the bar inside, where short blocks are text, and raises it outside, where they are not; one
that holds less is a teaser, whose short blocks are no text. Where a page has hardly any of the stop
words known, punctuation at the ends of sentences stands for them. In the second pass undecided
blocks take the label of the nearest decided neighbour; where both are equally near and differ, a
heading or a block of an article is text and any other is not.

Character references are decoded, white space inside a block becomes one space, and the blocks that
are text are joined, in page order, by an empty line. Nothing is capped.

Cases: null or empty html, and pages without text, give an empty text; unclosed tags and comments end
with the page, an unclosed quote with its tag, an unclosed button, select or object at the next block; repeated rows are extracted each; an empty table gives an empty table;
names of further columns are free.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartograph.llm.words import free_name, map_slices, plain

#: A block of fewer characters is undecided; one of more needs fewer stop words.
SHORT, LONG = 60, 200
MOST_LINKS = 0.5
LEAST_STOPS, LEAST_STOPS_LONG = 0.3, 0.2
#: Inside the article, where a block with fewer that ends a sentence is text as well.
LEAST_STOPS_INSIDE = 0.1
#: A page with a smaller share of stop words is in a language they are not known of.
FOREIGN = 0.05

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from had has have he her his i in is it its not of on or that the
    their they this to was we were which with you
    aber als am auch auf aus bei bin das dass dem den der des die du durch ein eine einen einer er
    es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war
    wie wir zu zum zur
    au aux avec ce ces cette dans de elle en est et il ils je la le les leur mais ne nous on ou par
    pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con del el ella ellos entre era esta este fue ha hay las lo los más me mi muy no nos
    para pero por porque ser si sin sobre su sus también una y ya
    """.split()
)

# Tags that start a block, and elements whose content is never text.
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu
    nav ol p pre section summary table tbody td tfoot th thead tr ul
    """.split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
BAD_TAGS = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "head"])
BAD_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)
#: Elements whose ends are looked for; others only end blocks.
SCOPES = BAD_TAGS | frozenset(["article", "main", "header", "div", "section", "ul", "ol", "table", "details"])

# A quoted value follows "=" and its closing quote ends the attribute; any other quote is a plain
# character, so one that is never closed does not reach beyond the ">" of its tag.
_QUOTED = r"""=\s*+(?:"[^"]*+"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z))"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|svg|iframe)\b[^>]*+(?:>|\Z)"
    r".*?(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)"
    # Controls that are not closed end at the next block.
    rf"|<(?P<control>button|select|object)\b[^>]*+(?:>|\Z)(?:(?!</(?P=control)\b|</?(?:{'|'.join(sorted(BLOCK_TAGS))})\b).)*+"
    r"(?:</(?P=control)\b[^>]*+(?:>|\Z))?+"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:{_QUOTED}|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_BAD_NAME = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|comments?|commentlist|disqus|cookies?"
    r"|consent|notices?|alert|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|share|sharing|social"
    r"|related|popup|modal|newsletter|subscribe|login|pagination"
)
_REMARKS = re.compile(r"comments?|commentlist|disqus")
#: Parts of a name that tell a state or a topic of what it stands on: ``has-sidebar``, ``ad-free``, ``comments-open``.
_STATE_FIRST = frozenset("has no not without with is category tag type format topic".split())
_STATE_LAST = frozenset("open opened closed off on free less hidden active enabled disabled visible".split())
_PARTS = re.compile(r"[-_]+")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?\u2026;](?=[\s\"'\u00bb\u201d)]|$)|[\u3002\uff01\uff1f\u061f\u06d4\u0964\u104b\u1362\u17d4]")
#: Letters of scripts in which a character says as much as two or three of others.
_WIDE = re.compile(r"[\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")


class Block(NamedTuple):
    text: str
    tag: str
    linked: int
    bad: bool
    header: bool
    article: bool
    main: bool


def _named(value: str) -> int:
    """What a class or id says: 2 for a name of something that is no text, 1 for a hint, 0 for nothing.

    A name counts as a whole, and one of comments by any of its parts; a part of another name is a hint.
    """
    told = 0
    for name in value.split():
        parts = [p for p in _PARTS.split(name) if p]
        if not parts or len(parts) > 1 and (parts[0] in _STATE_FIRST or parts[-1] in _STATE_LAST):
            continue
        if len(parts) == 1 and _BAD_NAME.fullmatch(parts[0]) or any(_REMARKS.fullmatch(p) for p in parts):
            return 2
        told = max(told, any(_BAD_NAME.fullmatch(p) for p in parts))
    return told


def _kind(tag: str, attrs: str) -> tuple[str, int]:
    """What a scope is (``bad``, ``header``, ``article``, ``main`` or nothing of these), and what its names say."""
    if tag in BAD_TAGS:
        return "bad", 0
    header, named = tag == "header", 0
    for name, value in _ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            return "bad", 0
        if name == "role" and value in BAD_ROLES:
            return "bad", 0
        if name in ("class", "id"):
            named = max(named, _named(value))
            header |= any(p in ("header", "topbar") for n in value.split() for p in _PARTS.split(n)[-1:])
    if tag == "main" or tag == "article" and named < 2:
        return tag, 0
    return "header" if header else "article" if tag == "article" else "", named


class _Suspect:
    """A scope whose name says that it is no text, and what it was found to hold."""

    __slots__ = ("article", "main", "named", "size")

    def __init__(self, named: int) -> None:
        self.named, self.size, self.article, self.main = named, 0, False, False

    def guilty(self, total: int) -> bool:
        """A name is overruled by a main element inside; a hint also by an article, or most of the page's text."""
        return not self.main and (self.named == 2 or not self.article and 2 * self.size <= total)


def blocks(page: str) -> list[Block]:
    found: list[tuple[Block, tuple[_Suspect, ...]]] = []
    stack: list[tuple[str, str, _Suspect | None]] = []
    suspects: list[_Suspect] = []
    opened: dict[str, int] = {}
    within = {"bad": 0, "header": 0, "article": 0, "main": 0, "": 0}
    parts: list[str] = []
    linked, in_link, tag_now, at = 0, False, "", 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            made = Block(text, tag_now, linked, *(within[k] > 0 for k in ("bad", "header", "article", "main")))
            found.append((made, tuple(suspects)))
        parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if in_link else 0

    for m in _TOKEN.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "a":
            in_link = not m["end"]
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            close()
            in_link, tag_now = False, "" if m["end"] else tag
            if tag in SCOPES and not m["end"]:
                kind, named = _kind(tag, m["attrs"])
                for s in suspects:
                    s.article |= kind == "article" and not named
                    s.main |= kind == "main"
                suspect = _Suspect(named) if named else None
                if suspect:
                    suspects.append(suspect)
                stack.append((tag, kind, suspect))
                opened[tag] = opened.get(tag, 0) + 1
                within[kind] += 1
            elif m["end"] and opened.get(tag):
                while True:
                    last, kind, suspect = stack.pop()
                    opened[last] -= 1
                    within[kind] -= 1
                    if suspect:
                        suspects.remove(suspect)
                    if last == tag:
                        break
    put(page[at:])
    close()
    # Names are judged when all is known that they stand on.
    total = 0
    for block, named in found:
        if not block.bad and not _dense(block):
            total += len(block.text)
            for s in named:
                s.size += len(block.text)
    return [b._replace(bad=b.bad or any(s.guilty(total) for s in named)) for b, named in found]


def _stops(text: str) -> tuple[int, int]:
    """How many of the words are stop words, and how many words there are."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _dense(b: Block) -> bool:
    return b.linked > MOST_LINKS * len(b.text)


def _length(text: str) -> int:
    return len(text) + len(_WIDE.findall(text))


def _prose(b: Block, foreign: bool, inside: bool = False) -> bool | None:
    """What length and stop words (or punctuation) say of a block that is not full of links."""
    if b.tag in HEADINGS or _length(b.text) < SHORT:
        return None
    if foreign:
        ended = bool(_SENTENCE_END.search(b.text))
        return True if ended else None if inside or _length(b.text) >= LONG else False
    stops, words = _stops(b.text)
    share = stops / max(words, 1)
    if share >= (LEAST_STOPS_INSIDE if inside else LEAST_STOPS_LONG if len(b.text) >= LONG else LEAST_STOPS):
        return True
    if inside:
        return True if _SENTENCE_END.search(b.text) else None
    return None if share >= 0.1 or len(b.text) >= LONG else False


def first_pass(found: list[Block]) -> list[bool | None]:
    """True for text, False for none, None for undecided."""
    usable = [b for b in found if not b.bad and not (b.header and b.tag not in HEADINGS)]
    article = any(b.article for b in usable)
    region = [b.article if article else b.main for b in found]
    counts = [_stops(b.text) for b in usable if not _dense(b)]
    words = sum(n for _, n in counts)
    foreign = sum(n for n, _ in counts) < FOREIGN * words
    # What the element holds, against what passes the rules outside of it.
    inside = outside = 0
    for b, within in zip(found, region, strict=True):
        if b.bad or b.header or _dense(b):
            continue
        if within:
            inside += len(b.text)
        elif _prose(b, foreign):
            outside += len(b.text)
    trusted = inside > 0 and inside >= outside
    labels: list[bool | None] = []
    for b, within in zip(found, region, strict=True):
        if b.bad or b.header and (b.tag not in HEADINGS or not within):
            labels.append(False)
        elif _dense(b):
            # Lists of links inside an article are menus; a sentence may be one link.
            told = b.tag not in ("li", "td", "div", "ul", "dd") or _length(b.text) >= SHORT and _SENTENCE_END.search(b.text)
            labels.append(None if trusted and within and told else False)
        else:
            said = _prose(b, foreign, trusted and within)
            small = b.tag in HEADINGS or _length(b.text) < SHORT
            if said is None and small and trusted:
                said = within
            elif said is None and small and within:
                said = False
            elif trusted and not within:
                said = bool(said)
            labels.append(said)
    return labels


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbour."""

    def nearest(order: range) -> dict[int, tuple[int, bool]]:
        last, out = None, {}
        for i in order:
            if labels[i] is not None:
                last = (i, labels[i])
            elif last is not None:
                out[i] = (abs(i - last[0]), last[1])
        return out

    before, after = nearest(range(len(labels))), nearest(range(len(labels) - 1, -1, -1))
    final = []
    for i, label in enumerate(labels):
        if label is None:
            sides = sorted(x for x in (before.get(i), after.get(i)) if x)
            if not sides:
                label = True
            elif len(sides) == 2 and sides[0][0] == sides[1][0] and sides[0][1] != sides[1][1]:
                label = found[i].tag in HEADINGS or found[i].article
            else:
                label = sides[0][1]
        final.append(label)
    return final


def main_text(page: str) -> str:
    found = blocks(page)
    labels = second_pass(found, first_pass(found))
    return "\n\n".join(b.text for b, good in zip(found, labels, strict=True) if good)


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all, if none are named) and the main text; the latter's name."""
    keep = pages.columns if keep is None else keep
    name = free_name(pages.columns, "main_text")
    whole = free_name([*pages.columns, name], "whole_page")
    source = pages.select(*(pages[c] for c in keep), pages[page].alias(whole))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(name, T.StringType())])

    def work(batch: pa.RecordBatch) -> dict:
        texts = [main_text(p) for p in plain(batch[whole]).to_pylist()]
        return {**{c: batch[c] for c in keep}, name: pa.array(texts, pa.string())}

    return map_slices(source, whole, work, schema), name
