"""Main-text extraction from HTML by two passes of block rules.

A page is cut into blocks of text. Pass 1 decides a block by its length, its stop-word density
and its link density, to which its place adds a prior: within `article` or `main`, outside of
them where they hold the page's text, or within an element whose tag or name says that it is a
menu, an advert, a comment and the like (a suspect). Pass 2 lets blocks that stay ambiguous inherit from their
nearest decided neighbours.

Names are not trusted blindly: a suspect that holds the page's text (a wrapper called
`with-sidebar`, an article of class `related`) is none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and frequent function words of four languages.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav noframes noscript ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
REMOVED = frozenset(
    "script style head title textarea select button noscript template iframe svg object noembed noframes xmp "
    "audio video canvas label input option datalist".split())
SUSPECT_TAGS = frozenset("nav footer header aside form menu dialog".split())
NEVER_TEXT = frozenset("nav footer aside menu dialog".split())     # but where they hold a landmark or a first heading
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDED_BY_ITSELF = frozenset("li dt dd tr td th option".split())
SUSPECT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert sidebar widget widgets menu nav navbar "
    "navigation navi breadcrumb breadcrumbs footer header masthead "
    "share sharing social related recommended newsletter subscribe "
    "subscription signup login popup modal overlay pagination pager toolbar skip copyright legal".split())
COMMENT_NAMES = frozenset("comment comments commentlist respond reply replies disqus".split())
OPPOSITES = frozenset("no non not without with has free hide main article post entry content body".split())
SUSPECT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
STOP_WORDS = frozenset(
    # English
    "the of and to in is it that for as with was on are by this be from at or an not but have has he she "
    "they his her which you we its were been their one all would there when if so no will more can who "
    # German
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden "
    "aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder "
    # French
    "le la les de des du et en un une est que qui dans pour par sur pas au aux plus ce il elle ne se avec "
    "sont son sa ses ou mais comme nous vous leur cette été être a "
    # Spanish
    "el los las del y una por con para no su al lo como más pero sus este ya entre cuando muy sin sobre "
    "ser tiene también me hasta hay donde quien desde todo nos".split())


STOP_DENSITY = 0.12
KNOWN_DENSITY = 0.05     # pages with fewer stop words are in none of the languages; length and links decide them
LINK_DENSITY = 0.4
SHORT_CHARS = 70
LONG_CHARS = 200

# Points of the first pass.
LONG_TEXT, MEDIUM_TEXT, NO_STOP_WORDS, LINKS = 3.0, 2.0, -2.0, -4.0
INSIDE, OUTSIDE, SUSPECT, LEGAL = 1.5, -2.0, -6.0, -3.0
GOOD_FROM, BAD_TO = 2.0, -1.5

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]*)(\s*=\s*)?")
SPLIT_NAME = re.compile(r"[^a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
LEGAL_TEXT = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\W*$", re.IGNORECASE)


class Block(NamedTuple):
    text: str
    link_chars: int
    heading: bool
    node: int        # element that holds it


class Node(NamedTuple):
    parent: int
    tag: str
    suspect: str     # "", "tag", "name" or "comment"
    landmark: bool   # article or main
    removed: bool    # it or an element around it is no text for readers


class _Quotes:
    """Where the next quote of a kind is; a kind that has no further one is not searched again."""

    def __init__(self, page: str):
        self.page, self.ended = page, {}

    def find(self, quote: str, at: int) -> int:
        if at >= self.ended.get(quote, len(self.page) + 1):
            return -1
        found = self.page.find(quote, at)
        if found < 0:
            self.ended[quote] = at
        return found


def _tag(page: str, at: int, quotes: _Quotes) -> tuple[int, dict[str, str], bool]:
    """(index after the `>`, attributes, closed by `/>`) of the tag whose name ends at `at`; -1 where it has no end.

    Values in quotes may hold anything and have any length. A quote that is never closed is a plain character.
    """
    simple = page.find(">", at)
    if simple < 0:
        return -1, {}, False
    if "=" not in page[at:simple]:
        return simple + 1, dict.fromkeys(page[at:simple].lower().replace("/", " ").split(), ""), page[simple - 1] == "/"
    found: dict[str, str] = {}
    end = len(page)
    while at < end:
        m = ATTRIBUTE.match(page, at)
        name, at = m[1].lower(), m.end()
        value = ""
        if m[2]:
            stop = quotes.find(page[at], at + 1) if at < end and page[at] in "\"'" else -1
            if stop >= 0:
                value, at = page[at + 1:stop], stop + 1
            else:
                start = at
                while at < end and page[at] not in " \t\n\r\f>":
                    at += 1
                value = page[start:at]
        if name:
            found.setdefault(name, value)
        if at < end and page[at] == ">":
            return at + 1, found, page[at - 1] == "/" and not value
        if at == m.start():
            at += 1
    return -1, found, False


def _suspect(tag: str, attributes: dict[str, str], in_landmark: bool) -> str:
    if tag in SUSPECT_TAGS and not (tag == "header" and in_landmark):
        return "tag"
    if attributes.get("role", "").lower() in SUSPECT_ROLES:
        return "tag"
    if tag in ("html", "body"):
        return ""
    found = ""
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split():
        parts = SPLIT_NAME.split(name)
        if any(p in OPPOSITES for p in parts):    # no-comments, with-sidebar, promo-free
            if not (COMMENT_NAMES.intersection(parts) and parts[-1] in ("body", "content")):
                continue
        if COMMENT_NAMES.intersection(parts):
            return "comment"
        if SUSPECT_NAMES.intersection(parts):
            found = "name"
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return ("hidden" in attributes and attributes["hidden"].lower() != "until-found") or \
        attributes.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(attributes.get("style", "").lower()))


def parse(page: str) -> tuple[list[Block], list[Node]]:
    """Blocks in page order and the elements that hold them. Malformed markup closes what it must and never fails."""
    out: list[Block] = []
    nodes = [Node(-1, "", "", False, False)]
    stack: list[tuple[str, int]] = []        # tag and node; a plain inline element has the node around it
    block_at: list[int] = []                 # places of block elements in the stack
    opened: Counter = Counter()
    texts: list[str] = []
    links = 0
    heading = False
    quotes = _Quotes(page)
    at, end = 0, len(page)

    def here() -> int:
        return stack[-1][1] if stack else 0

    def flush() -> None:
        nonlocal texts, links, heading
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            if text and not nodes[here()].removed:
                out.append(Block(text, links, heading, here()))
        texts, links, heading = [], 0, False

    def add(text: str) -> None:
        nonlocal links, heading
        texts.append(text)
        if opened["a"]:
            links += len("".join(text.split()))
        heading = heading or any(opened[h] for h in HEADINGS)

    def pop_to(index: int) -> None:
        if any(t in BLOCKS for t, _ in stack[index:]) or stack[index][1] != (stack[index - 1][1] if index else 0):
            flush()
        for t, _ in stack[index:]:
            opened[t] -= 1
        del stack[index:]
        while block_at and block_at[-1] >= index:
            block_at.pop()

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        nxt = page[lt + 1:lt + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", lt):
                stop = page.find("]]>", lt)
                add(entities_safe(page[lt + 9:stop if stop >= 0 else end]))
                at = end if stop < 0 else stop + 3
            else:
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
            continue
        found = NAME.match(page, lt + 1)
        if not found:
            add("<")
            at = lt + 1
            continue
        tag, closing = found[1].lower(), nxt == "/"
        at, attributes, empty = _tag(page, found.end(), quotes)
        if at < 0:
            break
        if closing:
            if opened[tag]:
                index = len(stack) - 1
                while stack[index][0] != tag:
                    index -= 1
                pop_to(index)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW and not empty:
            if tag in BLOCKS:
                flush()
            close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
            if block_at:                     # an open paragraph or item ends here
                t = stack[block_at[-1]][0]
                if t == "p" or (t == tag and tag in ENDED_BY_ITSELF):
                    pop_to(block_at[-1])
        if tag in VOID or empty:
            continue
        around = nodes[here()]
        inside = bool(opened["article"] or opened["main"])
        suspect = _suspect(tag, attributes, inside)
        gone = around.removed or tag in REMOVED or _hidden(attributes)
        node = here()
        if tag in BLOCKS or suspect or gone != around.removed:
            if tag not in BLOCKS:
                flush()
            else:
                block_at.append(len(stack))
            nodes.append(Node(node, tag, suspect, tag in ("article", "main") or attributes.get("role", "").lower() == "main", gone))
            node = len(nodes) - 1
        stack.append((tag, node))
        opened[tag] += 1
    flush()
    return out, nodes


def entities_safe(text: str) -> str:
    return text.replace("&", "&amp;")


class Look(NamedTuple):
    """What the rules read of a block."""

    chars: int
    linked: bool     # link density above the bound
    stops: float     # stop-word density


def _look(b: Block) -> Look:
    words = b.text.lower().split()
    hits = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words)
    return Look(len(b.text), b.link_chars > LINK_DENSITY * len(b.text), hits / max(1, len(words)))


def _places(found: list[Block], looks: list[Look], nodes: list[Node], known: bool) -> tuple[list[bool], list[int]]:
    """For each block whether it lies in a suspect, and its place: 1 in the landmarks that hold the text
    (and in no suspect there), -1 elsewhere on such a page, 0 on others."""
    weight = [0 if k.linked else k.chars for k in looks]
    decent = [not k.linked and k.chars >= SHORT_CHARS and (k.stops >= STOP_DENSITY or not known) for k in looks]
    opens = [n.landmark or n.tag == "h1" for n in nodes]      # holds a landmark or a first heading, or is one
    marked = [n.landmark for n in nodes]                      # lies in a landmark
    for i in range(len(nodes) - 1, 0, -1):
        opens[nodes[i].parent] |= opens[i]
    for i in range(1, len(nodes)):
        marked[i] |= marked[nodes[i].parent]
    pardoned: set[int] = set()
    while True:
        over = [0] * len(nodes)              # innermost suspect at or above a node
        never = [False] * len(nodes)         # a suspect at or above it holds no text by its tag
        for i in range(1, len(nodes)):
            n = nodes[i]
            over[i] = i if n.suspect and i not in pardoned else over[n.parent]
            never[i] = never[n.parent] or (over[i] == i and n.tag in NEVER_TEXT and not opens[i])
        clean = [not over[b.node] for b in found]
        free = sum(w for w, c in zip(weight, clean, strict=True) if c)
        has_text = any(d and c for d, c in zip(decent, clean, strict=True))
        must_open = has_text or any(c and marked[b.node] for b, c in zip(found, clean, strict=True))
        under: Counter = Counter()
        for b, w, d in zip(found, weight, decent, strict=True):
            if d and over[b.node]:
                under[over[b.node]] += w
        wanted = [(nodes[i].suspect != "comment", w, -i) for i, w in under.items() if w > free and not never[i]
                  and (opens[i] or not must_open) and not (has_text and nodes[i].suspect == "comment")]
        if not wanted:
            break
        i = -max(wanted)[2]
        while i:                             # and what it lies in
            if nodes[i].suspect:
                pardoned.add(i)
            i = nodes[i].parent
    landmark = [False] * len(nodes)
    for i in range(1, len(nodes)):
        landmark[i] = landmark[nodes[i].parent] or (nodes[i].landmark and not over[i])
    within = sum(w for b, w, c in zip(found, weight, clean, strict=True) if c and landmark[b.node])
    if not within or 2 * within < free:
        return [not c for c in clean], [0] * len(found)
    return [not c for c in clean], [1 if c and landmark[b.node] else -1 for b, c in zip(found, clean, strict=True)]


GOOD, BAD, AMBIGUOUS = 1, 0, -1


def classify(found: list[Block], nodes: list[Node]) -> list[bool]:
    """Pass 1 gives points for length, stop words, links and place; pass 2 lets ambiguous blocks inherit from the
    nearest decided neighbour, one under the same parent first (at equal distance the prior decides; a heading looks at what follows)."""
    looks = [_look(b) for b in found]
    long = [k for k in looks if not k.linked and k.chars >= SHORT_CHARS]
    known = not long or sum(k.stops * k.chars for k in long) >= KNOWN_DENSITY * sum(k.chars for k in long)
    suspects, places = _places(found, looks, nodes, known)
    labels = []
    for b, k, suspect, place in zip(found, looks, suspects, places, strict=True):
        points = INSIDE * (place > 0) + OUTSIDE * (place < 0) + SUSPECT * suspect
        if k.linked:
            points += LINKS / 4 if b.heading and place > 0 else LINKS
        elif LEGAL_TEXT.search(b.text) and place <= 0:
            points += LEGAL
        elif k.chars >= SHORT_CHARS and not (b.heading and k.chars < LONG_CHARS):
            if k.stops >= STOP_DENSITY or not known:
                points += LONG_TEXT if k.chars >= LONG_CHARS else MEDIUM_TEXT
            elif k.chars >= LONG_CHARS:
                points += NO_STOP_WORDS
        labels.append(GOOD if points >= GOOD_FROM else BAD if points <= BAD_TO else AMBIGUOUS)

    home = [nodes[b.node].parent for b in found]

    def decided(order) -> list[tuple[tuple[bool, int], int] | None]:
        """(distance, label) of the last decided block before each, in this order, blocks of another parent element being
        farther than all others; only blocks of the same place count."""
        last: dict[int, tuple[int, int]] = {}
        out: list[tuple[tuple[bool, int], int] | None] = [None] * len(labels)
        for step, i in enumerate(order):
            seen = last.get(places[i])
            out[i] = ((home[seen[1]] != home[i], step - seen[0]), labels[seen[1]]) if seen else None
            if labels[i] != AMBIGUOUS:
                last[places[i]] = (step, i)
        return out

    before, after = decided(range(len(labels))), decided(range(len(labels) - 1, -1, -1))
    keep = []
    for b, x, place, lo, hi in zip(found, labels, places, before, after, strict=True):
        if x != AMBIGUOUS:
            keep.append(x == GOOD)
        elif b.heading and hi:
            keep.append(hi[1] == GOOD)
        elif lo and hi and lo[1] != hi[1]:
            near = lo if lo[0] < hi[0] else hi if hi[0] < lo[0] else None
            keep.append(place > 0 if near is None else near[1] == GOOD)
        elif lo or hi:
            keep.append((lo or hi)[1] == GOOD)
        else:
            keep.append(place > 0 or (place == 0 and b.link_chars == 0))
    return keep


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, nodes = parse(page)
    return "\n\n".join(b.text for b, good in zip(found, classify(found, nodes), strict=True) if good)


def _extract(column: str, text: str, chars: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(column)
            texts = [main_text(pages[i].as_py()) for i in range(batch.num_rows)]
            out = {f: batch.column(f) for f in batch.schema.names}
            out[text] = pa.array(texts, pa.string())
            out[chars] = pa.array([len(t) for t in texts], pa.int64())
            del out[column]
            yield pa.RecordBatch.from_pydict(out)
    return run


def extract_text(pages: DataFrame, html: str = "html", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """Replace column `html` by `text` (main text, blocks joined by two line feeds) and `chars`.

    Every row of `pages` gives one row; other columns pass through, but columns that are
    already called like the new ones are replaced. Null and empty pages give an empty text.
    Pages are whole and independent: no shuffle, and one page is held at a time. Repeated
    rows stay repeated.
    """
    from pyspark.sql import types as T

    kept = [f for f in pages.schema.fields if f.name not in (text, chars)]
    schema = T.StructType([f for f in kept if f.name != html]
                          + [T.StructField(text, T.StringType()), T.StructField(chars, T.LongType())])
    source = pages.select(*[F.col(f"`{f.name}`") for f in kept])
    return source.mapInArrow(_extract(html, text, chars), schema)
