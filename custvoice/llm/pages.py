"""Main text of web pages by the distribution of text over lines.

A page is cut into blocks, one line each; every container that opens or closes between two
blocks leaves an empty line, and what is never article by its element (menus, headers,
footers, asides, forms) leaves ``WINDOW`` of them, as do blocks outside of the article that
are mostly links.  Adverts, notices, share bars and readers' comments, known by their class
or role, are taken out and leave nothing: what stands before and after them is as near as if
they were not there.  Over the lengths of the lines a window of ``WINDOW`` lines slides; where
its sum rises from nothing is a surge, where it falls back to nothing a dive, and the text
between the two is one region.

Where the page has an ``article`` or ``main`` with text, lines outside of it count as empty,
and of the regions inside those go of which ``LINKED`` or more is links: lists of links set
apart from the text.  On other pages the largest region stays, those of at least ``SHARE``
of its length, and what lies between regions that stay and is no list of links.

Defined results: a null, empty or unreadable page has the empty text; an element never
closed ends with the page or where the article begins; repeated rows are read each;
other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from custvoice.llm.store import only

WINDOW = 3
SHARE = 0.3
LINKED = 0.6  # share of linked text beyond which a block is no article

# Elements by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas video audio select option".split())
ASIDE = frozenset("nav footer aside form menu button dialog fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br input nobr".split()
)
NESTED = frozenset("article main section div header nav footer aside form menu dialog fieldset ul ol dl table body blockquote figure".split())
MAIN = frozenset(("article", "main"))
# A name as a whole, or a part of a compound one.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|footer|comments?|disqus|"
    r"cookies?|consent|popup|modal|share|sharing|newsletter|subscribe|signup|login|widget|pager|pagination|toolbar|masthead)(?:$|[\s_-])"
    # Words that also stand in names of articles count as whole names, or with what such boxes are called.
    r"|(?:^|\s)(?:side|search|related|notices?|alert|replies|social|skip|recommend\w*)"
    r"(?:[_-](?:bar|box|links?|posts?|articles?|stories|list|form|icons?|media|message|to|items?|content))*(?:$|\s)",
    re.IGNORECASE,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAMED = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


def _noise(name: str, attributes: str, inside: bool) -> bool:
    if name in ASIDE or name == "header" and not inside:
        return True
    if not attributes or name in MAIN and not inside or name == "body":
        return False
    # The id of a heading or paragraph is the target of a link and says nothing.
    by_id = name in NESTED
    named = ((what.lower(), a or b or c) for what, a, b, c in _NAMED.findall(attributes))
    return bool(_HIDDEN.search(attributes)) or any(NOISE.search(value) for what, value in named if what != "id" or by_id)


class Block(NamedTuple):
    text: str
    noise: bool
    inside: bool  # of the article
    gap: int  # empty lines before it
    linked: float  # share of its text that is links


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    found: list[Block] = []
    open_: list[tuple[str, bool]] = []  # nested elements: name, whether noise
    noisy = inside = 0  # how many of the open ones are noise, how many hold the article
    parts: list[str] = []
    length = linked = link = gap = 0
    passing = ""  # an element that is no nested one, but noise

    def end_block() -> None:
        nonlocal length, linked, passing, gap
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append(Block(text, bool(noisy or passing), inside > 0, gap, linked / max(length, 1)))
            gap = 0
        parts.clear()
        length = linked = 0
        passing = ""

    def close(upto: int) -> None:
        nonlocal noisy, inside, gap
        while len(open_) > upto:
            name, noise = open_.pop()
            noisy -= noise
            inside -= name in MAIN
            if not noisy:
                gap += not noise
                if noise and not inside and (name in ASIDE or name == "header"):
                    gap += WINDOW

    at, size = 0, len(page)
    lower = None
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            piece = page[at:mark]
            parts.append(piece)
            shown = len(piece.strip())
            length += shown
            linked += shown if link else 0
        if mark == size:
            break
        tag = _TAG.match(page, mark)
        if not tag:
            if page.startswith("<!--", mark):
                stop = page.find("-->", mark + 4)
                at = size if stop < 0 else stop + 3
            elif page[mark + 1 : mark + 2] in ("!", "?", "/") or page[mark + 1 : mark + 2].isalpha():
                stop = page.find(">", mark)
                at = size if stop < 0 else stop + 1
            else:  # a bare sign
                parts.append("<")
                at = mark + 1
            continue
        at = tag.end()
        ending, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in RAW:
            if not ending and not attributes.endswith("/"):
                lower = page.lower() if lower is None else lower
                stop = lower.find("</" + name, at) if len(lower) == size else page.find("</" + tag[2], at)
                stop = page.find(">", stop) if stop >= 0 else -1
                at = size if stop < 0 else stop + 1
            parts.append(" ")
        elif name in INLINE:
            if name == "a":
                link = 0 if ending else 1
            elif name == "br":
                parts.append(" ")
        else:
            end_block()
            link = 0
            if name in NESTED:
                if ending:
                    places = [k for k, (n, _) in enumerate(open_) if n == name]
                    if places:
                        close(places[-1])
                elif not attributes.endswith("/"):
                    if name in MAIN and noisy and not inside and not any(noise and NOISE.search(n) for n, noise in open_ if n not in ASIDE):
                        close(0)  # the article cannot stand in an element that was left open
                    noise = _noise(name, attributes, inside > 0)
                    open_.append((name, noise))
                    noisy += noise
                    inside += name in MAIN
                    gap += not noisy
            elif not ending and (name in ASIDE or _noise(name, attributes, inside > 0)):
                passing = name
    end_block()
    return found


def regions(lengths: np.ndarray) -> list[tuple[int, int]]:
    """From surge to dive: first and last line of each stretch where the sliding sums are above nothing."""
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))  # sums[i] covers the lines i - WINDOW + 1 to i
    above = np.concatenate(([False], sums > 0, [False]))
    surges = np.flatnonzero(above[1:] & ~above[:-1])
    dives = np.flatnonzero(~above[1:] & above[:-1])
    return [(int(a), int(b) - WINDOW) for a, b in zip(surges, dives)]


def main_text(page: str | None) -> str:
    """The article of the page, a block a line; empty where there is none."""
    if not page:
        return ""
    found = blocks(page)
    article = any(b.inside and not b.noise for b in found)
    lines: list[str] = []
    links: list[float] = []
    gap = 0
    for block in found:
        gap += block.gap
        if block.noise:
            continue
        if article and not block.inside or not article and block.linked >= LINKED:
            gap += WINDOW
            continue
        lines += [""] * min(gap, WINDOW) + [block.text]
        links += [0.0] * min(gap, WINDOW) + [block.linked * len(block.text)]
        gap = 0
    if not lines:
        return ""
    lengths, linked = np.array([len(line) for line in lines], np.int64), np.array(links)
    stretches = regions(lengths)
    sizes = [int(lengths[a : b + 1].sum()) for a, b in stretches]
    text = [linked[a : b + 1].sum() < LINKED * n for (a, b), n in zip(stretches, sizes)]
    if article:
        # Links are all there is to an article of nothing else.
        stay = text if any(text) else [True] * len(text)
    else:
        large = [i for i, n in enumerate(sizes) if n >= SHARE * max(sizes)]
        stay = [large[0] <= i <= large[-1] and (i in large or text[i]) for i in range(len(sizes))]
    return "\n".join(line for (a, b), keep in zip(stretches, stay) if keep for line in lines[a : b + 1] if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            texts = [main_text(page) for page in some["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [some["page_id"], some["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each row of ``pages``, in one pass without a shuffle."""
    return only(pages, page_id="bigint", url="string", html="string").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
