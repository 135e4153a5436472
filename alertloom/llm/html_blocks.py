"""The text blocks of one page, with what the markup says about each."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element names and class words of the web.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_TAGS = frozenset("head nav footer aside form menu dialog button select option object canvas audio video map search".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo "
    "banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comment comments disqus respond reply replies pagination pager toolbar widget widgets copyright legal".split()
)
#: Of these, those that make an article element something else than the page's article.
OUTSIDE_CARDS = frozenset("comment comments reply replies ad ads advert sponsored promo related recommended".split())
#: In an article a name says so only as a whole, or made of these and such words alone, as in "share-buttons" or "ad-box".
FRAME_WORDS = frozenset(
    "area article articles bar block body box button buttons card container content entry form group header heading icons inner item items link links list "
    "main page panel post posts section site slot story stories title top unit wrap wrapper".split()
)
#: There, ids of headings, sections and small elements are slugs of what they say; only these ids of a section count.
ID_TAGS = frozenset("div ul ol".split())
SECTION_IDS = frozenset("comments respond disqus_thread".split())
#: A class that starts so, as in "has-sidebar", speaks of what is beside the element.
SAID_OF_OTHERS = frozenset("has no with without is not".split())
#: Opening one of the first ends an open one of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Block(NamedTuple):
    text: str
    inside: bool  # in an article or main element
    outside: bool  # in a menu, header, footer, sidebar, notice, advert, form or comments


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(text)}


def marks(tag: str, text: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element opens main content, and whether it stands outside it."""
    found = attributes(text) if text.strip(" /\n\t\r\f") else {}
    role = found.get("role", "").lower()
    classes, ids = (found.get(key, "").lower().split() for key in ("class", "id"))
    strict = inside or tag in ("article", "main")
    if strict and (tag not in ID_TAGS or "section" in classes):
        ids = [name for name in ids if name in SECTION_IDS and tag in ("div", "section")]
    names = [re.split(r"[^a-z0-9]+", name) for name in classes + ids if name not in SECTION_IDS]
    said = {name.split("_")[0] for name in classes + ids if name in SECTION_IDS}
    words = {w for parts in names if parts[0] not in SAID_OF_OTHERS and not (strict and set(parts) - OUTSIDE_WORDS - FRAME_WORDS) for w in parts}
    words = (words | said) - ({"header", "masthead"} if inside else set())
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    outside = tag in OUTSIDE_TAGS or (tag == "header" and not inside) or role in OUTSIDE_ROLES or hidden
    words &= OUTSIDE_CARDS if tag in ("article", "main") else frozenset() if tag in ("html", "body") else OUTSIDE_WORDS
    outside = outside or bool(words)
    return tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody", outside


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order: text with character references decoded, each run of white space one space."""
    out: list[Block] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, inside, outside: as for all it holds

    def end_block() -> None:
        if text:
            if words := " ".join("".join(text).split()):
                out.append(Block(words, stack[-1][1] if stack else False, stack[-1][2] if stack else False))
            text.clear()

    def close(names: tuple[str, ...], stop: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if not found:
            text.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            text.append(html.unescape(page[at : found.start()]))
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if tag in BLOCK_TAGS:
                end_block()
            close((tag,))
            continue
        if tag in RAW_TAGS:
            if not (found[3] or found[6] or "").endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            text.append(" ")
            continue
        if tag in BLOCK_TAGS:
            end_block()
            close(("p",), frozenset(("div", "section", "article", "main", "body", "li", "td", "th", "blockquote")))
            close(CLOSES.get(tag, ()), frozenset(("ul", "ol", "dl", "table", "select")))
        elif tag == "br":
            text.append(" ")
        if tag in VOID_TAGS:
            continue
        inside, outside = stack[-1][1:] if stack else (False, False)
        opens, leaves = marks(tag, found[3] or found[6] or "", inside)
        if (leaves or opens) and tag not in BLOCK_TAGS:
            end_block()
        stack.append((tag, inside or opens, outside or leaves))
    end_block()
    return out
