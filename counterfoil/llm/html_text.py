"""One page's markup as blocks of text, each marked as main text, page furniture or undecided."""

from __future__ import annotations

import html
import re

MAIN, FURNITURE, OPEN = "main", "furniture", "open"

# What HTML elements and common class names stand for.
RAW = "script|style|noscript|template|textarea|title|iframe|object|svg|canvas|select|button"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog head".split())
IMPLIED = frozenset("p li dt dd tr td th option".split())  # ended by the next of their kind
WHOLE = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form note".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer form header masthead menu menus nav navbar navigation newsletter notice notices popup "
    "promo promoted promotion related reply replies respond share sharing sidebar social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
REMARKS = frozenset("comment comments disqus promoted related reply replies respond sponsored".split())

ATTRIBUTES = r"""(?:[^"'>]|"[^"]*"|'[^']*')*"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][\w:-]*)({ATTRIBUTES})>|<(/?)([a-z][\w:-]*)[^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role|aria-hidden|hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[^a-z0-9]+")


def _names(attributes: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in NAMED.finditer(attributes)}


def _is_furniture(tag: str, named: dict[str, str], in_main: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not in_main):
        return True
    if "hidden" in named or named.get("aria-hidden") == "true" or named.get("role") in ROLES:
        return True
    if tag in ("body", "html"):
        return False
    parts = PART.split(named.get("class", "") + " " + named.get("id", ""))
    return any(part in FURNITURE_NAMES for part in parts)


def _remarks(tag: str, named: dict[str, str]) -> bool:
    """Furniture that holds articles of its own: remarks of readers, teasers, hidden parts."""
    if tag in ("body", "html"):
        return False
    if tag == "aside" or "hidden" in named or named.get("aria-hidden") == "true" or named.get("role") == "complementary":
        return True
    whole = named.get("class", "").split() + [named.get("id", "")]
    if any(name in REMARKS or name.startswith(("comment-", "reply-", "related-")) for name in whole):
        return True
    # An article with a name that only mentions remarks, as of their number, is no remark.
    return tag not in WHOLE and any(part in REMARKS for name in whole for part in PART.split(name))


def _closed(tokens: list[re.Match]) -> set[int]:
    """Places of the tokens that open an element with an end tag of its own."""
    found: set[int] = set()
    unclosed: dict[str, list[int]] = {}
    for i, token in enumerate(tokens):
        tag = (token[3] or token[6] or "").lower()
        if not (token[2] or token[5]):
            unclosed.setdefault(tag, []).append(i)
        elif unclosed.get(tag):
            found.add(unclosed[tag].pop())
    return found


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) in page order; references are decoded and white space is one blank.

    Main text stands in an article or main element, or one with that role, without the furniture inside.
    Furniture is known by its element, role, class or id. An article inside furniture is furniture, as
    comments and teasers are, and its end tag ends only itself. Furniture without an end tag of its own
    ends where a main element opens, and any furniture ends with the main element around it. Where no
    main text is found so, main elements also end furniture that isn't known to hold such articles.
    """
    tokens = list(TOKEN.finditer(page))
    out, held = _blocks(page, tokens, True)
    if held and all(kind != MAIN for kind, _ in out):
        out, _ = _blocks(page, tokens, False)
    return out


def _blocks(page: str, tokens: list[re.Match], strict: bool) -> tuple[list[tuple[str, str]], bool]:
    """The blocks, and whether furniture held a main element."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    main: list[list] = []  # open main elements, [tag, open elements of that tag]
    inner: list[str] = []  # main elements inside the furniture
    aside, depth, own, held, closed = "", 0, False, False, None

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((FURNITURE if aside else MAIN if main else OPEN, text))
        parts.clear()

    def leave(tag: str) -> None:
        """Past the end tag of the innermost main element with this tag."""
        for i in reversed(range(len(main))):
            if main[i][0] == tag:
                main[i][1] -= 1
                del main[i + 1 if main[i][1] else i :]
                return

    at, opened = 0, 0
    for i, token in enumerate(tokens):
        if token.start() > at:
            parts.append(html.unescape(page[at : token.start()]))
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(token[2] or token[5]), token[4] or ""
        named = _names(attributes) if attributes.strip(" /") else {}
        if tag in INLINE and tag != aside and not named:
            continue
        if aside in IMPLIED and not ends and tag not in INLINE and (tag == aside or aside == "p"):
            close()
            aside, inner = "", []
        opens_main = not ends and tag not in VOID and not (tag in WHOLE and _remarks(tag, named))
        opens_main = opens_main and (tag in WHOLE or named.get("role") == "main" or named.get("itemprop") == "articlebody")
        if tag not in INLINE:
            close()
        if aside and opens_main:
            closed = _closed(tokens) if closed is None else closed
            if opened in closed and (strict or own or main):
                held = True
            else:
                close()
                aside, inner = "", []
        if aside and ends and tag in WHOLE and tag != aside and tag not in inner and any(tag == m[0] for m in main):
            close()
            aside, inner = "", []
        if aside:
            if tag == aside and tag not in VOID:
                depth += -1 if ends else 1
                if not depth:
                    close()
                    aside, inner = "", []
            elif tag in WHOLE and not ends:
                inner.append(tag)
            elif tag in inner:
                del inner[len(inner) - 1 - inner[::-1].index(tag) :]
            continue
        if ends:
            if main and any(tag == m[0] for m in main):
                close()
                leave(tag)
        elif opens_main:
            close()
            main.append([tag, 1])
        elif tag not in VOID and not attributes.endswith("/") and (
            _remarks(tag, named) or (tag not in WHOLE and _is_furniture(tag, named, bool(main)))
        ):
            close()
            aside, depth, opened, own, inner = tag, 1, i, _remarks(tag, named), []
        elif main and main[-1][0] == tag:
            main[-1][1] += 1
    parts.append(html.unescape(page[at:]))
    close()
    return out, held
