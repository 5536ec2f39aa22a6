"""A forgiving HTML reader for main-text extraction: blocks of text with their place in the page.

It makes one pass, keeps no tree, and is linear in the page: tags never need a closing partner, a
page may break off anywhere."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CHROME_TAGS = frozenset(
    "nav aside footer script style noscript template iframe noembed noframes xmp svg math canvas object audio video button select option textarea input dialog menu head title".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Whole class or id names that hint at something beside the text; a hint never decides alone (see html_template).
SIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsored sponsor promo nav navbar navigation menu topbar toolbar site-header masthead site-footer footer sidebar
    rail widget widgets breadcrumb breadcrumbs pagination pager cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notices banner popup modal overlay newsletter
    subscribe signup login comment comments comment-list commentlist comments-area disqus_thread respond replies discussion share share-buttons social social-share related related-posts
    related-articles recommended recommendations trending tags toc skip-link""".split()
)
COMMENT_NAMES = frozenset("comments comment-list commentlist comments-area disqus_thread respond replies".split())
ARTICLE_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends an open element of these kinds, up to the listed containers.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select html body article main section div td th".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
DIGITS = re.compile(r"[0-9]+")


@dataclass(slots=True)
class Block:
    path: str
    text: str
    chrome: bool
    article: int  # nth outermost article or main element, 0: none
    linked: int  # characters inside links
    side: str = ""  # path of the outermost element around it whose name hints at something beside the text


@dataclass(slots=True)
class _Open:
    tag: str
    path: str
    chrome: bool
    article: int
    inline: bool
    side: str = ""
    form: bool = False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)} if text else {}


def _is_chrome(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether the markup itself says that this is no text of the page."""
    if tag in CHROME_TAGS or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("html", "body") or tag in ARTICLE_TAGS:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in CHROME_ROLES:
        return True
    return "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _is_side(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body") or tag in ARTICLE_TAGS or tag in HEADINGS or not ("class" in attributes or "id" in attributes):
        return False
    return not SIDE_NAMES.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())


def _is_comments(attributes: dict[str, str]) -> bool:
    return not COMMENT_NAMES.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())


def _tag_end(page: str, at: int) -> int:
    """The index of the tag's ``>``, quotes minded; -1 if the page breaks off in the tag."""
    end = page.find(">", at)
    while end >= 0:
        part = page[at:end]
        if '"' not in part and "'" not in part:
            return end
        quote = ""
        for mark in re.findall("[\"']", part):
            quote = "" if mark == quote else (quote or mark)
        if not quote:
            return end
        closing = page.find(quote, end)
        if closing < 0:
            return page.find(">", at)
        end = page.find(">", closing)
    return -1


def blocks(page: str) -> list[Block]:
    found: list[Block] = []
    base = _Open("", "", False, 0, False)
    stack: list[_Open] = []
    pieces: list[str] = []
    linked = articles = at = depth_a = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                top = next((o for o in reversed(stack) if not o.inline), base)
                # a form around an article is the page's; any other is a form
                chrome = (stack[-1].chrome if stack else False) or (top.form and not top.article)
                found.append(Block(top.path, text, chrome, top.article, linked, top.side))
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if depth_a:
                linked += len(text)

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        following = page[start + 1 : start + 2]
        if not (following in ("/", "!", "?") or (following.isascii() and following.isalpha())):
            say(page[at : start + 1])
            at = start + 1
            continue
        say(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        closing = following == "/"
        name = NAME.match(page, start + 1 + closing)
        end = _tag_end(page, start + 1)
        if end < 0:
            break
        at = end + 1
        if not name:
            continue
        tag = name[0].lower()
        if closing:
            if tag == "p" and not any(o.tag == "p" for o in stack):
                flush()
            if not any(o.tag == tag for o in stack):
                if tag not in INLINE:
                    flush()
                continue
            inline = tag in INLINE
            if not inline:
                flush()
            elif any(not o.inline for o in stack[_last(stack, tag) :]):
                continue
            while stack:
                gone = stack.pop()
                depth_a -= gone.tag == "a"
                if gone.tag == tag:
                    break
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            closes = ENDS.get(tag, frozenset()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in closes and (stack[i].tag != "p" or tag not in VOID or tag == "hr"):
                    for gone in stack[i:]:
                        depth_a -= gone.tag == "a"
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        top = stack[-1] if stack else base
        if tag in VOID:
            continue
        attributes = _attributes(page[name.end() : end])
        chrome = _is_chrome(tag, attributes, top.article > 0)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            rest = close.start() if close else len(page)
            over = page.find(">", rest)
            at = over + 1 if close and over >= 0 else len(page)
            continue
        if page[end - 1] == "/" and tag not in INLINE and tag in ("path", "rect", "circle", "use"):
            continue
        article, side, form = top.article, top.side, top.form
        if tag in ARTICLE_TAGS and not article and not top.chrome:
            articles += 1
            article, side, form = articles, "", False
        elif tag == "form":
            chrome, form = chrome or article > 0, True
        path = top.path
        if not inline:
            label = " ".join(sorted(attributes.get("class", "").lower().split())) if "class" in attributes else ""
            path = f"{path}/{tag}{'.' + DIGITS.sub('0', label) if label else ''}"
        if not side and not inline and _is_side(tag, attributes):
            side = f"{'comments' if _is_comments(attributes) else 'side'}#{len(found)}.{len(stack)}"  # this element, not others of its path
        stack.append(_Open(tag, path, chrome or top.chrome, article, inline, side, form))
        depth_a += tag == "a"
    flush()
    return found


def _last(stack: list[_Open], tag: str) -> int:
    return next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag)
