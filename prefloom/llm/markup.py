"""A tolerant reader of HTML that yields a tree of blocks: what stands between them is inline text."""

import re
from html import unescape

# Element names by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
REPLACED = frozenset("audio button canvas datalist embed head iframe img input link meta noembed noframes noscript object "
                     "script select style svg template textarea title video xmp math".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
# An element ends open ones of these names, up to the nearest of those that hold it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
# Elements, and words in classes, ids and roles, that mark what is not the article.
ASIDE = frozenset("aside dialog footer form menu nav".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies copyright dialog disqus footer form gdpr legal login masthead menu modal nav navbar navigation "
    "newsletter notice overlay pager pagination popup promo promoted promotion recommended related replies respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
NEGATED = ("has-", "no-", "with-", "without-", "is-", "has_", "no_")
CONTENT = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|</?[A-Za-z](?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>|</?[A-Za-z][^>]*>|<[!?/][^>]*(?:>|\Z)|</?[A-Za-z][^>]*\Z|[^<]+|<",
    re.S,
)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Block:
    """A block element: its name, whether it is marked as not the article, and its items in order:
    texts as [text, characters inside links] or blocks."""

    __slots__ = ("tag", "aside", "items", "flows")

    def __init__(self, tag, aside=False, flows=False):
        self.tag, self.aside, self.items, self.flows = tag, aside, [], flows

    def blocks(self):
        return [item for item in self.items if isinstance(item, Block)]


def _marked(tag, text, inside):
    """Whether a tag's name or attributes say that it does not belong to the article."""
    if tag in ASIDE or tag == "header" and not inside:
        return True
    if tag in ("html", "body") or tag in CONTENT or len(text) <= len(tag) + 2:
        return False
    for found in _ATTRIBUTE.finditer(text, len(tag) + 1):
        name, value = found[1].lower(), next((x for x in found.groups()[1:] if x is not None), "").lower()
        if name in ("class", "id", "role"):
            for word in value.split():
                if not word.startswith(NEGATED) and ASIDE_WORDS.intersection(re.split("[-_:]", word)):
                    return True
                if word in ("header", "site-header", "page-header") and not inside:
                    return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        elif name == "aria-hidden" and value == "true":
            return True
    return re.search(r"\shidden[\s/>=]", text) is not None


def read(html):
    """The block tree of a page; markup that is broken in any way still gives one."""
    root = Block("body")
    stack, text, linked, links, raw = [root], [], 0, 0, None
    position, size = 0, len(html)

    def flush():
        nonlocal text, linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                stack[-1].items.append([joined, linked])
        text, linked = [], 0

    def close(at):
        nonlocal links
        del stack[at:]
        links = 0

    while position < size:
        token = _TOKEN.match(html, position)
        value, position = token[0], token.end()
        if value[0] != "<" or len(value) == 1:
            text.append(value)
            linked += len(value) if links else 0
            continue
        name = _NAME.match(value)
        if name is None:
            continue
        tag = name[1].lower()
        if value[1] == "/":
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE and not any(block.flows and block.tag == tag for block in stack[1:]):
                continue
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), None)
            if at is not None:
                flush()
                close(at)
            elif tag not in INLINE and tag not in RAW and tag not in VOID:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, position)
            position = end.start() if end else size
            continue
        if tag in VOID:
            if tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        inside = any(block.tag in CONTENT for block in stack)
        if tag in INLINE:
            links += tag == "a"
            if not value.endswith("/>") and _marked(tag, value, inside):
                flush()
                stack.append(Block(tag, True, True))
                stack[-2].items.append(stack[-1])
            continue
        flush()
        if tag in ("html", "body"):
            continue
        if tag in ENDS_PARAGRAPH:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), None)
            if at is not None and not any(b.tag in ("table", "button", "object") for b in stack[at:]):
                close(at)
        ended, holders = ENDS.get(tag, ((), ()))
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in holders:
                break
            if stack[at].tag in ended:
                close(at)
        block = Block(tag, tag in REPLACED or _marked(tag, value, inside))
        stack[-1].items.append(block)
        if not value.endswith("/>"):
            stack.append(block)
    flush()
    return root
