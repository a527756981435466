"""Pages as token streams with the elements that are open at each text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")  # each with its value, so no value is taken for a name
# Elements by their roles in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SIBLINGS |= {t: {"tr", "td", "th", "thead", "tbody", "tfoot"} for t in ("thead", "tbody", "tfoot")}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
P_SCOPE = frozenset("button caption html object table td template th".split())
DEEPEST = 200  # elements below this depth count as part of the one at it; their text stays


def signature(tag: str, attributes: str) -> str:
    """Tag and classes; digits do not matter, and names that look made up count as one."""
    if not attributes or not attributes.strip():
        return tag
    names, flags = set(), ""
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("class", "id"):
            for name in value.split():
                plain = re.sub(r"\d+", "", name)
                names.add("#" if len(name) - len(plain) > 3 or not plain.strip("-_") else re.sub(r"[./+]", "-", plain))
        elif kind == "role" and value:
            names.add(f"role-{re.sub(r'[^a-z]', '', value)}")
        elif kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            flags = "!"
    return tag + "".join(f".{n}" for n in sorted(names)) + flags


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, data): `open`, `close` or `text`. What stands inside raw
    elements is their text, not markup."""
    at, raw = 0, None
    while at < len(page):
        if raw:
            end = re.compile(rf"</{raw}\b[^>]*>", re.I).search(page, at)
            if page[at : end.start() if end else None].strip():
                yield "text", "", page[at : end.start() if end else None]
            yield "close", raw, ""
            at, raw = end.end() if end else len(page), None
            continue
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else None]
        if text.strip():
            yield "text", "", html.unescape(text)
        elif text:
            yield "text", "", " "
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if name:
            if m[1] or m[4]:
                yield "close", name, ""
            else:
                yield "open", name, m[3] or m[6] or ""
                if name in RAW and not (m[0].endswith("/>") and name == "iframe"):
                    raw = name


class Page:
    """The elements and texts of a page in order.

    A path is the signatures of all open elements. End tags that were left out
    are put in where HTML demands them; stray ones are skipped.
    """

    def __init__(self, page: str):
        #: (path, text, the number of block borders before it)
        self.texts: list[tuple[str, str, int]] = []
        #: for every element that is opened: its path, and the signatures of its children in order
        self.elements: list[tuple[str, list[str]]] = [("", [])]
        stack: list[tuple[str, str, list[str]]] = [("", "", self.elements[0][1])]  # tag, path, children
        border = 0
        for kind, name, data in tokens(page):
            path, children = stack[-1][1:]
            if kind == "text":
                if data.strip():
                    children.append("#text")
                self.texts.append((path, data, border))
                continue
            if name not in INLINE:
                border += 1
            elif name == "br":
                self.texts.append((path, " ", border))
            if kind == "close":
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                del stack[at or len(stack) :]
                continue
            if name in SIBLINGS or name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if (name in CLOSES_P and stack[i][0] == "p") or stack[i][0] in SIBLINGS.get(name, ()):
                        del stack[i:]
                    elif stack[i][0] in SCOPES.get(name, P_SCOPE if name in CLOSES_P else {"table"}):
                        break
                path, children = stack[-1][1:]
            sign = signature(name, data)
            if len(stack) > DEEPEST:
                if name not in VOID:
                    stack.append((name, path, children))
                continue
            children.append(sign)
            if name not in VOID:
                below = f"{path}/{sign}" if path else sign
                self.elements.append((below, []))
                stack.append((name, below, self.elements[-1][1]))

    def blocks(self, wanted) -> list[str]:
        """The wanted texts; white space inside a block becomes one space."""
        blocks: list[list[str]] = []
        last = None
        for path, text, border in self.texts:
            if path in wanted:
                if border != last:
                    blocks.append([])
                    last = border
                blocks[-1].append(text)
        joined = (" ".join("".join(b).split()) for b in blocks)
        return [b for b in joined if b]
