"""Inference of union-free wrappers for the pages of a site.

A wrapper gives each element the regular expression of its children: a sequence
of zones, a zone being one or several kinds of children, each optional or not,
the zone repeated or not. There is no union: where two streams differ, the
mismatch makes a kind optional or joins kinds that come in turns into one
repeated zone. Texts that differ between pages are slots.

Zones of an element are kept as lists of [{signature: optional}, repeated].
"""

from __future__ import annotations

from collections.abc import Iterable

from spindle.llm.markup import Page

Zones = list
BANNED_TAGS = frozenset(
    "aside button canvas datalist dialog fieldset footer form head header iframe input label legend menu nav noscript object option script select style svg template textarea title".split()
)
# Words of class names for what is no article.
BANNED_WORDS = frozenset(
    """ad ads advert advertisement advertorial adbox banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright
    disclaimer discussion disqus donate footer footnav form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay
    pager pagination paywall popup popular promo promotion recommended related reply replies respond responses search share sharing sidebar signup
    skip social sponsor sponsored subscribe subscription tagcloud tags teaser toolbar topbar trending widget widgets""".split()
)
ARTICLE_TAGS = frozenset(["article", "main"])
ARTICLE_WORDS = frozenset(["article", "articlebody", "role-main", "role-article"])


def folded(children: list[str]) -> Zones:
    """The zones of one stream of children: whatever stands between two of a
    kind belongs to one repeated zone with them."""
    last = {sign: i for i, sign in enumerate(children)}
    zones: Zones = []
    at = 0
    while at < len(children):
        end, i = last[children[at]], at
        while i < end:
            i += 1
            end = max(end, last[children[i]])
        inside = children[at : end + 1]
        kinds = dict.fromkeys(inside, False)
        repeated = len(inside) > len(kinds)
        zones.append([{k: len(kinds) > 1 and repeated for k in kinds}, repeated])
        at = end + 1
    return zones


def joined(zones: Iterable) -> list:
    """Several zones as one repeated zone of optional kinds."""
    zones = list(zones)
    kinds: dict[str, bool] = {}
    for z in zones:
        for k, optional in z[0].items():
            kinds[k] = kinds.get(k, False) or optional
    return [kinds, any(z[1] for z in zones)]


def aligned(a: Zones, b: Zones) -> Zones:
    """One sequence of zones that fits both.

    Zones that share a kind are aligned. Where alignments cross, or something
    stands between two zones that must be one, all of it becomes one repeated
    zone. What only one side has becomes optional.
    """
    place = {k: j for j, z in enumerate(b) for k in z[0]}
    spans: list[list[int]] = []  # [first, last + 1 of a, first, last + 1 of b]
    for i, z in enumerate(a):
        js = [place[k] for k in z[0] if k in place]
        if js:
            spans.append([i, i + 1, min(js), max(js) + 1])
    merged: list[list[int]] = []
    for span in spans:
        while merged and merged[-1][3] > span[2]:
            before = merged.pop()
            span = [before[0], span[1], min(before[2], span[2]), max(before[3], span[3])]
        merged.append(span)
    out: Zones = []
    i = j = 0
    optional = lambda z: [dict.fromkeys(z[0], True), z[1]]
    for i0, i1, j0, j1 in [*merged, [len(a), len(a), len(b), len(b)]]:
        out += [optional(z) for z in a[i:i0]] + [optional(z) for z in b[j:j0]]
        if i1 > i0:
            one, other = joined(a[i0:i1]), joined(b[j0:j1])
            zone = joined([one, other])
            for k in zone[0]:
                zone[0][k] = zone[0][k] or k not in one[0] or k not in other[0]
            if i1 - i0 > 1 or j1 - j0 > 1:
                zone = [dict.fromkeys(zone[0], True), True]
            out.append(zone)
        i, j = i1, j1
    return out


def wrapper_of(page: Page) -> dict[str, Zones]:
    """The wrapper of one page: elements of one path share their expression."""
    out: dict[str, Zones] = {}
    for path, children in page.elements:
        zones = folded(children)
        out[path] = aligned(out[path], zones) if path in out else zones
    return out


def merged(a: dict[str, Zones], b: dict[str, Zones]) -> dict[str, Zones]:
    """The wrapper of both sets of pages."""
    return {p: aligned(a[p], b[p]) if p in a and p in b else a.get(p) or b.get(p) or [] for p in sorted(a.keys() | b.keys())}


def expression(wrapper: dict[str, Zones], path: str = "") -> str:
    """A wrapper as a regular expression over tags and text slots."""
    parts = []
    for kinds, repeated in wrapper.get(path, []):
        inner = []
        for k, optional in kinds.items():
            below = f"{path}/{k}" if path else k
            body = "#text" if k == "#text" else f"<{k}>{expression(wrapper, below)}</{k}>"
            inner.append(f"({body})?" if optional and len(kinds) > 1 else body)
        alone = len(kinds) == 1 and next(iter(kinds.values()))
        zone = "".join(inner)
        parts.append(f"({zone}){'*' if repeated and alone else '+' if repeated else '?'}" if repeated or alone else zone)
    return "".join(parts)


def _words(sign: str) -> list[str]:
    return [w for name in sign.rstrip("!").split(".")[1:] for w in (name, *name.replace("_", "-").split("-"))]


def _tag(sign: str) -> str:
    return sign.split(".")[0].rstrip("!")


def around(path: str) -> int | None:
    """The number of elements with words for what is no article around the
    article of a path, None where the path is banned. Such words say nothing
    about a whole page, nor about the article that has them itself."""
    signs = path.split("/")
    tags = list(map(_tag, signs))
    article = next((tags.index(t) for t in ("article", "main") if t in tags), -1)
    found = 0
    for i, (sign, tag) in enumerate(zip(signs, tags, strict=True)):
        if sign.endswith("!") or tag in BANNED_TAGS:
            return None
        if i == article or tag in ("html", "body", "main") or BANNED_WORDS.isdisjoint(_words(sign)):
            continue
        if i > article:
            return None
        found += 1
    return found


def named(path: str) -> bool:
    """Whether a path is in an article element without words for what is none."""
    article = next((s for s in path.split("/") if _tag(s) == "article"), None)
    return article is not None and BANNED_WORDS.isdisjoint(_words(article))


def wanted(article: dict[str, list], texts: list[tuple[str, str, int]]) -> frozenset[str]:
    """The paths of the article of a page with these texts: those with as few
    banned elements around as its article elements have."""
    here = [article[p] for p in {p for p, t, _ in texts if t.strip()} if p in article]
    most = min([n for n, sure in here if sure] or [n for n, _ in here], default=-1)
    return frozenset(p for p in {p for p, _, _ in texts} if p in article and article[p][0] <= most)


def in_article(path: str) -> bool:
    return any(_tag(s) in ARTICLE_TAGS or not ARTICLE_WORDS.isdisjoint(_words(s)) for s in path.split("/"))


def main_slots(wrapper: dict[str, Zones], slots: dict[str, tuple[int, int, int, bool]]) -> tuple[dict[str, list], list[str]]:
    """The paths of elements whose own text belongs to the article: those inside
    article elements, as `wanted` takes them, and those to use on pages that have none.

    `slots` gives, by the element's path, pages, characters, characters in links, and whether nearly
    all different pages have it with one text. Without an article element it is the deepest element that
    holds most of the free text; texts that are the same on all pages of a site
    belong to its frame.
    """
    depths = {p: around(p) for p in slots if p in wrapper}
    article = {p: [n, named(p)] for p, n in sorted(depths.items()) if n is not None and in_article(p)}
    free = {p: s for p, s in slots.items() if depths.get(p) == 0}
    varying = {p: s for p, s in free.items() if not s[3]} or free
    mass: dict[str, list[int]] = {}
    for p, (_, chars, links, _) in varying.items():
        parts = p.split("/")
        for i in range(len(parts) + 1):
            m = mass.setdefault("/".join(parts[:i]), [0, 0])
            m[0] += chars - links
            m[1] += links
    at = ""
    while True:
        below = [f"{at}/{k}" if at else k for kinds, _ in wrapper.get(at, []) for k in kinds if k != "#text"]
        best = max(below, key=lambda p: (mass.get(p, [0])[0], p), default=None)
        if best is None or mass.get(best, [0])[0] * 10 < mass.get(at, [0])[0] * 6 or best.split("/")[-1].split(".")[0] in ("p", "li"):
            break
        at = best
    inside = [p for p in varying if p == at or p.startswith(f"{at}/") or not at]
    linked = lambda p: mass[p][1] > mass[p][0] and p != at
    menus = {p for p in mass if p.startswith(at) and p != at and p.split("/")[-1].split(".")[0] in ("ul", "ol", "div", "section", "table") and linked(p)}
    other = sorted(p for p in inside if not any(p == m or p.startswith(f"{m}/") for m in menus))
    return article, other
