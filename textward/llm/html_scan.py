"""A page as its sequence of tag tokens and the text blocks between them, in one linear pass.

A token is a tag (with its class and id words) under the containers around it. Containers carry a number that is a hash
of the parent's number, their own label and how many alike stand before them in the parent, so a token costs the same at
any depth and no container of a page shares its number with another. An unclosed tag, comment or raw element takes the
rest of the page; a quote counts only after an equals sign.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash

PLAIN, MADE, ROLE, HEADING = 0, 1, 2, 3

_SPACE = re.compile(r"\s+")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r""">|=\s*["']""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_words = lambda s: frozenset(s.split())
# Elements by kind, and the class or id words of what is no article.
CONTAINERS = _words("html head body header footer nav main article section aside div form ul ol dl table figure dialog details template noscript iframe svg object button select textarea fieldset menu")
INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr")
RAW = _words("script style title textarea xmp noembed noframes")
DROPPED = _words("head nav footer aside form script style title noscript iframe svg object button select textarea template dialog menu fieldset xmp noembed noframes")
ROLES = _words(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar"
)
#: Words that may stand beside a role word; with any other word beside it (social-context) a name is no role.
BESIDE = _words(
    "alert area bar block bottom box buttons container global google head inner item items left links list main menu outer page panel policy posts primary right row secondary section "
    "site slot thread top unit user users widget wrap wrapper"
)
MAIN = ("article", "main")


def _digest(data: str) -> int:
    return xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass")) - (1 << 63)


def is_role(name: str) -> bool:
    """Whether a class or id names a part that is no article: role words, alone or beside words of place."""
    parts = _PART.findall(name.lower())
    return any(p in ROLES for p in parts) and all(p in ROLES or p in BESIDE for p in parts)


@dataclass
class Page:
    #: token numbers of all tags in page order
    tags: list[int] = field(default_factory=list)
    #: text blocks: how many tags stand before, text, characters inside links, kind, number of text and place
    at: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    token: list[int] = field(default_factory=list)
    #: which box a block is in, -1 outside of all
    inside: list[int] = field(default_factory=list)
    #: boxes, the containers that may hold an article: those without a role, down to the first made for one; where among
    #: the tags each opens, and the box around it
    boxes: list[int] = field(default_factory=list)
    up: list[int] = field(default_factory=list)


class Scanner:
    """Scans pages; remembers the numbers of labels, up to a bound."""

    def __init__(self, remembered: int = 200_000):
        self.remembered = remembered
        self.numbers: dict[tuple[int, str], int] = {}
        self.labels: dict[tuple[str, str], tuple[str, bool, bool]] = {}

    def number(self, parent: int, label: str) -> int:
        key = (parent, label)
        found = self.numbers.get(key)
        if found is None:
            if len(self.numbers) >= self.remembered:
                self.numbers.clear()
            found = self.numbers[key] = _digest(f"{parent}>{label}")
        return found

    def label(self, tag: str, attributes: str) -> tuple[str, bool, bool]:
        """The label of a tag, whether its name says that it is no article, and whether it is made for one."""
        if not attributes.strip():
            return tag, tag in DROPPED or tag == "header", tag in MAIN
        key = (tag, attributes)
        found = self.labels.get(key)
        if found is None:
            if len(self.labels) >= self.remembered:
                self.labels.clear()
            values = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attributes)}
            names = f"{values.get('class', '')} {values.get('id', '')}".split()
            label = tag + "".join(f".{w}" for w in sorted(set(_PART.findall(" ".join(names).lower()))))
            role = values.get("role", "").lower()
            dropped = tag in DROPPED or tag == "header" or any(map(is_role, names)) or is_role(role)
            found = self.labels[key] = (label, dropped, tag in MAIN or role in MAIN)
        return found

    def scan(self, page: str) -> Page:
        out = Page()
        tags = out.tags
        # open containers: tag, number, kind, box, how many of each label they hold
        stack: list[tuple[str, int, int, int, dict[str, int]]] = [("", 0, PLAIN, -1, {})]
        opened: Counter[str] = Counter()
        parts: list[str] = []
        links, in_link, heading, at, size = 0, False, False, 0, len(page)

        def flush():
            nonlocal links
            joined = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if joined:
                _, number, kind, box, _ = stack[-1]
                out.at.append(len(tags))
                out.text.append(joined)
                out.links.append(min(links, len(joined)))
                out.kind.append(HEADING if heading and kind == PLAIN else kind)
                out.inside.append(box)
                out.token.append(self.number(number, f"text {joined}") if kind == PLAIN else 0)
            parts.clear()
            links = 0

        while at < size:
            start = page.find("<", at)
            if start < 0 or start + 1 >= size:
                start = size if start < 0 else start
            if start > at:
                parts.append(page[at:start])
                links += start - at if in_link else 0
            if start >= size:
                break
            after = page[start + 1 : start + 2]
            if after in ("!", "?") or after == "/" and not page[start + 2 : start + 3].isalpha():
                mark = "-->" if page.startswith("<!--", start) else ">"
                end = page.find(mark, start + 2)
                at = size if end < 0 else end + len(mark)
                continue
            closing = after == "/"
            name = _TAG_NAME.match(page, start + 1 + closing) if closing or after.isascii() else None
            if not name:
                parts.append("<")
                at = start + 1
                continue
            tag, end = name[0].lower(), name.end()
            while True:
                stop = _STOP.search(page, end)
                if not stop:
                    end = size + 1
                    break
                if stop[0] == ">":
                    end = stop.start()
                    break
                end = page.find(stop[0][-1], stop.end()) + 1
                if end == 0:
                    end = size + 1
                    break
            at = min(end + 1, size)
            if end > size:
                break  # a tag without end is none
            if tag == "a":
                in_link = not closing
            if tag in INLINE:
                continue
            flush()
            heading = tag == "h1" and not closing
            if tag not in CONTAINERS and tag not in RAW:
                tags.append(self.number(stack[-1][1], f"/{tag}" if closing else tag))
                continue
            if closing:
                if opened[tag]:
                    while True:
                        inner, number, *_ = stack.pop()
                        opened[inner] -= 1
                        if inner == tag:
                            break
                    tags.append(self.number(number, "/"))
                continue
            label, dropped, made = self.label(tag, page[name.end() : end])
            _, parent, kind, box, alike = stack[-1]
            alike[label] = alike.get(label, 0) + 1
            number = self.number(parent, label if alike[label] == 1 else f"{label} {alike[label]}")
            tags.append(number)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else size
                closed = page.find(">", at)
                at = size if closed < 0 else closed + 1
                continue
            # the header of an article is part of it; any other part that is dropped stays so, down to its last element
            if tag == "header" and kind == MADE and dropped and not any(map(is_role, label.split(".")[1:])):
                dropped = False
            inner = ROLE if dropped or kind == ROLE else MADE if made else kind
            if kind == PLAIN and inner != ROLE:
                out.boxes.append(len(tags) - 1)
                out.up.append(box)
                box = len(out.boxes) - 1
            stack.append((tag, number, inner, box, {}))
            opened[tag] += 1
        flush()
        return out
