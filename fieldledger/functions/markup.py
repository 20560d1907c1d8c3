"""A page read once, tag by tag, with the stack of open elements; no column expressions here."""
from __future__ import annotations

import html as entities
import re

# Fixed values of the markup language: elements without content, and those whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset(("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                            "header hr main nav ol p pre section table ul").split())
DEEPEST = 512                  # elements further down have no content of their own

# Comments, scripts and styles whole, then tags; a tag that never ends takes the rest of the page.
WHOLE = r"<!--.*?(?:-->|\Z)|<script\b[^>]*>.*?(?:</script\s*>|\Z)|<style\b[^>]*>.*?(?:</style\s*>|\Z)"
TOKEN = re.compile(rf"""({WHOLE}|</?[a-z][^\s/>]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-z].*)""", re.I | re.S)
TAG = re.compile(rf"""{WHOLE}|<(/?)([a-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.I | re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLANKS = re.compile("[ \t\n\x0b\f\r\xa0]{2,}|[\t\n\x0b\f\r\xa0]")    # all but a blank by itself
KNOWN, LONGEST = 10_000, 500   # tags that a reader remembers, and how long they may be


def clean(pieces: list[str], between: str = "") -> str:
    text = between.join(pieces)
    return BLANKS.sub(" ", entities.unescape(text) if "&" in text else text).strip(" ")


def attributes(source: str) -> tuple[tuple[str, ...], str | None]:
    """The classes and the href of a start tag; the first of each counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return tuple(found.get("class", "").split()), found.get("href")


class Reader:
    """Reads pages for the elements of some tags ('p') and classes ('.user').

    Boxes are only placed; leaves also have text (tags dropped, entities decoded, blanks collapsed) and inner markup.
    An element ends at its end tag, where an element around it ends, or, for a paragraph, where a block starts.
    Scripts, styles and comments are neither elements nor text; end tags that close nothing are ignored.
    """

    def __init__(self, boxes: list[str], leaves: list[str]):
        self.kinds = dict.fromkeys(boxes, 1) | dict.fromkeys(leaves, 2)
        self.by_class = any(k.startswith(".") for k in self.kinds)
        self.known: dict[str, tuple | None] = {}                  # pages repeat their tags

    def _tag(self, token: str) -> tuple | None:
        """Of a tag: whether it ends an element, its name, whether it ends a paragraph, has content, and is wanted (1 box,
        2 leaf), classes and href. None for what is no tag."""
        m = TAG.match(token)
        found = None
        if m and m[2] is not None:
            name, classes, href = m[2].lower(), (), None
            kind = self.kinds.get(name, 0)
            if m[3] and not m[1] and (kind or self.by_class):
                classes, href = attributes(m[3])
                kind = max([kind, *(self.kinds.get(f".{c}", 0) for c in classes)])
            found = bool(m[1]), name, name in ENDS_PARAGRAPH, name not in VOID, kind, classes, href
        if len(token) <= LONGEST:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[token] = found
        return found

    def read(self, page: str) -> tuple[list[list], list[str]]:
        """Elements in order of their start, as [tag, classes, depth, number, last number within, href, text, inner],
        and the pieces of text between tags."""
        nodes: list[list] = []
        stack: list[tuple[str, int, int, int]] = []              # name, element or -1, pieces before, start of content
        opened: dict[str, int] = {}
        pieces: list[str] = []
        known, end = self.known, 0

        def close(upto: int) -> str:
            name, k, first, start = stack.pop()
            opened[name] -= 1
            if k >= 0:
                nodes[k][4] = len(nodes) - 1
                if nodes[k][6] is not None:
                    nodes[k][6:] = clean(pieces[first:]), page[start:upto]
            return name

        parts = TOKEN.split(page)
        for text, token in zip(parts[::2], parts[1::2]):
            if text:
                pieces.append(text)
            start = end + len(text)
            end = start + len(token)
            tag = known[token] if token in known else self._tag(token)
            if tag is None:
                continue
            slash, name, ends_paragraph, content, kind, classes, href = tag
            if slash:
                if opened.get(name):
                    if stack[-1][0] == name and stack[-1][1] < 0:       # most often the innermost, and not wanted
                        stack.pop()
                        opened[name] -= 1
                        continue
                    while close(start) != name:
                        pass
                continue
            if ends_paragraph and opened.get("p"):
                while close(start) != "p":
                    pass
            k = -1
            if kind:
                k = len(nodes)
                text = "" if kind == 2 else None
                nodes.append([name, classes, len(stack), k, k, href, text, text])
            if content and len(stack) < DEEPEST:
                stack.append((name, k, len(pieces), end))
                opened[name] = opened.get(name, 0) + 1
        if parts[-1]:
            pieces.append(parts[-1])
        while stack:
            close(len(page))
        return nodes, pieces
