"""A tolerant HTML reader: block elements as a tree, and the text blocks of each in page order.

Inline elements aren't nodes; their text belongs to the block around them. White space inside a block becomes one
space; br and block borders end a block. Scripts, styles, comments, titles and the like have no text; what stands in a
textarea, select, datalist, button or output is an element of its own, a form control. Text ends a head that isn't
closed. Elements keep their true parents at any depth.
"""

from __future__ import annotations

import re
from html import unescape

#: A comment, a tag, a tag whose quotes don't close (it ends with the next >), a declaration, and a tag that the page cuts.
#: Nothing is given back once it is read, so that a page is read once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Names of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark map meter progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg math object noscript template canvas audio video mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot munder mover munderover mstyle mspace mpadded menclose semantics annotation br hr area base col embed link meta param source track".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Form controls; what stands in one is not the text around it. A tag of another kind than those that may stand in it ends it.
CONTROLS = frozenset("select datalist button output".split())
OPTIONS = frozenset("option optgroup".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
P_BORDERS = frozenset(["table", "td", "th", "button"])
#: An element of the key's kind ends an open element of these kinds, inside the nearest of the borders.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set())}


class Page:
    """parent, depth, tag, name (words of class, id and role) of each node, the root first; blocks: (node, text, characters in links)."""

    def __init__(self, html: str):
        self.parent, self.depth, self.tag, self.name, self.blocks = [-1], [0], ["#root"], [""], []
        self._stack, self._text, self._linked, self._link = [0], [], 0, None
        self._open_at: dict[str, list[int]] = {}  # where the stack has the open elements of each kind
        at, end = 0, len(html)
        head = control = None  # the open head, and the open control's name and text
        inside: list[str] = []
        while at < end:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                raw = html[at:stop]
                if control is not None:
                    inside.append(raw)
                elif head is None or raw.strip():
                    head = None
                    self._add(raw)
            if not m:
                break
            at, tag, attributes = m.end(), m.group(2) or m.group(5), m.group(3) or m.group(6) or ""
            if not tag:
                continue
            tag, closing = tag.lower(), (m.group(1) or m.group(4)) == "/"
            if control is not None:
                if not (closing and tag == control) and (tag in OPTIONS or tag in INLINE):
                    inside.append(" ")
                    continue
                self._control(" ".join(inside))
                ended, control, inside = control, None, []
                if closing and tag == ended:
                    continue
            if head is not None:  # nothing in the head is text
                if (closing and tag == "head") or (not closing and tag in CLOSES_P) or tag == "body":
                    head = None
                elif tag not in RAW or closing:
                    continue
            if tag in RAW and not closing:
                if not attributes.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    if tag == "textarea":
                        self._end_block()
                        self._control(html[at : close.start() if close else end])
                    at = close.end() if close else end
                continue
            if tag in CONTROLS and not closing:
                if not attributes.endswith("/"):
                    control = tag
            elif tag == "head":
                head = None if closing else tag
            elif tag in INLINE:
                if tag == "a":
                    self._link = None if closing else len(self._stack)
                elif tag in ("br", "hr"):
                    self._end_block()
            elif closing:
                self._close(tag)
            else:
                self._open(tag, attributes)
        if control is not None:
            self._control(" ".join(inside))
        self._end_block()

    def _add(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._link is not None:
            self._linked += len(text.strip())

    def _end_block(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _control(self, raw: str) -> None:
        """Text that stands in a form control; the block around goes on."""
        self._node("form", "form")
        if text := " ".join(unescape(raw).split()):
            self.blocks.append((len(self.tag) - 1, text, 0))

    def _node(self, tag: str, name: str) -> None:
        self.parent.append(self._stack[-1])
        self.depth.append(self.depth[self._stack[-1]] + 1)
        self.tag.append(tag)
        self.name.append(name)

    def _open(self, tag: str, attributes: str) -> None:
        self._end_block()
        if tag in CLOSES_P:
            self._close("p", P_BORDERS)
        if tag in ENDS:
            kinds, borders = ENDS[tag]
            for kind in kinds:
                self._close(kind, borders)
        self._node(tag, " ".join(a or b or c for a, b, c in _CLASS.findall(attributes)) if attributes else "")
        if tag not in VOID and not attributes.endswith("/"):
            self._open_at.setdefault(tag, []).append(len(self._stack))
            self._stack.append(len(self.tag) - 1)

    def _close(self, tag: str, borders=frozenset()) -> None:
        """Ends the innermost open element of this kind and all in it, unless a border stands between."""
        self._end_block()
        at = self._open_at.get(tag)
        if not at or any(b != tag and self._open_at.get(b, [0])[-1:] > at[-1:] for b in borders):
            return
        to = at[-1]
        for node in self._stack[to:]:
            self._open_at[self.tag[node]].pop()
        del self._stack[to:]
        if self._link is not None and self._link > to:
            self._link = None
