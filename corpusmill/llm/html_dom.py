"""A small tolerant HTML reader: block elements as a tree, and the text that stands directly in each."""

from __future__ import annotations

import html
import re

#: A quote opens a value only right after "="; one that is never closed is part of an unquoted value.
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
_PAIR = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_PAIR})*+)(?:>|\Z)", re.S)
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+", re.S)
#: The attributes that are looked at.
_KNOWN = frozenset("class id role itemprop style hidden aria-hidden href".split())
#: Elements whose content is no text of the page, or not shown where their markup is.
RAW = frozenset("script style noscript template iframe textarea select option canvas audio video head title annotation annotation-xml desc metadata defs".split())
#: Of these, the ones whose content is not parsed as markup.
_UNPARSED = frozenset("script style textarea title iframe noscript".split())
_RUNNING = frozenset("p li td th dd dt blockquote figcaption h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary dialog center hgroup search menu".split())
_CLOSES_P = BLOCK - {"html", "body", "caption", "td", "th", "tr", "thead", "tbody", "tfoot"}
#: A new element ends an open one of these kinds, up to the given container.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "runs", "links", "depth", "index", "hidden")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children, self.runs, self.links = [], [], 0
        self.depth = parent.depth + 1 if parent else 0
        self.index, self.hidden = 0, False


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        name, value = m[1].lower(), m[2] or ""
        if name in _KNOWN and name not in found:
            quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
            found[name] = html.unescape(value[1:-1] if quoted else value)
    return found


def parse(source: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The root, and the page's blocks in order: (element that the text stands in, its text), white space
    made single. A run of text ends where a block element begins or ends; <br> is white space."""
    root = Node("#root", {}, None)
    stack, blocks, buffer = [root], [], []
    skip: list[str] = []
    link = 0

    def flush():
        if buffer:
            text = " ".join(html.unescape("".join(x for x, _ in buffer)).split())
            if text:
                node = stack[-1]
                node.runs.append(len(blocks))
                node.links += sum(len(x) for x, linked in buffer if linked)
                blocks.append((node, text))
            buffer.clear()

    def close(down_to: int):
        nonlocal link
        flush()
        link = 0
        del stack[down_to:]

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            if not skip:
                buffer.append((source[at:], link))
            break
        if m.start() > at and not skip:
            buffer.append((source[at : m.start()], link))
        at = max(m.end(), m.start() + 1)
        name = m[2].lower() if m[2] else None
        if name is None:
            continue
        if m[1]:  # an end tag
            if skip:
                if name in skip:
                    del skip[skip.index(name) :]
            elif name == "a":
                link = 0
            elif name in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        close(k)
                        break
                else:
                    flush()
            continue
        # A button within running text is part of it; elsewhere it belongs to a form.
        if name in RAW or (name == "button" and not any(n.tag in _RUNNING for n in stack)):
            if name in _UNPARSED:
                stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else end
            elif not m[3].endswith("/"):
                skip.append(name)
            if not skip:
                buffer.append((" ", link))
            continue
        if skip:
            if name == "body" and skip == ["head"]:
                skip.clear()
            else:
                continue
        if name in ("br", "hr") or name in VOID:
            buffer.append((" ", link))
        elif name == "a":
            link = 1
        elif name in BLOCK:
            flush()
            if name in ("html", "body") and any(n.tag == name for n in stack):
                continue
            if name in _CLOSES_P and any(n.tag == "p" for n in stack):
                k = max(k for k, n in enumerate(stack) if n.tag == "p")
                if not any(n.tag in ("td", "th", "table", "li") for n in stack[k:]):
                    close(k)
            if name in _ENDS:
                ends, within = _ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in within:
                        break
                    if stack[k].tag in ends:
                        close(k)
                        break
            link = 0
            node = Node(name, _attributes(m[3]), stack[-1])
            node.index = len(stack[-1].children)
            hide = node.attrs.get("style", "").replace(" ", "").lower()
            node.hidden = stack[-1].hidden or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in hide or "visibility:hidden" in hide
            stack[-1].children.append(node)
            if not m[3].endswith("/"):
                stack.append(node)
    flush()
    return root, blocks
