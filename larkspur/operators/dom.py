"""A small document tree and the CSS selectors that extraction needs, on the standard library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "svg"))


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "order")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: int):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """Nodes below this one in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self, hidden: bool = True) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                yield item
            elif hidden or item.tag not in HIDDEN:
                todo += reversed(item.children)

    def text(self, between: str = "") -> str:
        """Text below, each piece stripped and empty ones dropped."""
        return between.join(filter(None, map(str.strip, self.strings())))

    def raw(self) -> str:
        return "".join(self.strings())

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0)
        self.made = 0

    def handle_starttag(self, tag, attrs):
        self.made += 1
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, self.made)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_PART = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|:not\(\.(?P<not>[\w-]+)\)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)["']?(?P<val>[^"'\]]*)["']?)?\]""")


@lru_cache(1024)
def _compiled(selector: str) -> tuple:
    """Alternatives, each a list of (whether a direct child, conditions) from left to right."""
    out = []
    for one in selector.split(","):
        steps, direct = [], False
        for word in one.replace(">", " > ").split():
            if word == ">":
                direct = True
                continue
            steps.append((direct, tuple((m.lastgroup if m.lastgroup in ("tag", "id", "cls", "not") else "attr", m["tag"] or m["id"] or m["cls"] or m["not"] or m["attr"], m["op"], m["val"]) for m in _PART.finditer(word))))
            direct = False
        out.append(steps)
    return tuple(out)


def _fits(node: Node, conditions: tuple) -> bool:
    for kind, name, op, value in conditions:
        if kind == "tag":
            ok = node.tag == name
        elif kind == "id":
            ok = node.attrs.get("id") == name
        elif kind == "cls":
            ok = name in node.classes
        elif kind == "not":
            ok = name not in node.classes
        elif op is None:
            ok = name in node.attrs
        else:
            has = node.attrs.get(name)
            ok = has is not None and (has == value if op == "=" else value in has)
        if not ok:
            return False
    return True


def _matches(node: Node, steps: list, top: Node) -> bool:
    if not _fits(node, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    for up in node.ancestors():
        if _matches(up, steps[:-1], top):
            return True
        if steps[-1][0]:
            return False
    return False


def select(top: Node, selector: str) -> list[Node]:
    """Nodes below ``top`` that fit one of the selector's alternatives, in document order."""
    alternatives = _compiled(selector)
    return [n for n in top.walk() if any(_matches(n, steps, top) for steps in alternatives)]


def first(top: Node, selector: str) -> Node | None:
    alternatives = _compiled(selector)
    return next((n for n in top.walk() if any(_matches(n, steps, top) for steps in alternatives)), None)


def visible_text(top: Node) -> str:
    return "\n".join(filter(None, map(str.strip, top.strings(hidden=False))))
