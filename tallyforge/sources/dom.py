"""Elements of a page and the selectors that find them.

A selector is compiled once to a chain of compound tests with child and descendant combinators and is matched from its
last compound to the left, so that an element is tested by itself before anything around it is looked at.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

#: Elements without an end tag, and those whose text nobody sees.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset(("script", "style", "template", "noscript"))
#: Start tags that end an open element of these kinds, as browsers close them.
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | dict.fromkeys(BLOCKS, ("p",))
BOUNDS = {"li": ("ul", "ol"), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)} | dict.fromkeys(BLOCKS, tuple((BLOCKS - {"p"}) | {"td", "th", "li", "button", "body", "html"}))


class Node:
    """An element: pre numbers elements in document order, last is the greatest number inside it."""

    __slots__ = ("tag", "attributes", "parent", "children", "pre", "last", "_lower", "_text")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None, pre: int):
        self.tag, self.attributes, self.parent, self.pre, self.last = tag, attributes, parent, pre, pre
        self.children: list[Node | str] = []
        self._lower: dict[str, str] = {}
        self._text: str | None = None

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def ancestors(self) -> Iterator[Node]:
        """The elements around it, the nearest first."""
        node = self.parent
        while node is not None and node.parent is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        """The visible text below, white space condensed."""
        if self._text is None:
            out, stack = [], [self]
            while stack:
                node = stack.pop()
                if isinstance(node, str):
                    out.append(node)
                elif node.tag not in UNSEEN:
                    out.append(" ")
                    stack += reversed(node.children)
            self._text = " ".join("".join(out).split())
        return self._text

    def lower(self, name: str) -> str:
        """An attribute in lower case."""
        if name not in self._lower:
            self._lower[name] = self.attributes[name].lower()
        return self._lower[name]

    def attribute(self, names: Sequence[str]) -> str:
        """The first of the attributes that is not blank, white space condensed."""
        return next((" ".join(v.split()) for n in names if (v := self.attributes.get(n, "")).strip()), "")

    def matches(self, selector: str) -> bool:
        return any(_chain(self, chain) for chain in compiled(selector))

    def inside(self, selectors: Sequence[str]) -> bool:
        """Whether the element or one around it matches a selector."""
        every = index(tuple(selectors))
        node: Node | None = self
        while node is not None:
            if any(node.matches(selectors[rank]) for rank in every.ranks(node)):
                return True
            node = node.parent
        return False

    def first(self, selectors: Sequence[str]) -> Node | None:
        """The first element below that matches the earliest selector with any, found in one walk."""
        every, best, found = index(tuple(selectors)), len(selectors), None
        for node in self.walk():
            for rank in every.ranks(node):
                if rank >= best:
                    break
                if node.matches(selectors[rank]):
                    best, found = rank, node
                    break
            if best == 0:
                break
        return found

    def ranked(self, selectors: Sequence[str]) -> list[tuple[int, Node]]:
        """(rank, element) of all elements below that match, by the selector's rank and in document order."""
        every = index(tuple(selectors))
        hits = [(rank, node.pre, node) for node in self.walk() for rank in every.ranks(node) if node.matches(selectors[rank])]
        return [(rank, node) for rank, _, node in sorted(hits, key=lambda h: h[:2])]


class Index:
    """Selectors by what the element itself has to have: one of its attributes, its tag, or nothing."""

    def __init__(self, selectors: tuple[str, ...]):
        self.by: dict[str, list[int]] = {}
        self.any: list[int] = []
        for rank, selector in enumerate(selectors):
            for _, tests in (chain[0] for chain in compiled(selector)):
                needs = next((t.needs for t in tests if t.needs.startswith("@")), next((t.needs for t in tests), ""))
                (self.by.setdefault(needs, []) if needs else self.any).append(rank)

    def ranks(self, node: Node) -> list[int]:
        """The selectors that may match an element, the earlier first."""
        out = list(self.any)
        for name in node.attributes:
            out += self.by.get("@" + name, ())
        out += self.by.get(node.tag, ())
        return sorted(set(out)) if len(out) > 1 else out


@functools.lru_cache(maxsize=256)
def index(selectors: tuple[str, ...]) -> Index:
    return Index(selectors)


class Test:
    """A test of an element, and what the element needs for it: `@` and an attribute, or a tag."""

    __slots__ = ("holds", "needs")

    def __init__(self, holds: Callable[[Node], bool], needs: str):
        self.holds, self.needs = holds, needs


_CHECKS = {"=": str.__eq__, "*": str.__contains__, "^": str.startswith, "$": str.endswith, "~": lambda have, want: want in have.split()}


def _attribute(name: str, kind: str, want: str, any_case: bool) -> Test:
    check = _CHECKS[kind]
    if any_case:
        want = want.lower()
        return Test(lambda node: name in node.attributes and check(node.lower(name), want), "@" + name)
    return Test(lambda node: name in node.attributes and check(node.attributes[name], want), "@" + name)


@functools.lru_cache(maxsize=4096)
def _compound(text: str) -> tuple[Test, ...]:
    """Tests of a compound selector: tag, .class, #id, [name], [name='value'] and *=, ^=, $=, ~= with or without ``i``."""
    tag, rest = re.match(r"([a-zA-Z][\w-]*|\*)?(.*)", text, re.S).groups()
    tests: list[Test] = []
    if tag and tag != "*":
        tests.append(Test(lambda node, tag=tag.lower(): node.tag == tag, tag.lower()))
    at = 0
    for m in re.finditer(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?)=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*(i)?\s*)?\]", rest):
        if m.start() != at:
            raise ValueError(f"no selector: {text}")
        at = m.end()
        word, identity, name, kind, *values, any_case = m.groups()
        if word:
            tests.append(_attribute("class", "~", word, False))
        elif identity:
            tests.append(_attribute("id", "=", identity, False))
        elif kind is None:
            tests.append(Test(lambda node, name=name.lower(): name in node.attributes, "@" + name.lower()))
        else:
            tests.append(_attribute(name.lower(), kind or "=", next((v for v in values if v is not None), ""), bool(any_case)))
    if at != len(rest) or not (tests or tag):
        raise ValueError(f"no selector: {text}")
    return tuple(tests)


@functools.lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple[tuple[tuple[str, tuple[Test, ...]], ...], ...]:
    """The alternatives of a selector, each as (combinator to the left, tests), the last compound first."""
    pieces = re.findall(r"(?:\[[^\]]*\]|[^\s,>\[])+|[>,]", selector)
    if "".join(pieces) != re.sub(r"\s+(?![^\[]*\])", "", selector):
        raise ValueError(f"no selector: {selector}")
    chains, now, combinator = [], [], " "
    for piece in [*pieces, ","]:
        if piece == ",":
            if not now or combinator == ">":
                raise ValueError(f"no selector: {selector}")
            chains.append(tuple(reversed(now)))
            now, combinator = [], " "
        elif piece == ">":
            if not now or combinator == ">":
                raise ValueError(f"no selector: {selector}")
            combinator = ">"
        else:
            now.append((combinator if now else "", _compound(piece)))
            combinator = " "
    return tuple(chains)


def _chain(node: Node, chain: tuple[tuple[str, tuple[Test, ...]], ...]) -> bool:
    combinator, tests = chain[0]
    for test in tests:
        if not test.holds(node):
            return False
    if not combinator:
        return True
    parent = node.parent
    if combinator == ">":
        return parent is not None and parent.parent is not None and _chain(parent, chain[1:])
    return any(_chain(a, chain[1:]) for a in node.ancestors())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None, 0)
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes, bounds, node = CLOSES.get(tag, ()), BOUNDS.get(tag, ()), self.now
        while closes and node.parent is not None and node.tag not in bounds:
            if node.tag in closes:
                self.now = node.parent
            node = node.parent
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.now, self.count)  # of repeated attributes the first counts
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.now = node.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def parsed(html: str | None) -> Node:
    """The page's root, its elements numbered."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = [tree.root, *tree.root.walk()]
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.last = max(node.parent.last, node.last)
    return tree.root
