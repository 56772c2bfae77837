"""Prefix query text: ``@and @attr 1=4 utah @attr 5=1 sal`` to a syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


class Diagnostic(Exception):
    """A query error with its public diagnostic number."""

    def __init__(self, code: int, info: str = ""):
        super().__init__(f"diagnostic {code}: {info}")
        self.code, self.info = code, info


@dataclass(frozen=True)
class Apt:
    """A term with attributes (set, type) -> value; the first given attribute of a type counts."""

    term: str
    attrs: tuple[tuple[str, int, str], ...] = ()

    def get(self, kind: int) -> str | None:
        return next((v for _, t, v in self.attrs if t == kind), None)

    def attribute_set(self, kind: int) -> str:
        return next((s for s, t, _ in self.attrs if t == kind), "bib-1")


@dataclass(frozen=True)
class Bool:
    """and / or over any number of children, not over two."""

    op: str
    children: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Prox:
    left: object
    right: object
    exclusion: bool
    distance: int
    ordered: bool
    relation: int
    known: bool
    unit: int


@dataclass(frozen=True)
class SetRef:
    name: str


_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|\S+)')


def parse(text: str) -> object:
    """The tree; nested and/or of one kind are flattened. Malformed text raises diagnostic 10."""
    tokens = _TOKEN.findall(text)
    at, base = 0, "bib-1"

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise Diagnostic(10, "the query ends early")
        at += 1
        return tokens[at - 1]

    def attribute(own: str) -> tuple[str, int, str]:
        first = _plain(take())
        if "=" not in first:
            own, first = first, _plain(take())
        kind, _, value = first.partition("=")
        if not kind.isdigit() or not value:
            raise Diagnostic(10, f"bad attribute {first!r}")
        return own, int(kind), value[1:-1] if value.startswith('"') and value.endswith('"') else value

    def node(attrs: tuple) -> object:
        nonlocal base
        word = take()
        if word == "@attrset":
            base = take()
            return node(attrs)
        if word == "@attr":
            return node((attribute(base), *attrs))
        if word == "@term":
            take()
            return node(attrs)
        if word == "@set":
            return SetRef(_plain(take()))
        if word in ("@and", "@or", "@not"):
            return joined(word[1:], node(attrs), node(attrs))
        if word == "@prox":
            excl, dist, order, rel, known, unit = (take() for _ in range(6))
            if not all(x.lstrip("-").isdigit() for x in (dist, rel, unit)) or known not in ("k", "p", "known", "private", "1", "2"):
                raise Diagnostic(10, "bad proximity operator")
            left, right = node(attrs), node(attrs)
            return Prox(left, right, excl in ("1", "true"), int(dist), order in ("1", "true"), int(rel), known in ("k", "known", "1"), int(unit))
        if word.startswith("@"):
            raise Diagnostic(10, f"no operator {word}")
        return Apt(_plain(word), attrs)

    tree = node(())
    if at < len(tokens):
        raise Diagnostic(10, f"unexpected {tokens[at]!r}")
    return tree


def joined(op: str, left: object, right: object) -> Bool:
    if op == "not":
        return Bool(op, (left, right))
    own = lambda x: x.children if isinstance(x, Bool) and x.op == op else (x,)
    return Bool(op, (*own(left), *own(right)))


def _plain(word: str) -> str:
    return re.sub(r"\\(.)", r"\1", word[1:-1]) if len(word) > 1 and word[0] == word[-1] == '"' else word


def with_attribute(tree: object, kind: int, value: str) -> object:
    """Every leaf with one more attribute in front."""
    if isinstance(tree, Apt):
        return replace(tree, attrs=(("bib-1", kind, value), *tree.attrs))
    if isinstance(tree, Bool):
        return replace(tree, children=tuple(with_attribute(c, kind, value) for c in tree.children))
    if isinstance(tree, Prox):
        return replace(tree, left=with_attribute(tree.left, kind, value), right=with_attribute(tree.right, kind, value))
    return tree
