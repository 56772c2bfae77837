"""Index formulae over MARC fields: ``mc-71.00_$a,_$g,_$h_(_$c_){.$b_(_$c_)}``.

A formula names fields by tag and indicators (``.`` any, ``_`` blank), then a text made of subfields and
literals. ``_`` is a space, ``( )`` a group that is left out where none of its subfields is there, ``{ }`` a
part that repeats while it has subfields, ``$1<formula>`` a formula over the fields embedded in a subfield, and
``[a-b]`` an interval of characters. A control field has an interval only: ``mc-008[0-5]``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .tree import Node


@dataclass(frozen=True)
class Sub:
    code: str
    interval: tuple[int, int] | None = None
    inner: Formula | None = None


@dataclass(frozen=True)
class Group:
    parts: tuple
    repeated: bool = False


@dataclass(frozen=True)
class Formula:
    tag: str
    indicators: str
    parts: tuple
    interval: tuple[int, int] | None = None


def parse(text: str) -> Formula:
    body = text.removeprefix("mc-")
    formula, rest = _formula(body)
    if rest:
        raise ValueError(f"unexpected {rest!r} in {text!r}")
    return formula


def _interval(text: str) -> tuple[tuple[int, int] | None, str]:
    m = re.match(r"\[(\d+)(?:-(\d+))?\]", text)
    return ((int(m[1]), int(m[2] or m[1])), text[m.end() :]) if m else (None, text)


def _formula(text: str) -> tuple[Formula, str]:
    tag, text = text[:3], text[3:]
    if len(tag) < 3 or not re.fullmatch(r"[\w.]{3}", tag):
        raise ValueError(f"bad field {tag!r}")
    interval, text = _interval(text)
    if interval:
        return Formula(tag, "..", (), interval), text
    indicators, text = text[:2].replace("_", " "), text[2:]
    parts, text = _parts(text, "")
    return Formula(tag, indicators or "..", tuple(parts)), text


def _parts(text: str, end: str) -> tuple[list, str]:
    out: list = []
    while text:
        c = text[0]
        if end and c == end:
            return out, text[1:]
        if c == ">" and not end:
            return out, text
        if c in "({":
            inner, text = _parts(text[1:], {"(": ")", "{": "}"}[c])
            out.append(Group((("(", *inner, ")") if c == "(" else tuple(inner)), c == "{"))
        elif c == "$":
            code, text = text[1:2], text[2:]
            interval, text = _interval(text)
            inner = None
            if text.startswith("<"):
                inner, text = _formula(text[1:])
                if not text.startswith(">"):
                    raise ValueError("an embedded formula is open")
                text = text[1:]
            out.append(Sub(code, interval, inner))
        else:
            out.append(" " if c == "_" else c)
            text = text[1:]
    if end:
        raise ValueError(f"missing {end}")
    return out, text


def _fits(formula: Formula, tag: str, field: Node) -> bool:
    own = field.attrs.get("ind1", " ") + field.attrs.get("ind2", " ")
    return all(a in (".", b) for a, b in zip(formula.tag, tag)) and all(a in (".", b) for a, b in zip(formula.indicators, own))


def _embedded(text: str) -> tuple[str, Node]:
    """A linked field: its tag, indicators and subfields follow each other in one subfield, ``700 1\\x1faX`` or ``700 1$aX``."""
    node = Node(text[:3], {"ind1": text[3:4] or " ", "ind2": text[4:5] or " "})
    for part in re.split(r"[$\x1f]", text[5:])[1:]:
        node.children.append(Node(part[:1], children=[Node(None, text=part[1:])]))
    return text[:3], node


class _Fields:
    """Subfields of a field, each used once, in order."""

    def __init__(self, field: Node):
        self.left = [(c.attrs.get("code", c.tag), c.value()) for c in field.elements()]

    def take(self, code: str) -> str | None:
        for i, (c, value) in enumerate(self.left):
            if c == code:
                del self.left[i]
                return value
        return None


def _written(parts: tuple, fields: _Fields) -> tuple[str, int]:
    """The text, and how many subfields it has. Literals stand between subfields that are there."""
    out, found, pending = "", 0, ""
    for p in parts:
        if isinstance(p, str):
            pending += p
            continue
        if isinstance(p, Sub):
            value = fields.take(p.code)
            if value is not None and p.inner is not None:
                tag, node = _embedded(value)
                value = "".join(evaluate(p.inner, tag, node)) or None
            if value is not None and p.interval:
                value = value[p.interval[0] : p.interval[1] + 1]
            if value is None:
                pending = pending if not out else " " if pending.strip(" ") == "" and pending else ""
                continue
            out, found, pending = out + pending + value, found + 1, ""
        else:
            while True:
                text, n = _written(p.parts, fields)
                if not n:
                    break
                out, found, pending = out + pending + text, found + n, ""
                if not p.repeated:
                    break
    return out + (pending if found else ""), found


def evaluate(formula: Formula, tag: str, field: Node) -> list[str]:
    """The formula's text of one field; none where the field does not fit or has none of its subfields."""
    if not _fits(formula, tag, field):
        return []
    if formula.interval:
        data = field.value()[formula.interval[0] : formula.interval[1] + 1]
        return [data] if data else []
    if not any(not isinstance(p, str) for p in formula.parts):
        return [field.value()] if field.value() else []
    text, n = _written(formula.parts, _Fields(field))
    return [re.sub(r" +", " ", text).strip()] if n else []


def values(formula: Formula | str, record: Node) -> list[str]:
    """A formula over all fields of a record tree, in either MARC shape; ``ldr`` is the leader."""
    formula = parse(formula) if isinstance(formula, str) else formula
    top = next((n for n in record.elements() if n.tag == "record"), record)
    out = []
    for field in top.elements():
        tag = "ldr" if field.tag == "leader" else field.attrs.get("tag", field.tag)
        out += evaluate(formula, tag, field)
    return out
