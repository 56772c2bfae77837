"""A reader of line and block formats by rules: ``/pattern/ body /pattern/ { actions }``.

A specification has contexts of rules, and actions at the beginning (INIT, BEGIN) and the end (END) of a file.
At every place the first rule of the open context counts whose first pattern matches there (with BODY, whose last
one matches later on); its actions then run with ``$0``, ``$1`` … the texts of its parts. Text that no rule takes is
data of the open element. The actions are ``begin record x``, ``begin element x``, ``begin variant c t v``,
``begin context x``, ``end record``, ``end element [-record | x]``, ``end variant``, ``end context``,
``data [-text] [-element x] [-attribute a] text``, ``unread [-offset n] part`` and ``context x``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt
from .tree import Node


@dataclass
class Rule:
    parts: list  # patterns and BODY (None) in order
    actions: list[list[str]]


@dataclass
class Spec:
    contexts: dict[str, list[Rule]] = field(default_factory=lambda: {"main": []})
    init: list[list[str]] = field(default_factory=list)
    begin: list[Rule] = field(default_factory=list)
    end: list[list[str]] = field(default_factory=list)


def _pattern(text: str) -> re.Pattern:
    """``^`` is the start of a line, ``.`` no newline, ``$`` the end of a line."""
    return re.compile(text, re.M)


def _actions(text: str) -> list[list[str]]:
    words, out = re.findall(r'"(?:[^"\\]|\\.)*"|;|\n|[^\s;]+', text), [[]]
    for w in words:
        if w in (";", "\n"):
            out.append([])
        elif w.startswith('"'):
            out[-1].append("\0" + re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), w[1:-1]))
        else:
            out[-1].append(w)
    return [a for a in out if a]


def parse(text: str) -> Spec:
    spec, context, at = Spec(), "main", 0
    mode = "rule"
    parts: list = []
    while at < len(text):
        if m := re.compile(r"\s+|#[^\n]*").match(text, at):
            at = m.end()
        elif m := re.compile(r"CONTEXT\s*\{\s*([\w-]+)\s*\}").match(text, at):
            context, at = m[1], m.end()
            spec.contexts.setdefault(context, [])
        elif m := re.compile(r"(BEGIN|END|INIT|BODY)\b").match(text, at):
            at = m.end()
            if m[1] == "BODY":
                parts.append(None)
            else:
                mode = m[1].lower()
        elif m := re.compile(r"/((?:[^/\\]|\\.)*)/").match(text, at):
            parts.append(_pattern(m[1].replace("\\/", "/")))
            at = m.end()
        elif text[at] == "{":
            depth, stop, quoted = 1, at + 1, False
            while depth:
                if stop >= len(text):
                    raise ValueError("an action is open")
                c = text[stop]
                quoted ^= c == '"' and text[stop - 1] != "\\"
                depth += 0 if quoted else (c == "{") - (c == "}")
                stop += 1
            actions = _actions(text[at + 1 : stop - 1])
            if mode == "rule":
                spec.contexts[context].append(Rule(parts, actions))
            elif mode == "begin":
                spec.begin.append(Rule(parts, actions))
            else:
                (spec.init if mode == "init" else spec.end).extend(actions)
            mode, parts, at = "rule", [], stop
        else:
            raise ValueError(f"unexpected {text[at : at + 20]!r}")
    return spec


class _Machine:
    def __init__(self, spec: Spec):
        self.spec, self.contexts, self.stack, self.records = spec, ["main"], [], []

    def data(self, text: str, attribute: str | None = None, element: str | None = None) -> None:
        if not self.stack or not text:
            return
        at = self.stack[-1]
        if element:
            at = next((c for c in reversed(at.elements()) if c.tag == element), None) or at.children.append(Node(element)) or at.elements()[-1]
        if attribute:
            at.attrs[attribute] = at.attrs.get(attribute, "") + text
        elif at.children and at.children[-1].tag is None:
            at.children[-1].text += text
        else:
            at.children.append(Node(None, text=text))

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            done = self.stack.pop()
            if not self.stack:
                self.records.append(Node("", children=[done]))

    def run(self, actions: list[list[str]], parts: list[tuple[int, int]], text: str, end: int) -> int:
        """Where reading goes on."""
        shown = lambda w: w[1:] if w.startswith("\0") else text[slice(*parts[int(w[1:])])] if re.fullmatch(r"\$\d+", w) and int(w[1:]) < len(parts) else "" if re.fullmatch(r"\$\d+", w) else w
        for name, *args in actions:
            if name == "begin" and args:
                if args[0] == "record":
                    self.close(0)
                    self.stack.append(Node(shown(args[1]) if len(args) > 1 else "record"))
                elif args[0] == "context":
                    self.contexts.append(args[1])
                elif args[0] == "variant" and self.stack:
                    self.stack.append(Node("var", dict(zip(("class", "type", "value"), map(shown, args[1:])))))
                    self.stack[-2].children.append(self.stack[-1])
                elif args[0] == "element" and self.stack:
                    self.stack.append(Node(re.sub(r"\s+", "", shown(args[1])) or "element"))
                    self.stack[-2].children.append(self.stack[-1])
            elif name == "end" and args:
                if args[0] == "record":
                    self.close(0)
                elif args[0] == "context":
                    self.contexts = self.contexts[:-1] or ["main"]
                elif args[1:2] == ["-record"]:
                    self.close(1)
                elif len(args) > 1:
                    tags = [n.tag for n in self.stack]
                    if shown(args[1]) in tags[1:]:
                        self.close(len(tags) - 1 - tags[::-1].index(shown(args[1])))
                elif len(self.stack) > 1:
                    self.close(len(self.stack) - 1)
            elif name == "context" and args:
                self.contexts = [args[0]]
            elif name == "data":
                attribute = element = None
                words = list(args)
                while words and words[0].startswith("-"):
                    flag = words.pop(0)
                    if flag == "-attribute" and words:
                        attribute = shown(words.pop(0))
                    elif flag == "-element" and words:
                        element = shown(words.pop(0))
                self.data(" ".join(map(shown, words)), attribute, element)
            elif name == "unread" and args:
                words, offset = list(args), 0
                if words[0] == "-offset" and len(words) > 1:
                    offset, words = int(shown(words[1])), words[2:]
                part = int(words[0].lstrip("$")) if words and words[0].lstrip("$").isdigit() else 0
                if part < len(parts):
                    end = min(end, parts[part][0] + offset)
            else:
                raise ValueError(f"no action {name} {args}")
        return end

    def match(self, rule: Rule, text: str, at: int) -> list[tuple[int, int]] | None:
        out, here, open_body = [], at, False
        for p in rule.parts:
            if p is None:
                open_body = True
                continue
            m = p.search(text, here) if open_body else p.match(text, here)
            if not m:
                return None
            if open_body:
                out.append((here, m.start()))
            out.append(m.span())
            here, open_body = m.end(), False
        if open_body:
            out.append((here, len(text)))
        return out

    def read(self, text: str) -> list[Node]:
        self.run(self.spec.init, [], text, 0)
        at, plain, begun, stuck = 0, 0, not self.spec.begin, (-1, "")
        while at < len(text):
            rules = self.spec.begin if not begun else self.spec.contexts.get(self.contexts[-1], [])
            for rule in rules:
                found = self.match(rule, text, at)
                if found is None or found and found[-1][1] == at == stuck[0] and stuck[1] == id(rule):
                    continue
                self.data(text[plain:at])
                stuck = (at, id(rule))
                stop = found[-1][1] if found else at
                after = max(at, self.run(rule.actions, found, text, stop))
                at, plain, begun = after, after, True
                break
            else:
                at += 1
        self.data(text[plain:])
        self.run(self.spec.end, [], text, len(text))
        self.close(0)
        return self.records


def records(text: str, spec: Spec) -> list[Node]:
    """The record trees of one file's text."""
    return _Machine(spec).read(text)


def rule_records(files: DataFrame, spec_text: str) -> DataFrame:
    """(filename, part, text): records of (filename, text) files by a specification, as XML. A file is read by one task."""
    from .tree import events, to_xml

    parse(spec_text)  # errors show at once

    def run(frames) -> Iterator[pd.DataFrame]:
        spec = parse(spec_text)
        for frame in frames:
            rows = [(name, i, to_xml(events(r))) for name, text in zip(frame["filename"], frame["text"]) for i, r in enumerate(records(text or "", spec))]
            yield pd.DataFrame(rows, columns=["filename", "part", "text"])

    return dealt(files.select(F.col("filename"), F.col("text").cast("string"))).mapInPandas(run, "filename string, part long, text string")
