"""Chat formatting: a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree
becomes Python closures that stream a conversation's rendering piece by piece, with the pieces inside
``{% generation %}`` marked for the training loss. The language has

* ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}/{% elif %}/{% else %}``, ``{% set x = e %}``,
  ``{% generation %}``, ``{# comment #}``;
* strings, integers, names, ``x.field``, ``+ == != and or not in``, parentheses, ``loop.first``,
  ``loop.index``, and the filters ``escape``, ``upper``, ``lower``, ``trim``.

There are no calls, no subscripts and no attribute access on Python objects: ``x.field`` reads a
mapping only. Loops may run over any iterator, so a conversation is never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings with a meaning to the model; the escape keeps all of them out of roles and texts.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[SYS]", "[/SYS]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
TEMPLATE = (
    "{% for m in messages %}{{ '<s>' + '[ROLE]' }}{{ m.role | escape }}{{ '[/ROLE]' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '</s>' }}{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not of the language, or reads what it may not."""


def escape(text: str) -> str:
    r"""Doubles backslashes and breaks every control string with ``\.`` after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|\.)", lambda m: "\\" if m[1] == "\\" else "", text)


# ---- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip}
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[|().+]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise TemplateError(f"unexpected {text[at:]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("int", "str", "name", "op"), m.groups()) if v is not None))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *want: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in want:
            self.at += 1
            return value
        return None

    def whole(self):
        e = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = Op("or", (e, self.both()))
        return e

    def both(self):
        e = self.negated()
        while self.take("and"):
            e = Op("and", (e, self.negated()))
        return e

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        e = self.summed()
        while op := self.take("==", "!=", "in"):
            e = Op(op, (e, self.summed()))
        return e

    def summed(self):
        e = self.filtered()
        while self.take("+"):
            e = Op("+", (e, self.filtered()))
        return e

    def filtered(self):
        e = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            e = Op(f"|{name}", (e,))
        return e

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "int":
            return Const(int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        if kind == "name":
            e = {"true": Const(True), "false": Const(False), "none": Const(None)}.get(value) or Name(value)
            while self.take("."):
                kind, value = self.peek()
                if kind != "name" or value.startswith("_"):
                    raise TemplateError(f"no field {value!r}")
                self.at += 1
                e = Field(e, value)
            return e
        if value == "(":
            e = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is open")
            return e
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> tuple:
    """The template's syntax tree."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", template, flags=re.S)
    at = 0

    def block(*stops: str) -> tuple[tuple, str, str]:
        nonlocal at
        body = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                body.append(Out(_Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in stops:
                    return tuple(body), word, rest
                if word == "for":
                    if not (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
                        raise TemplateError(f"bad loop {rest!r}")
                    inner, _, _ = block("endfor")
                    body.append(For(m[1], _Expression(m[2]).whole(), inner))
                elif word == "if":
                    cases, test = [], _Expression(rest).whole()
                    while True:
                        inner, stop, rest = block("elif", "else", "endif")
                        cases.append((test, inner))
                        if stop == "endif":
                            break
                        test = Const(True) if stop == "else" else _Expression(rest).whole()
                    body.append(If(tuple(cases)))
                elif word == "set":
                    name, eq, value = rest.partition("=")
                    if not eq or not name.strip().isidentifier():
                        raise TemplateError(f"bad set {rest!r}")
                    body.append(Set(name.strip(), _Expression(value).whole()))
                elif word == "generation":
                    body.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"no statement {word!r}")
            elif part and not part.startswith("{#"):
                body.append(Out(Const(part)))
        if stops:
            raise TemplateError(f"missing {stops[-1]}")
        return tuple(body), "", ""

    return block()[0]


# ---- constant folding


def fold(node):
    """The same tree with constant expressions evaluated, dead branches gone and neighbouring constants joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            if isinstance(x, tuple):
                out += x
            elif isinstance(x, Out) and isinstance(x.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(_text(out[-1].value.value) + _text(x.value.value)))
            else:
                out.append(x)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        return Const(_expression(Op(node.op, args))({})) if all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, (Out, Set)):
        value = fold(node.value)
        return Out(value) if isinstance(node, Out) else Set(node.name, value)
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        cases = []
        for test, body in node.cases:
            test = fold(test)
            if isinstance(test, Const) and not test.value:
                continue
            cases.append((test, fold(body)))
            if isinstance(test, Const):
                break
        return cases[0][1] if cases and isinstance(cases[0][0], Const) else If(tuple(cases)) if cases else ()
    return node


# ---- closures


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _expression(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, k=node.name: env.get(k)
    if isinstance(node, Field):
        of, key = _expression(node.of), node.name

        def field(env):
            value = of(env)
            if value is not None and not isinstance(value, dict):
                raise TemplateError(f"{key!r} is read of something that is no mapping")
            return None if value is None else value.get(key)

        return field
    args = tuple(map(_expression, node.args))
    if node.op.startswith("|"):
        f = FILTERS[node.op[1:]]
        return lambda env, a=args[0]: f(_text(a(env)))
    if node.op == "not":
        return lambda env, a=args[0]: not a(env)
    a, b = args
    return {
        "+": lambda env: x + y if isinstance(x := a(env), int) and isinstance(y := b(env), int) else _text(x) + _text(b(env)),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "in": lambda env: _text(a(env)) in _text(b(env)),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
    }[node.op]


Pieces = Iterator[tuple[str, bool]]


def _statements(body: tuple) -> Callable[[dict, bool], Pieces]:
    steps = tuple(map(_statement, body))

    def run(env: dict, marked: bool) -> Pieces:
        for step in steps:
            yield from step(env, marked)

    return run


def _statement(node) -> Callable[[dict, bool], Pieces]:
    if isinstance(node, Out):
        value = _expression(node.value)

        def out(env, marked):
            yield _text(value(env)), marked

        return out
    if isinstance(node, Set):
        value = _expression(node.value)

        def put(env, marked):
            env[node.name] = value(env)
            return iter(())

        return put
    if isinstance(node, Generation):
        body = _statements(node.body)
        return lambda env, marked: body(env, True)
    if isinstance(node, If):
        cases = tuple((_expression(t), _statements(b)) for t, b in node.cases)

        def choose(env, marked):
            for test, body in cases:
                if test(env):
                    return body(env, marked)
            return iter(())

        return choose
    over, body = _expression(node.over), _statements(node.body)

    def loop(env, marked):
        inner = dict(env)
        for i, item in enumerate(over(env) or ()):
            inner[node.name], inner["loop"] = item, {"index": i + 1, "first": i == 0}
            yield from body(inner, marked)

    return loop


def compiled(template: str) -> Callable[[Iterable[dict]], Pieces]:
    """A function from messages to (piece, marked) pairs; the pieces' concatenation is the rendering."""
    run = _statements(fold(parse(template)))
    return lambda messages, **names: run({**names, "messages": messages}, False)


# ---- reading back

_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.S)


class Reader:
    """Parses a rendering of TEMPLATE as it arrives and keeps only the turn that is still open."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.open: list[str] = []

    def feed(self, piece: str, marked: bool) -> None:
        self.chars += len(piece)
        self.open.append(piece)
        if marked:
            text = unescape(piece)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        if piece.endswith("</s>"):
            self.close()

    def close(self) -> None:
        turn = "".join(self.open)
        m = _TURN.fullmatch(turn)
        if not m or len(_CONTROL.findall(turn)) != 4:
            raise ValueError("the rendering cannot be read back")
        self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        self.n_turns, self.open = self.n_turns + 1, []


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _by_conversation(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)))


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, piece_no, piece, marked): the renderings, a piece a row, in order within a conversation.

    Rows go by turn, then role, then text; null turns come first, a null text or role is empty, a null
    conv_id is a conversation of its own. Repeated rows are repeated turns. An empty table gives none.
    """

    def run(batches):
        from itertools import groupby

        render = compiled(template)
        out: list = []
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            for i, (piece, marked) in enumerate(render({"role": r[2] or "", "text": r[3]} for r in rows)):
                out.append((conv, i, piece, marked))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    names, kinds = ["conv_id", "piece_no", "piece", "marked"], [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return _by_conversation(conversations).mapInArrow(run, "conv_id long, piece_no long, piece string, marked boolean")


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation, read back from its rendering. A conversation streams through its
    task turn by turn, so memory does not grow with its length."""

    def run(batches):
        from itertools import groupby

        render, out = compiled(template), []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            reader = Reader()
            for piece, marked in render({"role": r[2] or "", "text": r[3]} for r in rows):
                reader.feed(piece, marked)
            if reader.open:
                raise ValueError("a turn is open at the end of the rendering")
            out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
            if len(out) >= 2000:
                yield table()
                out = []
        if out:
            yield table()

    return _by_conversation(conversations).mapInArrow(run, SCHEMA)
