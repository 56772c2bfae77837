"""CQL text to the same tree, through a table of properties that maps indexes, relations and modifiers to attributes."""

from __future__ import annotations

import re

from .prefix import Apt, Diagnostic, Prox, _plain, joined

#: Property lines as the public convention writes them: ``index.dc.title = 1=4``; a name without a line stands for itself.
DEFAULT = """
index.cql.serverChoice = 1=any
index.cql.allRecords = 1=_ALLRECORDS 2=103
index.rec.id = 1=12
index.dc.title = 1=4
index.dc.subject = 1=21
index.dc.creator = 1=1003
index.dc.author = 1=1003
index.dc.publisher = 1=1018
index.dc.description = 1=62
index.dc.date = 1=30
relation.< = 2=1
relation.le = 2=2
relation.eq = 2=3
relation.ge = 2=4
relation.> = 2=5
relation.exact = 4=1 6=3
relation.all = 4=6
relation.any = 4=105
relation.scr = 2=3
relationModifier.relevant = 2=102
relationModifier.fuzzy = 5=103
relationModifier.stem = 2=101
relationModifier.phonetic = 2=100
relationModifier.word = 4=2
relationModifier.string = 6=3
relationModifier.number = 4=109
relationModifier.regexp = 5=102
position.first = 3=1 6=1
position.firstAndLast = 3=3 6=3
truncation.right = 5=1
truncation.left = 5=2
truncation.both = 5=3
truncation.none = 5=100
truncation.z3958 = 5=104
"""
_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[()/]|[<>=]+|[^\s()<>="/]+)')
_SPELT = {"<=": "le", "=": "eq", ">=": "ge", "==": "exact", "<>": "ne"}


def properties(text: str = DEFAULT) -> dict[str, list[tuple[str, int, str]]]:
    """Property lines ``name = type=value …`` to attributes; a ``#`` begins a comment."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*([^#\s]+)\s*=\s*(.*?)\s*(?:#.*)?$", line)
        if m and not line.lstrip().startswith("#"):
            out[m[1].lower()] = [("bib-1", int(k), v) for k, v in re.findall(r"(\d+)=(\S+)", m[2])]
    return out


def from_cql(text: str, indexes: dict[str, str] | None = None, table: dict | None = None) -> object:
    """A CQL query to a tree: booleans with ``prox/distance<=3/unordered``, ``index relation/modifier term``, ``^`` anchors, ``*`` and ``?`` masks, ``sortBy``."""
    known = table if table is not None else properties()
    tokens, at = _TOKEN.findall(text), 0

    def peek(i: int = 0) -> str:
        return tokens[at + i] if at + i < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ""

    def modifiers() -> list[str]:
        out = []
        while peek() == "/":
            take()
            name = take().lower()
            if peek() and set(peek()) <= set("<>="):
                name += take() + take()
            out.append(name)
        return out

    def use(word: str) -> list[tuple[str, int, str]]:
        if indexes and word in indexes:
            return [("bib-1", 1, indexes[word])]
        own = known.get(f"index.{word.lower()}") or next((v for k, v in known.items() if k.startswith("index.") and k.rpartition(".")[2] == word.lower() and "." in word), None)
        return own or [("bib-1", 1, word)]

    def relation(word: str, more: list[str]) -> list[tuple[str, int, str]]:
        name = _SPELT.get(word, word)
        out = list(known.get(f"relation.{name}", ())) if name not in ("eq", "=") else []
        if name == "ne":
            raise Diagnostic(117, word)
        for m in more:
            if (own := known.get(f"relationmodifier.{m}")) is None:
                raise Diagnostic(20, f"modifier {m}")
            out += own
        return out

    def ended(term: str, attrs: list) -> Apt:
        first, last = term.startswith("^"), term.endswith("^") and not term.endswith("\\^")
        term = term[first : len(term) - last]
        if first:
            attrs = [*attrs, *known.get("position.firstandlast" if last else "position.first", ())]
        masks = re.sub(r"\\.", "", term)
        if "*" in masks or "?" in masks:
            bare = masks.strip("*")
            if "*" not in bare and "?" not in bare and bare:
                side = {(False, True): "right", (True, False): "left", (True, True): "both"}[masks[0] == "*", masks[-1] == "*"]
                return Apt(term.strip("*"), (*attrs, *known.get(f"truncation.{side}", ())))
            attrs = [*attrs, *known.get("truncation.z3958", ())]
            term = term.replace("?", "#").replace("*", "?")
        return Apt(term, tuple(attrs))

    def clause() -> object:
        if peek() == "(":
            take()
            tree = query()
            if take() != ")":
                raise Diagnostic(10, "a parenthesis is open")
            return tree
        word = take()
        if not word or word in (")", "/"):
            raise Diagnostic(10, "the query ends early")
        following = peek().lower()
        named = set(following) <= set("<>=") or following in ("any", "all", "exact", "scr", "adj", "within", "encloses")
        if following and named and not word.startswith('"'):
            op = take().lower()
            more, term = modifiers(), take()
            if not term:
                raise Diagnostic(10, "the query ends early")
            return ended(_plain(term), [*use(word), *relation(op, more)])
        return ended(_plain(word), [])

    def query() -> object:
        tree = clause()
        while peek().lower() in ("and", "or", "not", "prox"):
            op, more = take().lower(), modifiers()
            right = clause()
            if op == "prox":
                distance, rel, ordered, unit = 1, 2, False, 2
                for m in more:
                    if d := re.fullmatch(r"distance([<>=]+)(\d+)", m):
                        distance, rel = int(d[2]), {"<": 1, "<=": 2, "=": 3, ">=": 4, ">": 5, "<>": 6}[d[1]]
                    elif m in ("ordered", "unordered"):
                        ordered = m == "ordered"
                    elif m.startswith("unit="):
                        unit = {"word": 2, "sentence": 3, "paragraph": 4, "element": 8}.get(m[5:], 0)
                    else:
                        raise Diagnostic(46, m)
                tree = Prox(tree, right, False, distance, ordered, rel, True, unit)
            else:
                tree = joined(op, tree, right)
        return tree

    tree = query()
    if peek().lower() == "sortby":
        take()
        n = 0
        while peek() and peek() not in (")",):
            word = take()
            down = any("descending" in m for m in modifiers())
            tree = joined("or", tree, Apt(str(n), (("bib-1", 7, "2" if down else "1"), *use(word))))
            n += 1
        if not n:
            raise Diagnostic(10, "sortBy needs an index")
    if peek():
        raise Diagnostic(10, f"unexpected {peek()!r}")
    return tree
