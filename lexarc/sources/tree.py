"""Record trees: selection, mapping onto another schema, small expressions, and writers of several forms."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field


class ElementError(ValueError):
    """A selection that no element set may hold; ``code`` is its public diagnostic."""

    code = 100


@dataclass
class Node:
    """An element, or a text where ``tag`` is None; comments and processing instructions have tags ``!`` and ``?name``."""

    tag: str | None
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Node] = field(default_factory=list)

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag and c.tag[0] not in "!?"]

    def value(self) -> str:
        """All text below."""
        return self.text if self.tag is None else "".join(c.value() for c in self.children if c.tag is None or c.tag[0] not in "!?")

    def find(self, path: str) -> list[Node]:
        """Elements at a path of tags from here; ``*`` is any tag."""
        found = [self]
        for step in [s for s in path.split("/") if s]:
            found = [c for n in found for c in n.elements() if step in ("*", c.tag)]
        return found

    def first(self, path: str, default: str = "") -> str:
        """Text of the first element at a path."""
        return next((n.value() for n in self.find(path)), default)

    def count(self, path: str) -> int:
        return len(self.find(path))


def tree(events: Iterable) -> Node:
    """The tree of a record's events; its root has no tag of the record's own."""
    root = Node("")
    stack = [root]
    for what, value, attrs in events:
        if what == "end":
            if len(stack) > 1:
                stack.pop()
        elif what == "text":
            if (last := stack[-1].children[-1:]) and last[0].tag is None:
                last[0].text += value  # neighbouring texts are one
            else:
                stack[-1].children.append(Node(None, text=value))
        elif what in ("comment", "pi"):
            stack[-1].children.append(Node("!" if what == "comment" else "?" + value, text=attrs if what == "pi" else value))
        else:
            stack[-1].children.append(node := Node(value, dict(attrs or {})))
            stack.append(node)
    return root


def events(node: Node) -> Iterator[tuple]:
    if node.tag is None:
        yield "text", node.text, None
    elif node.tag == "!":
        yield "comment", node.text, None
    elif node.tag.startswith("?"):
        yield "pi", node.tag[1:], node.text
    else:
        if node.tag:
            yield "start", node.tag, node.attrs
        for c in node.children:
            yield from events(c)
        if node.tag:
            yield "end", node.tag, None


def chopped(node: Node) -> Node:
    """Without white space at both ends of texts, and without texts of nothing else."""
    texts = [Node(None, text=" ".join(c.text.split())) if c.tag is None else chopped(c) for c in node.children]
    return Node(node.tag, node.attrs, node.text, [c for c in texts if c.tag is not None or c.text])


def without(node: Node, tag: str) -> Node:
    """Without subtrees of a tag, e.g. those that only steer indexing."""
    return Node(node.tag, node.attrs, node.text, [without(c, tag) for c in node.children if c.tag != tag])


# ---- element sets

_SELECTOR = re.compile(r"(!?)((?:[^\s\[{]+(?:\[@[\w.:-]+(?:=[^\]]*)?\])?)+)(?:\{(\w+)(?:,(\d+))?\})?$")
_STEP = re.compile(r"\((\d+),([^)]+)\)|([^/\[]+)(?:\[@([\w.:-]+)(?:=([^\]]*))?\])?")


def _step(node: Node, step: tuple, tags: dict[tuple[int, str], str]) -> bool:
    number, value, name, attribute, wanted = step
    if number:
        return node.tag == tags.get((int(number), value), value)
    if name != "*" and node.tag != name:
        return False
    return not attribute or attribute in node.attrs and (not wanted or node.attrs[attribute] == wanted.strip("'\""))


def selected(root: Node, selectors: list[str], tags: dict[tuple[int, str], str] | None = None, no_data: bool = False, most_bytes: int | None = None) -> Node:
    """The parts of a record that an element set names.

    A selector is a path ``a/b[@x=v]`` or ``(type,value)/…``, ``*`` any child, ``!path`` takes away, ``path{2,3}`` takes
    three occurrences from the second. Occurrences by ``last`` raise diagnostic 100. ``no_data`` keeps tags only,
    ``most_bytes`` cuts every text.
    """
    keep: set[int] = set()
    drop: set[int] = set()
    for text in selectors:
        m = _SELECTOR.match(text)
        if not m or m[3] and not m[3].isdigit():
            raise ElementError(text)
        steps = [s.groups() for s in _STEP.finditer(m[2])]
        found = [root]
        for i, step in enumerate(steps):
            found = [c for n in found for c in n.elements() if _step(c, step, tags or {})]
            if i + 1 == len(steps) and m[3]:
                found = found[int(m[3]) - 1 : int(m[3]) - 1 + int(m[4] or 1)]
        (drop if m[1] else keep).update(map(id, found))
    everything = all(t.startswith("!") for t in selectors)

    def cut(node: Node, inside: bool) -> Node | None:
        if id(node) in drop:
            return None
        inside = inside or id(node) in keep
        if node.tag is None:
            if not inside or no_data:
                return None
            return Node(None, text=node.text.encode()[:most_bytes].decode(errors="ignore") if most_bytes is not None else node.text)
        children = [c for c in (cut(c, inside) for c in node.children) if c is not None]
        return Node(node.tag, node.attrs, node.text, children) if inside or children else None

    return cut(root, everything) or Node(root.tag, root.attrs)


# ---- schema mapping


def map_rules(text: str) -> list[tuple[str, list[str], bool, bool, bool]]:
    """Lines ``map source target/path[:new] [nodata] [nochop]``: (source tag, target path, new, nodata, nochop)."""
    out = []
    for line in text.splitlines():
        words = line.partition("#")[0].split()
        if len(words) >= 3 and words[0] == "map":
            path, new = re.subn(r":new\b", "", words[2])
            out.append((words[1], [p for p in path.split("/") if p], bool(new), "nodata" in words[3:], "nochop" in words[3:]))
    return out


def remapped(root: Node, rules: list[tuple[str, list[str], bool, bool, bool]], name: str = "record") -> Node:
    """The record in another schema, depth first: a target is created where the last child is not it; elements without a rule pass on their children."""
    out = Node(name)
    table: dict[str, list] = {}
    for rule in rules:
        table.setdefault(rule[0], []).append(rule)

    def place(path: list[str], new: bool) -> Node:
        at = out
        for i, tag in enumerate(path):
            last = at.elements()[-1:]
            if not last or last[0].tag != tag or new and i + 1 == len(path):
                at.children.append(Node(tag))
            at = at.elements()[-1]
        return at

    def walk(node: Node) -> None:
        for c in node.elements():
            for _, path, new, nodata, nochop in table.get(c.tag, ()):
                target = place(path, new)
                data = "".join(x.text for x in c.children if x.tag is None)
                if not nodata and (data if nochop else data.strip()):
                    target.children.append(Node(None, text=data if nochop else " ".join(data.split())))
            walk(c)

    walk(root)
    return out


# ---- source expressions


def expression(text: str) -> Callable[[Node], str]:
    """``data``, ``tag``, ``attr(x)``, ``range(e, start[, length])``, ``first(e, 'text' …)`` (from the first of the texts on) and quoted text, of an element."""
    tokens = re.findall(r"'[^']*'|\"[^\"]*\"|[\w.:-]+|[(),]", text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        at += 1
        if at > len(tokens) or want and tokens[at - 1] != want:
            raise ValueError(f"bad expression {text!r}")
        return tokens[at - 1]

    def arguments() -> list:
        out = []
        take("(")
        while peek() != ")":
            out.append(parse())
            if peek() == ",":
                take()
        take(")")
        return out

    def parse():
        word = take()
        if word[0] in "'\"":
            return lambda n: word[1:-1]
        if word == "data":
            return Node.value
        if word == "tag":
            return lambda n: n.tag or ""
        if word.isdigit():
            return lambda n: word
        if word not in ("attr", "range", "first"):
            raise ValueError(f"no function {word}")
        if word == "attr":
            take("(")
            name = take().strip("'\"")
            take(")")
            return lambda n: n.attrs.get(name, "")
        args = arguments()
        if word == "range" and len(args) in (2, 3):
            whole, start, size = args[0], args[1], args[2] if len(args) > 2 else None
            return lambda n: whole(n)[int(start(n)) :][: int(size(n)) if size else None]
        if word == "first" and len(args) > 1:

            def from_first(n: Node) -> str:
                value = args[0](n)
                places = [p for a in args[1:] if (p := value.find(a(n))) >= 0]
                return value[min(places) :] if places else ""

            return from_first
        raise ValueError(f"bad arguments of {word}")

    out = parse()
    if at != len(tokens):
        raise ValueError(f"bad expression {text!r}")
    return out


def with_system_tags(root: Node, size: int, rank: int, sysno: int) -> Node:
    """The record with ``size``, ``rank`` and ``sysno`` elements at the end of its outermost element."""
    top = root.elements()[0] if root.elements() else root
    added = [Node(t, children=[Node(None, text=str(v))]) for t, v in (("size", size), ("rank", rank), ("sysno", sysno))]
    full = Node(top.tag, top.attrs, children=[*top.children, *added])
    return Node(root.tag, children=[full if c is top else c for c in root.children]) if top is not root else full


# ---- writers


def to_nested(node: Node, tags: dict[str, tuple[int, str]] | None = None) -> dict:
    """A typed record: elements as (type, value) tags with a leaf text or a subtree; names without a number have type 3."""
    kids = chopped(node).children
    kind, value = (tags or {}).get(node.tag, (3, node.tag))
    own = {"tagType": kind, "tagValue": value}
    below = [to_nested(c, tags) for c in kids if c.tag and c.tag[0] not in "!?"]
    text = " ".join(c.text for c in kids if c.tag is None)
    if not below:
        return {**own, "content": text}
    return {**own, "content": ([{"tagType": 2, "tagValue": "19", "content": text}] if text else []) + below}


def to_soif(root: Node, template: str = "RECORD", url: str = "-") -> str:
    """Attribute and value lines ``Path{bytes}:\\tvalue`` of all leaves."""
    out = [f"@{template} {{ {url}"]

    def walk(node: Node, path: list[str]) -> None:
        text = " ".join("".join(c.text for c in node.children if c.tag is None).split())
        if text:
            out.append(f"{'-'.join(path)}{{{len(text.encode())}}}:\t{text}")
        for c in node.elements():
            walk(c, [*path, c.tag])

    walk(root, [])
    return "\n".join([*out, "}", ""])


SUMMARY = {"title": ("title", "Title"), "author": ("author", "Author", "name"), "callNumber": ("callNumber",), "recordType": ("recordType",), "bibliographicLevel": ("bibliographicLevel",), "format": ("format",), "publicationPlace": ("publicationPlace",), "publicationDate": ("publicationDate", "date"), "targetSystemKey": ("targetSystemKey",), "satisfyingElement": ("satisfyingElement",), "rank": ("rank",), "documentId": ("documentId",), "abstract": ("abstract",)}


def to_summary(root: Node) -> dict[str, str]:
    """The fixed fields of a brief record, from the first element of each name anywhere."""
    found: dict[str, str] = {}

    def walk(node: Node) -> None:
        for c in node.elements():
            for name, tags in SUMMARY.items():
                if c.tag in tags and name not in found and c.value().strip():
                    found[name] = " ".join(c.value().split())
            walk(c)

    walk(root)
    return found


def to_xml(stream: Iterable) -> str:
    """Events as XML; an element's end has its start's name."""
    out, stack = [], []
    for what, value, attrs in stream:
        if what == "text":
            out.append(html.escape(value, quote=False))
        elif what == "comment":
            out.append(f"<!--{value}-->")
        elif what == "pi":
            out.append(f"<?{value} {attrs}?>" if attrs else f"<?{value}?>")
        elif what == "end":
            out.append(f"</{stack.pop()}>")
        else:
            stack.append(value)
            out.append("<" + value + "".join(f' {k}="{html.escape(v)}"' for k, v in (attrs or {}).items()) + ">")
    return "".join(out)
