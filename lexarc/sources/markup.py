"""Markup sources: SGML, XML and ISO 2709 records to node rows, and node rows to postings.

A node row is (sysno, node, parent, depth, path, tag, attrs, text): the pre-order number, the reversed
path ``b/a/`` and, for text nodes, tag null. Parsers run in Arrow batches, a record at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import FIELD_TYPES, FIRST_MARK, query_terms
from ..storage import dealt
from .tree import Node, to_xml

NODES = "sysno long, node int, parent int, depth int, path string, tag string, attrs map<string,string>, text string"
_TAG = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(/?)([A-Za-z][\w:.-]*)((?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?)*)\s*(/?)>", re.S)
_ATTR = re.compile(r"([\w:.-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

Event = tuple[str, object, object]


def sgml_events(text: str) -> Iterator[Event]:
    """Start, end and text events of tolerant markup: open elements are closed by their parent's end, stray ends ignored."""
    stack, at = [], 0
    for m in _TAG.finditer(text):
        if m.start() > at:
            yield "text", html.unescape(text[at : m.start()]), None
        at = m.end()
        if not m[2]:
            continue
        if m[1]:
            if m[2] in stack:
                while stack:
                    yield "end", (last := stack.pop()), None
                    if last == m[2]:
                        break
        else:
            attrs = {a[0]: html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])}
            yield "start", m[2], attrs
            if m[4]:
                yield "end", m[2], None
            else:
                stack.append(m[2])
    if at < len(text):
        yield "text", html.unescape(text[at:]), None
    while stack:
        yield "end", stack.pop(), None


class Malformed(ValueError):
    """A record that its reader cannot read."""


def strict_xml_events(text: str) -> Iterator[Event]:
    """Events of well-formed XML, with comments and processing instructions; entities of its own are replaced, outer ones
    are not fetched. Names lose their prefix. Anything else raises Malformed.
    """
    from xml.parsers import expat

    out: list[Event] = []
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    local = lambda name: name.rpartition("}")[2]
    parser.StartElementHandler = lambda name, attrs: out.append(("start", local(name), {local(k): v for k, v in attrs.items()}))
    parser.EndElementHandler = lambda name: out.append(("end", local(name), None))
    parser.CharacterDataHandler = lambda data: out.append(("text", data, None))
    parser.CommentHandler = lambda data: out.append(("comment", data, None))
    parser.ProcessingInstructionHandler = lambda target, data: out.append(("pi", target, data))
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        raise Malformed(str(e)) from None
    yield from out


def xml_events(text: str) -> Iterator[Event]:
    """Events of well-formed XML; anything else gives none (``read_status`` tells why)."""
    try:
        yield from strict_xml_events(text)
    except Malformed:
        return


def marc_events(text: str) -> Iterator[Event]:
    """Events of one ISO 2709 record: record / tag (ind1, ind2) / subfield."""
    raw = text.encode()
    try:
        base, ends = int(raw[12:17]), raw.index(b"\x1e")
        directory = raw[24:ends]
    except ValueError:
        return
    yield "start", "record", {}
    yield "start", "leader", {}
    yield "text", raw[:24].decode(errors="replace"), None
    yield "end", "leader", None
    for i in range(0, len(directory) - 11, 12):
        tag, size, at = directory[i : i + 3].decode(), directory[i + 3 : i + 7], directory[i + 7 : i + 12]
        if not (size.isdigit() and at.isdigit()):
            continue
        body = raw[base + int(at) : base + int(at) + int(size)].rstrip(b"\x1e\x1d").decode(errors="replace")
        if "\x1f" not in body:
            yield "start", tag, {}
            yield "text", body, None
        else:
            yield "start", tag, {"ind1": body[:1], "ind2": body[1:2]}
            for sub in body.split("\x1f")[1:]:
                yield "start", sub[:1], {}
                yield "text", sub[1:], None
                yield "end", sub[:1], None
        yield "end", tag, None
    yield "end", "record", None


def marc_split(raw: bytes) -> list[bytes]:
    """The records of an ISO 2709 file, by their five-digit lengths."""
    out, at = [], 0
    while at + 24 <= len(raw) and raw[at : at + 5].isdigit() and int(raw[at : at + 5]) >= 24:
        n = int(raw[at : at + 5])
        out.append(raw[at : at + n])
        at += n
    return out


def marcxml_events(text: str) -> Iterator[Event]:
    """Events of one ISO 2709 record in the shape of MARCXML: leader, controlfield and datafield elements with tag attributes."""
    depth, tag = 0, ""
    for what, value, attrs in marc_events(text):
        if what == "start":
            depth += 1
            if depth == 1 or value == "leader":
                yield "start", value, {}
            elif depth == 2:
                tag = value
                yield "start", "datafield" if attrs else "controlfield", {"tag": value, **attrs}
            else:
                yield "start", "subfield", {"code": value}
        elif what == "end":
            yield "end", {1: "record", 2: "leader" if value == "leader" else "controlfield" if tag < "010" else "datafield"}.get(depth, "subfield"), None
            depth -= 1
        else:
            yield what, value, attrs


#: Event readers by the name of a record form.
EVENTS: dict[str, Callable[[str], Iterator[Event]]] = {}


def events_of(form: str) -> Callable[[str], Iterator[Event]]:
    """The event reader of a dotted form, by its longest known part; plain texts are one element."""
    parts = form.split(".")
    for n in range(len(parts), 0, -1):
        for key in (".".join(parts[:n]), ".".join(parts[len(parts) - n :])):
            if key in EVENTS:
                return EVENTS[key]
    return lambda text: iter((("start", "text", {}), ("text", text, None), ("end", "text", None)))


def read_status(records: DataFrame, form: str, sysno: str = "sysno", text: str = "text") -> DataFrame:
    """(sysno, status, detail) of every record: OK, ERROR with the reason, or SKIP for an empty one."""
    strict = strict_xml_events if form.rpartition(".")[2] == "xml" else events_of(form)

    def one(raw: str | None) -> tuple[str, str | None]:
        if not (raw or "").strip():
            return "SKIP", None
        try:
            return ("OK", None) if next(iter(list(strict(raw))), None) else ("ERROR", "no record")
        except Malformed as e:
            return "ERROR", str(e)

    def run(frames):
        for frame in frames:
            got = [one(r) for r in frame["text"]]
            yield pd.DataFrame({"sysno": frame["sysno"], "status": [s for s, _ in got], "detail": [d for _, d in got]})

    return (
        dealt(records.select(F.col(sysno).cast("long").alias("sysno"), F.col(text).cast("string").alias("text")))
        .mapInPandas(run, "sysno long, status string, detail string")
    )


def marc_files(spark, path: str) -> DataFrame:
    """(filename, part, text): the records of ISO 2709 files. A file is one task's; its records are read one after the other."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"]):
                parts = marc_split(bytes(raw))
                for lo in range(0, len(parts), 1000):
                    own = parts[lo : lo + 1000]
                    yield pd.DataFrame({"filename": name, "part": range(lo, lo + len(own)), "text": [r.decode(errors="replace") for r in own]})

    return files.mapInPandas(run, "filename string, part long, text string")


def _nodes(events: Callable[[str], Iterator[Event]]) -> Callable[[DataFrame], DataFrame]:
    def read(records: DataFrame, sysno: str = "sysno", text: str = "text") -> DataFrame:
        def run(frames):
            for frame in frames:
                rows = []
                for key, raw in zip(frame["sysno"], frame["text"]):
                    stack, paths, n = [-1], [""], 0
                    for what, value, attrs in events(raw or ""):
                        if what == "end":
                            if len(stack) > 1:
                                stack.pop()
                                paths.pop()
                            continue
                        if what in ("comment", "pi"):
                            continue
                        path = f"{value}/{paths[-1]}" if what == "start" else paths[-1]
                        rows.append((key, n, stack[-1], len(stack) - 1, path, value if what == "start" else None, attrs or {}, None if what == "start" else value))
                        if what == "start":
                            stack.append(n)
                            paths.append(path)
                        n += 1
                yield pd.DataFrame(rows, columns=["sysno", "node", "parent", "depth", "path", "tag", "attrs", "text"])

        return dealt(records.select(F.col(sysno).cast("long").alias("sysno"), F.col(text).cast("string").alias("text"))).mapInPandas(run, NODES)

    return read


EVENTS.update({"sgml": sgml_events, "xml": xml_events, "marc": marc_events, "marcxml": marcxml_events})
sgml_nodes, xml_nodes, marc_nodes, marcxml_nodes = map(_nodes, (sgml_events, xml_events, marc_events, marcxml_events))

_POSTINGS = "idx_type string, idx_name string, term string, sysno long, seqno long"


_RULE = re.compile(r"(.*?)((?:\[[^\[\]]*@[^\[\]]*\])*)$", re.S)


def attribute_test(text: str) -> Callable[[dict[str, str]], bool]:
    """``@a``, ``@a='v'`` joined by ``and`` / ``or`` (and binds tighter)."""

    def one(part: str) -> Callable[[dict[str, str]], bool]:
        name, equal, value = part.strip().lstrip("@").partition("=")
        return lambda attrs: name.strip() in attrs and (not equal or attrs[name.strip()] == value.strip().strip("'\""))

    either = [[one(p) for p in re.split(r"\s+and\s+", group)] for group in re.split(r"\s+or\s+", text)]
    return lambda attrs: any(all(t(attrs) for t in group) for group in either)


def compiled_rule(pattern: str, spec: str) -> tuple[re.Pattern, list[Callable], list[tuple[str, str]]]:
    """A rule ``path pattern[@a='v' and @b]`` and its ``name:type`` entries."""
    path, tests = _RULE.match(pattern).groups()
    return re.compile(path), [attribute_test(t) for t in re.findall(r"\[([^\]]*)\]", tests)], [tuple(e.rsplit(":", 1)) if ":" in e else (e, "w") for e in spec.split()]


def _tree_tokens(key: int, events: Iterator[Event], rules: list[tuple[re.Pattern, list[Callable], list[tuple[str, str]]]], xpath: bool) -> list[tuple]:
    """Pre-order walk: tag position, attributes at the tag's position, text tokens by the nearest ruled ancestor, end tag."""
    out, at, paths, ruled = [], 1, [""], [[]]

    def put(name: str, code: str, text: str, base: int) -> int:
        kind, words = FIELD_TYPES[code], query_terms(text, FIELD_TYPES[code])
        if words and kind.first_in_field:
            words = [FIRST_MARK, *words]
        out.extend((code, name, w, key, base + i) for i, w in enumerate(words))
        return base + len(words)

    for what, value, attrs in events:
        if what == "start":
            paths.append(f"{value}/{paths[-1]}")
            ruled.append(next((spec for pattern, tests, spec in rules if pattern.fullmatch(paths[-1]) and all(t(attrs or {}) for t in tests)), ruled[-1]))
            if xpath:
                out.append(("0", "_XPATH_BEGIN", paths[-1], key, at))
                for name, v in (attrs or {}).items():
                    out += [("0", "_XPATH_ATTR", name, key, at), ("0", "_XPATH_ATTR", f"{name}={v}", key, at)]
                at += 1
                for name, v in (attrs or {}).items():
                    out.append(("0", "_XPATH_BEGIN", f"@{name}/{paths[-1]}", key, at))
                    at = put("_XPATH_ATTR_CDATA", "w", v, at + 1)
                    out.append(("0", "_XPATH_END", f"@{name}/{paths[-1]}", key, at))
                    at += 1
        elif what == "text":
            most = at
            for name, code in ruled[-1]:
                most = max(most, put(name, code, value, at))
            at = most
            if xpath:
                at = put("_XPATH_CDATA", "w", value, at)
        elif what == "end" and len(paths) > 1:
            if xpath:
                out.append(("0", "_XPATH_END", paths[-1], key, at))
                at += 1
            paths.pop()
            ruled.pop()
    return out


def tree_postings(records: DataFrame, rules: dict[str, str], form: str = "sgml", xpath: bool = True, db: str = "Default") -> DataFrame:
    """Postings of (sysno, text) records. rules: pattern over reversed paths -> ``"title:w title:p any:w"``.

    The first rule whose pattern matches an element's whole reversed path, and whose tests of attributes
    (``pattern[@a='v' or @b]``) hold, counts for it and for the elements below that have none of their own.
    All entries of a rule start at the same position. Equal terms at one position are one.
    """
    events = events_of(form)
    compiled = [compiled_rule(p, spec) for p, spec in rules.items()]

    def run(frames):
        for frame in frames:
            rows = [t for key, raw in zip(frame["sysno"], frame["text"]) for t in _tree_tokens(key, events(raw or ""), compiled, xpath)]
            yield pd.DataFrame(rows, columns=["idx_type", "idx_name", "term", "sysno", "seqno"])

    tokens = dealt(records.select(F.col("sysno").cast("long"), F.col("text").cast("string"))).mapInPandas(run, _POSTINGS)
    zero = F.lit(0).cast("long")
    # a record's tokens come from one call, so equal ones could be dropped there; across rows of one number they are too
    return (
        tokens
        .distinct()
        .select(F.lit(db).alias("db"), F.lit("index").alias("cat"), "idx_type", "idx_name", "term", zero.alias("static_rank"), "sysno", zero.alias("section_id"), zero.alias("segment"), "seqno")
    )


def elements(nodes: DataFrame, want: list[str], drop: list[str] = ()) -> DataFrame:
    """Element-set projection: text (sysno, path, text) below the wanted path patterns and not below dropped ones."""
    text = nodes.where("tag is null")
    keep = F.lit(False)
    for p in want:
        keep = keep | F.col("path").rlike(f"(^|/){p}")
    for p in drop:
        keep = keep & ~F.col("path").rlike(f"(^|/){p}")
    return text.where(keep).select("sysno", "node", "path", "text")


# ---- writers


def to_text(events: Iterator[Event]) -> str:
    """Indented lines ``tag: text``."""
    out, depth = [], 0
    for what, value, _ in events:
        if what == "start":
            out.append("  " * depth + value + ":")
            depth += 1
        elif what == "end":
            depth -= 1
        elif what == "text" and value.strip():
            out[-1:] = [out[-1] + " " + value.strip()] if out and out[-1].endswith(":") else [*out[-1:], "  " * depth + value.strip()]
    return "\n".join(out)


def to_marc(fields: list[tuple[str, str, list[tuple[str, str]]]], leader: str = "00000nam a2200000 a 4500") -> bytes:
    """ISO 2709 of (tag, indicators, subfields); a control field has one subfield with an empty code."""
    directory, body = b"", b""
    for tag, indicators, subs in fields:
        data = (subs[0][1] if subs and not subs[0][0] else indicators.ljust(2)[:2] + "".join(f"\x1f{c}{v}" for c, v in subs)).encode() + b"\x1e"
        directory += f"{tag:>3.3}{len(data):04}{len(body):05}".encode()
        body += data
    base = 24 + len(directory) + 1
    head = f"{base + len(body) + 1:05}{leader[5:12]}{base:05}{leader[17:24]}".encode()
    return head + directory + b"\x1e" + body + b"\x1d"


def marc_of_tree(root: Node) -> bytes:
    """ISO 2709 of a record tree, in either shape: tags as element names, or MARCXML."""
    top = next((n for n in root.elements() if n.tag == "record"), root)
    fields, leader = [], "00000nam a2200000 a 4500"
    for f in top.elements():
        tag = f.attrs.get("tag", f.tag)
        if tag == "leader":
            leader = f.value().ljust(24)[:24]
            continue
        subs = [(s.attrs.get("code", s.tag), s.value()) for s in f.elements()]
        fields.append((tag, f.attrs.get("ind1", " ") + f.attrs.get("ind2", " "), subs or [("", f.value())]))
    return to_marc(fields, leader)

