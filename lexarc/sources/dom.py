"""The document pipeline: XML or MARC input, rules that mark what to index, and the harvest of marks into postings.

A record tree says what to index either by elements ``index name="title:w any:w"``, ``group unit="u"`` and
``record id= rank= type=``, in any namespace whose address ends in ``-2.0``, or by processing instructions
``<?…-2.0 index title:w?>`` for the text of the element around them and ``<?…-2.0 record id=… rank=…?>``. There is no
stylesheet engine: a table of rules (path to index entries) makes the marks instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import FIELD_TYPES, FIRST_MARK, query_terms
from ..index import Index
from ..storage import dealt, kept
from . import markup
from .tree import Node, events, to_xml, tree

ACTIONS = ("insert", "update", "replace", "delete", "adelete")
_PI = re.compile(r".*-2\.0$")


@dataclass
class Rules:
    """index: pattern over reversed paths ``b/a/`` (with ``[@a='v']`` tests) -> entries ``title:w any:w``. groups: pattern -> unit.
    record: where id, rank and type are found, as paths ``a/b`` or ``a/@b`` from the root; record None takes every record."""

    index: dict[str, str] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=dict)
    record: dict[str, str] | None = None


@dataclass
class Harvest:
    record_id: str | None = None
    rank: int = 0
    action: str = "update"
    seen: bool = False
    tokens: list[tuple[str, str, str, int]] = field(default_factory=list)  # type, name, term, position
    sorts: list[tuple[str, str, str]] = field(default_factory=list)


def split(text: str, level: int = 0) -> list[str]:
    """The subtrees at a depth as records of their own; 0 is the whole document. A document that cannot be read raises Malformed."""
    root = tree(markup.strict_xml_events(text))
    nodes = [root]
    if not level:
        return [to_xml(events(root))]
    for _ in range(level + 1):
        nodes = [c for n in nodes for c in n.elements()]
    return [to_xml(events(Node("", children=[n]))) for n in nodes]


def _compiled(rules: Rules) -> tuple[list, list]:
    return [markup.compiled_rule(p, s) for p, s in rules.index.items()], [(*markup.compiled_rule(p, "")[:2], u) for p, u in rules.groups.items()]


def marked(root: Node, rules: Rules, ready: tuple[list, list] | None = None) -> Node:
    """The record with marks where the rules say so. ``ready``: the rules as ``_compiled`` makes them, where many records follow."""
    compiled, units = ready or _compiled(rules)
    fits = lambda rule, path, node: rule[0].fullmatch(path) and all(t(node.attrs) for t in rule[1])

    def walk(node: Node, path: str) -> Node:
        children = [c if c.tag is None or c.tag[0] in "!?" else walk(c, f"{c.tag}/{path}") for c in node.children]
        out = Node(node.tag, node.attrs, children=children)
        if entry := next((r for r in compiled if fits(r, path, node)), None):
            out = Node(node.tag, node.attrs, children=[Node("index", {"name": " ".join(":".join(e) for e in entry[2]), "_own": "1"}, children=children)])
        if unit := next((r for r in units if fits(r, path, node)), None):
            out = Node("group", {"unit": unit[2], "_own": "1"}, children=[out])
        return out

    out = Node("", children=[walk(c, f"{c.tag}/") if c.tag and c.tag[0] not in "!?" else c for c in root.children])
    if rules.record is not None:
        found = {}
        for name, where in rules.record.items():
            path, _, attribute = where.partition("@")
            nodes = root.find(path)
            if nodes and (value := nodes[0].attrs.get(attribute) if attribute else nodes[0].value().strip()):
                found[name] = value
        if found or not rules.record:
            out = Node("", children=[Node("record", {**found, "_own": "1"}, children=out.children)])
    return out


def harvest(root: Node, everything: bool = False) -> Harvest:
    """What the marks of a record say. All entries of an index mark begin at the same position, the next goes on after the
    longest; a group's beginning and end take a position each. A record without a record mark is to be skipped unless
    ``everything``; an unknown action raises Malformed."""
    out, at = Harvest(seen=everything), 1

    def control(attrs: dict[str, str]) -> None:
        out.seen = True
        out.record_id = attrs.get("id", out.record_id)
        if (rank := attrs.get("rank", "")).lstrip("-").isdigit():
            out.rank = int(rank)
        out.action = attrs.get("type", out.action)
        if out.action not in ACTIONS:
            raise markup.Malformed(f"no action {out.action}")

    def put(entries: str, text: str) -> None:
        nonlocal at
        most = at
        for entry in entries.split():
            name, _, code = entry.partition(":")
            kind = FIELD_TYPES.get(code or "w")
            if kind is None:
                raise markup.Malformed(f"no field type {code}")
            words = query_terms(text, kind)
            if kind.sort:
                out.sorts += [(kind.code, name, w) for w in words]
                continue
            if words and kind.first_in_field:
                words = [FIRST_MARK, *words]
            out.tokens += [(kind.code, name, w, at + i) for i, w in enumerate(words)]
            most = max(most, at + len(words))
        at = most

    def walk(node: Node) -> None:
        nonlocal at
        for c in node.children:
            if c.tag is None or c.tag == "!":
                continue
            if c.tag[0] == "?":
                if _PI.match(c.tag[1:]):
                    word, _, rest = c.text.strip().partition(" ")
                    if word == "record":
                        control({k: a or b or d for k, a, b, d in re.findall(r"(\w+)=(?:\"([^\"]*)\"|'([^']*)'|(\S+))", rest)})
                    elif word == "index":
                        put(rest, node.value())
                continue
            if c.tag == "record" and {"id", "rank", "type", "_own"} & set(c.attrs):
                control(c.attrs)
            if c.tag == "group" and "unit" in c.attrs:
                out.tokens.append(("w", f"_GROUP_{c.attrs['unit']}", "begin", at))
                at += 1
                walk(c)
                out.tokens.append(("w", f"_GROUP_{c.attrs['unit']}", "end", at))
                at += 1
                continue
            if c.tag == "index" and "name" in c.attrs:
                put(c.attrs["name"], c.value())
            walk(c)

    walk(root)
    return out


def _harvested(text: str | None, rules: Rules | None, form: str, ready: tuple[list, list] | None = None) -> tuple[Harvest | None, str]:
    """The harvest and OK, SKIP or the reason of an error."""
    if not (text or "").strip():
        return None, "SKIP"
    try:
        root = tree(markup.strict_xml_events(text) if form == "xml" else markup.events_of(form)(text))
        out = harvest(marked(root, rules, ready) if rules else root, everything=rules is not None and rules.record is None)
    except markup.Malformed as e:
        return None, f"ERROR {e}"
    return (out, "OK") if out.seen else (None, "SKIP")


def dom_records(files: DataFrame, level: int = 0, form: str = "xml") -> DataFrame:
    """(filename, part, text, status): the records of (filename, text) documents; ``form`` marc reads ISO 2709 into MARCXML."""

    def run(frames) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, text in zip(frame["filename"], frame["text"]):
                try:
                    parts = [to_xml(markup.marcxml_events(r.decode(errors="replace"))) for r in markup.marc_split((text or "").encode())] if form == "marc" else split(text or "", level)
                    rows += [(name, i, p, "OK") for i, p in enumerate(parts)]
                except markup.Malformed as e:
                    rows.append((name, None, None, f"ERROR {e}"))
            yield pd.DataFrame(rows, columns=["filename", "part", "text", "status"]).astype({"part": "Int64"})

    return dealt(files.select("filename", F.col("text").cast("string"))).mapInPandas(run, "filename string, part long, text string, status string")


def dom_control(records: DataFrame, rules: Rules | None = None, form: str = "xml") -> DataFrame:
    """(sysno, match_key, static_rank, action, status) of (sysno, text) records, as their record marks say."""

    def run(frames) -> Iterator[pd.DataFrame]:
        ready = _compiled(rules) if rules else None
        for frame in frames:
            rows = []
            for key, text in zip(frame["sysno"], frame["text"]):
                h, status = _harvested(text, rules, form, ready)
                rows.append((key, h.record_id if h else None, h.rank if h else 0, h.action if h else None, status))
            yield pd.DataFrame(rows, columns=["sysno", "match_key", "static_rank", "action", "status"])

    return (
        dealt(records.select(F.col("sysno").cast("long"), F.col("text").cast("string")))
        .mapInPandas(run, "sysno long, match_key string, static_rank long, action string, status string")
    )


def _marks(records: DataFrame, rules: Rules | None, form: str) -> DataFrame:
    def run(frames) -> Iterator[pd.DataFrame]:
        ready = _compiled(rules) if rules else None
        for frame in frames:
            rows = []
            for key, text in zip(frame["sysno"], frame["text"]):
                h, _ = _harvested(text, rules, form, ready)
                if h and h.action not in ("delete", "adelete"):
                    rows += [(key, h.rank, code, name, term, at) for code, name, term, at in dict.fromkeys(h.tokens)]
                    rows += [(key, h.rank, code, name, term, 0) for code, name, term in h.sorts]
            yield pd.DataFrame(rows, columns=["sysno", "static_rank", "idx_type", "idx_name", "term", "seqno"])

    return (
        dealt(records.select(F.col("sysno").cast("long"), F.col("text").cast("string")))
        .mapInPandas(run, "sysno long, static_rank long, idx_type string, idx_name string, term string, seqno long")
    )


def _postings(marks: DataFrame, db: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return marks.where("seqno > 0").select(F.lit(db).alias("db"), F.lit("index").alias("cat"), "idx_type", "idx_name", "term", "static_rank", "sysno", zero.alias("section_id"), zero.alias("segment"), "seqno")


def _sortkeys(marks: DataFrame, db: str) -> DataFrame:
    return (
        marks
        .where("seqno = 0")
        .groupBy("idx_type", "idx_name", "sysno")
        .agg(F.collect_list("term").alias("values"))
        .select(F.lit(db).alias("db"), "idx_type", "idx_name", "sysno", "values")
    )


def dom_postings(records: DataFrame, rules: Rules | None = None, db: str = "Default", form: str = "xml") -> DataFrame:
    """Postings of (sysno, text) records; skipped, deleted and unreadable ones have none (``dom_control`` tells which)."""
    return _postings(_marks(records, rules, form), db)


def dom_sortkeys(records: DataFrame, rules: Rules | None = None, db: str = "Default", form: str = "xml") -> DataFrame:
    """Sort keys of the same records."""
    return _sortkeys(_marks(records, rules, form), db)


def dom_index(records: DataFrame, rules: Rules | None = None, db: str = "Default", form: str = "xml") -> Index:
    """Both, of records that are read once and whose marks are written, so that no search reads them again."""
    marks = kept(_marks(records, rules, form), "marks")
    return Index(records, _postings(marks, db), _sortkeys(marks, db))


def retrieved(rows: DataFrame, views: dict[str, dict[str, str]], view: str) -> DataFrame:
    """(db, sysno, record) of (db, sysno, raw, …): a named view is an element with children ``name: path``; names in
    ``$id $filename $rank $schema $score $size`` take the columns of the rows."""
    wanted = views[view]
    columns = sorted({p[1:] for p in wanted.values() if p.startswith("$")} & set(rows.columns))

    @F.pandas_udf("string")
    def write(raw: pd.Series, known: pd.DataFrame) -> pd.Series:
        out = []
        for i, text in enumerate(raw):
            root = tree(markup.xml_events(text or ""))
            top = Node(view)
            for name, path in wanted.items():
                if path.startswith("$"):
                    values = [len((text or "").encode())] if path == "$size" and "size" not in known else [view] if path == "$schema" else [known[path[1:]].iloc[i]] if path[1:] in known else []
                else:
                    values = [n.value() for n in root.find(path)]
                top.children += [Node(name, children=[Node(None, text=str(v))]) for v in values]
            out.append(to_xml(events(top)))
        return pd.Series(out, dtype=object)

    packed = F.struct(*[F.col(c).cast("string").alias(c) for c in columns], F.lit("").alias("_"))
    return dealt(rows.select("db", "sysno", "raw", packed.alias("_known"))).select("db", "sysno", write("raw", "_known").alias("record"))
