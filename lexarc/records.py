"""Fetching records: special element sets, text parts, and record syntaxes."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.analysis import FIRST_MARK
from .index import Index
from .operators import browse
from .operators.combine import RECORD
from .plans.prefix import Diagnostic
from .sources import markup, tree
from .storage import dealt

if TYPE_CHECKING:
    from .session import ResultSet

SYNTAXES = ("xml", "text", "sutrs", "soif", "grs-1", "summary", "explain", "marc")
#: Lines of a text that a brief and a medium element set show.
LINES = {"B": 4, "M": 20}


def escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _raw(index: Index) -> Column:
    name = next((c for c in ("raw", "text", "html") if c in index.records.columns), None)
    if name is None:
        raise Diagnostic(14, "the records are not stored")
    return F.col(name).cast("string")


def _column(index: Index, *names: str, default: Column) -> Column:
    return next((F.coalesce(F.col(n).cast("string"), default) for n in names if n in index.records.columns), default)


def fields_of(spec: str) -> list[tuple[str, str | None, int | None]]:
    """``title:w:10,any`` as (name, type, number)."""
    return [(p[0], p[1] if len(p) > 1 else None, int(p[2]) if len(p) > 2 and p[2].isdigit() else None) for p in (x.split(":") for x in spec.split(",") if x)]


def fetch(hits: ResultSet, elements: str, syntax: str = "xml", namespace: str | None = None) -> DataFrame:
    """(db, sysno, record) of every hit, or one row (record) for facets.

    ``prefix::data`` is the stored record; ``::meta[::field]`` its number, base, file, type, score, rank and size;
    ``::index[::name[:type],…]`` its terms with positions, or its sort keys; ``::snippet`` the words around hits;
    ``::facet::name:type[:n],…`` the commonest terms. Other names are parts of a text (``R H B M``) or, with a
    path such as ``title,a/b``, of a record tree, in the record syntax. An unknown element set raises
    diagnostic 25, an unknown syntax 238.
    """
    if syntax not in SYNTAXES:
        raise Diagnostic(238, syntax)
    special = elements.split("::")
    if len(special) > 1:
        kind, rest = special[1], "::".join(special[2:])
        makers = {"data": _data, "meta": _meta, "index": _index, "snippet": _snippet, "facet": _facet}
        if kind not in makers:
            raise Diagnostic(25, elements)
        return makers[kind](hits, rest, elements, syntax, f' xmlns="{namespace}"' if namespace else "")
    if elements in ("R", "H", "B", "M"):
        return _text(hits, elements)
    return rendered(hits.records().select(*RECORD, _raw(hits.index).alias("raw"), _column(hits.index, "file_type", default=F.lit("tree.xml")).alias("form")), elements, syntax)


def _data(hits: ResultSet, rest: str, elements: str, syntax: str, ns: str) -> DataFrame:
    return hits.records().select(*RECORD, _raw(hits.index).alias("record"))


def _facts(hits: ResultSet) -> DataFrame:
    index, null = hits.index, F.lit(None).cast("string")
    own = index.records.select(*RECORD, _column(index, "filename", default=null).alias("file"), _column(index, "file_type", default=null).alias("type"), _column(index, "raw", "text", "html", default=null).alias("_raw"))
    size = F.octet_length("_raw").cast("string")
    scores = (
        hits
        .scored()
        .select(*RECORD, F.when(F.col("score") >= 0, F.col("score")).cast("string").alias("score"), F.col("static_rank").cast("string").alias("rank"))
    )
    return (
        own
        .join(scores, RECORD)
        .select(*RECORD, F.col("sysno").cast("string").alias("_sysno"), F.col("db").alias("base"), "file", "type", "score", "rank", size.alias("size"))
    )


def _meta(hits: ResultSet, rest: str, elements: str, syntax: str, ns: str) -> DataFrame:
    known = ["sysno", "base", "file", "type", "score", "rank", "size"]
    if rest and rest not in known:
        raise Diagnostic(25, elements)
    wanted = [rest] if rest else known
    column = lambda n: F.col("_sysno" if n == "sysno" else n)
    if syntax in ("sutrs", "text"):
        parts = [column(n) if rest else F.concat(F.lit(n + " "), column(n), F.lit("\n")) for n in wanted]
        return _facts(hits).select(*RECORD, F.concat_ws("", *parts).alias("record"))
    parts = [F.concat(F.lit(f' {n}="'), escaped(column(n)), F.lit('"')) for n in wanted]
    named = "" if rest else f' set="{elements}"'
    return _facts(hits).select(*RECORD, F.concat(F.lit(f"<record{ns}"), F.concat_ws("", *parts), F.lit(named + "/>\n")).alias("record"))


def _index(hits: ResultSet, rest: str, elements: str, syntax: str, ns: str) -> DataFrame:
    index, wanted = hits.index, fields_of(rest)
    catalog = [(r["idx_name"], r["idx_type"]) for r in index.catalog().select("idx_name", "idx_type").distinct().collect()]
    catalog += [(r["idx_name"], r["idx_type"]) for r in index.sortkeys.select("idx_name", "idx_type").distinct().collect()]
    for name, code, _ in wanted:
        if not any(name == n and code in (None, t) for n, t in catalog):
            raise Diagnostic(25, elements)
    ids = hits.keys.select(*RECORD).distinct()
    test = F.lit(not wanted)
    for name, code, _ in wanted:
        test = test | (F.col("idx_name") == name) & (F.lit(code is None) | (F.col("idx_type") == F.lit(code)))
    own = index.of_records(ids, fold=False).postings.where(test & (F.col("term") != FIRST_MARK))
    rows = own.select(*RECORD, "idx_name", "idx_type", "seqno", F.col("term").alias("value"))
    keys = (
        index.sortkeys
        .where(test)
        .join(ids, RECORD, "left_semi")
        .select(*RECORD, "idx_name", "idx_type", F.lit(None).cast("long").alias("seqno"), F.explode("values").alias("value"))
    )
    if syntax in ("sutrs", "text"):
        line = F.concat_ws(" ", "idx_name", "idx_type", F.col("seqno").cast("string"), "value")
        head, tail = F.lit(""), F.lit("")
    else:
        at = F.coalesce(F.concat(F.lit(' seq="'), F.col("seqno").cast("string"), F.lit('"')), F.lit(""))
        line = F.concat(F.lit('  <index name="'), escaped(F.col("idx_name")), F.lit('" type="'), F.col("idx_type"), F.lit('"'), at, F.lit(">"), escaped(F.col("value")), F.lit("</index>"))
        head = F.concat(F.lit(f'<record{ns} sysno="'), F.col("sysno").cast("string"), F.lit(f'" set="{elements}">\n'))
        tail = F.lit("</record>\n")
    lines = (
        rows
        .unionAll(keys)
        .select(*RECORD, F.struct(F.coalesce("seqno", F.lit(0)).alias("s"), "idx_name", "idx_type", "value", line.alias("line")).alias("x"))
    )
    return (
        lines
        .groupBy(*RECORD)
        .agg(F.array_sort(F.collect_list("x")).alias("x"))
        .select(*RECORD, F.concat(head, F.array_join("x.line", "\n"), F.lit("\n"), tail).alias("record"))
    )


def _snippet(hits: ResultSet, rest: str, elements: str, syntax: str, ns: str) -> DataFrame:
    name = rest or "any"
    found = browse.snippets(hits.index, hits.keys, name)
    if syntax in ("sutrs", "text"):
        return found.select(*RECORD, F.col("snippet").alias("record"))
    shown = F.replace(F.replace(escaped(F.col("snippet")), F.lit("{"), F.lit("<s>")), F.lit("}"), F.lit("</s>"))
    return found.select(*RECORD, F.concat(F.lit(f'<record{ns}>\n  <snippet name="{name}" type="w">'), shown, F.lit("</snippet>\n</record>")).alias("record"))


def _facet(hits: ResultSet, rest: str, elements: str, syntax: str, ns: str) -> DataFrame:
    wanted = fields_of(rest)
    if not wanted:
        raise Diagnostic(25, elements)
    tables = []
    for i, (name, code, n) in enumerate(wanted):
        if code == "s":
            one = browse.sort_facets(hits.index, hits.keys, name, n or 20).select("term", F.col("occur").alias("coccur"), "occur")
        else:
            one = browse.facets(hits.index, hits.keys, [(name, code or "w")], n or 20).select("term", "coccur", "occur")
        tables.append(one.select(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(code or "w").alias("type"), "term", "coccur", "occur"))
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionAll(more)
    if syntax in ("sutrs", "text"):
        line = F.concat(F.col("term"), F.lit(" "), F.col("occur").cast("string"))
        block = lambda x: F.concat(F.lit("facet "), F.col("name"), F.lit(" "), F.col("type"), F.lit("\n"), x)
        wrap = lambda x: x
    else:
        line = F.concat(F.lit('    <term coccur="'), F.col("coccur").cast("string"), F.lit('" occur="'), F.col("occur").cast("string"), F.lit('">'), escaped(F.col("term")), F.lit("</term>"))
        block = lambda x: F.concat(F.lit('  <facet type="'), F.col("type"), F.lit('" index="'), F.col("name"), F.lit('">\n'), x, F.lit("\n  </facet>"))
        wrap = lambda x: F.concat(F.lit(f"<record{ns}>\n"), x, F.lit("\n</record>\n"))
    each = (
        rows
        .groupBy("i", "name", "type")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("occur")).alias("o"), "term", line.alias("line")))).alias("x"))
    )
    return (
        each
        .select("i", block(F.array_join("x.line", "\n")).alias("b"))
        .groupBy()
        .agg(wrap(F.array_join(F.array_sort(F.collect_list(F.struct("i", "b")))["b"], "\n")).alias("record"))
    )


def _text(hits: ResultSet, elements: str) -> DataFrame:
    """R: the whole text; H: what is known about it; B and M: its first lines."""
    index = hits.index
    raw = _raw(index)
    if elements in LINES:
        raw = F.array_join(F.slice(F.split(raw, "\n"), 1, LINES[elements]), "\n")
    head = F.concat(F.lit("<!-- Size: "), F.octet_length(_raw(index)).cast("string"), F.lit(" Database: "), F.col("db"), _column(index, "filename", default=F.lit("")), F.lit(" -->\n"))
    return hits.records().select(*RECORD, (raw if elements == "R" else head if elements == "H" else F.concat(head, raw)).alias("record"))


def record(raw: str, form: str, elements: str, syntax: str) -> str | None:
    """One stored record in an element set (``F`` or empty: all of it) and a syntax."""
    root = tree.tree(markup.events_of(form)(raw or ""))
    if elements not in ("", "F", "full"):
        root = tree.selected(root, [e for e in elements.split(",") if e])
    if syntax == "xml":
        return tree.to_xml(tree.events(root))
    if syntax in ("text", "sutrs"):
        return markup.to_text(tree.events(root))
    if syntax == "soif":
        return tree.to_soif(root)
    if syntax == "grs-1":
        return json.dumps([tree.to_nested(c) for c in root.elements()], ensure_ascii=False)
    if syntax == "summary":
        return json.dumps(tree.to_summary(root), ensure_ascii=False)
    if syntax == "marc":
        return markup.marc_of_tree(root).decode(errors="replace")
    return None


def rendered(rows: DataFrame, elements: str = "F", syntax: str = "xml") -> DataFrame:
    """(db, sysno, record) of (db, sysno, raw, form), in Arrow batches."""
    if syntax == "explain":
        raise Diagnostic(238, "explain records are views of the index, see Index.explain")

    @F.pandas_udf("string")
    def write(raw: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([record(r, f, elements, syntax) for r, f in zip(raw, form)], dtype=object)

    return dealt(rows.select(*RECORD, "raw", "form")).select(*RECORD, write("raw", "form").alias("record"))


def explain(index: Index) -> DataFrame:
    """(category, name, detail): what the index holds, as records of five categories."""
    catalog = index.catalog()
    parts = [
        catalog.sparkSession.createDataFrame([(c, c, "") for c in ("TargetInfo", "DatabaseInfo", "AttributeSetInfo", "AttributeDetails", "CategoryList")], "category string, name string, detail string").withColumn("category", F.lit("CategoryList")),
        catalog.groupBy().agg(F.count("*").alias("n")).select(F.lit("TargetInfo"), F.lit("indexes"), F.col("n").cast("string")),
        index.databases().select(F.lit("DatabaseInfo"), "db", F.concat(F.col("records").cast("string"), F.lit(" records, "), F.col("bytes").cast("string"), F.lit(" bytes"))),
        catalog.select(F.lit("AttributeSetInfo"), "idx_type", F.lit("")).distinct(),
        catalog.select(F.lit("AttributeDetails"), F.concat_ws(":", "db", "idx_name", "idx_type"), F.concat(F.col("doc_occ").cast("string"), F.lit(" records, "), F.col("term_occ").cast("string"), F.lit(" terms"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def by_record_id(index: Index, record_id: str, column: str = "record_id") -> DataFrame:
    """(db, sysno) of the records that carry an id of their own."""
    return index.records.where(F.col(column) == record_id).select(*RECORD).distinct()
