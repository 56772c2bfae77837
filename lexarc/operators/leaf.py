"""One term with its attributes to keys."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import FIRST_MARK, ICU, MOST_QUERY_TERM, FieldType, query_terms
from ..index import ALL_RECORDS, Index, all_records, always_matches
from ..plans.attributes import Leaf
from ..plans.prefix import Diagnostic
from . import combine

_REGEX_SIGNS = set("\\.[]()*+?|^$-{}")


@dataclass(frozen=True)
class Part:
    """One term of a leaf. ``where`` picks its postings; expanded: it stands for several index terms."""

    term_id: int
    expanded: bool
    where: Column | None
    keys: DataFrame


def masked(term: str, truncation: int) -> str | None:
    """The pattern of a truncation attribute; None for plain equality."""
    q = re.escape
    if truncation == 101:
        return "".join(".*" if c == "#" else q(c) for c in term)
    if truncation == 102:
        return term
    if truncation == 104:
        out = re.sub(r"\?(\d{1,2})|([?*#])|([^?*#]+)", lambda m: f".{{0,{min(20, int(m[1]))}}}" if m[1] else {"?": ".*", "*": ".*", "#": "."}[m[2]] if m[2] else q(m[3]), term)
        return out
    if truncation in (105, 106):
        return "".join({"*": ".*", "!": "."}.get(c, q(c)) for c in term) + (".*" if truncation == 105 else "")
    return None


def folded(pattern: str) -> str:
    """A pattern in small letters, but for escapes (``\\D`` is not ``\\d``) and the names of classes."""
    return re.sub(r"\\[pP]\{\w+\}|\\x\{\w+\}|\\[\s\S]|[^\\]+", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


def _checked(spark, pattern: str) -> str:
    """The pattern, if the engine that will match it can read it; else diagnostic 120."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise Diagnostic(120, str(e).splitlines()[0]) from None
    return pattern


def with_errors(index: Index, leaf: Leaf, pattern: str, errors: int) -> DataFrame:
    """(term) of the index that match a pattern with so many insertions, deletions and substitutions: over distinct terms only."""
    import regex

    try:
        regex.compile(pattern)
    except regex.error as e:
        raise Diagnostic(120, str(e)) from None
    whole = f"(?:{pattern}){{e<={errors}}}"

    @F.pandas_udf("boolean")
    def fits(terms: pd.Series) -> pd.Series:
        program = regex.compile(whole)
        return terms.map(lambda t: bool(program.fullmatch(t)))

    own = index.dictionary().where((F.col("idx_type") == leaf.kind) & (F.col("idx_name") == leaf.index))
    return own.select("term").distinct().where(fits("term")).select("term")


def term_filter(spark, term: str, leaf: Leaf, kind: FieldType) -> Column:
    """The predicate on column term."""
    col, value = F.col("term"), F.lit(term)
    if kind.icu:
        if leaf.truncation not in (1, 2, 3, 100, 102):
            raise Diagnostic(120, f"truncation {leaf.truncation} of collated terms")
        if leaf.truncation != 102:
            col, value = F.collate(col, ICU), F.collate(value, ICU)
    if leaf.truncation == 1:
        return F.startswith(col, value)
    if leaf.truncation == 2:
        return F.endswith(col, value)
    if leaf.truncation == 3:
        return F.contains(col, value)
    if leaf.truncation == 103:
        errors, term = _errors(term)
        return F.levenshtein(col, F.lit(term), errors) >= 0
    if (pattern := masked(term, leaf.truncation)) is not None:
        return col.rlike(_checked(spark, f"^(?:{pattern})$"))
    if leaf.relation in (1, 2, 4, 5):
        return {1: col < value, 2: col <= value, 4: col >= value, 5: col > value}[leaf.relation]
    if kind.charmap and (pattern := kind.charmap.alternatives(term)):
        return col.rlike(f"^(?:{pattern})$")
    return col == value


def _errors(term: str) -> tuple[int, str]:
    m = re.match(r"\+(\d)\+(.*)", term, re.S)
    return (min(3, int(m[1])), m[2]) if m else (1, term)


def own_postings(index: Index, leaf: Leaf, dbs: list[str] | None) -> DataFrame:
    own = index.postings.where((F.col("idx_type") == leaf.kind) & (F.col("idx_name") == leaf.index) & (F.col("cat") == "index"))
    return own if dbs is None else own.where(F.col("db").isin(dbs))


def _keys(rows: DataFrame, term_id: int) -> DataFrame:
    return rows.withColumn("term_id", F.lit(term_id)).select(*combine.KEY)


def keys(index: Index, term: str, leaf: Leaf, dbs: list[str] | None, first_id: int) -> tuple[DataFrame, list[Part]]:
    """Keys of the leaf, and its terms."""
    spark = index.postings.sparkSession
    empty = _keys(index.postings.limit(0), first_id)
    if leaf.nothing:
        return empty, []
    if len(term.encode()) > MOST_QUERY_TERM:
        raise Diagnostic(11, "term too long")
    named = lambda rows: rows if dbs is None else rows.where(F.col("db").isin(dbs))
    if leaf.strategy == "local" or leaf.index == ALL_RECORDS:
        found = named(all_records(index))
        if leaf.strategy == "local":
            found = found.where(F.col("sysno") == (int(term) if term.strip().isdigit() else -1))
        found = _keys(found, first_id)
        return found, [Part(first_id, leaf.index == ALL_RECORDS, None, found)]
    own = own_postings(index, leaf, dbs)
    if leaf.always:
        found = _keys(named(always_matches(index, leaf.index, leaf.kind)), first_id)
        return found, [Part(first_id, True, None, found)]
    parts: list[Part] = []
    if leaf.strategy == "numeric":
        value = F.col("term").try_cast("bigint")
        tests = {1: value.__lt__, 2: value.__le__, 3: value.__eq__, 102: value.__eq__, 4: value.__ge__, 5: value.__gt__}[leaf.relation]
        for i, n in enumerate(re.findall(r"-?\d+", term)):
            where = tests(F.lit(int(n)))
            parts.append(Part(first_id + i, True, where, _keys(own.where(where), first_id + i)))
    else:
        kind = index.field_type(leaf.kind)
        pattern = leaf.truncation in (101, 102, 103, 104, 105, 106)
        exact = kind.separators is None and not kind.icu
        raw = [term if exact else folded(term) if leaf.truncation in (102, 103) else term.lower()] if pattern else query_terms(term, kind)
        expanded = leaf.truncation != 100 or leaf.relation in (1, 2, 4, 5)
        for i, t in enumerate(raw):
            if leaf.truncation == 103 and _REGEX_SIGNS & set(_errors(t)[1]) and not kind.icu:
                match, where = own.join(with_errors(index, leaf, _errors(t)[1], _errors(t)[0]), "term", "left_semi"), None
            else:
                where = (F.col("term") != FIRST_MARK) & term_filter(spark, t, leaf, kind)
                match = own.where(where)
            if expanded and leaf.most_terms:  # stop after so many terms, in their order
                match, where = match.join(first_terms(index, leaf, match, where), "term", "left_semi"), None
            parts.append(Part(first_id + i, expanded, where, _keys(match, first_id + i)))
    if not parts:
        return empty, []
    frames = [p.keys for p in parts]
    if len(frames) == 1:
        found = frames[0]
    elif leaf.strategy == "or-list":
        found = combine.union(frames)
    elif leaf.strategy in ("and-list", "numeric"):
        found = combine.intersect(frames)
    else:
        found = combine.phrase(frames)
    if leaf.position in (1, 2):
        if not index.field_type(leaf.kind).first_in_field:
            raise Diagnostic(119, "the index has no first-in-field mark")
        marks = own.where(F.col("term") == FIRST_MARK).select(*combine.UNIT, (F.col("seqno") + len(frames)).alias("seqno"))
        found = found.join(marks, [*combine.UNIT, "seqno"], "left_semi").select(*combine.KEY)
    return found, parts


def first_terms(index: Index, leaf: Leaf, match: DataFrame, where: Column | None) -> DataFrame:
    """The terms that an expansion of at most ``leaf.most_terms`` (less one) takes, from the table of terms where it can."""
    if where is not None and index.term_table is not None:
        match = index.dictionary().where((F.col("idx_type") == leaf.kind) & (F.col("idx_name") == leaf.index) & where)
    return match.select("term").distinct().orderBy("term").limit(max(0, leaf.most_terms - 1))


def one_scan(index: Index, leaves: list[tuple[Leaf, Part]], dbs: list[str] | None) -> DataFrame:
    """Keys of several one-term leaves by one pass over the postings, with ``child``: the leaf's place in the list."""
    tests = [(F.col("idx_type") == leaf.kind) & (F.col("idx_name") == leaf.index) & part.where for leaf, part in leaves]
    wanted = tests[0]
    for t in tests[1:]:
        wanted = wanted | t
    own = index.postings.where((F.col("cat") == "index") & wanted)
    own = own if dbs is None else own.where(F.col("db").isin(dbs))
    ids = F.filter(F.array(*[F.when(t, F.struct(F.lit(p.term_id).alias("term_id"), F.lit(i).alias("child"))) for i, (t, (_, p)) in enumerate(zip(tests, leaves))]), lambda x: x.isNotNull())
    rows = own.withColumn("_m", F.explode(ids))
    return rows.select(*[c for c in combine.KEY if c != "term_id"], F.col("_m.term_id").alias("term_id"), F.col("_m.child").alias("child"))
