"""Browsing terms, facets and snippets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import FIRST_MARK
from ..index import Index
from .combine import RECORD


def _postings(index: Index, wanted) -> DataFrame:
    return index.postings.where(wanted & (F.col("cat") == "index") & (F.col("term") != FIRST_MARK))


def scan(index: Index, idx_name: str, idx_type: str, term: str, position: int, number: int, limit_to: DataFrame | None = None, dbs: list[str] | None = None, display: bool = False) -> DataFrame:
    """(entry, term, docs): up to ``number`` terms in order, the first that is not before ``term`` being entry ``position``.

    The terms are picked first and only these are counted; terms without a record (of ``limit_to``) are not
    there. With ``display`` a column shows each term as its first record writes it.
    """
    named = (F.col("idx_type") == idx_type) & (F.col("idx_name") == idx_name)
    named = named if dbs is None else named & F.col("db").isin(dbs)
    if limit_to is None:
        own = index.dictionary().where(named)
        count, distinct = F.sum("docs"), own
    else:
        own = _postings(index, named).join(limit_to.select(*RECORD).distinct(), RECORD, "left_semi").select("term", *RECORD).distinct()
        count, distinct = F.count("*"), own
    after, before = max(0, number - position + 1), max(0, position - 1)

    def side(where, order, most: int, entry) -> DataFrame:
        few = distinct.where(where).select("term").distinct().orderBy(order).limit(most).withColumn("entry", entry)
        return own.where(where).join(F.broadcast(few), "term").groupBy("term", "entry").agg(count.alias("docs"))

    up = side(F.col("term") >= term, F.asc("term"), after, F.row_number().over(Window.orderBy("term")) + (position - 1))
    down = side(F.col("term") < term, F.desc("term"), before, F.lit(position) - F.row_number().over(Window.orderBy(F.desc("term"))))
    out = up.unionByName(down).where(F.col("entry").between(1, number)).select(F.col("entry").cast("long").alias("entry"), "term", "docs")
    if display:
        out = (
            out
            .join(shown(index, idx_name, idx_type, out.select("term")), "term", "left")
            .select("entry", "term", "docs", F.coalesce("display", "term").alias("display"))
        )
    return out.orderBy("entry")


def shown(index: Index, idx_name: str, idx_type: str, terms: DataFrame) -> DataFrame:
    """(term, display) of a few terms: as the first record that has it writes it, analysed again without folding."""
    named = (F.col("idx_type") == idx_type) & (F.col("idx_name") == idx_name)
    first = (
        _postings(index, named)
        .join(F.broadcast(terms), "term")
        .groupBy("term")
        .agg(F.min(F.struct("static_rank", *RECORD, "section_id", "seqno")).alias("at"))
        .select("term", "at.*")
    )
    raw = index.of_records(first, fold=False).postings.where(named).select(*RECORD, "section_id", "seqno", F.col("term").alias("display"))
    return first.join(raw, [*RECORD, "section_id", "seqno"], "left").select("term", "display")


def facets(index: Index, keys: DataFrame, fields: list[tuple[str, str]], n: int = 20, sample: DataFrame | None = None) -> DataFrame:
    """(idx_name, idx_type, term, coccur, occur): per field the n commonest terms of the hits.

    coccur counts occurrences in the sampled hits (all, where no sample is given), occur records of all
    hits. All fields share one pass; the order is occur, then term.
    """
    wanted = F.lit(False)
    for name, code in fields:
        wanted = wanted | (F.col("idx_name") == name) & (F.col("idx_type") == code)
    led, at = index.led is not None and index.led[0] is index.postings, ["sysno", "db"]  # a number first: its sort compares no texts
    own = _postings(replace(index, postings=index.led[1]) if led else index, wanted).join(keys.select(*at).distinct(), at, "left_semi")
    group = ["idx_name", "idx_type", "term"]
    if led:
        table = own.groupBy(*group).agg(F.count_if("lead").alias("occur"), F.count("*").alias("coccur"))
    else:
        table = own.groupBy(*group, *RECORD).agg(F.count("*").alias("c")).groupBy(*group).agg(F.count("*").alias("occur"), F.sum("c").alias("coccur"))
    if sample is not None:
        few = own.join(sample.select(*RECORD).distinct(), RECORD, "left_semi").groupBy(*group).agg(F.count("*").alias("coccur"))
        table = table.drop("coccur").join(few, group)
    place = F.row_number().over(Window.partitionBy("idx_name", "idx_type").orderBy(F.desc("occur"), "term"))
    return table.withColumn("place", place).where(F.col("place") <= n).select(*group, "coccur", "occur", F.col("place").cast("long").alias("place"))


def chunked(keys: DataFrame, most: int = 2) -> DataFrame:
    """The first ``most`` sections of every record, for facets of records in segments."""
    place = F.row_number().over(Window.partitionBy(*RECORD).orderBy("section_id"))
    return keys.select(*RECORD, "section_id").distinct().withColumn("_p", place).where(F.col("_p") <= most).drop("_p")


def sort_facets(index: Index, keys: DataFrame, name: str, n: int = 20) -> DataFrame:
    """(term, occur): the commonest values of a sort index among the hits."""
    values = index.sortkeys.where(F.col("idx_name") == name).join(keys.select(*RECORD).distinct(), RECORD, "left_semi")
    return values.select(F.explode("values").alias("term")).groupBy("term").agg(F.count("*").alias("occur")).orderBy(F.desc("occur"), "term").limit(n)


def snippets(index: Index, hits: DataFrame, idx_name: str, idx_type: str = "w", width: int = 4, others: tuple[str, ...] = ()) -> DataFrame:
    """(db, sysno, snippet): the words within ``width`` positions of a hit, hits marked with braces, gaps with dots.

    The words come from the hit records alone, analysed again. ``others`` names indexes whose terms at the
    same positions follow a word after a slash.
    """
    at = hits.select(*RECORD, "section_id", "seqno").distinct()
    unit = [*RECORD, "section_id"]
    window = (
        at
        .select(*unit, F.explode(F.sequence(F.col("seqno") - width, F.col("seqno") + width)).alias("seqno"), F.col("seqno").alias("hit"))
        .groupBy(*unit, "seqno")
        .agg(F.max(F.col("seqno") == F.col("hit")).alias("marked"))
    )
    own = index.of_records(at)
    words = _postings(own, (F.col("idx_name") == idx_name) & (F.col("idx_type") == idx_type)).select(*unit, "seqno", "term")
    show = words.join(window, [*unit, "seqno"])
    if others:
        more = (
            _postings(own, F.col("idx_name").isin(list(others)) & (F.col("idx_type") == idx_type))
            .groupBy(*unit, "seqno")
            .agg(F.array_join(F.array_sort(F.collect_set("term")), "/").alias("more"))
        )
        show = show.join(more, [*unit, "seqno"], "left").withColumn("term", F.concat_ws("/", "term", "more"))
    gap = F.col("seqno") - F.lag("seqno").over(Window.partitionBy(*RECORD).orderBy("section_id", "seqno")) > 1
    word = F.concat(F.when(gap, F.lit("... ")).otherwise(F.lit("")), F.when(F.col("marked"), F.concat(F.lit("{"), F.col("term"), F.lit("}"))).otherwise(F.col("term")))
    return (
        show
        .withColumn("word", word)
        .groupBy(*RECORD)
        .agg(F.array_sort(F.collect_list(F.struct("section_id", "seqno", "word"))).alias("w"))
        .select(*RECORD, F.concat_ws(" ", "w.word").alias("snippet"))
    )


def best_window(hits: DataFrame, width: int) -> DataFrame:
    """(db, sysno, seqno, n): the first position from which ``width`` positions hold most hits."""
    over = Window.partitionBy(*RECORD).orderBy("seqno").rangeBetween(0, width - 1)
    n = hits.select(*RECORD, "seqno").withColumn("n", F.count("*").over(over))
    return (
        n
        .groupBy(*RECORD)
        .agg(F.max(F.struct("n", (-F.col("seqno")).alias("s"))).alias("b"))
        .select(*RECORD, (-F.col("b.s")).alias("seqno"), "b.n")
    )
