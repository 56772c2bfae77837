"""Ranking, sorting, counting: key tables to records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .combine import RECORD

MOST_INT = 2147483647


@dataclass(frozen=True)
class TermInfo:
    """A leaf's part in ranking. n: keys of the term in the whole index (also a column); 0 for an expanded term."""

    term_id: int
    ranked: bool
    weight: int
    n: int | Column
    term: str = ""


def log2(x: Column) -> Column:
    """Whole base-2 logarithm, 0 for 0."""
    return F.greatest(F.length(F.bin(x)) - 1, F.lit(0)).cast("long")


def _integer_log2(n: int | Column) -> int | Column:
    return log2(n) if isinstance(n, Column) else max(0, n.bit_length() - 1)


def rank1(keys: DataFrame, info: list[TermInfo]) -> DataFrame:
    """(db, sysno, static_rank, score): occurrence in the record against occurrence in the index, by integer arithmetic."""
    ranked = [t for t in info if t.ranked]
    each = [F.count(F.when(F.col("term_id") == t.term_id, 1)) for t in ranked]
    per = (
        keys
        .groupBy(*RECORD)
        .agg(F.min("static_rank").alias("static_rank"), F.max("seqno").alias("last"), *(e.alias(f"lo{t.term_id}") for e, t in zip(each, ranked)))
    )
    total = F.lit(0).cast("long")
    for t in ranked:
        lo = F.col(f"lo{t.term_id}")
        total = total + F.when(lo > 0, (8 + log2(lo)) * ((32 - _integer_log2(t.n)) * t.weight)).otherwise(0)
    last = F.expr(f"last div {max(1, len(info))}")
    score = F.call_function("div", total, len(ranked) * (8 + log2(last))) if ranked else F.lit(-1)
    return per.select(*RECORD, "static_rank", F.least(score, F.lit(1000)).cast("int").alias("score"))


def rank2(keys: DataFrame, info: list[TermInfo]) -> DataFrame:
    """rank1 less the static rank."""
    return rank1(keys, info).withColumn("score", (F.col("score") - F.col("static_rank")).cast("int"))


def rank_static(keys: DataFrame, info: list[TermInfo]) -> DataFrame:
    """The greater, the smaller the static rank; -1 without a ranked term."""
    score = (F.lit(MOST_INT) - F.col("static_rank")).cast("int") if any(t.ranked for t in info) else F.lit(-1)
    return keys.groupBy(*RECORD).agg(F.min("static_rank").alias("static_rank")).withColumn("score", score)


HANDLERS = {"rank-1": rank1, "rank-2": rank2, "rank-static": rank_static, "rank-similarity": rank_static}


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n best; ties in read order."""
    return scored.orderBy(F.desc("score"), "static_rank", "db", "sysno").limit(n)


def hits(keys: DataFrame) -> DataFrame:
    """Number of records."""
    return keys.select(*RECORD).distinct().agg(F.count("*").alias("hits"))


def rounded_hits(n: int) -> int:
    """An approximate count as it is shown: above 1000, the leading digits only."""
    scale = 1
    while n > 1000:
        n, scale = n // 10, scale * 10
    return n * scale


def approximate_hits(keys: DataFrame, limit: int) -> DataFrame:
    """(hits, approximate): exact up to ``limit``; beyond, a sketch's estimate in its leading digits."""
    digits = F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))
    scale = F.pow(F.lit(10), F.when(F.floor(F.col("n") / F.pow(F.lit(10), digits)) > 1000, digits + 1).otherwise(digits)).cast("long")
    about = F.when(F.col("n") > 1000, F.floor(F.col("n") / scale).cast("long") * scale).otherwise(F.col("n"))
    counted = keys.agg(F.approx_count_distinct(F.struct(*RECORD), 0.02).alias("n"))
    few = hits(keys.select(*RECORD).distinct().limit(limit + 1)).select(F.col("hits").alias("few"))
    both = counted.select("*", few.scalar().alias("few"))
    return both.select(F.when(F.col("few") <= limit, F.col("few")).otherwise(about).alias("hits"), (F.col("few") > limit).alias("approximate"))


def term_hits(keys: DataFrame) -> DataFrame:
    """Records of each leaf."""
    return keys.select("term_id", *RECORD).distinct().groupBy("term_id").agg(F.count("*").alias("hits"))


@dataclass(frozen=True)
class SortKey:
    """name: of the sort index; pick: first, or least / greatest by direction for repeated fields. most: characters compared, all by default."""

    name: str
    descending: bool = False
    numeric: bool = False
    repeated: bool = False
    most: int | None = None


def ordered(keys: DataFrame, sortkeys: DataFrame, by: list[SortKey]) -> DataFrame:
    """Records in the order of up to ten sort keys; a missing value comes first ascending, ties in read order."""
    if len(by) > 10:
        raise ValueError("at most ten sort keys")
    out = keys.groupBy(*RECORD).agg(F.min("static_rank").alias("static_rank"))
    order = []
    for i, k in enumerate(by):
        values = F.array_sort("values")
        value = F.element_at(values, -1 if k.descending else 1) if k.repeated else F.element_at("values", 1)
        shown = F.substring(F.col(f"v{i}"), 1, k.most) if k.most else F.col(f"v{i}")
        one = F.coalesce(F.expr(f"try_cast(v{i} as double)"), F.lit(0.0)) if k.numeric else shown
        side = sortkeys.where(F.col("idx_name") == k.name).select(*RECORD, value.alias(f"v{i}"))
        out = out.join(side, RECORD, "left")
        order.append(one.desc_nulls_last() if k.descending else one.asc_nulls_first())
    return out.select("static_rank", *RECORD, *[f"v{i}" for i in range(len(by))]).orderBy(*order, "static_rank", *RECORD)
