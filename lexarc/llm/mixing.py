"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected number of copies is its source's target over its source's size. The whole part is
taken; the fractional parts are rounded in pairs: words of probability mass move from one document of
the pair to the other, in a random direction that leaves both expectations as they are, until one of
the two is whole. Every task keeps one open document per source and bucket; these residuals meet in a
reduction tree, level by level, until one document per source is left. A source's taken words thus
differ from its target by less than the size of one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefilter import likely
from .store import scratch, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST_TIMES = (5, 2, 1), 3
BUCKET_ROWS, FAN_IN = 8192, 256
#: Sources up to which their table is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 50_000
_LEVEL = "doc_id long, source string, size long, source_size long, target double, whole long, part double, bucket long, h long, th long, rest long, n long, no_id boolean"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, size): shares by weight, none above MOST_TIMES its source.

    Sources in code point order, null last, weigh 5, 2, 1, 5, ... With the ratio of cap to weight
    ascending, those before the first that is not capped are capped, so one ordered pass finds the level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = totals.withColumn("_r", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", F.element_at(weights, (F.pmod(F.col("_r") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    before = everything.orderBy((F.col("source_size") / F.col("_w")), "_r").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.sum("_w").over(everything).alias("_weights"),
        (MOST_TIMES * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("_cap_before"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w_before"),
    ).withColumn("_capped", (MOST_TIMES * F.col("source_size")).cast("double") * (F.col("_weights") - F.col("_w_before")) < F.col("_w") * (F.col("_all") - F.col("_cap_before")).cast("double"))
    level = (F.col("_all") - MOST_TIMES * F.coalesce(F.sum(F.when(F.col("_capped"), F.col("source_size"))).over(everything), F.lit(0))) / (F.col("_weights") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_w"))).over(everything), F.lit(0)))
    return filled.withColumn("_level", level).select(
        "source", "source_size", F.when(F.col("_capped"), (MOST_TIMES * F.col("source_size")).cast("double")).otherwise(F.least(F.col("_w") * F.col("_level"), (MOST_TIMES * F.col("source_size")).cast("double"))).alias("target")
    )


def pivot(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """New parts of two documents of sizes s and t: p * s + q * t and both expectations stay, one part becomes 0 or 1."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    move = up if u * (up + down) < down else -down
    p, q = p + move / s, q - move / t
    first = min(p, 1 - p) / 1 <= min(q, 1 - q)
    return (float(round(p)), min(1.0, max(0.0, q))) if first else (min(1.0, max(0.0, p)), float(round(q)))


def _rounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of (bucket, source) runs: all decided but at most one of each run, whose part stays open."""
    key, carry = None, None

    def settled(row: list, part: float) -> list:
        return [*row[:5], row[5] + int(round(part)), math.nan, *row[7:]]

    for frame in frames:
        out = []
        for row in zip(*(frame[c].to_list() for c in frame.columns)):
            row = list(row)
            u, own = row.pop(), (row[7], row[1])
            if own != key:
                if carry:
                    out.append(carry)
                key, carry = own, None
            if not row[6] or row[6] != row[6] or not row[2]:
                out.append(settled(row, 0.0))
            elif carry is None:
                carry = row
            else:
                p, q = pivot(carry[6], carry[2], row[6], row[2], u)
                if p in (0.0, 1.0):
                    out.append(settled(carry, p))
                    carry = row if 0 < q < 1 else None
                    if carry:
                        carry[6] = q
                    else:
                        out.append(settled(row, q))
                else:
                    out.append(settled(row, q))
                    carry[6] = p
        if out:
            yield pd.DataFrame(out, columns=frame.columns[:-1])
    if carry:
        yield pd.DataFrame([carry], columns=[c.split()[0] for c in _LEVEL.split(", ")])


def _uniform(level: int):
    return (F.xxhash64("h", F.lit(level), F.lit("pivot")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).alias("u")


def _keyed(documents: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, th, rest): every row packed whole, and what tells it from others: a hash of its text and one of the other columns."""
    fields = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    row = F.struct(*[F.col(f"`{c}`") for c in fields])
    told = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in fields.items() if c != "text"]
    text = F.col("text").cast("string")
    return documents.select(
        row.alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("th"),
        F.xxhash64(F.lit("row"), *told).alias("rest"),
    )


def _decided(light: DataFrame) -> DataFrame:
    """(doc_id, source, size, th, rest, n, source_size, target, copies): rows of ``light`` that are equal are one, n of them with ``copies`` in all.

    Every level of the tree is a written table.
    """
    with scratch() as keep:
        light = keep(light.groupBy("doc_id", "source", "size", "th", "rest").agg(F.count("*").alias("n")), "distinct")
        goal = keep(targets(light.select("source", (F.col("size") * F.col("n")).alias("size"))), "targets").withColumnRenamed("source", "_source")
        goal = F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("n")).otherwise(0.0)
        buckets = max(1, math.ceil(light.count() / BUCKET_ROWS))
        h = F.xxhash64("doc_id", "th", "rest", F.lit("mixing"))
        rows = light.join(goal, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_f", ratio)
        rows = rows.select(
            F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "source", "size", "source_size", "target", F.floor("_f").alias("whole"), (F.col("_f") - F.floor("_f")).alias("part"),
            F.pmod(h, F.lit(buckets)).alias("bucket"), h.alias("h"), "th", "rest", "n", F.col("doc_id").isNull().alias("no_id"),
        )
        done, level = [], 0
        while True:
            dealt = rows.select("*", _uniform(level)).repartition("bucket" if level == 0 else F.xxhash64("bucket", "source")).sortWithinPartitions("bucket", "source", F.desc("size"), "h", "doc_id")
            out = keep(dealt.mapInPandas(_rounded, _LEVEL).withColumn("part", F.when(F.isnan("part"), None).otherwise(F.col("part"))), "rounded")
            done.append(out.where("part is null"))
            open_rows = out.where("part is not null")
            if buckets == 1:
                done.append(open_rows.withColumn("whole", F.col("whole") + (_uniform(-1) < F.col("part")).cast("long")))
                break
            buckets, level = math.ceil(buckets / FAN_IN), level + 1
            rows = open_rows.withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
        out = done[0]
        for more in done[1:]:
            out = out.unionAll(more)
        return written(out.select(F.expr("if(no_id, null, doc_id)").alias("doc_id"), "source", "size", "source_size", "target", F.col("whole").alias("copies"), "th", "rest", "n"), "decided")


def decisions(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of ``documents``.

    A null text has size 0; null sources form one source; documents of size 0 take no words; an empty
    table gives no rows. Rows equal in id, source and text share what the mix takes of them as evenly as
    whole copies allow; rows that share an id only are decided each. The order of rows does not matter,
    and other columns are not read.
    """
    decided = _decided(_keyed(documents.select("doc_id", "source", "text")).drop("row"))
    each = decided.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    copies = F.expr("copies div n + if(i <= copies % n, 1L, 0L)")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(documents: DataFrame) -> DataFrame:
    """``documents`` with every row as often as the mix takes it; the columns stay, whatever their names.

    Decisions are joined by what tells rows apart, so a text moves once. Rows equal in every column are one
    row with the sum of their copies; a bitmap of bounded size tells which rows may be such, and these are
    brought together before they move. Nulls, empty texts and empty tables are as in ``decisions``.
    """
    keyed = _keyed(documents)
    taken = _decided(keyed.drop("row")).select(F.xxhash64("doc_id", "source", "size").alias("id"), "th", "rest", "copies", "n")
    key = ["id", "th", "rest"]
    rows = keyed.select("row", F.xxhash64("doc_id", "source", "size").alias("id"), "th", "rest")
    spot = F.xxhash64(*key).alias("id")
    maybe = likely(rows.select(F.struct("row", *key).alias("all"), spot), taken.where("n > 1").select(spot)).select("all.*")
    once = rows.join(taken.where("n = 1 and copies > 0").hint("shuffle_hash"), key).select("row", "copies")
    repeated = maybe.groupBy(*key).agg(F.first("row").alias("row")).join(taken.where("n > 1 and copies > 0"), key).select("row", "copies")
    return once.unionAll(repeated).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_")).select("row.*")
