"""Operators that join key tables: and, or, and-not, proximity, containment.

A unit is (db, sysno, section_id). Every operator brings the keys of a unit together once and decides by
windows over them, so nothing is joined with itself and no operator pairs the keys of a frequent term with
all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECORD = ["db", "sysno"]
UNIT = [*RECORD, "section_id"]
KEY = ["static_rank", *UNIT, "segment", "seqno", "term_id"]


def union(children: list[DataFrame]) -> DataFrame:
    """OR: all keys of all children."""
    return reduce(DataFrame.unionAll, [c.select(*KEY) for c in children])


def _tagged(children: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [c.select(*KEY, F.lit(i).alias("child")) for i, c in enumerate(children)])


def intersect(children: list[DataFrame]) -> DataFrame:
    """AND: all keys of units in which every child has one, unless the children's first keys lie in different segments (0 fits all)."""
    return meet(_tagged(children), len(children))


def meet(tagged: DataFrame, n: int) -> DataFrame:
    """AND of the ``n`` children that the column child (0, 1, ...) tells apart."""
    unit = Window.partitionBy(*UNIT)
    segments = [F.min(F.when(F.col("child") == i, F.struct("seqno", "segment"))).over(unit)["segment"] for i in range(n)]
    set_ones = F.array(*[F.when(s != 0, s) for s in segments])
    agree = F.size(F.array_distinct(F.array_compact(set_ones))) <= 1
    every = F.lit(True)
    for s in segments:
        every = every & s.isNotNull()
    return tagged.withColumn("_good", every & agree).where("_good").select(*KEY)


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """AND-NOT: keys of left whose unit has no key of right."""
    return apart(_tagged([left, right]))


def apart(tagged: DataFrame) -> DataFrame:
    """AND-NOT of child 0 and child 1."""
    spoilt = F.max(F.col("child")).over(Window.partitionBy(*UNIT))
    return tagged.withColumn("_last", spoilt).where("_last = 0").select(*KEY)


#: Distances d = right - left that fit a relation with n, as closed intervals; None is without bound.
def _fitting(relation: int, n: int, ordered: bool) -> list[tuple[int | None, int | None]]:
    inside = {1: [(-n + 1, n - 1)], 2: [(-n, n)], 3: [(-n, -n), (n, n)], 4: [(None, -n), (n, None)], 5: [(None, -n - 1), (n + 1, None)], 6: [(None, -n - 1), (-n + 1, n - 1), (n + 1, None)]}[relation]
    if n < 0:  # an absolute distance is never below 0
        inside = {1: [], 2: [], 3: []}.get(relation, [(None, None)])
    if n == 0:
        inside = {1: [], 2: [(0, 0)], 3: [(0, 0)], 4: [(None, None)], 5: [(None, -1), (1, None)], 6: [(None, -1), (1, None)]}[relation]
    return _after(inside) if ordered else inside


def _after(intervals: list) -> list:
    """The part of the intervals above 0."""
    cut = [(max(1, a) if a is not None else 1, b) for a, b in intervals]
    return [(a, b) for a, b in cut if b is None or a <= b]


def _outside(intervals: list, ordered: bool) -> list:
    """What the sorted intervals leave of all distances (above 0)."""
    out, at = [], 1 if ordered else None
    for a, b in intervals:
        if a is not None and (at is None or a > at):
            out.append((at, a - 1))
        if b is None:
            return out
        at = b + 1
    return [*out, (at, None)]


def near(left: DataFrame, right: DataFrame, distance: int, ordered: bool = True, relation: int = 3, exclusion: bool = False) -> DataFrame:
    """Proximity in positions.

    Ordered and not excluding, with relation < <= or =: every right key with a left key before it at a
    fitting distance. Otherwise one key, the first right one, of each unit in which some pair fits
    (with exclusion: fails). The latest left key that is near enough from below decides for a right key.
    """
    intervals = _fitting(relation, distance, ordered)
    if exclusion:
        intervals = _outside(intervals, ordered)
    if not intervals:
        return right.limit(0)
    both, unit = _tagged([left, right]), Window.partitionBy(*UNIT)
    at = F.when(F.col("child") == 0, F.col("seqno"))
    fits = F.lit(False)
    for a, b in intervals:
        latest = F.max(at).over(unit) if a is None else F.max(at).over(unit.orderBy("seqno").rangeBetween(Window.unboundedPreceding, -a))
        fits = fits | (latest.isNotNull() if b is None else F.coalesce(F.col("seqno") - latest <= b, F.lit(False)))
    found = both.withColumn("_fits", fits).where("child = 1 and _fits")
    if ordered and not exclusion and relation in (1, 2, 3):
        return found.select(*KEY)
    units = found.select(*UNIT).distinct()
    first = right.groupBy(*UNIT).agg(F.min(F.struct("seqno", "static_rank", "segment", "term_id")).alias("k"))
    return first.join(units, UNIT, "left_semi").select("k.static_rank", *UNIT, "k.segment", "k.seqno", "k.term_id")


def phrase(children: list[DataFrame]) -> DataFrame:
    """Terms at consecutive positions; keys of the last term."""
    return reduce(lambda a, b: near(a, b, 1), children)


def _tags(start: DataFrame, stop: DataFrame) -> DataFrame:
    return start.select(*UNIT, "seqno", F.lit(1).alias("step")).unionAll(stop.select(*UNIT, "seqno", F.lit(-1).alias("step"))).distinct()


def marked_regions(start: DataFrame, stop: DataFrame, attribute: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The start and the stop keys of the regions, which may nest, that have an attribute key at their start."""
    tags = _tags(start, stop)
    order = Window.partitionBy(*UNIT).orderBy("seqno", F.desc("step"))
    depth = F.sum("step").over(order) + F.when(F.col("step") == -1, 1).otherwise(0)
    closing = F.lead("seqno").over(Window.partitionBy(*UNIT, "depth").orderBy("seqno", F.desc("step")))
    found = (
        tags
        .withColumn("depth", depth)
        .withColumn("close", closing)
        .where("step = 1")
        .join(attribute.select(*UNIT, "seqno").distinct(), [*UNIT, "seqno"], "left_semi")
    )
    return found.select(*UNIT, "seqno"), found.where("close is not null").select(*UNIT, F.col("close").alias("seqno"))


def between(start: DataFrame, stop: DataFrame, hit: DataFrame, attribute: DataFrame | None = None) -> DataFrame:
    """Containment: keys of hit inside a start ... stop region, which may nest. With attribute, only regions count whose start has an attribute key at its position."""
    if attribute is not None:
        start, stop = marked_regions(start, stop, attribute)
    none = [F.lit(None).cast(hit.schema[c].dataType).alias(c) for c in ("static_rank", "segment", "term_id")]
    events = (
        _tags(start, stop)
        .select(*UNIT, "seqno", "step", *none)
        .unionByName(hit.select(*UNIT, "seqno", F.lit(0).alias("step"), "static_rank", "segment", "term_id"))
    )
    open_now = F.sum("step").over(Window.partitionBy(*UNIT).orderBy("seqno", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("open", open_now).where("step = 0 and open > 0").select(*KEY)


def regions(start: DataFrame, stop: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits inside start ... stop regions, with the number of their outermost region."""
    rest = [c for c in hits.columns if c not in (*UNIT, "seqno")]
    events = (
        _tags(start, stop)
        .select(*UNIT, "seqno", "step", *[F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in rest])
        .unionByName(hits.withColumn("step", F.lit(0)))
    )
    order = Window.partitionBy(*UNIT).orderBy("seqno", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.when((F.col("step") == 1) & (F.col("depth") == 1), 1).otherwise(0)).over(order)
    return events.withColumn("depth", F.sum("step").over(order)).withColumn("region", opened).where("step = 0 and depth > 0").drop("step", "depth")


def within(start: DataFrame, stop: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of both inside one outermost region that holds both."""
    numbered = regions(start, stop, left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(2))))
    one = Window.partitionBy(*UNIT, "region")
    return numbered.withColumn("_both", F.min("side").over(one) < F.max("side").over(one)).where("_both").select(*KEY)


def of_record(keys: DataFrame, sysno: int, db: str | None = None) -> DataFrame:
    """The keys of one record."""
    found = keys.where(F.col("sysno") == sysno)
    return found if db is None else found.where(F.col("db") == db)


