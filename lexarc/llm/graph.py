"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import LEAST_HEAVY, Table, joined, scratch


def _stars(links: DataFrame, large: bool, total: int, keep) -> DataFrame:
    """Each node's neighbours move to its smallest neighbour (itself included). A hub meets its minimum by broadcast."""
    if large:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    met = joined(both, keep(least, "least") if 2 * total > LEAST_HEAVY else least, ["a"], "n", 2 * total)
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long): the smallest node reachable.

    Links with a null end and loops count for nothing. Every step is written to the shared folder; the
    rounds go on until nothing moves.
    """
    now = Table(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark, total = None, now.df.count()
    while True:
        with scratch() as keep:
            step = _stars(now.df, True, total, keep)
            new = Table(_stars(keep(step, "links") if 2 * total > LEAST_HEAVY else step, False, total, keep), "links")
        now.drop()
        now = new
        row = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            break
        mark, total = (row[0], row[1]), row[0]
    stars = now.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
