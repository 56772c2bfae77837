"""A broadcast bitmap of fixed size that spares the shuffle of rows without a partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8 MB, whatever the input.
BITS = 1 << 26


_SET = "cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(_bit % 8 as int)) <> 0"


def _placed(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    spot = F.pmod(F.xxhash64("id"), F.lit(BITS)) + 1
    maps = ids.select(spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    return rows.withColumn("_bucket", F.bitmap_bucket_number(spot)).withColumn("_bit", F.bitmap_bit_position(spot)).join(F.broadcast(maps), "_bucket", how)


def likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` may be in ``ids`` (id), and few others; join them to be exact.

    With very many ids the bitmap fills up and lets more rows through. Join inner, on distinct ids: a
    semi join would be pushed below the bitmap.
    """
    return _placed(rows, ids, "inner").where(_SET).select(*rows.columns)


def apart(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``likely`` and the other rows, none of which has its ``id`` in ``ids``."""
    marked = _placed(rows, ids, "left").withColumn("_maybe", F.coalesce(F.expr(_SET), F.lit(False)))
    return marked.where("_maybe").select(*rows.columns), marked.where("not _maybe").select(*rows.columns)
