"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests, one machine) a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints"


class Table:
    """A DataFrame written once as Parquet, so that a lost executor costs a reread and not a recomputation.

    The tables of an application lie in one folder named by its id, so what a killed driver leaves behind
    can be told and deleted.
    """

    def __init__(self, df: DataFrame, label: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/lexarc-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; only for tables that no later plan reads."""
        self._fs.delete(self._path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` cut from its lineage by a table in the shared folder, deleted when the application ends."""
    return Table(df, label).df


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``written`` for tables that are deleted at the end of the block, which therefore must write its result itself."""
    tables: list[Table] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        tables.append(Table(df, label))
        return tables[-1].df

    try:
        yield keep
    finally:
        for table in tables:
            table.drop()


#: Keys that are joined by broadcasting hold more than one in MOST_HEAVY of all rows, so there are fewer than MOST_HEAVY of them.
MOST_HEAVY, LEAST_HEAVY = 2000, 20_000


def joined(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key), without ``size``: how many of the rows have the key.

    Rows of heavy keys meet their row of the table by a broadcast of proven size and are not shuffled; the others
    are joined as usual. Keys are not null; ``how`` is inner or left; ``total`` is the number of rows at most. Above
    LEAST_HEAVY rows both sides are read twice and should be written tables.
    """
    total = rows.count() if total is None else total
    bar = max(LEAST_HEAVY, total // MOST_HEAVY)
    more = [c for c in table.columns if c not in (*keys, size)]
    light = table.select(*keys, *more)
    heavy = table.where(F.col(size) > bar)
    if total <= bar or heavy.isEmpty():
        return rows.join(light, keys, how).select(*rows.columns, *more)
    marked = rows.join(F.broadcast(heavy.select(*keys, *more, F.lit(True).alias("_heavy"))), keys, "left")
    rest = marked.where("_heavy is null").select(*rows.columns).join(table.where(F.col(size) <= bar).select(*keys, *more), keys, how)
    return marked.where("_heavy").select(*rows.columns, *more).unionAll(rest.select(*rows.columns, *more))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores in front, so that no column of ``df`` has it in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
