"""Shared folders, small files and the versions of a stored index."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Locked(Exception):
    """Another writer holds the index, or has published a version in between."""


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests, one machine) a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints"


class Folder:
    """Files of one directory in any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._jvm = spark, root.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self.exists("") else []

    def create(self, name: str, text: str) -> bool:
        """Makes a file that must not exist yet; says whether it was made. Its content is complete once it is seen."""
        part = self._at(f".{name}-{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(part, self._at(name), options)  # never overwrites
        except Exception:
            self._fs.delete(part, False)
            if self.exists(name):
                return False
            raise
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def delete_on_exit(self) -> None:
        self._fs.deleteOnExit(self._at(""))

    def state(self) -> str:
        """Changes whenever the files do."""
        summary = self._fs.getContentSummary(self._at(""))
        return f"{summary.getLength()}-{summary.getFileCount()}-{self._fs.getFileStatus(self._at('')).getModificationTime()}"


class Manifests:
    """A numbered file for every published state. A state is published by making the next number, which one writer only can."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def latest(self) -> tuple[int, dict]:
        known = [int(n[9:-5]) for n in self.folder.names() if n.startswith("manifest-") and n.endswith(".json")]
        if not known:
            return 0, {"layers": [], "pending": None, "next": 1}
        return max(known), json.loads(self.folder.read(f"manifest-{max(known):012}.json"))

    def publish(self, number: int, state: dict) -> None:
        """After ``number``."""
        if not self.folder.create(f"manifest-{number + 1:012}.json", json.dumps(state)):
            raise Locked("another writer was faster")


def scratch_folder(spark: SparkSession, label: str) -> Folder:
    """A new folder of this application in the shared one, deleted at its end."""
    folder = Folder(spark, f"{shared_dir(spark)}/lexarc-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}")
    folder.delete_on_exit()
    return folder


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores: a small file of many records is one split, and parsing them in Python one task's work."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def kept(df: DataFrame, label: str = "kept") -> DataFrame:
    """The rows, written once, so that several readers do not make them again."""
    folder = scratch_folder(df.sparkSession, label)
    df.write.parquet(folder.root)
    return df.sparkSession.read.schema(df.schema).parquet(folder.root)


def numbered(df: DataFrame, name: str = "position") -> DataFrame:
    """A sorted DataFrame with the place of every row, from 1, without bringing all rows to one task.

    It is written once; a row's place is its place in its file after the rows of the files before.
    """
    spark, folder = df.sparkSession, scratch_folder(df.sparkSession, "sorted")
    df.write.parquet(folder.root)
    rows = (
        spark.read
        .schema(df.schema)
        .parquet(folder.root)
        .select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    )
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # a row a file
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        rows
        .join(F.broadcast(sizes.select("_file", before.alias("_before"))), "_file")
        .select(*df.columns, (F.col("_before") + F.col("_row") + 1).alias(name))
    )
