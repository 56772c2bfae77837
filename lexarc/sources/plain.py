"""Plain sources: text files, mail, pre-tokenised lines, directory listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime) of every file below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"))


def text_records(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None) -> DataFrame:
    """(filename, text): a record a file, or a record between separators. Empty records are left out. ``encoding`` is that of
    the files where it is not UTF-8; separators then split whole files."""
    if encoding:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        whole = F.decode("content", encoding)
        parts = F.explode(F.split(whole, re.escape(separator))) if separator else whole
        return files.select(F.col("path").alias("filename"), parts.alias("text")).where(F.length("text") > 0)
    read = spark.read.option("recursiveFileLookup", "true")
    rows = read.text(path, lineSep=separator) if separator else read.text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("filename"), F.col("value").alias("text")).where(F.length("text") > 0)


def mail(spark: SparkSession, path: str) -> DataFrame:
    """(filename, part, sender, subject, date, body) of mailbox files; lines that fit no header are body."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    one = rows.select(F.input_file_name().alias("filename"), F.posexplode(F.filter(F.split("value", r"(?m)^(?=From )"), lambda x: F.trim(x) != "")).alias("part", "m"))
    head, body = F.substring_index("m", "\n\n", 1), F.regexp_extract("m", r"(?s)^.*?\n\n(.*)$", 1)
    get = lambda h: F.nullif(F.trim(F.regexp_extract(head, rf"(?mi)^{h}:[ \t]*(.*(?:\n[ \t]+.*)*)", 1)), F.lit(""))
    return one.select("filename", "part", get("From").alias("sender"), get("Subject").alias("subject"), get("Date").alias("date"), body.alias("body"))


def pretokenised(spark: SparkSession, path: str, db: str = "Default", first_sysno: int = 1) -> DataFrame:
    """Postings of pre-tokenised files: a line with the record's match key, then
    ``[type] record section [segment] position index term`` lines. A record number of 0 stands for the file's own number:
    files are numbered in the order of their names from ``first_sysno`` on."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return pretokenised_lines(lines, db, file_numbers(lines, first_sysno))


def file_numbers(lines: DataFrame, first_sysno: int = 1) -> DataFrame:
    """(file, number): files in the order of their names; a row a file, so one window holds them."""
    names = lines.select("file").distinct()
    return names.withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long") + (first_sysno - 1))


def pretokenised_keys(spark: SparkSession, path: str, first_sysno: int = 1) -> DataFrame:
    """(file, match_key, sysno): the first line of every pre-tokenised file names its record."""
    whole = (
        spark.read
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.trim(F.substring_index("value", "\n", 1)).alias("match_key"))
    )
    return whole.join(file_numbers(whole, first_sysno), "file").select("file", "match_key", F.col("number").alias("sysno"))


def pretokenised_lines(lines: DataFrame, db: str = "Default", numbers: DataFrame | None = None) -> DataFrame:
    """Postings of single lines (value[, file]); lines that hold no token are ignored."""
    token = r"^(?:([a-z]) )?(\d+) (\d+) (?:(\d+) )?(\d+) (\S+) (.+)$"
    part = lambda i: F.regexp_extract("value", token, i)
    number = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0).cast("long"))
    rows, own = lines.where(F.col("value").rlike(token)), number(2)
    if numbers is not None:
        rows, own = rows.join(numbers, "file"), F.when(number(2) == 0, F.col("number")).otherwise(number(2))
    return rows.select(
        F.lit(db).alias("db"), F.lit("index").alias("cat"), F.coalesce(F.nullif(part(1), F.lit("")), F.lit("w")).alias("idx_type"), part(6).alias("idx_name"), F.lower(part(7)).alias("term"),
        F.lit(0).cast("long").alias("static_rank"), own.alias("sysno"), number(3).alias("section_id"), number(4).alias("segment"), number(5).alias("seqno"),
    ).distinct()


def record_type(path: Column, types: dict[str, str], default: str = "text") -> Column:
    """The record form of a file by its name's ending: ``{"sgml": "tree.sgml", "group.xml": "dom"}``; a longer ending counts first."""
    out = F.lit(default)
    for ending in sorted(types, key=len):
        out = F.when(F.endswith(F.lower(path), F.lit("." + ending.lower())), F.lit(types[ending])).otherwise(out)
    return out
