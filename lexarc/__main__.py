"""``python -m lexarc COMMAND``: keeps a stored index of text records.

init ROOT | update ROOT PATH | delete ROOT PATH | adelete ROOT PATH | drop ROOT DB | commit ROOT | clean ROOT | compact ROOT |
stat ROOT | dumpdict ROOT | dump ROOT | check ROOT | search ROOT QUERY | filters
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import index as ix
from .config import Config
from .session import Session
from .sources import names, text_records

FIELDS = [ix.Field("text", (("any", "w"), ("any", "p"))), ix.Field("filename", (("filename", "0"), ("filename", "s")))]


def records(spark: SparkSession, path: str, db: str):
    """Text files as records, numbered by the hash of their names."""
    rows = text_records(spark, path)
    return rows.select(F.xxhash64("filename").bitwiseAND(F.lit((1 << 53) - 1)).alias("sysno"), F.col("filename").alias("match_key"), F.lit(db).alias("db"), "filename", F.lit("text").alias("file_type"), "text")


def _updated(store: ix.Store, new, gone_only: bool, shadow: bool, db: str) -> int:
    plan = ix.build(new.limit(0) if gone_only else new, FIELDS, db=F.col("db"))
    try:
        old = store.read().records
    except FileNotFoundError:
        return store.write(plan, shadow)
    gone = old.where(F.col("db") == db).join(new.select("match_key"), "match_key", "left_semi").select("db", "sysno")
    return store.merge(plan, gone, shadow)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="lexarc", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("-c", "--config", help="a file of settings")
    parser.add_argument("-d", "--database", help="the database to change")
    parser.add_argument("-n", "--no-shadow", action="store_true", help="changes are visible at once")
    parser.add_argument("command")
    parser.add_argument("args", nargs="*")
    got = parser.parse_args(argv)
    with open(got.config) if got.config else open("/dev/null") as f:
        config = Config.parse(f.read())
    for name in config.unknown():
        print(f"unknown setting {name}", file=sys.stderr)
    if got.command == "filters":
        print("\n".join(names()), file=out)
        return 0
    if not got.args:
        parser.error("an index is needed")
    spark = spark or SparkSession.builder.appName("lexarc").getOrCreate()
    store, db, rest = ix.Store(spark, got.args[0]), got.database or config.get("database"), got.args[1:]
    show = lambda df: [print(*r, sep="\t", file=out) for r in df.toLocalIterator()]
    if got.command in ("update", "delete", "adelete"):
        new = records(spark, rest[0], db)
        if got.command == "delete":
            known = store.read().records.where(F.col("db") == db)
            missing = new.join(known.select("match_key"), "match_key", "left_anti")
            if not missing.isEmpty():
                show(missing.select(F.lit("missing"), "match_key"))
                return 1
        print(_updated(store, new, got.command != "update", not got.no_shadow, db), file=out)
    elif got.command in ("init", "commit", "clean", "compact"):
        getattr(store, got.command)()
    elif got.command == "drop":
        store.drop_database(rest[0])
    elif got.command == "stat":
        show(store.read().catalog())
    elif got.command == "dumpdict":
        show(store.read().dictionary().orderBy("idx_type", "idx_name", "term").select("idx_type", "idx_name", "term", "docs", "occurrences"))
    elif got.command == "dump":
        show(store.read().postings)
    elif got.command == "check":
        show(ix.check(store.read()))
    elif got.command == "search":
        show(Session(store).search(rest[0]).ordered().select("db", "sysno"))
    else:
        parser.error(f"no command {got.command}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
