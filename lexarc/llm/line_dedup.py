"""Line dedup by a suffix array over line ids, in DataFrame operations only.

The corpus is a sequence of line ids, text after text; lines without a word are left out. Prefix doubling
ranks every suffix by its first 1, 2, 4, ... lines: the ranks of 2n lines are those of the sorted pairs of
ranks of n lines. A suffix whose first n lines occur nowhere else drops out.

The suffixes that share their first m lines are an interval of the suffix array, 2^k <= m < 2^(k+1); it is
named by m and the ranks at level k of the first and the last 2^k of these lines. Runs of lines with at least
MIN_WORDS words that occur earlier are later copies; their lines are deleted, the first copy stays.

A maximal repeated run of that many words is the union of the shortest runs of MIN_WORDS words that begin or
end at its lines, and each of these is repeated as it is (a line that none begins or ends at lies inside the
one that begins at the run's first line). So it is enough to ask for every suffix whether the interval at the
depth of its shortest run holds an earlier one: its common prefix with that one is as long at least. Every line
has a word, so these runs have at most MIN_WORDS lines, and doubling ends there, however long the repeated runs
are. Stretches of repeated lines with fewer than MIN_WORDS words hold no run and are left out before doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefilter import apart
from .store import LEAST_HEAVY, joined, scratch, written

WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50
AT = ["doc_id", "th"]


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, th, pos, k, lid, lid2, words): every line with a word, its place among all lines and among such lines.

    th tells rows apart that share a doc_id; a line's id has 128 bits, so that no two lines of any corpus are taken for one.
    """
    split = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda s: s["line"].rlike(WORD))
    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(split).alias("k", "s"))
    return rows.select(*AT, F.col("s.pos").alias("pos"), "k", F.xxhash64("s.line").alias("lid"), F.xxhash64(F.lit("line"), "s.line").alias("lid2"), F.regexp_count("s.line", F.lit(WORD + "+")).alias("words"))


def ranked(keys: DataFrame, by: list[str], name: str, keep) -> DataFrame:
    """Distinct ``by`` that occur twice or more, with ``name``: numbers that ascend in their order, and ``n``: how often."""
    twice = keep(keys.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "twice")
    return keep(twice.orderBy(*by).withColumn(name, F.monotonically_increasing_id()), name)


def long_stretches(rows: DataFrame, min_words: int) -> DataFrame:
    """The rows in stretches of consecutive lines with ``min_words`` words or more."""
    rows = rows.withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy(*AT).orderBy("k")))
    whole = F.sum("words").over(Window.partitionBy(*AT, "island"))
    return rows.withColumn("whole", whole).where(F.col("whole") >= min_words).drop("island", "whole")


def suffix_ranks(rows: DataFrame, most: int, keep) -> DataFrame:
    """(d, k, level, r): rank of the suffix at k by its first 2 ** level <= most lines, where these occur elsewhere too."""
    total = rows.count()
    now = keep(joined(rows, ranked(rows, ["lid", "lid2"], "r", keep), ["lid", "lid2"], "n", total).select("d", "k", F.lit(0).alias("level"), "r"), "ranks")
    out, level = now, 1
    while total and 1 << level <= most:
        ahead = now.select("d", (F.col("k") - (1 << (level - 1))).alias("k"), F.col("r").alias("b"))
        pairs = now.select("d", "k", F.col("r").alias("a")).join(ahead, ["d", "k"])
        pairs = keep(pairs, "pairs") if total > LEAST_HEAVY else pairs
        now = keep(joined(pairs, ranked(pairs, ["a", "b"], "r", keep), ["a", "b"], "n", total).select("d", "k", F.lit(level).alias("level"), "r"), "ranks")
        out, level, total = out.unionAll(now), level + 1, now.count()
    return out


def shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(d, start, len): the shortest runs of ``min_words`` words that begin or end at each of the repeated lines."""
    order = Window.partitionBy("d").orderBy("k")
    apart = rows.select("d", "k", "words", (F.col("k") - F.row_number().over(order)).alias("island"))
    within = Window.partitionBy("d", "island").orderBy("k")

    def length(words):
        done = F.aggregate(words, F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.when(a["s"] >= min_words, a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))))
        return F.when(done["s"] >= min_words, done["n"])

    both = apart.select(
        "d", "k",
        length(F.collect_list("words").over(within.rowsBetween(0, min_words - 1))).alias("on"),
        length(F.reverse(F.collect_list("words").over(within.rowsBetween(1 - min_words, 0)))).alias("back"),
    )
    return both.select("d", F.explode(F.array(F.struct(F.col("k").alias("start"), F.col("on").alias("len")), F.struct((F.col("k") - F.col("back") + 1).alias("start"), F.col("back").alias("len")))).alias("x")).where("x.len is not null").select("d", "x.start", "x.len").distinct()


def later_runs(rows: DataFrame, min_words: int, keep) -> DataFrame:
    """(d, start, len): the shortest runs of ``min_words`` words that occur earlier in the corpus."""
    ranks = suffix_ranks(rows, min_words, keep)
    runs = shortest_runs(rows, min_words).withColumn("level", F.length(F.bin("len")) - 1)
    runs = runs.withColumn("last", F.expr("start + len - shiftleft(1, level)"))
    named = runs.join(ranks.select("d", F.col("k").alias("start"), "level", F.col("r").alias("a")), ["d", "start", "level"])
    named = named.join(ranks.select("d", F.col("k").alias("last"), "level", F.col("r").alias("b")), ["d", "last", "level"])
    named = keep(named.select("d", "start", "len", "a", "b"), "runs")
    interval = ["len", "a", "b"]
    firsts = named.groupBy(*interval).agg(F.min(F.struct("d", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return joined(named, keep(firsts, "intervals"), interval, "n").where(F.struct("d", "start") != F.col("first")).select("d", "start", "len")


def later_copies(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, n_lines, deleted): of every document with a line, its lines and the sorted places of those deleted."""
    with scratch() as keep:
        every = keep(lines(documents), "lines")
        twice = keep(every.groupBy("lid", "lid2").agg(F.count("*").alias("n")).where("n > 1"), "twice")
        rows = joined(every, twice, ["lid", "lid2"], "n").dropDuplicates([*AT, "k"])
        rows = keep(long_stretches(rows, min_words), "repeated")
        texts = keep(keep(rows.select(*AT).distinct(), "texts").orderBy(F.asc_nulls_first("doc_id"), "th").withColumn("d", F.monotonically_increasing_id()), "texts")
        rows = rows.join(texts.withColumnsRenamed({"doc_id": "_d", "th": "_t"}), (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
        rows = keep(rows.select("d", "k", "pos", "lid", "lid2", "words"), "repeated")
        runs = later_runs(rows, min_words, keep)
        gone = runs.select("d", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("k")).distinct()
        deleted = gone.join(rows.select("d", "k", "pos"), ["d", "k"]).groupBy("d").agg(F.sort_array(F.collect_list("pos")).alias("deleted"))
        deleted = deleted.join(texts, "d").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "deleted")
        number = every.groupBy(*AT).agg((F.max("k") + 1).alias("n_lines"))
        both = number.join(deleted, (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
        return written(both.select(*AT, F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted")), "deleted")


def report(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_deleted, deleted), one row per row: lines with a word, and the 0-based places of deleted lines, joined by commas.

    Null, empty and blank texts have no lines. Rows that share an id are documents of their own unless
    their texts are equal too; then they are one, and each row has its result. The first copy is the one
    with the least doc_id (null first), then the least place.
    """
    found = later_copies(documents, min_words)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"))
    out = rows.join(found.withColumnRenamed("doc_id", "_d"), (F.col("_h") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    deleted = F.coalesce("deleted", F.array().cast("array<int>"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(deleted).cast("long").alias("n_deleted"), F.array_join(deleted.cast("array<string>"), ",").alias("deleted"))


def deduplicated(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with the later copies of repeated line runs deleted; texts of which no word is left go.

    The columns stay, whatever their names; null texts and texts without a deleted line stay as they are.
    """
    found = later_copies(documents, min_words).where(F.size("deleted") > 0).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "n_lines", "deleted")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = documents.select(row.alias("row"), F.col("text").alias("text"), F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("d"))
    # only texts that may lose lines are shuffled
    maybe, stay = apart(rows.withColumn("id", F.xxhash64("d", "h")), found.select(F.xxhash64("_d", "_t").alias("id")))
    maybe = maybe.join(found, (F.col("h") == F.col("_t")) & F.col("d").eqNullSafe(F.col("_d")), "left").where("deleted is null or size(deleted) < n_lines")
    kept = F.concat_ws("\n", F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("deleted", s["i"])), lambda s: s["x"]))
    text = F.when(F.col("deleted").isNull(), F.col("text")).otherwise(kept)
    changed = maybe.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])
    return stay.select("row.*").unionAll(changed)
