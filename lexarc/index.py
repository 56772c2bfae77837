"""The index: records, postings and sort keys as DataFrames, stored as layers of Parquet directories.

Positions run over a whole record across all its fields; a field type with a first-in-field mark uses
one position for it. Postings are partitioned by field type and index name; a file holds all postings of
some records, sorted by term, so a leaf reads one directory and skips row groups and pages by their
statistics, and whatever is counted by record is counted where it is read. A table of terms and one of
indexes stand beside them, so browsing, counting and the choice of databases read no postings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.analysis import FIELD_TYPES, FIRST_MARK, FieldType, normalised, terms
from .storage import Folder, Locked, Manifests

POSTING = ["db", "cat", "idx_type", "idx_name", "term", "static_rank", "sysno", "section_id", "segment", "seqno"]
RECORD = ["db", "sysno"]
#: The pseudo index that holds every record once.
ALL_RECORDS = "_ALLRECORDS"


@dataclass(frozen=True)
class Field:
    """A text column of the records and the (index name, field type) pairs it feeds, all from the same position on."""

    column: str
    indexes: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Plan:
    """How records become postings: the arguments of ``build`` that a stored index needs to analyse its records again."""

    fields: tuple[Field, ...]
    section: str | None = None
    rank: str | None = None

    def again(self, records: DataFrame, types: dict[str, FieldType] | None = None) -> Index:
        return build(records, list(self.fields), F.col("db"), "sysno", self.section, self.rank, types)


@dataclass
class Index:
    records: DataFrame
    postings: DataFrame
    sortkeys: DataFrame
    plan: Plan | None = None
    term_table: DataFrame | None = None
    catalog_table: DataFrame | None = None
    types: dict[str, FieldType] | None = None
    #: Postings as ``build`` made them, and how it makes the same from records dealt to so many partitions.
    made: tuple[DataFrame, Callable[[int], DataFrame]] | None = None
    #: The same of sort keys.
    keyed: tuple[DataFrame, Callable[[int], DataFrame]] | None = None
    #: Postings of one stored layer, and the same with the column lead: whether one is its term's first in its record.
    led: tuple[DataFrame, DataFrame] | None = None

    def only(self) -> tuple[str, str] | None:
        """(type, name) if all postings are known to be of one index."""
        given = [(code, name) for f in self.plan.fields for name, code in f.indexes if code != "staticrank" and not self.field_type(code).sort] if self.plan else []
        return given[0] if len(given) == 1 and self.made is not None and self.made[0] is self.postings else None

    def by_record(self, n: int) -> DataFrame:
        """The postings in ``n`` partitions, a record's in one: texts are dealt out before they are analysed, wherever that is possible."""
        if self.made is not None and self.made[0] is self.postings:
            return self.made[1](n)
        return self.postings.repartition(n, "sysno")

    def keys_by_record(self, n: int) -> DataFrame:
        """The sort keys in the same partitions."""
        if self.keyed is not None and self.keyed[0] is self.sortkeys:
            return self.keyed[1](n)
        return self.sortkeys.repartition(n, "sysno")

    def marked(self) -> Column:
        """Whether a posting's index is known to have a first-in-field mark in every record that it has a posting of."""
        given = dict.fromkeys((code, name) for f in self.plan.fields for name, code in f.indexes) if self.plan and self.made is not None and self.made[0] is self.postings else {}
        known = [(F.col("idx_type") == code) & (F.col("idx_name") == name) for code, name in given if code != "staticrank" and self.field_type(code).first_in_field]
        return reduce(lambda x, y: x | y, known, F.lit(False))

    def field_type(self, code: str) -> FieldType:
        return (self.types or FIELD_TYPES)[code]

    def dictionary(self) -> DataFrame:
        """(db, idx_type, idx_name, term, docs, occurrences) of every index."""
        if self.term_table is not None:
            return self.term_table
        own = self.postings.where((F.col("cat") == "index") & (F.col("term") != FIRST_MARK))
        per = own.groupBy("db", "idx_type", "idx_name", "term", "sysno").agg(F.count("*").alias("n"))
        return per.groupBy("db", "idx_type", "idx_name", "term").agg(F.count("*").alias("docs"), F.sum("n").alias("occurrences"))

    def terms(self, idx_name: str, idx_type: str) -> DataFrame:
        """(term, docs, occurrences) of one index, over all databases."""
        own = self.dictionary().where((F.col("idx_type") == idx_type) & (F.col("idx_name") == idx_name))
        return own.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))

    def catalog(self) -> DataFrame:
        """(db, cat, idx_type, idx_name, doc_occ, term_occ)."""
        if self.catalog_table is not None:
            return self.catalog_table
        key = ["db", "cat", "idx_type", "idx_name"]
        return (
            self.postings
            .groupBy(*key, "sysno")
            .agg(F.count("*").alias("n"))
            .groupBy(*key)
            .agg(F.count("*").alias("doc_occ"), F.sum("n").alias("term_occ"))
        )

    def databases(self) -> DataFrame:
        """(db, records, bytes): what each database holds."""
        raw = next((F.octet_length(F.col(c).cast("string")) for c in ("raw", "text") if c in self.records.columns), F.lit(0))
        return self.records.groupBy("db").agg(F.countDistinct("sysno").alias("records"), F.coalesce(F.sum(raw), F.lit(0)).cast("long").alias("bytes"))

    def lookup(self, idx_name: str, idx_type: str, prefix: str = "") -> DataFrame:
        """(db, term, docs, occurrences) of the terms that begin with ``prefix``, in order."""
        own = self.dictionary().where((F.col("idx_type") == idx_type) & (F.col("idx_name") == idx_name) & F.col("term").startswith(prefix))
        return own.select("db", "term", "docs", "occurrences").orderBy("term", "db")

    def without_terms(self, idx_name: str, idx_type: str, prefix: str) -> Index:
        """The index without the terms that begin with ``prefix``."""
        gone = (F.col("idx_type") == idx_type) & (F.col("idx_name") == idx_name) & F.col("term").startswith(prefix)
        rest = None if self.term_table is None else self.term_table.where(~gone)  # a term goes with all its postings
        return replace(self, postings=self.postings.where(~gone), term_table=rest, catalog_table=None)

    def of_records(self, ids: DataFrame, **fold) -> Index:
        """A fresh analysis of the records in ``ids`` (db, sysno) only, e.g. to show words around hits; ``fold=False`` keeps them as written."""
        if self.plan is None:
            return replace(self, postings=self.postings.join(ids.select(*RECORD).distinct(), RECORD, "left_semi"))
        types = {k: replace(t, **fold) for k, t in (self.types or FIELD_TYPES).items()} if fold else self.types
        return self.plan.again(self.records.join(ids.select(*RECORD).distinct(), RECORD, "left_semi"), types)


def build(records: DataFrame, fields: list[Field], db: Column | str = "Default", sysno: str = "sysno", section: str | None = None, rank: str | None = None, types: dict[str, FieldType] | None = None) -> Index:
    """Postings and sort keys of every record.

    The fields of a record follow each other; the tokens of a field's several indexes start at the same
    position and the cursor moves on by the longest. Blank fields take no position and have no mark. A column
    of an array gives a sort index its several values. A field of type ``staticrank`` gives the record's rank.
    """
    kinds = types or FIELD_TYPES
    ranks = [f.column for f in fields for _, code in f.indexes if code == "staticrank"]
    given = F.col(rank) if rank else F.col(ranks[0]) if ranks else F.lit(0)
    base = records.select(
        (db if isinstance(db, Column) else F.lit(db)).alias("db"),
        F.col(sysno).cast("long").alias("sysno"),
        (F.col(section).cast("long") if section else F.lit(0).cast("long")).alias("section_id"),
        F.coalesce(given.try_cast("long"), F.lit(0)).cast("long").alias("static_rank"),
        *dict.fromkeys(f.column for f in fields if f.column not in ("db", "sysno", "section_id", "static_rank")),
    )
    cursor, groups, sorts = F.lit(0).cast("long"), [], []
    for f in fields:
        longest = F.lit(0)
        for name, code in f.indexes:
            if code == "staticrank":
                continue
            kind = kinds[code]
            if kind.sort:
                several = base.schema[f.column].dataType.typeName() == "array"
                values = F.flatten(F.transform(F.coalesce(F.col(f.column).cast("array<string>"), F.array()), lambda x: terms(x, kind))) if several else terms(F.col(f.column), kind)
                sorts.append((name, code, values))
                continue
            array = f"_a{len(groups)}"
            groups.append((name, code, terms(F.col(f.column), kind), F.col(array), cursor))
            longest = F.greatest(longest, F.size(array))
        cursor = cursor + longest
    own = ["db", "static_rank", "sysno", "section_id"]
    structs = F.array(*[F.struct(F.lit(n).alias("idx_name"), F.lit(c).alias("idx_type"), a.alias("terms"), at.alias("at")) for n, c, _, a, at in groups])

    def with_mark(words: Column, code: str) -> Column:
        return F.when(F.size(words) > 0, F.concat(F.array(F.lit(FIRST_MARK)), words)).otherwise(words) if kinds[code].first_in_field else words

    def posted(base: DataFrame) -> DataFrame:
        """Each text is analysed once, as a column: an expression that explode reads several times is evaluated several times."""
        base = base.select(*own, *[words.alias(f"_t{i}") for i, (_, _, words, _, _) in enumerate(groups)])
        base = base.select(*own, *[with_mark(F.col(f"_t{i}"), code).alias(f"_a{i}") for i, (_, code, _, _, _) in enumerate(groups)])
        if len(groups) == 1:  # names as literals: nothing is sorted by them
            name, code, _, array, at = groups[0]
            tokens = base.select(*own, F.lit(name).alias("idx_name"), F.lit(code).alias("idx_type"), at.alias("at"), F.posexplode(array).alias("i", "term"))
        else:
            rows = base.select(*own, F.explode(structs).alias("g"))
            tokens = rows.select(*own, "g.idx_name", "g.idx_type", "g.at", F.posexplode("g.terms").alias("i", "term"))
        return tokens.select("db", F.lit("index").alias("cat"), "idx_type", "idx_name", "term", "static_rank", "sysno", "section_id", F.lit(0).cast("long").alias("segment"), (F.col("at") + F.col("i") + 1).alias("seqno"))

    postings = posted(base)
    read = dict.fromkeys(["db", "sysno", "section_id", *(f.column for f in fields if any(c != "staticrank" and kinds[c].sort for _, c in f.indexes))])

    def keyed(base: DataFrame) -> DataFrame:
        rows = base.select("db", "sysno", F.struct("section_id", *[v.alias(f"_v{i}") for i, (_, _, v) in enumerate(sorts)]).alias("s"))
        sections = rows.groupBy("sysno", "db").agg(F.collect_list("s").alias("s"))
        of = lambda i: F.transform("s", lambda s: F.struct(s["section_id"], s[f"_v{i}"].alias("values")))
        each = []
        for name, code in dict.fromkeys((n, c) for n, c, _ in sorts):
            places = [i for i, (n, c, _) in enumerate(sorts) if (n, c) == (name, code)]
            values = F.flatten(F.array_sort(F.concat(*[of(i) for i in places]))["values"])
            if len(places) == 1:  # nothing to put in order
                values = F.when(F.size("s") == 1, F.col("s")[0][f"_v{places[0]}"]).otherwise(values)
            each.append(F.struct(F.lit(code).alias("idx_type"), F.lit(name).alias("idx_name"), values.alias("values")))
        return sections.select("db", "sysno", F.explode(F.array(*each)).alias("k")).select("db", "k.idx_type", "k.idx_name", "sysno", "k.values").where("size(values) > 0")

    if sorts:
        keys = keyed(base)
    else:
        keys = (
            base
            .select("db", F.lit("s").alias("idx_type"), F.lit("").alias("idx_name"), "sysno", F.array().cast("array<string>").alias("values"))
            .limit(0)
        )
    kept = records.withColumns({"sysno": F.col(sysno).cast("long"), "db": db if isinstance(db, Column) else F.lit(db)})
    dealt_keys = (keys, lambda n: keyed(base.select(*read).repartition(n, "sysno"))) if sorts else None
    return Index(kept, postings, keys, Plan(tuple(fields), section, rank), types=types, made=(postings, lambda n: posted(base.repartition(n, "sysno"))), keyed=dealt_keys)


def joined_indexes(*parts: Index) -> Index:
    """Several databases as one index; records keep the columns that all have."""
    common = [c for c in parts[0].records.columns if all(c in p.records.columns for p in parts)]
    both = lambda pick: reduce(DataFrame.unionByName, [pick(p) for p in parts])
    return Index(both(lambda p: p.records.select(*common)), both(lambda p: p.postings), both(lambda p: p.sortkeys))


def always_matches(index: Index, idx_name: str, idx_type: str) -> DataFrame:
    """A key at position 1 for every record and section that has the index."""
    own = index.postings.where((F.col("idx_type") == idx_type) & (F.col("idx_name") == idx_name) & (F.col("cat") == "index"))
    return own.groupBy("static_rank", "db", "sysno", "section_id").agg(F.lit(0).cast("long").alias("segment"), F.lit(1).cast("long").alias("seqno"))


def all_records(index: Index, rank: Column | None = None) -> DataFrame:
    """A key for every record, also one without a term, at the position of its number."""
    if index.records is None:
        return (
            index.postings
            .select("db", "sysno")
            .distinct()
            .select(F.lit(0).cast("long").alias("static_rank"), "db", "sysno", F.lit(0).cast("long").alias("section_id"), F.lit(0).cast("long").alias("segment"), F.col("sysno").alias("seqno"))
        )
    named = index.plan.rank if index.plan else None
    static = rank if rank is not None else F.coalesce(F.col(named).try_cast("long"), F.lit(0)) if named else F.lit(0)
    return (
        index.records
        .select(static.cast("long").alias("static_rank"), "db", "sysno", F.lit(0).cast("long").alias("section_id"), F.lit(0).cast("long").alias("segment"), F.col("sysno").alias("seqno"))
        .distinct()
    )


# ---- versions

_POSTINGS = "db string, cat string, term string, static_rank long, sysno long, section_id long, segment long, seqno long, idx_type string, idx_name string"
_SORTKEYS = "db string, sysno long, values array<string>, idx_type string, idx_name string"
_TERMS = "db string, term string, docs long, occurrences long, idx_type string, idx_name string"
_CATALOG = "db string, cat string, idx_type string, idx_name string, doc_occ long, term_occ long"


#: Text and records whose postings one task sorts and writes.
TASK_BYTES, TASK_ROWS = 8 << 20, 50_000


class Store:
    """Versions of an index under one directory.

    A version is a list of layers; a later layer replaces the records that it names as gone. Layers are
    written aside and become visible all at once by publishing a numbered manifest, which succeeds for one
    writer only; a reader pins the layers it was given, and a crash leaves the former version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.folder = Folder(spark, root)
        self.manifests = Manifests(self.folder)

    def version(self) -> int:
        return self.manifests.latest()[0]

    def _layer(self, index: Index, number: int, gone: DataFrame | None) -> str:
        name = f"v{number}"
        at = f"{self.root}/{name}"
        index.records.write.mode("error").parquet(f"{at}/records")
        by = ["idx_type", "idx_name", "term", "db", "sysno"]
        place = F.row_number().over(Window.partitionBy(*by).orderBy("section_id", "seqno"))  # needs no shuffle, and its sort is that of the files
        n = self._partitions(at)
        rows = index.by_record(n).select(*POSTING, (place == 1).alias("lead"))
        if (one := index.only()) and all(re.fullmatch(r"\w+", x) for x in one):  # the same directory, without a sort by its name
            rows.drop("idx_type", "idx_name").write.parquet(f"{at}/postings/idx_type={one[0]}/idx_name={one[1]}")
        else:
            rows.write.partitionBy("idx_type", "idx_name").parquet(f"{at}/postings")
        stored = self.spark.read.schema(f"lead boolean, {_POSTINGS}").parquet(f"{at}/postings")
        by = ["db", "idx_type", "idx_name", "term"]
        own = stored.where((F.col("cat") == "index") & (F.col("term") != FIRST_MARK))
        terms = own.groupBy(*by).agg(F.count_if("lead").alias("docs"), F.count("*").alias("occurrences"))
        terms.sortWithinPartitions("idx_type", "idx_name", "term", "db").write.partitionBy("idx_type", "idx_name").parquet(f"{at}/terms")
        self._catalog(index, stored).coalesce(1).write.parquet(f"{at}/catalog")
        keys = index.keys_by_record(n).select("db", "sysno", "values", "idx_type", "idx_name")
        keys.sortWithinPartitions("idx_type", "idx_name", "db", "sysno").write.partitionBy("idx_type", "idx_name").parquet(f"{at}/sortkeys")
        if gone is not None:
            gone.select(*RECORD).distinct().write.parquet(f"{at}/gone")
        if index.plan is not None:
            self.folder.create(f"{name}/plan.json", json.dumps(asdict(index.plan)))
        return name

    @staticmethod
    def _catalog(index: Index, stored: DataFrame) -> DataFrame:
        """``Index.catalog`` of the stored postings; the leads of the first marks count records, other indexes are shuffled by record."""
        key, mark = ["db", "cat", "idx_type", "idx_name"], F.col("lead") & (F.col("term") == FIRST_MARK)
        marked = stored.where(index.marked()).groupBy(*key).agg(F.count_if(mark).alias("doc_occ"), F.count("*").alias("term_occ"))
        return marked.unionByName(replace(index, postings=stored.where(~index.marked()), catalog_table=None).catalog())

    def _partitions(self, at: str) -> int:
        """So many that a task sorts the postings of ``TASK_BYTES`` of text, or of ``TASK_ROWS`` records, in memory."""
        records = self.spark.read.parquet(f"{at}/records")
        texts = [F.octet_length(F.col(f"`{c}`").cast("string")) for c, kind in records.dtypes if kind in ("string", "binary") or kind.startswith("array")]
        each = reduce(lambda x, y: x + y, [F.coalesce(t, F.lit(0)).cast("long") for t in texts], F.lit(0).cast("long"))
        n, size = records.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
        return max(1, -(-size // TASK_BYTES), -(-n // TASK_ROWS))

    def _publish(self, index: Index, shadow: bool, layered: bool, gone: DataFrame | None = None) -> int:
        number, state = self.manifests.latest()
        if not self.folder.create("writer.lock", str(number)):
            raise Locked("another writer is at work; unlock() after a crash")
        try:
            name = self._layer(index, number + 1, gone)
            layers = [*(state["pending"] or state["layers"] if layered else []), name]
            new = {"layers": state["layers"], "pending": layers} if shadow else {"layers": layers, "pending": None}
            self.manifests.publish(number, new)
        finally:
            self.unlock()
        return number + 1

    def unlock(self) -> None:
        """Removes a writer's lock; by hand only after a crash."""
        self.folder.delete("writer.lock")

    def write(self, index: Index, shadow: bool = False) -> int:
        """Replaces the whole index; with shadow the version stays invisible until commit()."""
        return self._publish(index, shadow, False)

    def merge(self, changed: Index, gone: DataFrame, shadow: bool = False) -> int:
        """Adds a layer: the records ``gone`` (db, sysno) go, those of ``changed`` come. Nothing else is written or analysed again."""
        return self._publish(changed, shadow, True, gone)

    def commit(self) -> None:
        number, state = self.manifests.latest()
        if state["pending"]:
            self.manifests.publish(number, {"layers": state["pending"], "pending": None})

    def clean(self) -> None:
        """Drops what was written but not committed, and layers that the newest version does not name."""
        number, state = self.manifests.latest()
        if state["pending"]:
            self.manifests.publish(number, {"layers": state["layers"], "pending": None})
        for name in self.folder.names():
            if name.startswith("v") and name[1:].isdigit() and name not in state["layers"]:
                self.folder.delete(name)

    def compact(self) -> int:
        """One layer from all; readers of the old ones are not disturbed until clean()."""
        return self.write(self.read())

    def init(self) -> None:
        """An empty index."""
        number, _ = self.manifests.latest()
        self.manifests.publish(number, {"layers": [], "pending": None})

    def drop_database(self, db: str) -> int:
        """A version without the records of a database; an unknown one changes nothing."""
        now = self.read()
        gone = now.records.where(F.col("db") == db).select(*RECORD)
        none = Index(now.records.limit(0), now.postings.limit(0), now.sortkeys.limit(0), now.plan)
        return self.merge(none, gone)

    def _layer_index(self, name: str) -> Index:
        at = f"{self.root}/{name}"
        load = lambda table, schema: self.spark.read.schema(schema).parquet(f"{at}/{table}")
        plan = None
        if self.folder.exists(f"{name}/plan.json"):
            spec = json.loads(self.folder.read(f"{name}/plan.json"))
            plan = Plan(tuple(Field(f["column"], tuple(map(tuple, f["indexes"]))) for f in spec["fields"]), spec["section"], spec["rank"])
        led = load("postings", f"lead boolean, {_POSTINGS}")
        postings = led.select(*POSTING)
        return Index(self.spark.read.parquet(f"{at}/records"), postings, load("sortkeys", _SORTKEYS), plan, load("terms", _TERMS), load("catalog", _CATALOG), led=(postings, led))

    def read(self, version: int | None = None) -> Index:
        """The newest version, or the one of that number."""
        number, state = self.manifests.latest()
        if version is not None and version != number:
            state = json.loads(self.folder.read(f"manifest-{version:012}.json"))
        if not state["layers"]:
            raise FileNotFoundError(f"no version under {self.root}")
        out = None
        for name in state["layers"]:
            layer = self._layer_index(name)
            if out is None:
                out = layer
                continue
            gone = self.spark.read.schema("db string, sysno long").parquet(f"{self.root}/{name}/gone")
            rest = lambda old, new, gone=gone: old.join(gone, RECORD, "left_anti").unionByName(new)
            out = Index(rest(out.records, layer.records), rest(out.postings, layer.postings), rest(out.sortkeys, layer.sortkeys), layer.plan or out.plan)
        return out


# ---- changes


#: Order of changes of a key at the same time.
ACTIONS = ("adelete", "delete", "insert", "replace", "update")


def apply_changes(records: DataFrame, changes: DataFrame, key: str = "match_key") -> tuple[DataFrame, DataFrame]:
    """(new records, errors): insert, replace, update, delete and adelete rows of ``changes`` (column action) by ``key``.

    insert fails if the key exists, replace and delete if it does not; update does either, adelete ignores a
    missing record. The changes of a key follow each other by column ``at`` (equal times in the order of
    ACTIONS), each judged by what the ones before it have left: after insert and update, whether or not they
    succeed, a record exists, after delete and adelete none does, and replace changes nothing about that.
    """
    known = records.select(F.col(key).alias("_key")).distinct()
    order = F.struct("at", F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")).alias("_a"))
    rows = changes.join(known, changes[key] == known["_key"], "left").withColumn("_known", F.col("_key").isNotNull()).withColumn("_order", order)
    leaves = F.when(F.col("action").isin("insert", "update"), True).when(F.col("action").isin("delete", "adelete"), False)
    earlier = Window.partitionBy(key).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_leaves", leaves).withColumn("_there", F.coalesce(F.last("_leaves", True).over(earlier), "_known"))
    wrong = (F.col("action") == "insert") & F.col("_there") | F.col("action").isin("replace", "delete") & ~F.col("_there")
    errors = rows.where(wrong).select(key, "action", F.when(F.col("_there"), "exists").otherwise("missing").alias("error"))
    good = rows.where(~wrong).withColumn("_row", F.struct(*records.columns))
    content = F.col("action").isin("insert", "replace", "update")
    last = good.groupBy(key).agg(F.max_by("action", "_order").alias("_last"), F.max_by("_row", F.when(content, F.col("_order"))).alias("_new"))
    added = last.where(F.col("_last").isin("insert", "replace", "update")).select("_new.*")
    return records.join(last.select(key), key, "left_anti").unionByName(added), errors


def changed_keys(changes: DataFrame, errors: DataFrame, key: str = "match_key") -> DataFrame:
    """Keys that a batch may have touched: all of it but those with errors only."""
    wrong = errors.groupBy(key).agg(F.count("*").alias("_w"))
    every = changes.groupBy(key).agg(F.count("*").alias("_n"))
    return every.join(wrong, key, "left").where("_w is null or _w < _n").select(key)


def match_keys(records: DataFrame, spec: str, index: Index | None = None) -> DataFrame:
    """``records`` with a column match_key by a specification: ``(name)`` stands for the record's terms of an index,
    ``$group $database $filename $type`` for columns, quoted text for itself; parts are joined by \\x01. A part without
    a value gives a null key, so such a record matches none.
    """
    parts, out, used = re.findall(r"\([^)]*\)|\$\w+|\"[^\"]*\"|'[^']*'", spec), records, []
    for i, part in enumerate(parts):
        if part[0] == "(":
            name, _, code = part[1:-1].replace(",", ":").partition(":")
            own = index.postings.where((F.col("idx_name") == name.strip()) & (F.col("idx_type") == (code.strip() or "w")) & (F.col("term") != FIRST_MARK))
            value = (
                own
                .groupBy(*RECORD)
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", "seqno", "term"))), lambda x: x["term"]), " ").alias(f"_k{i}"))
            )
            out = out.join(value, RECORD, "left")
            used.append(F.col(f"_k{i}"))
        elif part[0] == "$":
            column = {"$database": "db", "$type": "file_type"}.get(part, part[1:])
            used.append(F.col(column).cast("string"))
        else:
            used.append(F.lit(part[1:-1]))
    missing = reduce(lambda x, y: x | y, [u.isNull() for u in used], F.lit(not used))
    return out.withColumn("match_key", F.when(~missing, F.concat_ws("\x01", *used))).drop(*[f"_k{i}" for i in range(len(parts))])


def file_changes(known: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, action): insert for new files, update for newer ones, delete for missing ones."""
    old = known.select("path", F.col("mtime").alias("was"))
    both = listing.select("path", F.col("mtime").alias("now")).join(old, "path", "full_outer")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("now") > F.col("was"), "update")
    return both.select("path", action.alias("action")).where("action is not null")


#: Places in the bitmap of ``key_delta`` (8 MB of words), and groups of terms in which a record is compared.
DELTA_BITS, DELTA_GROUPS = 1 << 26, 16


def key_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """The postings to add (+1) and to take away (-1).

    Sums of hashes tell which groups of terms of a record are the same on both sides (by 96 bits); those are not
    shuffled. The others meet by record. A full bitmap lets more postings through and changes nothing else. Both
    sides are read twice.
    """
    key = POSTING
    both = old.select(*key, F.lit(-1).cast("long").alias("step")).unionAll(new.select(*key, F.lit(1).cast("long").alias("step")))
    group, low = F.pmod(F.hash("idx_type", "idx_name", "term"), F.lit(DELTA_GROUPS)), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    digest = F.xxhash64(*key)
    sums = [F.sum("step"), F.sum(F.col("step") * low(digest)), F.sum(F.col("step") * F.shiftrightunsigned(digest, 32)), F.sum(F.col("step") * F.hash(*key))]
    per = both.groupBy(*RECORD, group.alias("_g")).agg(*[x.alias(f"_{i}") for i, x in enumerate(sums)]).where("_0 <> 0 or _1 <> 0 or _2 <> 0 or _3 <> 0")
    spot = lambda g: F.pmod(F.xxhash64(*RECORD, g), F.lit(DELTA_BITS))
    words = per.select(spot(F.col("_g")).alias("_s")).groupBy(F.expr("_s div 64").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_s % 64 as int))")).alias("_b"))
    placed = both.withColumn("_s", spot(group)).withColumn("_w", F.expr("_s div 64")).join(F.broadcast(words), "_w")
    rest = placed.where("shiftright(_b, cast(_s % 64 as int)) & 1L = 1").select(*key, "step")
    return rest.repartition(_many(both), "sysno").groupBy(*key).agg(F.sum("step").alias("step")).where("step <> 0")


def _many(df: DataFrame) -> int:
    """Partitions that grow with what a plan is expected to read, so that a task's part stays in memory."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(size // TASK_BYTES, 20_000)) if size < 1 << 60 else least


def check(index: Index) -> DataFrame:
    """(fault, n): postings and sort keys without a record, records without a posting."""
    ids = index.records.select(*RECORD).distinct()
    posted = index.postings.select(*RECORD).distinct()
    faults = {
        "postings without record": posted.join(ids, RECORD, "left_anti"),
        "records without posting": ids.join(posted, RECORD, "left_anti"),
        "sort keys without record": index.sortkeys.select(*RECORD).distinct().join(ids, RECORD, "left_anti"),
    }
    return reduce(DataFrame.unionAll, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("fault"), "n") for k, d in faults.items()])


BOUNDS = (1, 2, 3, 6, 10, 20, 30, 60, 100, 200, 300, 600, 1000, 10000, 100000, 1000000)


def posting_histogram(index: Index) -> DataFrame:
    """(idx_name, upto, n_terms): how many terms have posting lists of each length class."""
    lengths = index.dictionary().groupBy("idx_type", "idx_name", "term").agg(F.sum("occurrences").alias("n"))
    upto = F.coalesce(*[F.when(F.col("n") <= b, b) for b in BOUNDS], F.lit(-1)).cast("long")
    return lengths.groupBy("idx_type", "idx_name", upto.alias("upto")).agg(F.count("*").alias("n_terms"))


def normalise(text: Column, code: str = "w") -> Column:
    """The text as terms of a field type are spelt."""
    return normalised(text, FIELD_TYPES[code])
