"""MinHash near-dedup with min-max hashing.

Each permutation is evaluated once and gives two signature values, the least and the greatest image of a
document's shingles. Bands of these values choose candidates; a link counts only when the full shingle
sets confirm it. Documents with equal sets are one class from the start. Every class is first compared
with the smallest of each of its buckets, the heads. Classes that share a head and are left in different
components are then compared block by block, so no link between components is lost and no group of
copies is expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .prefilter import apart, likely
from .store import joined, scratch, written
from .textnp import LOWER, Texts, mix, shingles, slices, string_column

PERMUTATIONS, ROWS = 48, 4
BANDS = 2 * PERMUTATIONS // ROWS
_GEN = np.random.default_rng(11)
_A = _GEN.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _GEN.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_SALT = np.uint64(0x9E3779B97F4A7C15)
#: Members and set items of a block of a large star (of one long text more), set items met at once, columns of a product.
BLOCK_ROWS, BLOCK_ITEMS, PAIR_ITEMS, COLUMNS = 128, 200_000, 1 << 20, 4096


def shingle_sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text, and their n + 1 bounds. With fewer than ``k`` words the sequence is one shingle."""
    starts, ends = t.words()
    h = t.hashes(starts, ends)
    bounds = t.split_by_text(starts)
    n = np.diff(bounds)
    text = np.repeat(np.arange(t.n), n)
    windows = shingles(h, k)
    inside = np.flatnonzero(text[: len(windows)] == text[len(h) - len(windows) :]) if len(windows) else np.zeros(0, np.int64)
    owner, value = text[inside], windows[inside]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = mix(n[few].astype(np.uint64) * _SALT)
        for i in range(k - 1):
            more = n[few] > i
            short[more] = mix(short[more] * np.uint64(0xD6E8FEB86659FD93) + h[bounds[few[more]] + i])
        owner, value = np.concatenate([owner, few]), np.concatenate([value, short])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    _, first = np.unique(mix(value + owner.astype(np.uint64) * _SALT), return_index=True)
    first.sort()
    owner, value = owner[first], value[first]
    return value, np.searchsorted(owner, np.arange(t.n + 1))


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BANDS) band keys; zero for a text without shingles."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    if not len(full):
        return out
    at, sig = bounds[:-1][full], np.empty((2 * PERMUTATIONS, len(full)), np.uint64)
    for i in range(PERMUTATIONS):
        image = value * _A[i] + _B[i]
        sig[2 * i], sig[2 * i + 1] = np.minimum.reduceat(image, at), np.maximum.reduceat(image, at)
    for b in range(BANDS):
        # the values of a band come from different permutations
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sig[(b * ROWS + r) % PERMUTATIONS * 2 + (b * ROWS + r) // PERMUTATIONS])
        out[full, b] = key
    return out


def _signed(documents: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            column, ids, hashes = string_column(batch, "text"), *(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "th"))
            for lo, hi in slices(column):
                value, bounds = shingle_sets(Texts(column.slice(lo, hi - lo), LOWER), k)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value * np.uint64(c) + np.uint64(c)))]) for c in (3, 7)]
                s1, s2 = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                bands = signatures(value, bounds).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), hashes.slice(lo, hi - lo), pa.array(np.diff(bounds).astype(np.int64)), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))],
                    ["doc_id", "th", "n", "s1", "s2", "bands"],
                )

    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(run, "doc_id long, th long, n long, s1 long, s2 long, bands array<long>")


def shared_counts(value: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Size of the intersection of the sets ``left[i]`` and ``right[i]``, some PAIR_ITEMS items of sets at a time."""
    size, out = np.diff(bounds), np.zeros(len(left), np.int64)
    ends = np.cumsum(size[left] + size[right])
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIR_ITEMS, "right")))
        keys, owners = [], []
        for side in (left[lo:hi], right[lo:hi]):
            n = size[side]
            owner = np.repeat(np.arange(hi - lo), n)
            at = np.arange(len(owner)) + np.repeat(bounds[side] - np.cumsum(n) + n, n)
            keys.append(mix(value[at] + owner.astype(np.uint64) * _SALT))
            owners.append(owner)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key)
        key = key[order]
        out[lo:hi] = np.bincount(owner[order[1:][key[1:] == key[:-1]]], minlength=hi - lo)
        lo = hi
    return out


def shared_matrix(value: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every set of ``right``, by products of 0/1 matrices."""
    sides = []
    for side in (left, right):
        n = np.diff(bounds)[side]
        owner = np.repeat(np.arange(len(side)), n)
        sides.append((owner, value[np.arange(len(owner)) + np.repeat(bounds[side] - np.cumsum(n) + n, n)]))
    common = np.intersect1d(np.unique(sides[0][1]), np.unique(sides[1][1]), assume_unique=True)
    out = np.zeros((len(left), len(right)))
    placed = []
    for owner, items in sides:
        column = np.searchsorted(common, items)
        known = np.flatnonzero(common[np.minimum(column, len(common) - 1)] == items) if len(common) else column[:0]
        known = known[np.argsort(column[known], kind="stable")]
        placed.append((owner[known], column[known]))
    for lo in range(0, len(common), COLUMNS):
        parts = []
        for (owner, column), side in zip(placed, (left, right)):
            a, b = np.searchsorted(column, [lo, lo + COLUMNS])
            part = np.zeros((len(side), COLUMNS), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.round().astype(np.int64)


def _compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, similarity, linked) of the pairs (a, b), from their full sets."""

    def run(batches):
        for batch in batches:
            left, right = string_column(batch, "ta"), string_column(batch, "tb")
            for lo, hi in slices(left):
                n = hi - lo
                sets = [shingle_sets(Texts(column.slice(lo, n), LOWER), k) for column in (left, right)]
                value = np.concatenate([v for v, _ in sets])
                bounds = np.concatenate([sets[0][1], sets[1][1][1:] + sets[0][1][-1]])
                size = np.diff(bounds)
                both = shared_counts(value, bounds, np.arange(n), np.arange(n) + n)
                union = size[:n] + size[n:] - both
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both / np.maximum(1, union)), pa.array((both > 0) & (100 * both >= percent * union))], ["a", "b", "similarity", "linked"])

    first = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double, linked boolean")


def _bridges(stars: DataFrame, texts: DataFrame, k: int, percent: int, keep) -> DataFrame:
    """(a, b): components with a link between members of one star (head, id, n, similarity, c).

    Members of a star are compared with one another unless they are of one component, their sizes differ
    too much, or their similarities to the head do: 1 - similarity is a metric, so these differ by 1 - least
    at most where there is a link. A large star is dealt into blocks of BLOCK_ROWS members; blocks within its
    largest component are not met, other pairs of blocks are, each in one row.
    """
    per = stars.groupBy("head", "c").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    per = per.groupBy("head").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("m").alias("m0"), F.max_by("s", F.struct("m", "c")).alias("s0"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("apart")).where("apart > 1")
    blocks = lambda m, s: F.ceil(F.greatest(m / BLOCK_ROWS, s / BLOCK_ITEMS)).cast("int")
    per = per.withColumn("one", (F.col("m") <= BLOCK_ROWS) & (F.col("s") <= BLOCK_ITEMS))
    per = per.select("head", "main", "one", F.when(F.col("one"), 0).otherwise(blocks(F.col("m0"), F.col("s0"))).alias("n0"), F.when(F.col("one"), 1).otherwise(blocks(F.col("m") - F.col("m0"), F.col("s") - F.col("s0"))).alias("n1"))
    per = keep(per, "stars")
    rows = stars.join(per, "head").withColumn("side", F.when(~F.col("one") & (F.col("c") == F.col("main")), 0).otherwise(1))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    rows = rows.join(texts, "id").select("head", "side", "slot", F.struct("c", "n", "similarity", "text").alias("x"))
    dealt = rows.groupBy("head", "side", "slot").agg(F.collect_list("x").alias("x"))
    dealt = keep(dealt.select("head", "side", "slot", *(F.col(f"x.{c}").alias(c) for c in ("c", "n", "similarity", "text"))), "blocks")
    other = F.explode(F.concat(F.when(F.col("n0") > 0, F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda i: F.struct(F.lit(0).alias("side"), i.alias("slot")))).otherwise(F.array().cast("array<struct<side:int,slot:int>>")), F.when(F.col("t") > 0, F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda i: F.struct(F.lit(1).alias("side"), i.alias("slot")))).otherwise(F.array().cast("array<struct<side:int,slot:int>>"))))
    crosses = per.where("not one").select("*", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("t")).select("head", "t", other.alias("o")).select("head", "t", F.col("o.side").alias("side"), F.col("o.slot").alias("slot"))
    names = ["c", "n", "similarity", "text"]
    second = dealt.where("side = 1").select("head", F.col("slot").alias("t"), *(F.col(c).alias(f"{c}_2") for c in names))
    crosses = crosses.join(dealt, ["head", "side", "slot"]).join(second, ["head", "t"]).select(*names, *(f"{c}_2" for c in names))
    alone = dealt.where("side = 1").select(*names, *(F.lit(None).cast(dealt.schema[c].dataType).alias(f"{c}_2") for c in names))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                same = row.column(4)[0].as_py() is None
                parts = [[row.column(i + j).flatten() for i in range(4)] for j in ((0,) if same else (0, 4))]
                c, n, near = (np.concatenate([np.asarray(p[i]) for p in parts]) for i in range(3))
                m = len(parts[0][0])
                first, last = np.arange(m), np.arange(m) if same else np.arange(m, len(c))
                wanted = (c[first][:, None] != c[last]) & (np.abs(near[first][:, None] - near[last]) <= 1 - percent / 100 + 1e-9)
                wanted &= 100 * np.minimum(n[first][:, None], n[last]) >= percent * np.maximum(n[first][:, None], n[last])
                if same:
                    wanted = np.triu(wanted, 1)
                i, j = np.nonzero(wanted)
                if not len(i):
                    continue
                values, bounds = [], [np.zeros(1, np.int64)]
                for p in parts:
                    column = p[3].cast(pa.large_string())
                    for lo, hi in slices(column):
                        v, b = shingle_sets(Texts(column.slice(lo, hi - lo), LOWER), k)
                        values.append(v)
                        bounds.append(b[1:] + bounds[-1][-1])
                value, at = np.concatenate(values), np.concatenate(bounds)
                i, j = first[i], last[j]
                if len(i) > 2 * len(c):
                    x, y = np.unique(i), np.unique(j)
                    both = shared_matrix(value, at, x, y)[np.searchsorted(x, i), np.searchsorted(y, j)]
                else:
                    both = shared_counts(value, at, i, j)
                yes = (both > 0) & (100 * both >= percent * (n[i] + n[j] - both))
                if yes.any():
                    found = np.unique(np.stack([np.minimum(c[i[yes]], c[j[yes]]), np.maximum(c[i[yes]], c[j[yes]])]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[1]), pa.array(found[0])], ["a", "b"])

    return alone.unionAll(crosses).repartition(F.xxhash64("c", "c_2")).mapInArrow(run, "a long, b long").distinct()


def _same_id(signed: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): classes that rows of one id have in common."""
    several = signed.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi")).where("lo <> hi").select("doc_id")
    own = signed.join(several, "doc_id").join(classes.select(*keys, "id"), keys).select("doc_id", "id")
    least = own.groupBy("doc_id").agg(F.min("id").alias("b"))
    return own.join(least, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def classified(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``documents``.

    Null texts and texts without words have no shingles and link with nothing. Rows that repeat an id are
    one node with the links of all their texts. A null id links with nothing and is kept. An empty table
    gives no rows. Other columns are not looked at.
    """
    with scratch() as keep:
        signed = keep(_signed(documents, k), "signatures")
        keys = ["n", "s1", "s2"]
        # a class is one set of shingles; its text is that of one row
        equal = signed.where("n > 0 and doc_id is not null").groupBy(*keys).agg(F.min(F.struct("doc_id", "th")).alias("row"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
        classes = keep(equal.select(*keys, F.monotonically_increasing_id().alias("id"), "row.doc_id", "row.th", "bands", "rows"), "classes")
        banded = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
        buckets = keep(banded.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1"), "buckets")
        members = joined(banded, buckets, ["band", "key"], "size").where("id <> head").groupBy("head", "id").agg(F.min("n").alias("n"))
        members = keep(members, "members")
        ids = members.select("id").unionAll(members.select(F.col("head").alias("id"))).distinct()
        wanted = classes.join(ids, "id").select("id", "doc_id", "th")
        spot = F.xxhash64("doc_id", "th").alias("id")
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("th"))
        rows = likely(rows.select(F.struct("doc_id", "th", "text").alias("row"), spot), wanted.select(spot)).select("row.*").join(wanted, ["doc_id", "th"])
        texts = keep(rows.groupBy("id").agg(F.min("text").alias("text")), "candidates")
        compared = keep(_compared(members.select(F.col("id").alias("a"), F.col("head").alias("b")), texts, k, percent), "compared")
        found = keep(components(compared.where("linked").select("a", "b").unionAll(_same_id(signed, classes, keys))), "components")

        # what the heads leave apart
        stars = members.join(compared.select(F.col("a").alias("id"), F.col("b").alias("head"), "similarity"), ["id", "head"]).join(found.withColumnRenamed("node", "id"), "id", "left")
        stars = keep(stars.select("head", "id", "n", "similarity", F.coalesce("component", "id").alias("c")), "members")
        bridged = components(keep(_bridges(stars, texts, k, percent, keep), "bridges"))
        groups = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select(*keys, "doc_id", "rows", F.coalesce("component", "id").alias("c"))
        groups = groups.join(bridged.withColumnRenamed("node", "c"), "c", "left").select(*keys, "doc_id", "rows", F.coalesce("component", "c").alias("c"))
        groups = keep(groups, "groups")
        names = groups.groupBy("c").agg(F.min("doc_id").alias("name"), F.count("*").alias("size"))
        named = keep(joined(groups, keep(names, "names"), ["c"], "size").select(*keys, "rows", "name"), "named")
        light = signed.select("doc_id", *keys)
        full = joined(light.where("n > 0 and doc_id is not null"), named, keys, "rows")
        blank = light.where("n = 0 and doc_id is not null").join(full.groupBy("doc_id").agg(F.min("name").alias("name")), "doc_id", "left")
        out = full.unionAll(blank).unionAll(light.where("doc_id is null").withColumn("name", F.lit(None).cast("long")))
        component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("name", "doc_id"))
        return written(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")), "classified")


def deduplicated(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without those that another of their group stands for; the columns stay, whatever their names.

    Null ids, null texts and texts without words stay; rows of one id stay or go together.
    """
    gone = classified(documents, k, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    # only rows that may go are shuffled; an outer join, as an anti join would be pushed below the bitmap
    maybe, stay = apart(rows, gone.select(F.col("gone").alias("id")))
    return stay.select("row.*").unionAll(maybe.join(gone, F.col("id") == F.col("gone"), "left").where("gone is null").select("row.*"))
