"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c). Projections on leading principal
directions only shorten distances, so vectors sorted by their grid cells (side epsilon) on those
directions form a sequence in which near vectors meet in few intervals. The sequence is cut into blocks of
bounded bytes; intervals of blocks are joined recursively and a pair is skipped once the boxes around two
intervals are farther apart than epsilon. A box has the projections and the length of what they leave of a
vector, which two near vectors share up to epsilon too. Blocks that remain are dealt in tiles, so that a block
travels once for many partners; in a task the recursion goes on over strips of a block, skipped by their boxes
or by their centres and radii in all dimensions. Strips that remain are compared in full, in double precision.
A task returns link counts and a spanning forest of its links, never the links themselves.

Vectors without structure along few directions (evenly spread over many dimensions) leave nothing to skip:
every pair of blocks is then compared, as any exact method must.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import scratch, written

DIRECTIONS, BLOCK, STRIP = 8, 4096, 256
#: Bytes of a block's vectors at most, and blocks along each side of a tile.
BLOCK_BYTES, TILE = 4 << 20, 6
#: Vectors from which the principal directions are learned; results do not depend on them.
SAMPLE = 4000
#: Block summaries held by a task at a time; more are met a slice after the other.
SUMMARIES = 100_000
_SLACK = 1e-9


def _valid(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows whose vector can have a cosine: no null or non-finite component, not zero; doubles."""
    e = F.col(embedding).cast("array<double>")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(vec_id).cast("long").alias("id"), e.alias("e")).where(F.col("id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision."""
    return _unit(np.asarray(column.flatten(), np.float64).reshape(-1, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(vectors: DataFrame, dim: int) -> np.ndarray:
    """(dim, up to DIRECTIONS) orthonormal principal directions of a bounded sample."""
    rows = vectors.select("e", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).toArrow()
    x = _matrix(rows.column("e").combine_chunks(), dim)
    x = x - x.mean(0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :DIRECTIONS]


def _boxed(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(vectors, directions + 1): projections of unit vectors, and the length of the rest. Distances only shrink."""
    p = x @ basis
    return np.concatenate([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1, keepdims=True)))], 1)


def _block_rows(dim: int, kind: str) -> int:
    return max(16, min(BLOCK, BLOCK_BYTES // (dim * np.dtype(kind).itemsize)))


def _sequence(vectors: DataFrame, basis: np.ndarray, eps: float, kind: str, n: int) -> DataFrame:
    """Blocks of the grid order: (block, lo, hi, ids, data), of bounded bytes, the components as given (``kind``)."""
    dim, k = basis.shape
    most = _block_rows(dim, kind)

    def project(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                raw = np.asarray(part.column(1).flatten(), np.float64).reshape(-1, dim)
                x = _unit(raw)
                cells = np.floor(x @ basis / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary()), *(pa.array(c) for c in cells.T)], names)

    def cut(batches):
        from pyspark import TaskContext

        at, ids, rows = TaskContext.get().partitionId() << 32, [], []

        def block():
            p = _boxed(_unit(np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(np.float64)), basis)
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([b"".join(rows)])], ["block", "lo", "hi", "ids", "data"])

        for batch in batches:
            for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                rows.append(r)
                if len(ids) == most:
                    yield block()
                    at, ids, rows = at + 1, [], []
        if ids:
            yield block()

    names = ["id", "v", *(f"c{i}" for i in range(k))]
    placed = vectors.mapInArrow(project, "id long, v binary, " + ", ".join(f"c{i} int" for i in range(k)))
    order = placed.repartitionByRange(*names[2:], "id").sortWithinPartitions(*names[2:], "id").select("id", "v")
    order = order.coalesce(max(1, -(-n // (4 * most))))  # neighbours in the order, so that blocks are full
    return order.mapInArrow(cut, "block long, lo array<double>, hi array<double>, ids binary, data binary")


def near_intervals(own: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray, eps: float) -> list[int]:
    """Positions of the sequence whose boxes are within eps of the box ``own``: halves are skipped as soon as their joint box is too far."""
    out = []
    stack = [(0, len(lo))]
    while stack:
        a, b = stack.pop()
        if a >= b:
            continue
        gap = np.maximum(0, np.maximum(lo[a:b].min(0) - own[1], own[0] - hi[a:b].max(0)))
        if gap @ gap > eps * eps + _SLACK:
            continue
        if b - a == 1:
            out.append(a)
        else:
            stack += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def _places(blocks: DataFrame) -> DataFrame:
    """(block, place): blocks numbered in order; their numbers hold the partition and the place in it, so counts of partitions are enough."""
    part = F.shiftright("block", 32)
    number = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = number.select("part", before.alias("from"))
    return blocks.select("block", part.alias("part"), F.col("block").bitwiseAND(F.lit((1 << 32) - 1)).alias("at")).join(starts, "part").select("block", (F.col("from") + F.col("at")).alias("place"))


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(i, j, pi, pj), i <= j: block pairs that may hold links, and their places. Summaries are read SUMMARIES at a time."""
    summary = blocks.select("block", "lo", "hi")
    spark, last, out, base = blocks.sparkSession, None, None, 0
    places = _places(blocks)
    while True:
        part = (summary if last is None else summary.where(F.col("block") > last)).orderBy("block").limit(SUMMARIES).toArrow()
        if not part.num_rows and out is not None:
            return out
        ids = np.asarray(part.column("block"), np.int64)
        boxes = [np.array(part.column(c).to_pylist(), float).reshape(len(ids), -1) for c in ("lo", "hi")]
        shared = spark.sparkContext.broadcast((ids, *boxes, base))

        def run(batches, shared=shared):
            known, lo, hi, base = shared.value
            for batch in batches:
                i, j, p, q = [], [], [], []
                for b, x, y, place in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    near = [m for m in near_intervals((np.array(x), np.array(y)), lo, hi, eps) if known[m] >= b]
                    i += [b] * len(near)
                    j += [int(known[m]) for m in near]
                    p += [place] * len(near)
                    q += [base + m for m in near]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (i, j, p, q)], ["i", "j", "pi", "pj"])

        more = summary.join(places, "block").select("block", "lo", "hi", "place").mapInArrow(run, "i long, j long, pi long, pj long")
        out = more if out is None else out.unionAll(more)
        base += len(ids)
        if part.num_rows < SUMMARIES:
            return out
        last = int(ids[-1])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, nodes 0..n-1 linked by (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        new = new[root]
        if np.array_equal(new, root):
            return root
        root = new


def _strips(x: np.ndarray, basis: np.ndarray) -> list[tuple]:
    """(from, to, box, centre, radius) of every strip of a block."""
    out, boxes = [], _boxed(x, basis)
    for s in range(0, len(x), STRIP):
        part, box = x[s : s + STRIP], boxes[s : s + STRIP]
        centre = part.mean(0)
        out.append((s, s + len(part), (box.min(0), box.max(0)), centre, float(np.sqrt(((part - centre) ** 2).sum(1).max()))))
    return out


def _apart(a: tuple, b: tuple, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a[2][0] - b[2][1], b[2][0] - a[2][1]))
    return gap @ gap > eps * eps + _SLACK or np.sqrt(((a[3] - b[3]) ** 2).sum()) - a[4] - b[4] > eps + _SLACK


def _compared(pairs: DataFrame, blocks: DataFrame, basis: np.ndarray, least: float, eps: float, kind: str) -> DataFrame:
    """(id, n, root) for every vector with a link in a tile of block pairs."""
    dim = basis.shape[0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = {b: i for i, b in enumerate(left.column("block").to_pylist())}
        ids = [np.frombuffer(v.as_buffer(), np.int64) for v in left.column("ids")]
        start = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        vectors, strips = {}, {}

        def block(i: int) -> tuple[np.ndarray, list]:
            if i not in vectors:
                vectors[i] = _unit(np.frombuffer(left.column("data")[i].as_buffer(), kind).reshape(-1, dim).astype(np.float64))
                strips[i] = _strips(vectors[i], basis)
            return vectors[i], strips[i]

        number, root = np.zeros(start[-1], np.int64), np.arange(start[-1])
        for i, j in zip(right.column("i").to_pylist(), right.column("j").to_pylist()):
            i, j = order[i], order[j]
            (x, own), (y, other) = block(i), block(j)
            for s in own:
                near = [t for t in other if (i != j or t[0] >= s[0]) and not _apart(s, t, eps)]
                for t in near:
                    a, b = np.nonzero(x[s[0] : s[1]] @ y[t[0] : t[1]].T >= least)
                    if i == j and s[0] == t[0]:
                        a, b = a[a < b], b[a < b]
                    if len(a):
                        a, b = a + s[0] + start[i], b + t[0] + start[j]
                        number += np.bincount(a, minlength=len(number)) + np.bincount(b, minlength=len(number))
                        a, b = root[a], root[b]
                        touched, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                        low = touched[forest(at[: len(a)], at[len(a) :], len(touched))]
                        change = np.arange(len(root))
                        change[touched] = low
                        root = change[root]
        # the least id of each local component stands for it
        every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        low = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(low, root, every)
        hit = number > 0
        return pa.table({"id": every[hit], "n": number[hit], "root": low[root][hit]})

    tiled = pairs.select(F.floor(F.col("pi") / TILE).alias("ti"), F.floor(F.col("pj") / TILE).alias("tj"), "i", "j")
    needed = tiled.select(F.col("ti").alias("ui"), F.col("tj").alias("uj"), F.explode(F.array("i", "j")).alias("block")).distinct()
    shipped = needed.join(blocks.select("block", "ids", "data"), "block")
    return shipped.groupBy("ui", "uj").cogroup(tiled.groupBy("ti", "tj")).applyInArrow(run, "id long, n long, root long")


def linked(embeddings: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``embeddings``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
    link with nothing; vectors of different length are never compared. Rows that repeat an id are
    vectors of their own that share one node and the sum of their links; a link between two of them counts. An
    empty table gives no rows. Other columns are not looked at.
    """
    kind = "f4" if embeddings.schema[embedding].dataType.elementType.typeName() == "float" else "f8"
    eps = float(np.sqrt(2 - 2 * least))
    ids = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"))
    with scratch() as keep:
        valid, links = keep(_valid(embeddings, vec_id, embedding), "vectors"), None
        for row in valid.groupBy(F.size("e").alias("dim")).count().orderBy("dim").toLocalIterator():
            same = valid.where(F.size("e") == row["dim"])
            basis = directions(same, row["dim"])
            blocks = keep(_sequence(same, basis, eps, kind, row["count"]), "blocks")
            pairs = keep(_pairs(blocks, eps), "pairs")
            found = keep(_compared(pairs, blocks, basis, least, eps, kind), "links")
            links = found if links is None else links.unionAll(found)
        if links is None:
            return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        number = written(links.groupBy("id").agg(F.sum("n").alias("n_links")), "numbers")
        found = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = ids.join(number, ids["vec_id"] == number["id"], "left").drop("id").join(found, ids["vec_id"] == found["node"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
