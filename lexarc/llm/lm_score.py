"""LM scoring by cross-entropy difference.

A target model (texts labelled good) and a background model (all texts) are interpolated bigram models
over one shared vocabulary: every word of the counted texts. Words, word pairs and words as a pair's
first are keys of 62 hashed bits and their kind; each has an exact count, so the models grow with the
corpus. They are never gathered: texts are dealt into blocks, a block sends its distinct keys to buckets
by their leading bits, a bucket adds up the counts and answers each block. A document's score is the
mean, over its tokens, of the background loss minus the target loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnp import LOWER, Texts, shingles, slices, string_column

#: Slots of a dense model, as ``losses`` takes it where a model names no keys.
BITS = 20
SLOTS = 1 << BITS
#: Bytes of text in a block and a bucket, and the least blocks; up to MANY, buckets are of FINE bytes.
BLOCK_BYTES, BUCKET_BYTES, BLOCKS, FINE, MANY = 8 << 20, 32 << 20, 128, 256 << 10, 1024
_FIRST = np.uint64(0xA0761D6478BD642F)
_KIND = np.uint64(3)
PACKED = "bucket long, block long, size long, keys binary, background binary, target binary"
ANSWER = "block long, bucket long, size long, background binary, target binary, words long, background_words long, target_words long"


def _tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the word pair that ends there, of the word before, and bounds by text.

    The first word of a text follows a start mark.
    """
    starts, ends = t.words()
    h = t.hashes(starts, ends)
    bounds = t.split_by_text(starts)
    before = np.full(len(h), _FIRST)
    before[1:] = h[:-1]
    heads = bounds[:-1][np.diff(bounds) > 0]
    before[heads] = _FIRST
    pair = shingles(np.stack([before, h], 1).ravel(), 2)[::2] if len(h) else h
    return h, pair, before, bounds


def _keyed(hashes: np.ndarray, kind: int) -> np.ndarray:
    return hashes & ~_KIND | np.uint64(kind)


def _pack(a: np.ndarray) -> bytes:
    """Numbers as planes of bytes, no more than the largest needs."""
    a = np.ascontiguousarray(a, np.uint64)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 0
    return a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return out.view(np.uint64).ravel()


def _down(buckets: int) -> np.uint64:
    return np.uint64(64 - (buckets.bit_length() - 1))


def _distinct(texts: pa.Array, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs in all texts and in the ``good`` ones."""
    keys, every, chosen = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(texts):
        *hashes, bounds = _tokens(Texts(texts.slice(lo, hi - lo), LOWER))
        mark = np.repeat(good[lo:hi], np.diff(bounds))
        key, at = np.unique(np.concatenate([_keyed(h, kind) for kind, h in enumerate(hashes)]), return_inverse=True)
        keys.append(key)
        every.append(np.bincount(at, minlength=len(key)))
        chosen.append(np.bincount(at[np.tile(mark, 3)], minlength=len(key)))
    return _summed(*map(np.concatenate, (keys, every, chosen)))


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[heads], *(np.add.reduceat(x[order], heads) if len(heads) else x for x in numbers))


def _dealt(keys: np.ndarray, every: np.ndarray, chosen: np.ndarray, block: int, buckets: int) -> pa.RecordBatch:
    """A row for every bucket, also for those that get no key: each answers with its part of the totals."""
    down = _down(buckets)
    edges = np.append(np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << down), len(keys))
    out = [[], [], []]
    for b in range(buckets):
        lo, hi = edges[b], edges[b + 1]
        for column, a in zip(out, (np.diff(keys[lo:hi], prepend=np.uint64(b) << down), every[lo:hi], chosen[lo:hi])):
            column.append(_pack(a))
    arrays = [pa.array(np.arange(buckets)), pa.array(np.full(buckets, block)), pa.array(np.diff(edges)), *(pa.array(x, pa.binary()) for x in out)]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "block", "size", "keys", "background", "target"])


def _plan(documents: DataFrame) -> tuple[int, int]:
    """Number of blocks and of buckets (a power of two) for the bytes of text."""
    n = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(16, min(MANY, n // FINE), n // BUCKET_BYTES)
    return max(BLOCKS, -(-n // BLOCK_BYTES)), 1 << (buckets - 1).bit_length()


def _blocks(documents: DataFrame, blocks: int) -> DataFrame:
    """(block, doc_id, text), rows of one id in one block."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(_block("doc_id", blocks), "doc_id", "text").repartition(blocks, "block")


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("long").alias("block")


def _requests(dealt: DataFrame, target: DataFrame | None, blocks: int, buckets: int) -> DataFrame:
    """PACKED rows of every block: its distinct keys and, with ``target`` (doc_id), their counts; else counts of 0."""
    if target is None:
        def ask(table: pa.Table) -> pa.Table:
            keys, every, _ = _distinct(string_column(table.combine_chunks().to_batches()[0], "text"), np.zeros(len(table), bool))
            return pa.Table.from_batches([_dealt(keys, every * 0, every * 0, table.column("block")[0].as_py(), buckets)])

        return dealt.groupBy("block").applyInArrow(ask, PACKED)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.Table.from_batches([], pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("background", pa.binary()), ("target", pa.binary())]))
        batch = left.combine_chunks().to_batches()[0]
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        good = np.asarray(ids.is_valid()) & np.isin(np.asarray(ids.fill_null(0)), np.asarray(right.column("id")))
        return pa.Table.from_batches([_dealt(*_distinct(string_column(batch, "text"), good), left.column("block")[0].as_py(), buckets)])

    wanted = target.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct().select(_block("id", blocks), "id")
    return dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(count, PACKED)


def _bucket(table: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Distinct keys of a bucket, both counts, where each row's keys are among them, the rows' ends and the rows."""
    rows = table.to_pylist()
    base = np.uint64(rows[0]["bucket"]) << _down(buckets)
    keys = np.concatenate([base + np.cumsum(_unpack(r["keys"], r["size"]), dtype=np.uint64) for r in rows])
    key, at = np.unique(keys, return_inverse=True)
    sums = []
    for name in ("background", "target"):
        n = np.concatenate([_unpack(r[name], r["size"]) for r in rows]).astype(np.int64)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, n)
        sums.append(total)
    return key, *sums, at, np.cumsum([r["size"] for r in rows]), rows


def counts(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(kind, key, background, target): how often each key occurs in all texts and in those of ``target`` (doc_id).

    kind 0: words, 1: pairs, 2: words as a pair's first.
    """
    blocks, buckets = _plan(documents)

    def rows(table: pa.Table) -> pa.Table:
        key, background, chosen, *_ = _bucket(table, buckets)
        return pa.table({"kind": pa.array((key & _KIND).astype(np.int32)), "key": pa.array(key.view(np.int64)), "background": pa.array(background), "target": pa.array(chosen)})

    return _requests(_blocks(documents, blocks), target, blocks, buckets).groupBy("bucket").applyInArrow(rows, "kind int, key long, background long, target long")


def models(table: DataFrame, weight: float = 0.6) -> dict:
    """The distributed table of counts and the interpolation's weight."""
    return {"table": table, "weight": weight}


def losses(t: Texts, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of every token under the target and the background, and bounds by text.

    counts: by kind, model and place of the key in the sorted ``keys``, which hold every key of the texts;
    without ``keys``, by the hash's leading BITS. size: words of the vocabulary.
    """
    *hashes, bounds = _tokens(t)
    if "keys" in model:
        c, (word, pair, before) = np.broadcast_to(model["counts"], (3, *model["counts"].shape)), (np.searchsorted(model["keys"], _keyed(h, kind)) for kind, h in enumerate(hashes))
    else:
        c, (word, pair, before) = model["counts"], ((h >> np.uint64(64 - BITS)).astype(np.int64) for h in hashes)
    lam, size = model["weight"], model.get("size", SLOTS)
    out = []
    for j in (1, 0):
        single = (c[0, j, word] + 0.5) / (model["totals"][j] + 0.5 * size)
        double = np.where(c[2, j, before] > 0, np.minimum(1.0, c[1, j, pair] / np.maximum(c[2, j, before], 1)), single)
        out.append(-np.log2(lam * double + (1 - lam) * single))
    return out[0], out[1], bounds


def _scored(dealt: DataFrame, packed: DataFrame, buckets: int, weight: float) -> DataFrame:
    """Scores of the blocks ``dealt`` by the counts in ``packed``, which holds a request of every block; rows of block -1 get no answer."""

    def answer(table: pa.Table) -> pa.Table:
        key, background, chosen, at, ends, rows = _bucket(table, buckets)
        word = (key & _KIND == 0) & (background + chosen > 0)
        totals = (int(word.sum()), int(background[word].sum()), int(chosen[word].sum()))
        out = []
        for r, hi in zip(rows, ends):
            if r["block"] >= 0:
                mine = at[hi - r["size"] : hi]
                out.append((r["block"], r["bucket"], r["size"], _pack(background[mine]), _pack(chosen[mine]), *totals))
        names = ["block", "bucket", "size", "background", "target", "words", "background_words", "target_words"]
        kinds = [pa.binary() if n in ("background", "target") else pa.int64() for n in names]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        batch = left.combine_chunks().to_batches()[0]
        column, ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
        keys, *_ = _distinct(column, np.zeros(len(column), bool))
        known = np.stack([np.concatenate([_unpack(r[name], r["size"]) for r in rows]).astype(np.float64) for name in ("background", "target")])
        if len(rows) != buckets or known.shape[1] != len(keys):
            raise RuntimeError("answers do not fit the block: the documents changed between two reads")
        model = {"keys": keys, "counts": known, "totals": [sum(r[f"{x}_words"] for r in rows) for x in ("background", "target")], "size": 1 + sum(r["words"] for r in rows), "weight": weight}
        parts = []
        for lo, hi in slices(column):
            t = Texts(column.slice(lo, hi - lo), LOWER)
            target, background, bounds = losses(t, model)
            n = np.diff(bounds)
            owner = np.repeat(np.arange(t.n), n)
            a, b = (np.bincount(owner, x, t.n) / np.maximum(1, n) for x in (target, background))
            parts.append(pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(a), pa.array(b), pa.array(b - a)], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]))
        return pa.Table.from_batches(parts)

    answers = packed.groupBy("bucket").applyInArrow(answer, ANSWER)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def scored(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every document, losses in bits a token.

    score = background_loss - target_loss, higher: more like the target. A text without words has no
    tokens, losses of 0 and score 0. Repeated rows are scored each.
    """
    blocks, buckets = _plan(documents)
    down = _down(buckets)

    def sent(batches):
        for batch in batches:
            key = np.asarray(batch.column(1)).view(np.uint64)
            order = np.argsort(key)
            numbers = [np.asarray(batch.column(i))[order] for i in (2, 3)]
            key = key[order]
            places, heads = np.unique(key >> down, return_index=True)
            for b, lo, hi in zip(places.tolist(), heads, np.append(heads[1:], len(key))):
                packed = [pa.array([_pack(x)], pa.binary()) for x in (np.diff(key[lo:hi], prepend=np.uint64(b) << down), numbers[0][lo:hi], numbers[1][lo:hi])]
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([-1]), pa.array([hi - lo]), *packed], ["bucket", "block", "size", "keys", "background", "target"])

    dealt = _blocks(documents, blocks)
    known = model["table"].select("kind", "key", "background", "target").mapInArrow(sent, PACKED)
    return _scored(dealt, _requests(dealt, None, blocks, buckets).unionAll(known), buckets, model["weight"])


def compared(documents: DataFrame, target: DataFrame, weight: float = 0.6) -> DataFrame:
    """``scored`` of the very documents that are counted: their counts are their requests, so keys move once."""
    blocks, buckets = _plan(documents)
    dealt = _blocks(documents, blocks)
    return _scored(dealt, _requests(dealt, target, blocks, buckets), buckets, weight)
