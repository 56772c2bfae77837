"""Language ID: prediction by partial matching over bytes with frozen statistics.

Each language has a variable-order context tree over the bytes of a bounded training sample. A byte
costs the code length of method C: in the longest context seen, count / (total + distinct); a byte not
seen there pays the escape distinct / (total + distinct) and is coded in the next shorter context, down
to 1/256. All trees share one table of byte strings, so a whole slice of texts is coded in a few
passes: the code lengths of a string in every language are resolved when the statistics are frozen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import window
from .textnp import LOWER, HashTable, Texts, slices, string_column

ORDER = 5  # bytes of a string: a context of four and the byte coded
#: Bound of the training sample: documents of each language, characters of a document (of a longer one a window at a
#: hashed place), and characters in all, which the languages share where there are very many.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 300, 8000, 1 << 28
UND = "und"


def _keys(data: np.ndarray, m: int) -> np.ndarray:
    """Key of the ``m`` bytes that end at each position; the first m - 1 are not to be used."""
    key = np.zeros(len(data), np.uint64)
    for i in range(min(m, len(data))):
        key[i:] |= data[: len(data) - i].astype(np.uint64) << np.uint64(8 * i)
    return key | np.uint64(m << 56)


def _depth(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Position of every byte of the texts, and how many bytes of its text end there."""
    n = t.ends - t.starts
    at = np.arange(n.sum()) + np.repeat(t.starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if t.n else np.zeros(0, np.int64)
    return at, at - np.repeat(t.starts, n) + 1


def fit(samples: dict[str, list[str]]) -> dict:
    """Frozen statistics of every language that has a sample."""
    names = sorted(samples)
    seen: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
    for m in range(1, ORDER + 1):
        of = {}
        for name in names:
            t = Texts(pa.array(samples[name], pa.large_string()), LOWER)
            at, depth = _depth(t)
            of[name] = np.unique(_keys(t.data, m)[at[depth >= m]], return_counts=True)
        seen.append(of)
    levels, code, escape = [], [], []
    root = np.zeros(len(names), np.float32)  # cost of leaving the empty context
    for m, of in enumerate(seen, 1):
        keys = np.unique(np.concatenate([of[x][0] for x in names])) if names else np.zeros(0, np.uint64)
        cost, leave = np.zeros((len(keys), len(names)), np.float32), np.zeros((len(keys), len(names)), np.float32)
        context = (keys >> np.uint64(8)) & np.uint64((1 << (8 * (m - 1))) - 1) | np.uint64((m - 1) << 56)
        shorter = keys & np.uint64((1 << (8 * (m - 1))) - 1) | np.uint64((m - 1) << 56)
        if m > 1:
            context, shorter = np.searchsorted(levels[-1], context), np.searchsorted(levels[-1], shorter)
        for j, name in enumerate(names):
            own, number = of[name]
            have = np.zeros(len(keys))
            have[np.searchsorted(keys, own)] = number
            size = len(levels[-1]) if m > 1 else 1
            at = context if m > 1 else np.zeros(len(keys), np.int64)
            total, distinct = np.bincount(at, have, size), np.bincount(at, have > 0, size)
            leave_at = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(total + distinct, 1)), 0)
            if m > 1:
                escape[-1][:, j] = leave_at
                below = code[-1][shorter, j]
            else:
                root[j] = leave_at[0]
                below = 8.0
            cost[:, j] = np.where(have > 0, -np.log2(np.maximum(have, 1) / np.maximum(total + distinct, 1)[at]), leave_at[at] + below)
        levels.append(keys)
        code.append(cost)
        escape.append(leave)
    return {"names": names, "keys": np.concatenate(levels) if levels else np.zeros(0, np.uint64), "code": np.concatenate(code), "escape": np.concatenate(escape), "root": root}


class Coder:
    """Code lengths of texts under every language."""

    def __init__(self, model: dict):
        self.names, self.root = model["names"], model["root"]
        none = np.zeros((1, len(self.names)), np.float32)
        self.code, self.escape = np.concatenate([model["code"], none]), np.concatenate([model["escape"], none])
        self.table = HashTable(model["keys"])

    def bits(self, t: Texts) -> np.ndarray:
        """(texts, languages): exact code length of each text's bytes, ASCII lower-cased."""
        at, depth = _depth(t)
        longest = _keys(t.data, ORDER)
        here, before = longest[at], longest[at - 1]

        def short(keys: np.ndarray, m: int) -> np.ndarray:
            return keys & np.uint64((1 << (8 * m)) - 1) | np.uint64(m << 56)

        found = self.table.find(here)
        found[depth < ORDER] = -1
        cost = self.code[found]  # row -1 is zero
        todo = np.flatnonzero(found < 0)
        for m in range(ORDER, 0, -1):
            if m < ORDER:
                found = self.table.find(short(here[todo], m))
                found[depth[todo] < m] = -1
                cost[todo] += self.code[found]
                todo = todo[found < 0]
            if m > 1:
                known = self.table.find(short(before[todo], m - 1))
                known[depth[todo] < m] = -1
                cost[todo] += self.escape[known]
            else:
                cost[todo] += self.root + np.float32(8)
        return np.stack([np.bincount(np.repeat(np.arange(t.n), t.ends - t.starts), cost[:, j], t.n) for j in range(cost.shape[1])], 1)


def sample(rows: DataFrame) -> dict[str, list[str]]:
    """At most SAMPLE_DOCS texts of every language of ``rows`` (text, lang, doc_id), those with the least hash of their id."""
    rows = rows.where("text is not null and lang is not null").select("lang", "doc_id", "text")
    number = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not number:
        return {}
    chars = max(1, min(SAMPLE_CHARS, SAMPLE_ALL // sum(min(n, SAMPLE_DOCS) for n in number.values())))
    share = rows.sparkSession.createDataFrame([(k, min(1.0, 1.2 * SAMPLE_DOCS / n + 20 / n)) for k, n in number.items()], "lang string, _share double")
    h = F.xxhash64("doc_id", F.lit("language"))
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod(h, F.lit(1_000_000)) < 1_000_000 * F.col("_share"))
    picked = picked.select("lang", "doc_id", window(F.col("text"), chars, F.col("doc_id")).alias("text"), h.alias("_h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))
    out: dict[str, list[str]] = {}
    for r in picked.withColumn("_n", place).where(F.col("_n") <= SAMPLE_DOCS).orderBy("lang", "_n").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def _has_letter(t: Texts, texts: pa.Array) -> np.ndarray:
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    run = np.concatenate([[0], np.cumsum(letter[t.data])])
    has = run[t.ends] > run[t.starts]
    for i in np.flatnonzero(~has & (t.ends > t.starts)):
        has[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
    return has


def identified(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score): the language with the shortest code, of equal ones the first by name, and its posterior.

    The posterior takes equal priors and code lengths divided by the root of the number of bytes: neighbouring bytes
    are not independent, and undivided lengths would make it 0 or 1 for all but the shortest texts. A null text, a text
    without a letter, or a model of no language gives ``und`` with score 0; repeated and null ids give a row each; an
    empty table gives no rows. Other columns are not looked at.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            column, ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi in slices(column, 1 << 18):
                part = column.slice(lo, hi - lo)
                t = Texts(part, LOWER)
                named = _has_letter(t, part) & bool(coder.names)
                if coder.names:
                    bits = coder.bits(t)
                    best = bits.argmin(1)
                    score = 1 / np.exp2(-((bits - bits.min(1, keepdims=True)) / np.maximum(1, np.sqrt(t.ends - t.starts))[:, None]).clip(0, 60)).sum(1)
                    pred = np.where(named, np.array(coder.names, object)[best], UND)
                else:
                    pred, score = np.full(t.n, UND, object), np.zeros(t.n)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(np.where(named, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
