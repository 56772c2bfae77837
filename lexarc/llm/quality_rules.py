"""Quality rules: counts of a text, then a hashed n-gram logistic regression with calibrated probability.

Features are relative frequencies of hashed words, word pairs and byte windows of three and five of the
ASCII-lower-cased text. The regression is trained on labelled rows, Platt-scaled on rows it has not
seen, broadcast (a fixed number of weights) and applied in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .textnp import LOWER, Texts, mix, per_text, shingles, slices, string_column

BITS = 18
#: Bound of the labelled sample: rows of each label, and characters of a row; of a longer text a window at a hashed place.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 20_000
SAMPLE_OVER = 3
MIN_WORDS, MOST_REPEATED, KEEP_AT = 50, 50, 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(t: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends = t.words()
    bounds = t.split_by_text(starts)
    prefix = t.prefix()
    head = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[t.data])])
    h = t.hashes(starts, ends, prefix)
    text = np.repeat(np.arange(t.n), np.diff(bounds))

    three = shingles(h, 3)
    whole = text[: len(three)] == text[2 : 2 + len(three)] if len(three) else np.zeros(0, bool)
    three = mix(three + text[: len(three)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(whole)
    _, inverse, number = np.unique(three[at], return_inverse=True, return_counts=True)
    twice = at[number[inverse] > 1]
    repeated = np.zeros(len(h) + 3, np.int64)
    for i in range(3):
        repeated[twice + i] = 1

    ls, le = t.lines()
    words_to = np.searchsorted(starts, np.stack([ls, le]))
    filled = words_to[1] > words_to[0]
    ls, le = ls[filled], le[filled]
    lb = t.split_by_text(ls)
    key = mix(t.hashes(ls, le, prefix) + np.repeat(np.arange(t.n), np.diff(lb)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.ones(len(key), np.int64)
    again[np.unique(key, return_index=True)[1]] = 0
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_text(head[ends] - head[starts], bounds),
        "n_symbols": symbols[t.ends] - symbols[t.starts],
        "n_dup_lines": per_text(again, lb),
        "n_repeat_words": per_text(repeated[: len(h)], bounds),
    }


def _slots(t: Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Feature slots of each kind, and where each text's begin and end among them; none crosses texts."""
    starts, ends = t.words()
    h = t.hashes(starts, ends)
    bounds = t.split_by_text(starts)
    d = t.data.astype(np.uint64)
    d3 = (d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]
    d5 = (d3[:-2] << np.uint64(16)) | (d[3:-1] << np.uint64(8)) | d[4:] if len(d) > 4 else d3[:0]
    out = []
    for salt, (values, lo, hi) in enumerate(((h, bounds[:-1], bounds[1:]), (shingles(h, 2), bounds[:-1], bounds[1:] - 1), (d3, t.starts, t.ends - 2), (d5, t.starts, t.ends - 4))):
        slots = (values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt << 7)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)
        out.append((slots.astype(np.int32), np.minimum(lo, len(slots)), np.clip(hi, np.minimum(lo, len(slots)), len(slots))))
    return out


def margins(t: Texts, weights: np.ndarray) -> np.ndarray:
    """weights: (4, 2 ** BITS) of the kinds. Mean weight of each kind's features, summed."""
    total = np.zeros(t.n)
    for (slots, lo, hi), w in zip(_slots(t), weights):
        run = np.concatenate([[0.0], np.cumsum(w[slots], dtype=np.float64)])
        total += (run[hi] - run[lo]) / np.maximum(1, hi - lo)
    return total


def window(text, chars: int, *key):
    """The whole text, or of a longer one ``chars`` characters from a place chosen by the hash of ``key``."""
    start = F.pmod(F.xxhash64(*key, F.lit("window")), F.greatest(F.length(text) - chars + 1, F.lit(1)).cast("long")) + 1
    return F.when(F.length(text) <= chars, text).otherwise(F.substring(text, start.cast("int"), F.lit(chars)))


def sample(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``rows`` rows of each label, those with the least hash of their id.

    No length is left out: a text above ``chars`` gives a window. The hash first bounds the labels that may be
    chosen to about SAMPLE_OVER times ``rows``; these few are broadcast, so the documents are read once and not
    shuffled. Null ids, labels and texts are not used.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_i"), F.col(label).cast("int").alias("_y"))
    number = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64("_i", F.lit("sample"))
    few = known.where(F.lit(False))
    for y, n in number.items():
        few = few.unionAll(known.where((F.col("_y") == y) & (F.pmod(h, F.lit(1 << 40)) < int(min(1.0, SAMPLE_OVER * rows / n) * (1 << 40)))))
    few = F.broadcast(few.select("_i", "_y", F.pmod(h, F.lit(1 << 40)).alias("_h")).distinct())
    filled = documents.where(F.col("text").isNotNull()).select("doc_id", window(F.col("text"), chars, F.col("doc_id")).alias("text"))
    joined = written(filled.join(few, F.col("doc_id") == F.col("_i")).select("text", "_y", "_h", "doc_id"), "sample")
    texts, ys = [], []
    for y in (0, 1):
        got = joined.where(F.col("_y") == y).orderBy("_h", "doc_id", "text").limit(rows).collect()
        texts += [r["text"] for r in got]
        ys += [y] * len(got)
    return texts, np.array(ys, float)


def good_share(labels: DataFrame, label: str = "quality") -> float:
    """Label 1's part of the labels."""
    n = {r["_y"]: r["n"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("_y")).agg(F.count("*").alias("n")).collect()}
    return n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))


def fit(texts: list[str], y: np.ndarray, share: float = 0.5, rounds: int = 80) -> dict:
    """Balanced logistic regression by Adam on four fifths of the rows, Platt scaling on the others.

    The sample holds both labels alike; the scaling weighs them by ``share``, label 1's part of all labels, so that the
    probability is one of the corpus. With rows of one label only the model says that label for every text; with none, 1.
    """
    if not len(y) or y.min() == y.max():
        return {"weights": np.zeros((4, 1 << BITS), np.float32), "a": 0.0, "b": 8.0 if not len(y) or y.min() else -8.0}
    rows, cols, vals = [], [], []
    column = pa.array(texts, pa.large_string())
    for lo, hi in slices(column):
        t = Texts(column.slice(lo, hi - lo), LOWER)
        for kind, (slots, first, last) in enumerate(_slots(t)):
            n = last - first
            row = np.repeat(np.arange(t.n), n)
            at = np.arange(len(row)) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            key, c = np.unique(row * (4 << BITS) + kind * (1 << BITS) + slots[at], return_counts=True)
            rows.append(key // (4 << BITS) + lo)
            cols.append(key % (4 << BITS))
            vals.append(c / np.maximum(1, n)[key // (4 << BITS)])
    row, col, val = map(np.concatenate, (rows, cols, vals))
    used, col = np.unique(col, return_inverse=True)
    test = np.arange(len(y)) % 5 == 4
    weight = np.where(y == 1, 0.5 / max(1, (y[~test] == 1).sum()), 0.5 / max(1, (y[~test] == 0).sum())) * ~test
    w, m, v, bias, mb, vb = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(row, val * w[col], len(y)) + bias
        g = (1 / (1 + np.exp(-z.clip(-30, 30))) - y) * weight
        gw = np.bincount(col, val * g[row], len(used)) + 1e-7 * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        bias -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-9)
    z = np.bincount(row, val * w[col], len(y)) + bias
    a, b = platt(z[test], y[test], share)
    weights = np.zeros(4 << BITS, np.float32)
    weights[used] = w
    return {"weights": weights.reshape(4, -1), "a": a, "b": a * bias + b}


def platt(z: np.ndarray, y: np.ndarray, share: float = 0.5) -> tuple[float, float]:
    """Slope and offset of the log-odds over a margin, by Newton steps with smoothed targets; label 1 weighs ``share`` in all."""
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    scale = z.std() or 1.0
    x = np.stack([z / scale, np.ones(len(z))])
    want = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share / n1, (1 - share) / n0)
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(theta @ x).clip(-30, 30)))
        step = np.linalg.solve((x * weight * p * (1 - p)) @ x.T + 1e-4 * np.eye(2), x @ (weight * (p - want)) + 1e-4 * theta)
        theta -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return max(theta[0], 1e-3) / scale, theta[1]


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def rules(documents: DataFrame, model: dict, keep_at: float = KEEP_AT) -> DataFrame:
    """Counts, base verdict, calibrated probability of label 1 and verdict of every document.

    A null or empty text has no words and fails the base; repeated and null ids give a row each; a
    probability equal to ``keep_at`` keeps; an empty table gives no rows. Other columns are not looked at.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column, ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            m = shared.value
            for lo, hi in slices(column):
                c = counts(Texts(column.slice(lo, hi - lo)))
                z = margins(Texts(column.slice(lo, hi - lo), LOWER), m["weights"]) * m["a"] + m["b"]
                p = 1 / (1 + np.exp(-z.clip(-30, 30)))
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *(pa.array(np.asarray(c[k], np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"],
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)
