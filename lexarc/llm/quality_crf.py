"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line with a word is good or bad. Its features are binned shape statistics of the line itself and
of the lines before and after; the chain's potentials are trained with the label of the line's document
on a bounded sample. Forward-backward gives each line's marginal probability of being good, and the
length-weighted mean of the marginals is the document's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import good_share, sample
from .textnp import Texts, mix, slices, string_column

KEEP_AT = 0.7
#: Bins per statistic; statistics are fractions, cut at these points.
CUTS = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
BINS = len(CUTS) + 1
STATS = 13
WIDTH = 3 * (STATS * BINS + 1)  # of the line, the line before, the line after; one slot each for "no such line"


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_CLASSES = [_class(bytes(range(65, 91))), _class(b"#*$%&"), _class(b"|<>{}[]\\^~=_`"), _class(b"!?"), _class(bytes(range(48, 58))), _class(b".,;:'\"()-"), _class(bytes(range(128, 256)))]


def line_statistics(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines with a word: bounds by text, byte length, and statistics (lines, STATS) in 0..1."""
    starts, ends = t.words()
    ls, le = t.lines()
    w0, w1 = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    keep = w1 > w0
    ls, le, w0, w1 = ls[keep], le[keep], w0[keep], w1[keep]
    size = (le - ls).astype(float)
    words = (w1 - w0).astype(float)
    bounds = t.split_by_text(ls)
    stats = []
    for table in _CLASSES:
        run = np.concatenate([[0], np.cumsum(table[t.data], dtype=np.int64)])
        stats.append((run[le] - run[ls]) / size)
    prefix = t.prefix()
    h = t.hashes(starts, ends, prefix)
    line = np.repeat(np.arange(len(ls)), w1 - w0)
    inside = np.arange(len(h) - 1) if len(h) else np.zeros(0, int)
    same = np.zeros(len(h) + 1)
    if len(h) > 1:
        same[1:-1] = np.cumsum((h[1:] == h[:-1]) & (line[inside] == line[inside + 1]))
        same[-1] = same[-2]
    stats.append((same[np.maximum(w1 - 1, 0)] - same[w0]) / np.maximum(1, words - 1))
    key = mix(h + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.zeros(len(h), np.int64)
    first[np.unique(key, return_index=True)[1]] = 1
    fresh = np.concatenate([[0], np.cumsum(first)])
    stats.append(1 - (fresh[w1] - fresh[w0]) / words)
    edge = np.concatenate([[0], np.cumsum(_END[t.data[ends - 1]])])  # words that end in a symbol
    stats.append((edge[w1] - edge[w0]) / words)
    body = np.concatenate([[0], np.cumsum(ends - starts)])
    stats.append(np.minimum(1, (body[w1] - body[w0]) / words / 20))
    stats.append(np.minimum(1, np.log2(1 + words) / 10))
    text = np.repeat(np.arange(t.n), np.diff(bounds))
    lk = mix(t.hashes(ls, le, prefix) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.ones(len(ls))
    again[np.unique(lk, return_index=True)[1]] = 0
    stats.append(again)
    return bounds, size, np.stack(stats, 1) if len(ls) else np.zeros((0, STATS))


_END = _class(b"#*$%&!|<>").astype(np.int64)


def features(bounds: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """(lines, 3 * STATS) slots below WIDTH: each line's own bins, its predecessor's and its successor's."""
    n = len(stats)
    own = np.searchsorted(CUTS, stats, "left") + np.arange(STATS) * BINS
    none = STATS * BINS
    before, after = np.full((n, STATS), none), np.full((n, STATS), none)
    if n > 1:
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        same = text[1:] == text[:-1]
        before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return np.concatenate([own, before + none + 1, after + 2 * (none + 1)], 1)


def marginals(bounds: np.ndarray, emission: np.ndarray, transition: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the summed pair marginals (2, 2); all chains of a slice step together.

    emission: log-potential of good against bad; transition[i, j] from label i to j; weight: of each
    line in the pair sums, which are only made where it is given.
    """
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    first, sizes = bounds[:-1][order], n[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # chains longer than the step
    good, bad = np.zeros(len(emission)), np.zeros(len(emission))
    for s in range(steps):
        k = alive[s]
        at = first[:k] + s
        if s == 0:
            good[at], bad[at] = emission[at], 0.0
        else:
            g, b = good[at - 1], bad[at - 1]
            good[at] = emission[at] + np.logaddexp(g + transition[1, 1], b + transition[0, 1])
            bad[at] = np.logaddexp(g + transition[1, 0], b + transition[0, 0])
    back_g, back_b = np.zeros(len(emission)), np.zeros(len(emission))
    for s in range(steps - 2, -1, -1):
        k = alive[s + 1]
        at = first[:k] + s
        g, b = back_g[at + 1] + emission[at + 1], back_b[at + 1]
        back_g[at] = np.logaddexp(transition[1, 1] + g, transition[1, 0] + b)
        back_b[at] = np.logaddexp(transition[0, 1] + g, transition[0, 0] + b)
    p = 1 / (1 + np.exp((bad + back_b - good - back_g).clip(-500, 500)))
    pairs = np.zeros((2, 2))
    if weight is not None and len(emission) > 1:
        text = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(text[1:] == text[:-1])
        if len(at):
            cells = np.stack([bad[at] + transition[0, 0] + back_b[at + 1], bad[at] + transition[0, 1] + emission[at + 1] + back_g[at + 1], good[at] + transition[1, 0] + back_b[at + 1], good[at] + transition[1, 1] + emission[at + 1] + back_g[at + 1]])
            cells = np.exp(cells - cells.max(0))
            pairs = (cells / cells.sum(0) @ weight[at]).reshape(2, 2)
    return p, pairs


def _gathered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column, bounds, size, slots = pa.array(texts, pa.large_string()), [np.zeros(1, np.int64)], [], []
    for lo, hi in slices(column):
        b, s, st = line_statistics(Texts(column.slice(lo, hi - lo)))
        slots.append(features(b, st))
        bounds.append(b[1:] + bounds[-1][-1])
        size.append(s)
    return np.concatenate(bounds), np.concatenate(size or [np.zeros(0)]), np.concatenate(slots or [np.zeros((0, 3 * STATS), int)])


def fit(texts: list[str], y: np.ndarray, share: float = 0.5, rounds: int = 150) -> dict:
    """Maximises the conditional likelihood of the line labels by Adam, the labels weighing ``share`` and the rest.

    With no row of one label all lines are of the other.
    """
    if not len(y) or y.min() == y.max():
        return {"w": np.zeros(WIDTH), "bias": 8.0 if not len(y) or y.min() else -8.0, "transition": np.zeros((2, 2))}
    bounds, _, slots = _gathered(texts)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    label = y[text]
    weight = np.where(label == 1, share / max(1, (label == 1).sum()), (1 - share) / max(1, (label == 0).sum()))
    truth = np.zeros((2, 2))
    same = text[1:] == text[:-1]
    truth[1, 1], truth[0, 0] = weight[:-1][same & (label[1:] == 1)].sum(), weight[:-1][same & (label[1:] == 0)].sum()
    x = np.zeros(WIDTH + 5)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, bias, transition = x[:WIDTH], x[WIDTH], x[WIDTH + 1 :].reshape(2, 2)
        p, pairs = marginals(bounds, w[slots].sum(1) + bias, transition, weight)
        g = (p - label) * weight
        gw = np.bincount(slots.ravel(), np.repeat(g, slots.shape[1]), WIDTH) + 1e-4 * w
        gt = pairs - truth + 1e-3 * transition
        grad = np.concatenate([gw, [g.sum()], gt.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        x = x - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return {"w": x[:WIDTH], "bias": x[WIDTH], "transition": x[WIDTH + 1 :].reshape(2, 2)}


def document_scores(t: Texts, model: dict) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; 0 for a text without words."""
    bounds, size, stats = line_statistics(t)
    slots = features(bounds, stats)
    p, _ = marginals(bounds, model["w"][slots].sum(1) + model["bias"], model["transition"])
    sums = lambda x: (c := np.concatenate([[0.0], np.cumsum(x)]))[bounds[1:]] - c[bounds[:-1]]
    total = sums(size)
    return np.where(total > 0, sums(p * size) / np.maximum(total, 1), 0.0).clip(0, 1)


def scored(documents: DataFrame, model: dict, name: str = "_quality") -> DataFrame:
    """The input with a column ``name`` (double), which no column of the input may have.

    Null, empty and blank texts score 0; repeated and null ids are scored each; an empty table gives no
    rows. All other columns stay.
    """
    import pyspark.sql.types as T

    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = string_column(batch, "text")
            for lo, hi in slices(column):
                p = document_scores(Texts(column.slice(lo, hi - lo)), shared.value)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, name])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())]))


def trained(documents: DataFrame, labels: DataFrame) -> dict:
    """A model of ``labels.quality`` from a bounded sample (quality_rules.SAMPLE_ROWS rows of each label), the labels weighing as often as they occur in ``labels``."""
    return fit(*sample(documents, labels), good_share(labels))
