"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The vocabulary of a public model is laid over a text as a lattice of pieces. Forward filtering sums, for
every byte position, the weights of all segmentations that end there; backward sampling then draws one
piece after the other from the end. Randomness is a hash of the row's key and the piece's place, so a
row's segmentation is the same wherever and whenever it is drawn.

A space stands for the vocabulary's word mark, and any byte may be a byte piece, so every text has a
segmentation and decoding gives back its bytes. No piece holds a character followed by a space, and none
holds a newline; the lattice therefore falls apart at those places, exactly, into units. The lattices of
all distinct short units of a slice are laid by walking a piece trie and summed in step; a unit's path
depends on its length only, so that its sums are the same in every slice.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnp import HashTable, Texts, mix, slices, string_column

MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_SALT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of the longest unit whose sums stay in range by themselves, and of the longest whose sums are taken in step with
#: others; steps after which the sums of the longer ones are looked at; their range.
PLAIN, SHORT, STEPS, RANGE = 64, 8192, 16, 2.0**300


def vocabulary(path: str | None = None) -> list[tuple[bytes, float]]:
    """(bytes, rank) of every piece by id; byte pieces have rank infinity, control pieces no bytes."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append((bytes([int(sp.id_to_piece(i)[3:-1], 16)]), np.inf))
        elif sp.is_control(i) or sp.is_unknown(i):
            out.append((b"", np.inf))
        else:
            out.append((sp.id_to_piece(i).replace(_MARK, " ").encode(), float(max(0.0, -sp.get_score(i)))))
    return out


class Sampler:
    """Segmentations of whole texts under the weights (2 + rank) ** -alpha of the pieces."""

    def __init__(self, pieces: list[tuple[bytes, float]], alpha: float = 1.0, seed: int = 0):
        self.bytes = [p for p, _ in pieces]
        self.seed = np.uint64(seed)
        floor = 1e-3 * min([(2 + r) ** -alpha for _, r in pieces if r < np.inf], default=1.0) if alpha else 1e-6
        self.weight: dict[bytes, tuple[float, int]] = {}
        for i, (p, rank) in enumerate(pieces):
            w = (2 + rank) ** -alpha if rank < np.inf else floor
            if p and (p not in self.weight or self.weight[p][0] < w):
                self.weight[p] = (w, i)
        if len([p for p in self.weight if len(p) == 1]) < 256:
            raise ValueError("the vocabulary lacks bytes")
        if any(re.search(rb"[^ ] |\n.|.\n", p, re.S) for p in self.weight):
            raise ValueError("a piece crosses the end of a unit")
        self.starts: dict[int, int] = {}  # longest piece by first byte
        for p in self.weight:
            self.starts[p[0]] = max(self.starts.get(p[0], 0), len(p))
        self.size = np.array([len(p) for p in self.bytes], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        # a factor per byte slows the sums' way out of range: every segmentation of a unit has as many bytes
        low = min(w for w, _ in self.weight.values())
        self.factor = low**-0.5
        self.plain, self.short = min(PLAIN, int(250 / max(1e-9, -0.5 * np.log10(low)))), SHORT
        self.longest = max(map(len, self.weight))
        nodes: dict[bytes, int] = {b"": 0}
        for p in sorted(self.weight):
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        self.node_weight, self.node_piece = np.zeros(len(nodes)), np.full(len(nodes), -1, np.int32)
        for p, (w, i) in self.weight.items():
            self.node_weight[nodes[p]], self.node_piece[nodes[p]] = w * self.factor ** len(p), i
        self.roots = np.array([nodes[bytes([b])] for b in range(256)], np.int64)
        steps = [(nodes[p[:-1]] << 8 | p[-1], i) for p, i in nodes.items() if p]
        self.children, self.child = HashTable(np.array([k for k, _ in steps], np.uint64)), np.array([i for _, i in steps], np.int64)

    def forward(self, unit: bytes) -> tuple[bytes, bytes, int]:
        """Edges by the position they end at: position - 1 + cumulative probability, piece; and their number."""
        n, weight = len(unit), self.weight
        reach: list[list] = [[] for _ in range(n + 1)]
        total = [1.0] + [0.0] * n
        keys, pieces, scale = [], [], 1.0
        for e in range(n + 1):
            if e:
                mass = sum(w for w, _ in reach[e])
                at = 0.0
                for w, piece in reach[e]:
                    at += w / mass
                    keys.append(e - 1 + min(at, 1.0))
                    pieces.append(piece)
                keys[-1] = float(e)
                reach[e] = ()
                total[e] = mass
            if e < n:
                if total[e] < 1e-200:  # the weights still to come share one factor
                    for later in range(e + 1, n + 1):
                        if not reach[later] and later > e + 64:
                            break
                        reach[later] = [(w * 1e200, p) for w, p in reach[later]]
                    total[e] *= 1e200
                own = total[e]
                for s in range(e + 1, min(n, e + self.starts[unit[e]]) + 1):
                    if hit := weight.get(unit[e:s]):
                        reach[s].append((own * hit[0], hit[1]))
        return np.array(keys).tobytes(), np.array(pieces, np.int32).tobytes(), len(keys)

    def in_step(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``forward``, for units of these lengths back to back in ``data``: edges over all of it."""
        base = np.cumsum(length) - length
        stop = np.repeat(base + length, length)
        at, node, size = np.arange(len(data)), self.roots[data], 1
        ends, sizes, nodes = [], [], []
        while len(at):
            hit = self.node_piece[node] >= 0
            ends.append(at[hit] + size)
            sizes.append(np.full(int(hit.sum()), size, np.int64))
            nodes.append(node[hit])
            on = at + size < stop[at]
            at, node = at[on], node[on]
            step = self.children.find((node << 8 | data[at + size]).astype(np.uint64))
            at, node, size = at[step >= 0], self.child[step[step >= 0]], size + 1
        end, width, node = map(np.concatenate, (ends, sizes, nodes))
        order = np.argsort(end, kind="stable")
        end, width, node = end[order], width[order], node[order]
        weight, source = self.node_weight[node], end - width
        place = (end - np.repeat(base, length)[end - 1]).astype(np.uint8 if int(length.max()) < 256 else np.uint16)  # sorted by radix
        turn = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[turn], np.arange(1, int(length.max()) + 2))
        mass, start = np.zeros(len(end)), np.zeros(len(data), bool)
        start[base] = True
        total = np.zeros(len(data) + 1)  # at the end of a unit its sum, until the next unit's edges have been taken
        if int(length.max()) <= self.plain:
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                own = turn[lo:hi]
                mass[own] = np.where(start[source[own]], 1.0, total[source[own]]) * weight[own]
                heads = np.flatnonzero(np.diff(end[own], prepend=-1))
                total[end[own[heads]]] = np.add.reduceat(mass[own], heads)
        else:
            self._rescaled(bounds, turn, end, source, weight, start, base, length, mass, total)
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        run = np.cumsum(mass / total[end])
        share = run - np.repeat(np.concatenate([[0.0], run[heads[1:] - 1]]), np.diff(np.append(heads, len(end))))
        edge = end - 1 + np.minimum(share, 1.0)
        edge[np.append(heads[1:], len(end)) - 1] = end[heads]
        return edge, self.node_piece[node]

    def _rescaled(self, bounds, turn, end, source, weight, start, base, length, mass, total) -> None:
        """Fills ``mass`` and ``total`` step by step. ``live`` has the sums in their unit's present scale; from a unit's start it is ``scale``."""
        live, first = np.zeros(len(total)), start[source]
        scale, unit = np.ones(len(base)), np.repeat(np.arange(len(base)), length)
        for step, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]), 1):
            own = turn[lo:hi]
            mass[own] = np.where(first[own], scale[unit[source[own]]], live[source[own]]) * weight[own]
            heads = np.flatnonzero(np.diff(end[own], prepend=-1))
            at = end[own[heads]]
            total[at] = live[at] = np.add.reduceat(mass[own], heads)
            if step % STEPS == 0 and len(odd := at[(live[at] > RANGE) | (live[at] < 1 / RANGE)]):
                down = np.ldexp(1.0, -np.frexp(live[odd])[1])
                back = odd[:, None] - np.arange(self.longest)
                inside = back > base[unit[odd - 1]][:, None]
                live[back[inside]] *= np.broadcast_to(down[:, None], back.shape)[inside]
                if step <= self.longest:
                    scale[unit[odd - 1]] *= down

    def units(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every unit: cut where a space follows another byte, and around newlines."""
        d = t.data
        cut = np.zeros(len(d) + 1, bool)
        cut[1:-1] = ((d[1:] == 32) & (d[:-1] != 32)) | (d[1:] == 10) | (d[:-1] == 10)
        cut[t.starts], cut[t.ends] = True, True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        seams = np.zeros(len(d), bool)  # the newlines between texts
        seams[0] = True
        seams[t.ends] = True
        keep = ~seams[starts]
        return starts[keep], ends[keep]

    def encode(self, t: Texts, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts and their n + 1 bounds. keys: uint64 of each text."""
        starts, ends = self.units(t)
        bounds = t.split_by_text(starts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(t.n + 1, np.int64)
        _, first, inverse = np.unique(t.hashes(starts, ends), return_index=True, return_inverse=True)
        length = (ends - starts)[first]
        order = np.argsort(1 * (length > self.plain) + (length > self.short), kind="stable")  # short ones first
        base = np.empty(len(first), np.int64)
        base[order] = np.cumsum(length[order]) - length[order]
        edges, pieces, at = [], [], 0
        for most in (min(self.plain, self.short), self.short):  # a unit's way depends on its length only
            few = order[at : int((length <= most).sum())]
            at += len(few)
            if len(few):
                n, shift = length[few], base[few[0]]
                edge, piece = self.in_step(t.data[np.arange(n.sum()) + np.repeat(starts[first[few]] - base[few] + shift, n)], n)
                edges.append(edge + shift)
                pieces.append(piece)
        for i in order[at:]:
            keys_i, pieces_i, _ = self.forward(t.data[starts[first[i]] : ends[first[i]]].tobytes())
            edges.append(np.frombuffer(keys_i, np.float64) + base[i])
            pieces.append(np.frombuffer(pieces_i, np.int32))
        edge, piece = np.concatenate(edges), np.concatenate(pieces)

        text = np.repeat(np.arange(t.n), np.diff(bounds))
        rank = (np.arange(len(starts)) - bounds[:-1][text]).astype(np.uint64)
        seed = mix(mix(keys[text] + self.seed * _SALT) + rank * _SALT)
        at, node, left = np.arange(len(starts)), base[inverse], ends - starts
        words, drawn, step = [], [], 0
        while len(at):
            u = (mix(seed[at] + np.uint64(step + 1)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            p = piece[np.searchsorted(edge, node + (left - 1) + u, "right")]
            words.append(at)
            drawn.append(p)
            left = left - self.size[p]
            on = left > 0
            at, node, left, step = at[on], node[on], left[on], step + 1
        n = np.bincount(np.concatenate(words), minlength=len(starts))
        last = np.cumsum(n)
        out = np.empty(int(last[-1]), np.int32)
        for step, (w, p) in enumerate(zip(words, drawn)):  # drawn from the end
            out[last[w] - 1 - step] = p
        return out, np.concatenate([[0], last])[bounds]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces."""
        n = self.size[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.offset[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at]


def encoded(documents: DataFrame, vocabulary_path: str | None = None, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, pieces, n_pieces, n_bytes, lossless): a sampled segmentation of every whole text.

    ``lossless`` says that decoding the pieces gave the text's bytes. A null text has null pieces, an
    empty one none; rows that repeat an id and a text get the same pieces, a null id counts as a key of
    its own. The vocabulary is broadcast: 32,000 pieces.
    """
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary(vocabulary_path), alpha, seed))

    def run(batches):
        pieces, a, s = shared.value
        sampler = Sampler(pieces, a, s)
        for batch in batches:
            column, ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            keys = np.asarray(batch.column(batch.schema.get_field_index("key")), np.int64).view(np.uint64)
            for lo, hi in slices(column):
                part = column.slice(lo, hi - lo)
                t = Texts(part)
                out, bounds = sampler.encode(t, keys[lo:hi])
                n_bytes = t.ends - t.starts
                back = np.concatenate([[0], np.cumsum(sampler.size[out])])[bounds]
                body = np.ones(len(t.data), bool)
                body[t.starts - 1], body[t.ends] = False, False
                same = np.concatenate([[0], np.cumsum(sampler.decode(out) != t.data[body])])
                fine = (np.diff(back) == n_bytes) & (same[back[1:]] == same[back[:-1]])
                gone = np.asarray(part.is_null())
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(gone, False)), pa.array(out))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists, pa.array(np.diff(bounds)), pa.array(n_bytes), pa.array(fine)], ["doc_id", "pieces", "n_pieces", "n_bytes", "lossless"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("doc_id", F.lit("pieces")).alias("key"))
    return rows.mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, n_bytes long, lossless boolean")


def decoded(rows: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, pieces); null pieces give a null text, bytes that are no UTF-8 an error."""
    shared = rows.sparkSession.sparkContext.broadcast([p for p, _ in vocabulary(vocabulary_path)])

    def run(batches):
        pieces = shared.value
        for batch in batches:
            texts = [None if x is None else b"".join([pieces[i] for i in x]).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "pieces").mapInArrow(run, "doc_id long, text string")
