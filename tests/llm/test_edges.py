"""Nulls, repeated ids, empty tables and clashing column names for every corpus operator and stage, and brute-force versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarc.llm import chat, embedding_join, language, line_dedup, lm_score, minhash, mixing, quality_crf, quality_rules, queries, sentencepiece
from .test_llm import ODD, brute_lines, brute_near, prose, quality_rows, smallest, table

#: Names that the operators use inside.
INSIDE = ["_quality", "_Quality", "_id", "_size", "_copies", "_n", "_i", "_h", "_d", "_t", "_gone", "gone", "_bucket", "_bit", "_bits", "_source", "_heavy", "th", "rest", "id", "row", "n", "copies", "deleted", "n_lines", "h", "size", "key", "name", "text_", "k", "d", "all", "_"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(21)
    passage = "\n".join(prose(rng, 12) for _ in range(9))
    texts = [*ODD, *(prose(rng, 30) for _ in range(6)), "own words here\n" + passage, passage + "\nother words", prose(rng, 60), None, ""]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None) for i, t in enumerate(texts)]
    rows += [(5, "other text of row five " * 9, "en", "a", 1), (5, None, None, None, None), (3, "one", "en", "a", None), (3, "one", "en", "a", None)]
    rows += [(None, "a text without an id " * 4, "de", "b", 2)] * 3 + [(None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def wide(df):
    """With columns of every name used inside, one of them nested."""
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(INSIDE) if c != "_Quality"], F.struct(F.lit(1).alias("x")).alias("deep"))


@pytest.fixture(scope="module")
def models(spark):
    rows = quality_rows(random.Random(9), 80)
    docs, labels = table(spark, [t for _, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    sample = quality_rules.sample(docs, labels)
    return {"crf": quality_crf.fit(*sample), "rules": quality_rules.fit(*sample), "language": language.fit({"en": ["some english text"], "de": ["ein deutscher text"]})}


def test_every_operator_answers_every_row_and_an_empty_table(spark, odd, models):
    n, none = odd.count(), odd.limit(0)
    good = spark.createDataFrame([(5,), (None,)], "doc_id long")
    runs = {
        "mixing": mixing.decisions,
        "pieces": sentencepiece.encoded,
        "language": lambda d: language.identified(d, models["language"]),
        "lm": lambda d: lm_score.compared(d, good),
        "lines": line_dedup.report,
        "crf": lambda d: quality_crf.scored(d, models["crf"]),
        "rules": lambda d: quality_rules.rules(d, models["rules"]),
        "near": minhash.classified,
    }
    want = sorted(map(str, (r["doc_id"] for r in odd.select("doc_id").collect())))
    for name, run in runs.items():
        got = run(odd).collect()
        assert sorted(str(r["doc_id"]) for r in got) == want and len(got) == n, name
        assert run(none).count() == 0, name
    lm = [r for r in runs["lm"](odd).collect() if r["n_tokens"] == 0]
    assert all(r["score"] == 0 for r in lm) and len(lm) == 7
    near = runs["near"](odd).collect()
    assert all(r["kept"] and r["component_id"] is None for r in near if r["doc_id"] is None)
    assert runs["rules"](odd).where("doc_id is null and kept").count() == 0


def test_stages_keep_columns_of_any_name(spark, odd, models):
    from lexarc.llm.store import unused

    docs = wide(odd)
    name = unused(docs, "_quality")
    assert name == "__quality"
    scored = quality_crf.scored(docs, models["crf"], name)
    assert scored.columns == [*docs.columns, name] and scored.count() == docs.count()
    for stage in (line_dedup.deduplicated, minhash.deduplicated, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns and out.schema["deep"].dataType == docs.schema["deep"].dataType
        rows = out.collect()
        assert rows and all([r[c] for c in INSIDE if c != "_Quality"] == [i for i, c in enumerate(INSIDE) if c != "_Quality"] for r in rows), stage.__name__
        assert stage(docs.limit(0)).count() == 0


def test_near_copies_of_repeated_ids(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 80, 500) for _ in range(3))
    rows = [(5, a), (5, b), (7, a + " more"), (3, b + " end"), (9, c), (9, " "), (9, None), (2, c + " x"), (None, a), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.classified(docs, 3, 85).collect()), key=str)
    want = [(5, 3, False), (5, 3, False), (7, 3, False), (3, 3, True), (9, 2, False), (9, 2, False), (9, 2, False), (2, 2, True), (None, None, True), (4, 4, True), (5, 3, False)]
    assert got == sorted(want, key=str)
    assert sorted((r["doc_id"] for r in minhash.deduplicated(docs, 3, 85).collect()), key=str) == [2, 3, 4, None]


def test_repeated_vectors_share_a_node(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(4, x), (4, y), (2, x), (9, y), (None, x), (9, None)]
    got = sorted(map(tuple, embedding_join.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert got == sorted([(4, 2, 2, False), (4, 2, 2, False), (2, 1, 2, True), (9, 1, 2, False), (9, 1, 2, False), (None, 0, None, True)], key=str)


def test_blocks_are_skipped_where_vectors_lie_in_clusters_and_no_link_is_lost(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 40)
    monkeypatch.setattr(embedding_join, "STRIP", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 24))
    x = (centres[np.repeat(np.arange(10), 200)] + 0.2 * rng.normal(size=(2000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(2000, dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in embedding_join.linked(df).collect()}
    assert near.sum() > 10_000 and all(got[i] == near[i].sum() for i in range(2000))
    eps = float(np.sqrt(0.2))
    valid = embedding_join._valid(df, "vec_id", "embedding")
    blocks = embedding_join._sequence(valid, embedding_join.directions(valid, 24), eps, "f4", 2000).cache()
    n = blocks.count()
    assert n >= 30 and embedding_join._pairs(blocks, eps).count() < 0.6 * n * (n + 1) / 2


def test_planted_links_among_fifty_thousand_vectors(spark):
    """Evenly spread vectors, 400 of them near another one, and one cluster of 300: against all pairs."""
    import pandas as pd

    rng = np.random.default_rng(8)
    x = rng.normal(size=(50_000, 32))
    x[49_000:49_400] = x[:400] + 0.2 * rng.normal(size=(400, 32))
    x[49_600:49_900] = x[500] + 0.15 * rng.normal(size=(300, 32))
    x = x.astype(np.float32)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": list(x)}), "vec_id long, embedding array<float>")
    spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    got = embedding_join.linked(df).toPandas().sort_values("vec_id")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    number, links = np.zeros(50_000, np.int64), []
    for lo in range(0, 50_000, 2000):
        a, b = np.nonzero(u[lo : lo + 2000] @ u.T >= 0.9)
        a = a + lo
        a, b = a[a != b], b[a != b]
        number += np.bincount(a, minlength=50_000)
        links.append(np.stack([a, b]))
    a, b = np.concatenate(links, 1)
    assert number.sum() > 50_000 and (number > 0).sum() > 900
    assert (got["n_links"].to_numpy() == number).all() and (got["component_id"].to_numpy() == embedding_join.forest(a, b, 50_000)).all()


# ---- mixing


def plain_targets(sizes):
    """Water filling: cap the source that is most above its cap, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {**capped, **{s: weight[s] * level for s in free}}
        capped.update({s: 3.0 * sizes[s] for s in over})


def test_targets_against_water_filling(spark):
    rng = random.Random(17)
    for trial in range(8):
        sizes = {s: rng.choice([0, 1, 5, 100, 10_000]) * rng.randint(1, 9) for s in [*(f"{c}{trial}" for c in "bcadZé"), None][: rng.randint(1, 7)]}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        want = plain_targets(sizes)
        assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_equal_rows_share_what_is_taken_and_expectations_hold(spark):
    rows = [(1, "a b c d", "x")] * 50 + [(None, "e f", "x")] * 30 + [(i, "w " * (i % 7 + 1), "xy"[i % 2]) for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.decisions(docs).collect()
    assert len(got) == len(rows) and Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    for key in (1, None):
        own = [r["copies"] for r in got if r["doc_id"] == key]
        assert max(own) - min(own) <= 1
    for source in "xy":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    out = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(docs).collect())
    want = Counter()
    for r in got:
        want[r["doc_id"], r["size"], r["source"]] += r["copies"]
    assert Counter({(i, len(t.split()), s): n for (i, t, s), n in out.items()}) == +want


# ---- quality


def write_tables(spark, path, rows, extra=()):
    docs = [(i, t, "en", "abc"[i % 3], len(t)) for i, t, _ in rows] + list(extra)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")


def test_held_out_labels_do_not_move_a_score(spark, tmp_path):
    import zlib

    rows = quality_rows(random.Random(41), 120)
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, t, y in rows]
    assert flipped != rows
    got = []
    for name, own in (("a", rows), ("b", flipped)):
        write_tables(spark, f"{tmp_path}/{name}", own)
        got.append({r["doc_id"]: tuple(r) for r in queries.op7_quality_crf(spark, f"{tmp_path}/{name}").collect()})
    assert got[0] == got[1] and {v[1] for v in got[0].values()} == {True, False}


def test_a_label_on_long_texts_only_is_learned(spark):
    rng = random.Random(43)
    texts = [prose(rng, 12) + "." for _ in range(40)] + ["BUY $$$ NOW!!! %% ##\n" * 3000 for _ in range(5)]
    docs, labels = table(spark, texts), spark.createDataFrame([(i, int(i < 40)) for i in range(45)], "doc_id long, quality int")
    got, y = quality_rules.sample(docs, labels)
    assert y.sum() == 40 and len(y) == 45 and max(map(len, got)) == quality_rules.SAMPLE_CHARS
    scores = {r["doc_id"]: r["_quality"] for r in quality_crf.scored(docs, quality_crf.trained(docs, labels)).collect()}
    assert min(scores[i] for i in range(40)) > 0.7 > max(scores[i] for i in range(40, 45))


def test_probabilities_are_those_of_the_corpus(spark):
    """One feature word in three strengths, nine of ten labels good: predicted and seen shares agree."""
    rng = np.random.default_rng(7)
    rows, truth = [], {"sure": 0.99, "likely": 0.85, "open": 0.55}
    for i in range(6000):
        kind = rng.choice(["sure", "likely", "open"], p=[0.7, 0.2, 0.1])
        rows.append((i, f"{kind} filler words {rng.integers(0, 50)}", int(rng.random() < truth[kind])))
    docs, labels = table(spark, [t for _, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality_rules.fit(*quality_rules.sample(docs, labels), quality_rules.good_share(labels))
    got = {r["doc_id"]: r["probability"] for r in quality_rules.rules(docs, model).collect()}
    for kind, share in truth.items():
        own = [i for i, t, _ in rows if t.startswith(kind)]
        assert abs(np.mean([got[i] for i in own]) - share) < 0.13, kind
    assert abs(np.mean(list(got.values())) - np.mean([y for *_, y in rows])) < 0.05


def test_rule_verdicts_against_plain_features(spark):
    """The score is the mean weight of the features of each kind, computed here text by text."""
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(4, 1 << quality_rules.BITS)).astype(np.float32)
    texts = ["One two, three two one", "", "x", "Ünï cödé " * 40, "A\nb\tC d e f g", None]
    import pyarrow as pa

    from lexarc.llm.textnp import LOWER, Texts

    whole = quality_rules.margins(Texts(pa.array(texts, pa.large_string()), LOWER), weights)
    alone = [quality_rules.margins(Texts(pa.array([t], pa.large_string()), LOWER), weights)[0] for t in texts]
    assert np.allclose(whole, alone)
    for t, got in zip(texts, alone):
        data = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode()
        want = 0.0
        for kind, n in ((2, 3), (3, 5)):
            slots = []
            for i in range(len(data) - n + 1):
                v = int.from_bytes(data[i : i + n], "big")
                slots.append(((v * 0x9E3779B97F4A7C15 + (kind << 7)) % 2**64 * 0xD6E8FEB86659FD93) % 2**64 >> (64 - quality_rules.BITS))
            want += sum(float(weights[kind][s]) for s in slots) / max(1, len(slots))
        words = weights.copy()
        words[2:] = 0
        part = quality_rules.margins(Texts(pa.array([t], pa.large_string()), LOWER), words)[0]
        assert math.isclose(got, want + part, abs_tol=1e-6)


def test_language_ties_go_to_the_first_name(spark):
    model = language.fit({"bb": ["abc abc"], "aa": ["abc abc"]})
    docs = table(spark, ["abc", "zzz", "é"])
    got = [(r["lang_pred"], round(r["score"], 6)) for r in language.identified(docs, model).orderBy("doc_id").collect()]
    assert got == [("aa", 0.5)] * 3


# ---- lines


def test_line_runs_beyond_any_fixed_length(spark):
    rng = random.Random(51)
    long = [f"line {i} of the long one" for i in range(150)]
    texts = ["\n".join(["head a b c", *long]), "\n".join([*long[20:140], "tail x y z"]), "\n".join(["p q r s"] + long[100:] + ["z"] + long[:30]), "\n".join(long[60:62])]
    texts += ["\n".join(["a b c d e", "f g h i j"] * 40), "\n".join(["f g h i j", "a b c d e"] * 7)]
    texts += ["\n".join(rng.choice(["l one two", "m one two", "n one two"]) for _ in range(60)) for _ in range(6)]
    docs = table(spark, texts)
    for least in (12, 50):
        want = brute_lines(texts, least)
        got = {r["doc_id"]: (r["n_lines"], [int(x) for x in r["deleted"].split(",") if x]) for r in line_dedup.report(docs, least).collect()}
        assert got == want


def test_line_dedup_of_repeated_and_null_ids(spark):
    body = "\n".join(f"some words of line {i}" for i in range(20))
    rows = [(1, "x\n" + body), (1, "y\n" + body), (None, body), (1, "x\n" + body), (0, "w")]
    got = sorted((r["doc_id"] is None, r["n_lines"], r["n_deleted"]) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 1, 0), (False, 21, 20), (False, 21, 20), (False, 21, 20), (True, 20, 0)]


# ---- chat and pieces


def test_chat_of_an_empty_table_and_very_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string, id int, row int"
    assert chat.digests(spark.createDataFrame([], schema)).count() == 0
    import hashlib

    text = "[INST] </s> \\ word " * 60_000
    r = chat.digests(spark.createDataFrame([(1, 0, "user", text, 1, 2), (1, 1, "assistant", text, 1, 2)], schema)).first()
    assert r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pieces_depend_on_the_key_and_the_text_only(spark):
    text = "some words to be cut into pieces " * 5
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text)]
    got = [(r["doc_id"], tuple(r["pieces"])) for r in sentencepiece.encoded(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(set(got)) == 3 and len({p for _, p in got}) == 3


def test_units_of_all_lengths_in_one_slice():
    import pyarrow as pa

    from lexarc.llm.textnp import Texts

    sampler, rng = sentencepiece.Sampler(sentencepiece.vocabulary()), random.Random(71)
    texts = ["".join(rng.choice("ab日é_") for _ in range(n)) for n in (1, 5, 40, 70, 300, 900, 3000, 9000)] * 2 + [prose(rng, 50)]
    rng.shuffle(texts)
    keys = np.arange(len(texts), dtype=np.uint64)
    ids, bounds = sampler.encode(Texts(pa.array(texts, pa.large_string())), keys)
    for i, t in enumerate(texts):
        own = ids[bounds[i] : bounds[i + 1]]
        assert sampler.decode(own).tobytes() == t.encode()
        alone, _ = sampler.encode(Texts(pa.array([t], pa.large_string())), keys[i : i + 1])
        assert (alone == own).all()


def test_long_units_in_step_against_sums_of_logarithms():
    sampler = sentencepiece.Sampler(sentencepiece.vocabulary())
    weights = {p: (math.log(w), i) for p, (w, i) in sampler.weight.items()}
    for unit in ("x" * 300, "日本語の文章です。" * 60, " " * 400, "\x00" * 500, "the" * 300):
        raw = unit.encode()
        edge, piece = sampler.in_step(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
        total, at = [0.0], 0
        for e in range(1, len(raw) + 1):
            own = [(total[b] + weights[raw[b:e]][0], weights[raw[b:e]][1]) for b in range(max(0, e - sampler.longest), e) if raw[b:e] in weights]
            top = max(x for x, _ in own)
            total.append(top + math.log(sum(math.exp(x - top) for x, _ in own)))
            share = dict(zip(piece[at : at + len(own)].tolist(), np.diff(edge[at : at + len(own)] - (e - 1), prepend=0.0)))
            assert all(abs(share[i] - math.exp(x - total[-1])) < 1e-9 for x, i in own)
            at += len(own)
        assert at == len(edge)


# ---- pipeline


def test_every_stage_of_the_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(61)
    rows = quality_rows(rng, 90)
    passage = "\n".join(prose(rng, 9) + "." for _ in range(9))
    extra = [(200 + i, (f"{prose(rng, 14)}.\n" + passage), "en", "a", 1) for i in range(5)]
    base = prose(rng, 120, 900).split()
    for i in range(6):
        own = list(base)
        own[i * 7] = "changed"
        extra.append((300 + i, " ".join(own) + ".", "en", "b", 1))
    extra += [(400, None, None, None, None), (401, "", "en", "c", 0), (302, extra[7][1], "en", "b", 1)]
    write_tables(spark, tmp_path, rows, extra)
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        rows_in = sorted(docs.select("doc_id", "text", "source").collect(), key=str)
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name.replace(' ', '_')}")
            out = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
            assert out.columns == docs.columns
        got = out.collect()
        texts = [r["text"] for r in rows_in]
        if name == "quality classifier":
            bad = {i for i, _, y in rows if not y}
            assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows_in} - bad - {400, 401}
        elif name == "line dedup":
            want, order = brute_lines([r["text"] for r in sorted(rows_in, key=lambda r: r["doc_id"])], 50), sorted(rows_in, key=lambda r: r["doc_id"])
            left = Counter()
            for d, r in enumerate(order):
                n, gone = want[d]
                if r["doc_id"] == 302:
                    gone = []  # equal rows are one document
                if len(gone) < n:
                    left[r["doc_id"], "\n".join(x for p, x in enumerate(r["text"].split("\n")) if p not in set(gone))] += 1
            assert Counter((r["doc_id"], r["text"]) for r in got) == left
        elif name == "near-duplicate removal":
            ids = sorted({r["doc_id"] for r in rows_in})
            _, root = brute_near([next(r["text"] for r in rows_in if r["doc_id"] == i) for i in ids], 5, 80)
            assert {r["doc_id"] for r in got} == {i for n, i in enumerate(ids) if root[n] == n}
        elif name == "source mixing":
            sizes = defaultdict(int)
            for r in rows_in:
                sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            target, taken = plain_targets(dict(sizes)), defaultdict(int)
            for r in got:
                taken[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            assert all(abs(taken[s] - target[s]) <= max(len((t or "").split()) for t in texts) for s in target)
        else:
            assert all(r["lossless"] for r in got) and Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows_in)
        docs, before = out, rows_in
    assert before and smallest(2, [(0, 1)]) == [0, 0]
