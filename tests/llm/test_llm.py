"""Every corpus operator against a brute-force version, a round trip or held-out accuracy, and the edge cases of their docstrings."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexarc.llm import chat, embedding_join, graph, language, line_dedup, lm_score, minhash, mixing, prefilter, quality_crf, quality_rules, sentencepiece
from lexarc.llm.textnp import HashTable, Texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, texts, **more):
    rows = [(i, t, None, more.get("sources", [None] * len(texts))[i], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "  \n\t ", "one", "one two", "Ünï cödé 日本語 x", "x" * 70_000, "a b c " * 4000]


def smallest(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_of_a_chain_a_hub_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(1, i) for i in range(2, 90)]
    links = spark.createDataFrame(chain + hub + [(5, 5), (None, 3)], "a long, b long")
    got = dict(map(tuple, graph.components(links).collect()))
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 1 for i in range(1, 90)) and len(got) == 130


def test_bitmap_lets_every_member_through(spark):
    rows = spark.range(5000).select("id", F.lit(1).alias("_bucket_of_ours"))
    ids = rows.where("id % 97 = 0").select("id")
    got = {r["id"] for r in prefilter.likely(rows, ids).collect()}
    assert {i for i in range(5000) if i % 97 == 0} <= got and len(got) < 100


def test_hash_table_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000, dtype=np.uint64))
    found = HashTable(keys[::2]).find(keys)
    assert (found[::2] == np.arange(len(keys[::2]))).all() and (found[1::2] == -1).all()


# ---- mixing


def test_targets_fill_capped_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), ("c", 400), (None, 90)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert math.isclose(sum(got.values()), 1000) and got["a"] == 30  # 5/9 of all is above three times 10
    left, weights = 970, {"b": 2, "c": 1, None: 5}
    assert got[None] == 270 and math.isclose(got["b"] / got["c"], 2) and math.isclose(got["b"], (left - 270) * 2 / (2 + 1)) and weights


def test_pivot_keeps_mass_and_makes_one_whole():
    rng = random.Random(3)
    for _ in range(2000):
        p, q, s, t = rng.random() * 0.98 + 0.01, rng.random() * 0.98 + 0.01, rng.randint(1, 50), rng.randint(1, 50)
        a, b = mixing.pivot(p, s, q, t, rng.random())
        assert math.isclose(a * s + b * t, p * s + q * t, rel_tol=1e-9) and (a in (0, 1) or b in (0, 1)) and 0 <= min(a, b) and max(a, b) <= 1


def test_mixing_comes_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)  # several levels of the tree
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(400)] + [None, "", " "]
    docs = table(spark, texts, sources=["hot" if i % 3 else rng.choice(["b", "c", None]) for i in range(len(texts))])
    rows, again = mixing.decisions(docs).collect(), mixing.decisions(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(texts)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own) and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in rows) and mixing.mixed(docs).columns == docs.columns
    assert mixing.decisions(docs.limit(0)).count() == 0


# ---- embeddings


def test_embedding_join_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 300)] + 0.25 * rng.normal(size=(300, 8))
    x[:60] = x[0]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, v) for i, v in enumerate(odd)]
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_join.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)
    root = smallest(300, np.argwhere(np.triu(near)))
    assert len(got) == len(rows) and all(got[i] == (near[i].sum(), root[i], root[i] == i) for i in range(300))
    assert all(got[300 + i] == (0, 300 + i, True) for i in range(len(odd)))
    assert embedding_join.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- pieces


def test_pieces_round_trip(spark):
    texts = [*ODD, "tabs\tand\r\nlines\n\n", " lead", "many     blanks", "▁ mark", "\x00\x01"]
    docs = table(spark, texts)
    rows = {r["doc_id"]: r for r in sentencepiece.encoded(docs).collect()}
    back = dict(map(tuple, sentencepiece.decoded(sentencepiece.encoded(docs)).collect()))
    assert [back[i] for i in range(len(texts))] == texts
    assert all(r["lossless"] and r["n_pieces"] == len(r["pieces"] or ()) and r["n_bytes"] == len((texts[i] or "").encode()) for i, r in rows.items())
    assert rows[0]["pieces"] is None and rows[1]["pieces"] == []
    parts = {r["doc_id"]: r["pieces"] for r in sentencepiece.encoded(docs.repartition(7)).collect()}
    assert parts == {i: r["pieces"] for i, r in rows.items()}
    assert sentencepiece.encoded(docs.limit(0)).count() == 0


def every_split(unit, weight):
    if not unit:
        return [((), 1.0)]
    return [((weight[unit[:i]][1], *rest), weight[unit[:i]][0] * w) for i in range(1, len(unit) + 1) if unit[:i] in weight for rest, w in every_split(unit[i:], weight)]


@pytest.mark.parametrize("short", [True, False])
def test_sampled_segmentations_follow_their_weights(short):
    sampler = sentencepiece.Sampler([(bytes([b]), np.inf) for b in range(256)] + [(p.encode(), 2.0 * i) for i, p in enumerate(["a", "b", "ab", "ba", "aba", " a", " ab"])])
    if not short:
        sampler.short = 0
    want = dict(every_split(b" abab", sampler.weight))
    n, whole = 40_000, sum(want.values())
    ids, bounds = sampler.encode(Texts(pa.array([" abab"] * n, pa.large_string())), np.arange(n, dtype=np.uint64))
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:]))
    assert set(got) <= set(want)
    assert all(abs(got[s] / n - w / whole) < 0.012 for s, w in want.items())


def test_a_vocabulary_must_hold_all_bytes_and_no_crossing_piece():
    with pytest.raises(ValueError):
        sentencepiece.Sampler([(b"a", 1.0)])
    with pytest.raises(ValueError):
        sentencepiece.Sampler([(bytes([b]), np.inf) for b in range(256)] + [(b"a b", 1.0)])


# ---- language


def test_language_of_held_out_texts(spark):
    rng = random.Random(4)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "abfgk"}
    make = lambda k, n: " ".join("".join(rng.choice(alphabets[k]) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, make(k := rng.choice(list(alphabets)), 40), k) for i in range(240)]
    rows += [(1000, None, "aa"), (1001, "12 34 !", "aa"), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(language.sample(docs.where("doc_id % 3 <> 1")))
    got = {r["doc_id"]: r for r in language.identified(docs, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:240] if i % 3 == 1) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    none = language.fit(language.sample(docs.limit(0)))
    assert {r["lang_pred"] for r in language.identified(docs, none).collect()} == {"und"}


def test_every_language_is_learned_also_from_long_texts_only(spark):
    rows = [(i, f"abc{i}", f"l{i:03}") for i in range(300)] + [(1000 + i, "xyz zyx " * 2000, "long") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(docs)
    assert set(got) == {k for *_, k in rows} and [len(x) for x in got["long"]] == [language.SAMPLE_CHARS] * 3
    model = language.fit({k: got[k] for k in ("l000", "l001", "long")})
    assert language.identified(docs.where("doc_id = 1001"), model).first()["lang_pred"] == "long"


def test_language_code_lengths_against_a_plain_coder():
    samples = {"x": ["abracadabra abra", "cad"], "y": ["zzz abz"]}
    tree = {k: defaultdict(Counter) for k in samples}
    for k, texts in samples.items():
        for t in map(str.encode, texts):
            for i in range(len(t)):
                for m in range(min(language.ORDER - 1, i) + 1):
                    tree[k][t[i - m : i]][t[i]] += 1

    def bits(k, text):
        total = 0.0
        for i, b in enumerate(text):
            for m in range(min(language.ORDER - 1, i), -1, -1):
                seen = tree[k].get(text[i - m : i])
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if seen[b]:
                    total -= math.log2(seen[b] / whole)
                    break
                del seen[b]
                total -= math.log2(len(seen) / whole)
            else:
                total += 8
        return total

    coder = language.Coder(language.fit(samples))
    for text in ("abrac", "zabrz", "q", "abz abz"):
        got = coder.bits(Texts(pa.array([text], pa.large_string())))[0]
        assert np.allclose(got, [bits(k, text.encode()) for k in coder.names], atol=1e-3)


# ---- LM scoring


def test_lm_score_counts_every_text_and_prefers_the_target(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(30)) if i % 2 else prose(rng, 30) for i in range(100)]
    docs = table(spark, [*texts, None, ""])
    good = spark.createDataFrame([(i,) for i in range(1, 60, 2)] + [(1,), (None,)], "doc_id long")
    counted = lm_score.counts(docs, good)
    sums = {r["kind"]: (r["b"], r["t"]) for r in counted.groupBy("kind").agg(F.sum("background").alias("b"), F.sum("target").alias("t")).collect()}
    assert sums == {k: (3000, 900) for k in range(3)}
    rows = {r["doc_id"]: r for r in lm_score.scored(docs, lm_score.models(counted)).collect()}
    assert min(rows[i]["score"] for i in range(1, 100, 2)) > max(rows[i]["score"] for i in range(0, 100, 2))
    assert all(rows[i]["n_tokens"] == 0 and rows[i]["score"] == 0 for i in (100, 101))
    assert all(math.isclose(r["score"], r["background_loss"] - r["target_loss"]) for r in rows.values())


def test_lm_score_holds_exact_counts_beyond_any_fixed_number_of_slots(spark):
    texts = [" ".join(f"w{d}x{i}" for i in range(4000)) for d in range(300)]
    docs, good = table(spark, texts), spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    found = lm_score.counts(docs, good).groupBy("kind").agg(F.count("*").alias("n"), F.max("background").alias("most"), F.sum("target").alias("t")).collect()
    # each word occurs once; as a pair's first, the start mark occurs in every text
    assert {r["kind"]: (r["n"], r["most"], r["t"]) for r in found} == {0: (1_200_000, 1, 400_000), 1: (1_200_000, 1, 400_000), 2: (1_200_000 - 300 + 1, 300, 400_000)}


def test_lm_score_against_plain_counts(spark):
    rng = random.Random(16)
    texts = [*(prose(rng, rng.randrange(1, 60), 40) for _ in range(60)), *ODD[:6], "A b\tA"]
    docs, good = table(spark, texts), spark.createDataFrame([(i,) for i in range(0, 60, 3)] + [(None,)], "doc_id long")
    split = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(t or "")] for t in texts]
    single, double, first = [[Counter() for _ in range(2)] for _ in range(3)]
    for i, ws in enumerate(split):
        for j in (0, 1) if i < 60 and i % 3 == 0 else (0,):
            single[j].update(ws)
            double[j].update(zip([None, *ws], ws))
            first[j].update([None, *ws][: len(ws)])
    def loss(ws, j):
        bits = 0.0
        for a, b in zip([None, *ws], ws):
            one = (single[j][b] + 0.5) / (single[j].total() + 0.5 * (len(single[0]) + 1))
            bits -= math.log2(0.6 * (double[j][a, b] / first[j][a] if first[j][a] else one) + 0.4 * one)
        return bits / max(1, len(ws))

    apart = lm_score.scored(docs, lm_score.models(lm_score.counts(docs, good)))
    for got in (lm_score.compared(docs, good), apart):
        rows = {r["doc_id"]: r for r in got.collect()}
        assert len(rows) == len(texts)
        for i, ws in enumerate(split):
            assert rows[i]["n_tokens"] == len(ws)
            assert math.isclose(rows[i]["background_loss"], loss(ws, 0), abs_tol=1e-9) and math.isclose(rows[i]["target_loss"], loss(ws, 1), abs_tol=1e-9)


# ---- lines


def brute_lines(texts, least):
    """Later copies of every run of lines with ``least`` words."""
    kept = [[(p, x) for p, x in enumerate((t or "").split("\n")) if WORDS.search(x)] for t in texts]
    first, gone = {}, defaultdict(set)
    for d, own in enumerate(kept):
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += len(WORDS.findall(own[b][1]))
                if words >= least:
                    key = tuple(x for _, x in own[a : b + 1])
                    if first.setdefault(key, (d, a)) != (d, a):
                        gone[d] |= {p for p, _ in own[a : b + 1]}
    return {d: (len(own), sorted(gone[d])) for d, own in enumerate(kept)}


def test_line_dedup_against_every_run(spark):
    rng = random.Random(8)
    pool = [prose(rng, rng.randint(1, 4), 30) for _ in range(25)]
    passage = [prose(rng, 3) for _ in range(6)]
    texts = []
    for i in range(60):
        own = [rng.choice(pool) for _ in range(rng.randint(0, 12))] + [""] * rng.randint(0, 2)
        texts.append("\n".join(own[:5] + passage * (i % 4 == 0) + own[5:] + (passage if i == 8 else [])))
    texts += [texts[3], None, "", " \n ", "same line\n" * 30]
    docs = table(spark, texts)
    want = brute_lines(texts, 8)
    got = {r["doc_id"]: (r["n_lines"], [int(x) for x in r["deleted"].split(",") if x]) for r in line_dedup.report(docs, 8).collect()}
    assert got == want
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs, 8).collect()}
    for i, t in enumerate(texts):
        n, gone = want[i]
        if gone and len(gone) == n:
            assert i not in left
        else:
            assert left[i] == (t if not gone else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone))
    assert line_dedup.report(docs.limit(0)).count() == 0


# ---- quality


def quality_rows(rng, n):
    rows = []
    for i in range(n):
        good = rng.random() < 0.6
        rows.append((i, "\n".join(prose(rng, 12) + "." if good else "BUY $$$ NOW!!! %% ## " * 3 for _ in range(rng.randint(1, 8))), int(good)))
    return rows


def test_quality_classifier_and_rules_on_held_out_rows(spark):
    rows = quality_rows(random.Random(9), 300)
    docs = table(spark, [t for _, t, _ in rows] + ODD)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.trained(docs.where("doc_id % 4 <> 2"), labels)
    got = {r["doc_id"]: r["_quality"] for r in quality_crf.scored(docs, model).collect()}
    assert len(got) == 300 + len(ODD) and all(0 <= s <= 1 for s in got.values()) and got[300] == got[301] == got[302] == 0
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows if i % 4 == 2)
    rules = {r["doc_id"]: r for r in quality_rules.rules(docs, quality_rules.fit(*quality_rules.sample(docs.where("doc_id % 4 <> 2"), labels))).collect()}
    assert all((rules[i]["probability"] >= 0.5) == bool(y) for i, _, y in rows if i % 4 == 2)
    assert all(r["kept"] == (not r["base_failed"] and r["probability"] >= 0.5) for r in rules.values())
    texts, y = quality_rules.sample(docs, labels, rows=20)
    assert len(texts) == 40 and y.sum() == 20
    one = quality_crf.trained(docs, labels.where("quality = 1"))
    assert min(r["_quality"] for r in quality_crf.scored(docs.where("doc_id < 300"), one).collect()) > 0.99


def test_marginals_against_every_labelling():
    rng = np.random.default_rng(3)
    bounds, emission, transition = np.array([0, 4, 4, 5]), rng.normal(size=5), rng.normal(size=(2, 2))
    p, pairs = quality_crf.marginals(bounds, emission, transition, np.ones(5))
    want, both = np.zeros(5), np.zeros((2, 2))
    for lo, hi in ((0, 4), (4, 5)):
        labellings = [[(m >> i) & 1 for i in range(hi - lo)] for m in range(1 << (hi - lo))]
        w = np.array([np.exp(sum(emission[lo + i] * x for i, x in enumerate(y)) + sum(transition[a, b] for a, b in zip(y, y[1:]))) for y in labellings])
        for y, share in zip(labellings, w / w.sum()):
            want[lo:hi] += share * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += share
    assert np.allclose(p, want) and np.allclose(pairs, both)


def test_rule_counts_against_plain_python():
    rng = random.Random(10)
    texts = [*ODD, *("\n".join(rng.choice(["a b c", "a b c d", "# x|y", "", "é é é é"]) for _ in range(rng.randint(0, 9))) for _ in range(60))]
    got = quality_rules.counts(Texts(pa.array(texts, pa.string())))
    for i, t in enumerate(t or "" for t in texts):
        words = WORDS.findall(t)
        at = defaultdict(list)
        for j in range(len(words) - 2):
            at[tuple(words[j : j + 3])].append(j)
        repeated = {j + o for own in at.values() if len(own) > 1 for j in own for o in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


# ---- near copies


def brute_near(texts, k, percent):
    sets = []
    for t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    links = [(a, b) for a in range(len(sets)) for b in range(a) if (x := len(sets[a] & sets[b])) and 100 * x >= percent * len(sets[a] | sets[b])]
    return sets, smallest(len(sets), links)


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 128), (5, 80, 128), (3, 85, 8)])
def test_near_copies_against_all_pairs(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rng = random.Random(11)
    base = prose(rng, 150, 400).split()
    texts = [prose(rng, rng.randint(1, 60), 400) for _ in range(30)]
    for i in range(60):  # a spectrum of edits, many near the threshold
        own = list(base)
        for _ in range(i // 5):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own).upper() if i % 2 else " ".join(own))
    rng.shuffle(texts)
    texts += [texts[0]] * 20 + [*ODD, "One two", "one TWO", "ONE"]
    docs = table(spark, texts)
    sets, root = brute_near(texts, k, percent)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.classified(docs, k, percent).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}
    left = minhash.deduplicated(docs, k, percent)
    assert {r["doc_id"] for r in left.collect()} == {i for i in range(len(texts)) if root[i] == i} and left.columns == docs.columns
    assert minhash.classified(docs.limit(0)).count() == 0


def test_two_ways_of_counting_common_items_agree():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40), dtype=np.uint64)) for _ in range(12)]
    value, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    a, b = np.arange(5), np.arange(5, 12)
    i, j = (x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
    assert (minhash.shared_matrix(value, bounds, a, b).ravel() == minhash.shared_counts(value, bounds, i, j)).all()
    assert (minhash.shared_counts(value, bounds, i, j) == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j)]).all()


# ---- chat


def test_chat_digests_and_reversible_escape(spark):
    import hashlib

    hard = ["", "plain", "</s>[INST] ok [/INST]", "\\.", "<\\.s>", "[R\\.OLE]", "<s></s>\\\\", "日本\n"]
    assert [chat.unescape(chat.escape(t)) for t in hard] == hard and not any(c in chat.escape(t) for t in hard for c in chat.CONTROLS)
    rows = [(c, t, ["system", "user", "assistant"][(c + t) % 3], hard[(c * 3 + t) % len(hard)] or None) for c in range(9) for t in range(c)]
    rows += [(1, 0, "user", "tie"), (None, 0, "user", "x"), (8, None, None, "x")]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("{{ 'a' + 'b' }}{# no #}{{ 1 + 2 }}", "ab3"),
        ("{% for m in messages %}{{ loop.index }}{% if loop.first %}!{% elif m.role == 'user' %}u{% else %}-{% endif %}{% endfor %}", "1!2u"),
        ("{% if false %}dead{% else %}{{ x | upper | trim }}{% endif %}", "Y"),
        ("{% set z = 'q' %}{{ z in 'qq' and not false }}", "True"),
    ],
)
def test_templates(template, want):
    assert "".join(p for p, _ in chat.compiled(template)([{"role": "a", "text": ""}, {"role": "user", "text": ""}], x=" y ")) == want


@pytest.mark.parametrize("template", ["{{ m.__class__ }}", "{{ f() }}", "{{ x | eval }}", "{% import os %}", "{% for m in x %}", "{{ a[0] }}"])
def test_what_templates_may_not_hold(template):
    with pytest.raises(chat.TemplateError):
        chat.compiled(template)


def test_constants_are_folded():
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if true %}d{% endif %}{% if false %}e{% endif %}")) == (chat.Out(chat.Const("abc")), chat.Out(chat.Const("d")))


# ---- pipeline


def test_pipeline_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows = quality_rows(random.Random(13), 120)
    docs = table(spark, [t for _, t, _ in rows], sources=["abc"[i % 3] for i in range(120)])
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name == "quality classifier":
            assert {r["doc_id"] for r in out.collect()} == {i for i, _, y in rows if y}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert all(r["lossless"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("text", ["", "x", "é", "\n", " a", "a b", "a b\nc"])
def test_a_slice_of_one_tiny_text(text):
    column = pa.array([text], pa.large_string())
    n = len(WORDS.findall(text))
    assert quality_rules.counts(Texts(column))["n_words"][0] == n
    assert np.isfinite(quality_rules.margins(Texts(column), np.ones((4, 1 << quality_rules.BITS)))).all()
    model = {"w": np.zeros(quality_crf.WIDTH), "bias": 0.0, "transition": np.zeros((2, 2))}
    assert quality_crf.document_scores(Texts(column), model)[0] == (0.5 if n else 0)
    value, bounds = minhash.shingle_sets(Texts(column), 3)
    assert len(value) == bounds[-1] == min(n, 1) and minhash.signatures(value, bounds).shape == (1, minhash.BANDS)
    assert language.Coder(language.fit({"x": ["ab"]})).bits(Texts(column)).shape == (1, 1)
    lm = {"counts": np.ones((3, 2, lm_score.SLOTS), np.float32), "totals": np.ones(2) * lm_score.SLOTS, "weight": 0.5}
    assert len(lm_score.losses(Texts(column), lm)[0]) == n
    sampler = sentencepiece.Sampler(sentencepiece.vocabulary())
    ids, _ = sampler.encode(Texts(column), np.zeros(1, np.uint64))
    assert sampler.decode(ids).tobytes() == text.encode()
