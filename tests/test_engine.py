"""Stored layers, sessions, query front ends, fetching, and the command line."""

import io

import pytest
from pyspark.sql import functions as F

from lexarc import index as ix
from lexarc import records
from lexarc.__main__ import main
from lexarc.config import Config
from lexarc.functions.analysis import FIELD_TYPES, Charmap, FieldType
from lexarc.operators import browse, combine, ranking
from lexarc.operators.leaf import folded
from lexarc.plans.cql import from_cql
from lexarc.plans.prefix import Apt, Bool, Diagnostic, Prox, parse
from lexarc.plans.sorting import sort_spec, with_sort_leaves
from lexarc.session import Session
from lexarc.sources.markup import tree_postings
from lexarc.storage import Locked, numbered
from lexarc.streaming.ingest import ingest

TEXTS = ["Red fish, blue fish", "One fish two fish", "blue moon over red hill", "", None, "Straße und Größe", "over the hill: red red red"]
FIELDS = [ix.Field("text", (("any", "w"), ("any", "p"))), ix.Field("cls", (("cls", "s"),))]


def frame(spark, texts=TEXTS, start=0):
    rows = [(start + i, t, ["b", "a", None][i % 3], f"k{start + i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "sysno long, text string, cls string, match_key string")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = ix.Store(spark, str(tmp_path_factory.mktemp("store")))
    s.write(ix.build(frame(spark), FIELDS))
    return s


@pytest.fixture(scope="module")
def index(store):
    return store.read()


def ids(session, query, **kw):
    return sorted(r[0] for r in session.search(query, **kw).keys.select("sysno").distinct().collect())


# ---- a stored index


def test_a_stored_leaf_prunes_and_pushes_down(index, capsys):
    Session(index).search("fish").keys.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "idx_type" in plan and "EqualTo(term,fish)" in plan


def test_layers_equal_a_rebuild(spark, tmp_path):
    s = ix.Store(spark, str(tmp_path))
    s.write(ix.build(frame(spark), FIELDS))
    new = frame(spark, ["changed fish", "fresh words"], 1)
    gone = new.select(F.lit("Default").alias("db"), "sysno").unionByName(spark.createDataFrame([("Default", 6)], "db string, sysno long"))
    before = s.read()
    s.merge(ix.build(new, FIELDS), gone)
    whole = ix.build(frame(spark).where("sysno not in (1, 2, 6)").unionByName(new), FIELDS)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for now in (s.read(), s.read(s.compact())):
        assert rows(now.postings) == rows(whole.postings) and rows(now.sortkeys) == rows(whole.sortkeys)
        assert rows(now.dictionary()) == rows(whole.dictionary()) and rows(now.catalog()) == rows(whole.catalog())
        assert not [r for r in ix.check(now).collect() if r["n"] and "posting" not in r["fault"]]
    assert ids(Session(before), "red") == [0, 2, 6]  # a reader keeps what it was given
    s.clean()
    assert ids(Session(s), "fish") == [0, 1]


def test_one_writer_and_whole_versions(spark, tmp_path):
    s = ix.Store(spark, str(tmp_path))
    n = s.write(ix.build(frame(spark), FIELDS))
    s.folder.create("writer.lock", "x")
    with pytest.raises(Locked):
        s.write(ix.build(frame(spark), FIELDS))
    s.unlock()
    number, state = s.manifests.latest()
    s.manifests.publish(number, state)
    with pytest.raises(Locked):
        s.manifests.publish(number, state)  # somebody else has taken the next number
    assert s.read().records.count() == len(TEXTS) and s.read(n).records.count() == len(TEXTS)
    s.drop_database("Default")
    assert s.read().records.count() == 0
    s.init()
    with pytest.raises(FileNotFoundError):
        s.read()


def test_changes_follow_each_other(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("f", 9)], "match_key string, v int")
    rows = [("a", 5, "delete", 1), ("a", 6, "insert", 2), ("c", 7, "insert", 1), ("c", 8, "delete", 2), ("b", 3, "replace", 1), ("b", 4, "insert", 2), ("d", 1, "delete", 1), ("d", 2, "update", 1), ("e", 1, "replace", 1), ("e", 2, "insert", 2), ("f", 0, "adelete", 3), ("f", 8, "update", 2)]
    records_, errors = ix.apply_changes(old, spark.createDataFrame(rows, "match_key string, v int, action string, at int"))
    assert sorted(map(tuple, records_.collect())) == [("a", 6), ("b", 3), ("d", 2), ("e", 2)]
    assert sorted(map(tuple, errors.collect())) == [("b", "insert", "exists"), ("d", "delete", "missing"), ("e", "replace", "missing")]


def test_stream_merges_and_keeps_errors(spark, tmp_path):
    schema = "match_key string, sysno long, text string, action string, at int"
    s = ix.Store(spark, str(tmp_path / "store"))
    empty = spark.createDataFrame([], "match_key string, sysno long, text string")
    build = lambda r: ix.build(r, [ix.Field("text", (("any", "w"),))])
    for batch in ([("a", 1, "x y", "insert", 1), ("b", 2, "z", "insert", 1)], [("a", 1, "w", "update", 1), ("b", 2, "q", "insert", 1), ("c", 3, "v", "insert", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), s, build, str(tmp_path / "cp"), empty, errors_to=str(tmp_path / "errors")).awaitTermination()
    assert sorted(r["term"] for r in s.read().terms("any", "w").collect()) == ["v", "w", "z"] and len(s.manifests.latest()[1]["layers"]) == 2
    assert [(r["match_key"], r["error"]) for r in spark.read.parquet(str(tmp_path / "errors")).collect()] == [("b", "exists")]


def test_match_keys_from_a_specification(spark, index):
    got = {r["sysno"]: r["match_key"] for r in ix.match_keys(index.records, "$database (any:w) 'x'", index).collect()}
    assert got[0] == "Default\x01red fish blue fish\x01x" and got[3] is None


def test_numbered_rows(spark):
    rows = numbered(spark.range(1000).orderBy(F.desc("id"))).collect()
    assert {r["id"]: r["position"] for r in rows} == {i: 1000 - i for i in range(1000)}


# ---- sessions


def test_databases_do_not_meet(spark):
    one = ix.build(frame(spark), FIELDS, db="one")
    two = ix.build(frame(spark, ["moon", "hill"]), FIELDS, db="two")
    s = Session(ix.joined_indexes(one, two))
    assert ids(s, "@and fish moon") == [] and ids(s, "@and blue moon") == [2] and s.search("moon").hits() == 2
    assert [tuple(r) for r in s.search("moon").keys.select("db", "sysno").orderBy("db").collect()] == [("one", 2), ("two", 0)]
    s.select(["two"])
    assert ids(s, "hill") == [1] and [r["term"] for r in s.scan("a").collect()] == ["hill", "moon"]


def test_sets_are_renumbered_cloned_and_sorted(index):
    s = Session(index)
    s.search("@and @attr 2=102 red @attr 2=102 hill", "r")
    both = s.search("@or @attr 2=102 fish @set r")
    assert {r["term_id"]: r["hits"] for r in both.term_hits().collect()} == {0: 2, 1: 2, 2: 2}
    assert both.scored().count() == 4
    s.clone("r", "again")
    assert s.sets["again"].hits() == 2 and [r["sysno"] for r in s.sort("again", "sorted", "cls >").ordered().collect()] == [6, 2]
    assert [r["sysno"] for r in s.search("red").at([3, 1]).orderBy("position").collect()] == [0, 6]
    for bad in ([0], [4], []):
        with pytest.raises(Diagnostic) as e:
            s.search("red").at(bad)
        assert e.value.code == 13
    assert s.search("red").of_record(6).count() == 3


def test_rights_types_and_limits(spark, store, index):
    with pytest.raises(Diagnostic) as e:
        Session(store).apply(ix.build(frame(spark).limit(0), FIELDS), index.records.limit(0))
    assert e.value.code == 223
    with pytest.raises(Diagnostic) as e:
        Session(index).search("a", kind="ccl")
    assert e.value.code == 107
    with pytest.raises(Diagnostic) as e:
        Session(index, [])
    assert e.value.code == 109
    wide = Session(index).search("@attr 5=1 @attr 13=3 o")
    assert wide.partial() and not Session(index).search("@attr 5=1 @attr 13=30 o").partial()
    assert tuple(Session(index, limit=2).search("red").hit_counts().first())[1] and not Session(index, limit=9).search("red").hit_counts().first()[1]
    many = spark.range(30_000).select(F.lit("d").alias("db"), F.col("id").alias("sysno"))
    hits, about = ranking.approximate_hits(many, 100).first()
    assert about and abs(hits - 30_000) < 2_500 and hits == ranking.rounded_hits(hits)
    assert ids(Session(index), "@attr 1=_ALLRECORDS @attr 2=103 x") == list(range(7)) and ids(Session(index), "@attr 4=107 4") == [4]


def test_nested_paths_with_predicates(spark):
    docs = ["<r id='1'><t lang='en'>foo</t></r>", "<r id='2'><t lang='en'>foo</t></r>", "<r id='1'><t lang='de'>foo</t><x><t lang='en'>bar</t></x></r>"]
    s = Session(ix.Index(None, tree_postings(spark.createDataFrame(list(enumerate(docs)), "sysno long, text string"), {}, "xml"), None))
    ask = lambda path, term="foo", more="": ids(s, f'@attr "1={path}" {more} {term}')
    assert ask("/r[@id='1']/t") == [0, 2] and ask("/r[@id='1']/t[@lang='en']") == [0] and ask("/r[@id='2']//t[@lang='en']") == [1]
    assert ask("/r[@id='1']//t[@lang='en']", "bar") == [2] and ask("/r[@id='1']/t[@lang='de']", "x", "@attr 2=103") == [2] and ask("/r[@id='3']/t", "x", "@attr 2=103") == []


@pytest.mark.parametrize(("relation", "ordered", "exclusion"), [(r, o, x) for r in range(1, 7) for o in (True, False) for x in (True, False)])
def test_proximity_against_all_pairs(spark, relation, ordered, exclusion):
    import random

    rng = random.Random(relation * 4 + ordered * 2 + exclusion)
    units = {u: ([rng.randrange(12) for _ in range(rng.randint(0, 3))], [rng.randrange(12) for _ in range(rng.randint(1, 3))]) for u in range(40)}
    make = lambda side: spark.createDataFrame([(0, "d", u, 0, 0, p, side) for u, both in units.items() for p in both[side]], "static_rank long, db string, sysno long, section_id long, segment long, seqno long, term_id int")
    n = rng.choice([0, 1, 3])
    test = {1: lambda d: d < n, 2: lambda d: d <= n, 3: lambda d: d == n, 4: lambda d: d >= n, 5: lambda d: d > n, 6: lambda d: d != n}[relation]
    want = {u for u, (a, b) in units.items() if any((not ordered or r > x) and test(r - x if ordered else abs(r - x)) != exclusion for x in a for r in b)}
    assert {r[0] for r in combine.near(make(0), make(1), n, ordered, relation, exclusion).select("sysno").collect()} == want


def test_regular_expressions_with_errors_and_classes(index):
    s = Session(index)
    assert ids(s, '@attr 5=103 "mo+m|hlil"') == [2] and ids(s, '@attr 5=103 "+2+h(ii|xx)l"') == [2, 6]
    assert ids(s, r'@attr 5=102 "R\\Dd"') == [0, 2, 6]
    assert folded(r"A\D[B\W]\p{Lu}") == r"a\D[b\W]\p{Lu}"
    for bad in ("(", "[", "*a"):
        with pytest.raises(Diagnostic) as e:
            s.search(f'@attr 5=102 "{bad}"')
        assert e.value.code == 120


def test_character_maps_in_indexing_and_queries(spark):
    cm = Charmap.parse("lowercase {0-9}{a-z}åø\nuppercase {0-9}{A-Z}ÅØ\nspace {\\x01-\\x20},\nmap (ph) f\nmap (^the ) \nequivalent aå")
    types = {**FIELD_TYPES, "w": FieldType("w", first_in_field=True, charmap=cm), "s": FieldType("s", complete=True, sort=True, charmap=cm), "strict": FieldType("strict", charmap=Charmap(strict=True))}
    docs = frame(spark, ["The Phone, Åse", "phase ase the", "øl", "zoo", "é"])
    idx = ix.build(docs, [ix.Field("text", (("any", "w"), ("any", "strict"), ("t", "s")))], types=types)
    s = Session(idx)
    assert ids(s, "PHone") == [0] and ids(s, "ase") == [0, 1] and ids(s, "the") == [1] and ids(s, "@attr 4=strict é") == [4]
    order = [r["sysno"] for r in s.search("@attr 1=_ALLRECORDS @attr 2=103 x").sorted(ranking.SortKey("t")).where("v0 is not null").collect()]
    assert order.index(3) < order.index(2)  # ø comes after z
    assert sorted(r["term"] for r in idx.postings.where("idx_type = 'strict' and sysno = 4").collect()) == ["\ufffd\ufffd"]


def test_collated_terms(spark):
    idx = ix.build(frame(spark, ["Café del Mar", "cafe CAFÉ", "日本 語"]), [ix.Field("text", (("any", "icu"), ("any", "simple")))])
    s = Session(idx)
    assert ids(s, "@attr 4=icu cafe") == [0, 1] and ids(s, "@attr 4=icu @attr 5=1 CAF") == [0, 1] and ids(s, "@attr 4=icu 日本") == [2] and ids(s, "@attr 4=simple cafe") == [1]
    with pytest.raises(Diagnostic) as e:
        s.search("@attr 4=icu @attr 5=104 c?")
    assert e.value.code == 120


def test_long_terms_stay_apart_and_several_sort_values(spark):
    long = "x" * 600
    docs = spark.createDataFrame([(1, long + "a", ["b", "z"], "5"), (2, long + "b", ["c"], "x"), (3, "y", [], None)], "sysno long, text string, names array<string>, rk string")
    idx = ix.build(docs, [ix.Field("text", (("any", "w"),)), ix.Field("names", (("n", "s"),)), ix.Field("rk", (("", "staticrank"),))])
    assert idx.terms("any", "w").count() == 3
    keys = Session(idx).search("@attr 1=_ALLRECORDS @attr 2=103 x")
    by = lambda k: [r["sysno"] for r in keys.sorted(k).collect()]
    assert by(ranking.SortKey("n", True, repeated=True))[0] == 1 and by(ranking.SortKey("n", True))[0] == 2
    assert {r["sysno"]: r["static_rank"] for r in idx.postings.collect()} == {1: 5, 2: 0, 3: 0}


# ---- front ends


def test_cql():
    assert from_cql("dc.title any/relevant \"a b\"").attrs == (("bib-1", 1, "4"), ("bib-1", 4, "105"), ("bib-1", 2, "102"))
    assert from_cql("a prox/distance<3/ordered b") == Prox(Apt("a"), Apt("b"), False, 3, True, 1, True, 2)
    assert from_cql("*fish").attrs == (("bib-1", 5, "2"),) and from_cql("f?s*h") == Apt("f#s?h", (("bib-1", 5, "104"),)) and from_cql('"^fish"').attrs == (("bib-1", 3, "1"), ("bib-1", 6, "1"))
    tree = from_cql("fish sortBy cls/sort.descending")
    assert tree == Bool("or", (Apt("fish"), Apt("0", (("bib-1", 7, "2"), ("bib-1", 1, "cls")))))
    for text, code in (("a and", 10), ("(a", 10), ("a =/odd b", 20), ("a <> b", 117), ("a prox/odd b", 46), ("a sortBy", 10)):
        with pytest.raises(Diagnostic) as e:
            from_cql(text)
        assert e.value.code == code, text


def test_sort_specifications(index):
    assert sort_spec("1=4,4=109 >i cls <") == [ranking.SortKey("title", True, True), ranking.SortKey("cls")]
    assert with_sort_leaves(parse("a"), "cls,,0") == Bool("or", (Apt("a"), Apt("0", (("bib-1", 7, "2"), ("bib-1", 1, "cls")))))
    for bad in ("cls", "cls ?", "1=9999 <"):
        with pytest.raises(Diagnostic):
            sort_spec(bad)
    assert [r["sysno"] for r in Session(index).search("red", sortkeys="cls,,1").sorted().collect()] == [2, 0, 6]


def test_updates_through_a_session(spark, tmp_path):
    s = ix.Store(spark, str(tmp_path))
    build = lambda r: ix.build(r, FIELDS, db=F.col("db"))
    s.write(build(frame(spark).withColumn("db", F.lit("Default"))))
    changes = frame(spark, ["new fish", "x", "y"], 6).withColumn("action", F.element_at(F.array(*map(F.lit, ("update", "insert", "delete"))), (F.col("sysno") - 5).cast("int"))).withColumn("at", F.lit(1))
    session = Session(s, writable=True)
    assert [tuple(r) for r in session.update(changes, build).collect()] == [("k8", "delete", "missing")]
    assert ids(session, "fish") == [0, 1, 6] and ids(session, "x") == [7] and ids(session, "red") == [0, 2]


def test_bytes_and_their_encoding(spark, index, tmp_path):
    assert ids(Session(index, encoding="latin-1"), "größe".encode("latin-1")) == [5]
    with pytest.raises(Diagnostic) as e:
        Session(index).search("größe".encode("latin-1"))
    assert e.value.code == 125
    (tmp_path / "a.txt").write_bytes("größe|b".encode("latin-1"))
    from lexarc.sources import text_records

    assert sorted(r["text"] for r in text_records(spark, str(tmp_path), "|", "ISO-8859-1").collect()) == ["b", "größe"]


# ---- fetching


def test_fetch(index):
    s = Session(index)
    one = lambda q, e, syntax="xml", **k: records.fetch(s.search(q), e, syntax, **k).first()["record"]
    assert one("moon", "p::data") == TEXTS[2] and one("moon", "p::meta::sysno", "sutrs") == "2" and one("moon", "p::meta::sysno") == '<record sysno="2"/>\n'
    assert one("moon", "p::meta", namespace="u") == '<record xmlns="u" sysno="2" base="Default" rank="0" size="23" set="p::meta"/>\n'
    assert one("one", "p::index::any:p") == '<record sysno="1" set="p::index::any:p">\n  <index name="any" type="p" seq="2">One fish two fish</index>\n</record>\n'
    assert one("one", "p::index::cls:s") == '<record sysno="1" set="p::index::cls:s">\n  <index name="cls" type="s">a</index>\n</record>\n'
    assert "<s>moon</s>" in one("moon", "p::snippet") and one("red", "p::facet::any:w:1", "sutrs") == "facet any w\nred 3"
    assert one("red", "p::facet::cls:s:1") == '<record>\n  <facet type="s" index="cls">\n    <term coccur="2" occur="2">b</term>\n  </facet>\n</record>\n'
    for bad in ("p::none", "p::index::none", "p::meta::none", "p::facet"):
        with pytest.raises(Diagnostic) as e:
            one("moon", bad)
        assert e.value.code == 25, bad
    with pytest.raises(Diagnostic) as e:
        one("moon", "F", "pdf")
    assert e.value.code == 238
    assert one("moon", "R") == TEXTS[2] and one("moon", "H").startswith("<!-- Size: 23")


def test_record_syntaxes_and_explain(spark, index):
    rows = spark.createDataFrame([("D", 1, "<b><t>x</t><a>y</a></b>", "tree.xml")], "db string, sysno long, raw string, form string")
    get = lambda e, s: records.rendered(rows, e, s).first()["record"]
    assert get("b/t", "xml") == "<b><t>x</t></b>" and get("F", "soif").startswith("@RECORD") and '"tagValue": "t"' in get("F", "grs-1") and get("F", "text") == "b:\n  t: x\n  a: y" and get("F", "summary") == "{}"
    found = {(r["category"], r["name"]): r["detail"] for r in records.explain(index).collect()}
    assert found["DatabaseInfo", "Default"].startswith("7 records") and ("AttributeDetails", "Default:any:w") in found
    assert [r["sysno"] for r in records.by_record_id(index, "k3", "match_key").collect()] == [3]


def test_scan_display_sections_and_facet_samples(index):
    rows = browse.scan(index, "any", "w", "blue", 1, 3, display=True).collect()
    assert [(r["term"], r["display"]) for r in rows] == [("blue", "blue"), ("fish", "fish"), ("größe", "Größe")]
    got = Session(index).search("red").facets(("any", "w"), n=50, first=1).collect()
    assert {r["term"]: (r["coccur"], r["occur"]) for r in got} == {"red": (1, 3), "fish": (2, 1), "blue": (1, 2)}
    keys = index.postings.sparkSession.createDataFrame([("d", 1, s) for s in range(5)], "db string, sysno long, section_id long")
    assert browse.chunked(keys).count() == 2


# ---- configuration and command line


def test_config(monkeypatch):
    monkeypatch.setenv("HERE", "/x")
    base = Config.parse("rank: rank-2\nregister: ${HERE}/r # c\n")
    own = Config.parse("gils.recordType.sgml: tree.sgml\nmapdb: all a b, one a\nodd: 1", base)
    assert own.get("rank") == "rank-2" and own.get("register") == "/x/r" and own.get("sortmax") == "1000" and own.record_type("f.SGML", "gils") == "tree.sgml" and own.record_type("f.x") == "text"
    assert own.aliases() == {"all": ["a", "b"], "one": ["a"]} and own.unknown() == ["odd"]


def test_command_line(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "ix")
    src.mkdir()
    (src / "a.txt").write_text("alpha beta")
    (src / "b.txt").write_text("beta gamma")

    def run(*args):
        out = io.StringIO()
        code = main(list(args), spark, out)
        return code, out.getvalue().splitlines()

    assert run("-n", "update", root, str(src))[0] == 0 and len(run("search", root, "beta")[1]) == 2
    (src / "a.txt").write_text("delta")
    run("update", root, str(src / "a.txt"))
    assert len(run("search", root, "beta")[1]) == 2  # not committed
    run("commit", root)
    assert len(run("search", root, "beta")[1]) == 1 and len(run("search", root, "delta")[1]) == 1
    assert run("-n", "delete", root, str(src / "a.txt"))[0] == 0 and run("search", root, "delta")[1] == [] and run("-n", "delete", root, str(src / "a.txt"))[0] == 1
    run("compact", root)
    run("clean", root)
    assert any("gamma" in x for x in run("dumpdict", root)[1]) and run("stat", root)[1] and run("dump", root)[1] and all(x.endswith("\t0") for x in run("check", root)[1]) and "dom" in run("filters")[1]
