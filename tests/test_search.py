import pytest

from lexarc.functions.analysis import Charmap, query_terms, terms, FIELD_TYPES
from lexarc.functions.xpath import region, steps
from lexarc.index import Field, build
from lexarc.operators import browse, ranking
from lexarc.plans.cql import from_cql
from lexarc.plans.prefix import Apt, Bool, Diagnostic, Prox, parse
from lexarc.session import Session
from lexarc.sources.markup import tree_postings
from lexarc.sources.plain import pretokenised_lines

TEXTS = ["Red fish, blue fish", "One fish two fish", "blue moon over red hill", "", None, "Straße und Größe", "over the hill: red red red"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, t, ["b", "a", None][i % 3], str(10 * i)) for i, t in enumerate(TEXTS)]
    return build(spark.createDataFrame(rows, "sysno long, text string, cls string, cost string"), [Field("text", (("any", "w"), ("any", "p"))), Field("cost", (("cost", "n"), ("cost", "s"))), Field("cls", (("cls", "s"),))])


def ids(session, query, **kw):
    return sorted(r[0] for r in session.search(query, **kw).keys.select("sysno").distinct().collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("fish", [0, 1]),
        ("FISH", [0, 1]),
        ("@and red blue", [0, 2]),
        ("@or moon two", [1, 2]),
        ("@not red blue", [6]),
        ('"blue fish"', [0]),
        ('"fish blue"', [0]),
        ("@attr 5=1 hil", [2, 6]),
        ("@attr 5=2 oon", [2]),
        ("@attr 5=3 lu", [0, 2]),
        ("@attr 5=101 b#e", [0, 2]),
        ('@attr 5=102 "re.|two"', [0, 1, 2, 6]),
        ("@attr 5=103 mon", [2]),
        ('@attr 5=103 "+2+hiyy"', [2, 6]),
        ('@attr 5=104 "?1un#"', [5]),
        ('@attr 5=106 "mo!n"', [2]),
        ("@attr 2=5 two", [5]),
        ("@attr 3=1 red", [0]),
        ('@attr 3=1 "over the"', [6]),
        ("@attr 6=3 \"red fish blue fish\"", [0]),
        ("@attr 6=3 \"red fish\"", []),
        ('@attr 4=6 "hill red"', [2, 6]),
        ('@attr 4=105 "moon two"', [1, 2]),
        ("@attr 4=107 6", [6]),
        ("@attr 2=103 x", [0, 1, 2, 5, 6]),
        ("@attr 1=cost @attr 4=109 @attr 2=5 20", [3, 4, 5, 6]),
        ("@prox 0 2 1 2 k 2 red fish", [0]),
        ("@prox 0 3 1 3 k 2 red fish", [0]),
        ("@prox 0 1 0 3 k 2 hill red", [2, 6]),
        ("@prox 1 1 0 3 k 2 hill red", [6]),
        ("größe", [5]),
        ("@attr 1=1016 moon", [2]),
    ],
)
def test_queries(index, query, want):
    assert ids(Session(index), query) == want


def test_diagnostics(index):
    s = Session(index)
    for query, code in (("@attr 1=9999 x", 114), ("@attr nope 1=4 x", 121), ("@attr 2=6 x", 117), ("@attr 5=7 x", 120), ("@set none", 30), ("@and a", 10), ("x" * 600, 11), ("@prox 0 1 1 1 k 1 a b", 132), ("@attr 5=102 \"(\"", 120)):
        with pytest.raises(Diagnostic) as e:
            s.search(query)
        assert e.value.code == code, query
    with pytest.raises(Diagnostic) as e:
        Session(index, ["missing"])
    assert e.value.code == 109
    with pytest.raises(Diagnostic):
        s.search("fish").page(2, 5)
    assert ids(s, "@attr 1=3 @attr 14=1 x") == []


def test_sets_and_pages(index):
    s = Session(index)
    s.search("red", "r")
    assert ids(s, "@and @set r blue") == [0, 2]
    assert [r["sysno"] for r in s.search("red").page(2, 2).collect()] == [2, 6]
    s.delete_set("r")
    with pytest.raises(Diagnostic):
        s.search("@set r")


def test_set_algebra(index):
    s = Session(index)
    a, b = set(ids(s, "red")), set(ids(s, "hill"))
    assert set(ids(s, "@and red hill")) == a & b and set(ids(s, "@or red hill")) == a | b and set(ids(s, "@not red hill")) == a - b
    assert set(ids(s, '"red hill"')) <= a & b


def test_sorting(index):
    s = Session(index)
    order = [r["sysno"] for r in s.search("@attr 2=103 x").sorted(ranking.SortKey("cls")).collect()]
    assert order == [2, 5, 1, 0, 6]
    order = [r["sysno"] for r in s.search("@or @attr 2=103 x @attr 7=2 @attr 1=cost @attr 4=109 0").sorted().collect()]
    assert order == [6, 5, 2, 1, 0]


def test_rank(index):
    """By hand: red has 1 + 1 + 3 = 5 keys in the index, so 32 - 2; record 6 has 3, the last at position 7."""
    got = {r["sysno"]: r["score"] for r in Session(index).search("@attr 2=102 red").scored().collect()}
    assert got[6] == min(1000, (8 + 1) * 30 * 34 // (8 + 2))
    assert got[0] == min(1000, 8 * 30 * 34 // (8 + 1))


def test_scan_facets_snippets(index):
    s = Session(index)
    rows = s.scan("fish", 2, 3).collect()
    assert [(r["entry"], r["term"], r["docs"]) for r in rows] == [(1, "blue", 2), (2, "fish", 2), (3, "größe", 1)]
    top = s.search("red").facets(("any", "w"), n=2).collect()
    assert [(r["term"], r["occur"], r["coccur"]) for r in sorted(top, key=lambda r: r["place"])] == [("red", 3, 5), ("blue", 2, 2)]
    got = {r["sysno"]: r["snippet"] for r in s.search("moon").snippets().collect()}
    assert got == {2: "blue {moon} over red hill"}
    best = browse.best_window(s.search("red").keys, 2).where("sysno = 6").first()
    assert best["n"] == 2
    assert [r["term"] for r in browse.sort_facets(index, s.search("red").keys, "cls").collect()] == ["b"]


def test_parser():
    assert parse("@and a @and b c") == Bool("and", (Apt("a"), Apt("b"), Apt("c")))
    assert parse("@attr 1=4 @or a b") == Bool("or", (Apt("a", (("bib-1", 1, "4"),)), Apt("b", (("bib-1", 1, "4"),))))
    assert isinstance(parse("@prox 0 1 1 2 k 2 a b"), Prox)
    assert from_cql("title = a and b or c") == Bool("or", (Bool("and", (Apt("a", (("bib-1", 1, "title"),)), Apt("b"))), Apt("c")))
    for bad in ("", "@and a", "a b", "@attr x y", "(a"):
        with pytest.raises(Diagnostic):
            parse(bad) if bad != "(a" else from_cql(bad)


def test_charmap(spark):
    cm = Charmap.parse("lowercase {0-9}{a-z}æøå\nuppercase {0-9}{A-Z}ÆØÅ\nspace {\\x01-\\x20}!,.\nmap (ph) f\nequivalent aå\ncut |")
    from dataclasses import replace
    from pyspark.sql import functions as F

    kind = replace(FIELD_TYPES["w"], charmap=cm)
    row = spark.createDataFrame([("The|Phone, ÆBLE",)], "t string").select(terms(F.col("t"), kind).alias("w"), cm.collated(F.lit("øz")).alias("o"), cm.collated(F.lit("zø")).alias("p")).first()
    assert row["w"] == ["fone", "æble"]
    assert row["o"] > row["p"]
    assert cm.alternatives("ab") == "[aå]b"
    assert query_terms("a b", FIELD_TYPES["0"]) == ["a b"]


def test_xpath(spark):
    docs = ["<r><t lang='en'>foo bar</t><t>baz</t></r>", "<r><x>foo</x><t lang='de'>baz foo</t></r>", "not markup"]
    postings = tree_postings(spark.createDataFrame(list(enumerate(docs)), "sysno long, text string"), {r"t/r/": "title:w any:w", r".*": "any:w"})
    from lexarc.index import Index

    s = Session(Index(None, postings, None))
    assert ids(s, "@attr 1=/r/t foo") == [0, 1]
    assert ids(s, "@attr 1=/r/x foo") == [1]
    assert ids(s, "@attr 1=//t baz") == [0, 1]
    assert ids(s, "@attr \"1=/r/t[@lang='de']\" foo") == [1]
    assert ids(s, "@attr \"1=/r/t[@lang='en']\" baz") == []
    assert ids(s, "@attr 1=/r/x @attr 2=103 y") == [1]
    assert ids(s, "@attr 1=/r/t/@lang en") == [0]
    assert ids(s, "@attr 1=title foo") == [0, 1]
    assert region(steps("/a//b"))[0] == r"^b/(?:[^/]+/)*a/$"


def test_segments_and_sections(spark):
    lines = ["id1", "1 0 1 1 any alpha", "1 0 1 2 any beta", "1 0 2 3 any gamma", "2 1 0 1 any alpha", "2 2 0 1 any beta", "w 3 0 0 1 any beta"]
    postings = pretokenised_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    from lexarc.index import Index

    s = Session(Index(None, postings, None))
    assert ids(s, "@and alpha beta") == [1]
    assert ids(s, "@and alpha gamma") == []
    assert ids(s, "beta") == [1, 2, 3]
    assert ids(Session(Index(None, postings, None), sections=(False, [2])), "beta") == [2]


def test_units(spark):
    rows = [("_GROUP_element", "begin", 1), ("any", "a", 2), ("any", "b", 3), ("_GROUP_element", "end", 4), ("_GROUP_element", "begin", 5), ("any", "c", 6), ("_GROUP_element", "end", 7)]
    frame = spark.createDataFrame([("D", "index", "w", n, t, 0, 1, 0, 0, p) for n, t, p in rows], "db string, cat string, idx_type string, idx_name string, term string, static_rank long, sysno long, section_id long, segment long, seqno long")
    from lexarc.index import Index

    s = Session(Index(None, frame, None))
    assert ids(s, "@prox 0 1 0 2 k 8 a b") == [1]
    assert ids(s, "@prox 0 1 0 2 k 8 a c") == []
    assert ranking.rounded_hits(123456) == 123000
