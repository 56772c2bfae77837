"""Readers, record trees, the document pipeline, MARC formulae, rules, and writers."""

import json

import pytest

from lexarc import sources
from lexarc.index import Index
from lexarc.session import Session
from lexarc.sources import dom, marc_formula, markup, plain, regx, tree
from lexarc.sources.tree import Node

BOOK = "<book id='7'><title>On  Sets</title><author><name>A. B.</name></author><author><name>C</name></author><note/></book>"


def root(text=BOOK):
    return tree.tree(markup.xml_events(text))


def ids(session, query, **kw):
    return sorted(r[0] for r in session.search(query, **kw).keys.select("sysno").distinct().collect())


def test_xml_keeps_comments_instructions_and_names():
    text = "<?xml version='1.0'?><!DOCTYPE r [<!ENTITY e 'ent'>]><u:r xmlns:u='http://x'><!-- c --><?go on?><u:b k='&lt;'>a &amp; &e;</u:b></u:r>"
    assert tree.to_xml(markup.xml_events(text)) == '<r><!-- c --><?go on?><b k="&lt;">a &amp; ent</b></r>'
    assert list(markup.xml_events("<a><b>")) == []
    with pytest.raises(markup.Malformed):
        list(markup.strict_xml_events("<a><b>"))


def test_status_of_records(spark):
    rows = [(1, "<a/>"), (2, "<a>"), (3, " "), (4, None)]
    got = {r["sysno"]: r["status"] for r in markup.read_status(spark.createDataFrame(rows, "sysno long, text string"), "tree.xml").collect()}
    assert got == {1: "OK", 2: "ERROR", 3: "SKIP", 4: "SKIP"}


def test_registry():
    sources.register("mine.own", lambda d: d)
    assert sources.reader("mine.own.rest")[1] == "rest" and "mine.own" in sources.names()
    del sources.READERS["mine.own"]


def test_tree_selection():
    pick = lambda *s, **k: tree.to_xml(tree.events(tree.selected(root(), list(s), **k)))
    assert pick("book/title") == '<book id="7"><title>On  Sets</title></book>'
    assert pick("book/author{2}") == '<book id="7"><author><name>C</name></author></book>'
    assert pick("*/*/name{1,1}") == '<book id="7"><author><name>A. B.</name></author></book>'
    assert pick("!book/author", "!book/note") == '<book id="7"><title>On  Sets</title></book>'
    assert pick("book[@id=7]/(1,9)", tags={(1, "9"): "title"}, most_bytes=2) == '<book id="7"><title>On</title></book>'
    assert pick("book[@id=8]") == pick("book[@id=8]/title") == ""
    assert pick("book/title", no_data=True) == '<book id="7"><title></title></book>'
    with pytest.raises(tree.ElementError):
        pick("book/author{last}")


def test_tree_helpers_and_expressions():
    r = root()
    assert r.first("book/title") == "On  Sets" and r.count("book/author") == 2 and r.first("none", "d") == "d"
    book = r.find("book")[0]
    ask = lambda e, n=book: tree.expression(e)(n)
    assert ask("attr(id)") == "7" and ask("tag") == "book" and ask("range(data, 0, 2)") == "On" and ask("first(data, 'C', 'B.')") == "B.C" and ask("'x'") == "x"
    for bad in ("attr(", "none(data)", "range(data)", "data data"):
        with pytest.raises((ValueError, IndexError)):
            tree.expression(bad)
    full = tree.with_system_tags(r, 10, 2, 5)
    assert full.first("book/size") == "10" and full.first("book/sysno") == "5"
    assert tree.without(r, "author").count("book/author") == 0
    assert tree.chopped(r).first("book/title") == "On Sets"


def test_schema_mapping():
    rules = tree.map_rules("map title head/name\nmap name people/person:new # each\nmap note mark nodata\n")
    out = tree.to_xml(tree.events(tree.remapped(root(), rules)))
    assert out == "<record><head><name>On Sets</name></head><people><person>A. B.</person><person>C</person></people><mark></mark></record>"


def test_writers():
    r = root()
    assert "book-title{7}:\tOn Sets" in tree.to_soif(r) and tree.to_soif(r).endswith("}\n")
    assert tree.to_summary(r) == {"title": "On Sets", "author": "A. B."}
    nested = tree.to_nested(r.find("book")[0], {"title": (1, "4")})
    assert nested["content"][0] == {"tagType": 1, "tagValue": "4", "content": "On Sets"} and json.dumps(nested)
    assert markup.to_text(markup.xml_events("<a><!-- no --><b>t</b></a>")) == "a:\n  b: t"


MARC = [("001", "", [("", "id7")]), ("710", "00", [("a", "Corp"), ("g", "Sub"), ("c", "City"), ("b", "One"), ("c", "X"), ("b", "Two")]), ("463", "  ", [("1", "70011$aBrown$gJo$cSir")])]


def test_marc_shapes_and_files(spark, tmp_path):
    raw = markup.to_marc(MARC)
    assert markup.to_marc(MARC) == markup.marc_of_tree(tree.tree(markup.marc_events(raw.decode()))) == markup.marc_of_tree(tree.tree(markup.marcxml_events(raw.decode())))
    assert '<controlfield tag="001">id7</controlfield>' in tree.to_xml(markup.marcxml_events(raw.decode()))
    (tmp_path / "a.mrc").write_bytes(raw * 3)
    rows = markup.marc_files(spark, str(tmp_path)).orderBy("part").collect()
    assert [r["part"] for r in rows] == [0, 1, 2] and {r["text"] for r in rows} == {raw.decode()}


@pytest.mark.parametrize("events", [markup.marc_events, markup.marcxml_events])
def test_marc_formulae(events):
    record = tree.tree(events(markup.to_marc(MARC).decode()))
    ask = lambda f: marc_formula.values(f, record)
    assert ask("mc-71.00_$a,_$g_(_$c_){.$b_(_$c_)}") == ["Corp, Sub ( City ).One ( X ).Two"]
    assert ask("mc-7..__$a") == [] and ask("mc-71.0._$x") == []
    assert ask("mc-001[0-1]") == ["id"] and ask("mc-ldr[6]") == ["a"]
    assert ask("mc-4.._._$1<70.11$a,_$g_(_$c_)>_") == ["Brown, Jo ( Sir )"]
    assert ask("mc-71.00_$a[0-1]") == ["Co"]
    for bad in ("mc-7", "mc-71.00_($a", "mc-463__$1<70.11$a"):
        with pytest.raises(ValueError):
            marc_formula.parse(bad)


RULES = r"""
# mail
BEGIN /^From .*$/ { begin record mail; begin context headers }
/^From .*$/ { unread 0; end record }
CONTEXT {headers}
/^[A-Z][A-Za-z-]*/ /: / { end element -record; begin element $0 }
/\n\n/ { end context; end element -record; begin element body }
/\n[ \t]+/ { data " " }
/\n/ {}
END { end record }
"""


def test_rule_reader(spark):
    text = "From x\nSubject: a\n  long one\nTo: b\n\nhello\nthere\n"
    (record,) = regx.records(text, regx.parse(RULES))
    assert tree.to_xml(tree.events(record)) == "<mail><Subject>a long one</Subject><To>b</To><body>hello\nthere\n</body></mail>"
    spec = regx.parse('/<(\\w+)>/ BODY /;/ { begin record r; begin element $0; data -attribute k "v"; data $1; end record }')
    got = [tree.to_xml(tree.events(r)) for r in regx.records("<a>one;junk<b>two;", spec)]
    assert got == ['<r><&lt;a&gt; k="v">one</&lt;a&gt;></r>'.replace("&lt;", "<").replace("&gt;", ">"), '<r><<b> k="v">two</<b>></r>']
    rows = regx.rule_records(spark.createDataFrame([("f", text), ("g", None)], "filename string, text string"), RULES).collect()
    assert [(r["filename"], r["part"]) for r in rows] == [("f", 0)]
    with pytest.raises(ValueError):
        regx.parse("/a/ { begin record")


COLLECTION = """<c><rec nr="1" kind="insert"><t lang="en">Computer sets</t><who><n>Leary</n><n>Ian</n></who></rec>
<rec nr="2" kind="delete"><t>Computer two</t></rec><rec nr="3"><t>Other</t><who><n>Ian</n></who><who><n>Leary</n></who></rec></c>"""


def test_document_pipeline(spark):
    files = spark.createDataFrame([("a.xml", COLLECTION), ("b.xml", "<open>")], "filename string, text string")
    rows = dom.dom_records(files, level=1).collect()
    assert [r["status"] for r in rows if r["filename"] == "a.xml"] == ["OK"] * 3 and [r["status"][:5] for r in rows if r["filename"] == "b.xml"] == ["ERROR"]
    records = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(r for r in rows if r["text"])], "sysno long, text string")
    rules = dom.Rules({"t/rec/": "title:w title:s any:w", "n/who/rec/": "name:w any:w"}, {"who/rec/": "element"}, {"id": "rec/@nr", "type": "rec/@kind"})
    control = [tuple(r) for r in dom.dom_control(records, rules).orderBy("sysno").collect()]
    assert control == [(0, "1", 0, "insert", "OK"), (1, "2", 0, "delete", "OK"), (2, "3", 0, "update", "OK")]
    s = Session(Index(records, dom.dom_postings(records, rules), dom.dom_sortkeys(records, rules)))
    assert ids(s, "@attr 1=title computer") == [0] and ids(s, "@attr 1=any ian") == [0, 2]
    assert ids(s, "@and @attr 1=name leary @attr 1=name ian") == [0, 2] and ids(s, "@prox 0 0 0 0 k 8 @attr 1=name leary @attr 1=name ian") == [0]
    assert [r["sysno"] for r in s.search("ian").sorted("title >").collect()] == [2, 0]


def test_marks_in_the_record_itself(spark):
    one = '<z:record xmlns:z="http://x-2.0" id="k" rank="4"><z:index name="title:w any:w">a b</z:index><z:index name="title:w">c</z:index></z:record>'
    pi = "<r><?x-2.0 record id=p rank=2?><f><?x-2.0 index title:w?>d e</f></r>"
    h = dom.harvest(tree.tree(markup.xml_events(one)))
    assert (h.record_id, h.rank, h.seen) == ("k", 4, True)
    at = {(n, t): p for _, n, t, p in h.tokens}
    assert at["title", "a"] == at["any", "a"] == 2 and at["title", "c"] == 5
    rows = spark.createDataFrame([(1, one), (2, pi), (3, "<r><f>no mark</f></r>"), (4, "<z:record xmlns:z='u-2.0' type='odd'/>"), (5, None)], "sysno long, text string")
    got = {r["sysno"]: (r["match_key"], r["static_rank"], r["status"][:5]) for r in dom.dom_control(rows).collect()}
    assert got == {1: ("k", 4, "OK"), 2: ("p", 2, "OK"), 3: (None, 0, "SKIP"), 4: (None, 0, "ERROR"), 5: (None, 0, "SKIP")}
    s = Session(Index(rows, dom.dom_postings(rows), None))
    assert ids(s, "@attr 1=title d") == [2] and ids(s, '@attr 1=title "a b"') == [1]
    frame = spark.createDataFrame([("D", 1, "<r><t>x</t></r>", "f.xml", 7)], "db string, sysno long, raw string, filename string, score int")
    assert dom.retrieved(frame, {"brief": {"title": "r/t", "file": "$filename", "score": "$score", "size": "$size"}}, "brief").first()["record"] == "<brief><title>x</title><file>f.xml</file><score>7</score><size>15</size></brief>"


def test_rules_with_attribute_tests(spark):
    docs = spark.createDataFrame([(1, "<r><a k='1'>x</a><a k='2'>y</a><a m='3'>z</a></r>")], "sysno long, text string")
    postings = markup.tree_postings(docs, {r"a/r/[@k='1' or @m]": "good:w"}, "xml")
    assert sorted(r["term"] for r in postings.where("idx_name = 'good' and term not like '\x01%'").collect()) == ["x", "z"]


def test_pretokenised_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("key one\n0 0 0 1 any alpha\n0 0 0 2 any beta\n")
    (tmp_path / "b.txt").write_text("key two\n0 0 0 1 any alpha\n9 0 0 1 any gamma\n")
    got = sorted((r["sysno"], r["term"]) for r in plain.pretokenised(spark, str(tmp_path), first_sysno=5).collect())
    assert got == [(5, "alpha"), (5, "beta"), (6, "alpha"), (9, "gamma")]
    assert sorted((r["sysno"], r["match_key"]) for r in plain.pretokenised_keys(spark, str(tmp_path), 5).collect()) == [(5, "key one"), (6, "key two")]
    frame = spark.createDataFrame([("x/a.SGML",), ("b.txt",)], "path string")
    assert [r[0] for r in frame.select(plain.record_type(frame["path"], {"sgml": "tree.sgml"})).collect()] == ["tree.sgml", "text"]


def test_tree_root_has_no_tag():
    assert Node("").value() == "" and tree.to_xml(tree.events(root("<a/>"))) == "<a></a>"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_of_a_small_file_are_dealt_out(spark, tmp_path):
    """A file of many records is one split; parsing must not be one task's work."""
    rows = spark.range(300).selectExpr("id as sysno", "concat('<part id=\"', id, '\"><name>ring</name></part>') as text")
    rows.coalesce(1).write.parquet(str(tmp_path / "x"))
    one = spark.read.parquet(str(tmp_path / "x"))
    assert one.rdd.getNumPartitions() == 1
    rules = dom.Rules({"name/part/": "title:w title:s"}, {}, {"id": "part/@id"})
    for made in (dom.dom_control(one, rules), dom.dom_postings(one, rules), markup.xml_nodes(one), markup.read_status(one, "tree.xml")):
        assert made.select("sysno").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).filter(lambda n: n > 0).count() > 3
    assert dom.dom_control(one, rules).where("match_key = cast(sysno as string)").count() == 300


def test_a_search_parses_no_record_again(spark):
    from lexarc import workload_records as own

    sf = "/root/testdata/sf0.001"
    for make, query in ((own._dom, "@prox 0 0 0 0 k 8 @attr 1=kind economy @attr 1=kind 11"), (own._session({}), "@attr \"1=/part[@brand='Brand#2']/name\" ring")):
        assert "MapInPandas" not in _plan(make(spark, sf).search(query).keys)
    assert "MapInPandas" not in _plan(own._dom(spark, sf).search("@attr 1=kind 11").sorted("title >"))


def test_dom_index_equals_its_parts(spark):
    rows = spark.createDataFrame([(1, "<r><t>b a</t></r>"), (2, "<r><t>c</t><t>d</t></r>"), (3, None), (4, "<r>")], "sysno long, text string")
    rules = dom.Rules({"t/r/": "t:w t:s"})
    whole, key = dom.dom_index(rows, rules), lambda df: sorted(map(str, df.collect()))
    assert key(whole.postings) == key(dom.dom_postings(rows, rules)) and whole.postings.count() > 0
    assert key(whole.sortkeys) == key(dom.dom_sortkeys(rows, rules)) and whole.sortkeys.count() == 2
