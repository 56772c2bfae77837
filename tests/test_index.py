import os

import pytest
from pyspark.sql import functions as F

from lexarc import index as ix
from lexarc.sources import mail, reader, text_records
from lexarc.sources.markup import elements, marc_events, marc_nodes, marc_split, sgml_events, sgml_nodes, to_marc, to_text, to_xml, xml_nodes
from lexarc.streaming.ingest import ingest


def built(records):
    return ix.build(records, [ix.Field("text", (("any", "w"),))])


def test_versions(spark, tmp_path):
    store = ix.Store(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.read()
    store.write(built(spark.createDataFrame([(1, "a b")], "sysno long, text string")))
    old = store.read()
    store.write(built(spark.createDataFrame([(1, "a b"), (2, "c")], "sysno long, text string")), shadow=True)
    assert store.read().records.count() == 1
    store.commit()
    assert store.read().records.count() == 2 and old.records.count() == 1
    store.write(built(spark.createDataFrame([(3, "c")], "sysno long, text string")), shadow=True)
    store.clean()
    assert store.read().records.count() == 2
    assert not [r for r in ix.check(store.read()).collect() if r["n"]]


def test_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "match_key string, v int")
    new = spark.createDataFrame([("a", 5, "insert", 1), ("b", 6, "replace", 1), ("c", 7, "update", 1), ("d", 8, "delete", 1), ("e", 9, "adelete", 1), ("c", 8, "update", 2)], "match_key string, v int, action string, at int")
    records, errors = ix.apply_changes(old, new)
    assert sorted(map(tuple, records.collect())) == [("a", 1), ("b", 6), ("c", 8)]
    assert sorted((r[0], r[2]) for r in errors.collect()) == [("a", "exists"), ("d", "missing")]


def test_stream(spark, tmp_path):
    schema = "match_key string, sysno long, text string, action string, at int"
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x y", "insert", 1), ("b", 2, "z", "insert", 1)], schema).write.json(str(src))
    store = ix.Store(spark, str(tmp_path / "store"))
    empty = spark.createDataFrame([], "match_key string, sysno long, text string")
    ingest(spark.readStream.schema(schema).json(str(src)), store, built, str(tmp_path / "cp"), empty).awaitTermination()
    assert store.read().terms("any", "w").count() == 3


def test_markup(spark):
    assert to_xml(sgml_events("<a x=1><b>t&amp;u<c>v</a>")) == '<a x="1"><b>t&amp;u<c>v</c></b></a>'
    assert to_text(sgml_events("<a><b>t</b></a>")) == "a:\n  b: t"
    rows = sgml_nodes(spark.createDataFrame([(1, "<a><b>t</b></a>"), (2, None)], "sysno long, text string")).collect()
    assert [(r["path"], r["text"]) for r in rows] == [("a/", None), ("b/a/", None), ("b/a/", "t")]
    assert xml_nodes(spark.createDataFrame([(1, "<a><b>")], "sysno long, text string")).count() == 0
    nodes = sgml_nodes(spark.createDataFrame([(1, "<a><b>t</b><c>u</c></a>")], "sysno long, text string"))
    assert [r["text"] for r in elements(nodes, ["a/"], ["c/"]).collect()] == ["t"]


def test_marc(spark):
    raw = to_marc([("001", "", [("", "id7")]), ("245", "10", [("a", "Title"), ("c", "By")])])
    assert int(raw[:5]) == len(raw) and marc_split(raw + raw) == [raw, raw]
    got = list(marc_events(raw.decode()))
    assert ("text", "id7", None) in got and ("start", "245", {"ind1": "1", "ind2": "0"}) in got and ("text", "Title", None) in got
    assert marc_nodes(spark.createDataFrame([(1, raw.decode()), (2, "junk")], "sysno long, text string")).where("path = 'a/245/record/' and text is not null").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("one\ntwo")
    (tmp_path / "d/e.txt").write_text("")
    assert [r["text"] for r in text_records(spark, str(tmp_path / "d")).collect()] == ["one\ntwo"]
    assert sorted(r["text"] for r in text_records(spark, str(tmp_path / "d"), "\n").collect()) == ["one", "two"]
    (tmp_path / "m.mbx").write_text("From x\nFrom: A\nSubject: hi\n\nbody\nFrom y\nFrom: B\n\nmore\n")
    assert [(r["sender"], r["subject"]) for r in mail(spark, str(tmp_path / "m.mbx")).orderBy("part").collect()] == [("A", "hi"), ("B", None)]
    assert reader("tree.sgml.usual")[1] == "usual"
    with pytest.raises(KeyError):
        reader("none")


def test_queries_match_duckdb(spark):
    """Every registered search query equals its SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from lexarc import workload

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    for name in ("term_search", "prox_exclusion", "prox_far", "rank1", "scan_terms", "facet_terms", "snippet_window", "between_region", "upsert_records", "register_check"):
        df = workload.QUERIES[name](spark, d)
        cur = con.execute(workload.ORACLE[name])
        cols = [c[0] for c in cur.description]
        assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall())), name


def test_a_record_lies_in_one_file(spark, tmp_path, monkeypatch):
    """Several partitions, sections, databases and repeated numbers: the stored postings, terms and catalog are those of the plain index."""
    monkeypatch.setattr(ix, "TASK_ROWS", 20)
    rows = spark.createDataFrame([(i % 70, i // 70, f"Same w{i % 7} w{i % 7} {'' if i % 5 else 'odd'}", f"k{i % 3}") for i in range(200)], "id long, part int, text string, kind string")
    one = ix.build(rows, [ix.Field("text", (("any", "w"),))], sysno="id", section="part")
    two = ix.build(rows, [ix.Field("text", (("any", "w"), ("any", "p"))), ix.Field("kind", (("kind", "0"),))], db="other", sysno="id")
    counted = lambda df: sorted(map(tuple, df.collect()), key=str)
    for n, plain in enumerate((one, two, ix.joined_indexes(one, two))):
        store = ix.Store(spark, str(tmp_path / str(n)))
        store.write(plain)
        now = store.read()
        assert counted(now.postings.select(*ix.POSTING)) == counted(plain.postings.select(*ix.POSTING))
        keys = ["db", "idx_type", "idx_name", "term", "docs", "occurrences"]
        assert counted(now.dictionary().select(*keys)) == counted(plain.dictionary().select(*keys))
        assert counted(now.catalog()) == counted(plain.catalog())
        files = spark.read.parquet(str(tmp_path / str(n) / "v1" / "postings")).groupBy("db", "sysno", "idx_type", "idx_name").agg(F.countDistinct(F.col("_metadata.file_name")).alias("n"))
        assert files.where("n > 1").count() == 0
        assert spark.read.parquet(str(tmp_path / str(n) / "v1" / "postings")).select("_metadata.file_name").distinct().count() > 1


def test_terms_deleted_reads_no_postings(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the theme of"), (2, "of the of"), (3, "thorn")], "id long, text string")
    plain = ix.build(rows, [ix.Field("text", (("any", "w"),))], sysno="id")
    store = ix.Store(spark, str(tmp_path))
    store.write(plain)
    rest = store.read().without_terms("any", "w", "th")
    assert rest.term_table is not None and "postings" not in " ".join(rest.terms("any", "w").inputFiles())
    assert [tuple(r) for r in rest.terms("any", "w").collect()] == [tuple(r) for r in plain.without_terms("any", "w", "th").terms("any", "w").collect()] == [("of", 2, 3)]
    assert sorted(r.term for r in rest.postings.where("term not like '\x01%'").collect()) == ["of", "of", "of"]


def test_key_delta_shuffles_only_what_differs(spark, monkeypatch):
    """Repeated postings, swapped positions, records on one side only and a full bitmap; equal sides shuffle no posting."""
    rows = spark.range(400).selectExpr("id as sysno", "concat_ws(' ', 'the', concat('w', id % 17), concat('w', id % 5), 'of') as text")
    plain = built(rows).postings
    new = plain.unionAll(plain.where("sysno = 7"))
    old = plain.where("sysno % 10 <> 3").withColumn("term", F.when(F.col("term") == "the", "teh").otherwise(F.col("term"))).withColumn("seqno", F.when(F.col("sysno") == 9, 9 - F.col("seqno")).otherwise(F.col("seqno")))
    old = old.unionAll(plain.where("sysno = 8").withColumn("sysno", F.lit(None).cast("long")))
    from collections import Counter

    want = Counter(map(tuple, new.select(*ix.POSTING).collect()))
    want.subtract(Counter(map(tuple, old.select(*ix.POSTING).collect())))
    for bits in (ix.DELTA_BITS, 64):
        monkeypatch.setattr(ix, "DELTA_BITS", bits)
        got = {tuple(r)[:-1]: r["step"] for r in ix.key_delta(old, new).collect()}
        assert got == {k: n for k, n in want.items() if n}
    monkeypatch.undo()
    same = ix.key_delta(plain, built(rows).postings)
    assert same.count() == 0
    assert "_w" in same._jdf.queryExecution().optimizedPlan().toString()


def test_sort_keys_are_written_by_record(spark, tmp_path, monkeypatch):
    """Sections, repeated numbers, arrays, missing values and two fields of one sort index: made with one shuffle, by record, and the same as before storing."""
    monkeypatch.setattr(ix, "TASK_ROWS", 20)
    rows = [(i % 70 if i else None, 9 - i // 70, f"T{i % 7}" if i % 4 else " -", [f"b{i % 3}", "A", None] if i % 5 else None, f"k{i % 2}") for i in range(200)]
    records = spark.createDataFrame(rows, "id long, part int, title string, many array<string>, kind string")
    fields = [ix.Field("title", (("title", "w"), ("title", "s"))), ix.Field("many", (("many", "s"),)), ix.Field("kind", (("title", "s"), ("kind", "s")))]
    plain = ix.build(records, fields, sysno="id", section="part")
    want = {}
    for n, part, title, many, kind in rows:
        for name, values in (("title", [title.lower()] if title != " -" else []), ("title", [kind]), ("many", [x.lower() for x in many or [] if x]), ("kind", [kind])):
            if values:
                want.setdefault((name, n), []).append((part, values))
    want = {k: [x for _, values in sorted(v) for x in values] for k, v in want.items()}
    store = ix.Store(spark, str(tmp_path))
    store.write(plain)
    for keys in (plain.sortkeys, store.read().sortkeys):
        got = [((r["idx_name"], r["sysno"]), r["values"]) for r in keys.collect()]
        assert dict(got) == want and len(got) == len(want)
    plan = plain.keys_by_record(5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" not in plan
    files = spark.read.parquet(str(tmp_path / "v1" / "sortkeys")).groupBy("sysno", "idx_name").agg(F.countDistinct(F.col("_metadata.file_name")).alias("n"))
    assert files.where("n > 1").count() == 0


def test_a_text_is_analysed_once(spark):
    two = ix.build(spark.createDataFrame([(1, "a b", "c")], "sysno long, text string, more string"), [ix.Field("text", (("any", "w"), ("any", "n"))), ix.Field("more", (("more", "w"),))])
    for made in (two.postings, two.by_record(3)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 3
    assert sorted((r["idx_name"], r["idx_type"], r["term"], r["seqno"]) for r in two.postings.collect()) == [("any", "w", "\x01^", 1), ("any", "w", "a", 2), ("any", "w", "b", 3), ("more", "w", "\x01^", 4), ("more", "w", "c", 5)]


def test_facets_and_catalog_of_a_store(spark, tmp_path, monkeypatch):
    """Counts by record without a group for every record and term; layers, where a posting's lead is not kept, count as before."""
    from lexarc.operators import browse

    monkeypatch.setattr(ix, "TASK_ROWS", 20)
    rows = spark.createDataFrame([(i % 70, i // 70, f"the w{i % 3} the w{i % 11}" if i % 9 else None, str(i % 4)) for i in range(200)], "sysno long, part int, text string, size string")
    fields = [ix.Field("text", (("any", "w"), ("any", "p"))), ix.Field("size", (("size", "n"), ("size", "0")))]
    plain = ix.build(rows, fields, section="part")
    hits = plain.postings.where("sysno % 3 = 1")
    own = [("any", "w"), ("any", "p"), ("size", "n")]
    want = sorted(map(tuple, browse.facets(plain, hits, own, 5).collect()))
    store = ix.Store(spark, str(tmp_path))
    store.write(plain)
    now = store.read()
    found = browse.facets(now, hits, own, 5)
    assert sorted(map(tuple, found.collect())) == want and any(r["coccur"] > r["occur"] for r in found.collect())
    groups = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert groups and not any("term" in x and "sysno" in x for x in groups)
    assert sorted(map(tuple, now.catalog().collect())) == sorted(map(tuple, plain.catalog().collect()))
    store.merge(ix.build(rows.where("sysno < 9"), fields, section="part"), rows.where("sysno < 9").selectExpr("'Default' as db", "sysno"))
    assert store.read().led is None and sorted(map(tuple, browse.facets(store.read(), hits, own, 5).collect())) == want
    assert {r["term"] for r in browse.facets(now.without_terms("any", "w", "w"), hits, [("any", "w")], 50).collect()} == {"the"}
