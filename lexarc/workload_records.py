"""Registered queries of readers, record trees, writers and analysers, over records written from the driver's tables."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index as ix
from . import records
from .functions.analysis import FIELD_TYPES, Charmap, FieldType
from .index import Field, Index
from .operators import browse, ranking
from .session import Session
from .sources import dom, marc_formula, markup, plain, regx, tree
from .storage import dealt, kept, numbered
from .workload import _words, conversations, documents, once, parts, register

_KEY = "CAST(p_partkey AS BIGINT) AS sysno"
_ALL = f"SELECT {_KEY} FROM part WHERE "
_HAS = "list_contains(string_split(p_name, ' '), '{}')"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("sysno", F.col("p_partkey").cast("long"))


def xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sysno, text): a part as XML."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    kind = tag("kind", F.concat(tag("type", F.col("p_type")), tag("size", F.col("p_size").cast("string"))))
    text = F.concat(F.lit('<part id="'), F.col("p_partkey").cast("string"), F.lit('" brand="'), F.col("p_brand"), F.lit('">'), tag("name", F.col("p_name")), kind, F.lit("</part>"))
    return _parts(spark, sf_dir).select("sysno", text.alias("text"))


_XML = """'<part id="' || p_partkey || '" brand="' || p_brand || '"><name>' || p_name || '</name><kind><type>' || p_type || '</type><size>' || p_size || '</size></kind></part>'"""


def _session(rules: dict[str, str], form: str = "xml"):
    index = once(f"tree-{form}-{rules}", "part")(lambda s, d: Index(None, kept(markup.tree_postings(xml(s, d), rules, form), "tree"), None))
    return lambda s, d: Session(index(s, d))


def _found(make, query: str):
    return lambda s, d: make(s, d).search(query).keys.select("sysno").distinct()


register(
    "xml_nodes",
    lambda s, d: markup.xml_nodes(xml(s, d)).where("tag is not null").groupBy("path", "depth").agg(F.count("*").alias("n")),
    "SELECT path, depth, count(*) AS n FROM part, (VALUES ('part/', 0), ('name/part/', 1), ('kind/part/', 1), ('type/kind/part/', 2), "
    "('size/kind/part/', 2)) v(path, depth) GROUP BY path, depth",
)
register(
    "sgml_nodes",
    lambda s, d: markup.sgml_nodes(xml(s, d).withColumn("text", F.replace("text", F.lit("</type>"), F.lit("")))).where("tag is null").select("sysno", "path", "text"),
    "SELECT CAST(p_partkey AS BIGINT) AS sysno, 'name/part/' AS path, p_name AS text FROM part UNION ALL SELECT p_partkey, 'type/kind/part/', p_type "
    "FROM part UNION ALL SELECT p_partkey, 'size/type/kind/part/', CAST(p_size AS VARCHAR) FROM part",
)
register("xpath_text", _found(_session({}), "@attr 1=/part/name ring"), _ALL + _HAS.format("ring"))
register("xpath_any_depth", _found(_session({}), "@attr 1=//size 11"), _ALL + "p_size = 11")
register("xpath_predicate", _found(_session({}), "@attr \"1=/part[@brand='Brand#2']/name\" ring"), _ALL + _HAS.format("ring") + " AND p_brand = 'Brand#2'")
register("xpath_nested", _found(_session({}), "@attr \"1=/part[@brand='Brand#2']/kind/type\" economy"), _ALL + "p_type = 'ECONOMY' AND p_brand = 'Brand#2'")
register("xpath_exists", _found(_session({}), "@attr \"1=/part[@brand='Brand#2']/name\" @attr 2=103 x"), _ALL + "p_brand = 'Brand#2'")
register("xpath_attribute", _found(_session({}), '@attr 1=/part/@brand "brand 2"'), _ALL + "p_brand = 'Brand#2'")
register(
    "tree_rules",
    _found(_session({"name/part/": "title:w any:w", ".*": "any:w"}), "@or @attr 1=title ring economy"),
    _ALL + _HAS.format("ring") + " OR p_type = 'ECONOMY'",
)
register(
    "tree_rule_tests",
    _found(_session({r"part/[@brand='Brand#2' or @id='1']": "two:w"}), "@attr 1=two @attr 5=1 r"),
    _ALL + "(p_brand = 'Brand#2' OR p_partkey = 1) AND (regexp_matches(p_name, '(^| )r') OR starts_with(lower(p_type), 'r'))",
)


def _broken(spark, d):
    odd = (
        F.when(F.col("sysno") % 7 == 0, F.replace("text", F.lit("</name>"), F.lit("")))
        .when(F.col("sysno") % 11 == 0, F.lit(" "))
        .otherwise(F.col("text"))
    )
    return markup.read_status(xml(spark, d).withColumn("text", odd), "tree.xml").select("sysno", "status")


register(
    "read_status",
    _broken,
    f"SELECT {_KEY}, CASE WHEN p_partkey % 7 = 0 THEN 'ERROR' WHEN p_partkey % 11 = 0 THEN 'SKIP' ELSE 'OK' END AS status FROM part",
)


# ---- writers and projections
def _rendered(elements: str, syntax: str):
    return lambda s, d: records.rendered(xml(s, d).select(F.lit("Default").alias("db"), "sysno", F.col("text").alias("raw"), F.lit("tree.xml").alias("form")), elements, syntax).select("sysno", "record")


register("xml_writer", _rendered("F", "xml"), f"SELECT {_KEY}, {_XML} AS record FROM part")
register(
    "text_writer",
    _rendered("F", "sutrs"),
    f"SELECT {_KEY}, 'part:' || chr(10) || '  name: ' || p_name || chr(10) || '  kind:' || chr(10) || '    type: ' || p_type || chr(10) || '    "
    f"size: ' || p_size AS record FROM part",
)
register(
    "soif_writer",
    _rendered("F", "soif"),
    f"SELECT {_KEY}, '@RECORD {{ -' || chr(10) || 'part-name{{' || strlen(p_name) || '}}:' || chr(9) || p_name || chr(10) || 'part-kind-type{{' || "
    f"strlen(p_type) || '}}:' || chr(9) || p_type || chr(10) || 'part-kind-size{{' || length(CAST(p_size AS VARCHAR)) || '}}:' || chr(9) || p_size "
    f"|| chr(10) || '}}' || chr(10) AS record FROM part",
)
register("summary_writer", _rendered("F", "summary"), f"SELECT {_KEY}, '{{\"author\": \"' || p_name || '\"}}' AS record FROM part")
register(
    "nested_writer",
    _rendered("part/name", "grs-1"),
    f"SELECT {_KEY}, '[{{\"tagType\": 3, \"tagValue\": \"part\", \"content\": [{{\"tagType\": 3, \"tagValue\": \"name\", \"content\": \"' || p_name "
    f"|| '\"}}]}}]' AS record FROM part",
)
register(
    "element_set",
    _rendered("part/kind/size,!part/name", "xml"),
    f"SELECT {_KEY}, replace(regexp_replace({_XML}, '<name>.*</name>', ''), '<type>' || p_type || '</type>', '') AS record FROM part",
)


def _by_tree(name: str, make):
    """A column made from every record's tree."""

    def run(spark, d):
        @F.pandas_udf("string")
        def write(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: make(tree.tree(markup.xml_events(t))))

        return dealt(xml(spark, d)).select("sysno", write("text").alias(name))

    return run


_MAP = tree.map_rules("map name head/title\nmap size sizes/one:new\nmap type flag nodata\n")
register(
    "schema_map",
    _by_tree("record", lambda r: tree.to_xml(tree.events(tree.remapped(r, _MAP)))),
    f"SELECT {_KEY}, '<record><head><title>' || p_name || '</title></head><flag></flag><sizes><one>' || p_size || '</one></sizes></record>' AS "
    f"record FROM part",
)
register(
    "source_expression",
    _by_tree("value", lambda r: "|".join(tree.expression(e)(r.find("part")[0]) for e in ("attr(brand)", "range(data, 0, 3)", "tag", "first(data, 'ring', 'widget')"))),
    f"SELECT {_KEY}, p_brand || '|' || (p_name || p_type || p_size)[1:3] || '|part|' || regexp_extract(p_name || p_type || p_size, "
    f"'((?:ring|widget).*)$', 1) AS value FROM part",
)
register(
    "system_tags",
    _by_tree("value", lambda r: tree.with_system_tags(r, 9, 3, 4).first("part/rank") + str(tree.with_system_tags(r, 9, 3, 4).count("part/*"))),
    f"SELECT {_KEY}, '35' AS value FROM part",
)
register(
    "tag_paths",
    _by_tree("value", lambda r: f"{r.first('part/kind/size')} {r.count('part/*')} {r.count('part/kind/*')}"),
    f"SELECT {_KEY}, p_size || ' 2 2' AS value FROM part",
)


# ---- MARC
def marc(spark, d) -> DataFrame:
    @F.pandas_udf("string")
    def write(key: pd.Series, name: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([markup.to_marc([("001", "", [("", k)]), ("245", "10", [("a", n), ("c", t)])]).decode() for k, n, t in zip(key, name, kind)])

    return dealt(_parts(spark, d)).select("sysno", write(F.col("p_partkey").cast("string"), "p_name", "p_type").alias("text"))


register(
    "marc_nodes",
    lambda s, d: markup.marc_nodes(marc(s, d)).where("path in ('a/245/record/', '001/record/') and text is not null").select("sysno", "path", "text"),
    "SELECT CAST(p_partkey AS BIGINT) AS sysno, 'a/245/record/' AS path, p_name AS text FROM part UNION ALL "
    "SELECT p_partkey, '001/record/', CAST(p_partkey AS VARCHAR) FROM part",
)
register(
    "marcxml_nodes",
    lambda s, d: markup.marcxml_nodes(marc(s, d)).where("tag = 'datafield' or tag = 'subfield'").select("sysno", F.col("attrs")["tag"].alias("field"), F.col("attrs")["code"].alias("code")),
    "SELECT CAST(p_partkey AS BIGINT) AS sysno, '245' AS field, NULL AS code FROM part UNION ALL SELECT p_partkey, NULL, c "
    "FROM part, (VALUES ('a'), ('c')) v(c)",
)


def _formula(spark, d):
    formula = marc_formula.parse("mc-24.10$a_(_$c_){.$x}")

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "|".join(marc_formula.values(formula, tree.tree(markup.marc_events(t)))))

    return marc(spark, d).select("sysno", read("text").alias("value"))


register("marc_formula", _formula, f"SELECT {_KEY}, p_name || ' ( ' || p_type || ' )' AS value FROM part")


# ---- rules and documents
_LINES = '/Name: / BODY /\\n/ { begin record part; begin element name; data $1; end element }\n/Type: / BODY /\\n/ { begin element type; data -attribute kind "t"; data $1; end element }\n/\\n/ { end record }'


def _ruled(spark, d):
    text = F.concat(F.lit("Name: "), F.col("p_name"), F.lit("\nType: "), F.col("p_type"), F.lit("\n\nName: second\n"))
    return (
        regx
        .rule_records(_parts(spark, d).select(F.col("sysno").cast("string").alias("filename"), text.alias("text")), _LINES)
        .select("filename", "part", "text")
    )


register(
    "rule_reader",
    _ruled,
    "SELECT CAST(p_partkey AS VARCHAR) AS filename, CAST(0 AS BIGINT) AS part, '<part><name>' || p_name || '</name><type kind=\"t\">' || p_type || "
    "'</type></part>' AS text FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, '<part><name>second</name></part>' FROM part",
)


def _collection(spark, d):
    whole = (
        xml(spark, d)
        .withColumn("filename", (F.col("sysno") % 50).cast("string"))
        .groupBy("filename")
        .agg(F.concat(F.lit("<c>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sysno", "text"))), lambda x: x["text"]), ""), F.lit("</c>")).alias("text"))
    )
    return dom.dom_records(whole, level=1).select("filename", "part", "text", "status")


register(
    "dom_split",
    _collection,
    f"SELECT CAST(p_partkey % 50 AS VARCHAR) AS filename, CAST(p_partkey // 50 AS BIGINT) AS part, {_XML} AS text, 'OK' AS status FROM part",
)
_RULES = dom.Rules({"name/part/": "title:w title:s any:w", "type/kind/part/": "kind:w any:w", "size/kind/part/": "kind:w"}, {"kind/part/": "element"}, {"id": "part/@id", "rank": "part/kind/size"})
register(
    "dom_control",
    lambda s, d: dom.dom_control(xml(s, d), _RULES).select("sysno", "match_key", "static_rank", "action"),
    f"SELECT {_KEY}, CAST(p_partkey AS VARCHAR) AS match_key, CAST(p_size AS BIGINT) AS static_rank, 'update' AS action FROM part",
)
_dom_index = once("dom", "part")(lambda s, d: dom.dom_index(xml(s, d), _RULES))
_dom = lambda s, d: Session(_dom_index(s, d))
register("dom_index", _found(_dom, "@and @attr 1=title @attr 5=1 r @attr 1=any economy"), _ALL + "regexp_matches(p_name, '(^| )r') AND p_type = 'ECONOMY'")
register("dom_groups", _found(_dom, "@prox 0 0 0 0 k 8 @attr 1=kind economy @attr 1=kind 11"), _ALL + "p_type = 'ECONOMY' AND p_size = 11")
register("dom_apart", _found(_dom, "@prox 0 0 0 0 k 8 @attr 1=title @attr 5=1 r @attr 1=kind economy"), _ALL + "false")
register(
    "dom_sort",
    lambda s, d: _dom(s, d).search("@attr 1=kind 11").sorted("title >").transform(numbered).select("sysno", "position"),
    f"SELECT {_KEY}, row_number() OVER (ORDER BY p_name DESC, p_partkey) AS position FROM part WHERE p_size = 11",
)
register(
    "dom_views",
    lambda s, d: dom.retrieved(xml(s, d).select(F.lit("Default").alias("db"), "sysno", F.col("text").alias("raw")), {"brief": {"title": "part/name", "id": "$sysno"}}, "brief").select("sysno", "record"),
    f"SELECT {_KEY}, '<brief><title>' || p_name || '</title><id>' || p_partkey || '</id></brief>' AS record FROM part",
)

# ---- analysers
_CHARS = Charmap(maps=(("ng", "g"), ("^s", "z")), equivalent=("ei",))
_TYPES = {**FIELD_TYPES, "w": FieldType("w", first_in_field=True, charmap=_CHARS), "s": FieldType("s", complete=True, sort=True, charmap=replace(_CHARS, lower="zyxwvutsrqponmlkjihgfedcba0123456789", upper="ZYXWVUTSRQPONMLKJIHGFEDCBA0123456789"))}


def _mapped(spark, d) -> Index:
    rows = _parts(spark, d).withColumn("both", F.array("p_name", "p_type")).withColumn("size_text", F.col("p_size").cast("string"))
    return ix.build(rows, [Field("p_name", (("any", "w"), ("any", "icu"), ("any", "simple"), ("name", "s"))), Field("both", (("both", "s"),)), Field("size_text", (("", "staticrank"),))], types=_TYPES)


_ask = lambda query: _found(lambda s, d: Session(_mapped(s, d)), query)
register("charmap_map", _ask("RING"), _ALL + _HAS.format("ring") + " OR " + _HAS.format("rig") + " OR " + _HAS.format("reg") + " OR " + _HAS.format("reng"))
register("charmap_anchor", _ask("@attr 5=1 zm"), _ALL + "starts_with(p_name, 'sm')")
register("icu_search", _ask("@attr 4=icu RÎNG"), _ALL + _HAS.format("ring"))
register("simple_chain", _ask("@attr 4=simple ring"), _ALL + _HAS.format("ring"))
register(
    "charmap_sort",
    lambda s, d: Session(_mapped(s, d)).search("@attr 4=simple ring").sorted(ranking.SortKey("name")).transform(numbered).select("sysno", "position"),
    f"SELECT {_KEY}, row_number() OVER (ORDER BY translate(regexp_replace(replace(p_name, 'ng', 'g'), '^s', 'z'), 'zyxwvutsrqponmlkjihgfedcba ', "
    f"'abcdefghijklmnopqrstuvwxyz '), p_size, p_partkey) AS position FROM part WHERE {_HAS.format('ring')}",
)
register(
    "static_rank_order",
    lambda s, d: Session(_mapped(s, d)).search("@attr 4=simple ring").ordered().transform(numbered).select("sysno", "static_rank", "position"),
    f"SELECT {_KEY}, CAST(p_size AS BIGINT) AS static_rank, row_number() OVER (ORDER BY p_size, p_partkey) AS position FROM part "
    f"WHERE {_HAS.format('ring')}",
)
register(
    "sort_repeated",
    lambda s, d: Session(ix.build(_parts(s, d).withColumn("both", F.array(F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))), [Field("p_name", (("any", "w"),)), Field("both", (("both", "s"),))])).search("ring").sorted(ranking.SortKey("both", True, repeated=True)).transform(numbered).select("sysno", "position"),
    f"SELECT {_KEY}, row_number() OVER (ORDER BY greatest(CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR)) DESC, p_partkey) AS position "
    f"FROM part WHERE {_HAS.format('ring')}",
)
register(
    "terms_as_written",
    lambda s, d: parts(s, d).of_records(Session(parts(s, d)).search("@attr 1=size @attr 4=109 11").keys, fold=False).postings.where("idx_name = 'title' and idx_type = 'p' and term not like '\x01%'").select("sysno", "term", "seqno"),
    f"SELECT {_KEY}, p_name AS term, CAST(2 AS BIGINT) AS seqno FROM part WHERE p_size = 11",
)

# ---- sets, facets, catalog
_Q = "@attr 1=size @attr 4=109 @attr 2=4 45"


def _positions(spark, d):
    found = Session(parts(spark, d)).search("@attr 1=size @attr 4=109 @attr 2=4 1").at([7, 1, 3])
    return found.select("position", "sysno")


register(
    "position_list",
    _positions,
    "SELECT row_number() OVER (ORDER BY p_partkey) AS position, CAST(p_partkey AS BIGINT) AS sysno FROM part WHERE p_size >= 1 "
    "QUALIFY position IN (1, 3, 7)",
)
register(
    "hit_limit",
    lambda s, d: Session(parts(s, d), limit=1_000_000).search(_Q).hit_counts(),
    "SELECT count(*) AS hits, false AS approximate FROM part WHERE p_size >= 45",
)
register(
    "facet_sample",
    lambda s, d: Session(parts(s, d)).search(_Q).facets(("title", "w"), n=1000, first=10).select("term", "coccur", "occur"),
    f"WITH h AS (SELECT p_partkey, {_words('p_name')} AS ws, row_number() OVER (ORDER BY p_partkey) AS n FROM part "
    f"WHERE p_size >= 45), t AS (SELECT p_partkey, n, unnest(ws) AS term FROM h) "
    f"SELECT term, count(*) FILTER (n <= 10) AS coccur, count(DISTINCT p_partkey) AS occur FROM t GROUP BY term HAVING coccur > 0",
)
register(
    "facet_chunks",
    lambda s, d: browse.chunked(Session(conversations(s, d)).search("@attr 1=any @attr 2=103 x").keys, 2).select("sysno", "section_id"),
    f"WITH t AS (SELECT conv_id AS sysno, turn AS section_id FROM conversations WHERE len({_words('text')}) > 0) SELECT DISTINCT sysno, section_id "
    f"FROM t QUALIFY dense_rank() OVER (PARTITION BY sysno ORDER BY section_id) <= 2",
)
register(
    "record_hits",
    lambda s, d: Session(documents(s, d)).search("the").of_record(17).select("sysno", "seqno"),
    f"WITH l AS (SELECT doc_id AS sysno, {_words('text')} AS ws FROM documents), t AS (SELECT sysno, unnest(ws) AS term, CAST(unnest(range(2, "
    f"len(ws) + 2)) AS BIGINT) AS seqno FROM l) SELECT sysno, seqno FROM t WHERE sysno = 17 AND term = 'the'",
)
register(
    "explain_details",
    lambda s, d: records.explain(parts(s, d)).where("category = 'AttributeDetails'").select("name", "detail"),
    f"SELECT 'Default:title:w' AS name, count(*) || ' records, ' || sum(len({_words('p_name')}) + 1) || ' terms' AS detail FROM part UNION ALL "
    f"SELECT 'Default:title:p', count(*) || ' records, ' || 2 * count(*) || ' terms' FROM part UNION ALL "
    f"SELECT 'Default:size:n', count(*) || ' records, ' || count(*) || ' terms' FROM part",
)
register("record_ids", lambda s, d: records.by_record_id(parts(s, d), "Brand#2", "p_brand").select("sysno"), _ALL + "p_brand = 'Brand#2'")
register(
    "match_keys",
    lambda s, d: ix.match_keys(parts(s, d).records, "$database (title:w) 'x'", parts(s, d)).select("sysno", "match_key"),
    f"SELECT {_KEY}, 'Default' || chr(1) || array_to_string({_words('p_name')}, ' ') || chr(1) || 'x' AS match_key FROM part",
)
register(
    "file_types",
    lambda s, d: _parts(s, d).select("sysno", plain.record_type(F.concat("p_name", F.lit("."), F.lower("p_type")), {"economy": "tree.xml", "promo": "marc"}).alias("form")),
    f"SELECT {_KEY}, CASE lower(p_type) WHEN 'economy' THEN 'tree.xml' WHEN 'promo' THEN 'marc' ELSE 'text' END AS form FROM part",
)


def _segmented(spark, d) -> Session:
    """Conversations as pre-tokenised lines, a turn as a segment."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), FIELD_TYPES["w"].separators), lambda x: x != "")
    lines = (
        rows
        .select("conv_id", "turn", F.posexplode(words).alias("i", "term"))
        .select(F.concat_ws(" ", F.lit("w"), "conv_id", F.lit(0), (F.col("turn") + 1), (F.col("turn") * 100_000 + F.col("i")), F.lit("any"), "term").alias("value"))
    )
    return Session(Index(None, plain.pretokenised_lines(lines), None))


register(
    "segments",
    lambda s, d: _segmented(s, d).search("@and the of").keys.select("sysno").distinct(),
    f"WITH l AS (SELECT conv_id AS sysno, turn, {_words('text')} AS ws FROM conversations), t AS (SELECT sysno, turn, unnest(ws) AS term, "
    f"unnest(range(len(ws))) AS i FROM l) SELECT sysno FROM t WHERE term IN ('the', 'of') GROUP BY sysno "
    f"HAVING arg_min(turn, turn * 100000 + i) FILTER (term = 'the') = arg_min(turn, turn * 100000 + i) FILTER (term = 'of')",
)
register(
    "terms_by_prefix",
    lambda s, d: documents(s, d).lookup("any", "w", "thea").select("term", "docs", "occurrences"),
    f"WITH l AS (SELECT doc_id AS sysno, {_words('text')} AS ws FROM documents), t AS (SELECT sysno, unnest(ws) AS term FROM l) "
    f"SELECT term, count(DISTINCT sysno) AS docs, count(*) AS occurrences FROM t WHERE starts_with(term, 'thea') GROUP BY term",
)
register(
    "terms_deleted",
    lambda s, d: documents(s, d).without_terms("any", "w", "th").terms("any", "w").agg(F.count("*").alias("n"), F.sum("occurrences").alias("occurrences")),
    f"WITH l AS (SELECT doc_id AS sysno, {_words('text')} AS ws FROM documents), t AS (SELECT sysno, unnest(ws) AS term FROM l) "
    f"SELECT count(DISTINCT term) AS n, CAST(count(*) AS BIGINT) AS occurrences FROM t WHERE NOT starts_with(term, 'th')",
)
register(
    "rank_stop",
    lambda s, d: Session(documents(s, d)).search("@attr 2=102 the").scored(first=25).select("sysno"),
    f"WITH l AS (SELECT doc_id AS sysno, {_words('text')} AS ws FROM documents) SELECT sysno FROM l WHERE list_contains(ws, 'the') ORDER BY sysno "
    f"LIMIT 25",
)
