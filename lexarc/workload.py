"""Registered queries of the search engine over the driver's tables, and the same results in SQL from the raw texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index as ix
from .index import Field, Index
from .operators import browse, combine, ranking
from .session import Session
from .storage import Folder, numbered, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_SEP = r"[\x01-\x20!-/:-@\[-\x60{-~]+"


def _words(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '{_SEP}'), lambda x: x <> '')"


#: Every document's words with the position that the index gives them: the field's mark has position 1.
TOK = f"""WITH l AS (SELECT doc_id AS sysno, {_words("text")} AS ws FROM documents),
tok AS (SELECT sysno, unnest(ws) AS term, CAST(unnest(range(2, len(ws) + 2)) AS BIGINT) AS seqno FROM l)
"""


_STORED: dict[tuple[str, str, str], tuple[str, Index]] = {}


def once(name: str, *tables: str):
    """A maker of an index that is made once for a session and a folder of tables, and again when the tables change."""

    def wrap(make: Callable[[SparkSession, str], Index]) -> Callable[[SparkSession, str], Index]:
        def get(spark: SparkSession, sf_dir: str) -> Index:
            key, state = (spark.sparkContext.applicationId, sf_dir, name), "|".join(Folder(spark, f"{sf_dir}/{t}.parquet").state() for t in tables)
            if _STORED.get(key, ("",))[0] != state:
                _STORED[key] = (state, make(spark, sf_dir))
            return _STORED[key][1]

        return get

    return wrap


def stored(name: str, *tables: str):
    """The same for an index that is built and stored."""

    def wrap(make: Callable[[SparkSession, str], Index]) -> Callable[[SparkSession, str], Index]:
        def write(spark: SparkSession, sf_dir: str) -> Index:
            store = ix.Store(spark, scratch_folder(spark, f"index-{name}").root)
            store.write(make(spark, sf_dir))
            return store.read()

        return once(name, *tables)(write)

    return wrap


@stored("documents", "documents")
def documents(spark: SparkSession, sf_dir: str) -> Index:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ix.build(docs, [Field("text", (("any", "w"),)), Field("lang", (("lang", "s"),)), Field("source", (("source", "s"),))], sysno="doc_id")


def _docs(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: Session(documents(spark, d)).search(query).keys.select("sysno").distinct()


def register(name: str, run: Callable, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def _search(name: str, query: str, sql: str) -> None:
    """A query's records against SQL."""
    register(name, _docs(query), TOK + sql)


def _pair(cond: str, a: str = "the", b: str = "of") -> str:
    return f"SELECT DISTINCT b.sysno FROM tok a JOIN tok b ON a.sysno = b.sysno WHERE a.term = '{a}' AND b.term = '{b}' AND {cond}"


_ONE_BYTE = r"regexp_replace(term, '[^\x00-\x7f]', '~', 'g')"  # DuckDB's distance counts bytes
_has = lambda c: f"SELECT DISTINCT sysno FROM tok WHERE {c}"
_search("term_search", "the", _has("term = 'the'"))
_search("and_search", "@and the of", _has("term = 'the'") + " INTERSECT " + _has("term = 'of'"))
_search("or_search", "@or der les", _has("term IN ('der', 'les')"))
_search("andnot_search", "@not the of", _has("term = 'the'") + " EXCEPT " + _has("term = 'of'"))
_search("phrase_search", '"of the"', _pair("b.seqno - a.seqno = 1", "of", "the"))
_search("prox_within", "@prox 0 5 1 2 k 2 the of", _pair("b.seqno - a.seqno BETWEEN 1 AND 5"))
_search("prox_far", "@prox 0 40 1 2 k 2 the of", _pair("b.seqno - a.seqno BETWEEN 1 AND 40"))
_search("prox_exact", "@prox 0 3 1 3 k 2 the of", _pair("b.seqno - a.seqno = 3"))
_search("prox_unordered", "@prox 0 3 0 2 k 2 the of", _pair("abs(b.seqno - a.seqno) <= 3"))
_search("prox_exclusion", "@prox 1 3 0 2 k 2 the of", _pair("abs(b.seqno - a.seqno) > 3"))
_search("prox_greater", "@prox 0 30 1 5 k 2 the of", _pair("b.seqno - a.seqno > 30"))
_search("trunc_right", "@attr 5=1 thea", _has("starts_with(term, 'thea')"))
_search("trunc_left", "@attr 5=2 tionti", _has("ends_with(term, 'tionti')"))
_search("trunc_both", "@attr 5=3 tionwh", _has("contains(term, 'tionwh')"))
_search("mask_hash", "@attr 5=101 th#tion", _has("regexp_full_match(term, 'th.*tion')"))
_search("mask_wildcards", '@attr 5=104 "th?2es*"', _has("regexp_full_match(term, 'th.{0,2}es.*')"))
_search("mask_bang", '@attr 5=106 "th!!es"', _has("regexp_full_match(term, 'th..es')"))
_search("mask_bang_right", '@attr 5=105 "th!!es"', _has("regexp_full_match(term, 'th..es.*')"))
_search("regexp_match", '@attr 5=102 "(er|st)(on|an)+"', _has("regexp_full_match(term, '(er|st)(on|an)+')"))
_search("fuzzy_match", "@attr 5=103 theat", _has("levenshtein(" + _ONE_BYTE + ", 'theat') <= 1"))
_search("fuzzy_match_2", '@attr 5=103 "+2+thation"', _has("levenshtein(" + _ONE_BYTE + ", 'thation') <= 2"))
for _name, _number, _op in (("rel_lt", 1, "<"), ("rel_le", 2, "<="), ("rel_ge", 4, ">="), ("rel_gt", 5, ">")):
    _search(_name, f"@attr 2={_number} {'aa' if _number < 3 else 'zu'}", _has(f"term {_op} '{'aa' if _number < 3 else 'zu'}'"))
_search("always_matches", "@attr 2=103 x", "SELECT DISTINCT sysno FROM tok")
_search("first_in_field", "@attr 3=1 the", _has("term = 'the' AND seqno = 2"))
_search("first_in_field_phrase", '@attr 3=1 "the and"', _pair("b.seqno = 3 AND a.seqno = 2", "the", "and"))
_search("and_list", '@attr 4=6 "the of and"', " INTERSECT ".join(_has(f"term = '{t}'") for t in ("the", "of", "and")))
_search("or_list", '@attr 4=105 "der les"', _has("term IN ('der', 'les')"))
_search("local_number", "@attr 4=107 17", _has("sysno = 17"))
_search(
    "cql_like",
    '@and @attr 5=1 the @not of "in the"',
    f"({_has('starts_with(term, ' + repr('the') + ')')}) INTERSECT (({_has('term = ' + repr('of'))}) "
    f"EXCEPT ({_pair('b.seqno - a.seqno = 1', 'in', 'the')}))",
)
register(
    "cql_search",
    lambda s, d: Session(documents(s, d)).search("the and (der or de) not les", cql=True).keys.select("sysno").distinct(),
    TOK + f"({_has('term = ' + repr('the'))}) INTERSECT ({_has('term IN (' + repr('der') + ', ' + repr('de') + ')')}) "
    f"EXCEPT ({_has('term = ' + repr('les'))})",
)


def _truncmax(spark, d):
    return Session(documents(spark, d)).search("@attr 5=1 @attr 13=6 thea").keys.select("sysno").distinct()


register(
    "trunc_limit",
    _truncmax,
    TOK + "SELECT DISTINCT sysno FROM tok WHERE term IN (SELECT DISTINCT term FROM tok WHERE starts_with(term, 'thea') ORDER BY term LIMIT 5)",
)


def _set_reference(spark, d):
    s = Session(documents(spark, d))
    s.search("@and the of", "common")
    return s.search("@not @set common and").keys.select("sysno").distinct()


register(
    "set_reference",
    _set_reference,
    TOK + f"({_has('term = ' + repr('the'))} INTERSECT {_has('term = ' + repr('of'))}) EXCEPT ({_has('term = ' + repr('and'))})",
)
register(
    "hit_count",
    lambda s, d: ranking.hits(Session(documents(s, d)).search("@or the der").keys),
    TOK + "SELECT count(DISTINCT sysno) AS hits FROM tok WHERE term IN ('the', 'der')",
)
register(
    "term_hit_counts",
    lambda s, d: ranking.term_hits(Session(documents(s, d)).search("@or the @or of der").keys),
    TOK + "SELECT CASE term WHEN 'the' THEN 0 WHEN 'of' THEN 1 ELSE 2 END AS term_id, count(DISTINCT sysno) AS hits FROM tok "
    "WHERE term IN ('the', 'of', 'der') GROUP BY 1",
)

_RANKED = "@and @attr 2=102 the @attr 2=102 of"
_SCORE = """, k AS (SELECT * FROM tok WHERE term IN ('the', 'of') AND sysno IN (SELECT sysno FROM tok WHERE term = 'the' INTERSECT SELECT sysno FROM tok WHERE term = 'of')),
g AS (SELECT count(*) FILTER (term = 'the') AS g0, count(*) FILTER (term = 'of') AS g1 FROM tok),
p AS (SELECT sysno, count(*) FILTER (term = 'the') AS l0, count(*) FILTER (term = 'of') AS l1, max(seqno) AS last FROM k GROUP BY sysno),
lg AS (SELECT sysno, length(bin(l0)) - 1 AS a, length(bin(l1)) - 1 AS b, length(bin(g0)) - 1 AS ga, length(bin(g1)) - 1 AS gb, greatest(length(bin(last // 2)) - 1, 0) AS c FROM p, g),
scored AS (SELECT sysno, CAST(least(1000, ((8 + a) * (32 - ga) * 34 + (8 + b) * (32 - gb) * 34) // (2 * (8 + c))) AS INTEGER) AS score FROM lg)
"""


def _ranked(handler: str):
    return lambda s, d: Session(documents(s, d)).search(_RANKED).top(10, handler).select("sysno", "score")


register("rank1", _ranked("rank-1"), TOK.rstrip() + _SCORE + "SELECT sysno, score FROM scored ORDER BY score DESC, sysno LIMIT 10")
register(
    "rank_static",
    _ranked("rank-static"),
    TOK.rstrip() + _SCORE + "SELECT sysno, CAST(2147483647 AS INTEGER) AS score FROM scored ORDER BY sysno LIMIT 10",
)


@stored("labelled", "documents", "labels")
def _labelled(spark, d) -> Index:
    docs = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return ix.build(docs, [Field("text", (("any", "w"),))], sysno="doc_id", rank="quality")


register(
    "rank2",
    lambda s, d: Session(_labelled(s, d)).search(_RANKED).top(10, "rank-2").select("sysno", "score"),
    TOK.replace("FROM documents", "FROM documents JOIN labels USING (doc_id)").rstrip() + _SCORE + ", r AS (SELECT sysno, CAST(score - quality AS INTEGER) AS score, quality FROM scored JOIN labels ON doc_id = sysno) SELECT sysno, score FROM r "
    "ORDER BY score DESC, quality, sysno LIMIT 10",
)
register(
    "sort_multi_key",
    lambda s, d: Session(documents(s, d)).search("the").sorted(ranking.SortKey("lang", True), ranking.SortKey("source")).transform(numbered).select("sysno", "position"),
    TOK + "SELECT sysno, row_number() OVER (ORDER BY lang DESC NULLS LAST, source ASC NULLS FIRST, sysno) AS position "
    "FROM (SELECT DISTINCT sysno, d.lang, d.source FROM tok JOIN documents d ON d.doc_id = tok.sysno WHERE term = 'the')",
)
register(
    "sort_query",
    lambda s, d: Session(documents(s, d)).search("@or the @attr 7=2 @attr 1=source @attr 4=s 0").sorted().transform(numbered).select("sysno", "position"),
    TOK + "SELECT sysno, row_number() OVER (ORDER BY source DESC NULLS LAST, sysno) AS position FROM (SELECT DISTINCT sysno, d.source FROM tok "
    "JOIN documents d ON d.doc_id = tok.sysno WHERE term = 'the')",
)
register(
    "topk_page",
    lambda s, d: Session(documents(s, d)).search("the").page(21, 20).select("sysno"),
    TOK + "SELECT DISTINCT sysno FROM tok WHERE term = 'the' ORDER BY sysno LIMIT 20 OFFSET 20",
)
register(
    "scan_terms",
    lambda s, d: browse.scan(documents(s, d), "any", "w", "the", 5, 20),
    TOK + ", t AS (SELECT term, count(DISTINCT sysno) AS docs FROM tok GROUP BY term), a AS (SELECT term, docs, row_number() OVER (ORDER BY term) + 4 AS "
    "entry FROM t WHERE term >= 'the'), b AS (SELECT term, docs, 5 - row_number() OVER (ORDER BY term DESC) AS entry FROM t WHERE term < 'the') "
    "SELECT entry, term, docs FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE entry BETWEEN 1 AND 20",
)


def _scan_limited(spark, d):
    s = Session(documents(spark, d))
    s.search("der", "german")
    return s.scan("the", 1, 20, "german")


register(
    "scan_limited",
    _scan_limited,
    TOK + "SELECT row_number() OVER (ORDER BY term) AS entry, term, docs FROM (SELECT term, count(DISTINCT sysno) AS docs FROM tok WHERE term >= 'the' "
    "AND sysno IN (SELECT sysno FROM tok WHERE term = 'der') GROUP BY term) QUALIFY entry <= 20",
)
register(
    "facet_terms",
    lambda s, d: Session(documents(s, d)).search("der").facets(("any", "w"), n=10).select("term", "coccur", "occur"),
    TOK + "SELECT term, count(*) AS coccur, count(DISTINCT sysno) AS occur FROM tok WHERE sysno IN (SELECT sysno FROM tok WHERE term = 'der') "
    "GROUP BY term ORDER BY occur DESC, term LIMIT 10",
)
register(
    "facet_sort",
    lambda s, d: (lambda x: browse.sort_facets(x, Session(x).search("der").keys, "source"))(documents(s, d)),
    TOK + "SELECT lower(source) AS term, count(*) AS occur FROM documents WHERE source IS NOT NULL AND doc_id IN (SELECT sysno FROM tok "
    "WHERE term = 'der') GROUP BY 1 ORDER BY occur DESC, term LIMIT 20",
)
register(
    "catalog_stats",
    lambda s, d: documents(s, d).catalog().select("idx_type", "idx_name", "doc_occ", "term_occ"),
    TOK + "SELECT 'w' AS idx_type, 'any' AS idx_name, count(DISTINCT sysno) AS doc_occ, count(*) + count(DISTINCT sysno) AS term_occ FROM tok",
)
register(
    "posting_histogram",
    lambda s, d: ix.posting_histogram(documents(s, d)).select("upto", "n_terms"),
    TOK + f", c AS (SELECT term, count(*) AS n FROM tok GROUP BY term) SELECT "
    f"CAST(coalesce({', '.join(f'CASE WHEN n <= {b} THEN {b} END' for b in ix.BOUNDS)}, -1) AS BIGINT) AS upto, count(*) AS n_terms FROM c GROUP BY 1",
)
register(
    "snippet_window",
    lambda s, d: Session(documents(s, d)).search("@and the der").snippets().select("sysno", "snippet"),
    TOK + ", h AS (SELECT sysno, seqno FROM tok WHERE term IN ('the', 'der') AND sysno IN (SELECT sysno FROM tok WHERE term = 'the' INTERSECT SELECT sysno "
    "FROM tok WHERE term = 'der')), w AS (SELECT t.sysno, t.seqno, t.term, max(CAST(t.seqno = h.seqno AS INTEGER)) AS m FROM tok t "
    "JOIN h ON h.sysno = t.sysno AND t.seqno BETWEEN h.seqno - 4 AND h.seqno + 4 "
    "GROUP BY ALL), x AS (SELECT *, seqno - lag(seqno) OVER (PARTITION BY sysno ORDER BY seqno) AS gap FROM w) "
    "SELECT sysno, string_agg(CASE WHEN gap > 1 THEN '... ' ELSE '' END || CASE WHEN m = 1 THEN '{' || term || '}' ELSE term END, ' ' "
    "ORDER BY seqno) AS snippet FROM x GROUP BY sysno",
)
register(
    "best_window",
    lambda s, d: browse.best_window(Session(documents(s, d)).search("the").keys, 10).select("sysno", "seqno", "n"),
    TOK + ", t AS (SELECT sysno, seqno, count(*) OVER (PARTITION BY sysno ORDER BY seqno RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM tok "
    "WHERE term = 'the') SELECT sysno, seqno, n FROM (SELECT *, row_number() OVER (PARTITION BY sysno ORDER BY n DESC, seqno) AS k FROM t) "
    "WHERE k = 1",
)

# ---- sections: a conversation is a record, a turn a section
_CTOK = f"WITH l AS (SELECT conv_id AS sysno, turn AS section_id, {_words('text')} AS ws FROM conversations), tok AS (SELECT sysno, section_id, unnest(ws) AS term FROM l) "


@stored("conversations", "conversations")
def conversations(spark: SparkSession, sf_dir: str) -> Index:
    return ix.build(spark.read.parquet(f"{sf_dir}/conversations.parquet"), [Field("text", (("any", "w"),)), Field("role", (("role", "0"),))], sysno="conv_id", section="turn")


register(
    "section_and",
    lambda s, d: Session(conversations(s, d)).search("@and the of").keys.select("sysno", "section_id").distinct(),
    _CTOK + "SELECT DISTINCT sysno, section_id FROM tok WHERE term = 'the' INTERSECT SELECT DISTINCT sysno, section_id FROM tok WHERE term = 'of'",
)
register(
    "section_limit",
    lambda s, d: Session(conversations(s, d), sections=(False, [0, 1])).search("the").keys.select("sysno", "section_id").distinct(),
    _CTOK + "SELECT DISTINCT sysno, section_id FROM tok WHERE term = 'the' AND section_id IN (0, 1)",
)
register(
    "section_limit_complement",
    lambda s, d: Session(conversations(s, d), sections=(True, [0, 1])).search("the").keys.select("sysno", "section_id").distinct(),
    _CTOK + "SELECT DISTINCT sysno, section_id FROM tok WHERE term = 'the' AND section_id NOT IN (0, 1)",
)
register(
    "exact_field",
    lambda s, d: Session(conversations(s, d)).search("@attr 1=role @attr 4=3 system").keys.select("sysno").distinct(),
    "SELECT DISTINCT conv_id AS sysno FROM conversations WHERE role = 'system'",
)


# ---- short fields, numbers, several databases
@stored("parts", "part")
def parts(spark: SparkSession, sf_dir: str) -> Index:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("size_text", F.col("p_size").cast("string"))
    return ix.build(p, [Field("p_name", (("title", "w"), ("title", "p"), ("title", "s"))), Field("size_text", (("size", "n"), ("size", "s")))], sysno="p_partkey")


_PART = "SELECT CAST(p_partkey AS BIGINT) AS sysno FROM part WHERE "
for _name, _number, _op in (("numeric_lt", 1, "<"), ("numeric_le", 2, "<="), ("numeric_eq", 3, "="), ("numeric_ge", 4, ">="), ("numeric_gt", 5, ">")):
    register(_name, lambda s, d, n=_number: Session(parts(s, d)).search(f"@attr 1=size @attr 4=109 @attr 2={n} 12").keys.select("sysno").distinct(), _PART + f"p_size {_op} 12")
register(
    "numeric_range",
    lambda s, d: Session(parts(s, d)).search("@and @attr 1=size @attr 4=109 @attr 2=4 10 @attr 1=size @attr 4=109 @attr 2=2 20").keys.select("sysno").distinct(),
    _PART + "p_size BETWEEN 10 AND 20",
)
register(
    "sort_numeric",
    lambda s, d: Session(parts(s, d)).search("@attr 1=size @attr 4=109 @attr 2=4 45").sorted(ranking.SortKey("size", True, True)).transform(numbered).select("sysno", "position"),
    "SELECT CAST(p_partkey AS BIGINT) AS sysno, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS position FROM part WHERE p_size >= 45",
)


def _complete(spark, d):
    name = spark.read.parquet(f"{d}/part.parquet").agg(F.min("p_name")).first()[0]
    return Session(parts(spark, d)).search(f'@attr 1=4 @attr 6=3 "{name}"').keys.select("sysno").distinct()


register("complete_field", _complete, "SELECT CAST(p_partkey AS BIGINT) AS sysno FROM part WHERE lower(p_name) = (SELECT lower(min(p_name)) FROM part)")


@stored("databases", "customer", "nation")
def _databases(spark, d) -> Index:
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("sysno"), F.col("c_mktsegment").alias("name"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("sysno"), F.col("n_name").alias("name"))
    one, two = (ix.build(x, [Field("name", (("any", "w"),))], db=db) for x, db in ((c, "customers"), (n, "nations")))
    return ix.joined_indexes(one, two)


def _two(query: str, *columns: str):
    return lambda spark, d: Session(_databases(spark, d), ["all"], aliases={"all": ["customers", "nations"]}).search(query).keys.select(*columns).distinct()


register(
    "multi_database",
    _two("@or building @attr 5=1 united", "sysno"),
    "SELECT DISTINCT sysno FROM (SELECT CAST(c_custkey AS BIGINT) AS sysno FROM customer WHERE lower(c_mktsegment) = 'building' UNION ALL "
    "SELECT CAST(n_nationkey AS BIGINT) FROM nation WHERE regexp_matches(lower(n_name), '(^|[^a-z0-9])united'))",
)


# ---- regions: a page's title and body as start ... stop markers
def _region_tables(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").cast("long").alias("sysno"), F.col("html").alias("text"))
    return p, F.filter(F.split(F.lower("text"), r"(?=<)|(?<=>)|[\x01-\x20]+"), lambda x: x != "")


def _between(spark, d):
    p, tokens = _region_tables(spark, d)
    zero = F.lit(0).cast("long")
    rows = p.select("sysno", F.posexplode(tokens).alias("seqno", "term"))
    keys = rows.select(zero.alias("static_rank"), F.lit("Default").alias("db"), "sysno", zero.alias("section_id"), zero.alias("segment"), F.col("seqno").cast("long"), F.lit(0).alias("term_id"), "term")
    pick = lambda c: keys.where(c).select(*combine.KEY)
    return combine.between(pick("term = '<p>'"), pick("term = '</p>'"), pick("term = 'the'")).groupBy("sysno").agg(F.count("*").alias("n"))


register("between_region", _between, r"""WITH t AS (SELECT page_id AS sysno, list_filter(string_split_regex(regexp_replace(lower(html), '(<[^>]*>)', chr(1) || '\1' || chr(1), 'g'), '[\x01-\x20]+'), lambda x: x <> '') AS ws FROM pages),
k AS (SELECT CAST(sysno AS BIGINT) AS sysno, unnest(ws) AS term, unnest(range(len(ws))) AS seqno FROM t),
o AS (SELECT sysno, term, sum(CASE term WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY sysno ORDER BY seqno) AS depth FROM k)
SELECT sysno, count(*) AS n FROM o WHERE term = 'the' AND depth > 0 GROUP BY sysno""")


# ---- maintenance
def _changes(spark, d):
    docs = (
        spark.read
        .parquet(f"{d}/documents.parquet")
        .select(F.col("doc_id").cast("string").alias("match_key"), "lang", F.length("text").cast("long").alias("size"))
    )
    key = F.col("match_key").cast("long")
    base = docs.where(key % 3 != 0)
    return base, docs.select("*", F.when(key % 5 == 0, "delete").when(key % 5 == 1, "insert").when(key % 5 == 2, "replace").when(key % 5 == 3, "update").otherwise("adelete").alias("action"), key.alias("at")).withColumn("size", F.lit(-1).cast("long"))


register("upsert_records", lambda s, d: ix.apply_changes(*_changes(s, d))[0].select("match_key", "size"), """SELECT CAST(doc_id AS VARCHAR) AS match_key, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 IN (2, 3) OR doc_id % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE length(text) END AS size
FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 IN (1, 2, 3) OR doc_id % 3 = 0 AND doc_id % 5 IN (1, 3)""")
register(
    "change_errors",
    lambda s, d: ix.apply_changes(*_changes(s, d))[1],
    "SELECT CAST(doc_id AS VARCHAR) AS match_key, CASE doc_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'replace' END AS action, CASE WHEN "
    "doc_id % 3 <> 0 THEN 'exists' ELSE 'missing' END AS error FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 1 OR doc_id % 3 = 0 "
    "AND doc_id % 5 IN (0, 2)",
)


def _file_sync(spark, d):
    e = (
        spark.read
        .parquet(f"{d}/events.parquet")
        .select(F.col("event_id").cast("string").alias("path"), F.col("event_id").alias("i"), F.col("user_id").alias("mtime"))
    )
    return ix.file_changes(e.where("i % 4 <> 0"), e.where("i % 7 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("i") % 2 == 0, 1).otherwise(0)))


register(
    "file_sync_delta",
    _file_sync,
    "SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 4 = 0 THEN 'insert' WHEN event_id % 7 = 0 THEN 'delete' ELSE 'update' END AS "
    "action FROM events WHERE event_id % 4 = 0 AND event_id % 7 <> 0 OR event_id % 4 <> 0 AND event_id % 7 = 0 OR event_id % 4 <> 0 "
    "AND event_id % 7 <> 0 AND event_id % 2 = 0",
)
register(
    "register_check",
    lambda s, d: ix.check(documents(s, d)),
    TOK + "SELECT 'postings without record' AS fault, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'records without posting', (SELECT count(*) FROM documents "
    "WHERE doc_id NOT IN (SELECT sysno FROM tok)) UNION ALL SELECT 'sort keys without record', 0",
)


def _key_delta(spark, d):
    new = documents(spark, d).postings
    old = new.where("sysno % 10 <> 3").withColumn("term", F.when(F.col("term") == "the", "teh").otherwise(F.col("term")))
    return ix.key_delta(old, new).groupBy("step").agg(F.count("*").alias("n"))


register(
    "key_delta",
    _key_delta,
    TOK + ", n AS (SELECT count(*) FILTER (sysno % 10 = 3) AS gone, count(*) FILTER (sysno % 10 <> 3 "
    "AND term = 'the') AS the, count(DISTINCT sysno) FILTER (sysno % 10 = 3) AS marks FROM tok) "
    "SELECT CAST(1 AS BIGINT) AS step, gone + the + marks AS n FROM n UNION ALL SELECT -1, the FROM n",
)


# ---- what single indexes, sets and batches hide
register(
    "multi_database_and",
    _two("@or @and nation 1 @and nation household", "db", "sysno"),
    "SELECT 'nations' AS db, CAST(n_nationkey AS BIGINT) AS sysno FROM nation WHERE list_contains(string_split(lower(n_name), '_'), '1')",
)
register("multi_database_not", _two("@not nation household", "db", "sysno"), "SELECT 'nations' AS db, CAST(n_nationkey AS BIGINT) AS sysno FROM nation")
_search("regexp_classes", r'@attr 5=102 "\\D\\W*[A-C]\\w"', _has("regexp_full_match(term, '\\D\\W*[a-c]\\w')"))
register(
    "local_number_blank",
    lambda s, d: Session(documents(s, d)).search("@attr 1=_ALLRECORDS @attr 2=103 x").keys.select("sysno").distinct(),
    "SELECT doc_id AS sysno FROM documents",
)


def _set_terms(spark, d):
    s = Session(documents(spark, d))
    s.search("@or der les", "foreign")
    return s.search("@or the @set foreign").term_hits()


register(
    "set_reference_terms",
    _set_terms,
    TOK + "SELECT CASE term WHEN 'the' THEN 0 WHEN 'der' THEN 1 ELSE 2 END AS term_id, count(DISTINCT sysno) AS hits FROM tok "
    "WHERE term IN ('the', 'der', 'les') GROUP BY 1",
)
register(
    "rank_static_labelled",
    lambda s, d: Session(_labelled(s, d)).search(_RANKED).top(1000, "rank-static").select("sysno", "score"),
    TOK + "SELECT sysno, CAST(2147483647 - quality AS INTEGER) AS score FROM (SELECT sysno FROM tok WHERE term = 'the' INTERSECT SELECT sysno FROM tok "
    "WHERE term = 'of') JOIN labels ON doc_id = sysno ORDER BY score DESC, sysno LIMIT 1000",
)


def _many_changes(spark, d):
    docs = (
        spark.read
        .parquet(f"{d}/documents.parquet")
        .select(F.col("doc_id").cast("string").alias("match_key"), F.length("text").cast("long").alias("size"))
    )
    key = F.col("match_key").cast("long")
    each = [("insert", 1, -1), ("delete", 2, -2), ("insert", 3, -3), ("replace", 4, -4), ("adelete", 5, -5)]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(at).cast("long").alias("at"), F.lit(v).cast("long").alias("size")) for a, at, v in each]))
    changes = docs.select("match_key", rows.alias("c")).select("match_key", "c.*").where((F.col("match_key").cast("long") + F.col("at")) % 4 != 0)
    return docs.where(key % 3 != 0), changes


_FOLDED = """WITH RECURSIVE c AS (SELECT doc_id, nth, action FROM documents, (VALUES (1, 'insert'), (2, 'delete'), (3, 'insert'), (4, 'replace'), (5, 'adelete')) AS v(nth, action) WHERE (doc_id + nth) % 4 <> 0),
s(doc_id, step, there, size, action, error) AS (SELECT doc_id, 0, doc_id % 3 <> 0, CAST(CASE WHEN doc_id % 3 <> 0 THEN length(text) END AS BIGINT), '', CAST(NULL AS VARCHAR) FROM documents
UNION ALL SELECT s.doc_id, s.step + 1,
CASE c.action WHEN 'insert' THEN true WHEN 'delete' THEN false WHEN 'adelete' THEN false ELSE s.there END,
CASE WHEN c.action = 'insert' AND NOT s.there OR c.action = 'replace' AND s.there THEN -(s.step + 1) WHEN c.action IN ('delete', 'adelete') THEN NULL ELSE s.size END,
coalesce(c.action, ''), CASE WHEN c.action = 'insert' AND s.there THEN 'exists' WHEN c.action IN ('delete', 'replace') AND NOT s.there THEN 'missing' END
FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.nth = s.step + 1 WHERE s.step < 5)
"""
register(
    "changes_folded",
    lambda s, d: ix.apply_changes(*_many_changes(s, d))[0].select("match_key", "size"),
    _FOLDED + "SELECT CAST(doc_id AS VARCHAR) AS match_key, size FROM s WHERE step = 5 AND there",
)
register(
    "changes_folded_errors",
    lambda s, d: ix.apply_changes(*_many_changes(s, d))[1],
    _FOLDED + "SELECT CAST(doc_id AS VARCHAR) AS match_key, action, error FROM s WHERE error IS NOT NULL",
)


def _merged(spark, d):
    """A stored index with one layer of changes on top, read as one."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    fields = [Field("text", (("any", "w"),))]
    store = ix.Store(spark, scratch_folder(spark, "merged").root)
    store.write(ix.build(docs.where("doc_id % 4 <> 1"), fields, sysno="doc_id"))
    changed = docs.where("doc_id % 4 in (1, 2)").withColumn("text", F.concat(F.lit("newword "), F.coalesce("text", F.lit(""))))
    gone = (
        docs
        .where("doc_id % 4 in (2, 3) and doc_id % 5 = 0 or doc_id % 4 = 2")
        .select(F.lit("Default").alias("db"), F.col("doc_id").alias("sysno"))
    )
    store.merge(ix.build(changed, fields, sysno="doc_id"), gone)
    return Session(store).search("@or newword the").keys.select("sysno", "seqno")


register(
    "merge_layers",
    _merged,
    "WITH m AS (SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 2) THEN 'newword ' || coalesce(text, '') ELSE text END AS text FROM documents "
    "WHERE NOT (doc_id % 4 = 3 AND doc_id % 5 = 0)), " + TOK[5:].replace("FROM documents", "FROM m") + "SELECT sysno, seqno FROM tok WHERE term IN ('newword', 'the')",
)


def _dropped(spark, d):
    store = ix.Store(spark, scratch_folder(spark, "dropped").root)
    store.write(_databases(spark, d))
    store.drop_database("customers")
    store.compact()
    return store.read().databases().select("db", "records")


register("drop_database", _dropped, "SELECT 'nations' AS db, count(*) AS records FROM nation")
register(
    "group_databases",
    lambda s, d: _databases(s, d).databases().select("db", "records"),
    "SELECT 'nations' AS db, count(*) AS records FROM nation UNION ALL SELECT 'customers', count(*) FROM customer",
)

# ---- fetching records
_fetch = lambda make, query, elements, syntax="xml": lambda s, d: Session(make(s, d)).search(query).fetch(elements, syntax).select("sysno", "record")
_PART45 = "FROM part WHERE p_size = 45"
_Q45 = "@attr 1=size @attr 4=109 45"
register(
    "fetch_data",
    _fetch(documents, "der", "x::data"),
    TOK + "SELECT doc_id AS sysno, text AS record FROM documents WHERE doc_id IN (SELECT sysno FROM tok WHERE term = 'der')",
)
register(
    "fetch_meta",
    _fetch(documents, "der", "x::meta"),
    TOK + "SELECT doc_id AS sysno, '<record sysno=\"' || doc_id || '\" base=\"Default\" rank=\"0\" size=\"' || strlen(text) || '\" set=\"x::meta\"/>' || "
    "chr(10) AS record FROM documents WHERE doc_id IN (SELECT sysno FROM tok WHERE term = 'der')",
)
register(
    "fetch_meta_sysno",
    _fetch(documents, "der", "x::meta::sysno", "sutrs"),
    TOK + "SELECT DISTINCT sysno, CAST(sysno AS VARCHAR) AS record FROM tok WHERE term = 'der'",
)
register(
    "fetch_index",
    _fetch(parts, _Q45, "x::index::size:n"),
    f"SELECT CAST(p_partkey AS BIGINT) AS sysno, '<record sysno=\"' || p_partkey || '\" set=\"x::index::size:n\">' || chr(10) || '  <index "
    f"name=\"size\" type=\"n\" seq=\"' || (len({_words('p_name')}) + 2) || '\">45</index>' || chr(10) || '</record>' || chr(10) AS record {_PART45}",
)
register(
    "fetch_sort_keys",
    _fetch(parts, _Q45, "x::index::title:s"),
    f"SELECT CAST(p_partkey AS BIGINT) AS sysno, '<record sysno=\"' || p_partkey || '\" set=\"x::index::title:s\">' || chr(10) || '  <index "
    f"name=\"title\" type=\"s\">' || array_to_string({_words('p_name')}, ' ') || '</index>' || chr(10) || '</record>' || chr(10) AS record {_PART45}",
)
register(
    "fetch_snippet",
    _fetch(documents, "les", "x::snippet", "sutrs"),
    TOK + ", h AS (SELECT sysno, seqno FROM tok WHERE term = 'les'), w AS (SELECT t.sysno, t.seqno, t.term, max(CAST(t.seqno = h.seqno AS INTEGER)) AS m "
    "FROM tok t JOIN h ON h.sysno = t.sysno AND t.seqno BETWEEN h.seqno - 4 AND h.seqno + 4 "
    "GROUP BY ALL), x AS (SELECT *, seqno - lag(seqno) OVER (PARTITION BY sysno ORDER BY seqno) AS gap FROM w) "
    "SELECT sysno, string_agg(CASE WHEN gap > 1 THEN '... ' ELSE '' END || CASE WHEN m = 1 THEN '{' || term || '}' ELSE term END, ' ' "
    "ORDER BY seqno) AS record FROM x GROUP BY sysno",
)
register(
    "fetch_lines",
    _fetch(documents, "der", "B"),
    TOK + "SELECT doc_id AS sysno, '<!-- Size: ' || strlen(text) || ' Database: Default -->' || chr(10) || array_to_string(string_split(text, "
    "chr(10))[1:4], chr(10)) AS record FROM documents WHERE doc_id IN (SELECT sysno FROM tok WHERE term = 'der')",
)
register(
    "fetch_facets",
    lambda s, d: Session(documents(s, d)).search("der").fetch("x::facet::any:w:3", "sutrs"),
    TOK + ", f AS (SELECT term, count(DISTINCT sysno) AS occur FROM tok WHERE sysno IN (SELECT sysno FROM tok WHERE term = 'der') GROUP BY term "
    "ORDER BY occur DESC, term LIMIT 3) SELECT 'facet any w' || chr(10) || string_agg(term || ' ' || occur, chr(10) "
    "ORDER BY occur DESC, term) AS record FROM f",
)
register(
    "scan_display",
    lambda s, d: browse.scan(parts(s, d), "title", "w", "b", 1, 10, display=True),
    f"WITH l AS (SELECT CAST(p_partkey AS BIGINT) AS sysno, {_words('p_name')} AS ws, {_words('p_name').replace('lower(p_name)', 'p_name')} AS raw "
    f"FROM part), tok AS (SELECT sysno, unnest(ws) AS term, unnest(raw) AS word, unnest(range(len(ws))) AS nth FROM l) "
    f"SELECT row_number() OVER (ORDER BY term) AS entry, term, count(DISTINCT sysno) AS docs, arg_min(word, sysno * 1000000 + nth) AS display "
    f"FROM tok WHERE term >= 'b' GROUP BY term ORDER BY term LIMIT 10",
)
register(
    "sort_spec",
    lambda s, d: Session(documents(s, d)).search("the").sorted("lang > source <").transform(numbered).select("sysno", "position"),
    ORACLE["sort_multi_key"],
)
register(
    "sru_sort_keys",
    lambda s, d: Session(documents(s, d)).search("the", sortkeys="lang,,0 source,,1").sorted().transform(numbered).select("sysno", "position"),
    ORACLE["sort_multi_key"],
)
register(
    "cql_relations",
    lambda s, d: Session(parts(s, d)).search('size >=/number 10 and size <=/number 20 not title any "zz"', cql=True).keys.select("sysno").distinct(),
    ORACLE["numeric_range"],
)
register(
    "cql_prox",
    lambda s, d: Session(documents(s, d)).search("the prox/distance<=3/unordered of", cql=True).keys.select("sysno").distinct(),
    ORACLE["prox_unordered"],
)
register("cql_masks", lambda s, d: Session(documents(s, d)).search("th??es", cql=True).keys.select("sysno").distinct(), ORACLE["mask_bang"])
register(
    "delete_records",
    lambda s, d: ix.apply_changes(_changes(s, d)[0], _changes(s, d)[1].where("action in ('delete', 'adelete')"))[0].select("match_key"),
    "SELECT CAST(doc_id AS VARCHAR) AS match_key FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 NOT IN (0, 4)",
)
register("numeric_eq_multi", lambda s, d: Session(parts(s, d)).search('@attr 1=size @attr 4=109 "12 12"').keys.select("sysno").distinct(), ORACLE["numeric_eq"])
register(
    "sort_missing",
    lambda s, d: Session(documents(s, d)).search("@attr 2=103 x").sorted("source <").transform(numbered).select("sysno", "position"),
    TOK + "SELECT sysno, row_number() OVER (ORDER BY source ASC NULLS FIRST, sysno) AS position FROM (SELECT DISTINCT sysno, d.source FROM tok "
    "JOIN documents d ON d.doc_id = tok.sysno)",
)
register(
    "facet_multi",
    lambda s, d: Session(parts(s, d)).search("@attr 1=size @attr 4=109 @attr 2=4 40").facets(("title", "w"), ("size", "n"), n=5).select("idx_name", "term", "coccur", "occur", "place"),
    f"WITH l AS (SELECT p_partkey AS sysno, {_words('p_name')} AS ws, CAST(p_size AS VARCHAR) AS z FROM part "
    f"WHERE p_size >= 40), t AS (SELECT 'title' AS idx_name, sysno, unnest(ws) AS term FROM l UNION ALL SELECT 'size', sysno, z "
    f"FROM l), f AS (SELECT idx_name, term, count(*) AS coccur, count(DISTINCT sysno) AS occur FROM t GROUP BY idx_name, term) "
    f"SELECT *, row_number() OVER (PARTITION BY idx_name ORDER BY occur DESC, term) AS place FROM f QUALIFY place <= 5",
)
