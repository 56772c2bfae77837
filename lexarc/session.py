"""Sessions: search, scan, sort and present over an index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import records as fetching
from .functions.xpath import regions, steps
from .index import Index, Store, apply_changes, changed_keys
from .operators import browse, combine, leaf, ranking
from .plans.attributes import resolve
from .plans.cql import from_cql
from .plans.prefix import Apt, Bool, Diagnostic, Prox, SetRef, parse
from .plans.sorting import sort_spec, with_sort_leaves

GROUP_UNITS = {3: "sentence", 4: "paragraph", 5: "section", 6: "chapter", 7: "document", 8: "element", 9: "subelement", 10: "elementType"}
MOST_POSITIONS = 10_000


@dataclass
class ResultSet:
    """A lazy key table, its leaves and its sort keys."""

    index: Index
    keys: DataFrame
    leaves: list[tuple[ranking.TermInfo, DataFrame]]
    sort: list[ranking.SortKey] = field(default_factory=list)
    name: str = "default"
    limit: int | None = None
    expansions: list[tuple[DataFrame, int]] = field(default_factory=list)

    def hits(self) -> int:
        return ranking.hits(self.keys).first()[0]

    def hit_counts(self) -> DataFrame:
        """(hits, approximate): an estimate beyond the limit that the query or the session sets."""
        return ranking.approximate_hits(self.keys, self.limit) if self.limit else ranking.hits(self.keys).select("hits", F.lit(False).alias("approximate"))

    def partial(self) -> bool:
        """Whether an expansion stopped at its limit of terms, so that hits may be missing."""
        return any(terms.select("term").distinct().limit(most).count() >= most for terms, most in self.expansions)

    def term_hits(self) -> DataFrame:
        return ranking.term_hits(self.keys)

    def scored(self, handler: str = "rank-1", first: int | None = None) -> DataFrame:
        """(db, sysno, static_rank, score). Whole-index counts of plain ranked terms are subqueries of the same plan.

        With ``first``, reading stops after so many records in read order; the others have no score.
        """
        count = lambda keys: keys.agg(F.count("*").alias("n")).scalar()
        info = [replace(t, n=count(k)) if t.ranked and isinstance(t.n, int) and t.n < 0 else t for t, k in self.leaves]
        keys = self.keys
        if first is not None:
            few = keys.groupBy(*combine.RECORD).agg(F.min("static_rank").alias("_r")).orderBy("_r", *combine.RECORD).limit(first)
            keys = keys.join(few.drop("_r"), combine.RECORD, "left_semi")
        return ranking.HANDLERS[handler](keys, info)

    def top(self, n: int = 1000, handler: str = "rank-1") -> DataFrame:
        return ranking.top(self.scored(handler), n)

    def sorted(self, *by: ranking.SortKey | str) -> DataFrame:
        """In the order of sort keys, of a specification such as ``1=4 <i``, or of the query's sort leaves."""
        keys = [k for b in by for k in (sort_spec(b) if isinstance(b, str) else [b])]
        return ranking.ordered(self.keys, self.index.sortkeys, keys or self.sort)

    def ordered(self, *by: ranking.SortKey | str) -> DataFrame:
        """Records in the order in which they are shown: by sort keys, else read order."""
        if by or self.sort:
            return self.sorted(*by)
        return self.keys.groupBy(*combine.RECORD).agg(F.min("static_rank").alias("static_rank")).orderBy("static_rank", *combine.RECORD)

    def page(self, first: int, number: int, *by: ranking.SortKey | str) -> DataFrame:
        """Records at positions first, first + 1, ...; past the end raises diagnostic 13."""
        if first < 1 or number > MOST_POSITIONS or (number and self.keys.select(*combine.RECORD).distinct().limit(first + number - 1).count() < first + number - 1):
            raise Diagnostic(13, f"{first}+{number}")
        return self.ordered(*by).offset(first - 1).limit(number)

    def at(self, positions: list[int], *by: ranking.SortKey | str) -> DataFrame:
        """Records at any 1-based positions, with the column position; one past the end raises diagnostic 13."""
        if not positions or min(positions) < 1 or max(positions) > MOST_POSITIONS:
            raise Diagnostic(13, str(positions))
        rows = self.ordered(*by).limit(max(positions)).collect()  # MOST_POSITIONS rows of numbers at most
        if len(rows) < max(positions):
            raise Diagnostic(13, str(max(positions)))
        return self.keys.sparkSession.createDataFrame([(i, rows[i - 1]["db"], rows[i - 1]["sysno"]) for i in positions], "position long, db string, sysno long")

    def of_record(self, sysno: int, db: str | None = None) -> DataFrame:
        return combine.of_record(self.keys, sysno, db)

    def records(self) -> DataFrame:
        return self.index.records.join(self.keys.select(*combine.RECORD).distinct(), combine.RECORD, "left_semi")

    def fetch(self, elements: str, syntax: str = "xml") -> DataFrame:
        """(db, sysno, record): the hits in an element set, see ``records.fetch``."""
        return fetching.fetch(self, elements, syntax)

    def facets(self, *fields: tuple[str, str], n: int = 20, first: int | None = None) -> DataFrame:
        """With ``first``, occurrences are counted in the first so many hits only."""
        sample = self.ordered().limit(first) if first else None
        return browse.facets(self.index, self.keys, list(fields), n, sample)

    def snippets(self, idx_name: str = "any", others: tuple[str, ...] = ()) -> DataFrame:
        return browse.snippets(self.index, self.keys, idx_name, others=others)


class Session:
    """Compiles queries over one pinned index. Result sets have names and may be operands of later queries."""

    def __init__(self, index: Index | Store, databases: list[str] | None = None, sections: tuple[bool, list[int]] | None = None, aliases: dict[str, list[str]] | None = None, limit: int | None = None, writable: bool = False, encoding: str = "utf-8"):
        self.store, self.writable = (index, writable) if isinstance(index, Store) else (None, False)
        self.index, self.sets, self.aliases = index.read() if isinstance(index, Store) else index, {}, aliases or {}
        self.sections, self.limit = sections, limit  # sections: (complement, section ids); limit: of exact counting
        self.encoding = encoding  # of queries given as bytes
        self.tag = f"lexarc-{id(self):x}"
        self.databases = None
        if databases is not None:
            self.select(databases)

    def select(self, databases: list[str]) -> None:
        """The databases that later searches read; aliases stand for several. None or an unknown one raises diagnostic 109."""
        names = [x for d in databases for x in self.aliases.get(d, [d])]
        known = {r[0] for r in self.index.catalog().select("db").distinct().collect()} if self.index.catalog_table is not None else {r[0] for r in self.index.postings.select("db").distinct().collect()}
        if not names or (missing := [n for n in names if n not in known]):
            raise Diagnostic(109, missing[0] if names else "no database")
        self.databases = names

    def refresh(self) -> None:
        """Reads the store's newest version; result sets of the former one end."""
        self.index, self.sets = self.store.read(), {}

    def apply(self, changed: Index, gone: DataFrame) -> None:
        """Merges changes into the store; refused without the right to write."""
        if not self.writable or self.store is None:
            raise Diagnostic(223, "no permission to write")
        self.store.merge(changed, gone)
        self.refresh()

    def update(self, changes: DataFrame, build: Callable[[DataFrame], Index], key: str = "match_key") -> DataFrame:
        """Applies (action, at, key, …) rows to the records and merges what they touch; the refused ones (key, action, error)."""
        old = self.index.records.join(changes.select(key).distinct(), key, "left_semi")
        columns = [c for c in old.columns if c in changes.columns or c == "db"]
        given = changes if "db" in changes.columns else changes.withColumn("db", F.lit("Default"))
        new, errors = apply_changes(old.select(*columns), given, key)
        kept = changed_keys(given, errors, key)
        self.apply(build(new.join(kept, key, "left_semi")), old.join(kept, key, "left_semi").select(*combine.RECORD))
        return errors

    def cancellable(self) -> Session:
        """Jobs of this thread from here on end when another thread calls ``cancel()``."""
        self.index.postings.sparkSession.addTag(self.tag)
        return self

    def cancel(self) -> None:
        self.index.postings.sparkSession.interruptTag(self.tag)

    def _text(self, query: str | bytes | object) -> str | object:
        if not isinstance(query, bytes):
            return query
        try:
            return query.decode(self.encoding)
        except UnicodeDecodeError as e:
            raise Diagnostic(125, str(e)) from None

    def search(self, query: str | bytes | object, name: str = "default", cql: bool = False, kind: str = "prefix", sortkeys: str | None = None) -> ResultSet:
        """Of a prefix or CQL text or a tree. ``sortkeys``: SRU's ``path,schema,ascending`` lists. Other query types raise diagnostic 107."""
        if kind not in ("prefix", "cql"):
            raise Diagnostic(107, kind)
        query = self._text(query)
        tree = (from_cql(query) if cql or kind == "cql" else parse(query)) if isinstance(query, str) else query
        if sortkeys:
            tree = with_sort_leaves(tree, sortkeys)
        state = _State([], {}, [], [])
        keys = self._compile(tree, state)
        if self.sections:
            inside = F.col("section_id").isin(self.sections[1])
            keys = keys.where(~inside if self.sections[0] else inside)
        out = ResultSet(self.index, keys, state.leaves, [state.sort[i] for i in sorted(state.sort)], name, min(state.limits, default=self.limit), state.expansions)
        self.sets[name] = out
        return out

    def sort(self, source: str, target: str, *by: ranking.SortKey | str) -> ResultSet:
        """A result set in another order, under a name of its own."""
        keys = [k for b in by for k in (sort_spec(b) if isinstance(b, str) else [b])]
        self.sets[target] = replace(self._set(source), sort=keys, name=target)
        return self.sets[target]

    def clone(self, source: str, target: str) -> ResultSet:
        self.sets[target] = replace(self._set(source), name=target)
        return self.sets[target]

    def delete_set(self, *names: str) -> None:
        for n in names:
            self.sets.pop(n, None)

    def scan(self, query: str | bytes, position: int = 1, number: int = 20, limit_to: str | None = None, display: bool = False) -> DataFrame:
        tree = parse(self._text(query))
        if not isinstance(tree, Apt):
            raise Diagnostic(228, "a scan takes one term")
        named = limit_to or tree.get(8)
        own = resolve(Apt(tree.term, tuple(a for a in tree.attrs if a[1] != 8)))
        return browse.scan(self.index, own.index, own.kind, tree.term.lower(), position, number, self._set(named).keys if named else None, self.databases, display)

    def _set(self, name: str) -> ResultSet:
        if name not in self.sets:
            raise Diagnostic(30, name)
        return self.sets[name]

    def _compile(self, tree: object, state: _State) -> DataFrame:
        if isinstance(tree, SetRef):
            return state.adopt(self._set(tree.name))
        if isinstance(tree, Bool):
            if (tagged := self._together(tree, state)) is not None:
                return tagged
            children = [self._compile(c, state) for c in tree.children]
            if tree.op == "or":
                return combine.union(children)
            return combine.intersect(children) if tree.op == "and" else combine.subtract(*children)
        if isinstance(tree, Prox):
            if not tree.known or not 2 <= tree.unit <= 10:
                raise Diagnostic(132, str(tree.unit))
            if tree.unit == 2 and not 1 <= tree.relation <= 6:  # other units look at neither distance nor relation
                raise Diagnostic(117, str(tree.relation))
            left, right = self._compile(tree.left, state), self._compile(tree.right, state)
            if tree.unit == 2:
                return combine.near(left, right, tree.distance, tree.ordered, tree.relation, tree.exclusion)
            group = self.index.postings.where(F.col("idx_name") == f"_GROUP_{GROUP_UNITS[tree.unit]}").withColumn("term_id", F.lit(-1))
            start, stop = (group.where(F.col("term") == t).select(*combine.KEY) for t in ("begin", "end"))
            return combine.within(start, stop, left, right)
        return self._leaf(tree, state)

    def _together(self, tree: Bool, state: _State) -> DataFrame | None:
        """A boolean of one-term leaves by one pass over the postings; None where a child is anything else."""
        if len(tree.children) < 2 or not all(isinstance(c, Apt) and c.get(7) is None for c in tree.children):
            return None
        trial = _State(list(state.leaves), dict(state.sort), list(state.limits), list(state.expansions))
        picked = []
        for c in tree.children:
            own = resolve(c)
            if own.xpath or own.position in (1, 2):
                return None
            self._leaf(c, trial, picked)
        if len(picked) != len(tree.children) or any(p.where is None for _, p in picked):
            return None
        state.leaves[:], state.limits[:], state.expansions[:] = trial.leaves, trial.limits, trial.expansions
        rows = leaf.one_scan(self.index, picked, self.databases)
        if tree.op == "or":
            return rows.select(*combine.KEY)
        return combine.meet(rows, len(picked)) if tree.op == "and" else combine.apart(rows)

    def _leaf(self, apt: Apt, state: _State, picked: list | None = None) -> DataFrame:
        if direction := apt.get(7):
            if direction not in ("1", "2") or not apt.term.isdigit() or int(apt.term) > 9:
                raise Diagnostic(207, apt.term)
            own = resolve(Apt("", tuple(a for a in apt.attrs if a[1] != 7)))
            state.sort[int(apt.term)] = ranking.SortKey(own.index, direction == "2", own.strategy == "numeric", own.repeated)
            return self.index.postings.limit(0).withColumn("term_id", F.lit(-1)).select(*combine.KEY)
        own = resolve(apt)
        if own.hit_limit:
            state.limits.append(own.hit_limit)
        first = state.next_id()
        if own.xpath:
            return self._xpath(apt, own, first, state)
        keys, parts = leaf.keys(self.index, apt.term, own, self.databases, first)
        state.leaves += [(ranking.TermInfo(p.term_id, own.ranked, own.weight, 0 if p.expanded else -1, apt.term), p.keys) for p in parts]
        if own.most_terms:
            state.expansions += [(leaf.own_postings(self.index, own, self.databases).join(p.keys.select(*combine.UNIT, "seqno"), [*combine.UNIT, "seqno"], "left_semi"), max(1, own.most_terms - 1)) for p in parts if p.expanded]
        if picked is not None and len(parts) == 1:
            picked.append((own, parts[0]))
        return keys

    def _xpath(self, apt: Apt, own, first: int, state: _State) -> DataFrame:
        """A BETWEEN for the innermost step and for every step with a predicate; each adds its start and stop term."""
        path = steps(own.index)
        postings = self.index.postings if self.databases is None else self.index.postings.where(F.col("db").isin(self.databases))
        pick = lambda where: postings.where(where).withColumn("term_id", F.lit(first)).select(*combine.KEY)
        tag = lambda name, pattern: pick((F.col("idx_name") == name) & F.col("term").rlike(pattern))
        nested = regions(path)
        attribute = nested[0][1] if nested else None
        if own.always:
            keys = tag("_XPATH_BEGIN", nested[0][0]) if nested else pick(F.col("idx_name") == "_XPATH_BEGIN")
        else:
            inner = resolve(Apt(apt.term, tuple(a for a in apt.attrs if a[1] != 1) + (("bib-1", 1, "any"),)))
            text = "_XPATH_ATTR_CDATA" if attribute else "_XPATH_CDATA"
            keys, _ = leaf.keys(replace(self.index, term_table=None), apt.term, replace(inner, index=text), self.databases, first)
        state.leaves.append((ranking.TermInfo(first, own.ranked, own.weight, -1, apt.term), keys))
        for i, (pattern, _, predicate) in enumerate(nested):
            marks = pick((F.col("idx_name") == "_XPATH_ATTR") & (F.col("term") == predicate)) if predicate else None
            if own.always and i == 0:
                keys = keys if marks is None else keys.join(marks.select(*combine.UNIT, "seqno").distinct(), [*combine.UNIT, "seqno"], "left_semi").select(*combine.KEY)
                continue
            start, stop = tag("_XPATH_BEGIN", pattern), tag("_XPATH_END", pattern)
            keys = combine.between(start, stop, keys, marks)
            state.leaves += [(ranking.TermInfo(state.next_id() + k, False, 0, 0), keys.limit(0)) for k in (0, 1)]
        return keys


@dataclass
class _State:
    """What a compilation gathers: leaves, sort leaves by number, limits of exact counting, expansions that may stop."""

    leaves: list[tuple[ranking.TermInfo, DataFrame]]
    sort: dict[int, ranking.SortKey]
    limits: list[int]
    expansions: list[tuple[DataFrame, int]]

    def next_id(self) -> int:
        return 1 + max((t.term_id for t, _ in self.leaves), default=-1)

    def adopt(self, other: ResultSet) -> DataFrame:
        """The keys of a named set, its terms numbered after those that are there."""
        shift = self.next_id()
        moved = lambda keys: keys.withColumn("term_id", F.when(F.col("term_id") >= 0, F.col("term_id") + shift).otherwise(F.col("term_id"))).select(*combine.KEY)
        self.leaves += [(replace(t, term_id=t.term_id + shift), moved(k)) for t, k in other.leaves]
        self.expansions += other.expansions
        return moved(other.keys)
