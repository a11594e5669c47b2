"""Full-text search with BM25.

A search over rows makes two narrow passes: one counts the documents, tokens and documents with each query term, a few
numbers; the other scores each row from its own terms. Nothing is shuffled but the best rows. An index keeps postings
in order of term, and the lengths of documents: a search reads the postings of its own terms, shuffles these by row, and
reads of the table the fragments of the rows it found.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import analyzer
from brindle.functions.analyzer import Params
from brindle.session import stash, unstash

K1, B = 1.2, 0.75


class Query:
    def __and__(self, other: "Query") -> "Query":
        return BooleanQuery([("must", self), ("must", other)])

    def __or__(self, other: "Query") -> "Query":
        return BooleanQuery([("should", self), ("should", other)])


@dataclass
class MatchQuery(Query):
    query: str
    column: str
    boost: float = 1.0
    fuzziness: int | None = 0
    max_expansions: int = 50
    operator: str = "or"
    prefix_length: int = 0

    def __post_init__(self):
        self.fuzziness, self.operator = self.fuzziness or 0, str(self.operator).lower()
        if self.operator not in ("or", "and") or self.fuzziness < 0 or self.max_expansions < 0 or self.prefix_length < 0:
            raise ValueError("bad settings of a match query")


@dataclass
class PhraseQuery(Query):
    query: str
    column: str
    slop: int = 0


@dataclass
class BoostQuery(Query):
    positive: Query
    negative: Query
    negative_boost: float = 0.5


@dataclass
class MultiMatchQuery(Query):
    query: str
    columns: list[str]
    boosts: list[float] | None = None
    operator: str = "or"

    def __post_init__(self):
        if self.boosts is not None and len(self.boosts) != len(self.columns):
            raise ValueError("The number of boosts must match the number of columns")


@dataclass
class BooleanQuery(Query):
    queries: list[tuple[str, Query]]
    must: list[Query] = field(init=False)

    def __post_init__(self):
        self.queries = [(str(o).lower(), q) for o, q in self.queries]
        self.must = [q for o, q in self.queries if o == "must"]
        self.should = [q for o, q in self.queries if o == "should"]
        self.must_not = [q for o, q in self.queries if o == "must_not"]
        if not self.must and not self.should:
            raise ValueError("boolean query must have at least one should/must query")


def from_json(spec: str | dict) -> Query:
    """The JSON form: {match|match_phrase|boost|multi_match|boolean: settings}."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    (kind, s), = spec.items()
    if kind == "match":
        return MatchQuery(s["terms"], s["column"], s.get("boost", 1.0), s.get("fuzziness", 0), s.get("max_expansions", 50), s.get("operator", "or"), s.get("prefix_length", 0))
    if kind in ("match_phrase", "phrase"):
        return PhraseQuery(s["terms"], s["column"], s.get("slop", 0))
    if kind == "boost":
        return BoostQuery(from_json(s["positive"]), from_json(s["negative"]), s.get("negative_boost", 0.5))
    if kind == "multi_match":
        parts = [q["match"] if "match" in q else q for q in s["match_queries"]]
        return MultiMatchQuery(parts[0]["terms"], [q["column"] for q in parts], [q.get("boost", 1.0) for q in parts], parts[0].get("operator", "or"))
    if kind == "boolean":
        return BooleanQuery([(o, from_json(q)) for o in ("must", "should", "must_not") for q in s.get(o, [])])
    raise ValueError(f"unknown query kind {kind!r}")


def columns_of(query: Query) -> set[str]:
    if isinstance(query, (MatchQuery, PhraseQuery)):
        return {query.column}
    if isinstance(query, MultiMatchQuery):
        return set(query.columns)
    if isinstance(query, BoostQuery):
        return columns_of(query.positive) | columns_of(query.negative)
    return set().union(*(columns_of(q) for _, q in query.queries))


class _Plan:
    """Scores of a query over rows that carry the terms of each column as __t_<k>."""

    def __init__(self, docs: DataFrame | None, terms: dict[str, str], params: Params, length: str | None = None, total: tuple[int, int] | None = None):
        """length, total: the column of documents' lengths, and documents and tokens of all, where docs are a part."""
        self.docs, self.terms, self.params, self.length, self.total = docs, terms, params, length, total
        self.groups: dict[int, list[list[str]]] = {}
        self.stats: dict[str, dict] = {}

    def _leaves(self, q: Query):
        if isinstance(q, (MatchQuery, PhraseQuery)):
            yield q
        elif isinstance(q, MultiMatchQuery):
            if not hasattr(q, "parts"):
                q.parts = [MatchQuery(q.query, c, 1.0 if q.boosts is None else q.boosts[k], operator=q.operator) for k, c in enumerate(q.columns)]
            yield from q.parts
        elif isinstance(q, BoostQuery):
            yield from self._leaves(q.positive)
            yield from self._leaves(q.negative)
        else:
            for _, x in q.queries:
                yield from self._leaves(x)

    def expand(self, query: Query, vocabulary: DataFrame | None = None) -> set[str]:
        """The terms of all leaves. vocabulary: (t) of the only column; else terms come from docs."""
        for leaf in self._leaves(query):
            tokens = analyzer.tokenize(leaf.query, self.params)
            if isinstance(leaf, MatchQuery) and leaf.fuzziness:
                self.groups[id(leaf)] = self._expand(leaf, [t for t, _ in tokens], vocabulary)
            else:
                self.groups[id(leaf)] = [[t] for t, _ in tokens]
            leaf.at = [p for _, p in tokens]
        return {t for leaf in self._leaves(query) for g in self.groups[id(leaf)] for t in g}

    def prepare(self, query: Query) -> None:
        """Expand the terms of all leaves, where that isn't done, and count them in one pass."""
        leaves = list(self._leaves(query))
        if any(id(leaf) not in self.groups for leaf in leaves):
            self.expand(query)
        wanted = {c: sorted({t for leaf in leaves if leaf.column == c for g in self.groups[id(leaf)] for t in g}) for c in {leaf.column for leaf in leaves}}
        aggs = []
        for c, ts in wanted.items():
            arr = F.col(self.terms[c])
            aggs += [F.count(arr).alias(f"n|{c}"), F.sum(F.size(arr)).alias(f"l|{c}")]
            aggs += [F.count_if(_has(arr, t)).alias(f"{k}|{c}") for k, t in enumerate(ts)]
        row = self.docs.agg(*aggs).first() if aggs else {}
        for c, ts in wanted.items():
            n, tokens = self.total or (row[f"n|{c}"], row[f"l|{c}"] or 0)
            self.stats[c] = {"n": n, "avgdl": tokens / n if n else 0.0, "df": {t: row[f"{k}|{c}"] for k, t in enumerate(ts)}}

    def _expand(self, leaf: MatchQuery, words: list[str], vocabulary: DataFrame | None) -> list[list[str]]:
        """Terms of the column within the edits, in order, from one budget for all words."""
        if vocabulary is None:
            vocabulary = self.docs.select(F.explode(F.transform(self.terms[leaf.column], lambda x: x["t"])).alias("t"))
        near = lambda w: (F.levenshtein("t", F.lit(w), leaf.fuzziness) >= 0) & F.startswith("t", F.lit(w[: leaf.prefix_length]))
        found = vocabulary.where(reduce(lambda a, b: a | b, map(near, words), F.lit(False))).distinct()
        left, out = leaf.max_expansions, []
        for w in words:
            got = [r["t"] for r in found.where(near(w)).orderBy("t").limit(left).collect()]  # max_expansions at most
            left -= len(got)
            out.append(got)
        return out

    def _weight(self, column: str, term: str) -> Column:
        s, arr = self.stats[column], F.col(self.terms[column])
        df = s["df"][term]
        idf = math.log((s["n"] - df + 0.5) / (df + 0.5) + 1)
        f = F.size(F.filter(arr, lambda x: x["t"] == term)).cast("double")
        length = F.col(self.length) if self.length else F.size(arr)
        norm = K1 * (1 - B + B * length / F.lit(float(s["avgdl"]) or 1.0))
        return F.when(f > 0, F.lit(idf * (K1 + 1)) * f / (f + norm)).otherwise(0.0)

    def score(self, q: Query) -> Column:
        """The row's score; null where the query doesn't match it."""
        if isinstance(q, (MatchQuery, PhraseQuery)):
            return self._leaf(q)
        if isinstance(q, MultiMatchQuery):
            parts = [self._leaf(p) for p in self._leaves(q)]
            return F.greatest(*parts) if len(parts) > 1 else parts[0]
        if isinstance(q, BoostQuery):
            return self.score(q.positive) - F.lit(float(q.negative_boost)) * F.coalesce(self.score(q.negative), F.lit(0.0))
        must, should, never = ([self.score(x) for x in part] for part in (q.must, q.should, q.must_not))
        if must:
            total = reduce(lambda a, b: a + b, must)
            for s in should:
                total = total + F.coalesce(s, F.lit(0.0))
        else:
            total = F.when(reduce(lambda a, b: a | b, [s.isNotNull() for s in should]), reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in should]))
        for s in never:
            total = F.when(s.isNull(), total)
        return total

    def _leaf(self, q) -> Column:
        groups = self.groups[id(q)]
        arr = F.col(self.terms[q.column])
        if not groups:
            return F.lit(None).cast("double")
        has = lambda ts: F.exists(arr, lambda x: x["t"].isin(*ts)) if ts else F.lit(False)
        total = reduce(lambda a, b: a + b, [self._weight(q.column, t) for g in groups for t in g], F.lit(0.0))
        if isinstance(q, PhraseQuery):
            return F.when(self._phrase(arr, [g[0] for g in groups], q.at, q.slop), total)
        if q.operator == "and":
            hit = reduce(lambda a, b: a & b, [has(g) for g in groups])
        else:
            every = [t for g in groups for t in g]
            hit = has(every)
        return F.when(hit, total * F.lit(float(q.boost)))

    @staticmethod
    def _phrase(arr: Column, ts: list[str], at: list[int], slop: int) -> Column:
        """Every term at its place from one base; with slop each up to that much later than the one before."""
        shifted = [_places(arr, t, p) for t, p in zip(ts, at, strict=True)]
        found = shifted[0]
        for s in shifted[1:]:
            found = _within(s, found, slop) if slop else F.array_intersect(found, s)
        return F.size(found) > 0


def _has(arr: Column, term: str) -> Column:
    return F.exists(arr, lambda x: x["t"] == term)


def _places(arr: Column, term: str, less: int) -> Column:
    return F.transform(F.filter(arr, lambda x: x["t"] == term), lambda x: x["p"] - less)


def _within(places: Column, before: Column, slop: int) -> Column:
    return F.filter(places, lambda r: F.exists(before, lambda b: (r >= b) & (r <= b + slop)))


def search(df: DataFrame, query: Query | str | dict, limit: int | None = None, key: str | None = None, params: Params = analyzer.PLAIN, terms: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """df's rows that match, with _score; the best `limit` of them by score and key.

    A plain string asks all text columns (or `columns`). terms: columns that hold analysed terms already.
    Rows with a null text have no document.
    """
    if isinstance(query, dict):
        query = from_json(query)
    if isinstance(query, str):
        query = from_json(query) if query.lstrip().startswith('{"') else MultiMatchQuery(query, columns or [c for c, t in df.dtypes if t == "string"])
    used = sorted(columns_of(query))
    if not used:
        raise ValueError("no text column to search")
    names = dict(terms or {})
    made = {c: f"__t_{k}" for k, c in enumerate(used) if c not in names}
    docs = df.withColumns({name: analyzer.terms(F.col(c), params) for c, name in made.items()})
    plan = _Plan(docs, names | made, params)
    plan.prepare(query)
    found = docs.withColumn("_score", plan.score(query)).where(F.col("_score").isNotNull()).drop(*made.values())
    if limit is not None:
        found = found.orderBy(F.desc("_score"), *([key] if key else [])).limit(limit)
    return found


def list_elements(df: DataFrame, column: str) -> DataFrame:
    """A row an element of a list of texts, with _doc_index, for searches by element."""
    return df.select("*", F.posexplode(column).alias("_doc_index", "__e")).drop(column).withColumnRenamed("__e", column)


DOCS = 1000  # documents whose postings a Python worker makes at a time


def _grouped(terms: pa.ListArray) -> tuple[pa.Array, pa.ListArray]:
    """Each document's number of tokens and its terms with their positions in order."""
    dl = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
    t, p = terms.flatten().flatten()
    known, place = t.dictionary_encode("encode"), p.to_numpy()
    code, of = known.indices.to_numpy(), np.repeat(np.arange(len(dl)), dl)
    order = np.lexsort((place, code, of))
    code, of = code[order], of[order]
    first = np.flatnonzero(np.r_[np.ones(min(len(of), 1), bool), (np.diff(of) != 0) | (np.diff(code) != 0)])
    positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(of)].astype(np.int32)), pa.array(place[order]))
    posts = pa.StructArray.from_arrays([known.dictionary.take(pa.array(code[first])), positions], names=["term", "positions"])
    ends = np.r_[0, np.bincount(of[first], minlength=len(dl)).cumsum()].astype(np.int32)
    return pa.array(dl, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), posts)


def _documents(df: DataFrame, column: str, p: Params) -> DataFrame:
    """(_rowaddr, dl, posts) of the rows with a text; a document's postings are made from it alone, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                b = whole.slice(at, DOCS)
                yield pa.RecordBatch.from_arrays([b[0], *_grouped(b[1] if p.native else analyzer.analyzed(b[1], p))], names=["_rowaddr", "dl", "posts"])

    given = analyzer.terms(F.col(column), p) if p.native else F.col(column)
    return df.where(F.col(column).isNotNull()).select("_rowaddr", given.alias("given")).mapInArrow(run, "_rowaddr long, dl int, posts array<struct<term: string, positions: array<int>>>")


def _lengths_and(df: DataFrame, column: str, p: Params, wanted: set[str]) -> DataFrame:
    """(_rowaddr, dl, terms) of the rows with a text: of the terms only those wanted leave the analysis."""
    df = df.where(F.col(column).isNotNull())
    if p.native:
        return df.select("_rowaddr", analyzer.terms(F.col(column), p).alias("terms")).select("_rowaddr", F.size("terms").alias("dl"), F.filter("terms", lambda x: x["t"].isin(sorted(wanted))).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dl, found = [], []
            for text in b[1]:
                tokens = analyzer.tokenize(text.as_py(), p)
                dl.append(len(tokens))
                found.append([{"t": t, "p": at} for t, at in tokens if t in wanted])
            kind = pa.list_(pa.struct([("t", pa.string()), ("p", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b[0], pa.array(dl, pa.int32()), pa.array(found, kind)], names=["_rowaddr", "dl", "terms"])

    return df.select("_rowaddr", column).mapInArrow(run, "_rowaddr long, dl int, terms array<struct<t: string, p: int>>")


FETCHED = 10_000  # rows found by an index that go by the driver, to know their fragments; of more the table is joined whole


class TextIndex:
    """Postings of a column of a table version, in order of term, and the lengths of its documents."""

    def __init__(self, table, entry: dict):
        self.table, self.entry = table, entry
        self.params = Params(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry["params"].items()})

    @classmethod
    def build(cls, table, column: str, name: str | None = None, **params) -> "TextIndex":
        p = Params(**params)
        path = f"_indices/{uuid.uuid4().hex}"
        df = stash(_documents(table.to_df(system=True, columns=[column]), column, p))
        df.select("_rowaddr", "dl").write.parquet(table.store.at(f"{path}/lengths"))
        posts = df.select("_rowaddr", "dl", F.inline("posts")).select("term", "_rowaddr", "dl", "positions")
        posts.repartitionByRange("term", "_rowaddr").sortWithinPartitions("term", "_rowaddr").write.parquet(table.store.at(f"{path}/postings"))
        unstash(df)
        from brindle.plans.indexes import register

        kept = {k: v for k, v in p.__dict__.items()}
        return cls(table, register(table, {"name": name or f"{column}_idx", "column": column, "kind": "INVERTED", "path": path, "params": kept}))

    def _of_live(self, part: str, covered: list[int]) -> DataFrame:
        """A side table without rows of other fragments and deleted ones."""
        table = self.table
        df = table.spark.read.parquet(table.store.at(f"{self.entry['path']}/{part}")).where(F.shiftright("_rowaddr", 32).isin(covered))
        if table.manifest.deletions:
            gone = table.spark.read.parquet(*[table.store.at(d["path"]) for d in table.manifest.deletions]).select(F.col("addr").alias("_rowaddr"))
            df = df.join(gone, "_rowaddr", "left_anti")
        return df

    def search(self, query: Query | str | dict, limit: int | None = None, fast: bool = False) -> DataFrame:
        """Rows with _score: by postings, and rows of uncovered fragments analysed now unless fast."""
        from brindle.plans.indexes import Planner

        table, column = self.table, self.entry["column"]
        query = MatchQuery(query, column) if isinstance(query, str) else from_json(query) if isinstance(query, dict) else query
        if columns_of(query) != {column}:
            return search(table.to_df(system=True), query, limit, "_rowid", self.params)
        plan = _Plan(None, {}, self.params)
        if not self.params.with_position and any(isinstance(q, PhraseQuery) for q in plan._leaves(query)):
            raise ValueError("position is not found but required for phrase queries, try recreating the index with position")
        live = {f.id for f in table.manifest.fragments}
        covered = sorted(Planner(table)._covered(self.entry) & live)
        rest = [] if fast else sorted(live - set(covered))
        postings, lengths = self._of_live("postings", covered), self._of_live("lengths", covered).select("dl")
        vocabulary = postings.select(F.col("term").alias("t"))
        fresh = None
        if rest:
            fresh = table.to_df(system=True, fragments=rest, columns=[column])
            if any(isinstance(q, MatchQuery) and q.fuzziness for q in plan._leaves(query)):  # its terms are known by all words only
                vocabulary = vocabulary.unionByName(fresh.select(F.explode(F.transform(analyzer.terms(F.col(column), self.params), lambda x: x["t"])).alias("t")))
        terms = plan.expand(query, vocabulary)
        if rest:
            fresh = stash(_lengths_and(fresh, column, self.params, terms))
            lengths = lengths.unionByName(fresh.select("dl"))
        total = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        own = postings.where(F.col("term").isin(sorted(terms)))
        docs = own.groupBy("_rowaddr").agg(F.first("dl").alias("dl"), F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(F.col("term").alias("t"), p.alias("p"))))).alias("terms"))
        if fresh is not None:
            docs = docs.unionByName(fresh.where("size(terms) > 0"))
        plan.docs, plan.terms, plan.length, plan.total = stash(docs), {column: "terms"}, "dl", tuple(total)
        plan.prepare(query)
        best = plan.docs.select("_rowaddr", plan.score(query).alias("_score")).where("_score IS NOT NULL")
        if limit is None:
            return table.to_df(system=True, fragments=covered + rest).join(best, "_rowaddr")
        # Ties at the edge stay until the rows' ids decide among them.
        edge = best.orderBy(F.desc("_score")).limit(limit).agg(F.min("_score")).first()[0]
        best = best.where(F.col("_score") >= F.lit(edge)) if edge is not None else best
        few = best.limit(FETCHED + 1).collect()
        fragments = covered + rest
        if len(few) <= FETCHED:
            best = F.broadcast(table.spark.createDataFrame([(r[0], r[1]) for r in few], "_rowaddr long, _score double"))
            fragments = sorted({r[0] >> 32 for r in few})
        return table.to_df(system=True, fragments=fragments).join(best, "_rowaddr").orderBy(F.desc("_score"), "_rowid").limit(limit)

    def postings(self) -> DataFrame:
        """(term, _rowaddr, tf, positions, dl)."""
        rows = self.table.spark.read.parquet(self.table.store.at(f"{self.entry['path']}/postings"))
        return rows.select("term", "_rowaddr", F.size("positions").cast("long").alias("tf"), "positions", "dl")
