"""Nearest neighbours: exact, batched, multivector, and by inverted file.

Distances are made in numpy over Arrow batches. Every batch keeps only its own best k, so what reaches the
final sort is a few rows a batch and no vector leaves its task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import emit
from brindle.functions.dialect import Unsupported

METRICS = ("l2", "cosine", "dot", "hamming")
_ALIASES = {"euclidean": "l2", "ip": "dot"}
#: The names of a search's settings.
KEYS = {
    "column", "q", "k", "metric", "nprobes", "minimum_nprobes", "maximum_nprobes", "refine_factor", "use_index", "ef", "query_parallelism", "approx_mode", "distance_range",
}
SAMPLE_RATE, ROUNDS = 256, 50  # vectors a centroid that training reads, and k-means rounds at most
CANDIDATES = 5_000_000  # distances of one step


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) distances: squared L2, 1 - cosine, 1 - dot, or differing bits."""
    if metric == "hamming":
        return np.bitwise_count(x[None, :, :] ^ q[:, None, :]).sum(2).astype(np.float64)
    x, q = x.astype(np.float64, copy=False), q.astype(np.float64, copy=False)
    if metric == "l2":
        return np.stack([((x - row) ** 2).sum(1) for row in q])
    dot = q @ x.T
    if metric == "dot":
        return 1 - dot
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - dot / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])


def _matrix(col: pa.Array, width: int, binary: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the rows that have one of the width, and those rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col) if pa.types.is_binary(col.type) else pa.compute.list_value_length(col), -1))
    rows = np.flatnonzero(sizes == width)
    if pa.types.is_binary(col.type):
        return np.frombuffer(b"".join(col.take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, width), rows
    flat = np.asarray(col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False))
    return (flat.astype(np.int64).astype(np.uint8) if binary else flat).reshape(-1, width), rows


def validate(spec: dict, t: T.DataType) -> dict:
    """The search's settings, checked."""
    unknown = set(spec) - KEYS
    if unknown:
        raise TypeError(f"unknown search settings: {sorted(unknown)}")
    spec = dict(spec)
    spec["k"] = 10 if spec.get("k") is None else spec["k"]
    if not isinstance(spec["k"], int) or spec["k"] <= 0:
        raise ValueError("k must be a whole number above 0")
    for n in ("nprobes", "minimum_nprobes", "maximum_nprobes", "refine_factor", "ef"):
        if spec.get(n) is not None and spec[n] < 1:
            raise ValueError(f"{n} must be above 0")
    binary = isinstance(t, T.BinaryType) or isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.ByteType, T.ShortType))
    metric = spec.get("metric")
    metric = _ALIASES.get(str(metric).lower(), str(metric).lower()) if metric else "hamming" if binary else "l2"
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if binary != (metric == "hamming"):
        raise ValueError("byte vectors are compared by hamming distance, and only they")
    spec["metric"], spec["binary"] = metric, binary
    return spec


def _queries(spec: dict, multi: bool) -> tuple[np.ndarray, bool]:
    q = np.asarray(spec["q"], np.float64)
    batch = q.ndim == 2 and not multi
    q = q if q.ndim == 2 else q[None, :]
    if spec["binary"]:
        if (q != np.floor(q)).any() or (q < 0).any() or (q > 255).any():
            raise ValueError("a byte vector holds whole numbers from 0 to 255")
        q = q.astype(np.uint8)
    return q, batch


def nearest(df: DataFrame, spec: dict, key: str | list[str]) -> DataFrame:
    """The k nearest rows of each query with _distance (and query_index where q has several queries).

    Smaller distances first, NaN last, ties by key. Rows with a null vector, or one of another width, are left out.
    """
    name = emit.resolve(spec["column"], df.columns)
    t = df.schema[name].dataType
    spec = validate(spec | {"column": name}, t)
    multi = isinstance(t, T.ArrayType) and isinstance(t.elementType, T.ArrayType)
    q, batch = _queries(spec, multi)
    width, k, metric, bounds = q.shape[1], spec["k"], spec["metric"], spec.get("distance_range") or (None, None)
    dim = (df.schema[name].metadata or {}).get("dim")
    if dim and dim != width:
        raise ValueError(f"the query has {width} dimensions, the column {dim}")
    keys = [key] if isinstance(key, str) else list(key)
    n = 1 if multi else len(q)
    schema = T.StructType([T.StructField("__q", T.IntegerType()), *[df.schema[c] for c in keys], T.StructField("_distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors = b.column(len(keys))
            if multi:
                d, rows = _multivector(vectors, q, metric)
                d = [d]
            else:
                x, rows = _matrix(vectors, width, spec["binary"])
                step = max(1, CANDIDATES // max(1, x.size, len(x)))
                d = (distances(x, q[a : a + step], metric) for a in range(0, n, step)) if len(rows) else [np.zeros((n, 0))]
            at, of, value = [], [], []
            for j, far in enumerate(row for part in d for row in part):  # few queries' distances are held at a time
                row = np.where(np.isnan(far), np.inf, far)
                ok = np.ones(len(row), bool)
                if bounds[0] is not None:
                    ok &= ~(far < bounds[0])
                if bounds[1] is not None:
                    ok &= ~(far >= bounds[1])
                ok = np.flatnonzero(ok)
                if len(ok) > k:  # ties at the edge stay, so that the key decides among them
                    edge = np.partition(row[ok], k - 1)[k - 1]
                    ok = ok[row[ok] <= edge]
                at.append(rows[ok])
                of.append(np.full(len(ok), j, np.int32))
                value.append(far[ok])
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), *(b.column(c).take(pa.array(at)) for c in range(len(keys))), pa.array(np.concatenate(value), pa.float64())], names=schema.fieldNames())

    best = df.select(*[emit.quote(c) for c in keys], emit.quote(name)).mapInArrow(run, schema)
    order = [F.col("_distance").asc_nulls_last(), *[F.col(emit.quote(c)) for c in keys]]
    if n == 1:
        best = best.orderBy(*order).limit(k)
    else:
        from pyspark.sql import Window

        best = best.withColumn("__r", F.row_number().over(Window.partitionBy("__q").orderBy(*order))).where(F.col("__r") <= k).drop("__r")
    best = best.withColumnRenamed("__q", "query_index") if batch else best.drop("__q")
    return df.join(F.broadcast(best) if k * n <= 1_000_000 else best, keys)


def _multivector(col: pa.Array, q: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Each query vector's least distance to a row's vectors, summed; rows without vectors are left out."""
    out, rows = [], []
    for k, row in enumerate(col.to_pylist()):
        if row:
            out.append(distances(np.asarray(row, np.float64), q, metric).min(1).sum())
            rows.append(k)
    return np.array([out], np.float64), np.array(rows, np.int64)


# -- inverted file ------------------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from a spread start; an empty cluster takes the farthest vector."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float64)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)[None, :]
        of, far = d.argmin(1), d.min(1)
        count = np.bincount(of, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, of, x)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        empty = np.flatnonzero(count == 0)
        new[empty] = x[np.argsort(-far)[: len(empty)]]
        if np.allclose(new, centre):
            return new
        centre = new
    return centre


def train_ivf(df: DataFrame, column: str, partitions: int | None = None, metric: str = "l2", sample_rate: int = SAMPLE_RATE, target: int = 8192) -> np.ndarray:
    """Centroids from a bounded sample: sample_rate vectors a centroid. Null and non-finite vectors are left out."""
    vectors = df.select(F.col(emit.quote(column)).alias("v")).where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    n = vectors.count()
    if not n:
        raise ValueError("no vector to train on")
    partitions = partitions or min(4096, max(1, n // target))
    want = min(n, partitions * sample_rate)
    rows = vectors.select("v", F.xxhash64(F.col("v").cast("array<double>")).alias("h")).orderBy("h").limit(want).toArrow()
    x = np.array(rows["v"].to_pylist(), np.float64)
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return kmeans(x, partitions)


def assign(df: DataFrame, column: str, centroids: np.ndarray, metric: str = "l2", name: str = "_part") -> DataFrame:
    """df with each vector's centroid; null where it has no vector."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])
    at, width = df.columns.index(column), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = _matrix(b.column(at), width, False)
            x = x.astype(np.float64)
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            part = np.full(b.num_rows, -1, np.int32)
            for a in range(0, len(rows), 8192):
                y = x[a : a + 8192]
                part[rows[a : a + 8192]] = (-2 * y @ centroids.T + (centroids**2).sum(1)[None, :]).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, mask=part < 0)], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def probes(centroids: np.ndarray, q: np.ndarray, n: int, metric: str = "l2") -> list[int]:
    if metric == "cosine":
        q = q / max(np.linalg.norm(q), 1e-12)
    d = distances(centroids, np.asarray(q, np.float64)[None, :], "dot" if metric == "dot" else "l2")[0]
    return np.argsort(d, kind="stable")[:n].tolist()


class Quantizer:
    """Vectors as bytes. PQ: the nearest of 256 codewords for each run of dimensions; SQ: each dimension in 256 steps."""

    def __init__(self, kind: str, books: np.ndarray):
        self.kind, self.books = kind, books  # PQ: (runs, codewords, width); SQ: (2, dimensions), low and step

    @classmethod
    def train(cls, x: np.ndarray, kind: str, sub_vectors: int | None = None) -> "Quantizer":
        if kind == "SQ":
            low = x.min(0)
            return cls(kind, np.stack([low, np.maximum((x.max(0) - low) / 255, 1e-12)]))
        d = x.shape[1]
        m = sub_vectors or next(m for m in (d // 8, d // 4, d // 2, 1) if m and d % m == 0)
        if d % m:
            raise ValueError(f"{d} dimensions don't split into {m} sub-vectors")
        books = [kmeans(part, 256, 12) for part in np.split(x, m, axis=1)]
        return cls(kind, np.stack([np.r_[c, np.repeat(c[:1], 256 - len(c), axis=0)] for c in books]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "SQ":
            return np.clip(np.rint((x - self.books[0]) / self.books[1]), 0, 255).astype(np.uint8)
        parts = np.split(x, len(self.books), axis=1)
        return np.stack([(-2 * p @ c.T + (c**2).sum(1)[None, :]).argmin(1) for p, c in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        if self.kind == "SQ":
            return self.books[0] + codes * self.books[1]
        return np.concatenate([c[codes[:, k]] for k, c in enumerate(self.books)], axis=1)


def _sample(df: DataFrame, column: str, rows: int, metric: str) -> np.ndarray:
    got = df.where(F.col(emit.quote(column)).isNotNull()).select(F.col(emit.quote(column)).cast("array<double>").alias("v")).orderBy(F.xxhash64("v")).limit(rows).toArrow()
    x = np.array(got["v"].to_pylist(), np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


class IvfIndex:
    """Vectors of a table version in files partitioned by centroid; a search reads the probed parts and the rows found.

    IVF_FLAT parts hold the vectors, and answers are exact over them. IVF_PQ and IVF_SQ parts hold quantised codes:
    distances are those of the decoded vectors, or exact ones of k * refine_factor candidates that are read again. The
    HNSW and RQ kinds are kept as IVF_SQ and IVF_PQ: a graph walk is no gain over the scan of a part by many tasks.
    """

    def __init__(self, table, entry: dict):
        self.table, self.entry = table, entry
        self.model = json.loads(table.store.read(f"{entry['path']}/model.json"))
        self.centroids = np.array(self.model["centroids"])
        self.quantizer = Quantizer(self.model["quantizer"], np.array(self.model["books"])) if self.model.get("quantizer") else None

    @classmethod
    def build(cls, table, column: str, name: str | None = None, metric: str = "l2", partitions: int | None = None, sample_rate: int = SAMPLE_RATE, kind: str = "IVF_FLAT", sub_vectors: int | None = None) -> "IvfIndex":
        df = table.to_df(system=True, columns=[column]).select("_rowaddr", column)
        centroids = train_ivf(df, column, partitions, metric, sample_rate)
        path = f"_indices/{uuid.uuid4().hex}"
        model = {"centroids": centroids.tolist(), "metric": metric}
        made = assign(df, column, centroids, metric).where("_part IS NOT NULL")
        quantizer = None
        if kind.endswith(("PQ", "RQ", "SQ")):
            quantizer = Quantizer.train(_sample(df, column, 256 * sample_rate // 4, metric), "SQ" if kind.endswith("SQ") else "PQ", sub_vectors)
            model |= {"quantizer": quantizer.kind, "books": quantizer.books.tolist()}
            made = _encoded(made, column, quantizer, centroids.shape[1], metric)
        made.repartition("_part", F.pmod(F.xxhash64("_rowaddr"), F.lit(8))).write.partitionBy("_part").parquet(table.store.at(f"{path}/parts"))
        table.store.replace(f"{path}/model.json", json.dumps(model))
        from brindle.plans.indexes import register

        return cls(table, register(table, {"name": name or f"{column}_idx", "column": column, "kind": kind, "path": path, "metric": metric}))

    def _parts(self) -> DataFrame:
        return self.table.spark.read.parquet(self.table.store.at(f"{self.entry['path']}/parts"))

    def partition_sizes(self) -> DataFrame:
        return self._parts().groupBy("_part").count()

    def partition(self, number: int) -> DataFrame:
        """The entries of one part: _rowaddr, and the vector or its code."""
        return self._parts().where(F.col("_part") == number).drop("_part")

    def _live(self, parts: list[int], covered: list[int]) -> DataFrame:
        """(_rowaddr, vector) of the parts' live rows; a code is decoded."""
        table, column = self.table, self.entry["column"]
        probed = self._parts().where(F.col("_part").isin(parts)).drop("_part").where(F.shiftright("_rowaddr", 32).isin(covered))
        if table.manifest.deletions:
            gone = table.spark.read.parquet(*[table.store.at(d["path"]) for d in table.manifest.deletions]).select(F.col("addr").alias("_rowaddr"))
            probed = probed.join(gone, "_rowaddr", "left_anti")
        if self.quantizer is None:
            return probed.select("_rowaddr", column)
        quantizer, width = self.quantizer, len(self.quantizer.books) if self.quantizer.kind == "PQ" else self.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, width)
                x = quantizer.decode(codes).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["_rowaddr", column])

        return probed.select("_rowaddr", "code").mapInArrow(run, T.StructType([T.StructField("_rowaddr", T.LongType()), T.StructField(column, T.ArrayType(T.FloatType()))]))

    def search(self, spec: dict, filter: str | None = None, fast: bool = False) -> DataFrame:
        """Nearest rows: of the probed parts, and of the fragments that the index doesn't cover unless fast.

        nprobes parts are probed, or minimum_nprobes and twice as many each time while fewer than k rows are found, to
        maximum_nprobes. k is the driver's bound: so many addresses are fetched, and only their fragments are read.
        """
        from brindle.plans.indexes import Planner

        table, column = self.table, self.entry["column"]
        spec = validate(spec | {"column": column}, table.schema[column].dataType)
        plain = {k: v for k, v in spec.items() if k in KEYS}
        if spec["metric"] != self.model["metric"]:
            df = table.to_df(system=True)
            return nearest(df.where(emit.condition(filter, df.schema)) if filter else df, plain, "_rowid")
        q, batch = _queries(spec, False)
        if batch:
            raise Unsupported("search the index with one query at a time")
        live = [f.id for f in table.manifest.fragments]
        covered = sorted(Planner(table)._covered(self.entry) & set(live))
        rest = [] if fast else [f for f in live if f not in set(covered)]
        allowed = None
        if filter:
            every = table.to_df(system=True, fragments=covered + rest)
            allowed = every.where(emit.condition(filter, every.schema)).select("_rowaddr")
        fixed = spec.get("nprobes")
        n = fixed or spec.get("minimum_nprobes") or max(1, round(len(self.centroids) ** 0.5))
        most = min(len(self.centroids), n if fixed else spec.get("maximum_nprobes") or len(self.centroids))
        wide = spec["k"] * (spec.get("refine_factor") or 1) if self.quantizer else spec["k"]
        while True:
            n = min(n, most)
            vectors = self._live(probes(self.centroids, q[0], n, self.model["metric"]), covered)
            if rest and not self.quantizer:
                vectors = vectors.unionByName(table.to_df(system=True, fragments=rest, columns=[column]).select("_rowaddr", column))
            vectors = vectors if allowed is None else vectors.join(allowed, "_rowaddr", "left_semi")
            best = nearest(vectors, plain | {"k": wide}, "_rowaddr").select("_rowaddr", "_distance").collect()
            if n == most or len(best) >= spec["k"]:
                break
            n *= 2
        if self.quantizer and (rest or spec.get("refine_factor")):
            # Candidates' own vectors, and those of rows that have no code.
            some = table.to_df(system=True, fragments=sorted({r[0] >> 32 for r in best} | set(rest)), columns=[column])
            own = some.where(F.shiftright("_rowaddr", 32).isin(rest)) if rest else some.limit(0)
            own = own if allowed is None else own.join(allowed, "_rowaddr", "left_semi")
            known = table.spark.createDataFrame([(r[0], r[1]) for r in best], "_rowaddr long, _distance double")
            if spec.get("refine_factor"):
                own = own.unionByName(some.join(F.broadcast(known.select("_rowaddr")), "_rowaddr", "left_semi")).dropDuplicates(["_rowaddr"])
                best = nearest(own.select("_rowaddr", column), plain, "_rowaddr").select("_rowaddr", "_distance").collect()
            else:
                more = nearest(own.select("_rowaddr", column), plain, "_rowaddr").select("_rowaddr", "_distance")
                best = known.unionByName(more).orderBy(F.col("_distance").asc_nulls_last(), "_rowaddr").limit(spec["k"]).collect()
        found = table.spark.createDataFrame([(r[0], r[1]) for r in best], "_rowaddr long, _distance double")
        return table.to_df(system=True, fragments=sorted({r[0] >> 32 for r in best})).join(F.broadcast(found), "_rowaddr")


def _encoded(df: DataFrame, column: str, quantizer: Quantizer, width: int, metric: str) -> DataFrame:
    """(_rowaddr, _part, code) of assigned vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = _matrix(b.column(2), width, False)
            x = x.astype(np.float64)
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            code = quantizer.encode(x) if len(x) else np.zeros((0, 1), np.uint8)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([c.tobytes() for c in code], pa.binary())], names=["_rowaddr", "_part", "code"])

    return df.select("_rowaddr", "_part", column).mapInArrow(run, "_rowaddr long, _part int, code binary")


# -- binary signatures --------------------------------------------------------------------------------------


def sign_bits(column: str) -> Column:
    """A vector's signs as one long: bit k is set if element k is above zero (64 elements at most)."""
    return F.expr(f"aggregate(transform(slice({emit.quote(column)}, 1, 64), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")


def hamming_components(df: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """(key, component): rows whose signatures are linked by differences of at most `most` bits, smallest key as class.

    Equal signatures are one node. Of most + 2 blocks two signatures within `most` bits share two whole, so rows meet by
    equi-joins on pairs of blocks, which are long, and never all with all.
    """
    from brindle.operators.graph import connected_components

    nodes = df.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("b")).agg(F.min(key).alias("low"))
    cuts = [64 * k // (most + 2) for k in range(most + 3)]
    block = [F.shiftrightunsigned(F.shiftleft("b", cuts[k]), 64 - (cuts[k + 1] - cuts[k])) for k in range(most + 2)]
    both = [F.struct(F.lit(i * (most + 2) + j).alias("n"), block[i].alias("v"), block[j].alias("w")) for i in range(most + 2) for j in range(i + 1, most + 2)]
    rows = nodes.select("b", F.explode(F.array(*both)).alias("x")).select("b", "x.n", "x.v", "x.w")
    pairs = rows.alias("l").join(rows.alias("r"), ["n", "v", "w"]).where("l.b < r.b").where(F.bit_count(F.col("l.b").bitwiseXOR(F.col("r.b"))) <= most)
    roots = connected_components(pairs.select(F.col("l.b").alias("u"), F.col("r.b").alias("v")))
    named = nodes.join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    low = named.groupBy("root").agg(F.min("low").alias("component"))
    return df.select(key, bits).join(named.join(low, "root").select(F.col("b").alias(bits), "component"), bits, "left").select(key, F.coalesce("component", F.col(key)).alias("component"))


def recall(df: DataFrame, index: IvfIndex, queries: np.ndarray, k: int = 10, key: str = "_rowid", **spec) -> float:
    """Share of the exact neighbours that the index finds, over a bounded set of queries."""
    hit = 0
    for q in queries:
        exact = {r[0] for r in nearest(df, {"column": index.entry["column"], "q": q, "k": k, "metric": index.model["metric"]}, key).select(key).collect()}
        hit += len(exact & {r[0] for r in index.search({"q": q, "k": k, **spec}).select(key).collect()})
    return hit / (k * len(queries))


QUERY_BLOCK = 4096  # queries that go to the executors at a time


def nearest_rows(df: DataFrame, queries: DataFrame, column: str, key: str, k: int = 10, metric: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, key, _distance, rank): the k nearest rows of every row of queries (key, column), in blocks of queries."""
    from pyspark.sql import Window

    n = queries.count()
    parts = []
    for b in range(max(1, -(-n // block))):
        mine = queries.where(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // block)))) == b).select(key, column).orderBy(key).toArrow()  # about a block
        if not mine.num_rows:
            continue
        ids, q = mine[key].to_pylist(), np.array(mine[column].to_pylist(), np.float64)
        found = nearest(df.select(key, column), {"column": column, "q": q, "k": k, "metric": metric}, key).select("query_index", key, "_distance")
        names = df.sparkSession.createDataFrame(list(enumerate(ids)), "query_index int, query long")
        parts.append(found.join(F.broadcast(names), "query_index").select("query", key, "_distance"))
    if not parts:
        return df.sparkSession.createDataFrame([], "query long, key long, _distance double, rank int").withColumnRenamed("key", key)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.col("_distance").asc_nulls_last(), key)
    return out.withColumn("rank", F.row_number().over(w))
