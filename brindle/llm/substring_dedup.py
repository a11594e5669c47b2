"""Substring dedup over a sparse de Bruijn graph of the corpus.

Vertices are word runs of K words, sampled so that every window of 50 words holds at least one: the least of its own by
hash, its anchor. Edges are the token k-mers between a document's consecutive vertices, each with all words from the
one to the end of the other. A vertex that always has the same edge before and the same edge after it, in all
documents, is nonbranching; Spark joins compact the edges that such vertices link to paths. Documents then hold runs
of paths, and each run is verified against the words at the path's source, its smallest document and place. A window
inside a verified run whose anchor is nonbranching is decided by the source, since all its occurrences lie in runs of that
path. Windows anchored at a branch, those that leave their run, and those of paths that fail (their k-mers' hashes
collided) go one by one by 128-bit hash, so the result is that of comparing all windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.rows import join_counted, text_key
from brindle.session import scope, stash, unstash

WINDOW, K = 50, 26  # consecutive vertices are WINDOW - K + 1 < K words apart at most
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S29, _S32 = np.uint64(29), np.uint64(32)


class _Hashes(dict):
    """Word -> XXH64; emptied when it holds 300,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_HASHES = _Hashes()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + (b ^ (b >> _S29)) * _B
    x ^= x >> _S32
    x *= _C
    return x ^ (x >> _S29)


def _rolling(base: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all runs of each size, from those of runs of powers of two."""
    powers = [base]
    while 2 << (len(powers) - 1) <= max(sizes):
        step = 1 << (len(powers) - 1)
        powers.append(_mix(powers[-1][:-step], powers[-1][step:]))
    out = []
    for size in sizes:
        made, at = None, 0
        for p in range(len(powers) - 1, -1, -1):
            if size >> p & 1:
                part = powers[p][at : at + len(base) - size + 1]
                made, at = (part if made is None else _mix(made, part)), at + (1 << p)
        out.append(made)
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _anchors(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at least WINDOW words: hashes of all runs of K words, each window's anchor, and the vertices' places."""
    (runs,) = _rolling(hashes, (K,))
    runs = runs >> np.uint64(64 - bits)
    anchor = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - K + 1).argmin(axis=1) + np.arange(len(hashes) - WINDOW + 1)
    return runs, anchor, anchor[np.r_[True, anchor[1:] != anchor[:-1]]]


def _occurrences(bits: int):
    """(vertex, before, after, doc_id, tkey, pos): each vertex of a document with the edges at it; 0 where there is none."""
    names = ["vertex", "before", "after", "doc_id", "tkey", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[list[np.ndarray]] = [[] for _ in names]
            size = 0

            def out() -> pa.RecordBatch:
                cols = [np.concatenate(x) for x in held]
                return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in cols[:3]), *map(pa.array, cols[3:])], names=names)

            for doc, tkey, text in zip(b[0].to_pylist(), b[1].to_pylist(), b[2], strict=True):
                words = _words(text.as_py())
                if len(words) < WINDOW:
                    continue
                runs, _, places = _anchors(_word_hashes(words), bits)
                at, gap = runs[places], np.diff(places).astype(np.uint64)
                edge = _mix(_mix(at[:-1], at[1:]), gap) | np.uint64(1)
                none = np.zeros(1, np.uint64)
                for x, c in zip(held, (at, np.r_[none, edge], np.r_[edge, none], np.full(len(at), doc, np.int64), np.full(len(at), tkey, np.int64), places.astype(np.int32)), strict=True):
                    x.append(c)
                size += len(at)
                if size > 200_000:
                    yield out()
                    held, size = [[] for _ in names], 0
            if size:
                yield out()

    return run


def _digest(words: list[bytes]) -> tuple[int, int]:
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_FOUND = "doc_id long, tkey long, begin int, stop int, path long, h1 long, h2 long"


def _runs(bits: int, whole: bool):
    """Of documents with their repeated vertices (pos, path): the runs of paths with the digest of their words, and each
    window that is in no run, with both hashes and no path. Where `whole` is False the runs' windows come out as well:
    documents then carry the runs to be opened (pos being a run's begin and path its stop) and give those windows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, tkey, text, pos, path in zip(*(b[k].to_pylist() for k in range(5)), strict=True):
                words = _words(text)
                hashes = _word_hashes(words)
                n = len(words) - WINDOW + 1
                rows: list[tuple[int, int, int, int, int]] = []
                if whole:
                    _, anchor, places = _anchors(hashes, bits)
                    at = np.searchsorted(places, np.array(pos))
                    repeated, plain = np.zeros(len(places), bool), np.zeros(len(places), bool)
                    repeated[at], plain[at] = True, [p is not None for p in path]
                    of = np.searchsorted(places, anchor)
                    inside = np.zeros(n, bool)
                    names = dict(zip(at.tolist(), path, strict=True))
                    edges = np.flatnonzero(np.diff(np.r_[0, plain, 0]))
                    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                        # The run reaches from the vertex before the nonbranching ones to the one after them.
                        begin, stop = int(places[first - 1]), int(places[last]) + K
                        if stop - begin >= WINDOW:
                            inside[begin : stop - WINDOW + 1] = True
                            rows.append((begin, stop, names[first], *_digest(words[begin:stop])))
                    # At its ends a run has windows anchored at a vertex that other documents leave by another edge.
                    opened = np.flatnonzero(repeated[of] & ~(inside & plain[of]))
                else:
                    opened = np.unique(np.concatenate([np.arange(x, y - WINDOW + 1) for x, y in zip(pos, path, strict=True)]))
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.int64()), pa.array([tkey] * len(rows), pa.int64()), *cols], names=[x.split()[0] for x in _FOUND.split(", ")])
                if m := len(opened):
                    one, two = (_rolling(h, (WINDOW,))[0][opened].view(np.int64) for h in (hashes, _mix(hashes, hashes ^ _C)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, doc, np.int64)), pa.array(np.full(m, tkey, np.int64)), pa.array(opened.astype(np.int32)), pa.array((opened + WINDOW).astype(np.int32)), pa.nulls(m, pa.int64()), pa.array(one), pa.array(two)],
                        names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, texts = [], [], [], []
            for text, begin, stop in zip(b[1], b[2], b[3], strict=True):
                words = _words(text.as_py())
                begin, stop = begin.as_py(), stop.as_py()
                kept = words
                if begin:
                    edges = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edges, begin, 1)
                    np.add.at(edges, stop, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                out = b" ".join(kept)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    texts.append(out.decode())
            cols = [b[0], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text?) of every document.

    A word goes if a window of 50 words over it also starts in a document with a smaller id. Null and empty texts have
    no words, very long ones are read whole. Rows with a null id lose nothing and make nothing lose. Rows that repeat
    an id are one document as to order, each with its own text, so ties lose nothing to each other. No rows give none.
    Other columns are not read, whatever their names. bits: of the hashes of word runs; fewer only cost time.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("tkey"), text.alias("text"))
    me = F.struct("doc_id", "tkey")
    with scope(docs.sparkSession) as sc:
        seen = stash(rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_occurrences(bits), "vertex long, before long, after long, doc_id long, tkey long, pos int"))
        plain = (F.min("before") == F.max("before")) & (F.min("after") == F.max("after")) & (F.min("before") != 0) & (F.min("after") != 0)
        vertices = seen.groupBy("vertex").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("size"), F.min("before").alias("before"), F.min("after").alias("after"), plain.alias("plain"))
        vertices = stash(vertices.where("low < high").drop("high"))
        place = F.struct("doc_id", "tkey", "pos")
        met = stash(join_counted(seen.select("vertex", "doc_id", "tkey", "pos"), vertices.withColumn("n", F.col("size")), ["vertex"], "size", place, "inner"))
        # The smallest document spells each path in order. An edge joins a nonbranching vertex to the one before it, if that
        # one is nonbranching too, else it is the first of a path, which it gives its name.
        own = met.where("plain AND doc_id = low").groupBy("vertex", "before", "after", "doc_id", "n").agg(F.min(F.struct("tkey", "pos")).alias("at"))
        linked = own.select(F.col("after").alias("before"), F.lit(True).alias("linked")).distinct()
        along = Window.partitionBy("doc_id", "at.tkey").orderBy("at.pos")
        first = F.when(F.col("linked").isNull(), F.col("vertex"))
        paths = stash(own.join(linked, "before", "left").select("vertex", F.col("n").alias("size"), F.last(first, ignorenulls=True).over(along).alias("path")))
        marked = join_counted(met.select("vertex", "doc_id", "tkey", "pos"), paths, ["vertex"], "size", place)
        marked = marked.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("pos", "path")).alias("marks"))
        flagged = rows.join(marked, ["doc_id", "tkey"]).dropDuplicates(["doc_id", "tkey"]).select("doc_id", "tkey", "text", F.col("marks.pos").alias("pos"), F.col("marks.path").alias("path"))
        found = stash(flagged.mapInArrow(_runs(bits, True), _FOUND))
        unstash(seen)

        runs = found.where("path IS NOT NULL")
        span = F.struct("doc_id", "tkey", "begin", (F.col("stop") - F.col("begin")).alias("n"), "h1", "h2")
        sources = stash(runs.groupBy("path").agg(F.min(span).alias("source"), F.count(F.lit(1)).alias("size"), (F.min(F.struct("h1", "h2")) == F.max(F.struct("h1", "h2"))).alias("same")))
        opened = found.where("path IS NULL")
        failed = sources.where("NOT same").select("path", "size")
        if not failed.isEmpty():  # other words than at the source: all windows of such a path's runs go one by one
            again = join_counted(runs, failed, ["path"], "size", me, "inner").groupBy("doc_id", "tkey").agg(F.collect_list("begin").alias("pos"), F.collect_list("stop").alias("path"))
            texts = rows.join(again, ["doc_id", "tkey"]).dropDuplicates(["doc_id", "tkey"]).select("doc_id", "tkey", "text", "pos", "path")
            opened = opened.unionByName(stash(texts.mapInArrow(_runs(bits, False), _FOUND)))
        good = join_counted(runs, sources.where("same").select("path", "source", "size"), ["path"], "size", me, "inner").where("source.doc_id < doc_id")
        first = opened.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").drop("high")
        single = join_counted(opened, stash(first), ["h1", "h2"], "size", F.struct("doc_id", "tkey", "begin"), "inner").where("low < doc_id")
        spans = good.select("doc_id", "tkey", "begin", "stop").unionByName(single.select("doc_id", "tkey", "begin", "stop"))
        lists = sc.keep(spans.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("begin", "stop")).alias("spans")))
    full = rows.join(lists, ["doc_id", "tkey"], "left").select("doc_id", "text", F.col("spans.begin").alias("begin"), F.col("spans.stop").alias("stop"))
    return full.mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
