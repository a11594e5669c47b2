"""Exact links between texts whose sets of word shingles are similar: near SimHashes first, a prefix join for the rest.

Pairs of near fingerprints come from the caller and are verified on the sets, so most groups hang together. Similar sets
may have fingerprints too far apart, so a prefix join finds what is left: of shingles in one order, rare first, two sets
with a Jaccard similarity of s or more share one of the first n - ceil(s * n) + 1. One round compares each set with a few
sets of each of these shingles, so large groups hang together. The next compares the others of the same shingle that
don't hang together yet, in cells of bounded size, and only gives out pairs that lengths, places and a bitmap of each
set can't rule out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.rows import ASCII_LOWER, few, join_counted, slices
from brindle.operators.graph import connected_components
from brindle.session import scope, stash, unstash

SAMPLE, COMMON = 5_000, 100_000  # about so many documents show which shingles are frequent; at most so many of these
LARGE, PIVOTS = 64, 8  # a shingle of more sets gets so many pivots, others get one; what they leave goes to the cells
CELL = 2_000  # sets of one shingle that are compared at a time, with as many others
_ONES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # of each byte, low bit first
_MINI = 16  # words of 64 bits of a set's small bitmap; the other has two bits an element at least


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter((digest(x, seed) for x in runs), np.uint64, max(1, len(words) - width + 1)))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes: the bits set in over half of them; zero without any."""
    n = len(hashes)
    h = hashes.view(np.uint8).reshape(n, 8)
    if n < 256:
        ones = np.unpackbits(h, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(h[:, k], minlength=256) @ _ONES for k in range(8)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _set_key(held: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes())).view(np.int64))


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as if made with fewer words; both are powers of two."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _bitmap(held: np.ndarray) -> np.ndarray:
    words = max(_MINI, 1 << max(0, 2 * len(held) - 1).bit_length() >> 6)
    bits = np.zeros(words, np.uint64)
    at = held & np.uint64(words * 64 - 1)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits


def _common(docs: DataFrame, width: int, at_least: int = 5) -> np.ndarray:
    """Shingles of several of some documents, the most frequent last. They only order the shingles, so any result is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = [shingles(x.as_py(), width) for x in b[0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held or [np.empty(0, np.uint64)]).view(np.int64))], names=["h"])

    few = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    often = few.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= at_least).orderBy(F.desc("count"), "h").limit(COMMON).collect()
    return np.array([r["h"] for r in reversed(often)], np.int64).view(np.uint64)


def _heads(docs: DataFrame, width: int, least: float) -> DataFrame:
    """(doc_id, tkey, fp, sim, n, mini, bits, heads): each text's set by its hash fp, with its SimHash, size, bitmaps and first shingles."""
    rank = _common(docs, width)
    order = np.argsort(rank)
    sorted_rank = rank[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = [shingles(x.as_py(), width) for x in b[2]]
            heads = []
            for h in held:
                place = np.zeros(len(h), np.int64)
                if len(rank):
                    k = np.minimum(np.searchsorted(sorted_rank, h), len(rank) - 1)
                    place = np.where(sorted_rank[k] == h, order[k] + 1, 0)
                n = len(h)
                heads.append(h[np.lexsort((h, place))][: n - math.ceil(least * n - 1e-9) + 1 if n else 0].view(np.int64))
            maps = [_bitmap(h) for h in held]
            yield pa.RecordBatch.from_arrays(
                [b[0], b[1], pa.array([_set_key(h) for h in held], pa.int64()), pa.array(np.array([majority(h) for h in held], np.uint64).view(np.int64)), pa.array([len(h) for h in held], pa.int32()), pa.array([_fold(x, _MINI).tobytes() for x in maps], pa.binary()),
                 pa.array([x.tobytes() for x in maps], pa.binary()), pa.array(heads, pa.list_(pa.int64()))], names=["doc_id", "tkey", "fp", "sim", "n", "mini", "bits", "heads"])

    return docs.select("doc_id", "tkey", "text").mapInArrow(run, "doc_id long, tkey long, fp long, sim long, n int, mini binary, bits binary, heads array<long>")


def _can_be(p, q, n, m, least: float):
    """Whether sets can be similar by their bitmaps: a bit that only one set has is an element that the other lacks."""
    most = np.minimum(n - np.bitwise_count(p & ~q).sum(-1, dtype=np.int64), m - np.bitwise_count(q & ~p).sum(-1, dtype=np.int64))
    return most * (1 + least) >= least * (n + m) - 1e-6


def _similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, least: float) -> DataFrame:
    """Of the candidates (u, v) those that are similar. sets: fp, n, bits, and the row of one text, o_id and o_key."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            can = []
            for n, m, x, y in zip(*(b[k].to_pylist() for k in (2, 3, 4, 5)), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(p), len(q))
                can.append(bool(_can_be(_fold(p, words), _fold(q, words), n, m, least)))
            yield pa.RecordBatch.from_arrays([b[0], b[1]], names=["u", "v"]).filter(pa.array(can, pa.bool_()))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept = [shingles(x.as_py(), width).view(np.int64) for x in b[1]]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(kept, pa.list_(pa.int64()))], names=["fp", "held"])

    def met(pairs: DataFrame, table: DataFrame, names: dict[str, str]) -> DataFrame:
        """pairs with columns of both ends; an end of many pairs is split."""
        now, total = pairs, pairs.count()
        for end, cols in (("u", {c: f"{n}1" for c, n in names.items()}), ("v", {c: f"{n}2" for c, n in names.items()})):
            size = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("size"))
            now = join_counted(now, table.select(F.col("fp").alias(end), *(F.col(c).alias(n) for c, n in cols.items())).join(size, end), [end], "size", F.struct("u", "v"), "inner", total)
        return now.select("u", "v", *(f"{n}{k}" for n in names.values() for k in (1, 2)))

    with scope(docs.sparkSession) as sc:
        pairs = stash(pairs.distinct())
        pairs = stash(met(pairs, sets, {"n": "n", "bits": "b"}).mapInArrow(prune, "u long, v long"))
        some = stash(sets.join(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp").select("fp", "o_id", "o_key"))
        texts = docs.join(few(some), F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("tkey") == F.col("o_key"))).select("fp", "text")
        bags = stash(texts.mapInArrow(again, "fp long, held array<long>"))
        both = F.size(F.array_intersect("s1", "s2"))
        return sc.keep(met(pairs, bags, {"held": "s"}).where(both >= least * (F.size("s1") + F.size("s2") - both) - 1e-9).select("u", "v"))


def _pairs(fp: np.ndarray, n: np.ndarray, i: np.ndarray, root: np.ndarray, mini: np.ndarray, part: np.ndarray, split: bool, least: float) -> np.ndarray:
    """(2, pairs) of one cell: those of its two parts, or within its only one, that stand apart and can be similar."""
    out = [np.empty((2, 0), np.int64)]
    for x in np.flatnonzero(part == part.min()) if split else range(len(fp) - 1):
        y = np.flatnonzero(part == part.max()) if split else np.arange(x + 1, len(fp))
        y = y[root[y] != root[x]]
        y = y[np.minimum(n[x] - i[x], n[y] - i[y]) * (1 + least) >= least * (n[x] + n[y]) - 1e-6]
        if len(y):
            y = y[_can_be(mini[x], mini[y], n[x], n[y], least)]
            out.append(np.stack([np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y])]))
    return np.concatenate(out, axis=1)


def _candidates(least: float):
    """Of rows (h, one, other, fp, n, i, root, part, mini) in the order of their cells the candidate pairs, a cell at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the cell that goes on

        def cells(t: pa.Table, last: bool) -> Iterator[np.ndarray]:
            cols = [c.to_numpy().astype(np.int64) for c in t.columns[:8]]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            mini = np.frombuffer(b"".join(t.column(8).to_pylist()), np.uint64).reshape(-1, _MINI)
            edges = [0, *cut.tolist(), *([t.num_rows] if last else [])]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    yield _pairs(*(cols[k][a:b] for k in (3, 4, 5, 6)), mini[a:b], cols[7][a:b], cols[1][a] != cols[2][a], least)
            held[:] = [] if last else t.slice(edges[-1]).combine_chunks().to_batches()

        def out(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            both = np.concatenate([np.empty((2, 0), np.int64), *found], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

        for b in batches:
            if b.num_rows:
                yield from out(cells(pa.Table.from_batches([*held, b]), False))
        if held:
            yield from out(cells(pa.Table.from_batches(held), True))

    return run


def similar_links(docs: DataFrame, near: Callable[[DataFrame], DataFrame], width: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows, links) of docs (doc_id, tkey, text): rows (doc_id, tkey, fp) with fp the hash of a text's set, links (u, v) of sets.

    The links connect all sets of a Jaccard similarity of `least` or more, and no others. near: of sets (fp, sim) pairs
    (u, v) whose SimHashes are close; whichever it gives, the links are right, but those it gives spare the join work.
    """
    held = stash(_heads(docs, width, least))
    # Only the sets of several rows are reduced to one; the others needn't move for that.
    several = stash(held.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("fp"))
    names = ["fp", "sim", "n", "mini", "bits", "o_id", "o_key", "heads"]
    rows = held.withColumnsRenamed({"doc_id": "o_id", "tkey": "o_key"}).select(*names)
    least_row = rows.join(several, "fp", "left_semi").groupBy("fp").agg(F.min_by(F.struct(*names[1:]), F.struct("o_id", "o_key")).alias("s")).select("fp", "s.*")
    sets = rows.join(several, "fp", "left_anti").unionByName(least_row)
    links = _similar(near(sets.select("fp", "sim")), docs, sets, width, least)

    posts = sets.select("fp", "n", F.posexplode("heads").alias("i", "h"))
    counts = stash(posts.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    total = counts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    posts = stash(join_counted(posts, counts, ["h"], "size", F.col("fp"), "inner", total))

    def stand(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members, apart): posts with the root that their set hangs on, and the shingles, with their size, of several roots."""
        nodes = connected_components(links).withColumnRenamed("node", "fp")
        members = stash(posts.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        apart = members.groupBy("h").agg(F.count(F.lit(1)).alias("size"), (F.min("root") != F.max("root")).alias("apart"))
        return members, stash(apart.where("apart").drop("apart"))

    def can_be(n: Column, i: Column, pivot: Column) -> Column:
        """A pair's first common shingle leaves both enough others, so it comes out there."""
        return F.least(n - i, pivot["n"] - pivot["i"]) * (1 + least) >= least * (n + pivot["n"]) - 1e-6

    members, apart = stand(links)
    wanted = apart.withColumn("pivots", F.when(F.col("size") > LARGE, PIVOTS).otherwise(1))
    some = stash(join_counted(members, wanted, ["h"], "size", F.col("fp"), "inner", total))
    each = some.groupBy("h", F.pmod(F.xxhash64("fp"), F.col("pivots")).alias("k")).agg(
        F.min(F.struct(F.xxhash64("fp", F.lit(1)).alias("x"), "fp", "n", "i", "root")).alias("pivot"), F.count(F.lit(1)).alias("size"))
    pivots = each.groupBy("h").agg(F.collect_list("pivot").alias("met"), F.sum("size").alias("size"))  # PIVOTS at most
    met = join_counted(some.drop("pivots"), pivots, ["h"], "size", F.col("fp"), "inner", total)
    apart_from = F.filter("met", lambda p: (p["root"] != F.col("root")) & can_be(F.col("n"), F.col("i"), p))
    pairs = met.select("fp", F.explode(apart_from).alias("pivot"))
    links = links.unionByName(_similar(pairs.select(F.least("pivot.fp", "fp").alias("u"), F.greatest("pivot.fp", "fp").alias("v")), docs, sets, width, least))
    for done in (members, apart, some):
        unstash(done)

    members, apart = stand(links)
    apart = apart.select("h", "size", F.ceil(F.col("size") / CELL).cast("int").alias("parts"))
    dealt = join_counted(members, apart, ["h"], "size", F.col("fp"), "inner", total).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.join(sets.select("fp", "mini"), "fp")
    cells = dealt.select("h", "fp", "n", "i", "mini", "root", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    cells = cells.select("h", F.least("k", "part").alias("one"), F.greatest("k", "part").alias("other"), "fp", "n", "i", "root", "part", "mini")
    cells = cells.repartition("h", "one", "other").sortWithinPartitions("h", "one", "other")
    rest = _similar(cells.mapInArrow(_candidates(least), "u long, v long"), docs, sets, width, least)
    return held.select("doc_id", "tkey", "fp"), links.unionByName(rest)
