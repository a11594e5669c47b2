"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of one trie are walked in node pairs: a pair goes on to its four child pairs, unlike children
spend one bit of the error budget, and a pair over budget is pruned. With b+1 blocks, two fingerprints within
b bits agree in one block whole, so each block's value is a trie of its own and tries are dealt to tasks.
Within a task links are folded into stars, so copies never become all pairs.

keep_one, the pipeline's stage, links texts whose sets of five-word shingles have a Jaccard similarity of 0.8. The same
join of tries finds its candidates, within more bits: with b+2 blocks, two of them agree whole, and each two blocks'
values are a trie. Each candidate is verified on the sets. Similar texts can differ in more bits than tries carry (0.8 is
about ten of 64, often more), so an exact join of the sets by prefixes links those (similar.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.rows import ASCII_LOWER, carry_out, join_counted, slices, text_key
from brindle.llm.similar import majority, similar_links
from brindle.operators.graph import connected_components
from brindle.session import scope, stash

BITS = 64
CELL = 20_000  # distinct fingerprints of one block's value that one task takes at a time; more are dealt in cells
FRONTIER = 500_000
WALK = 30_000  # rows of tries that near_pairs walks at a time
NEAR = 7  # differing bits within which the tries look for candidates of keep_one


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The SimHash of word shingles; zero for a text without words."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if width == 4:
        hashes = [digest(b"%b %b %b %b" % w, seed) for w in zip(words, words[1:], words[2:], words[3:])]
    else:
        hashes = [digest(b" ".join(words[k : k + width]), seed) for k in range(n)]
    return majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every whole text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(x.as_py(), width, seed) for x in b[1]], np.uint64)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_links(tries: np.ndarray, fps: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of fingerprints of the same trie that differ in at most budget bits.

    tries, fps: uint64, sorted by both and without repeats. A node is a range of rows: those that share a
    trie and a prefix. Nodes of one row each are compared at once.
    """
    n = len(fps)
    if not n:
        return
    edge = np.flatnonzero(np.r_[True, tries[1:] != tries[:-1], True])
    start = np.stack([edge[:-1], edge[1:], edge[:-1], edge[1:], np.zeros(len(edge) - 1, np.int64)])
    stack = [(0, start[:, start[1] - start[0] > 1])]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        level, f = stack.pop()
        if f.shape[1] > FRONTIER:
            half = f.shape[1] // 2
            stack += [(level, f[:, :half]), (level, f[:, half:])]
            continue
        single = (f[1] - f[0] == 1) & (f[3] - f[2] == 1)
        if single.any():
            i, j = f[0, single], f[2, single]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
            if near.any():
                yield i[near], j[near]
            f = f[:, ~single]
        if level == BITS or not f.shape[1]:
            continue
        if level not in zeros:
            zeros[level] = np.r_[0, np.cumsum((fps >> np.uint64(BITS - 1 - level)) & np.uint64(1) == 0)]
        z = zeros[level]
        a, b = f[0] + z[f[1]] - z[f[0]], f[2] + z[f[3]] - z[f[2]]  # where the ones begin
        own = (f[0] == f[2]) & (f[1] == f[3])
        pairs = np.concatenate([
            np.stack([f[0], a, f[2], b, f[4]]), np.stack([a, f[1], b, f[3], f[4]]), np.stack([f[0], a, b, f[3], f[4] + 1]),
            np.stack([a, f[1], f[2], b, f[4] + 1])[:, ~own]], axis=1)
        same = (pairs[0] == pairs[2]) & (pairs[1] == pairs[3])
        live = (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= budget) & ~(same & (pairs[1] - pairs[0] < 2))
        stack.append((level + 1, pairs[:, live]))


def stars(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row it is linked to, by way of others too."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the links between n rows so many that they connect the same rows, none of them to spare."""
    root = np.arange(n)
    for i, j in links:
        while True:
            apart = root[i] != root[j]
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            high, one = np.unique(np.maximum(root[i], root[j]), return_index=True)  # each hangs on a lower one
            low = np.minimum(root[i], root[j])[one]
            yield i[one], j[one]
            root[high] = low
            while (up := root[root]).tobytes() != root.tobytes():
                root = up


def _tries(fps: DataFrame, budget: int, agree: int = 1) -> DataFrame:
    """fps, whose fp are distinct, in tries and cells: (trie, cell) of each, such that any two that differ in at most budget bits meet.

    Of budget + agree blocks so many as `agree` are the same; a trie is of the values of so many blocks.
    """
    blocks, others = budget + agree, [c for c in fps.columns if c != "fp"]
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    wide = [edges[k + 1] - edges[k] for k in range(blocks)]
    keys = [F.shiftrightunsigned(F.shiftleft(F.col("fp"), edges[k]), BITS - wide[k]) for k in range(blocks)]
    chosen = list(combinations(range(blocks), agree))
    values = [reduce(lambda v, k: F.shiftleft(v, wide[k]).bitwiseOR(keys[k]), c[1:], keys[c[0]]) for c in chosen]
    rows = fps.select("fp", *others, F.posexplode(F.array(*values)).alias("block", "value")).select("fp", *others, F.expr(f"value * {len(chosen)} + block").alias("trie"))
    # A trie of more rows than CELL is dealt in cells: each row to one part, each pair of parts to one cell.
    large = rows.groupBy("trie").count().where(F.col("count") > CELL).select("trie", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    dealt = rows.join(large, "trie", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("part", part).select(
        "trie", "fp", *others, F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, F.col("part")) * F.col("parts") + F.greatest(k, F.col("part")))).alias("cell"))
    return dealt.repartition("trie", "cell")


def near_links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints fps(fp): enough to connect all that differ in at most budget bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        trie, cell, fp = (t[k].to_numpy() for k in ("trie", "cell", "fp"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, cell, trie))
        trie, cell, fp = trie[order], cell[order], fp[order]
        number = np.cumsum(np.r_[0, (trie[1:] != trie[:-1]) | (cell[1:] != cell[:-1])]).astype(np.uint64)
        root = stars(len(fp), trie_links(number, fp, budget))
        far = root != np.arange(len(fp))
        yield pa.RecordBatch.from_arrays([pa.array(fp[far].view(np.int64)), pa.array(fp[root[far]].view(np.int64))], names=["u", "v"])

    return _tries(fps, budget).mapInArrow(run, "u long, v long")


def near_pairs(sets: DataFrame, budget: int = NEAR) -> DataFrame:
    """Pairs (u, v), u < v, of sets(fp, sim): any two whose SimHashes differ in at most budget bits hang together by such pairs.

    Each pair is in budget itself, and there are no more than the sets times the tries. Sets of one SimHash go by the least.
    """
    sims = stash(sets.groupBy("sim").agg(F.min("fp").alias("of"), F.count(F.lit(1)).alias("size")))

    def walk(t: pa.Table) -> pa.RecordBatch:
        trie, cell, fp, of = (t[k].to_numpy() for k in ("trie", "cell", "fp", "of"))
        fp = fp.view(np.uint64)
        number = np.cumsum(np.r_[0, (trie[1:] != trie[:-1]) | (cell[1:] != cell[:-1])]).astype(np.uint64)
        order = np.lexsort((fp, number))
        fp, of = fp[order], of[order]
        i, j = np.concatenate([np.empty((2, 0), np.int64), *map(np.stack, forest(len(fp), trie_links(number, fp, budget)))], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(of[i], of[j])), pa.array(np.maximum(of[i], of[j]))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows come in the order of tries and cells; whole ones are walked, WALK rows and more at a time
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < WALK:
                continue
            t = pa.Table.from_batches(held)
            trie, cell = t["trie"].to_numpy(), t["cell"].to_numpy()
            whole = np.flatnonzero((trie[1:] != trie[:-1]) | (cell[1:] != cell[:-1]))
            if len(whole):
                yield walk(t[: whole[-1] + 1])
                held = t[whole[-1] + 1 :].combine_chunks().to_batches()
        t = pa.Table.from_batches(held) if held else None
        if t is not None and t.num_rows:
            yield walk(t)

    apart = _tries(sims.select(F.col("sim").alias("fp"), "of"), budget, 2).sortWithinPartitions("trie", "cell").mapInArrow(run, "u long, v long")
    alike = join_counted(sets, sims.where("size > 1"), ["sim"], "size", F.col("fp"), "inner").where("fp <> of")
    return apart.unionByName(alike.select(F.col("of").alias("u"), F.col("fp").alias("v")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Null, empty and blank texts have fingerprint zero and link like others; very long texts are read whole. Null ids
    form no class id (a class of such rows alone has null). Repeated rows and ties share their class. No rows give
    none. Other columns are not read, whatever their names.
    """
    with scope(docs.sparkSession) as sc:
        rows = sc.keep(fingerprints(docs, id_col, text_col, width, seed))
        fps = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
        nodes = connected_components(near_links(fps.select("fp"), budget))
        roots = stash(fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        lows = roots.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size"))
        of = sc.keep(join_counted(roots, lows, ["root"], "size", F.col("fp"), "inner").select("fp", "component_id", "n"))
    found = join_counted(rows, of, ["fp"], "n", F.col("doc_id"), "inner")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of texts linked by a Jaccard similarity of `least` or more, with all its columns.

    Shingles are of `width` words; a shorter text is one shingle, texts without words, null ones too, are alike, and
    very long texts are read whole. The row with the smallest id stays, one without an id only where none has one. A
    verdict holds for a row: rows that share an id but not the text don't fall together. Where rows tie on the id the
    smallest text hash stays, and of rows that repeat id and text one. No rows give none. Other columns may have any
    name.
    """
    text = F.col(f"`{text_col}`")
    with scope(docs.sparkSession) as sc:
        rows, links = similar_links(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("tkey"), text.alias("text")), near_pairs, width, least)
        sets = stash(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
        roots = stash(sets.join(connected_components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        wide = roots.groupBy("root").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("sets")).where("size > 1")
        some = join_counted(roots, wide.select("root", F.col("sets").alias("size")), ["root"], "size", F.col("fp"), "inner").select("fp", "root", "n")
        met = stash(join_counted(rows, some, ["fp"], "n", F.struct("doc_id", "tkey"), "inner").groupBy("root", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n")))
        me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
        lows = met.groupBy("root").agg(F.min(me).alias("low"), F.count(F.lit(1)).alias("size"))
        told = join_counted(met, lows, ["root"], "size", F.struct("doc_id", "tkey"), "inner").select("doc_id", "tkey", (me != F.col("low")).alias("gone"), "n")
        told = sc.keep(told.where("gone OR n > 1").drop("n"))
    return carry_out(docs, told, id_col, text_col)
