"""Line dedup by pairwise alignment.

Documents that share a rare line, one that at most RARE rows hold, are a pair. A pair is aligned by patience diff over
the rare lines that both hold, and aligned lines go from the document with the larger id. Every pair is aligned, so no
holder is passed over. Pairs by a common line would be all pairs of its holders; a common line is a block of its own
instead and stays only with its smallest holder.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.rows import join_counted, text_key
from brindle.session import scope, stash

RARE = 16  # rows that hold a rare line at most


def lcs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence as positions (i, j); the rows of its table are the bits of integers."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    table, v = [], full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        table.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or table[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal items: common ends, then unique common items in longest order, then between.

    Where no common item is unique in both, the longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        at = {x: k for k, x in enumerate(b[j:n], j) if cb[x] == 1}
        pairs = [(k, at[x]) for k, x in enumerate(a[i:m], i) if ca[x] == 1 and x in at]
        tails: list[int] = []
        ends: list[int] = []
        prev: list[int] = []
        for k, (_, y) in enumerate(pairs):
            p = bisect_left(tails, y)
            tails[p : p + 1], ends[p : p + 1] = [y], [k]
            prev.append(ends[p - 1] if p else -1)
        k, anchors = ends[-1] if ends else -1, []
        while k >= 0:
            anchors.append(pairs[k])
            k = prev[k]
        if not anchors:
            both = ca.keys() & cb.keys()
            if both:
                p, q = [k for k in range(i, m) if a[k] in both], [k for k in range(j, n) if b[k] in both]
                out += [(p[x], q[y]) for x, y in lcs([a[k] for k in p], [b[k] for k in q])]
            continue
        for x, y in reversed(anchors):
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, m, j, n))
    return sorted(out)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, doc_id, tkey, at): of each document's distinct lines the 128-bit hash and the places."""
    for b in batches:
        digests, owner, places = [], [], []
        for k, text in enumerate(b[2]):
            at: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.as_py().encode().split(b"\n")):
                if line := line.strip():
                    at.setdefault(line, []).append(i)
            digests += map(xxhash.xxh128_digest, at)
            owner += [k] * len(at)
            places += at.values()
        key = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        of = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), b[0].take(of), b[1].take(of), pa.array(places, pa.list_(pa.int32()))], names=["a", "b", "doc_id", "tkey", "at"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of a later document's lines that align with an earlier one's."""
    for b in batches:
        gone = []
        for lines in b[2].to_pylist():
            mine = sorted((i, k) for k, x in enumerate(lines) for i in x["mine"])
            first = sorted((j, k) for k, x in enumerate(lines) for j in x["first"])
            gone.append([mine[i][0] for i, _ in patience([k for _, k in mine], [k for _, k in first])])
        yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "tkey", "gone"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, rare: int = RARE) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, kept_text?) of every document.

    Lines end at a line feed and are compared without outer ASCII white space; lines of nothing else stay and mark
    nothing. A document loses a line that more than `rare` rows hold if one of them has a smaller id, and a rarer line
    if it aligns with that of any document with a smaller id. Null texts have no lines, an empty text one. Rows with a
    null id lose nothing and make nothing lose. Rows that repeat an id are not compared with each other and are judged
    by their own texts; repeated rows have equal results. Very long texts are read whole. No rows give none. Other
    columns are not read, whatever their names.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("tkey"), text.alias("text"))
    with scope(docs.sparkSession) as sc:
        holders = stash(rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_holders, "a long, b long, doc_id long, tkey long, at array<int>"))
        lines = stash(holders.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").withColumn("size", F.col("n")))
        met = stash(join_counted(holders, lines.drop("high"), ["a", "b"], "size", F.struct("doc_id", "tkey"), "inner"))
        common = met.where((F.col("n") > rare) & (F.col("doc_id") > F.col("low"))).select("doc_id", "tkey", F.col("at").alias("gone"))
        groups = met.where(F.col("n") <= rare).groupBy("a", "b").agg(F.collect_set(F.struct("doc_id", "tkey", "at")).alias("m"))  # of `rare` at most
        pairs = groups.select("m", F.explode("m").alias("x")).select("x", F.explode(F.filter("m", lambda y: y["doc_id"] < F.col("x.doc_id"))).alias("y"))
        pairs = pairs.groupBy("x.doc_id", "x.tkey", F.col("y.doc_id").alias("d0"), F.col("y.tkey").alias("k0")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("x.at").alias("mine"), F.col("y.at").alias("first")))).alias("lines"))
        aligned = pairs.select("doc_id", "tkey", "lines").mapInArrow(_align, "doc_id long, tkey long, gone array<int>").where("size(gone) > 0")
        gone = sc.keep(common.unionByName(aligned).groupBy("doc_id", "tkey").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))
    full = rows.join(gone, ["doc_id", "tkey"], "left")
    cut = F.expr("element_at(transform(array(named_struct('l', split(text, '\n'), 'g', gone)), v -> array_join(transform(array_except(sequence(0, size(v.l) - 1), v.g), i -> v.l[i]), '\n')), 1)")
    full = full.withColumn("kept_text", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(cut))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    return full.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"), *(["kept_text"] if with_text else []))
