"""Exact dedup by a cuckoo-filter index over digests of normalised texts.

A key whose fingerprint stands in neither of its two buckets is new, without a look at any key; a hit is verified
against the whole 256-bit digests that the same slots hold. Entries can be deleted; an overflow doubles the table and
refills it from the stored keys. Every input partition first folds its own copies in one index, so a group of copies
reaches the shuffle as a few rows a partition. A partition of digests is read in the order of their first two bytes:
once these change, the entries of the last ones are given out and deleted, so the index stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.rows import carry_out, join_counted, text_key
from brindle.session import scope, stash

SLOTS, KICKS = 4, 200
FOLDED = 200_000  # live digests of an input partition's index; more are given out early and fold after the shuffle


class CuckooIndex:
    """Digest -> value, in a cuckoo filter of 16-bit fingerprints whose slots also keep the digest and its value."""

    def __init__(self, buckets: int = 1024):
        self.n = buckets  # a power of two
        self.size = 0
        self._clear()

    def _clear(self) -> None:
        self.marks: list[list[int]] = [[] for _ in range(self.n)]
        self.content: list[list[tuple[bytes, object]]] = [[] for _ in range(self.n)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        f = int.from_bytes(key[2:4], "little") or 1
        i = int.from_bytes(key[4:12], "little") & (self.n - 1)
        return f, i, self._other(i, f)

    def _other(self, i: int, f: int) -> int:
        return i ^ ((f * 0x5BD1E995 >> 3) & (self.n - 1))

    def _find(self, key: bytes, f: int, i: int, j: int) -> tuple[int, int] | None:
        """Bucket and slot of key: slots with its fingerprint are verified by their digest."""
        for k in (i, j):
            if f in self.marks[k]:
                for slot, held in enumerate(self.content[k]):
                    if held[0] == key:
                        return k, slot
        return None

    def get(self, key: bytes):
        """The live value of key or None."""
        at = self._find(key, *self._places(key))
        return self.content[at[0]][at[1]][1] if at else None

    def put(self, key: bytes, value) -> bool:
        """Insert or replace; True if key is new."""
        f, i, j = self._places(key)
        at = self._find(key, f, i, j)
        if at:
            self.content[at[0]][at[1]] = (key, value)
            return False
        self.size += 1
        left = self._seat(f, i, j, (key, value))
        if left:
            self._resize(left)
        return True

    def delete(self, key: bytes) -> bool:
        at = self._find(key, *self._places(key))
        if not at:
            return False
        del self.marks[at[0]][at[1]], self.content[at[0]][at[1]]
        self.size -= 1
        return True

    def _seat(self, f: int, i: int, j: int, entry: tuple[bytes, object]) -> tuple[bytes, object] | None:
        """None, or the entry that is left without a seat after KICKS."""
        for k in (i, j):
            if len(self.marks[k]) < SLOTS:
                self.marks[k].append(f)
                self.content[k].append(entry)
                return None
        k = i
        for turn in range(KICKS):
            slot = (f + turn) % SLOTS
            f, self.marks[k][slot] = self.marks[k][slot], f
            entry, self.content[k][slot] = self.content[k][slot], entry
            k = self._other(k, f)
            if len(self.marks[k]) < SLOTS:
                self.marks[k].append(f)
                self.content[k].append(entry)
                return None
        return entry

    def _resize(self, left: tuple[bytes, object]) -> None:
        live = [*self.items(), left]
        while True:
            self.n *= 2
            self._clear()
            if not any(self._seat(*self._places(entry[0]), entry) for entry in live):
                return

    def items(self) -> Iterator[tuple[bytes, object]]:
        for held in self.content:
            yield from held


def normalised(text: Column | str) -> Column:
    """Runs of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _out(rows: list[tuple[bytes, tuple]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1][0] for r in rows], pa.int64()), pa.array([r[1][1] for r in rows], pa.int64())],
        names=["digest", "keep_id", "group_size"])


def _fold(ordered: bool):
    """ordered: rows come by the digest's first two bytes, and each digest is to come out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, live, done, prefix = CuckooIndex(), [], [], b""
        for b in batches:
            for key, low, n in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist(), strict=True):
                if ordered and key[:2] != prefix or not ordered and len(live) >= FOLDED:
                    for old in live:
                        done.append((old, index.get(old)))
                        index.delete(old)
                    live, prefix = [], key[:2]
                    while len(done) >= 50_000:
                        yield _out(done[:50_000])
                        del done[:50_000]
                if (old := index.get(key)) is None:
                    index.put(key, (low, n))
                    live.append(key)
                else:
                    least = low if old[0] is None else old[0] if low is None else min(old[0], low)
                    index.put(key, (least, old[1] + n))
        done += [(old, index.get(old)) for old in live]
        for k in range(0, len(done), 50_000):
            yield _out(done[k : k + 50_000])

    return run


def exact_groups(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of rows (digest binary, keep_id long, group_size long)."""
    out = "digest binary, keep_id long, group_size long"
    return digests.mapInArrow(_fold(False), out).repartition(F.col("digest")).sortWithinPartitions(F.substring("digest", 1, 2)).mapInArrow(_fold(True), out)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tkey, digest, keep_id, group_size) of every row."""
    text = F.col(f"`{text_col}`")
    rows = stash(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("tkey"), F.unhex(F.sha2(normalised(text), 256)).alias("digest")))
    groups = exact_groups(rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    # Only groups of several rows are joined: the rest is its own keeper.
    several = stash(groups.where("group_size > 1").select("digest", "keep_id", "group_size", F.col("group_size").alias("size")))
    joined = join_counted(rows, several, ["digest"], "size", F.struct("doc_id", "tkey"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", "tkey", "digest", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones; very long texts are hashed whole. Rows with a null id are rows like others, but stay
    only where no row of their group has an id. Rows that repeat an id and a text (ties) all count in group_size and
    share the verdict. No rows give none. Columns other than the two are not read, whatever their names.
    """
    return _grouped(docs, id_col, text_col).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, that with the smallest id, with all its columns.

    A verdict holds for a row, not for an id: rows that share an id but not the text don't fall together. Rows with a
    null id come last, so one stays only where no row of its group has an id. Where rows tie on the id, the smallest
    text hash stays, and of rows that repeat id and text one. Null and empty texts are one group. No rows give none.
    Other columns may have any name.
    """
    with scope(docs.sparkSession) as sc:
        several = stash(_grouped(docs, id_col, text_col).where("group_size > 1"))
        first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        keys = several.groupBy("digest", first.alias("first"), "doc_id", "tkey").agg(F.count(F.lit(1)).alias("n"))
        lows = keys.where("first").groupBy("digest").agg(F.min("tkey").alias("low"))
        # Of the keeper's id a group has few keys; the others all go.
        told = keys.where("first").join(lows, "digest").select("doc_id", "tkey", (F.col("tkey") != F.col("low")).alias("gone"), "n").where("gone OR n > 1").drop("n")
        told = sc.keep(told.unionByName(keys.where("NOT first").select("doc_id", "tkey", F.lit(True).alias("gone"))))
    return carry_out(docs, told, id_col, text_col)
