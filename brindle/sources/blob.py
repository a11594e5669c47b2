"""Large binary values: columns flagged as blobs, files over single values, and ranges of many."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import emit
from brindle.sources.table import Table


def flag(table: Table, column: str) -> Table:
    """Mark a binary column, so that scans with blob_handling give descriptions instead of its bytes."""
    return table.field_metadata(column, {"blob": "true"})


class BlobFile(io.RawIOBase):
    """One value as a file for reading. A read fetches the bytes asked for from the fragment's row, and no others travel."""

    def __init__(self, table: Table, column: str, address: int, size: int):
        self.table, self.column, self.address, self._size, self._at = table, column, address, size, 0

    def size(self) -> int:
        return self._size

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._size}[whence])
        return self._at

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def read(self, n: int = -1) -> bytes:
        n = max(0, self._size - self._at if n is None or n < 0 else min(n, self._size - self._at))
        if not n:
            return b""
        rows = self.table.to_df(system=True, fragments=[self.address >> 32], columns=[self.column]).where(F.col("_rowaddr") == self.address)
        data = bytes(rows.select(F.substring(emit.quote(self.column), self._at + 1, n).alias("b")).first()["b"])
        self._at += len(data)
        return data

    def readall(self) -> bytes:
        return self.read()


def take_blobs(table: Table, column: str, positions: list[int] | None = None, ids: list[int] | None = None, addresses: list[int] | None = None) -> list[BlobFile | None]:
    """Files over the values at positions, row ids or addresses, in that order; None for a null value. Sizes are read, not bytes."""
    if sum(x is not None for x in (positions, ids, addresses)) != 1:
        raise ValueError("give positions, ids or addresses")
    size = F.octet_length(F.col(emit.quote(column))).cast("long").alias("n")
    if positions is not None:
        asked, key = positions, "at"
        starts, at = {}, 0
        for f in table.manifest.fragments:
            starts[f.id] = at
            at += f.live
        from pyspark.sql import Window

        wanted = {f.id for f in table.manifest.fragments if any(starts[f.id] <= p < starts[f.id] + f.live for p in positions)}
        df = table.to_df(system=True, fragments=sorted(wanted), columns=[column])
        frag = F.shiftright("_rowaddr", 32)
        first = F.create_map(*[x for f in sorted(wanted) for x in (F.lit(f).cast("long"), F.lit(starts[f]).cast("long"))]) if wanted else F.lit(None)
        df = df.withColumn("at", first[frag] + F.row_number().over(Window.partitionBy(frag).orderBy("_rowaddr")) - 1) if wanted else df.withColumn("at", F.lit(0))
    else:
        asked, key = (ids, "_rowid") if ids is not None else (addresses, "_rowaddr")
        by_address = key == "_rowaddr" or table.manifest.next_row_id is None
        df = table.to_df(system=True, fragments=sorted({a >> 32 for a in asked}) if by_address else None, columns=[column])
    rows = df.where(F.col(key).isin([int(a) for a in asked])).select(F.col(key).alias("k"), "_rowaddr", size).collect()  # one a value asked for
    found = {r["k"]: r for r in rows}
    missing = [a for a in asked if a not in found]
    if missing:
        raise IndexError(f"no rows at {missing[:3]}")
    return [None if found[a]["n"] is None else BlobFile(table, column, found[a]["_rowaddr"], found[a]["n"]) for a in asked]


def read_ranges(table: Table, column: str, wanted: DataFrame) -> DataFrame:
    """wanted (_rowaddr, position, size, ...) with the bytes as `content`, cut where the rows are read."""
    rows = table.to_df(system=True, columns=[column]).select("_rowaddr", F.col(emit.quote(column)).alias("__b"))
    return wanted.join(rows, "_rowaddr", "left").withColumn("content", F.expr("substring(__b, cast(position AS int) + 1, cast(size AS int))")).drop("__b")
