"""What changed between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Delta:
    """Changes after version begin, up to version end."""

    def __init__(self, table, begin: int, end: int):
        if begin > end:
            raise ValueError("begin is after end")
        self.table, self.begin, self.end = table, begin, end
        self._at = table.checkout(end)

    def _rows(self) -> DataFrame:
        return self._at.to_df(system=True)

    def inserted(self) -> DataFrame:
        created = F.col("_row_created_at_version")
        return self._rows().where((created > self.begin) & (created <= self.end))

    def updated(self) -> DataFrame:
        changed = F.col("_row_last_updated_at_version")
        return self._rows().where((F.col("_row_created_at_version") <= self.begin) & (changed > self.begin) & (changed <= self.end))

    def deleted_row_ids(self) -> DataFrame:
        if self.table.manifest.next_row_id is None:
            raise ValueError("deleted ids need stable row ids")
        before = self.table.checkout(self.begin).to_df(system=True, columns=[]).select("_rowid")
        return before.join(self._rows().select("_rowid"), "_rowid", "left_anti")

    def transactions(self) -> list[dict]:
        return self.table.transactions(self.begin, self.end)
