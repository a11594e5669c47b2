"""Compaction: plan on the manifest, execute each task anywhere, commit once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from brindle.functions import emit
from brindle.sources.manifest import Manifest
from brindle.sources.table import Table, _schema_of


@dataclass
class Task:
    fragments: list[int]
    version: int
    target_rows: int
    files: list | None = None


def plan(table: Table, target_rows: int, deleted_share: float = 0.1, exclude: set[int] = frozenset()) -> list[Task]:
    """Bins of neighbours: fragments smaller than the target or with more than deleted_share of rows deleted."""
    bins, now, rows = [], [], 0
    patched = bool(table.manifest.patches)

    def close() -> None:
        nonlocal now, rows
        if len(now) > 1 or now and (now[0].deleted > deleted_share * now[0].rows or patched and now[0].deleted):
            bins.append(Task([f.id for f in now], table.version, target_rows))
        now, rows = [], 0

    for f in table.manifest.fragments:
        if f.id in exclude or not (f.rows < target_rows or f.deleted > deleted_share * f.rows):
            close()
            continue
        now.append(f)
        rows += f.live
        if rows >= target_rows:
            close()
    close()
    return bins


def execute(table: Table, task: Task) -> Task:
    """Write the task's live rows, in order, with their ids and versions."""
    df = table.to_df(system=True, fragments=task.fragments)
    shape = [F.col(emit.quote(f["name"])).alias(f["column"]) for f in table.manifest.fields]
    live = sum(f.live for f in table.manifest.fragments if f.id in set(task.fragments))
    parts = max(1, -(-live // task.target_rows))
    rows = df.select("_rowaddr", *shape, F.col("_rowid").alias("__rowid"), F.col("_row_created_at_version").alias("__created"), F.col("_row_last_updated_at_version").alias("__updated"))
    rows = rows.repartitionByRange(parts, "_rowaddr").sortWithinPartitions("_rowaddr").drop("_rowaddr")
    return Task(task.fragments, task.version, task.target_rows, Table._write_files(table.store, rows, task.target_rows))


def commit(table: Table, done: list[Task]) -> dict:
    if not done:
        return {"fragments_removed": 0, "fragments_added": 0}
    gone = {f for t in done for f in t.fragments}

    def change(old: Manifest, number: int) -> Manifest:
        kind = _schema_of(old, table.manifest.fields)
        old.fragments = [f for f in old.fragments if f.id not in gone]
        for t in done:
            Table._add(old, t.files, number, kind, take_ids=False)
        if not any(f.deleted for f in old.fragments):
            old.deletions = []
        if not any(f.id in p.get("fragments", [f.id]) for p in old.patches for f in old.fragments if f.version != number):
            old.patches = []
        for i in old.indexes:
            i["fragments"] = [f for f in i["fragments"] if f not in gone]
        return old

    table._again(table.log.commit(table.manifest, {"operation": "Rewrite", "fragments": sorted(gone)}, change))
    return {"fragments_removed": len(gone), "fragments_added": sum(len(t.files) for t in done)}
