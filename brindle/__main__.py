"""python -m brindle convert SOURCE ROOT | inspect ROOT | versions ROOT | head ROOT [N]

SOURCE: Parquet, JSON lines (.json, .jsonl, .ndjson) or Arrow IPC (.arrow, .ipc, .feather; a file or a stream).
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from brindle.sources.table import Table


def read(spark: SparkSession, source: str) -> DataFrame:
    kind = source.rstrip("/").rpartition(".")[2].lower()
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.json(source)
    if kind in ("arrow", "ipc", "feather"):
        import io

        import pyarrow as pa

        def rows(batches):
            for b in batches:
                for content in b.column(0):
                    data = io.BytesIO(content.as_py())
                    try:
                        table = pa.ipc.open_file(data).read_all()
                    except pa.ArrowInvalid:
                        data.seek(0)
                        table = pa.ipc.open_stream(data).read_all()
                    yield from table.to_batches()

        files = spark.read.format("binaryFile").load(source).select("content")
        first = bytes(files.first()["content"])
        try:
            schema = pa.ipc.open_file(first).schema
        except pa.ArrowInvalid:
            schema = pa.ipc.open_stream(first).schema
        from pyspark.sql.pandas.types import from_arrow_schema

        return files.mapInArrow(rows, from_arrow_schema(schema))
    return spark.read.parquet(source)


def main(args: list[str], spark: SparkSession | None = None) -> str:
    if not args or args[0] not in ("convert", "inspect", "versions", "head") or len(args) < (3 if args[0] == "convert" else 2):
        raise SystemExit(__doc__)
    spark = spark or SparkSession.builder.getOrCreate()
    if args[0] == "convert":
        table = Table.write(read(spark, args[1]), args[2])
        return f"{table.count_rows()} rows in {len(table.manifest.fragments)} fragments"
    table = Table(spark, args[1])
    if args[0] == "versions":
        return "\n".join(json.dumps(v, default=str) for v in table.versions())
    if args[0] == "head":
        return "\n".join(json.dumps(r.asDict(True), default=str, ensure_ascii=False) for r in table.scan(limit=int(args[2]) if len(args) > 2 else 10).to_df().collect())
    return json.dumps(table.stats() | {"schema": table.schema.simpleString(), "indexes": [i["name"] for i in table.manifest.indexes]}, indent=1)


if __name__ == "__main__":
    print(main(sys.argv[1:]))
