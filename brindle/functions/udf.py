"""New columns from functions over Arrow batches, one result file a fragment, so a broken run goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.store import Store


class BatchUDF:
    def __init__(self, f: Callable, schema: T.StructType | str, checkpoint: str | None = None):
        self.f, self.checkpoint = f, checkpoint
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep columns and the function's; it gets the rest of each batch, as Arrow."""
        f, schema = self.f, self.schema
        out = T.StructType([*[df.schema[c] for c in keep], *schema.fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = f(b.drop_columns(keep))
                if not isinstance(got, pa.RecordBatch):  # pandas
                    got = pa.RecordBatch.from_pandas(got, preserve_index=False)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(got.column(n) for n in schema.fieldNames())], names=out.fieldNames())

        return df.mapInArrow(run, out)

    def add_to(self, table, read: list[str] | None = None):
        """Commit the function's columns to a table."""
        if not self.checkpoint:
            df = table.to_df(system=True, columns=read).drop("_rowaddr", "_row_created_at_version", "_row_last_updated_at_version")
            return table.add_columns(self.apply(df, ["_rowid"]))
        store = Store(table.spark, self.checkpoint)
        done = set(store.folders(""))
        for f in table.manifest.fragments:  # each is a distributed job of its own
            name = f"v{table.version}-f{f.id}"
            if name in done and store.exists(f"{name}/_SUCCESS"):
                continue
            df = table.to_df(system=True, fragments=[f.id], columns=read).drop("_rowaddr", "_row_created_at_version", "_row_last_updated_at_version")
            self.apply(df, ["_rowid"]).write.mode("overwrite").parquet(store.at(name))
        names = [store.at(f"v{table.version}-f{f.id}") for f in table.manifest.fragments]
        return table.add_columns(table.spark.read.parquet(*names))


def batch_udf(schema: T.StructType | str, checkpoint: str | None = None) -> Callable[[Callable], BatchUDF]:
    """Decorator: a function of Arrow batches (or to pandas) as new columns of `schema`."""
    return lambda f: BatchUDF(f, schema, checkpoint)


def half_precision(column: str) -> Column:
    """A float vector rounded to half precision."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def rounded(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return rounded(F.col(column))
