"""Vector models trained on their own, kept in a store, and put to use by several writers."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame

from brindle.operators.vector import SAMPLE_RATE, Quantizer, _encoded, _sample, assign, train_ivf
from brindle.sources.store import Store


class IndicesBuilder:
    """Steps of a vector index over one column: centroids, codewords, assignments, codes; models are JSON files."""

    def __init__(self, df: DataFrame, column: str, metric: str = "l2"):
        self.df, self.column, self.metric = df, column, metric
        self.centroids: np.ndarray | None = None
        self.quantizer: Quantizer | None = None

    def train_ivf(self, partitions: int | None = None, sample_rate: int = SAMPLE_RATE) -> np.ndarray:
        self.centroids = train_ivf(self.df, self.column, partitions, self.metric, sample_rate)
        return self.centroids

    def train_pq(self, sub_vectors: int | None = None, rows: int = 65_536) -> Quantizer:
        self.quantizer = Quantizer.train(_sample(self.df, self.column, rows, self.metric), "PQ", sub_vectors)
        return self.quantizer

    def train_sq(self, rows: int = 65_536) -> Quantizer:
        self.quantizer = Quantizer.train(_sample(self.df, self.column, rows, self.metric), "SQ")
        return self.quantizer

    def save(self, spark, path: str) -> None:
        model = {"metric": self.metric, "column": self.column, "centroids": None if self.centroids is None else self.centroids.tolist()}
        if self.quantizer is not None:
            model |= {"quantizer": self.quantizer.kind, "books": self.quantizer.books.tolist()}
        root, _, name = path.rpartition("/")
        Store(spark, root).replace(name, json.dumps(model))

    @classmethod
    def load(cls, df: DataFrame, path: str) -> "IndicesBuilder":
        root, _, name = path.rpartition("/")
        model = json.loads(Store(df.sparkSession, root).read(name))
        made = cls(df, model["column"], model["metric"])
        made.centroids = None if model["centroids"] is None else np.array(model["centroids"])
        made.quantizer = Quantizer(model["quantizer"], np.array(model["books"])) if "quantizer" in model else None
        return made

    def assign(self, df: DataFrame | None = None) -> DataFrame:
        """Rows with _part, the number of the nearest centroid."""
        if self.centroids is None:
            raise ValueError("train or load centroids first")
        return assign(self.df if df is None else df, self.column, self.centroids, self.metric)

    def transform(self, df: DataFrame | None = None) -> DataFrame:
        """(_rowaddr, _part, code) of rows that carry _rowaddr."""
        if self.quantizer is None:
            raise ValueError("train or load a quantizer first")
        return _encoded(self.assign(df).where("_part IS NOT NULL"), self.column, self.quantizer, self.centroids.shape[1], self.metric)
