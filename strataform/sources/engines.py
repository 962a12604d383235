"""Storage engines: which reader serves a collection. A collection's binding never changes under its rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import ingest

#: Engine, the reader's format, and whether it is part of every build.
CATALOGUE = (
    ("kv", "parquet", True),
    ("columnar", "parquet", True),
    ("timeseries", "parquet", True),
    ("vector", "parquet", True),
    ("graph", "parquet", True),
    ("orc", "orc", True),
    ("json", "json", True),
    ("csv", "csv", True),
    ("jdbc", "jdbc", False),
)


@dataclass
class Router:
    """Collections to engines. An unknown engine is an error: nothing falls back."""

    spark: SparkSession
    default: str = "kv"
    bound: dict[str, str] = field(default_factory=dict)
    readers: dict[str, Callable[[str], DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, kind, built_in in CATALOGUE:
            if built_in:
                self.readers.setdefault(name, lambda path, kind=kind: ingest.read(self.spark, path, kind))

    def register(self, engine: str, reader: Callable[[str], DataFrame]) -> None:
        """A plug-in engine: any function from a path to a DataFrame."""
        self.readers[engine] = reader

    def bind(self, collection: str, engine: str, has_rows: bool = False) -> None:
        if engine not in self.readers:
            raise KeyError(f"unknown engine {engine!r}")
        if self.engine_of(collection) != engine and (has_rows or collection in self.bound):
            raise ValueError(f"{collection!r} is bound to {self.engine_of(collection)!r}")
        self.bound[collection] = engine

    def engine_of(self, collection: str) -> str:
        return self.bound.get(collection, self.default)

    def read(self, collection: str, path: str) -> DataFrame:
        return self.readers[self.engine_of(collection)](path)

    def catalogue(self) -> DataFrame:
        return self.spark.createDataFrame([(n, k, b, n in self.readers) for n, k, b in CATALOGUE], "engine string, format string, built_in boolean, active boolean")


def compact(df: DataFrame, path: str, files: int, sort_by: str) -> None:
    """Rewrite rows sorted by key in ``files`` files, so that key ranges can be skipped by their statistics."""
    df.repartitionByRange(files, sort_by).sortWithinPartitions(sort_by).write.mode("overwrite").parquet(path)
