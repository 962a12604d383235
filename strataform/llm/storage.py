"""Shared scratch tables and helpers for joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The planner's estimate for rows whose size it does not know is far above this.
UNKNOWN_BYTES = 1 << 55


#: Arrow batches to Python hold about so many bytes, one row at least, however long texts are.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` if the session has one.

    Where it is unset, a local session gets a temporary folder; on a cluster that would be one
    machine's own disk, so it is an error there.
    """
    setting = spark.conf.get("spark.checkpoint.dir", None)
    if setting:
        return setting.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strataform-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, unless it has a smaller bound of its own."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def texts_of(docs: DataFrame, *columns: tuple[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns that an operator reads, cast to (name, type), and those of ``keep`` as they are."""
    bound_batches(docs.sparkSession)
    return docs.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns], *keep)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns more that tell its rows apart, and their names.

    They are the hash of the row's file and its number there, so every scan gives the same ones.
    Rows that do not come from files are written as a table first.
    """
    names = [fresh(docs, "row_file"), fresh(docs, "row_number")]
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select("*", F.xxhash64(place.getField("file_path")).alias(names[0]), place.getField("row_index").alias(names[1])), names
    except AnalysisException:
        return placed(materialize(docs, "rows"))


def pick(docs: DataFrame, chosen: DataFrame, places: list[str]) -> DataFrame:
    """The rows of ``docs``, which ``placed`` gave its ``places``, that are in ``chosen``; the places go."""
    return docs.join(chosen.select(*places), places, "left_semi").drop(*places)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strataform/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, bytes_each: int, least: int | None = None) -> int:
    """A partition count that follows the input's size, the session's setting at least.

    Where the planner has no estimate (in-memory rows), the strings are measured.
    """
    size = estimated_bytes(df)
    if size >= UNKNOWN_BYTES:
        held = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
        size = sum(df.agg(*held).first()) // 2 if held else 0
    return max(least or shuffle_partitions(df), -(-size // bytes_each))


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join a table that may hold a third of its rows under one key to one row per key.

    ``right`` is dealt round robin first, so that both inputs of the join come from plain
    exchanges and adaptive execution can split the hot key's rows over many tasks.
    """
    return left.join(right.repartition(shuffle_partitions(right)), on, how)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on columns that may be null on both sides; the left side's keys stay."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, same, how).drop(*[f"__{k}" for k in keys])
