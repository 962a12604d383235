"""Reading outside data: JSON, CSV, TSV, text and vectors, and storing large records in parts."""

from __future__ import annotations

import csv
import io
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.files import CHUNK_CHARS, SPLIT_ABOVE

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def coerce(cell: str):
    """A number if the text is a plain decimal one; empty text stays text."""
    cell = cell.strip()
    if len(cell) > 1 and cell[0] == cell[-1] == "'":
        cell = cell[1:-1]
    if not _NUMBER.match(cell):
        return cell
    return int(cell) if re.fullmatch(r"[+-]?\d{1,18}", cell) else float(cell)


def delimiter(text: str) -> str | None:
    """Tab if the first line has one, else comma if it has one."""
    head = text.split("\n", 1)[0]
    return "\t" if "\t" in head else "," if "," in head else None


def classify(text: str, filename: str = "") -> str:
    """vector, graph, timeseries, documents, document, table or text: what a small payload holds."""
    try:
        value = json.loads(text)
    except ValueError:
        return "table" if delimiter(text) and "\n" in text.strip() else "text"
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if isinstance(value, list):
        return "vector" if value and all(map(number, value)) else "documents"
    if isinstance(value, dict):
        if any(k in value for k in ("source", "from")):
            return "graph"
        if any(k in value for k in ("timestamp", "time", "ts")):
            return "timeseries"
        return "document"
    return "text"


def parse_table(text: str) -> list[dict]:
    """Rows of delimited text with a header line, cells trimmed and numbers read."""
    rows = list(csv.reader(io.StringIO(text.strip("\n")), delimiter=delimiter(text) or ","))
    head = [h.strip() for h in rows[0]] if rows else []
    return [{k: coerce(v) for k, v in zip(head, r, strict=False)} for r in rows[1:] if r]


def read(spark: SparkSession, path: str, kind: str, schema=None, **options) -> DataFrame:
    """parquet, orc, json, csv, tsv, text, binary or jdbc, each by Spark's own reader."""
    if kind == "text":
        return spark.read.text(path)
    if kind == "binary":
        return spark.read.format("binaryFile").load(path)
    if kind == "jdbc":
        return spark.read.format("jdbc").options(url=path, **options).load()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("csv", "tsv"):
        return reader.options(header=True, sep="\t" if kind == "tsv" else ",", escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options).csv(path)
    if kind in ("parquet", "orc", "json"):
        return getattr(reader.options(**options), kind)(path)
    raise ValueError(f"unknown source {kind!r}")


def typed(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Columns of text as doubles; cells that are no plain decimal number (hex, NaN, 1d, empty) become null."""
    return df.withColumns({c: F.when(F.trim(c).rlike("^" + _NUMBER.pattern), F.trim(c).try_cast("double")) for c in numeric})


def chunk_records(docs: DataFrame, field: str, size: int = CHUNK_CHARS, least: int = SPLIT_ABOVE) -> DataFrame:
    """(key, parent_key, part_index, part_total, text): records above ``size`` characters in parts ``key#i``.

    Records whose field has ``least`` characters or fewer stay whole: part_index is null.
    """
    n = F.char_length(field)
    total = F.when((n > size) & (n > least), F.ceil(n / size)).otherwise(1).cast("int")
    parts = docs.select("key", F.col(field).alias("whole"), total.alias("part_total"), F.explode(F.sequence(F.lit(0), total - 1)).alias("i"))
    split = F.col("part_total") > 1
    return parts.select(
        F.when(split, F.concat("key", F.lit("#"), F.col("i").cast("string"))).otherwise(F.col("key")).alias("key"),
        F.when(split, F.col("key")).alias("parent_key"),
        F.when(split, F.col("i")).alias("part_index"),
        "part_total",
        F.substring("whole", F.col("i") * size + 1, F.lit(size)).alias("text"),
    )
