"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources take the weights 1, 2, 3, 1, 2, ... by code point order, null last, and share the total
size by weight; no target exceeds ``MAX_REPEAT`` times its source's size, and what that leaves
over is shared again by weight. Within a source, every document is expected target / size
times. Documents stand in order of size; the running sum of expected copies plus one random
offset of the source crosses integers, and a document is taken once for each it crosses.

The running sum over a hot source is not one window: documents are ranked within small cells
(source, size class, hash of the id), and the cells' counts are summed over a table of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage
from .storage import join_null_safe

MAX_REPEAT = 3
WEIGHTS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) of a table (source, size); one row per source.

    With r = limit / weight in rising order, a source is at its limit just where r does not exceed
    the share per weight that is left to it and all sources after it.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = total.withColumn("weight", (F.row_number().over(named) - 1) % WEIGHTS + 1).withColumn("limit", max_repeat * F.col("source_size"))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = left / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    marked = weighed.withColumn("full", F.col("limit") / F.col("weight") <= share)
    spread = (F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return marked.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(spread * F.col("weight")).alias("target"))


def _cells(docs: DataFrame) -> DataFrame:
    """Add size, size class (the binary digits of the size and its four leading ones) and hash part."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digits = F.length(F.bin("size"))
    return (
        docs.withColumn("size", size)
        .withColumn("digits", digits)
        .withColumn("size_class", F.col("digits") * 16 + F.expr("shiftright(size, greatest(digits - 4, 0))"))
        .drop("digits")
        .withColumn("part", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2))
    )


def _copies(docs: DataFrame, places: list[str], max_repeat: int, seed: str) -> DataFrame:
    """``mix`` with the columns ``places`` of ``docs``, which tell rows apart that are alike otherwise."""
    read = [F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("source", "string"), ("text", "string"))]
    cells = _cells(docs.select(*read, *places)).drop("text")
    keys = ["source", "size_class", "part"]
    counts = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    targets = source_targets(counts, max_repeat)
    classes = counts.groupBy("source", "size_class").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("size_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select("source", "size_class", before.alias("class_start"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, inner.alias("cell_start"))
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("size", "doc_id", *places)))

    starts = join_null_safe(join_null_safe(starts, classes, ["source", "size_class"]), targets, ["source"])
    starts = starts.select(*keys, (F.col("class_start") + F.col("cell_start")).alias("start"), "source_size", "target")
    dealt = join_null_safe(ranked, starts, keys)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("source")).cast("binary")), 1, 4), 16, 10).cast("double") / 65536
    rank = (F.col("start") + F.col("rank")).cast("double")
    copies = (F.floor(offset + rank * ratio) - F.floor(offset + (rank - 1) * ratio)).cast("long")
    return dealt.withColumn("copies", F.least(copies, F.lit(max_repeat).cast("long"))).select(
        "doc_id", *places, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), one row per row of ``docs``.

    Null text has size 0. A null source is a source of its own, after all others. Rows that
    repeat an id are documents of their own; ties stand side by side, so that either order
    gives the same rows. If all sizes are 0, nothing is taken. Other columns are not read.
    """
    return _copies(docs, [], max_repeat, seed)


def mixed_documents(docs: DataFrame, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The documents of the mix with all their columns as they are, each row as often as it is taken.

    Copies go by row: rows that repeat an id, or have none, are taken as often as ``mix`` says of each.
    """
    rows, places = storage.placed(docs)
    nth, copies = storage.fresh(docs, "nth_copy"), storage.fresh(docs, "copies_")
    taken = _copies(rows, places, max_repeat, seed).where("copies > 0").select(*places, F.col("copies").alias(copies))
    joined = rows.join(taken, places)
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB SQL for ``mix`` without ``copies``, over a table ``documents``.
MIX_SQL = f"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
               substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS part
        FROM documents),
    classed AS (
        SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS size_class FROM sized),
    total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (
        SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {WEIGHTS} + 1 AS weight,
               {MAX_REPEAT} * source_size AS lim FROM total),
    marked AS (
        SELECT *, lim / weight <= (sum(source_size) OVER ()
            - coalesce(sum(lim) OVER (ORDER BY lim / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
        FROM weighed),
    targets AS (
        SELECT source, source_size, CASE WHEN is_full THEN lim::DOUBLE ELSE
            (sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN lim END) OVER (), 0))
            / sum(CASE WHEN NOT is_full THEN weight END) OVER () * weight END AS target
        FROM marked),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, part, size, doc_id)::DOUBLE AS rank FROM classed),
    placed AS (
        SELECT r.doc_id, r.size, t.source_size, t.target, r.rank,
               CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
               ('0x' || substr(md5(concat_ws(':', '{SEED}', r.source)), 1, 4))::INT / 65536 AS u
        FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           (least(floor(u + rank * ratio) - floor(u + (rank - 1) * ratio), {MAX_REPEAT}) * size)::BIGINT AS taken
    FROM placed"""
