"""Concurrent versions of documents as path tables, and their order-free merge.

A path table has one row per write: (collection, key, path array, kind, value, hlc, tombstone), and
for array elements a tag. The merge is a function of the set of writes: per path the newest wins, and a
row lives only if it is newer than every tombstone and every write of another kind above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import hlc_text
from .documents import json_canon


def _kind(v):
    name = F.schema_of_variant(v)
    return F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "bool").when(name == "BIGINT", "int").when(name == "VOID", "null").otherwise("double")


def from_json(docs: DataFrame, hlc, json: str = "doc", depth: int = 16) -> DataFrame:
    """The path table of JSON objects (collection, key, ``json``), every path written at clock ``hlc``.

    Objects have a row of their own without a value, unless they are the document itself; scalars
    have their text, arrays their JSON text (``elements`` gives their members). Null documents, text that
    is not JSON and scalars at the top write nothing. Objects below ``depth`` levels raise an error.
    A text's opening braces bound its levels: one pass counts them, so that flat documents take few.
    """

    def node(path, v):
        kind = _kind(v)
        leaf = F.when(kind == "array", F.to_json(v)).when(kind != "object", v.cast("string"))
        return F.struct(path.alias("path"), kind.alias("kind"), leaf.alias("value"), F.when(kind == "object", F.to_json(v)).alias("inside"))

    def members(path, text):
        return F.transform(F.map_entries(F.parse_json(text).cast("map<string,variant>")), lambda e: node(F.concat(path, F.array(e["key"])), e["value"]))

    top = F.try_parse_json(F.col(json).cast("string"))
    top = docs.select("collection", "key", hlc.alias("hlc"), F.when(_kind(top) == "object", F.col(json).cast("string")).alias("inside"))
    rows = top.select("collection", "key", "hlc", F.explode(members(F.array().cast("array<string>"), F.col("inside"))).alias("n")).select("collection", "key", "hlc", "n.*")
    text = F.col(json).cast("string")
    braces = docs.select(F.max(F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))))).first()[0] or 0
    for _ in range(min(depth, braces) - 1):
        self_row = F.array(F.struct("path", "kind", "value", F.lit(None).cast("string").alias("inside")))
        both = F.when(F.col("inside").isNull(), self_row).otherwise(F.concat(self_row, members(F.col("path"), F.col("inside"))))
        rows = rows.select("collection", "key", "hlc", F.explode(both).alias("n")).select("collection", "key", "hlc", "n.*")
    deep = F.when(F.col("inside").isNull(), F.lit(False)).otherwise(F.raise_error(F.lit(f"objects nest deeper than {depth} levels")).cast("boolean"))
    return rows.select("collection", "key", "path", "kind", "value", "hlc", deep.alias("tombstone"))


def elements(paths: DataFrame) -> DataFrame:
    """The members of a path table's arrays, each with a tag of its own, for ``merge_sets``."""
    members = paths.where("kind = 'array'").select("collection", "key", "path", "hlc", "tombstone", F.posexplode(F.parse_json("value").cast("array<variant>")).alias("position", "v"))
    return members.select("collection", "key", "path", F.concat(hlc_text(F.col("hlc")), F.lit("#"), F.col("position").cast("string")).alias("tag"), F.to_json("v").alias("value"), "position", "tombstone")


def newest_writes(ops: DataFrame) -> DataFrame:
    """The newest write per path; of several at one clock a tombstone wins, then the greater kind and value."""
    cols = ["hlc", "tombstone", "kind", "value"]
    new = ops.groupBy("collection", "key", "path").agg(F.max(F.struct(*cols)).alias("w"))
    return new.select("collection", "key", "path", "w.kind", "w.value", "w.tombstone", "w.hlc")


def shadowed(now: DataFrame) -> DataFrame:
    """Live rows: those that no newer tombstone or scalar at a strict ancestor covers."""
    deep = now.withColumn("up", F.explode_outer(F.when(F.size("path") > 1, F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n)))))
    cover = now.where((F.col("kind") != "object") | F.col("tombstone")).select("collection", "key", F.col("path").alias("up"), F.col("hlc").alias("cover"))
    over = deep.join(cover, ["collection", "key", "up"], "left").groupBy("collection", "key", "path").agg(F.max("cover").alias("cover"), F.any_value("kind").alias("kind"), F.any_value("value").alias("value"), F.any_value("tombstone").alias("tombstone"), F.any_value("hlc").alias("hlc"))
    return over.where(~F.col("tombstone") & (F.col("cover").isNull() | (F.col("hlc") > F.col("cover")))).drop("cover", "tombstone")


def merge(ops: DataFrame) -> DataFrame:
    """Live paths after all writes, in any order: (collection, key, path, kind, value, hlc)."""
    return shadowed(newest_writes(ops))


def merge_sets(elements: DataFrame) -> DataFrame:
    """Observed-remove sets: an element (by tag) lives unless any replica removed that tag."""
    keys = ["collection", "key", "path", "tag"]
    per = elements.groupBy(*keys).agg(F.bool_or("tombstone").alias("gone"), F.min("value").alias("value"), F.min("position").alias("position"))
    return per.where("not gone").drop("gone")


def _name(field):
    """A field name as JSON text, quotes and all."""
    quoted = F.to_json(F.array(field))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def materialize_json(live: DataFrame) -> DataFrame:
    """(collection, key, doc): live paths as JSON objects with sorted fields, nested as their paths are.

    Objects are put together level by level from the deepest up, one aggregate each; a path that lives below one without a
    row of its own stands in an object too. Documents without a live path give no row.
    """
    keys = ["collection", "key"]
    scalar = F.when(F.col("kind") == "string", _name(F.col("value"))).when(F.col("kind") == "null", "null").otherwise(F.col("value"))
    cells = live.select(*keys, "path", F.when(F.col("kind") != "object", scalar).alias("text"))
    depth = live.agg(F.max(F.size("path"))).first()[0] or 0
    inner = None
    for level in range(depth, 0, -1):
        here = cells.where(F.size("path") == level)
        if inner is not None:
            here = here.join(inner, [*keys, "path"], "full").select(*keys, "path", F.coalesce("inside", "text").alias("text"))
        cell = F.struct(F.element_at("path", -1).alias("field"), F.coalesce("text", F.lit("{}")).alias("text"))
        grouped = here.groupBy(*keys, F.slice("path", 1, level - 1).alias("path")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        body = F.array_join(F.transform("cells", lambda x: F.concat(_name(x["field"]), F.lit(":"), x["text"])), ",")
        inner = grouped.select(*keys, "path", F.concat(F.lit("{"), body, F.lit("}")).alias("inside"))
    if inner is None:
        return live.select(*keys, F.lit("{}").alias("doc")).limit(0)
    return inner.select(*keys, F.col("inside").alias("doc"))


def update_ops(previous: DataFrame, update: DataFrame, hlc) -> DataFrame:
    """Writes that turn the live paths of ``previous`` into those of ``update`` at clock ``hlc``.

    Unchanged paths write nothing; paths that are gone get tombstones; a change of kind is a write. Integers
    and doubles of equal value are unchanged.
    """
    old = previous.select("collection", "key", "path", F.col("kind").alias("k0"), F.col("value").alias("v0"))
    new = update.select("collection", "key", "path", "kind", "value")
    both = old.join(new, ["collection", "key", "path"], "full")
    number = (F.col("kind").isin("int", "double")) & (F.col("k0").isin("int", "double"))
    same = (F.col("kind").eqNullSafe(F.col("k0")) & F.col("value").eqNullSafe(F.col("v0"))) | (number & (F.col("value").try_cast("double") == F.col("v0").try_cast("double")))
    gone = F.col("kind").isNull()
    changed = both.where(gone | ~F.coalesce(same, F.lit(False)))
    return changed.select("collection", "key", "path", F.coalesce("kind", "k0").alias("kind"), F.when(~gone, F.col("value")).alias("value"), hlc.alias("hlc"), gone.alias("tombstone"))


def update_elements(previous: DataFrame, update: DataFrame, hlc) -> DataFrame:
    """Writes to array elements (collection, key, path, tag, value, position, tombstone) that turn ``previous`` into ``update``.

    Both hold live elements with ``value`` as JSON text and ``position``. An element equal to an old one, each old one used once
    and in order, keeps its tag; others get tags of clock ``hlc``; old ones left over get tombstones. No tag is forgotten.
    """
    keys = ["collection", "key", "path"]

    def numbered(rows):
        nth = Window.partitionBy(*keys, "canon").orderBy("position")
        return rows.withColumn("canon", json_canon(F.col("value"))).withColumn("nth", F.row_number().over(nth))

    old = numbered(previous).select(*keys, "canon", "nth", F.col("tag").alias("tag0"), F.col("value").alias("value0"), F.col("position").alias("position0"))
    new = numbered(update).select(*keys, "canon", "nth", "value", "position", F.lit(True).alias("is_new"))
    both = old.join(new, [*keys, "canon", "nth"], "full")
    gone = F.col("is_new").isNull()
    tag = F.coalesce("tag0", F.concat(hlc_text(hlc), F.lit("#"), F.col("position").cast("string")))
    return both.select(*keys, tag.alias("tag"), F.coalesce("value0", "value").alias("value"), F.coalesce("position", "position0").alias("position"), gone.alias("tombstone"))


def last_write(ops: DataFrame) -> DataFrame:
    """(collection, key, hlc): the newest clock in a document."""
    return ops.groupBy("collection", "key").agg(F.max("hlc").alias("hlc"))


def deleted(live_paths: DataFrame, ops: DataFrame) -> DataFrame:
    """Documents that writes mention but of which nothing lives."""
    return ops.select("collection", "key").distinct().join(live_paths, ["collection", "key"], "left_anti")
