"""Graphs derived from documents: edges, neighbours, traversal, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: A class's table has so many columns at most; more are an error.
MAX_COLUMNS = 10_000
MAX_DEPTH = 64


def derive_edges(docs: DataFrame) -> DataFrame:
    """(src, dst, label, owner) from columns key, parent, children, edges, from_key, to_key, label.

    A parent and children give ``child`` edges; edge lists give their own labels; documents with both
    ends are edges. One document holds one edge per pair of ends.
    """
    child = F.lit("child")
    up = docs.where("parent is not null").select(F.col("parent").alias("src"), F.col("key").alias("dst"), child.alias("label"), F.col("key").alias("owner"), F.lit(0).alias("rank"))
    down = docs.select(F.col("key").alias("src"), F.explode("children").alias("dst"), child.alias("label"), F.col("key").alias("owner"), F.lit(1).alias("rank"))
    out = docs.select(F.col("key").alias("src"), F.explode("edges").alias("e"), F.col("key").alias("owner")).select("src", F.col("e.target").alias("dst"), F.coalesce("e.label", F.lit("")).alias("label"), "owner", F.lit(2).alias("rank"))
    own = docs.where("from_key is not null and to_key is not null").select(F.col("from_key").alias("src"), F.col("to_key").alias("dst"), F.coalesce("label", F.lit("")).alias("label"), F.col("key").alias("owner"), F.lit(3).alias("rank"))
    every = up.unionByName(down).unionByName(out).unionByName(own)
    return every.groupBy("owner", "src", "dst").agg(F.min_by("label", F.struct("rank", "label")).alias("label")).select("src", "dst", "label", "owner")


def out_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select("dst", "label").distinct()


def in_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node).select("src", "label").distinct()


def vertices(edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    found = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return (found.union(docs.select("key")) if docs is not None else found).distinct()


def roots(edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    return vertices(edges, docs).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def stats(edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """One row: nodes, distinct edges, roots."""
    n = vertices(edges, docs).agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges"))
    r = roots(edges, docs).agg(F.count(F.lit(1)).alias("roots"))
    return n.join(e, F.lit(True)).join(r, F.lit(True))  # three single rows


def reach(edges: DataFrame, root: str, depth: int = 0, reverse: bool = False) -> DataFrame:
    """(node, depth) of nodes below ``root`` (above it if ``reverse``), each at its least depth.

    Breadth first: a round joins the frontier with the edges and drops what was seen. The distinct edges are written once,
    dealt by the end that the frontier meets, and rounds end in checkpoints, all on the cluster's
    reliable storage; cycles end, and depth 0 means ``MAX_DEPTH``.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    depth = MAX_DEPTH if depth <= 0 else min(depth, MAX_DEPTH)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct().repartition("node").checkpoint()
    frontier = spark.createDataFrame([(root,)], "node string")
    seen, found = frontier, None
    for level in range(1, depth + 1):
        frontier = frontier.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        at = frontier.withColumn("depth", F.lit(level))
        found = at if found is None else found.unionByName(at)
        seen = seen.unionByName(frontier)
    return found if found is not None else frontier.withColumn("depth", F.lit(0))


def asymmetric(out: DataFrame, inward: DataFrame) -> DataFrame:
    """Edges (src, dst) that only one of the two adjacency tables holds."""
    a, b = out.select("src", "dst").distinct(), inward.select("src", "dst").distinct()
    return a.join(b, ["src", "dst"], "left_anti").withColumn("missing", F.lit("in")).unionByName(b.join(a, ["src", "dst"], "left_anti").withColumn("missing", F.lit("out")))


def object_view(docs: DataFrame, edges: DataFrame, cls: str, columns: list[str]) -> DataFrame:
    """A class as a table: its scalar columns as JSON text, the parent's key, and the number of children."""
    parent = edges.where("label = 'child'").groupBy(F.col("dst").alias("key")).agg(F.min("src").alias("_parent"))
    children = edges.where("label = 'child'").groupBy(F.col("src").alias("key")).agg(F.count_distinct("dst").alias("_child_count"))
    own = docs.where(F.col("class") == cls)
    cells = [F.coalesce(F.to_json(F.struct(F.col(c).alias("c"))), F.lit("null")) for c in columns]
    named = [F.coalesce(F.regexp_extract(x, r"^\{\"c\":(.*)\}$", 1), F.lit("null")) for x in cells]
    text = [F.when(F.col(c).isNull(), "null").otherwise(x).alias(c) for c, x in zip(columns, named, strict=True)]
    return own.join(parent, "key", "left").join(children, "key", "left").select("key", *text, "_parent", F.coalesce("_child_count", F.lit(0).cast("long")).alias("_child_count"))


def class_columns(members: DataFrame, json: str = "doc") -> list[str]:
    """The sorted names of all scalar fields of JSON documents: a table's header, so it fits the driver (``MAX_COLUMNS``)."""
    fields = members.select(F.explode(F.map_entries(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"))).alias("f"))
    names = fields.where(~F.schema_of_variant("f.value").rlike("^(OBJECT|ARRAY)")).select("f.key").distinct().limit(MAX_COLUMNS + 1).collect()
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    return sorted(r["key"] for r in names)


def json_object_view(docs: DataFrame, edges: DataFrame, cls: str, json: str = "doc") -> DataFrame:
    """A class (docs: key, class, a JSON document) as a table: the union of its members' scalar fields as JSON text,
    ``null`` where one has none, the parent's key, and the number of children."""
    own = docs.where(F.col("class") == cls)
    columns = class_columns(own, json)
    fields = own.select("key", F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>").alias("f"))

    def cell(name: str):
        value = F.try_element_at("f", F.lit(name))
        return F.when(value.isNull() | F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), "null").otherwise(F.to_json(value)).alias(name)

    parent = edges.where("label = 'child'").groupBy(F.col("dst").alias("key")).agg(F.min("src").alias("_parent"))
    children = edges.where("label = 'child'").groupBy(F.col("src").alias("key")).agg(F.count_distinct("dst").alias("_child_count"))
    table = fields.select("key", *(cell(c) for c in columns)).join(parent, "key", "left").join(children, "key", "left")
    return table.withColumn("_child_count", F.coalesce("_child_count", F.lit(0).cast("long")))
