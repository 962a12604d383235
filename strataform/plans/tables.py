"""The test tables as documents, points, edges, ledgers and replicas, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_docs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents: collection, key, deleted, updated_ms, clock, doc."""
    o = table(spark, d, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.col("o_orderpriority").alias("collection"),
        F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("key"),
        (F.col("o_orderkey") % 17 == 0).alias("deleted"),
        ms.alias("updated_ms"),
        F.concat(ms.cast("string"), F.lit(".0@n"), (F.col("o_custkey") % 5).cast("string")).alias("clock"),
        F.concat(F.lit("status "), "o_orderstatus").alias("doc"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("cust"),
    )


ORDERS_SQL = """docs AS (SELECT o_orderpriority AS collection, lpad(o_orderkey::VARCHAR, 8, '0') AS key, o_orderkey % 17 = 0 AS deleted,
    epoch_ms(o_orderdate) AS updated_ms, epoch_ms(o_orderdate)::VARCHAR || '.0@n' || (o_custkey % 5)::VARCHAR AS clock,
    'status ' || o_orderstatus AS doc, o_orderstatus AS status, o_totalprice AS price, o_custkey AS cust FROM orders)"""


def event_points(spark: SparkSession, d: str) -> DataFrame:
    """Events as points: key, series, ts_ms, value."""
    return table(spark, d, "events").select(F.lpad(F.col("event_id").cast("string"), 9, "0").alias("key"), F.col("event_type").alias("series"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")


POINTS_SQL = "points AS (SELECT lpad(event_id::VARCHAR, 9, '0') AS key, event_type AS series, epoch_us(ts) // 1000 AS ts_ms, value FROM events)"


def event_docs(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON documents with and without a time of their own."""
    e = table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    body = F.concat(F.lit('{"value": '), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "ts": '), ms.cast("string"))).otherwise(""), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "series": "'), "event_type", F.lit('"'))).otherwise(""), F.lit("}"))
    return e.select(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("key"), body.alias("doc"), (ms + 1).alias("updated_ms"), F.lit("events").alias("collection"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as file manifests."""
    p = table(spark, d, "pages")
    return p.select(
        F.lit("assets").alias("collection"),
        F.lpad(F.col("page_id").cast("string"), 8, "0").alias("key"),
        F.concat(F.when(F.col("page_id") % 3 == 0, "Photo").otherwise("page"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".png").when(F.col("page_id") % 3 == 1, ".html").otherwise(".bin")).alias("filename"),
        F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "text/html").otherwise("application/x").alias("mime"),
        F.char_length("html").cast("long").alias("size_bytes"),
        (F.lit(1_700_000_000_000) + F.col("page_id") * 3_600_000).alias("created_ms"),
        F.col("html").alias("excerpt"),
    )


FILES_SQL = """files AS (SELECT 'assets' AS collection, lpad(page_id::VARCHAR, 8, '0') AS key,
    (CASE WHEN page_id % 3 = 0 THEN 'Photo' ELSE 'page' END) || page_id::VARCHAR || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.html' ELSE '.bin' END AS filename,
    CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' ELSE 'application/x' END AS mime,
    length(html)::BIGINT AS size_bytes, 1700000000000 + page_id * 3600000 AS created_ms, html AS excerpt FROM pages)"""


def geo_docs(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers and suppliers as a tree, with a few edges of their own."""
    none, kids = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    links = F.lit(None).cast("array<struct<target:string,label:string>>")

    def doc(df, key, parent, cls, name, num):
        return df.select(key.alias("key"), parent.alias("parent"), kids.alias("children"), links.alias("edges"), none.alias("from_key"), none.alias("to_key"), none.alias("label"), F.lit(cls).alias("class"), name.alias("name"), num.cast("double").alias("balance"))

    r, n, c, s = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    out = doc(r, key("r", "r_regionkey"), none, "region", F.col("r_name"), F.lit(None))
    out = out.unionByName(doc(n, key("n", "n_nationkey"), key("r", "n_regionkey"), "nation", F.col("n_name"), F.lit(None)))
    out = out.unionByName(doc(c, key("c", "c_custkey"), key("n", "c_nationkey"), "customer", F.col("c_name"), F.col("c_acctbal")))
    sup = doc(s, key("s", "s_suppkey"), key("n", "s_nationkey"), "supplier", F.col("s_name"), F.col("s_acctbal"))
    sup = sup.withColumn("edges", F.array(F.struct(F.concat(F.lit("s"), ((F.substring("key", 2, 20).cast("int") + 1) % 7).cast("string")).alias("target"), F.lit("next").alias("label"))))
    return out.unionByName(sup)


GEO_SQL = """edges AS (
    SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'child' AS label FROM nation
    UNION SELECT 'n' || c_nationkey, 'c' || c_custkey, 'child' FROM customer
    UNION SELECT 'n' || s_nationkey, 's' || s_suppkey, 'child' FROM supplier
    UNION SELECT 's' || s_suppkey, 's' || ((s_suppkey + 1) % 7), 'next' FROM supplier)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events as ledger entries: lsn, type, collection, key, key_hash, node."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "INTENT").when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), "CLAIM").when(F.col("event_type") == "view", "DELETE").otherwise("PUT")
    return e.select(F.col("event_id").alias("lsn"), kind.alias("type"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("collection"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("key_hash"), F.concat(F.lit("n"), (F.col("event_id") % 4).cast("string")).alias("node"))


LEDGER_SQL = """ledger AS (SELECT event_id AS lsn, CASE WHEN event_type = 'error' THEN 'INTENT' WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'CLAIM'
    WHEN event_type = 'view' THEN 'DELETE' ELSE 'PUT' END AS type, 'c' || (user_id % 3) AS collection, 'k' || user_id AS key, 'h' || user_id AS key_hash, 'n' || (event_id % 4) AS node FROM events)"""


def talk_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as one ledger each."""
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("node"), F.col("turn").alias("lsn"), F.lit("PUT").alias("type"), F.col("role").alias("collection"), F.col("conv_id").cast("string").alias("key"), F.col("text").alias("payload"))


def customer_ops(spark: SparkSession, d: str) -> DataFrame:
    """Field writes of customers by two replicas, with a delete of a parent object now and then."""
    c = table(spark, d, "customer")
    h = lambda ms, node: F.struct(ms.cast("long").alias("physical_ms"), F.lit(0).cast("long").alias("logical"), F.lit(node).alias("node_id"))
    k = F.col("c_custkey")
    op = lambda path, kind, value, clock, gone: F.struct(F.array(*[F.lit(p) for p in path]).alias("path"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), clock.alias("hlc"), gone.alias("tombstone"))
    no = F.lit(False)
    null = F.lit(None).cast("string")
    ops = F.array(
        op(["name"], "string", F.col("c_name"), h(k % 10, "a"), no),
        op(["name"], "string", F.upper("c_name"), h(k % 7, "b"), no),
        op(["segment"], "string", F.col("c_mktsegment"), h(k % 3, "a"), no),
        op(["segment"], "string", null, h(k % 5, "b"), F.lit(True)),
        op(["address"], "object", null, h(F.lit(1), "a"), no),
        op(["address", "nation"], "int", F.col("c_nationkey"), h(k % 4, "a"), no),
        op(["address"], "object", null, h(k % 6, "b"), k % 2 == 0),
    )
    return c.select(F.lit("customer").alias("collection"), F.col("c_custkey").cast("string").alias("key"), F.explode(ops).alias("o")).select("collection", "key", "o.*")


OPS_SQL = """ops AS (
    SELECT c_custkey::VARCHAR AS key, u.* FROM customer, LATERAL (VALUES
        ('name', 'string', c_name, c_custkey % 10, 'a', false), ('name', 'string', upper(c_name), c_custkey % 7, 'b', false),
        ('segment', 'string', c_mktsegment, c_custkey % 3, 'a', false), ('segment', 'string', NULL, c_custkey % 5, 'b', true),
        ('address', 'object', NULL, 1, 'a', false), ('address.nation', 'int', c_nationkey::VARCHAR, c_custkey % 4, 'a', false),
        ('address', 'object', NULL, c_custkey % 6, 'b', c_custkey % 2 = 0)) u(path, kind, value, ms, node, gone))"""


def peers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as peers."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("n"), k.cast("string")).alias("node"),
        F.when(k % 11 == 0, "bootstrap").when(k % 13 == 0, "supervisor").otherwise("member").alias("role"),
        F.when(k % 5 == 0, "degraded").when(k % 9 == 0, "reclaimed").otherwise("active").alias("state"),
        (F.lit(1_000_000) - k * 900).cast("long").alias("seen_ms"),
        (k % 4).cast("int").alias("failures"),
        (k % 10 / 10.0).alias("reliability"),
        (k % 200).cast("double").alias("latency"),
        (k * 1000).cast("long").alias("used"),
        F.lit(60_000).cast("long").alias("quota"),
    )


PEERS_SQL = """peers AS (SELECT 'n' || s_suppkey AS node, CASE WHEN s_suppkey % 11 = 0 THEN 'bootstrap' WHEN s_suppkey % 13 = 0 THEN 'supervisor' ELSE 'member' END AS role,
    CASE WHEN s_suppkey % 5 = 0 THEN 'degraded' WHEN s_suppkey % 9 = 0 THEN 'reclaimed' ELSE 'active' END AS state, 1000000 - s_suppkey * 900 AS seen_ms,
    s_suppkey % 4 AS failures, (s_suppkey % 10) / 10.0::DOUBLE AS reliability, (s_suppkey % 200)::DOUBLE AS latency, s_suppkey * 1000 AS used, 60000 AS quota FROM supplier)"""


def nodes(spark: SparkSession, n: int = 5) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node"))
