"""Queries over column functions, checks, digests, set operations and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import crdt as C
from ..operators import documents as D
from ..operators import files as X
from ..operators import ledger as L
from ..operators import placement as P
from ..sources import ingest
from . import tables as T
from .consistency import _CHAIN_SQL, _MERGE_SQL, _chain, _envelopes, _keys
from .tables import FILES_SQL, LEDGER_SQL, OPS_SQL, ORDERS_SQL, PEERS_SQL, table


def _cells(s, d):
    k = F.col("c_custkey")
    cell = F.when(k % 6 == 0, "1d").when(k % 6 == 1, "NaN").when(k % 6 == 2, " 12.5 ").when(k % 6 == 3, "").when(k % 6 == 4, "0x1F").otherwise(k.cast("string"))
    return ingest.typed(table(s, d, "customer").select("c_custkey", cell.alias("cell")), ["cell"])


def _unchained(s, d):
    gone = (F.col("lsn") == 1) & (F.col("node").cast("int") % 3 == 0)
    return _chain(s, d).where(~gone)


_UNCHAINED_SQL = f"{_CHAIN_SQL}, left_over AS (SELECT * FROM chain WHERE NOT (lsn = 1 AND node::INT % 3 = 0)), l AS (SELECT *, lag(entry_hash) OVER (PARTITION BY node ORDER BY lsn) AS before FROM left_over)"


def _signed(s, d):
    return T.ledger(s, d).withColumn("signature", F.when(F.col("lsn") % 3 == 0, "sig").when(F.col("lsn") % 3 == 1, ""))


def _decode(s, d):
    html = F.base64(F.col("html").cast("binary"))
    sent = F.when(F.col("page_id") % 5 == 0, F.concat(html, F.lit("!"))).otherwise(html)
    return table(s, d, "pages").select("page_id", F.octet_length(F.try_to_binary(sent, F.lit("base64"))).cast("long").alias("size"))


def _vote(s, d, lsn: int):
    tips = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("node"), (F.col("n_nationkey") % 3).cast("long").alias("lsn"), F.lit("a").alias("entry_hash"))
    return L.quorum(tips, lsn, "a", 5)


_PLAN_SQL = f"""WITH {LEDGER_SQL}, c AS (SELECT DISTINCT key_hash FROM ledger WHERE type = 'CLAIM'),
    g AS (SELECT key_hash FROM ledger WHERE type = 'INTENT' AND lsn <= 900 INTERSECT SELECT key_hash FROM ledger WHERE type = 'CLAIM' AND lsn <= 900),
    w AS (SELECT count(DISTINCT key_hash) AS waiting FROM ledger WHERE type = 'INTENT' AND lsn <= 900 AND key_hash NOT IN (SELECT key_hash FROM c)),
    r AS (SELECT count(*) AS removed FROM ledger WHERE type IN ('INTENT', 'CLAIM') AND lsn <= 900 AND key_hash IN (SELECT key_hash FROM g))
    SELECT 'ok' AS decision, waiting, removed, waiting = 0 AS allowed FROM w, r"""


def _messages(s, d):
    return table(s, d, "events").select(F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string")).alias("message_id"), F.col("event_id").alias("at"))


def _holds(s, d):
    return T.ledger(s, d).select("lsn", F.col("node").alias("owner"), "key_hash", F.when(F.col("type") == "PUT", "HOLD").otherwise("RELEASE").alias("type"))


def _hits(s, d):
    return table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("collection"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("key"))


def _members(s, d):
    c = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True).select("name", "segment", F.round("balance", 2).alias("balance"))


def _assembled(s, d):
    p = table(s, d, "pages").where("html is not null")
    total = F.greatest(F.ceil(F.char_length("html") / 500), F.lit(1)).cast("int")
    parts = p.select("page_id", "html", total.alias("chunk_total"), F.explode(F.sequence(F.lit(0), total - 1)).alias("chunk_index"))
    sent = parts.select(F.col("page_id").alias("key_hash"), "chunk_total", "chunk_index", F.substring("html", F.col("chunk_index") * 500 + 1, F.lit(500)).alias("payload")).where("not (key_hash % 4 = 0 and chunk_index = 0)")
    return L.assemble_chunks(sent).select("key_hash", F.sha2(F.col("payload").cast("binary"), 256).alias("sha256"))


def _versions(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_mktsegment").alias("collection"), (F.col("c_custkey") * 37 % 1009).alias("updated_ms"), (F.col("c_custkey") % 2 == 0).alias("private"), F.col("c_custkey").alias("owner"))


def _health(s, d):
    """Every check's problems as one table: (check, problems)."""
    chain = L.verify(_chain(s, d)).agg(F.sum("bad_links").alias("problems")).select(F.lit("links").alias("check"), "problems")
    vectors = table(s, d, "embeddings").join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").agg(F.count(F.lit(1)).alias("problems"))
    orders = table(s, d, "lineitem").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("problems"))
    return chain.unionByName(vectors.select(F.lit("vectors").alias("check"), "problems")).unionByName(orders.select(F.lit("parents").alias("check"), "problems"))


Q = {
    "f01_align_down": (lambda s, d: table(s, d, "events").select("event_id", scalars.align_down(F.col("event_id") - 500, 60).alias("floor")), "SELECT event_id, (event_id - 500) - ((event_id - 500) % 60 + 60) % 60 AS floor FROM events"),
    "f09_placement_input": (
        lambda s, d: _keys(s, d).select("key", P.placement_input(F.col("collection"), F.col("key"), F.col("shard")).alias("input")),
        "SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 4 = 0 THEN 'cust|' || c_mktsegment ELSE 'cust/' || c_custkey END AS input FROM customer",
    ),
    "f10_normalize": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.element_at(scalars.normalize(F.col("embedding")), 1), 5).alias("first")),
        "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings",
    ),
    "f11_quantize": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.aggregate(scalars.quantize(F.col("embedding")), F.lit(0), lambda a, x: a + x).cast("long").alias("total")),
        "SELECT vec_id, list_sum(list_transform(embedding, lambda x: round(greatest(least(x::DOUBLE, 1.0), -1.0) * 127)::INT))::BIGINT AS total FROM embeddings",
    ),
    "f12_cosine_from_l2": (
        lambda s, d: table(s, d, "events").select("event_id", F.round(scalars.cosine_from_l2(F.col("user_id") / 10000.0), 9).alias("cosine")),
        "SELECT event_id, round(1 - (user_id / 10000.0::DOUBLE) * (user_id / 10000.0::DOUBLE) / 2, 9) AS cosine FROM events",
    ),
    "f13_text": (
        lambda s, d: table(s, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("low"), F.startswith("c_mktsegment", F.lit("B")).alias("starts"), F.contains("c_mktsegment", F.lit("I")).alias("holds"), F.substring("c_name", 1, 10).alias("preview"), F.element_at(F.split("c_name", "#"), -1).alias("tail")),
        "SELECT c_custkey, lower(c_mktsegment) AS low, starts_with(c_mktsegment, 'B') AS starts, contains(c_mktsegment, 'I') AS holds, substr(c_name, 1, 10) AS preview, string_split(c_name, '#')[-1] AS tail "
        "FROM customer",
    ),
    "f17_skew_filter": (lambda s, d: T.orders_docs(s, d).where(scalars.within_skew(F.col("updated_ms"), 800_000_000_000)).select("collection", "key"), f"WITH {ORDERS_SQL} SELECT collection, key FROM docs WHERE updated_ms <= 800000300000"),
    "f19_base64": (_decode, "SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN strlen(html) END::BIGINT AS size FROM pages"),
    "p01_field_access": (lambda s, d: table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k")), "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events"),
    "x08_flat_text": (
        lambda s, d: table(s, d, "events").select("event_id", D.flat_text(F.concat(F.lit('{"a": [true, null, 1.5], "b": '), "props", F.lit("}"))).alias("flat")),
        "SELECT event_id, 'a true 1.5 b k ' || (props::JSON ->> '$.k') AS flat FROM events",
    ),
    "s22_number_cells": (_cells, "SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN 12.5::DOUBLE WHEN 5 THEN c_custkey::DOUBLE END AS cell FROM customer"),
    "n04_file_category": (
        lambda s, d: T.files(s, d).select("key", scalars.file_category(F.col("mime"), F.col("filename")).alias("category"), scalars.size_class(F.col("size_bytes")).alias("size_class")),
        f"WITH {FILES_SQL} SELECT key, CASE mime WHEN 'image/png' THEN 'image' WHEN 'text/html' THEN 'code' ELSE 'other' END AS category, CASE "
        f"WHEN size_bytes < 1048576 THEN 'small' WHEN size_bytes <= 10485760 THEN 'medium' ELSE 'large' END AS size_class FROM files",
    ),
    "n05_hlc_parse": (
        lambda s, d: T.orders_docs(s, d).select("key", scalars.parse_hlc(F.col("clock")).alias("h")).select("key", "h.physical_ms", "h.logical", "h.node_id"),
        f"WITH {ORDERS_SQL} SELECT key, updated_ms AS physical_ms, 0::BIGINT AS logical, 'n' || (cust % 5) AS node_id FROM docs",
    ),
    "a05_spread_checksum": (lambda s, d: D.spread_fingerprint(T.orders_docs(s, d)), f"""WITH {ORDERS_SQL}, h AS (SELECT collection, sha256(key || '=' || clock) AS x FROM docs WHERE NOT deleted)
        SELECT collection, count(*) AS docs, concat_ws('-', {', '.join(f"sum(('0x' || substr(x, {15 * k + 1}, 15))::BIGINT)::VARCHAR" for k in range(4))}) AS checksum FROM h GROUP BY 1"""),
    "a09_verify_counts": (lambda s, d: L.signature_counts(_signed(s, d)), "SELECT count(*) AS checked, count(*) FILTER (event_id % 3 = 0) AS signed, count(*) FILTER (event_id % 3 <> 0) AS unsigned FROM events"),
    "a11_tallest_ledger": (lambda s, d: L.tallest(T.ledger(s, d)), f"WITH {LEDGER_SQL} SELECT max(lsn) AS height, arg_max(node, lsn) AS node FROM ledger"),
    "a15_collection_stats": (
        lambda s, d: D.collection_stats(T.orders_docs(s, d)),
        f"WITH {ORDERS_SQL} "
        f"SELECT collection, count(*) AS docs, count(*) FILTER (deleted) AS deleted, min(key) AS first_key, max(key) AS last_key, sum(strlen(doc))::BIGINT AS bytes FROM docs "
        f"GROUP BY 1",
    ),
    "a18_node_collections": (
        lambda s, d: D.node_collections(T.orders_docs(s, d).withColumn("node", F.concat(F.lit("n"), (F.col("cust") % 3).cast("string")))),
        f"WITH {ORDERS_SQL} SELECT 'n' || (cust % 3) AS node, collection, count(*) AS docs FROM docs WHERE NOT deleted GROUP BY 1, 2",
    ),
    "w01_chain_links": (lambda s, d: L.links(_unchained(s, d)).select("node", "lsn", "linked"), f"{_UNCHAINED_SQL} SELECT node, lsn, prev_hash = coalesce(before, repeat('0', 64)) AS linked FROM l"),
    "w02_segment_links": (lambda s, d: L.segment_linked(_unchained(s, d)), f"{_UNCHAINED_SQL} SELECT node, count(*) AS entries, bool_and(before IS NULL OR prev_hash = before) AS linked FROM l GROUP BY 1"),
    "l06_rechained": (
        lambda s, d: L.build_chain(T.talk_ledger(s, d).where("lsn <> 1")).select("node", "lsn", "prev_hash", "entry_hash"),
        _CHAIN_SQL.replace("FROM conversations)", "FROM conversations WHERE turn <> 1)") + " SELECT node, lsn, prev_hash, entry_hash FROM chain",
    ),
    "l05_checkpoint_plan": (lambda s, d: L.checkpoint_plan(T.ledger(s, d), _vote(s, d, 1), 900), _PLAN_SQL),
    "l08_health": (
        _health,
        "SELECT 'links' AS \"check\", 0::HUGEINT AS problems UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents "
        "WHERE doc_id IS NOT NULL) UNION ALL SELECT 'parents', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    ),
    "j07_hit_documents": (lambda s, d: D.fetch(_hits(s, d), T.orders_docs(s, d)).select("collection", "key", "doc"), f"WITH {ORDERS_SQL} SELECT collection, key, doc FROM docs WHERE status = 'F' AND NOT deleted"),
    "j10_rows_without_vector": (
        lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("vec_id")).join(table(s, d, "embeddings").select("vec_id"), "vec_id", "left_anti"),
        "SELECT o_orderkey AS vec_id FROM orders WHERE o_orderkey NOT IN (SELECT vec_id FROM embeddings)",
    ),
    "k01_row_counts": (
        lambda s, d: T.orders_docs(s, d).groupBy("collection").agg(F.count(F.lit(1)).alias("found"), F.count_distinct("key").alias("keys")).withColumn("agree", F.col("found") == F.col("keys")),
        f"WITH {ORDERS_SQL} SELECT collection, count(*) AS found, count(DISTINCT key) AS keys, count(*) = count(DISTINCT key) AS agree FROM docs GROUP BY 1",
    ),
    "u02_all_collections": (
        lambda s, d: D.collections(T.orders_docs(s, d)).union(D.collections(T.files(s, d))).union(D.collections(T.orders_docs(s, d))).distinct(),
        "SELECT o_orderpriority AS collection FROM orders UNION SELECT 'assets' FROM pages",
    ),
    "u04_member_columns": (_members, "SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, NULL, round(s_acctbal, 2) FROM supplier"),
    "m09_first_deliveries": (
        lambda s, d: L.first_deliveries(_messages(s, d)),
        "SELECT user_id::VARCHAR AS message_id, min(event_id) AS at FROM events WHERE user_id % 10 <> 0 GROUP BY 1 UNION ALL SELECT '', event_id FROM events WHERE user_id % 10 = 0",
    ),
    "m12_pending_holds": (lambda s, d: L.pending(_holds(s, d)).select("owner", "key_hash", "lsn"), f"WITH {LEDGER_SQL} SELECT node AS owner, key_hash, max(lsn) AS lsn FROM ledger GROUP BY 1, 2 HAVING arg_max(type, lsn) = 'PUT'"),
    "c05_merge_within_skew": (
        lambda s, d: C.merge(T.customer_ops(s, d).where(scalars.within_skew(F.col("hlc.physical_ms"), 0, 5))).select("key", F.array_join("path", ".").alias("path"), "value"),
        "SELECT key, path, value FROM (" + _MERGE_SQL.replace("FROM ops)", "FROM ops WHERE ms <= 5)") + ")",
    ),
    "c06_digest": (lambda s, d: L.digest(T.orders_docs(s, d).withColumn("hlc", F.col("clock"))), f"WITH {ORDERS_SQL} SELECT collection, key, clock AS hlc, substr(sha256(doc), 1, 16) AS hash FROM docs"),
    "r05_newest_acl": (
        lambda s, d: D.newest_acl(_versions(s, d).groupBy("collection", "updated_ms").agg(F.max("owner").alias("owner"))),
        "SELECT collection, max(k) AS updated_ms, max(c_custkey) FILTER (k = top) AS owner FROM (SELECT *, max(k) OVER (PARTITION BY collection) AS top "
        "FROM (SELECT c_mktsegment AS collection, c_custkey, c_custkey * 37 % 1009 AS k FROM customer)) GROUP BY 1",
    ),
    "r07_claims_by_holder": (
        lambda s, d: L.claims_by_holder(_envelopes(s, d).withColumnRenamed("owner", "holder")),
        "SELECT 'o' || (o_custkey % 20) AS holder, count(*) AS claims, min(o_orderkey::VARCHAR) AS first, max(o_orderkey::VARCHAR) AS last FROM orders GROUP BY 1",
    ),
    "n06_ingest_node": (lambda s, d: P.ingest_node(T.peers(s, d), "n3"), f"WITH {PEERS_SQL} SELECT node FROM peers WHERE state = 'active' ORDER BY node = 'n3' DESC, quota - used DESC, node LIMIT 1"),
    "n07_stale_peers": (lambda s, d: P.stale(T.peers(s, d), 1_000_000, 60_000), f"WITH {PEERS_SQL} SELECT node FROM peers WHERE 1000000 - seen_ms > 60000"),
    "n15_claimed_messages": (_assembled, "SELECT page_id AS key_hash, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL AND page_id % 4 <> 0"),
    "t07_files_by_name": (lambda s, d: X.page(T.files(s, d), "filename", 0, 50).select("key", "filename"), f"WITH {FILES_SQL} SELECT key, filename FROM files ORDER BY filename, collection, key LIMIT 50"),
}
