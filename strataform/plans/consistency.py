"""Queries over ledgers, concurrent versions, placement and peers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import chunk_hash, ring_position
from ..operators import crdt as C
from ..operators import documents as D
from ..operators import ledger as L
from ..operators import placement as P
from . import tables as T
from .tables import LEDGER_SQL, OPS_SQL, ORDERS_SQL, PEERS_SQL, table


def _chain(s, d):
    return L.build_chain(T.talk_ledger(s, d))


_CHAIN_SQL = """WITH RECURSIVE t AS (SELECT conv_id::VARCHAR AS node, turn AS lsn, role AS collection, text AS payload, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    chain(node, rn, lsn, prev_hash, entry_hash) AS (
        SELECT node, rn, lsn, repeat('0', 64), sha256('64:' || repeat('0', 64) || length(lsn::VARCHAR) || ':' || lsn || '3:PUT' || length(collection) || ':' || collection || length(node) || ':' || node || length(payload) || ':' || payload) FROM t WHERE rn = 1
        UNION ALL SELECT t.node, t.rn, t.lsn, c.entry_hash, sha256('64:' || c.entry_hash || length(t.lsn::VARCHAR) || ':' || t.lsn || '3:PUT' || length(collection) || ':' || collection || length(t.node) || ':' || t.node || length(payload) || ':' || payload)
        FROM chain c JOIN t ON t.node = c.node AND t.rn = c.rn + 1)"""


def _tampered(s, d):
    c = _chain(s, d)
    return L.verify(c.withColumn("payload", F.when((F.col("lsn") == 1) & (F.col("node").cast("int") % 5 == 0), "forged").otherwise(F.col("payload"))))


def _replica(s, d, other: bool):
    o = T.orders_docs(s, d)
    k = F.col("key").cast("int")
    rows = o.withColumn("hlc", F.struct((F.col("updated_ms") + (F.when(k % 6 == (1 if other else 2), 1).otherwise(0))).alias("physical_ms"), F.lit(0).cast("long").alias("logical"), F.lit("a").alias("node_id")))
    rows = rows.withColumn("doc", F.when(F.lit(other) & (k % 6 == 3), F.lit("x")).otherwise(F.col("doc")))
    return L.digest(rows.where(k % 6 != (4 if other else 5)))


_DIFF_SQL = f"""WITH {ORDERS_SQL}, k AS (SELECT collection, key, key::INT % 6 AS m FROM docs)
    SELECT collection, key, unnest(CASE m WHEN 1 THEN ['want'] WHEN 2 THEN ['push'] WHEN 3 THEN ['push', 'want'] WHEN 4 THEN ['push'] WHEN 5 THEN ['want'] END) AS action FROM k WHERE m > 0"""


def _merged(s, d):
    m = C.merge(T.customer_ops(s, d))
    return m.select("key", F.array_join("path", ".").alias("path"), "value", F.col("hlc.physical_ms").alias("ms"))


_MERGE_SQL = f"""WITH {OPS_SQL}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, path ORDER BY ms DESC, node DESC, gone DESC) AS rn FROM ops) WHERE rn = 1)
    SELECT w.key, w.path, w.value, w.ms::BIGINT AS ms FROM w LEFT JOIN w p ON p.key = w.key AND w.path = 'address.nation' AND p.path = 'address' AND p.gone
    WHERE NOT w.gone AND (p.key IS NULL OR (w.ms, w.node) > (p.ms, p.node))"""


def _sets(s, d):
    li = table(s, d, "lineitem")
    e = li.select(F.lit("c").alias("collection"), F.col("l_orderkey").cast("string").alias("key"), F.array(F.lit("tags")).alias("path"), F.concat(F.col("l_orderkey").cast("string"), F.lit("#"), (F.col("l_linenumber") % 3).cast("string")).alias("tag"), (F.col("l_returnflag") == "R").alias("tombstone"), F.col("l_linestatus").alias("value"), F.col("l_linenumber").alias("position"))
    return C.merge_sets(e).select("key", "tag", F.col("position").cast("long").alias("position"))


def _update(s, d):
    old = _flat(s, d)
    new = old.withColumn("value", F.when(F.col("key").cast("int") % 4 == 0, "9").otherwise(F.concat("value", F.lit(".0")))).withColumn("kind", F.lit("double")).where("cast(key AS int) % 5 <> 0")
    return C.update_ops(old, new, F.struct(F.lit(9).cast("long").alias("physical_ms"), F.lit(0).cast("long").alias("logical"), F.lit("a").alias("node_id"))).groupBy("tombstone").agg(F.count(F.lit(1)).alias("n"))


def _flat(s, d):
    return table(s, d, "customer").select(F.lit("c").alias("collection"), F.col("c_custkey").cast("string").alias("key"), F.array(F.lit("nation")).alias("path"), F.lit("int").alias("kind"), F.col("c_nationkey").cast("string").alias("value"))


def _keys(s, d):
    return table(s, d, "customer").select(F.lit("cust").alias("collection"), F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise("").alias("shard"))


def _placed(s, d):
    return P.replicas(_keys(s, d), T.nodes(s), 3)


_RING_SQL = """ring AS (SELECT 'n' || n AS node, substr(sha256('n' || n || '#' || v), 1, 16) AS position FROM range(5) a(n), range(160) b(v)),
    keys AS (SELECT 'cust' AS collection, c_custkey::VARCHAR AS key, substr(sha256(CASE WHEN c_custkey % 4 = 0 THEN 'cust|' || c_mktsegment ELSE 'cust/' || c_custkey END), 1, 16) AS position FROM customer),
    per AS (SELECT k.collection, k.key, r.node, min((r.position < k.position)::INT::VARCHAR || r.position) AS turn FROM keys k, ring r GROUP BY 1, 2, 3),
    placed AS (SELECT collection, key, list(node ORDER BY turn)[1:3] AS replicas FROM per GROUP BY 1, 2)"""


def _plan(s, d):
    held = _keys(s, d).select("collection", "key", F.array(F.lit("n0"), F.lit("n1")).alias("held"))
    return P.plan(_placed(s, d), held, 3).select("key", "primary", F.array_join("missing", ",").alias("missing"), "under_replicated", F.array_join("displaced", ",").alias("displaced"))


def _envelopes(s, d):
    o = table(s, d, "orders")
    return o.select(F.concat(F.lit("o"), (F.col("o_custkey") % 20).cast("string")).alias("owner"), F.col("o_orderkey").cast("string").alias("key_hash"), F.col("o_totalprice").cast("long").alias("bytes"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") * 10).cast("long").alias("expires_ms"))


_ENV_SQL = "env AS (SELECT 'o' || (o_custkey % 20) AS owner, o_orderkey::VARCHAR AS key_hash, trunc(o_totalprice)::BIGINT AS bytes, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey * 10 END AS expires_ms FROM orders)"


def _mail(s, d):
    return table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner"), F.col("o_orderkey").cast("string").alias("key_hash"), F.col("o_totalprice").cast("long").alias("bytes"))


def _receipts(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_suppkey").alias("applier"))


def _ewma(s, d):
    e = table(s, d, "events").select(F.concat(F.lit("n"), (F.col("event_id") % 4).cast("string")).alias("node"), F.col("event_id").alias("at"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"))
    return P.ewma(e).select("node", F.round("latency", 6).alias("latency"), F.round("success", 6).alias("success"))


_EWMA_SQL = """WITH p AS (SELECT 'n' || (event_id % 4) AS node, event_id, value, event_type <> 'error' AS ok FROM events),
    x AS (SELECT node, 'success' AS what, event_id, ok::INT::DOUBLE AS v FROM p UNION ALL SELECT node, 'latency', event_id, value FROM p WHERE ok),
    o AS (SELECT *, row_number() OVER (PARTITION BY node, what ORDER BY event_id DESC) - 1 AS age, row_number() OVER (PARTITION BY node, what ORDER BY event_id) = 1 AS first FROM x),
    f AS (SELECT node, what, sum(v * pow(0.75::DOUBLE, age) * CASE WHEN first THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS m FROM o GROUP BY 1, 2)
    SELECT node, round(max(m) FILTER (what = 'latency'), 6) AS latency, round(max(m) FILTER (what = 'success'), 6) AS success FROM f GROUP BY 1"""


def _fitness(s, d):
    p = T.peers(s, d)
    return P.ranked(p.select("node", P.fitness(F.col("reliability"), F.col("latency"), F.lit(0.5), F.lit(1.0)).alias("score"))).select("node", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _holders(s, d):
    m = table(s, d, "orders").select(F.lit("n1").alias("owner"), F.col("o_orderkey").cast("string").alias("key_hash"), (F.col("o_orderkey") % 3).cast("int").alias("chunk"))
    return P.transit_holders(m, T.nodes(s), 3).select("key_hash", F.col("chunk").cast("long").alias("chunk"), F.col("rank").cast("long").alias("rank"), "node")


_HOLDERS_SQL = """WITH m AS (SELECT o_orderkey::VARCHAR AS key_hash, o_orderkey % 3 AS chunk FROM orders),
    w AS (SELECT key_hash, chunk, node, row_number() OVER (PARTITION BY key_hash ORDER BY sha256('n1|' || key_hash || '|' || node) DESC) - 1 AS r FROM m, (SELECT 'n' || n AS node FROM range(5) t(n)) WHERE node <> 'n1')
    SELECT key_hash, chunk::BIGINT AS chunk, ((r - chunk) % 3 + 3) % 3 AS rank, node FROM w WHERE r < 3"""


def _admit(s, d):
    w = table(s, d, "orders").select(F.concat(F.lit("n"), (F.col("o_custkey") % 10).cast("string")).alias("node"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("long").alias("growth"), (F.col("o_orderkey") % 2 == 0).alias("merge"))
    return D.admit(w, 10_000_000).groupBy("node").agg(F.count_if("admitted").alias("admitted"))


Q = {
    "l01_chain_build": (lambda s, d: _chain(s, d).select("node", "lsn", "entry_hash"), f"{_CHAIN_SQL} SELECT node, lsn, entry_hash FROM chain"),
    "l02_chain_verify": (
        _tampered,
        """SELECT conv_id::VARCHAR AS node, count(*) AS checked, 0::BIGINT AS bad_links, count(*) FILTER (turn = 1 AND conv_id % 5 = 0) AS bad_content, min(CASE WHEN turn = 1 AND conv_id % 5 = 0 THEN turn END) AS first_bad FROM conversations GROUP BY 1, conv_id""",
    ),
    "l03_tips": (lambda s, d: L.tips(_chain(s, d)), f"{_CHAIN_SQL} SELECT node, max(lsn) AS lsn, max_by(entry_hash, lsn) AS entry_hash FROM chain GROUP BY 1"),
    "m01_changes_since": (lambda s, d: L.changes(T.ledger(s, d), 500).select("lsn", "type", "key"), f"WITH {LEDGER_SQL} SELECT lsn, type, key FROM ledger WHERE lsn > 500 ORDER BY lsn LIMIT 256"),
    "m01_feed_truncated": (lambda s, d: L.truncated(T.ledger(s, d).where("lsn >= 100"), 50), f"WITH {LEDGER_SQL} SELECT min(lsn) AS oldest, max(lsn) AS tip, true AS truncated FROM ledger WHERE lsn >= 100"),
    "s16_ledger_range": (lambda s, d: L.entry_range(T.ledger(s, d), 100, 9000, 5000).select("lsn", "key"), f"WITH {LEDGER_SQL} SELECT lsn, key FROM ledger WHERE lsn BETWEEN 100 AND 9000 ORDER BY lsn LIMIT 5000"),
    "w03_latest_put": (lambda s, d: L.recover(T.ledger(s, d)).select("collection", "key", "lsn"), f"WITH {LEDGER_SQL} SELECT collection, key, max(lsn) AS lsn FROM ledger WHERE type = 'PUT' GROUP BY 1, 2"),
    "j04_unclaimed_intents": (
        lambda s, d: L.unclaimed(T.ledger(s, d), 900),
        f"WITH {LEDGER_SQL} SELECT DISTINCT key_hash FROM ledger WHERE type = 'INTENT' AND lsn <= 900 AND key_hash NOT IN (SELECT key_hash FROM ledger WHERE type = 'CLAIM')",
    ),
    "j05_settled_pairs": (
        lambda s, d: L.settled(T.ledger(s, d), 900).select("lsn", "key_hash"),
        f"WITH {LEDGER_SQL} SELECT lsn, key_hash FROM ledger WHERE type = 'INTENT' AND lsn <= 900 AND key_hash IN (SELECT key_hash FROM ledger WHERE type = 'CLAIM' AND lsn <= 900)",
    ),
    "j06_prune_survivors": (
        lambda s, d: L.prune(T.ledger(s, d), 900).groupBy("type").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {LEDGER_SQL}, g AS (SELECT key_hash FROM ledger WHERE type = 'INTENT' AND lsn <= 900 INTERSECT SELECT key_hash FROM ledger WHERE type = 'CLAIM' AND lsn <= 900) "
        f"SELECT type, count(*) AS n FROM ledger WHERE NOT (type IN ('INTENT', 'CLAIM') AND lsn <= 900 AND key_hash IN (SELECT key_hash FROM g)) GROUP BY 1",
    ),
    "a10_quorum_decision": (
        lambda s, d: L.quorum(table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("node"), (F.col("n_nationkey") % 3).cast("long").alias("lsn"), F.when(F.col("n_nationkey") % 12 == 0, "b").otherwise("a").alias("entry_hash")), 0, "a", 5),
        "SELECT count(*) FILTER (n_nationkey % 3 = 0 "
        "AND n_nationkey % 12 <> 0) AS agreeing, count(*) FILTER (n_nationkey % 12 = 0) AS conflicting, count(*) FILTER (n_nationkey % 3 <> 0) AS unverified, 5::BIGINT AS required, 'conflict' AS decision "
        "FROM nation",
    ),
    "j03_digest_diff": (lambda s, d: L.digest_diff(_replica(s, d, False), _replica(s, d, True)), _DIFF_SQL),
    "c03_crdt_merge": (_merged, _MERGE_SQL),
    "c03_orset_merge": (_sets, "SELECT l_orderkey::VARCHAR AS key, l_orderkey || '#' || (l_linenumber % 3) AS tag, min(l_linenumber)::BIGINT AS position FROM lineitem GROUP BY 1, 2 HAVING NOT bool_or(l_returnflag = 'R')"),
    "c02_update_ops": (_update, "SELECT c_custkey % 5 = 0 AS tombstone, count(*) AS n FROM customer WHERE c_custkey % 5 = 0 OR (c_custkey % 4 = 0 AND c_nationkey <> 9) GROUP BY 1"),
    "c04_materialize_json": (lambda s, d: C.materialize_json(_flat(s, d)).select("key", "doc"), "SELECT c_custkey::VARCHAR AS key, '{\"nation\":' || c_nationkey || '}' AS doc FROM customer"),
    "a17_last_write": (lambda s, d: C.last_write(T.customer_ops(s, d)).select("key", F.col("hlc.physical_ms").alias("ms")), f"WITH {OPS_SQL} SELECT key, max(ms)::BIGINT AS ms FROM ops GROUP BY 1"),
    "f08_ring_position": (lambda s, d: _keys(s, d).select("key", ring_position(P.placement_input(F.col("collection"), F.col("key"), F.col("shard"))).alias("position")), f"WITH {_RING_SQL} SELECT key, position FROM keys"),
    "f07_chunk_hash": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", chunk_hash(F.sha2(F.col("n_name").cast("binary"), 256), F.col("n_nationkey")).alias("hash")),
        "SELECT n_nationkey, sha256(unhex(sha256(n_name)) || '\\x00'::BLOB || unhex(lpad(hex(n_nationkey), 8, '0'))) AS hash FROM nation",
    ),
    "r01_ring_replicas": (lambda s, d: _placed(s, d).select("key", F.array_join("replicas", ",").alias("replicas")), f"WITH {_RING_SQL} SELECT key, array_to_string(replicas, ',') AS replicas FROM placed"),
    "r03_placement_plan": (
        _plan,
        f"WITH {_RING_SQL} "
        f"SELECT key, replicas[1] AS primary, coalesce(array_to_string(list_sort(list_filter(replicas, lambda x: x NOT IN ('n0', 'n1'))), ','), '') AS missing, true AS under_replicated, coalesce(array_to_string(list_sort(list_filter(['n0', 'n1'], lambda x: NOT list_contains(replicas, x))), ','), '') AS displaced "
        f"FROM placed",
    ),
    "a16_keys_by_primary": (lambda s, d: P.by_primary(_placed(s, d)), f"WITH {_RING_SQL} SELECT replicas[1] AS primary, count(*) AS keys FROM placed GROUP BY 1"),
    "r02_placement_candidates": (
        lambda s, d: P.candidates(T.peers(s, d), 1_000_000, 60_000),
        f"WITH {PEERS_SQL} SELECT node, CASE WHEN role <> 'member' THEN role WHEN state <> 'active' THEN state WHEN 1000000 - seen_ms > 60000 THEN 'stale' END AS excluded "
        f"FROM peers",
    ),
    "p13_peer_suspicion": (
        lambda s, d: T.peers(s, d).select("node", P.suspicion(F.lit(1_000_000) - F.col("seen_ms"), 20_000, F.col("failures")).alias("state")),
        f"WITH {PEERS_SQL}, x AS (SELECT node, CASE WHEN 1000000 - seen_ms > 60000 THEN 2 WHEN 1000000 - seen_ms > 20000 THEN 1 ELSE 0 END + (failures >= 3)::INT AS st FROM peers) "
        f"SELECT node, CASE WHEN st >= 2 THEN 'dead' WHEN st = 1 THEN 'suspect' ELSE 'alive' END AS state FROM x",
    ),
    "a13_peer_fitness": (
        _fitness,
        f"WITH {PEERS_SQL}, f AS (SELECT node, 0.45::DOUBLE * reliability + 0.25::DOUBLE / (1 + latency / 50) + 0.2::DOUBLE * 0.5::DOUBLE + 0.1::DOUBLE * 1 AS score FROM peers) "
        f"SELECT node, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, node) AS rank FROM f",
    ),
    "a12_probe_ewma": (_ewma, _EWMA_SQL),
    "t06_transit_holders": (_holders, _HOLDERS_SQL),
    "n09_supervisor_sweep": (
        lambda s, d: P.sweep(T.peers(s, d), 1_000_000, 60_000, 0.9),
        f"WITH {PEERS_SQL} SELECT node, CASE WHEN 1000000 - seen_ms > 60000 THEN 'degrade' ELSE 'quota' END AS action FROM peers WHERE 1000000 - seen_ms > 60000 OR used >= 54000",
    ),
    "n08_invalid_transitions": (
        lambda s, d: P.invalid_transitions(T.peers(s, d).select("node", F.col("state").alias("from_state"), F.lit("active").alias("to_state"))).select("node"),
        f"WITH {PEERS_SQL} SELECT node FROM peers WHERE state <> 'degraded'",
    ),
    "n01_convergence": (
        lambda s, d: P.convergence(T.orders_docs(s, d).select((F.col("cust") % 3).cast("string").alias("node"), "collection", F.when(F.col("collection") == "5-LOW", F.col("status")).otherwise("same").alias("checksum"))),
        f"WITH {ORDERS_SQL} SELECT collection, count(DISTINCT cust % 3) AS nodes, count(DISTINCT CASE WHEN collection = '5-LOW' THEN status "
        f"ELSE 'same' END) AS versions, count(DISTINCT CASE WHEN collection = '5-LOW' THEN status ELSE 'same' END) = 1 AS converged FROM docs GROUP BY 1",
    ),
    "a08_transit_by_owner": (lambda s, d: L.held_by_owner(_envelopes(s, d)), f"WITH {_ENV_SQL} SELECT owner, count(*) AS held, sum(bytes)::BIGINT AS bytes, min(nullif(expires_ms, 0)) AS next_expiry FROM env GROUP BY 1"),
    "m11_transit_expiry": (lambda s, d: L.expire(_envelopes(s, d), 50_000).select("key_hash"), f"WITH {_ENV_SQL} SELECT key_hash FROM env WHERE expires_ms = 0 OR expires_ms > 50000"),
    "m13_outbox_undelivered": (
        lambda s, d: L.undelivered(_envelopes(s, d).withColumnRenamed("key_hash", "message_id"), table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("message_id"))).select("message_id"),
        f"WITH {_ENV_SQL} SELECT key_hash AS message_id FROM env WHERE key_hash NOT IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R')",
    ),
    "m14_durability": (lambda s, d: L.durable(_receipts(s, d), 4), "SELECT l_orderkey AS message_id, count(DISTINCT l_suppkey) AS appliers, count(DISTINCT l_suppkey) + 1 >= 4 AS met FROM lineitem GROUP BY 1"),
    "r08_hold_chunks": (
        lambda s, d: L.hold_chunks(_mail(s, d), 100_000, 2_000_000),
        "WITH "
        "e AS (SELECT 'c' || o_custkey AS owner, o_orderkey::VARCHAR AS key_hash, trunc(o_totalprice)::BIGINT AS bytes, greatest(ceil(trunc(o_totalprice) / 100000.0)::INT, 1) AS chunk_total "
        "FROM orders), o AS (SELECT owner FROM e GROUP BY 1 HAVING sum(bytes) <= 2000000), x AS (SELECT *, unnest(range(chunk_total))::INT AS chunk_index FROM e "
        "WHERE owner IN (SELECT owner FROM o)) SELECT owner, key_hash, chunk_index, chunk_total, least(100000, bytes - chunk_index * 100000)::BIGINT AS bytes FROM x",
    ),
    "k06_quota_admission": (
        _admit,
        "WITH "
        "w AS (SELECT 'n' || (o_custkey % 10) AS node, trunc(o_totalprice)::BIGINT AS growth, o_orderkey % 2 = 0 AS merge, sum(trunc(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey % 10 "
        "ORDER BY o_orderkey) AS total FROM orders) SELECT node, count(*) FILTER (growth <= 0 OR total <= CASE WHEN merge THEN 10500000 ELSE 10000000 END) AS admitted FROM w "
        "GROUP BY 1",
    ),
}
