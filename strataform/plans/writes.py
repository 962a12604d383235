"""Queries over JSON writes, their path tables, updates and deletes, and over ledgers and postings as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import crdt as C
from ..operators import documents as D
from ..operators import files as X
from ..operators import ledger as L
from . import tables as T
from .consistency import _CHAIN_SQL, _chain
from .documents import _TOKENS, _text_files
from .tables import LEDGER_SQL, ORDERS_SQL, table

_KEY = b"strataform"
_PADS = [bytes(x ^ byte for x in _KEY.ljust(64, b"\0")).hex() for byte in (0x36, 0x5C)]


def _clock(ms: int):
    return F.struct(F.lit(ms).cast("long").alias("physical_ms"), F.lit(0).cast("long").alias("logical"), F.lit("a").alias("node_id"))


def _json(s, d, changed: bool = False):
    """Events as nested JSON; changed: views are emptied, errors get another number."""
    e = table(s, d, "events")
    number = F.when(F.lit(changed) & (F.col("event_type") == "error"), -F.col("event_id")).otherwise(F.col("event_id"))
    body = F.concat(F.lit('{"id": '), number.cast("string"), F.lit(', "props": '), "props", F.lit(', "tags": ["a", 1]}'))
    return e.select(F.lit("events").alias("collection"), F.col("event_id").cast("string").alias("key"), F.when(F.lit(changed) & (F.col("event_type") == "view"), "{}").otherwise(body).alias("doc"))


def _paths(s, d):
    return C.from_json(_json(s, d), _clock(1))


def _writes(s, d):
    """All writes of the first documents and of their update."""
    first = _paths(s, d)
    return first.unionByName(C.update_ops(first, C.from_json(_json(s, d, True), _clock(2)), _clock(2)))


_TREE_SQL = """tree AS (SELECT event_id::VARCHAR AS key, t.* FROM events, json_tree('{"id": ' || event_id || ', "props": ' || props || ', "tags": ["a", 1]}') t)"""

Q = {
    "c01_path_table": (lambda s, d: _paths(s, d).select("key", F.array_join("path", ".").alias("path"), "kind", "value"), f"""WITH {_TREE_SQL} SELECT key, substr(fullkey, 3) AS path,
        CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' ELSE 'int' END AS kind,
        CASE type WHEN 'ARRAY' THEN '["a",1]' WHEN 'OBJECT' THEN NULL ELSE atom::VARCHAR END AS value FROM tree WHERE fullkey <> '$' AND NOT contains(fullkey, '[')"""),
    "c01_array_elements": (
        lambda s, d: C.elements(_paths(s, d)).select("key", "tag", "value", F.col("position").cast("long").alias("position")),
        "SELECT event_id::VARCHAR AS key, '1.0@a#' || p AS tag, CASE p WHEN 0 THEN '\"a\"' ELSE '1' END AS value, p::BIGINT AS position FROM events, range(2) t(p)",
    ),
    "s24_upserted_documents": (
        lambda s, d: C.materialize_json(C.merge(_writes(s, d))).select("key", "doc"),
        """SELECT event_id::VARCHAR AS key, '{"id":' || CASE WHEN event_type = 'error' THEN -event_id ELSE event_id END || ',"props":' || json(props) || ',"tags":["a",1]}' AS doc FROM events WHERE event_type <> 'view'""",
    ),
    "s25_deleted_documents": (lambda s, d: C.deleted(C.merge(_writes(s, d)), _writes(s, d)).select("key"), "SELECT event_id::VARCHAR AS key FROM events WHERE event_type = 'view'"),
    "s07_key_scan": (lambda s, d: D.key_scan(T.orders_docs(s, d)), f"WITH {ORDERS_SQL} SELECT collection, key FROM docs WHERE NOT deleted"),
    "s17_ledger_read": (lambda s, d: T.ledger(s, d).select("lsn", "type", "key_hash", "node"), f"WITH {LEDGER_SQL} SELECT lsn, type, key_hash, node FROM ledger"),
    "x05_postings": (
        lambda s, d: X.postings(_text_files(s, d)),
        f"WITH {_TOKENS}, w AS (SELECT doc_id, term, count(*) AS w FROM toks GROUP BY 1, 2 UNION ALL SELECT doc_id, unnest(['the', 'item', doc_id::VARCHAR]), 10 FROM documents) "
        f"SELECT doc_id AS key, term, sum(w)::BIGINT AS weight FROM w GROUP BY 1, 2",
    ),
    "f06_hmac": (
        lambda s, d: table(s, d, "customer").select("c_custkey", scalars.hmac_sha256(F.lit(_KEY), F.col("c_name").cast("binary")).alias("mac")),
        f"SELECT c_custkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || c_name::BLOB))) AS mac FROM customer",
    ),
    "n03_furthest_tip": (lambda s, d: L.tips(_chain(s, d)).orderBy(F.desc("lsn"), "node").limit(1), f"{_CHAIN_SQL} SELECT node, lsn, entry_hash FROM chain ORDER BY lsn DESC, node LIMIT 1"),
    "l07_intents_for_holder": (
        lambda s, d: L.unclaimed(T.ledger(s, d).where("type = 'CLAIM' or node = 'n1'"), 1 << 62),
        f"WITH {LEDGER_SQL} SELECT DISTINCT key_hash FROM ledger WHERE type = 'INTENT' AND node = 'n1' AND key_hash NOT IN (SELECT key_hash FROM ledger WHERE type = 'CLAIM')",
    ),
}
