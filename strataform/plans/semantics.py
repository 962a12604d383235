"""Queries over rules that the plainer tables do not reach: access, nesting, fallbacks, derived state, discovery."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import crdt as C
from ..operators import documents as D
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import timeseries as S
from ..sources.engines import Router
from . import tables as T
from .tables import ORDERS_SQL, table
from .upkeep import _UNCHAINED_SQL, _unchained
from .writes import _clock, _json, _writes

_SALT, _SECRET, _SIZE = b"salt-1", b"strataform", 48
_PRK = hmac.new(_SALT, _SECRET, hashlib.sha256).digest()
_INNER, _OUTER = (bytes(x ^ byte for x in _PRK.ljust(64, b"\0")).hex() for byte in (0x36, 0x5C))


def _readable_gets(s, d):
    docs = T.orders_docs(s, d)
    acl = docs.select("collection").distinct().select("collection", F.col("collection").isin("1-URGENT", "2-HIGH").alias("private"), F.when(F.col("collection") == "2-HIGH", "u1").otherwise("u0").alias("owner"), F.array(F.lit("u9")).alias("readers"))
    gets = [D.point_get(docs, c, key, acl, "u1").select("collection", "key") for c in ("1-URGENT", "2-HIGH", "5-LOW") for key in ("00000001", "00000002", "00000003", "00000004", "00000017")]
    found = gets[0]
    for g in gets[1:]:
        found = found.unionByName(g)
    return found


def _first_numbers(s, d):
    e = table(s, d, "events")
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    body = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"zeta": '), u, F.lit(', "beta": '), n, F.lit(', "id": 1, "name": "n", "alpha": "7"}')))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"temperature": '), u, F.lit('.5, "time": 1000, "device": 3, "on": true}')))
        .otherwise(F.lit('{"label": "x", "id": 5, "flag": true, "deep": {"value": 3}}'))
    )
    docs = e.select(F.concat(F.lit("s:"), n).alias("key"), body.alias("doc"), F.lit(5000).cast("long").alias("updated_ms"))
    return S.extract_points(docs).select("key", "series", "ts_ms", "value")


def _newest_rollup(s, d):
    points = T.event_points(s, d).withColumns({"updated_ms": F.col("key").cast("long"), "key": F.concat("series", F.lit("/"), (F.col("key").cast("long") % 500).cast("string"))})
    return S.rollup(S.newest_points(points), S.DAY_MS).select("series", "bucket", "n", F.round("total", 4).alias("total"))


def _derived(s, d):
    n = F.col("key").cast("long")
    stored = _json(s, d, True).withColumn("doc", F.when((n % 97 == 0) & (F.col("doc") != "{}"), '{"id": 0}').otherwise(F.col("doc")))
    return D.derived_problems(stored, C.materialize_json(C.merge(_writes(s, d))).where(n % 89 != 0)).select("key", "problem")


def _array_update(s, d):
    e = table(s, d, "events")
    n = F.col("event_id").cast("string")
    key = [F.lit("events").alias("collection"), n.alias("key")]
    first = e.select(*key, F.concat(F.lit('{"tags": ["a", 1, "a", '), n, F.lit("]}")).alias("doc"))
    then = e.select(*key, F.when(F.col("event_id") % 2 == 1, '{"tags": [1.0, "a", "new"]}').otherwise('{"tags": []}').alias("doc"))
    old, new = (C.elements(C.from_json(x, _clock(k))) for k, x in ((1, first), (2, then)))
    return C.update_elements(old, new, _clock(2)).select("key", "tag", "value", F.col("position").cast("long").alias("position"), "tombstone")


def _class_table(s, d):
    n = table(s, d, "nation")
    k = F.col("n_nationkey")
    extra = F.when(k % 2 == 0, F.lit(', "even": true')).otherwise(F.lit(', "odd one": null'))
    docs = n.select(F.concat(F.lit("n"), k.cast("string")).alias("key"), F.lit("nation").alias("class"), F.concat(F.lit('{"rank": '), k.cast("string"), F.lit(', "name": "'), "n_name", F.lit('", "tags": [1], "deep": {"a": 1}'), extra, F.lit("}")).alias("doc"))
    return G.json_object_view(docs, G.derive_edges(T.geo_docs(s, d)), "nation").withColumnRenamed("odd one", "odd_one")


def _categories(s, d):
    e = table(s, d, "events")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % by % len(values) + 1).cast("int"))
    name = F.concat(F.lit("Some.file"), F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("."), F.upper(pick(_EXTENSIONS, 1000)))).otherwise(F.lit("")))
    mime = F.when(F.col("event_id") % 3 == 0, pick(_MIMES, 997))
    return e.select("event_id", scalars.file_category(mime, name).alias("category"))


_EXTENSIONS = [x for names in scalars.EXTENSION_CATEGORIES.values() for x in names] + ["bin", "unknown"]
_MIMES = [m if not m.endswith("/") else m + "x" for m, _ in scalars.MIME_CATEGORIES] + ["application/octet-stream"]


def _cases(pairs, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"


_BY_EXT = _cases([(x, kind) for kind, names in scalars.EXTENSION_CATEGORIES.items() for x in names], "ext")
_BY_MIME = _cases([(m if not m.endswith("/") else m + "x", kind) for m, kind in scalars.MIME_CATEGORIES], "mime")

Q = {
    "s01_doc_get_readable": (_readable_gets, f"WITH {ORDERS_SQL} SELECT collection, key FROM docs WHERE key IN ('00000001', '00000002', '00000003', '00000004', '00000017') AND collection IN ('2-HIGH', '5-LOW') AND NOT deleted"),
    "s19_engine_read": (lambda s, d: Router(s).read("orders", f"{d}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "f04_first_number": (_first_numbers, """SELECT 's:' || event_id AS key, 's' AS series, CASE WHEN event_id % 3 = 1 THEN 1000 ELSE 5000 END::BIGINT AS ts_ms,
        CASE event_id % 3 WHEN 0 THEN event_id::DOUBLE ELSE user_id + 0.5::DOUBLE END AS value FROM events WHERE event_id % 3 <> 2"""),
    "a01_rollup_newest": (_newest_rollup, """WITH p AS (SELECT event_type AS series, event_type || '/' || (event_id % 500) AS key, event_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events),
        newest AS (SELECT key, any_value(series) AS series, arg_max(ts_ms, event_id) AS ts_ms, arg_max(value, event_id) AS value FROM p GROUP BY 1)
        SELECT series, ts_ms - ts_ms % 86400000 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM newest GROUP BY 1, 2"""),
    "k05_derived_json": (_derived, "SELECT event_id::VARCHAR AS key, CASE WHEN event_id % 89 = 0 THEN 'missing' ELSE 'differs' END AS problem FROM events WHERE event_type <> 'view' AND (event_id % 89 = 0 OR event_id % 97 = 0)"),
    "c02_array_update": (_array_update, """SELECT event_id::VARCHAR AS key, v.tag, CASE WHEN v.value = 'id' THEN event_id::VARCHAR ELSE v.value END AS value, v.position::BIGINT AS position, v.tombstone
        FROM events, (VALUES (1, '1.0@a#1', '1', 0, false), (1, '1.0@a#0', '"a"', 1, false), (1, '2.0@a#2', '"new"', 2, false), (1, '1.0@a#2', '"a"', 2, true), (1, '1.0@a#3', 'id', 3, true),
            (0, '1.0@a#0', '"a"', 0, true), (0, '1.0@a#1', '1', 1, true), (0, '1.0@a#2', '"a"', 2, true), (0, '1.0@a#3', 'id', 3, true)) v(odd, tag, value, position, tombstone) WHERE v.odd = event_id % 2"""),
    "f06_hkdf": (lambda s, d: table(s, d, "customer").select("c_custkey", scalars.hkdf_sha256(F.lit(_SECRET), F.lit(_SALT), F.col("c_name").cast("binary"), _SIZE).alias("okm")), f"""WITH t1 AS (
        SELECT c_custkey, c_name, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || c_name::BLOB || '\\x01'::BLOB))) AS a FROM customer),
        t2 AS (SELECT c_custkey, a, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || unhex(a) || c_name::BLOB || '\\x02'::BLOB))) AS b FROM t1)
        SELECT c_custkey, substr(a || b, 1, {2 * _SIZE}) AS okm FROM t2"""),
    "g10_object_view_discovered": (_class_table, f"""WITH {T.GEO_SQL} SELECT 'n' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'null' END AS even, '"' || n_name || '"' AS name, 'null' AS odd_one, n_nationkey::VARCHAR AS rank,
        'r' || n_regionkey AS _parent, (SELECT count(DISTINCT dst) FROM edges e WHERE e.src = 'n' || n_nationkey AND label = 'child') AS _child_count FROM nation"""),
    "n04_categories": (_categories, f"""WITH f AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN {_EXTENSIONS}[event_id % 1000 % {len(_EXTENSIONS)} + 1] ELSE 'file' END AS ext,
        CASE WHEN event_id % 3 = 0 THEN {_MIMES}[event_id % 997 % {len(_MIMES)} + 1] END AS mime FROM events)
        SELECT event_id, coalesce({_BY_MIME}, {_BY_EXT}, 'other') AS category FROM f"""),
    "n16_replica_tips": (lambda s, d: L.replica_tips(_unchained(s, d)), f"{_UNCHAINED_SQL} SELECT node, max(lsn) AS lsn, arg_max(entry_hash, lsn) AS entry_hash FROM l GROUP BY 1 HAVING bool_and(before IS NULL OR prev_hash = before)"),
}
