"""Queries over documents, files and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import documents as D
from ..operators import files as X
from ..operators import ledger as L
from ..sources import ingest
from ..sources.engines import Router
from . import tables as T
from .tables import FILES_SQL, ORDERS_SQL, table

_C = "1-URGENT"
_KEYS = ("collection", "key")


def _versions(s, d):
    """Three versions of each customer's document in two engines."""
    c = table(s, d, "lineitem")
    return c.select(F.lit("c").alias("collection"), F.col("l_orderkey").cast("string").alias("key"), F.concat(F.lit("e"), (F.col("l_linenumber") % 2).cast("string")).alias("engine"), F.col("l_linenumber").cast("long").alias("updated_ms"), F.col("l_quantity").alias("value"))


def _newest(s, d):
    v = _versions(s, d).groupBy("collection", "key", "updated_ms").agg(F.max("engine").alias("engine"), F.max("value").alias("value"))
    return D.latest(v, ["collection", "key"], "updated_ms").select("key", "engine", "updated_ms", "value")


_NEWEST_SQL = """SELECT key, engine, updated_ms, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_ms DESC) AS rn FROM (
    SELECT l_orderkey::VARCHAR AS key, l_linenumber::BIGINT AS updated_ms, max('e' || (l_linenumber % 2)) AS engine, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2)) WHERE rn = 1"""


def _acl(s, d):
    n = table(s, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("c"), k.cast("string")).alias("collection"),
        F.when(k % 3 > 0, F.concat(F.lit("c"), (k / 2).cast("int").cast("string"))).when(k == 24, F.lit("c24")).alias("parent"),
        (k % 2 == 0).alias("private"),
        F.concat(F.lit("u"), (k % 4).cast("string")).alias("owner"),
        F.array(F.concat(F.lit("u"), (k % 3).cast("string"))).alias("readers"),
    )


_ACL_SQL = """acl AS (SELECT 'c' || n_nationkey AS collection, CASE WHEN n_nationkey % 3 > 0 THEN 'c' || (n_nationkey // 2) WHEN n_nationkey = 24 THEN 'c24' END AS parent,
    n_nationkey % 2 = 0 AS private, 'u' || (n_nationkey % 4) AS owner, ['u' || (n_nationkey % 3)] AS readers FROM nation)"""


def _base64_parts(s, d):
    p = table(s, d, "pages")
    docs = p.select(F.lpad(F.col("page_id").cast("string"), 8, "0").alias("key"), F.regexp_replace(F.base64(F.col("html").cast("binary")), "[\r\n]", "").alias("text"), F.col("html"))
    parts = X.split_parts(docs)
    manifests = docs.select("key", F.ceil(F.char_length("text") / X.CHUNK_CHARS).cast("int").alias("part_total"), F.octet_length("html").cast("long").alias("size_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    return X.reassemble(manifests, parts)


def _tokens(s, d):
    return table(s, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_TOKENS = r"""toks AS (SELECT doc_id, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\s,.;:!?()\[\]{}"''\-_/]+')) AS t FROM documents) WHERE regexp_replace(lower(t), '[^a-z0-9]', '', 'g') <> '')"""


def _text_files(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("The item-"), F.col("doc_id").cast("string")).alias("filename"), F.col("text").alias("content"))


def _bm25(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    return X.bm25(docs, "the that with").select("key", F.round("score", 5).alias("score"))


_BM25_SQL = f"""WITH {_TOKENS}, sz AS (SELECT b.doc_id, count(t.term) AS size FROM documents b LEFT JOIN toks t USING (doc_id) GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(size) AS mean FROM sz), tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term IN ('the', 'that', 'with') GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN df USING (term) JOIN sz USING (doc_id), st GROUP BY 1)
    SELECT doc_id AS key, round(score, 5) AS score FROM sc ORDER BY score DESC, doc_id LIMIT 100"""


def _violations(s, d):
    docs = T.event_docs(s, d).withColumn("doc", F.when(F.substring_index("key", ":", -1).cast("int") % 10 == 0, '{"value": "x"}').otherwise(F.col("doc")))
    return D.schema_violations(docs, "doc", {"value": "number", "ts": "integer"}, ("value", "ts")).groupBy("field", "problem").agg(F.count(F.lit(1)).alias("n"))


_VIOLATIONS_SQL = """WITH e AS (SELECT event_id % 10 = 0 AS bad, event_id % 2 = 0 AND event_id % 10 <> 0 AS has_ts FROM events)
    SELECT 'value' AS field, 'expected number, found string' AS problem, count(*) AS n FROM e WHERE bad HAVING count(*) > 0
    UNION ALL SELECT 'ts', 'required', count(*) FROM e WHERE NOT has_ts HAVING count(*) > 0"""


def _chunked(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")
    return ingest.chunk_records(docs, "text").select("key", "parent_key", F.col("part_index").cast("long").alias("part_index"), F.col("part_total").cast("long").alias("part_total"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


_CHUNK_SQL = """WITH n AS (SELECT doc_id::VARCHAR AS k, text, CASE WHEN length(text) > 3500 THEN ceil(length(text) / 3500.0)::BIGINT ELSE 1 END AS part_total FROM documents),
    p AS (SELECT *, unnest(range(part_total)) AS i FROM n)
    SELECT CASE WHEN part_total > 1 THEN k || '#' || i ELSE k END AS key, CASE WHEN part_total > 1 THEN k END AS parent_key, CASE WHEN part_total > 1 THEN i END AS part_index, part_total,
        sha256(substr(text, (i * 3500 + 1)::BIGINT, 3500)) AS sha FROM p"""


def _mesh(s, d):
    o = D.live(T.orders_docs(s, d)).where(F.contains("key", F.lit("12")))
    hits = o.select("collection", "key", F.concat(F.lit("n"), (F.col("cust") % 3).cast("string")).alias("node")).unionByName(o.select("collection", "key", F.lit("n0").alias("node")))
    return D.mesh_lookup(hits, "00000012").select("collection", "key", F.array_join("nodes", ",").alias("nodes"), "exact")


def _client_filters(s, d):
    f = T.files(s, d).withColumn("category", scalars.file_category(F.col("mime"), F.col("filename"))).withColumn("size_class", scalars.size_class(F.col("size_bytes")))
    age = F.floor((F.lit(1_700_900_000_000) - F.col("created_ms")) / 86_400_000)
    f = f.withColumn("age", F.when(age < 1, "day").when(age < 7, "week").when(age < 30, "month").otherwise("older"))
    return f.groupBy("category", "size_class", "age").agg(F.count(F.lit(1)).alias("n"))


def _page(s, d):
    return X.page(T.files(s, d), "-size_bytes", 5, 20).select("key", "size_bytes", "total", "has_more")


def _json_equal(s, d):
    """Pairs that differ in the spelling of numbers, in the order of fields, inside a string, or in a value."""
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 6).alias("kind"), F.col("event_id").cast("string").alias("n"))
    left = F.concat(F.lit('{"a": '), "n", F.lit(', "s": "v 1.0 ", "x": [100, 2.50]}'))
    right = (
        F.when(F.col("kind") == 0, F.concat(F.lit('{"a": '), "n", F.lit('.0, "s": "v 1.0 ", "x": [1e2, 2.5]}')))
        .when(F.col("kind") == 1, F.concat(F.lit('{"a": '), "n", F.lit(', "s": "v 1 ", "x": [100, 2.50]}')))
        .when(F.col("kind") == 2, F.concat(F.lit('{"x": [1.0E+2, 25e-1], "s": "v 1.0 ", "a": '), "n", F.lit("}")))
        .when(F.col("kind") == 3, F.concat(F.lit('{"a": "'), "n", F.lit('", "s": "v 1.0 ", "x": [100, 2.50]}')))
        .when(F.col("kind") == 4, F.concat(F.lit('{"a": '), "n", F.lit(', "s": "v 1.0 ", "x": [2.50, 100]}')))
        .otherwise(F.concat(F.lit('{"a": '), "n", F.lit('.5, "s": "v 1.0 ", "x": [100, 2.50]}')))
    )
    return e.select("event_id", D.json_equal(left, right).alias("same"))


Q = {
    "s01_doc_get": (
        lambda s, d: D.point_get(T.orders_docs(s, d), "4-NOT SPECIFIED", "00000001").select("key", "doc", "updated_ms"),
        f"WITH {ORDERS_SQL} SELECT key, doc, updated_ms FROM docs WHERE collection = '4-NOT SPECIFIED' AND key = '00000001' AND NOT deleted",
    ),
    "s02_doc_scan_range": (
        lambda s, d: D.scan(T.orders_docs(s, d), _C, "00000100", 50).select("key", "status"),
        f"WITH {ORDERS_SQL} SELECT key, status FROM docs WHERE collection = '{_C}' AND key >= '00000100' AND NOT deleted ORDER BY key LIMIT 50",
    ),
    "s03_doc_page_keyset": (
        lambda s, d: D.next_page(T.orders_docs(s, d), _C, "00000400", 25).select("key", "price"),
        f"WITH {ORDERS_SQL} SELECT key, price FROM docs WHERE collection = '{_C}' AND key > '00000400' AND NOT deleted ORDER BY key LIMIT 25",
    ),
    "s06_latest_per_key": (_newest, _NEWEST_SQL),
    "s18_collections_list": (lambda s, d: D.collections(T.orders_docs(s, d)), "SELECT DISTINCT o_orderpriority AS collection FROM orders"),
    "s20_engine_catalogue": (lambda s, d: Router(s).catalogue(), None),
    "s23_chunk_split": (_chunked, _CHUNK_SQL),
    "s26_key_index": (lambda s, d: _newest(s, d).groupBy("engine").agg(F.count(F.lit(1)).alias("keys")), f"SELECT engine, count(*) AS keys FROM ({_NEWEST_SQL}) GROUP BY 1"),
    "s28_file_reassemble": (_base64_parts, "SELECT lpad(page_id::VARCHAR, 8, '0') AS key, strlen(html)::BIGINT AS size, sha256(html) AS sha256, '' AS problem FROM pages"),
    "p02_lookup_eq_text": (lambda s, d: D.equal_lookup(T.orders_docs(s, d), F.col("status"), F.lit("F"), 200).select(*_KEYS), f"WITH {ORDERS_SQL} SELECT collection, key FROM docs WHERE status = 'F' AND NOT deleted ORDER BY 1, 2 LIMIT 200"),
    "p02_lookup_eq_number": (
        lambda s, d: D.equal_lookup(T.orders_docs(s, d), F.col("cust").cast("double"), F.lit(30.0), 1000).select(*_KEYS),
        f"WITH {ORDERS_SQL} SELECT collection, key FROM docs WHERE cust = 30.0 AND NOT deleted ORDER BY 1, 2 LIMIT 1000",
    ),
    "p03_json_path_eq": (lambda s, d: table(s, d, "events").where(F.get_json_object("props", "$.k").cast("int") == 42).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE (props::JSON ->> '$.k')::INT = 42"),
    "p05_files_filter": (
        lambda s, d: X.matching(T.files(s, d), "text/", 1000, 100_000, 1_700_500_000_000, 1_700_010_000_000).select("key", "filename"),
        f"WITH {FILES_SQL} SELECT key, filename FROM files WHERE starts_with(mime, 'text/') AND size_bytes BETWEEN 1000 AND 100000 AND created_ms < 1700500000000 "
        f"AND created_ms > 1700010000000",
    ),
    "p06_files_classes": (_client_filters, f"""WITH {FILES_SQL} SELECT CASE mime WHEN 'image/png' THEN 'image' WHEN 'text/html' THEN 'code' ELSE 'other' END AS category,
        CASE WHEN size_bytes < 1048576 THEN 'small' WHEN size_bytes <= 10485760 THEN 'medium' ELSE 'large' END AS size_class,
        CASE WHEN floor((1700900000000 - created_ms) / 86400000) < 1 THEN 'day' WHEN floor((1700900000000 - created_ms) / 86400000) < 7 THEN 'week' WHEN floor((1700900000000 - created_ms) / 86400000) < 30 THEN 'month' ELSE 'older' END AS age, count(*) AS n FROM files GROUP BY 1, 2, 3"""),
    "p07_ledger_filter": (lambda s, d: L.entries_of(T.ledger(s, d), "PUT", "c1", "n2").select("lsn", "key"), f"WITH {T.LEDGER_SQL} SELECT lsn, key FROM ledger WHERE type = 'PUT' AND collection = 'c1' AND node = 'n2'"),
    "p08_collection_search": (
        lambda s, d: D.collections(T.orders_docs(s, d)).withColumn("tier", D.tier(F.col("collection"), "2-")).where("tier is not null").select("collection", F.col("tier").cast("long").alias("tier")),
        "SELECT DISTINCT o_orderpriority AS collection, (CASE WHEN lower(o_orderpriority) = '2-' THEN 0 WHEN starts_with(lower(o_orderpriority), '2-') THEN 1 "
        "ELSE 2 END)::BIGINT AS tier FROM orders WHERE contains(lower(o_orderpriority), '2-')",
    ),
    "p09_schema_violations": (_violations, _VIOLATIONS_SQL),
    "p10_acl_readable": (lambda s, d: D.readable(_acl(s, d).select("collection"), _acl(s, d), "u1"), f"WITH {_ACL_SQL} SELECT collection FROM acl WHERE NOT private OR owner = 'u1' OR list_contains(readers, 'u1')"),
    "p11_live_documents": (lambda s, d: D.live(T.orders_docs(s, d)).groupBy("collection").agg(F.count(F.lit(1)).alias("n")), f"WITH {ORDERS_SQL} SELECT collection, count(*) AS n FROM docs WHERE NOT deleted GROUP BY 1"),
    "p12_json_equality": (_json_equal, "SELECT event_id, event_id % 6 IN (0, 2) AS same FROM events"),
    "x01_lookup_ranked": (lambda s, d: D.ranked_lookup(T.orders_docs(s, d), "000012", 300), f"""WITH {ORDERS_SQL} SELECT (CASE WHEN key = '000012' THEN 0 WHEN starts_with(key, '000012') THEN 1 ELSE 2 END)::INT AS tier, collection, key, updated_ms, substr(doc, 1, 200) AS preview
        FROM docs WHERE contains(key, '000012') AND NOT deleted ORDER BY 1, 4 DESC, 2, 3 LIMIT 300"""),
    "x02_mesh_lookup": (_mesh, f"""WITH {ORDERS_SQL}, hits AS (SELECT collection, key, 'n' || (cust % 3) AS node FROM docs WHERE contains(key, '12') AND NOT deleted UNION SELECT collection, key, 'n0' FROM docs WHERE contains(key, '12') AND NOT deleted)
        SELECT collection, key, string_agg(node, ',' ORDER BY node) AS nodes, key = '00000012' AS exact FROM hits GROUP BY 1, 2"""),
    "x03_files_search": (
        lambda s, d: X.search(T.files(s, d), "PHOTO1", 0, 50).select("key", F.col("score").cast("long").alias("score")),
        f"WITH {FILES_SQL}, sc AS (SELECT *, CASE WHEN contains(lower(filename), 'photo1') THEN 10 ELSE 0 END + CASE WHEN contains(lower(excerpt), 'photo1') THEN 1 "
        f"ELSE 0 END AS score FROM files) SELECT key, score::BIGINT AS score FROM sc WHERE score > 0 ORDER BY score DESC, created_ms DESC, key LIMIT 50",
    ),
    "x04_fts_or_search": (lambda s, d: X.or_search(X.postings(_text_files(s, d)), "The that the"), f"""WITH {_TOKENS}, w AS (SELECT doc_id, term, count(*) AS w FROM toks GROUP BY 1, 2 UNION ALL SELECT doc_id, 'the', 10 FROM documents)
        SELECT doc_id AS key, sum(w * CASE term WHEN 'the' THEN 2 ELSE 1 END)::BIGINT AS score FROM w WHERE term IN ('the', 'that') GROUP BY 1"""),
    "x06_fts_tokens": (_tokens, f"WITH {_TOKENS} SELECT term, count(*) AS n FROM toks GROUP BY 1"),
    "x07_fts_bm25": (_bm25, _BM25_SQL),
    "t02_files_page": (_page, f"WITH {FILES_SQL} SELECT key, size_bytes, (SELECT count(*) FROM files) AS total, (SELECT count(*) FROM files) > 25 AS has_more FROM files ORDER BY size_bytes DESC, collection, key LIMIT 20 OFFSET 5"),
    "t03_files_recent": (lambda s, d: X.recent(T.files(s, d)).select("key", "created_ms"), f"WITH {FILES_SQL} SELECT key, created_ms FROM files ORDER BY created_ms DESC, collection, key LIMIT 20"),
    "a04_collection_checksum": (
        lambda s, d: D.fingerprint(T.orders_docs(s, d)),
        f"WITH {ORDERS_SQL} SELECT collection, count(*) AS docs, sha256(string_agg(key || '=' || clock, chr(10) ORDER BY key || '=' || clock) || chr(10)) AS checksum FROM docs "
        f"WHERE NOT deleted GROUP BY 1",
    ),
    "a07_quota_by_engine": (
        lambda s, d: D.quota(_versions(s, d).withColumn("bytes", F.col("value").cast("long")), 1_000_000),
        "SELECT 'e' || (l_linenumber % 2) AS engine, sum(l_quantity::BIGINT)::BIGINT AS bytes, round(sum(l_quantity::BIGINT) / 1000000.0::DOUBLE, 6) AS ratio FROM lineitem "
        "GROUP BY 1",
    ),
    "f16_hlc_text": (lambda s, d: T.orders_docs(s, d).select("key", scalars.hlc_text(scalars.parse_hlc(F.col("clock"))).alias("clock")), f"WITH {ORDERS_SQL} SELECT key, clock FROM docs"),
    "f07_key_hash": (
        lambda s, d: T.orders_docs(s, d).select("key", scalars.key_hash(F.col("collection"), F.col("key")).alias("hash")),
        f"WITH {ORDERS_SQL} SELECT key, sha256(encode(collection) || '\\x00'::BLOB || encode(key)) AS hash FROM docs",
    ),
    "r04_acl_effective": (lambda s, d: D.effective_acl(_acl(s, d)).select("collection", "source", "private", "owner"), f"""WITH RECURSIVE {_ACL_SQL}, up(collection, source, parent, depth) AS (SELECT collection, collection, parent, 0 FROM acl
        UNION ALL SELECT u.collection, a.collection, a.parent, depth + 1 FROM up u JOIN acl a ON a.collection = u.parent WHERE depth < 16),
        fin AS (SELECT collection, max_by(source, depth) AS source, max_by(coalesce(parent, ''), depth) AS parent FROM up GROUP BY 1)
        SELECT f.collection, CASE WHEN f.parent = '' THEN f.source END AS source, CASE WHEN f.parent = '' THEN a.private ELSE true END AS private, CASE WHEN f.parent = '' THEN a.owner END AS owner FROM fin f JOIN acl a ON a.collection = f.source"""),
}
