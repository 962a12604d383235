"""Queries over time series, vectors and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import timeseries as S
from ..operators import vectors as V
from . import tables as T
from .tables import GEO_SQL, POINTS_SQL, table

_HOUR = S.HOUR_MS
_NOW = 1_706_659_200_000  # 2024-01-31


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("total",)})


def _rollup_sql(step: int) -> str:
    return f"SELECT series, ts_ms - (ts_ms % {step} + {step}) % {step} AS bucket, count(*) AS n, min(value) AS lo, max(value) AS hi, round(sum(value), 4) AS total, arg_min(value, (ts_ms, key)) AS first, arg_max(value, (ts_ms, key)) AS last FROM points GROUP BY 1, 2"


def _query_vector(s, d):
    row = table(s, d, "embeddings").where("vec_id = 7").select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0] * 64


def _queries(e):
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _ann(s, d):
    e = table(s, d, "embeddings")
    return V.ann_batch(e, _queries(e), 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


def _ann_recall(s, d):
    e = table(s, d, "embeddings")
    got = V.recall(V.ann_batch(e, _queries(e), 10), V.knn_batch(e, _queries(e), 10))
    return got.select("wanted", (F.col("recall") >= 0.9).alias("enough"))


def _knn_batch(s, d):
    e = table(s, d, "embeddings")
    return V.knn_batch(e, _queries(e), 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


_DOT = "(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _edges(s, d):
    return G.derive_edges(T.geo_docs(s, d))


_TREE = "reach(node, depth) AS (SELECT dst, 1 FROM edges WHERE src = 'r1' UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.node WHERE r.depth < {depth})"


def _reach_sql(depth: int) -> str:
    return f"WITH RECURSIVE {GEO_SQL}, {_TREE.format(depth=depth)} SELECT node, min(depth)::INT AS depth FROM reach WHERE node <> 'r1' GROUP BY 1"


def _object_view(s, d):
    docs = T.geo_docs(s, d)
    return G.object_view(docs, G.derive_edges(docs), "nation", ["name", "balance"])


def _retained(s, d):
    return S.retained(T.event_points(s, d), _NOW, 15).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


Q = {
    "ts_rollup_hourly": (lambda s, d: _rounded(S.rollup(T.event_points(s, d), _HOUR)).select("series", "bucket", "n", "lo", "hi", "total"), f"WITH {POINTS_SQL} SELECT series, bucket, n, lo, hi, total FROM ({_rollup_sql(_HOUR)})"),
    "a01_rollup_minute": (lambda s, d: _rounded(S.rollup(T.event_points(s, d))), f"WITH {POINTS_SQL} {_rollup_sql(60_000)}"),
    "a02_rollup_coarse": (lambda s, d: _rounded(S.coarsen(S.rollup(T.event_points(s, d)), 600_001)), f"WITH {POINTS_SQL} {_rollup_sql(660_000)}"),
    "a02_rollup_range": (
        lambda s, d: _rounded(S.coarsen(S.rollup(T.event_points(s, d)), _HOUR, 1_704_200_030_000, 1_704_500_030_000)).select("series", "bucket", "n", "total"),
        f"WITH {POINTS_SQL}, m AS (SELECT *, ts_ms - ts_ms % 60000 AS minute FROM points) "
        f"SELECT series, minute - minute % {_HOUR} AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM m WHERE minute + 60000 > 1704200030000 AND minute <= 1704500030000 "
        f"GROUP BY 1, 2",
    ),
    "a03_rollup_average": (
        lambda s, d: S.rollup(T.event_points(s, d), S.DAY_MS).select("series", "bucket", F.round(F.col("total") / F.col("n"), 9).alias("mean")),
        f"WITH {POINTS_SQL} SELECT series, ts_ms - ts_ms % 86400000 AS bucket, round(sum(value) / count(*), 9) AS mean FROM points GROUP BY 1, 2",
    ),
    "w04_first_last_by_key": (
        lambda s, d: S.rollup(T.event_points(s, d), S.DAY_MS, "key").select("series", "bucket", "first", "last"),
        f"WITH {POINTS_SQL} SELECT series, ts_ms - ts_ms % 86400000 AS bucket, arg_min(value, key) AS first, arg_max(value, key) AS last FROM points GROUP BY 1, 2",
    ),
    "p04_ts_range": (
        lambda s, d: S.in_range(T.event_points(s, d), 1_704_300_000_000, 1_704_400_000_000, "click"),
        f"WITH {POINTS_SQL} SELECT key, series, ts_ms, value FROM points WHERE series = 'click' AND ts_ms BETWEEN 1704300000000 AND 1704400000000",
    ),
    "f02_extract_points": (
        lambda s, d: S.extract_points(T.event_docs(s, d)),
        "SELECT event_type || ':' || event_id AS key, event_type AS series, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 "
        "ELSE (epoch_us(ts) // 1000) + 1 END AS ts_ms, user_id::DOUBLE AS value FROM events",
    ),
    "m04_tumbling_window": (
        lambda s, d: T.event_points(s, d).groupBy("series", F.window(F.timestamp_millis("ts_ms"), "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("series", F.unix_millis(F.col("w.start")).alias("bucket"), "n"),
        f"WITH {POINTS_SQL} SELECT series, ts_ms - ts_ms % 60000 AS bucket, count(*) AS n FROM points GROUP BY 1, 2",
    ),
    "m07_retention_chunk": (
        _retained,
        f"WITH {POINTS_SQL}, c AS (SELECT *, max(ts_ms) OVER (PARTITION BY ts_ms - ts_ms % {_HOUR}) AS newest FROM points) SELECT series, count(*) AS n FROM c "
        f"WHERE newest >= {_NOW - 15 * S.DAY_MS} GROUP BY 1",
    ),
    "m07_retention_row": (
        lambda s, d: S.retained(T.event_points(s, d), _NOW, 15, False).groupBy("series").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {POINTS_SQL} SELECT series, count(*) AS n FROM points WHERE ts_ms >= {_NOW - 15 * S.DAY_MS} GROUP BY 1",
    ),
    "m08_retention_report": (
        lambda s, d: S.retention_report(T.event_points(s, d), _NOW, 15),
        f"WITH {POINTS_SQL}, c AS (SELECT series, ts_ms - ts_ms % {_HOUR} AS chunk, max(ts_ms) AS newest FROM points GROUP BY 1, 2) "
        f"SELECT series, count(*) AS considered, count(*) FILTER (newest < {_NOW - 15 * S.DAY_MS}) AS dropped FROM c GROUP BY 1",
    ),
    "v02_knn_exact": (
        lambda s, d: V.knn(table(s, d, "embeddings"), _query_vector(s, d), 10).select("vec_id", F.round("score", 5).alias("score")),
        "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS score "
        "FROM embeddings a, embeddings b WHERE b.vec_id = 7 ORDER BY score DESC, vec_id LIMIT 10",
    ),
    "j14_knn_batch": (
        _knn_batch,
        f"SELECT query_id, vec_id, rank, round(score, 5) AS score FROM (SELECT b.vec_id AS query_id, a.vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY b.vec_id "
        f"ORDER BY {_DOT} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) WHERE rank <= 5",
    ),
    "v04_int8_norms": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(V.quantized_score(F.col("embedding"), F.col("embedding")), 6).alias("norm")),
        "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(greatest(least(x::DOUBLE, 1.0), -1.0) * 127) ** 2)) / 16129.0, 6) AS norm FROM embeddings",
    ),
    "v01_dimension_check": (
        lambda s, d: table(s, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT len(embedding)::BIGINT AS dims, count(*) AS n FROM embeddings GROUP BY 1",
    ),
    "v03_lsh_buckets": (lambda s, d: V.lsh_candidates(table(s, d, "embeddings")), None),
    "v03_ann_search": (_ann, None),
    "v03_ann_recall": (_ann_recall, "SELECT least(10, (SELECT count(*) FROM embeddings)) * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 100 = 0"),
    "g01_edges_derive": (lambda s, d: _edges(s, d).select("src", "dst", "label"), f"WITH {GEO_SQL} SELECT src, dst, label FROM edges"),
    "g04_out_edges": (lambda s, d: G.out_edges(_edges(s, d), "n3"), f"WITH {GEO_SQL} SELECT DISTINCT dst, label FROM edges WHERE src = 'n3'"),
    "g04_in_edges": (lambda s, d: G.in_edges(_edges(s, d), "s3"), f"WITH {GEO_SQL} SELECT DISTINCT src, label FROM edges WHERE dst = 's3'"),
    "g05_vertices": (
        lambda s, d: G.vertices(_edges(s, d)).select(F.substring("node", 1, 1).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {GEO_SQL} SELECT substr(node, 1, 1) AS kind, count(*) AS n FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) GROUP BY 1",
    ),
    "g06_descendants_1": (lambda s, d: G.reach(_edges(s, d), "r1", 1), _reach_sql(1)),
    "g06_descendants_all": (lambda s, d: G.reach(_edges(s, d), "r1"), _reach_sql(12)),
    "g07_ancestors": (
        lambda s, d: G.reach(_edges(s, d), "s3", 0, True),
        f"WITH RECURSIVE {GEO_SQL}, up(node, depth) AS (SELECT src, 1 FROM edges WHERE dst = 's3' UNION SELECT e.src, u.depth + 1 FROM up u JOIN edges e ON e.dst = u.node "
        f"WHERE u.depth < 12) SELECT node, min(depth)::INT AS depth FROM up WHERE node <> 's3' GROUP BY 1",
    ),
    "g08_roots": (lambda s, d: G.roots(_edges(s, d)), f"WITH {GEO_SQL} SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)"),
    "a14_graph_stats": (
        lambda s, d: G.stats(_edges(s, d)),
        f"WITH {GEO_SQL}, v AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) "
        f"FROM (SELECT DISTINCT src, dst FROM edges)) AS edges, (SELECT count(*) FROM v WHERE node NOT IN (SELECT dst FROM edges)) AS roots",
    ),
    "g09_classes": (
        lambda s, d: T.geo_docs(s, d).groupBy("class").agg(F.count(F.lit(1)).alias("n")),
        "SELECT 'region' AS class, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL "
        "SELECT 'supplier', count(*) FROM supplier",
    ),
    "g10_object_view": (
        _object_view,
        f"WITH {GEO_SQL} SELECT 'n' || n_nationkey AS key, '\"' || n_name || '\"' AS name, 'null' AS balance, 'r' || n_regionkey AS _parent, (SELECT count(DISTINCT dst) "
        f"FROM edges e WHERE e.src = 'n' || n_nationkey AND label = 'child') AS _child_count FROM nation",
    ),
    "j12_edge_symmetry": (lambda s, d: G.asymmetric(_edges(s, d), _edges(s, d).where("dst <> 's3'")), f"WITH {GEO_SQL} SELECT DISTINCT src, dst, 'in' AS missing FROM edges WHERE dst = 's3'"),
}
