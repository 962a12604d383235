"""Rules that SQL does not show: sources, guards, streams, merges in any order."""

import hashlib
import hmac
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.functions import scalars, sql
from strataform.operators import crdt, documents, files, graph, placement, runs, timeseries, vectors
from strataform.sources import engines, ingest
from strataform.streaming import feed


def test_classify():
    assert [ingest.classify(x) for x in ("[1,2.5]", '{"from":"a"}', '{"ts":1}', '[{"id":1}]', '{"a":1}', "a,b\n1,2", "plain")] == ["vector", "graph", "timeseries", "documents", "document", "table", "text"]
    assert ingest.parse_table('name\tscore\n"a ""b"""\t 88.0\nx\t') == [{"name": 'a "b"', "score": 88.0}, {"name": "x", "score": ""}]


def test_guard(spark):
    spark.range(3).withColumnRenamed("id", "updated_ms").createOrReplaceTempView("guarded")
    assert sql.query(spark, "WITH a AS (SELECT updated_ms FROM guarded) SELECT * FROM a").count() == 3
    for text in ("DROP TABLE guarded", "CREATE TABLE x AS SELECT 1", "INSERT INTO guarded VALUES (1)", "SET a=b"):
        with pytest.raises(sql.NotReadOnly):
            sql.query(spark, text)


def test_router(spark):
    r = engines.Router(spark)
    with pytest.raises(KeyError):
        r.bind("a", "nope")
    r.bind("a", "graph")
    with pytest.raises(ValueError):
        r.bind("a", "vector")
    with pytest.raises(ValueError):
        r.bind("b", "vector", has_rows=True)


def test_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = spark.range(1).select(scalars.hmac_sha256(F.lit(key), F.lit(b"data")).alias("h")).first()["h"]
        assert got == hmac.new(key, b"data", hashlib.sha256).hexdigest()


def test_align_down(spark):
    assert [r[0] for r in spark.createDataFrame([(-1,), (0,), (59,), (60,)], "v long").select(scalars.align_down(F.col("v"), 60)).collect()] == [-60, 0, 0, 60]


def test_merge_order(spark):
    """Writes of different kinds at one path give one result in every order and grouping."""
    h = lambda ms: (ms, 0, "n")
    schema = "collection string, key string, path array<string>, kind string, value string, hlc struct<physical_ms:long,logical:long,node_id:string>, tombstone boolean"
    writes = [("c", "k", ["x"], "object", None, h(2), False), ("c", "k", ["x", "f"], "int", "1", h(2), False), ("c", "k", ["x"], "int", "7", h(5), False), ("c", "k", ["x"], "object", None, h(10), False), ("c", "k", ["x", "g"], "int", "2", h(10), False)]
    results = {tuple(sorted(tuple(map(str, r)) for r in crdt.merge(spark.createDataFrame(list(p), schema)).collect())) for p in itertools.islice(itertools.permutations(writes), 0, 120, 40)}
    assert len(results) == 1


def test_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c")], "src string, dst string")
    assert {tuple(r) for r in graph.reach(edges, "a").collect()} == {("b", 1), ("c", 2)}


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, WORLD-x_y 'q' é",)], "t string")
    assert df.select(files.tokens(F.col("t"))).first()[0] == ["hello", "world", "x", "y", "q"]


def test_numbers_only(spark):
    df = spark.createDataFrame([('{"value": true}',), ('{"value": "12"}',), ('{"value": 3}',)], "doc string")
    assert [r[0] for r in df.select(timeseries.number_field(F.col("doc"), "value")).collect()] == [None, None, 3.0]


def test_stream_equals_batch(spark, tmp_path):
    points = spark.range(200).select(F.timestamp_millis(F.col("id") * 7000).alias("ts"), (F.col("id") % 3).cast("string").alias("series"), F.col("id").cast("double").alias("value"))
    points.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = feed.continuous_rollup(feed.follow(spark, str(tmp_path / "in"), points.schema, 1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = points.groupBy("series", (F.floor(F.unix_millis("ts") / 60000) * 60000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, spark.table("rolled").select("series", "bucket", "n").collect())) == sorted(map(tuple, want.collect()))


def test_moving_averages(spark):
    """The fold over partitions against one probe after the other; odd rows as the operator states."""
    rows = [("a" if i % 3 else "b", i // 2, None if i % 7 == 0 else float(i * 13 % 29), i % 5 != 0) for i in range(400)]
    rows += [("c", 1, 5.0, False), ("d", None, 2.0, True), ("d", 3, 4.0, True), (None, 1, 1.0, True), ("a", 9, 1.0, None)] + [("e", 1, 1.0, True)] * 5
    schema = "node string, at long, ms double, ok boolean"
    got = {r["node"]: (r["latency"], r["success"]) for r in placement.ewma(spark.createDataFrame(rows, schema)).collect()}
    low = lambda v: (v is not None, v or 0)
    want = {}
    for node, _, ms, ok in sorted((r for r in rows if r[0] and r[3] is not None), key=lambda r: (r[0], *map(low, r[1:]))):
        latency, success = want.get(node, (None, None))
        if ok and ms is not None:
            latency = ms if latency is None else latency + (ms - latency) * 0.25
        want[node] = (latency, float(ok) if success is None else success + (ok - success) * 0.25)
    assert got == {k: (None if a is None else pytest.approx(a), pytest.approx(b)) for k, (a, b) in want.items()}
    assert placement.ewma(spark.createDataFrame([], schema)).count() == 0


def test_path_tables(spark):
    clock = F.struct(F.lit(1).cast("long").alias("physical_ms"), F.lit(0).cast("long").alias("logical"), F.lit("n").alias("node_id"))
    docs = spark.createDataFrame([("c", "a", '{"x": {"y": {"z": 1.5}}, "t": [true, {"u": null}], "n": null, "s": "q\\"", "e": {}}'), ("c", "b", None), ("c", "c", "not json"), ("c", "d", "[1]"), ("c", "e", "{}")], "collection string, key string, doc string")
    paths = crdt.from_json(docs, clock)
    got = {(r["key"], ".".join(r["path"])): (r["kind"], r["value"]) for r in paths.collect()}
    assert got == {("a", "x"): ("object", None), ("a", "x.y"): ("object", None), ("a", "x.y.z"): ("double", "1.5"), ("a", "t"): ("array", '[true,{"u":null}]'), ("a", "n"): ("null", None), ("a", "s"): ("string", 'q"'), ("a", "e"): ("object", None)}
    assert [(r["tag"], r["value"]) for r in crdt.elements(paths).orderBy("position").collect()] == [("1.0@n#0", "true"), ("1.0@n#1", '{"u":null}')]
    with pytest.raises(Exception, match="deeper than 2"):
        crdt.from_json(docs, clock, depth=2).collect()


def test_equal_clocks(spark):
    """Different values at one clock merge alike in every order."""
    schema = "collection string, key string, path array<string>, kind string, value string, hlc struct<physical_ms:long,logical:long,node_id:string>, tombstone boolean"
    writes = [("c", "k", ["x"], "int", str(v), (1, 0, "n"), False) for v in (3, 9, 5)]
    assert {crdt.merge(spark.createDataFrame(list(p), schema)).first()["value"] for p in itertools.permutations(writes)} == {"9"}


def test_neighbour_blocks(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11) for j in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    cells = ("query_id", "rank", "vec_id")
    assert sorted(vectors.knn_batch(df, queries, 3, max_queries=17).select(*cells).collect()) == sorted(vectors.knn_batch(df, queries, 3).select(*cells).collect())


def ops(spark, rows):
    schema = "collection string, key string, path array<string>, kind string, value string, hlc struct<physical_ms:long,logical:long,node_id:string>, tombstone boolean"
    return spark.createDataFrame(rows, schema)


def test_lookups_skip_tombstones(spark):
    docs = spark.createDataFrame([("c", "k1", "x", 1, False, "x"), ("c", "k2", "x", 2, True, "x")], "collection string, key string, doc string, updated_ms long, deleted boolean, field string")
    assert [r["key"] for r in documents.equal_lookup(docs, F.col("field"), F.lit("x")).collect()] == ["k1"]
    assert [r["key"] for r in documents.ranked_lookup(docs, "K").collect()] == ["k1"]


@pytest.mark.parametrize("doc", ['{"a":1,"o":{"b":2},"q\\"x":3}', '{"a":{"b":{"c":{"d":[1,{"e":2}]},"x":"\\\\ y"}},"n":null,"t":true,"z":{}}', '{"é":{"ü\\n":-1.5}}'])
def test_documents_survive_the_merge(spark, doc):
    clock = F.struct(F.lit(1).cast("long").alias("physical_ms"), F.lit(0).cast("long").alias("logical"), F.lit("n").alias("node_id"))
    got = crdt.materialize_json(crdt.merge(crdt.from_json(spark.createDataFrame([("c", "k", doc)], "collection string, key string, doc string"), clock))).collect()
    assert json.loads(got[0]["doc"]) == json.loads(doc) and len(got) == 1


def test_paths_without_a_parent_row(spark):
    live = ops(spark, [("c", "k", ["a", "b"], "int", "1", (1, 0, "n"), False), ("c", "k", ["c"], "string", "x", (1, 0, "n"), False)])
    assert crdt.materialize_json(live).first()["doc"] == '{"a":{"b":1},"c":"x"}'
    assert crdt.materialize_json(live.limit(0)).count() == 0


def test_json_equality(spark):
    cases = [('{"s":"v 1.0 "}', '{"s":"v 1 "}', False), ("1e2", "100", True), ('{"a":1,"b":2.50}', '{"b":2.5,"a":1.0}', True), ("[1,2]", "[2,1]", False), ('"1"', "1", False), ("9007199254740993", "9007199254740992", False), ('{"a":"\\"2.0"}', '{"a":"\\"2"}', False), ("-0.0", "0", True), ("{}", "[]", False)]
    got = spark.createDataFrame(cases, "a string, b string, same boolean").select(documents.json_equal(F.col("a"), F.col("b")).alias("got"), "same").collect()
    assert all(r["got"] == r["same"] for r in got)


def test_points_by_their_first_number(spark):
    docs = spark.createDataFrame([("s:1", '{"temperature": 3.5}', 9), ("s:2", '{"b": 2, "a": "1", "id": 7}', 9), ("s:3", '{"value": "x", "time": 4}', 9), ("s:4", '{"z": 1, "v": 8}', 9)], "key string, doc string, updated_ms long")
    assert {r["key"]: r["value"] for r in timeseries.extract_points(docs).collect()} == {"s:1": 3.5, "s:2": 2.0, "s:4": 8.0}


def test_guard_refuses_code_and_paths(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    spark.range(2).createOrReplaceTempView("plain")
    bad = ["SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'getenv', 'HOME')", "SELECT id FROM plain WHERE id IN (SELECT try_reflect('java.lang.Math', 'abs', 1))", f"SELECT * FROM parquet.`{tmp_path}/p`", f"WITH a AS (SELECT * FROM parquet.`{tmp_path}/p`) SELECT * FROM a", "SELECT upper(reflect('a', 'b')) AS x FROM plain", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM plain", "SELECT (SELECT max(reflect('a', 'b')) FROM plain) AS x"]
    for text in bad:
        with pytest.raises(sql.NotReadOnly):
            sql.query(spark, text)
    assert sql.query(spark, "SELECT id, (SELECT max(id) FROM plain) AS m FROM plain WHERE EXISTS (SELECT 1 FROM plain)").count() == 2


def test_hkdf(spark):
    """The first test vector of RFC 5869."""
    key, salt, info = b"\x0b" * 22, bytes(range(13)), bytes(range(0xF0, 0xFA))
    got = spark.range(1).select(scalars.hkdf_sha256(F.lit(key), F.lit(salt), F.lit(info), 42).alias("h")).first()["h"]
    assert got == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


def test_hkdf_of_many_rows(spark):
    """A constant key is worked out once, not for each row: a row costs the two hashes of each block."""
    made = spark.range(20_000).select(scalars.hkdf_sha256(F.lit(b"key"), F.lit(b"salt"), F.col("id").cast("string").cast("binary"), 48).alias("h"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 2 and "translate(" not in plan
    assert made.distinct().count() == 20_000


@pytest.mark.parametrize("size", [33, 8160])
def test_hkdf_of_key_columns(spark, size):
    def want(key, salt, info):
        mac = lambda k, x: hmac.new(k, x, hashlib.sha256).digest()
        secret, part, out = mac(salt, key), b"", b""
        for n in range(1, 256):
            part = mac(secret, part + info + bytes([n]))
            out += part
        return out[:size].hex()

    rows = [(b"", b"", b""), (bytes(range(256)), bytes(range(64)), b"a"), (b"k", bytes(range(65)), b"\xff"), (None, b"s", b"i"), (b"k", None, b"i"), (b"k", b"s", None)] + [(bytes([b]), bytes([b]) * 64, b"i") for b in (0x00, 0x36, 0x5C, 0x80, 0xFF)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k binary, s binary, info binary").select("i", scalars.hkdf_sha256(F.col("k"), F.col("s"), F.col("info"), size).alias("h"))
    assert {r["i"]: r["h"] for r in got.collect()} == {i: None if None in r else want(*r) for i, r in enumerate(rows)}


def test_runs_over_blocks(spark):
    rows = [(None if i % 7 == 0 else i % 2, i * 3, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, at long, v long")
    got = {(r["g"], r["at"]): (r["p"] and r["p"]["v"], r["s"]) for r in runs.running_sum(runs.previous(df, "g", "at", "v", "p", 16), "g", "at", "v", "s", 16).collect()}
    last, total = {}, {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + v
        assert got[g, at] == (last.get(g), total[g])
        last[g] = v


def test_arcs(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    points = placement.ring(nodes, 5)
    listed = sorted((r["position"], r["node"]) for r in points.collect())
    got = {(r["low"], r["high"]): r["replicas"] for r in placement.arcs(points, 2).collect()}
    for i, (position, _) in enumerate(listed):
        want = list(dict.fromkeys(n for _, n in listed[i:] + listed[:i]))[:2]
        assert got[listed[i - 1][0] if i else "", position] == want
    assert got[listed[-1][0], "g"] == list(dict.fromkeys(n for _, n in listed))[:2]


def test_fingerprint(spark):
    rows = [("c", f"k{i * 7 % 50}", f"{i}.0@n", i % 9 == 0) for i in range(50)] + [("d", "x", "1.0@n", False), ("d", None, "1", False), ("e", "x", "1", True)]
    got = {r["collection"]: (r["docs"], r["checksum"]) for r in documents.fingerprint(spark.createDataFrame(rows, "collection string, key string, clock string, deleted boolean")).collect()}
    own = sorted(f"{k}={c}" for n, k, c, gone in rows if n == "c" and not gone)
    assert got == {"c": (len(own), hashlib.sha256(("\n".join(own) + "\n").encode()).hexdigest()), "d": (2, hashlib.sha256(b"x=1.0@n\n").hexdigest())}


def test_dimensions(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vectors.knn(df, [0.0, 1.0], 5).collect()] == [3, 1]
    assert vectors.with_one_dimension(df).count() == 2
    queries = spark.createDataFrame([(9, [0.0, 3.0])], "query_id long, query array<double>")
    assert [(r["vec_id"], round(r["score"], 6)) for r in vectors.knn_batch(df, queries, 5).orderBy("rank").collect()] == [(3, 1.0), (1, 0.0)]
    odd = df.unionByName(spark.createDataFrame([(4, [1.0])], df.schema))
    for run in (lambda: vectors.knn(odd, [0.0, 1.0]).collect(), lambda: vectors.knn_batch(odd, queries, 2).collect(), lambda: vectors.with_one_dimension(odd).select("embedding").collect(), lambda: vectors.ann_batch(odd, queries, 2, np.eye(2)).collect()):
        with pytest.raises(Exception, match="dimension"):
            run()


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_approximate_neighbours(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + spread * rng.normal(size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = vectors.knn_batch(df, queries, 10)
    index = vectors.index_centres(df, sample=500)
    assert vectors.recall(vectors.ann_batch(df, queries, 10, index), exact).first()["recall"] >= 0.9
    whole = vectors.ann_batch(df, queries, 10, index, probed=1.0, max_queries=7)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in whole.collect()} == {(r["query_id"], r["rank"], r["vec_id"]) for r in exact.collect()}
    assert vectors.ann_batch(df.limit(0), queries.limit(0), 10).count() == 0


def drain(stream, name, path, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_first_messages(spark, tmp_path):
    rows = [("a", 1), ("a", 2), (None, 3), (None, 4), ("", 5), ("", 6), ("b", 7)]
    df = spark.createDataFrame(rows, "message_id string, at long").withColumn("ts", F.timestamp_seconds("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(feed.first_messages(feed.follow(spark, str(tmp_path / "in"), df.schema)), "once", tmp_path / "cp")
    assert sorted(str(r["message_id"]) for r in got) == sorted(["a", "None", "None", "", "", "b"])


def test_rate_limit(spark, tmp_path):
    """A bucket of two that fills by one a second, with requests out of order in a batch and state kept over batches."""
    for k, at in enumerate(([100, 0, 50, 1200], [1300, 5000, 5100, 5200])):
        spark.createDataFrame([("c", t) for t in at], "client string, at_ms long").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        limited = feed.rate_limited(feed.follow(spark, str(tmp_path / "in"), "client string, at_ms long"), 1.0, 2.0)
        limited.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out")).where(F.col("at_ms") >= 1300 if k else F.lit(True)).collect()
        want = {0: {0: True, 50: True, 100: False, 1200: True}, 1: {1300: False, 5000: True, 5100: True, 5200: False}}[k]
        assert {r["at_ms"]: r["allowed"] for r in got} == want


def test_late_points_and_sessions(spark, tmp_path):
    schema = "series string, ts timestamp, value double"
    for at in ([0, 10, 400], [20, 900], [30, 2000]):  # 20 comes in the batch that closes its window and counts; 30 comes after it
        spark.createDataFrame([("s", t) for t in at], "series string, at long").select("series", F.timestamp_seconds("at").alias("ts"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(str(tmp_path / f"in/{at[0]:03}"))
    source = lambda: feed.follow(spark, str(tmp_path / "in/*"), schema, 1)
    kept = {r["bucket"]: r["n"] for r in drain(feed.continuous_rollup(source()), "kept", tmp_path / "a", "complete")}
    assert kept == {0: 4, 360000: 1, 900000: 1, 1980000: 1}
    closed = drain(feed.continuous_rollup(source(), late="60 seconds"), "closed", tmp_path / "b")
    assert {r["bucket"]: r["n"] for r in closed} == {0: 3, 360000: 1, 900000: 1}
    first = {r["started"]: r["n"] for r in drain(feed.sessions(source(), "30 seconds", "60 seconds"), "sessions", tmp_path / "c")}
    assert first[0] == 3 and first[400000] == 1


def test_batches_replace_their_own_rows(spark, tmp_path):
    points = spark.createDataFrame([("k1", "s", 0, 1.0), ("k2", "s", 61000, 2.0)], "key string, series string, ts_ms long, value double")
    points.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        feed.upsert_batches(feed.follow(spark, str(tmp_path / "in"), points.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r["bucket"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 1.0), (60000, 2.0)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.5), ("a", 1.5), ("c", 0.5)], "name string, score double")
    engines.compact(df, str(tmp_path / "compact"), 2, "name")
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "compact")).orderBy("name").collect()] == ["a", "b", "c"]
    for kind in ("parquet", "orc", "json"):
        getattr(df.write, kind)(str(tmp_path / kind))
        assert ingest.read(spark, str(tmp_path / kind), kind).count() == 3
    (tmp_path / "t.tsv").write_text('name\tscore\n"x ""y"""\t7\n')
    assert ingest.typed(ingest.read(spark, str(tmp_path / "t.tsv"), "tsv"), ["score"]).first()["score"] == 7.0
    assert ingest.read(spark, str(tmp_path / "t.tsv"), "text").count() == 2 and ingest.read(spark, str(tmp_path / "t.tsv"), "binary").first()["length"] > 0
    with pytest.raises(ValueError):
        ingest.read(spark, "x", "nope")
    r = engines.Router(spark)
    r.register("plug", lambda path: spark.read.parquet(path))
    r.bind("mine", "plug")
    assert r.read("mine", str(tmp_path / "parquet")).count() == 3


def test_jdbc(spark):
    """Tables of an embedded database, written and read by Spark's own connector."""
    url, driver = "jdbc:derby:memory:strataform;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(10).select("id", (F.col("id") * 2).alias("twice")).write.jdbc(url, "numbers", "overwrite", driver)
    got = ingest.read(spark, url, "jdbc", dbtable="numbers", **driver)
    assert got.where("id >= 5").agg(F.sum("twice")).first()[0] == 70


def test_traversal_of_a_wide_graph(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{2 * i + k}") for i in range(1, 200) for k in (0, 1)], "src string, dst string")
    got = {r["node"]: r["depth"] for r in graph.reach(edges, "n1").collect()}
    assert got == {f"n{i}": i.bit_length() - 1 for i in range(2, 400)}
