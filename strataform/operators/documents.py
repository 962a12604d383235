"""Collections of documents: scans, lookups, ranked search, rules and access."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import running_sum


def live(docs: DataFrame) -> DataFrame:
    """Documents that are not tombstones; ``{}`` counts as deleted."""
    return docs.where(~F.col("deleted"))


def point_get(docs: DataFrame, collection: str, key: str, acl: DataFrame | None = None, user: str = "") -> DataFrame:
    """One live document; with access rules, one that ``user`` may not read is not found."""
    found = live(docs).where((F.col("collection") == collection) & (F.col("key") == key))
    return found if acl is None else readable(found, acl, user)


def scan(docs: DataFrame, collection: str, start: str = "", limit: int = 0) -> DataFrame:
    """Live documents from ``start`` (included) in key order; 0 is no limit."""
    found = live(docs).where((F.col("collection") == collection) & (F.col("key") >= start)).orderBy("key")
    return found.limit(limit) if limit else found


def key_scan(docs: DataFrame) -> DataFrame:
    """(collection, key) of live documents; the scan reads no other column than these and the tombstone."""
    return live(docs).select("collection", "key")


def next_page(docs: DataFrame, collection: str, after: str, size: int) -> DataFrame:
    """The ``size`` live documents that follow key ``after``."""
    return live(docs).where((F.col("collection") == collection) & (F.col("key") > after)).orderBy("key").limit(size)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key (by ``order``, a total one), as an aggregate that combines before the shuffle."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return newest.select("r.*")


def equal_lookup(docs: DataFrame, field: Column, value: Column, limit: int = 100, order: tuple[str, ...] = ("collection", "key")) -> DataFrame:
    """Live documents whose field equals a value, in key order; the limit is held to 1..1000."""
    return live(docs).where(field == value).orderBy(*order).limit(max(1, min(1000, limit)))


def tier(name: Column, query: str) -> Column:
    """0 for an exact match, 1 for a prefix, 2 for a part, null for none; case does not count."""
    low, q = F.lower(name), query.lower()
    return F.when(low == q, 0).when(F.startswith(low, F.lit(q)), 1).when(F.contains(low, F.lit(q)), 2)


def ranked_lookup(docs: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """Live documents whose key (or collection) matches: by tier, then newest, then collection and key; all are ranked."""
    found = live(docs).withColumn("tier", F.coalesce(tier(F.col("key"), query), F.when(tier(F.col("collection"), query).isNotNull(), 2))).where("tier is not null")
    cut = found.orderBy("tier", F.desc("updated_ms"), "collection", "key").limit(max(1, min(1000, limit)))
    return cut.select("tier", "collection", "key", "updated_ms", F.substring("doc", 1, 200).alias("preview"))


def mesh_lookup(hits: DataFrame, query: str) -> DataFrame:
    """One row per document over all nodes' hits, with the nodes that hold it; exact matches first."""
    merged = hits.groupBy("collection", "key").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return merged.withColumn("exact", F.lower("key") == query.lower()).orderBy(F.desc("exact"), "collection", "key")


def collections(docs: DataFrame, hidden: tuple[str, ...] = ("_transit",)) -> DataFrame:
    return docs.select("collection").where(~F.col("collection").isin(*hidden)).distinct()


def readable(docs: DataFrame, acl: DataFrame, user: str) -> DataFrame:
    """Documents of collections that are public, owned by the user, or open to them."""
    allowed = acl.where(~F.col("private") | (F.col("owner") == user) | F.array_contains("readers", user))
    return docs.join(allowed.select("collection"), "collection", "left_semi")


def writable(acl: DataFrame, user: str) -> DataFrame:
    """Collections the user may write: public ones and their own."""
    return acl.where(~F.col("private") | (F.col("owner") == user))


def effective_acl(acl: DataFrame, depth: int = 16) -> DataFrame:
    """Resolve parents: (collection, source, private, owner, readers); a cycle or too long a chain is closed to all.

    A collection without ``parent`` uses its own entry. Each of the ``depth`` steps is one join with the
    small table of parents.
    """
    top = acl.select("collection", F.col("collection").alias("source"), "parent", "private", "owner", "readers")
    step = acl.select(F.col("collection").alias("c2"), F.col("parent").alias("p2"), F.col("private").alias("pr2"), F.col("owner").alias("o2"), F.col("readers").alias("r2"))
    now = top
    for _ in range(depth):
        up = now.join(step, now["parent"] == step["c2"], "left")
        found = F.col("c2").isNotNull()
        now = up.select(
            "collection",
            F.when(found, F.col("c2")).otherwise(F.col("source")).alias("source"),
            F.when(found, F.col("p2")).otherwise(F.col("parent")).alias("parent"),
            *[F.when(found, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("private", "pr2"), ("owner", "o2"), ("readers", "r2"))],
        )
    closed = F.col("parent").isNotNull()
    return now.select(
        "collection",
        F.when(~closed, F.col("source")).alias("source"),
        F.when(closed, True).otherwise(F.col("private")).alias("private"),
        F.when(~closed, F.col("owner")).alias("owner"),
        F.when(~closed, F.col("readers")).alias("readers"),
    )


def newest_acl(versions: DataFrame) -> DataFrame:
    """Last writer wins per collection."""
    return latest(versions, ["collection"], "updated_ms")


def kind_of(json: Column, path: str) -> Column:
    """JSON kind of a field of a JSON text column; null where it is absent."""
    found = F.try_variant_get(F.try_parse_json(json), path, "variant")
    kind = F.schema_of_variant(found)
    return (
        F.when(kind.isNull(), None)
        .when(kind == "VOID", "null")
        .when(kind == "BIGINT", "integer")
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(F.startswith(kind, F.lit("ARRAY")), "array")
        .otherwise("object")
    )


def schema_violations(docs: DataFrame, json: str, properties: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """(collection, key, field, problem): wrong kinds of fields present, and required fields that are absent.

    An integer is a number too; kinds with unknown names never object.
    """
    problems = []
    for field, want in properties.items():
        kind = kind_of(F.col(json), f"$.{field}")
        if want in ("string", "number", "integer", "boolean", "array", "object", "null"):
            fine = kind.isin("integer", "number") if want == "number" else kind == want
            problems.append(F.when(kind.isNotNull() & ~fine, F.struct(F.lit(field).alias("field"), F.concat(F.lit(f"expected {want}, found "), kind).alias("problem"))))
    for field in required:
        problems.append(F.when(kind_of(F.col(json), f"$.{field}").isNull(), F.struct(F.lit(field).alias("field"), F.lit("required").alias("problem"))))
    return docs.select("collection", "key", F.explode(F.array_compact(F.array(*problems))).alias("p")).select("collection", "key", "p.field", "p.problem")


def _number_text(token: Column) -> Column:
    """One spelling for each JSON number, whole ones without a point or exponent."""
    real = token.try_cast("double")
    whole = F.when(token.rlike(r"[.eE]"), F.when((real == F.floor(real)) & (F.abs(real) < 1e37), real.try_cast("decimal(38,0)"))).otherwise(token.try_cast("decimal(38,0)"))
    return F.coalesce(whole.cast("string"), real.cast("string"), token)


def json_canon(json: Column) -> Column:
    """A JSON text with its fields in order and its numbers in one spelling; text inside strings stays. Null where it is no JSON."""
    plain = F.to_json(F.try_parse_json(json))
    tokens = F.regexp_extract_all(plain, F.lit(r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda x: F.when(x.rlike("^-?[0-9]"), _number_text(x)).otherwise(x)), "")


def json_equal(a: Column, b: Column) -> Column:
    """Deep equality of JSON texts, whatever the order of fields; numbers compare as numbers, strings as they are."""
    return json_canon(a).eqNullSafe(json_canon(b))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(collection, docs, checksum) of live documents, whatever their order.

    Per collection the sorted lines ``key=clock`` are hashed as one text. It is a chain by nature, so one task
    hashes a collection, but the engine sorts (and can spill) and the lines only stream by. ``spread_fingerprint`` has no chain.
    """
    lines = live(docs).select("collection", F.concat("key", F.lit("="), "clock").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(name, count, text):
            text.update(b"\n")
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([count], pa.int64()), pa.array([text.hexdigest()], pa.string())], ["collection", "docs", "checksum"])

        now, count, some, text = None, 0, False, hashlib.sha256()
        for batch in batches:
            for name, line in zip(batch.column("collection").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if count and name != now:
                    yield row(now, count, text)
                    count, some, text = 0, False, hashlib.sha256()
                now, count = name, count + 1
                if line is not None:
                    text.update(b"\n" * some + line.encode())
                    some = True
        if count:
            yield row(now, count, text)

    return lines.repartition("collection").sortWithinPartitions("collection", "line").mapInArrow(run, "collection string, docs long, checksum string")


def spread_fingerprint(docs: DataFrame) -> DataFrame:
    """(collection, docs, checksum) of live documents by sums of hashes, for collections too large to sort into one text.

    Per document the SHA-256 of ``key=clock`` is cut into four 60-bit numbers; their sums combine before the shuffle.
    """
    line = F.sha2(F.concat("key", F.lit("="), "clock").cast("binary"), 256)
    part = lambda k: F.conv(F.substring(line, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    per = live(docs).groupBy("collection").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)])
    return per.select("collection", "docs", F.concat_ws("-", *[F.col(f"s{k}").cast("string") for k in range(4)]).alias("checksum"))


def collection_stats(docs: DataFrame) -> DataFrame:
    """(collection, docs, deleted, first_key, last_key, bytes)."""
    return docs.groupBy("collection").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if("deleted").alias("deleted"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sum(F.octet_length("doc")).cast("long").alias("bytes")
    )


def node_collections(docs: DataFrame) -> DataFrame:
    """(node, collection, docs): what each node tells of its collections, all in one pass."""
    return live(docs).groupBy("node", "collection").agg(F.count(F.lit(1)).alias("docs"))


def fetch(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """The live documents that index hits point to; a hit without one is gone."""
    return hits.join(live(docs), ["collection", "key"])


def flat_text(json: Column) -> Column:
    """Field names and scalar leaves of a JSON text in order, joined by spaces; null where it is no JSON."""
    plain = F.to_json(F.try_parse_json(json))
    leaves = F.regexp_extract_all(plain, F.lit(r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false'), F.lit(0))
    return F.array_join(F.from_json(F.concat(F.lit("["), F.array_join(leaves, ","), F.lit("]")), "array<string>"), " ")


def key_index(entries: DataFrame) -> DataFrame:
    """Latest place of each (collection, key) over engines and nodes."""
    return latest(entries, ["collection", "key"], "updated_ms")


def quota(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """Bytes by engine, with each one's share of the limit."""
    used = docs.groupBy("engine").agg(F.sum("bytes").cast("long").alias("bytes"))
    return used.withColumn("ratio", F.round(F.col("bytes") / F.lit(float(limit_bytes)), 6))


def admit(writes: DataFrame, limit_bytes: int, overdraft: float = 0.05) -> DataFrame:
    """Whether each write of a node fits: growth up to the limit, merges up to the overdraft above it.

    Running sums go per node in order of ``seq``, in blocks, so a busy node is not one task.
    """
    ceiling = F.when(F.col("merge"), F.lit(limit_bytes * (1 + overdraft))).otherwise(F.lit(float(limit_bytes)))
    return running_sum(writes, "node", "seq", "growth", "total").withColumn("admitted", (F.col("growth") <= 0) | (F.col("total") <= ceiling))


def derived_problems(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """(collection, key, problem): stored documents (``doc``) that the derived ones lack or hold with another content."""
    other = derived.select("collection", "key", F.col("doc").alias("other"), F.lit(True).alias("there"))
    both = stored.where("doc <> '{}'").join(other, ["collection", "key"], "left")
    problem = F.when(F.col("there").isNull(), "missing").when(~json_equal(F.col("doc"), F.col("other")), "differs")
    return both.select("collection", "key", problem.alias("problem")).where("problem is not null")
