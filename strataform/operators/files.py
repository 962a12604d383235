"""Files: listings, search, inverted index, chunked contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 3500
SPLIT_ABOVE = 2000
# Fixed value: characters that end a token, besides white space.
DELIMITERS = r"[\s,.;:!?()\[\]{}\"'\-_/]+"
_DROPPED = "[^a-z0-9" + DELIMITERS[1:-1]
SORTS = {
    "size_bytes": [F.asc, "size_bytes"],
    "-size_bytes": [F.desc, "size_bytes"],
    "filename": [F.asc, "filename"],
    "-filename": [F.desc, "filename"],
}


def matching(files: DataFrame, mime: str = "", min_size: int = 0, max_size: int = 0, before_ms: int = 0, after_ms: int = 0) -> DataFrame:
    """Files with a name whose type starts with ``mime``, within sizes and strictly between times; 0 disables."""
    found = files.where("filename is not null")
    if mime:
        found = found.where(F.startswith("mime", F.lit(mime)))
    if min_size:
        found = found.where(F.col("size_bytes") >= min_size)
    if max_size:
        found = found.where(F.col("size_bytes") <= max_size)
    if before_ms:
        found = found.where(F.col("created_ms") < before_ms)
    return found.where(F.col("created_ms") > after_ms) if after_ms else found


def page(files: DataFrame, sort: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
    """A page in a total order (ties by collection and key), with the total and whether more follow."""
    way, name = SORTS.get(sort, (F.desc, "created_ms"))
    total = files.agg(F.count(F.lit(1)).alias("total"))
    cut = files.orderBy(way(name), "collection", "key").offset(offset).limit(limit)
    return cut.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + limit)  # one row is broadcast


def recent(files: DataFrame, limit: int = 20) -> DataFrame:
    return files.where("filename is not null").orderBy(F.desc("created_ms"), "collection", "key").limit(limit)


def search(files: DataFrame, query: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Substring search over all files: 10 for the name, 1 for the excerpt; case does not count."""
    q = F.lit(query.lower())
    score = F.when(F.contains(F.lower("filename"), q), 10).otherwise(0) + F.when(F.contains(F.lower(F.coalesce("excerpt", F.lit(""))), q), 1).otherwise(0)
    return files.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("created_ms"), "collection", "key").offset(offset).limit(limit)


def _plain(text: Column) -> Column:
    """The text with its tokens as runs of a-z and 0-9 between delimiters: one pass over it, not one a token."""
    return F.regexp_replace(F.lower(text), _DROPPED, "")


def tokens(text: Column) -> Column:
    """Tokens in order, lower case, of a-z and 0-9; empty ones left out."""
    return F.filter(F.split(_plain(text), DELIMITERS), lambda x: x != "")


def postings(files: DataFrame, key: str = "key", name: str = "filename", content: str = "content") -> DataFrame:
    """(key, term, weight): 10 for every token of the name, 1 for every token of the content, summed."""
    both = files.select(key, F.explode(tokens(F.col(name))).alias("term"), F.lit(10).alias("w")).unionByName(files.select(key, F.explode(tokens(F.col(content))).alias("term"), F.lit(1).alias("w")))
    return both.groupBy(key, "term").agg(F.sum("w").cast("long").alias("weight"))


def or_search(index: DataFrame, query: str, key: str = "key") -> DataFrame:
    """Score of each file over the query's tokens (a token twice counts twice); terms are a literal list."""
    terms = [t for t in ("".join(c for c in w.lower() if c.isascii() and c.isalnum()) for w in _split(query)) if t]
    times = F.lit(0)
    for t in sorted(set(terms)):
        times = F.when(F.col("term") == t, terms.count(t)).otherwise(times)
    hits = index.where(F.col("term").isin(*set(terms))) if terms else index.where(F.lit(False))
    return hits.groupBy(key).agg(F.sum(F.col("weight") * times).cast("long").alias("score"))


def _split(text: str) -> list[str]:
    import re

    return re.split(DELIMITERS, text)


def bm25(docs: DataFrame, query: str, limit: int = 100, key: str = "key", content: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best ``limit`` documents by BM25, ties by key.

    One pass gives sizes and the query's term counts per document; texts are not exploded.
    """
    terms = sorted({t for t in ("".join(c for c in w.lower() if c.isascii() and c.isalnum()) for w in _split(query)) if t})
    runs = [F.regexp_count("plain", F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")).alias(f"tf{i}") for i, t in enumerate(terms)]
    once = docs.select(key, F.explode(F.array(_plain(F.col(content)))).alias("plain"))  # a generator is not merged into what follows: one pass a text
    counted = once.select(key, F.regexp_count("plain", F.lit("[a-z0-9]+")).alias("size"), *runs)
    whole = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    joined = counted.join(F.broadcast(whole), F.lit(True))  # one row is broadcast
    for i in range(len(terms)):
        idf = F.log1p((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return joined.withColumn("score", score).where("score > 0").select(key, "score").orderBy(F.desc("score"), key).limit(limit)


def split_parts(docs: DataFrame, text: str = "text", key: str = "key", size: int = CHUNK_CHARS) -> DataFrame:
    """(parent_key, part_index, part_total, text): texts above ``size`` characters in parts of that size."""
    total = F.greatest(F.ceil(F.char_length(text) / size), F.lit(1)).cast("int")
    parts = docs.select(F.col(key).alias("parent_key"), total.alias("part_total"), F.posexplode(F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))).alias("part_index", "text"))
    return parts.select("parent_key", "part_index", "part_total", "text")


def reassemble(manifests: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, size, sha256, problem): base64 parts in order, decoded, checked against the manifest.

    Parts meet per file in one aggregate; a file is at most what a row may hold.
    """
    whole = parts.groupBy(F.col("parent_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("part_index", "text"))).alias("p"))
    body = F.try_to_binary(F.array_join(F.transform("p", lambda x: x["text"]), ""), F.lit("base64"))
    read = manifests.join(whole, "key", "left").withColumn("body", F.coalesce(body, F.when(F.col("part_total") == 0, F.lit(b""))))
    numbers = F.transform(F.col("p"), lambda x: x["part_index"])
    complete = (F.col("part_total") == 0) | (F.coalesce(numbers == F.sequence(F.lit(0), F.greatest(F.col("part_total") - 1, F.lit(0))), F.lit(False)))
    problem = (
        F.when(~complete, "missing part")
        .when(F.col("body").isNull(), "not base64")
        .when(F.octet_length("body") != F.col("size_bytes"), "size")
        .when(F.sha2("body", 256) != F.col("sha256"), "sha256")
    )
    return read.select("key", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha256"), F.coalesce(problem, F.lit("")).alias("problem"))
