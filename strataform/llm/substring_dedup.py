"""Substring dedup: remove every word that a repeated window of words covers, but for the first copy.

Documents are dealt, in order of doc_id, into chunks of about ``CHUNK_BYTES``. Each chunk takes the
Rabin-Karp hashes of all its windows of ``WINDOW`` words and sends the distinct ones, as arrays by
bucket of the hash range. Spark spreads them into rows and counts, hash by hash, in which chunks a
window stands; rows of all chunks but the first go back to their chunk. It then knows
all windows that start earlier somewhere; covered words merge into maximal removal intervals.

A window that a third of all documents share is one row per chunk, and documents of one id are dealt
over chunks like any others, so no key is hot. Window hashes have 64 bits: among n distinct windows
the odds of any false match are about n * n / 2**65 (1 in 3700 at 10**8 windows); at 10**13
windows some millions of them would match another by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage
from .textarrays import U64, Texts, Words, joined, texts, windows, words

WINDOW = 20
CHUNK_BYTES = 4 << 20
#: Chunks to a shuffle partition, and buckets of the hash range to one.
CHUNKS_EACH = 32
BUCKETS_EACH = 4

_PACKS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.list_(pa.int64()))])


def _bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash range begins in a sorted array."""
    number = ((sorted_hashes >> U64(32)) * U64(buckets)) >> U64(32)
    return np.searchsorted(number, np.arange(buckets + 1, dtype=np.uint64))


def _ordered(chunk: pa.Table) -> pa.Table:
    """The chunk's documents by id, null first; repeated ids by their turn."""
    return chunk.take(pc.sort_indices(chunk, sort_keys=[("doc_id", "ascending"), ("turn", "ascending")], null_placement="at_start"))


def _windows(chunk: pa.Table, n: int) -> tuple[Texts, Words, np.ndarray, np.ndarray]:
    t = texts(chunk.column("text"))
    w = words(t)
    return t, w, *windows(w.hash, w.first, n)


def _emit(buckets: int, n: int):
    def run(key, chunk):
        _, _, h, _ = _windows(chunk, n)
        h = np.unique(h)
        cuts = _bucket_cuts(h, buckets)
        full = np.flatnonzero(np.diff(cuts) > 0)
        hashes = pa.ListArray.from_arrays(pa.array(np.append(cuts[full], len(h)), pa.int32()), pa.array(h.view(np.int64)))
        return pa.table([pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array(full, pa.int32()), hashes], schema=_PACKS)

    return run


def _finish(n: int, with_text: bool):
    def run(chunk, answers):
        chunk = _ordered(chunk)
        t, w, h, at = _windows(chunk, n)
        first = np.ones(len(h), bool)
        unique, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        first[one] = False
        earlier = np.zeros(len(unique), bool)
        earlier[np.searchsorted(unique, answers.column("hash").to_numpy().view(np.uint64))] = True
        repeat = at[earlier[inverse] | first]
        cover = np.zeros(len(w.start) + 1, np.int32)
        np.add.at(cover, repeat, 1)
        np.add.at(cover, repeat + n, -1)
        keep = np.cumsum(cover[:-1]) == 0
        kept, _, _ = joined(t, w, keep)
        count = np.concatenate([[0], np.cumsum(~keep)])
        columns = {
            "doc_id": chunk.column("doc_id"),
            "n_words": pa.array(np.diff(w.first), pa.int64()),
            "n_removed": pa.array(np.diff(count[w.first]), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept.bytes_of(i)).hexdigest() for i in range(len(kept))], pa.string()),
        }
        if with_text:
            columns["kept_text"] = pa.array([kept.bytes_of(i).decode() for i in range(len(kept))], pa.string())
        return pa.table(columns)

    return run


def _order_keys(doc_id: pa.Array, turn: pa.Array) -> np.ndarray:
    """Rows' places in the order (doc_id, turn), null ids first, as byte strings that compare alike."""
    out = np.zeros((len(doc_id), 17), np.uint8)
    out[:, 0] = doc_id.is_valid().to_numpy(zero_copy_only=False)
    for at, column in ((1, pc.fill_null(doc_id, 0)), (9, turn)):
        flipped = column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ U64(1 << 63)
        out[:, at : at + 8] = flipped.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _starts(limit: int):
    """The first row of every chunk: rows come in order, and a chunk ends when it holds ``limit`` bytes."""

    def run(batches):
        total, last = 0, -1
        for batch in batches:
            filled = total + np.cumsum(batch.column("size").to_numpy())
            slot = (np.concatenate([[total], filled[:-1]]) if len(filled) else filled) // limit
            new = np.concatenate([[last], slot[:-1]])[: len(slot)] != slot
            if len(slot):
                total, last = int(filled[-1]), int(slot[-1])
            yield pa.RecordBatch.from_arrays([pa.array([x.ljust(17, b"\0") for x in _order_keys(batch.column("doc_id"), batch.column("turn"))[new]], pa.binary())], ["start"])

    return run


def _chunked(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``rows`` with ``chunk``, numbers that follow the order (doc_id, turn), and how many there are.

    The driver gets one key of 17 bytes a chunk.
    """
    light = rows.select("doc_id", "turn", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size"))
    light = light.repartitionByRange(storage.shuffle_partitions(rows), "doc_id", "turn").sortWithinPartitions("doc_id", "turn")
    starts = light.mapInArrow(_starts(limit), "start binary").toPandas()["start"]
    bounds = np.sort(np.array([bytes(x) for x in starts], "S17"))[1:]

    @F.arrow_udf("int")
    def chunk_of(doc_id: pa.Array, turn: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, _order_keys(doc_id, turn), "right"), pa.int32())

    return rows.withColumn("chunk", chunk_of("doc_id", "turn")), len(bounds) + 1


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row per row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a smaller
    doc_id, or before it in the same document. Windows are judged on the input. Null and
    short texts have no window and stay whole. Null ids come first; rows that repeat an id
    have an order of their own, by a hash of text and place. Kept words are joined by one space. Other columns are not read.
    """
    docs, places = storage.placed(docs)
    rows = storage.texts_of(docs, ("doc_id", "long"), ("text", "string"), keep=tuple(places))
    rows = rows.select("doc_id", "text", F.xxhash64("text", *places).alias("turn"))
    rows, chunks = _chunked(rows, chunk_bytes)
    n = max(storage.shuffle_partitions(docs), -(-chunks // CHUNKS_EACH))
    dealt = rows.repartition(n, "chunk")
    packs = dealt.groupBy("chunk").applyInArrow(_emit(BUCKETS_EACH * n, window), "chunk int, bucket int, hashes array<long>")
    seen = packs.repartition(n, "bucket").select("bucket", "chunk", F.explode("hashes").alias("hash"))
    counted = seen.withColumn("first", F.min("chunk").over(Window.partitionBy("hash", "bucket")))  # dealt by bucket already: no further shuffle
    answers = counted.where("chunk > first").select("chunk", "hash")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish(window, with_text), schema)
