"""Exact dedup by deterministic block naming.

Every text is cut into blocks of ``block_bytes``. Equal blocks get one integer name by
sorting: blocks are dealt by checksum, sorted, and numbered. Each text is then a sequence
of names; adjacent pairs are named the same way, round after round, until one name is left.
Two texts end with the same name if and only if they are equal: no hash decides.

Tasks first name their own distinct blocks by small numbers (a *chunk*'s dictionary), so a
block that a third of all rows share is shuffled once per task, and the names that come
back travel once per task too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textarrays import texts

BLOCK_BYTES = 4096
#: A chunk's distinct blocks and documents, in bytes, before it is sent on.
FLUSH_BYTES = 8 << 20

_ITEM = [("bucket", "int"), ("kind", "int"), ("chunk", "long"), ("seq", "int"), ("key", "binary"), ("name", "long"), ("sha", "binary"), ("refs", "array<int>")]
_NAMED = [("sha", "binary"), ("name", "long"), ("names", "array<long>")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _columns(own: list[tuple[str, str]], carry: tuple[str, ...]) -> list[tuple[str, str]]:
    return own + [(c, "long") for c in carry]


def _ddl(own: list[tuple[str, str]], carry: tuple[str, ...]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in _columns(own, carry))


def _schema(own: list[tuple[str, str]], carry: tuple[str, ...]) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in _columns(own, carry)])


class _Chunk:
    """The distinct keys and the documents that one task has seen since its last flush."""

    def __init__(self, buckets: int, carry: tuple[str, ...]):
        from pyspark import TaskContext

        self.buckets, self.schema, self.id = buckets, _schema(_ITEM, carry), TaskContext.get().partitionId() << 24
        self.clear()

    def clear(self) -> None:
        self.keys: dict[bytes, int] = {}
        self.docs: list[tuple] = []
        self.refs: list[list[int]] = []
        self.size = 0

    def add(self, sha: bytes, carried: tuple, keys: list[bytes]) -> None:
        refs = []
        for k in keys:
            if (at := self.keys.get(k)) is None:
                at = self.keys[k] = len(self.keys)
                self.size += len(k) + 100
            refs.append(at)
        self.size += 200 + 8 * len(refs)
        self.docs.append((sha, *carried))
        self.refs.append(refs)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The chunk's keys in order and numbered, then its documents with the numbers of their keys."""
        if self.docs:
            order = sorted(self.keys)
            rank = {self.keys[k]: i for i, k in enumerate(order)}
            n, m = len(order), len(self.docs)
            columns = {
                "bucket": [zlib.crc32(k) % self.buckets for k in order] + [i % self.buckets for i in range(m)],
                "kind": [0] * n + [1] * m,
                "chunk": [self.id] * (n + m),
                "seq": [*range(n)] + [0] * m,
                "key": order + [None] * m,
                "name": [None] * (n + m),
                "refs": [None] * n + [[rank[r] for r in refs] for refs in self.refs],
            }
            for name, values in zip(("sha", *self.schema.names[len(_ITEM) :]), zip(*self.docs, strict=True), strict=True):
                columns[name] = [None] * n + list(values)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in self.schema], schema=self.schema)
            self.id += 1
        self.clear()


def _cut(buckets: int, block: int, carry: tuple[str, ...]):
    def run(batches):
        chunk = _Chunk(buckets, carry)
        for batch in batches:
            t, carried = texts(batch.column("text")), zip(*(batch.column(c).to_pylist() for c in carry), strict=True)
            for i, own in enumerate(carried):
                raw = t.bytes_of(i)
                chunk.add(hashlib.sha256(raw).digest(), own, [raw[k : k + block] for k in range(0, len(raw), block)] or [b""])
                if chunk.size > FLUSH_BYTES:
                    yield from chunk.flush()
        yield from chunk.flush()

    return run


def _pairs(buckets: int, carry: tuple[str, ...]):
    def run(batches):
        chunk = _Chunk(buckets, carry)
        for batch in batches:
            carried = zip(*(batch.column(c).to_pylist() for c in carry), strict=True)
            for sha, row, own in zip(batch.column("sha").to_pylist(), batch.column("names"), carried, strict=True):
                names = row.values.to_numpy()
                names = np.append(names, -1) if len(names) % 2 else names
                raw = names.astype(">i8").tobytes()
                chunk.add(sha, own, [raw[k : k + 16] for k in range(0, len(raw), 16)])
                if chunk.size > FLUSH_BYTES:
                    yield from chunk.flush()
        yield from chunk.flush()

    return run


def _number(batches):
    """Sorted by (bucket, kind, key): equal keys get one number, unique over all buckets."""
    bucket, last, rank = None, None, -1
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at, own, key = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy() == 0, batch.column("key")
        fresh, head = np.ones(n, bool), np.ones(n, bool)
        head[1:] = at[1:] != at[:-1]
        fresh[1:] = head[1:] | ~pc.fill_null(pc.equal(key.slice(1), key.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        fresh[0] = at[0] != bucket or key[0].as_py() != last
        fresh &= own
        starts, count = np.flatnonzero(head), np.cumsum(fresh)
        sizes = np.diff(starts, append=n)
        ranks = count - 1 - np.repeat((count - fresh)[starts], sizes)
        if at[0] == bucket:
            ranks[: sizes[0]] += rank + 1
        mine = np.flatnonzero(own[starts[-1] :])
        if len(mine):
            end = int(starts[-1] + mine[-1])
            last, rank = key[end].as_py(), int(ranks[end])
        elif at[-1] != bucket:
            last, rank = None, -1
        bucket = at[-1]
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["name"] = pa.array((at.astype(np.int64) << 32) | ranks, pa.int64(), mask=~own)
        columns["key"] = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _collect(level: int, carry: tuple[str, ...]):
    """Sorted by (chunk, kind, seq): put the names back in the documents' places."""

    def run(batches):
        current, table = None, [np.zeros(0, np.int64)]
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunks)) + 1, [len(chunks)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if chunks[lo] != current:
                    current, table = chunks[lo], []
                part = batch.slice(lo, hi - lo)
                keys = int(np.searchsorted(part.column("kind").to_numpy(), 1))
                table.append(part.column("name").slice(0, keys).to_numpy())
                docs = part.slice(keys)
                if not docs.num_rows:
                    continue
                table = [np.concatenate(table)]
                refs = docs.column("refs")
                got, size = table[0][refs.flatten().to_numpy()], np.diff(refs.offsets.to_numpy())
                whole = size == 1
                name = np.zeros(len(size), np.int64)
                name[whole] = got[np.repeat(whole, size)] << 6 | level
                left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(whole, 0, size))]), pa.int32()), pa.array(got[np.repeat(~whole, size)]))
                yield pa.RecordBatch.from_arrays([docs.column("sha"), pa.array(name, mask=~whole), left, *(docs.column(c) for c in carry)], ["sha", "name", "names", *carry])

    return run


def _name(items: DataFrame, level: int, n: int, carry: tuple[str, ...]) -> DataFrame:
    """One round: number the distinct keys, and give each document the names of its own."""
    named = items.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "key").mapInArrow(_number, _ddl(_ITEM, carry))
    back = named.drop("key", "bucket").repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "seq")
    return storage.materialize(back.mapInArrow(_collect(level, carry), _ddl(_NAMED, carry)), "names")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(sha, name, *carry): one row per row of ``docs``; ``name`` is equal just where the texts are.

    Null text counts as empty. Texts of one block have their name after the first round and leave; the
    number of rounds follows the longest text. Each round ends in a table in the shared folder.
    """
    docs = storage.texts_of(docs, *((c, "long") for c in carry), ("text", "string"))
    n = storage.parts(docs, 8 << 20)
    now = _name(docs.mapInArrow(_cut(n, block_bytes, carry), _ddl(_ITEM, carry)), 0, n, carry)
    out, level = now.where("name is not null"), 0
    while not (rest := now.where("name is null")).isEmpty():
        level, n = level + 1, storage.parts(now, 8 << 20)
        now = _name(rest.mapInArrow(_pairs(n, carry), _ddl(_ITEM, carry)), level, n, carry)
        out = out.unionByName(now.where("name is not null"))
    return out.drop("names")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), one row per row.

    Of equal texts the row with the largest doc_id stays; null text counts as empty. Null ids
    lose against any other, and stay if their group has no other. Rows that repeat an id
    with the same text are rows of the group and share its verdict. An empty table gives
    an empty result; further columns are not read.
    """
    ids = identities(docs, block_bytes)
    groups = ids.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return storage.skew_join(ids, groups, "name").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def distinct_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``exact_dedup`` keeps: one row of each text.

    Of rows that share text and id (a null id included) one stays, whichever stands last in the files.
    """
    rows, places = storage.placed(docs)
    ids = identities(rows, block_bytes, ("doc_id", *places))
    stay = ids.groupBy("name").agg(F.max(F.struct("doc_id", *places)).alias("row")).select("row.*")
    return storage.pick(rows, stay, places)
