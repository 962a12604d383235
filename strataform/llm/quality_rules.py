"""Quality rules: base figures of every text, and cross-document line frequency.

Normalised lines (lower case, white space and digits evened out) are hashed; for each host
the distinct documents that hold a line are counted. Lines above the limit, a share of the host's
own documents, are removed, and a document that this leaves with too small a share of its words is rejected.
``cleaned`` gives the texts without those lines; all figures of lines removed come from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textarrays import LOWER, U64, WORD_BYTE, Texts, mix, slices, texts, windows, words

#: A line that a greater share of one host's documents hold is removed there, if it is in more than ``MIN_DOCS`` of them.
MAX_DOCS_SHARE = 0.05
MIN_DOCS = 3
#: A document must keep this share of its words.
MIN_KEPT_SHARE = 0.5
MIN_WORDS = 50
#: Up to so many frequent lines (some 16 bytes each), or hosts, are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 200_000

_LINE_BYTE = np.ones(256, bool)
_LINE_BYTE[0x0A] = False
_NORMAL = LOWER.copy()
_NORMAL[0x30:0x3A] = 0x30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_POINT = WORD_BYTE.copy()  # the first byte of a code point of a word
_POINT[0x80:0xC0] = False

_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_HELD = "doc_id long, host string, mark long, lines array<long>"
_CLEANED = ", ".join(["doc_id long, host string, text string", *(f"{c} long" for c in _FIGURES), "n_line_words long"])


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[bounds])


def _with_text(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + mix(doc.astype(np.uint64) + U64(1)))


def line_hashes(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: their text, the hash of their words as normalised, their words, the raw line's hash, and where it starts."""
    raw = words(t, _LINE_BYTE)
    w = words(Texts(_NORMAL[t.data], t.offsets))
    line = np.searchsorted(raw.start, w.start, "right") - 1
    if not len(line):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none.astype(np.uint64), none
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.concatenate([first, [len(line)]]))
    place = np.arange(len(line)) - np.repeat(first, size)
    odd = (place.astype(np.uint64) << U64(1)) + U64(1)
    h = mix(np.add.reduceat(w.hash * mix(odd) + odd, first))
    return raw.doc()[line[first]], h, size, raw.hash[line[first]], raw.start[line[first]]


def distinct_lines(column: pa.Array) -> pa.Array:
    """The hashes of the distinct normalised lines of every text."""
    t = texts(column)
    owner, lines, *_ = line_hashes(t)
    _, one = np.unique(_with_text(lines, owner), return_index=True)
    one.sort()
    offsets = pa.array(np.searchsorted(owner[one], np.arange(len(t) + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(lines[one].view(np.int64)))


def figures(t: Texts, owner: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
    """The base figures of every text, given its lines' texts and raw hashes."""
    w = words(t)
    n = len(t)
    doc = w.doc()
    h, at = windows(w.hash, w.first, 3)
    keyed = _with_text(h, doc[at]) if len(at) else h
    _, inverse, count = np.unique(keyed, return_inverse=True, return_counts=True)
    cover = np.zeros(len(w.start) + 1, np.int32)
    if len(at):
        twice = at[count[inverse] > 1]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 3, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    _, one = np.unique(_with_text(raw, owner), return_index=True)
    duplicate = np.ones(len(raw), bool)
    duplicate[one] = False
    return [np.diff(w.first), _per_text(_POINT[t.data], t.offsets), _per_text(_SYMBOL[t.data], t.offsets), np.bincount(owner[duplicate], minlength=n), _per_text(repeated, w.first)]


def without_lines(column: pa.Array, t: Texts, owner: np.ndarray, start: np.ndarray, goes: np.ndarray) -> pa.Array:
    """The texts without the lines that go; the others stay as they are and in order."""
    gaps = np.flatnonzero(t.data == 0x0A)
    number = np.searchsorted(gaps, start[goes]) - np.searchsorted(gaps, t.offsets[:-1])[owner[goes]]
    hit, first = np.unique(owner[goes], return_index=True)
    if not len(hit):
        return column
    left = []
    for i, gone in zip(hit, np.split(number, first[1:]), strict=True):
        out = set(gone.tolist())
        left.append(b"\n".join(x for k, x in enumerate(t.bytes_of(i).split(b"\n")) if k not in out))
    mask = np.zeros(len(t), bool)
    mask[hit] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array(left, pa.binary()).cast(pa.string(), safe=False))


def _lines(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "host", "mark")), distinct_lines(part.column("text"))], ["doc_id", "host", "mark", "lines"])


def _clean(box):
    """``box`` holds each host's frequent lines, sorted; without it they are in the column ``gone``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column("text")
                t = texts(column)
                owner, line, size, raw, start = line_hashes(t)
                if box is not None:
                    frequent = [box.value.get(x) for x in part.column("host").to_pylist()]
                else:
                    frequent = [None if x is None else np.sort(np.array(x, np.int64).view(np.uint64)) for x in part.column("gone").to_pylist()]
                goes = np.zeros(len(line), bool)
                first = np.searchsorted(owner, np.arange(len(t) + 1))
                for i, known in enumerate(frequent):
                    if known is not None:
                        own = line[first[i] : first[i + 1]]
                        goes[first[i] : first[i + 1]] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
                lost = np.bincount(owner[goes], size[goes], len(t)).astype(np.int64)
                left = without_lines(column, t, owner, start, goes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), left, *(pa.array(x, pa.int64()) for x in (*figures(t, owner, raw), lost))], ["doc_id", "host", "text", *_FIGURES, "n_line_words"])

    return run


def frequent_lines(stats: DataFrame, limit: int | None = None) -> DataFrame:
    """(host, line): lines that too many documents of the host hold, over all documents.

    Too many are more than ``limit``; without one, more than ``MAX_DOCS_SHARE`` of the host's documents and than ``MIN_DOCS``.
    """
    held = stats.select("host", F.explode("lines").alias("line"))
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (MIN_DOCS if limit is None else limit))
    if limit is not None:
        return counts.select("host", "line")
    hosts = storage.materialize(stats.groupBy("host").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") * MAX_DOCS_SHARE > MIN_DOCS), "hosts")
    few = hosts.count() <= BROADCAST_LINES
    return storage.join_null_safe(counts, F.broadcast(hosts) if few else hosts, ["host"]).where(F.col("docs").isNull() | (F.col("n") > F.col("docs") * MAX_DOCS_SHARE)).select("host", "line")


def cleaned(docs: DataFrame, limit: int | None = None, min_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """(doc_id, source, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_line_words).

    One row per row of ``docs``, ``text`` being without the lines of ``frequent_lines``: the other parts
    between line feeds, in order. The host is the column ``source``, null being a host of its own.
    ``n_line_words`` are the words in lines removed; the other figures are of the whole text. Null and
    empty texts fail the base rules. Rows that repeat an id are documents of their own. Other columns are not read.
    """
    docs = storage.texts_of(docs, ("doc_id", "long"), ("source", "string"), ("text", "string")).withColumnRenamed("source", "host")
    marked = docs.withColumn("mark", F.xxhash64("text"))
    stats = storage.materialize(marked.mapInArrow(_lines, _HELD), "lines-held")
    frequent = storage.materialize(frequent_lines(stats, limit), "lines")
    if frequent.count() <= BROADCAST_LINES:
        rows = frequent.toPandas()
        known = {None if host != host else host: np.sort(x.to_numpy(np.int64).view(np.uint64)) for host, x in rows.groupby("host", dropna=False)["line"]}
        found = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(known)), _CLEANED)
    else:  # rows alike in id, host and text lose the same lines
        held = stats.select("doc_id", "host", "mark", F.explode("lines").alias("line"))
        gone = storage.join_null_safe(held, frequent, ["line", "host"], "inner").groupBy("doc_id", "host", "mark").agg(F.collect_set("line").alias("gone"))
        gone = gone.repartition(storage.shuffle_partitions(gone))
        found = storage.join_null_safe(marked, gone, ["doc_id", "host", "mark"]).drop("mark").mapInArrow(_clean(None), _CLEANED)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    return (
        found.withColumnRenamed("host", "source")
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= F.lit(min_share) * F.col("n_words")))
        .select("doc_id", "source", "text", *_FIGURES, "base_failed", "kept", "n_line_words")
    )


def quality_rules(docs: DataFrame, limit: int | None = None, min_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The figures and verdicts of ``cleaned``, without its texts."""
    return cleaned(docs, limit, min_share).drop("source", "text")


def digests(docs: DataFrame) -> DataFrame:
    """``quality_rules``, with the SHA-256 of each text as ``cleaned`` leaves it (null counts as empty)."""
    return cleaned(docs).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).drop("source", "text")
