"""SimHash near-duplicates, linked by anchor-point covering.

The fingerprint of a text has a bit for each bit that more than half of its 3-word
shingles' hashes set. Two texts link when their fingerprints differ in ``THRESHOLD`` bits or fewer.

Anchors are the words of a covering code: the product of two binary Golay codes (23 bits,
covering radius 3), a Hamming code (15 bits, radius 1) and a repetition code (3 bits,
radius 1). All four are perfect, so every 64-bit word is within R = 8 of one anchor found by
syndromes, its home. A fingerprint is replicated to the anchors within R + threshold at which
it can meet a partner: two fingerprints that differ in up to 2 bits have a word between
them, within 1 of both, and meet at that word's home. So it goes to the homes of itself and
of the 64 words around it, about 17 anchors out of 2**36. Per anchor the fingerprints are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .components import components
from .textarrays import LOWER, U64, joined, slices, texts, words

THRESHOLD = 2
SHINGLE = 3
SEED = 42

# XXH64 primes.
_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U64(k)) | (x >> U64(64 - k))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every span [start, end), all spans of one length at once."""
    out = np.empty(len(start), np.uint64)
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(pad[:8].view(np.uint64), (len(data) + 1,), (1,)) if len(data) else np.zeros(1, np.uint64)
    four = np.lib.stride_tricks.as_strided(pad[:4].view(np.uint32), (len(data) + 1,), (1,)) if len(data) else np.zeros(1, np.uint32)
    size = end - start
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 65536 else size, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1, [len(size)]])
    with np.errstate(over="ignore"):
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            rows = order[lo:hi]
            n, at = int(size[rows[0]]), start[rows]
            if n > 512 and len(rows) < 64:
                for r in rows:
                    out[r] = xxhash.xxh64_intdigest(data[start[r] : end[r]].tobytes(), seed=seed)
                continue
            done = 0
            if n >= 32:
                lanes = [np.full(len(rows), v % (1 << 64), np.uint64) for v in (seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1))]
                while done + 32 <= n:
                    lanes = [_round(a, eight[at + done + 8 * k]) for k, a in enumerate(lanes)]
                    done += 32
                h = _rot(lanes[0], 1) + _rot(lanes[1], 7) + _rot(lanes[2], 12) + _rot(lanes[3], 18)
                for a in lanes:
                    h = (h ^ _round(np.zeros(1, np.uint64), a)) * _P1 + _P4
            else:
                h = np.full(len(rows), (seed + int(_P5)) % (1 << 64), np.uint64)
            h = h + U64(n)
            while done + 8 <= n:
                h = _rot(h ^ _round(np.zeros(1, np.uint64), eight[at + done]), 27) * _P1 + _P4
                done += 8
            if done + 4 <= n:
                h = _rot(h ^ (four[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while done < n:
                h = _rot(h ^ (data[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h = (h ^ (h >> U64(33))) * _P2
            h = (h ^ (h >> U64(29))) * _P3
            out[rows] = h ^ (h >> U64(32))
    return out


#: Byte b's bits in eight lanes of eight bits each.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every group of consecutive hashes, how many set each of the 64 bits."""
    groups = len(first) - 1
    out = np.zeros((groups, 64), np.int64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    sizes = np.diff(first)[full]
    steps = -(-sizes // 255)  # lanes hold up to 255
    begin = np.repeat(first[:-1][full], steps) + 255 * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
    head = np.cumsum(steps) - steps
    raw = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        part = np.add.reduceat(_LANES[raw[:, k]], begin).view(np.uint8).reshape(-1, 8)
        out[full, 8 * k : 8 * k + 8] = np.add.reduceat(part.astype(np.int64), head, axis=0)
    return out


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """SimHash fingerprints (uint64) of a column of texts; zero where there is no word."""
    t = texts(column)
    w = words(t, hashed=False, limit=1 << 21)
    flat, start, end = joined(t, w, table=LOWER)
    n = np.diff(w.first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(w.first[:-1], count) + np.arange(first[-1]) - np.repeat(first[:-1], count)
    stop = begin + np.repeat(np.minimum(n, SHINGLE), count) - 1
    h = xxh64(flat.data, start[begin], end[stop])
    majority = 2 * bit_counts(h, first) > count[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel() if len(t) else np.zeros(0, np.uint64)


def _fingerprint(batches):
    for batch in batches:
        rest = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        for part in slices(batch, "text"):
            fp = pa.array(fingerprints_of(part.column("text")).view(np.int64))
            yield pa.RecordBatch.from_arrays([fp, *(part.column(k) for k in rest)], ["fp", *(part.schema.names[k] for k in rest)])


# --- the covering code -------------------------------------------------------------------


def _golay_rows() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 bits, and the error pattern of each of the 2048 syndromes."""
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    syndrome = []
    for k in range(23):
        r = 1 << k
        for d in range(22, 10, -1):
            if r >> d & 1:
                r ^= generator << (d - 11)
        syndrome.append(r)
    errors = np.zeros(2048, np.uint64)
    for i in range(23):
        errors[syndrome[i]] = 1 << i
        for j in range(i):
            errors[syndrome[i] ^ syndrome[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[syndrome[i] ^ syndrome[j] ^ syndrome[k]] = 1 << i | 1 << j | 1 << k
    low = np.zeros(1 << 12, np.uint64)
    high = np.zeros(1 << 11, np.uint64)
    for table, offset in ((low, 0), (high, 12)):
        for x in range(len(table)):
            s = 0
            for b in range(12):
                if x >> b & 1:
                    s ^= syndrome[b + offset]
            table[x] = s
    return np.stack([low, np.concatenate([high, high])]), errors


_GOLAY, _GOLAY_ERRORS = _golay_rows()
_HAMMING = np.zeros(1 << 15, np.uint64)
for _k in range(15):
    _HAMMING ^= np.where(np.arange(1 << 15) >> _k & 1, _k + 1, 0).astype(np.uint64)
_MASK23, _MASK15 = U64((1 << 23) - 1), U64((1 << 15) - 1)


def home(x: np.ndarray) -> np.ndarray:
    """The anchor nearest to each 64-bit word."""
    out = np.zeros_like(x)
    for shift in (0, 23):
        b = (x >> U64(shift)) & _MASK23
        s = _GOLAY[0][(b & U64(4095)).astype(np.int64)] ^ _GOLAY[1][(b >> U64(12)).astype(np.int64)]
        out |= (b ^ _GOLAY_ERRORS[s.astype(np.int64)]) << U64(shift)
    b = (x >> U64(46)) & _MASK15
    s = _HAMMING[b.astype(np.int64)]
    out |= (b ^ np.where(s > 0, U64(1) << (np.maximum(s, U64(1)) - U64(1)), U64(0))) << U64(46)
    b = x >> U64(61)
    return out | np.where(np.array([0, 0, 0, 1, 0, 1, 1, 1], bool)[b.astype(np.int64)], U64(7) << U64(61), U64(0))


_FLIPS = np.concatenate([[U64(0)], U64(1) << np.arange(64, dtype=np.uint64)])


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint's anchors, as (index of the fingerprint, anchor), each once."""
    all_homes = np.sort(home((fp[:, None] ^ _FLIPS[None, :]).ravel()).reshape(-1, 65), axis=1)
    new = np.ones_like(all_homes, bool)
    new[:, 1:] = all_homes[:, 1:] != all_homes[:, :-1]
    return np.repeat(np.arange(len(fp)), new.sum(axis=1)), all_homes[new]


def _replicate(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for lo in range(0, len(fp), 8192):
            row, anchor = anchors(fp[lo : lo + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[lo : lo + 8192][row].view(np.int64))], ["anchor", "fp"])


def _around(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one crowded anchor, in time linear in its size.

    Fingerprints that share a word within 1 of each are within 2 of each other: those at the
    same word hang on the smallest of them. Every link within the threshold has such a word.
    """
    near = (fp[:, None] ^ _FLIPS[None, :]).ravel()
    who = np.repeat(fp, 65)
    order = np.lexsort((who, near))
    near, who = near[order], who[order]
    head = np.concatenate([[True], near[1:] != near[:-1]])
    least = who[np.maximum.accumulate(np.where(head, np.arange(len(near)), 0))]
    link = who != least
    return who[link], least[link]


CROWD = 256


def _links(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compare all fingerprints of each anchor; anchors come sorted."""
    cuts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.concatenate([cuts, [len(anchor)]]))
    us, vs = [], []
    for k in np.flatnonzero(sizes > CROWD):
        u, v = _around(fp[cuts[k] : cuts[k] + sizes[k]])
        us.append(u)
        vs.append(v)
    small = np.flatnonzero((sizes > 1) & (sizes <= CROWD))
    widest = int(sizes[small].max()) if len(small) else 1
    begin, size = cuts[small], sizes[small]
    for gap in range(1, widest):  # pairs of rows that stand ``gap`` apart within an anchor
        room = size > gap
        begin, size = begin[room], size[room]
        count = size - gap
        at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        a, b = fp[at], fp[at + gap]
        link = np.bitwise_count(a ^ b) <= THRESHOLD
        us.append(np.maximum(a[link], b[link]))
        vs.append(np.minimum(a[link], b[link]))
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def _thin(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components: each node and the smallest node that it reaches here."""
    if not len(u):
        return u, v
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    link = root != np.arange(len(nodes))
    return nodes[link], nodes[root[link]]


def _compare(batches):
    rest_a, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(a, f):
        u, v = _thin(*_links(a, f))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        a = np.concatenate([rest_a, batch.column("anchor").to_numpy()])
        f = np.concatenate([rest_f, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(a):
            continue
        cut = int(np.searchsorted(a, a[-1], "left"))  # the last anchor may go on
        if cut:
            yield out(a[:cut], f[:cut])
        rest_a, rest_f = a[cut:], f[cut:]
    if len(rest_a):
        yield out(rest_a, rest_f)


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(fp, *carry): the fingerprint of every text as a signed long; null text has no word."""
    rows = storage.texts_of(docs, *((c, "long") for c in carry), ("text", "string"))
    return rows.mapInArrow(_fingerprint, ", ".join(["fp long", *(f"`{c}` long" for c in carry)]))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints, thinned: the components are those of all links."""
    n = storage.shuffle_partitions(distinct)
    copies = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    return copies.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "u long, v long")


def _reach(classes: DataFrame) -> DataFrame:
    """(fp, first): for each distinct fingerprint, the least ``first`` of all that it reaches over links."""
    roots = storage.materialize(components(fingerprint_links(classes)).select(F.col("node").alias("fp"), "root"), "roots")
    linked = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return storage.skew_join(linked.select("fp", "root"), linked.groupBy("root").agg(F.min("first").alias("first")), "root").select("fp", "root", "first")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links. Texts without a word, null ones
    too, have fingerprint zero, which links like any other. Null ids get their group's
    component_id, null if it has no other id. Repeated rows stay. Other columns are not read.
    """
    prints = storage.materialize(fingerprints(docs), "fingerprints")
    classes = storage.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    reach = _reach(classes).select("fp", F.col("first").alias("component_id"))
    return storage.skew_join(prints, reach, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are: of each component of links, one row.

    It is the one with the smallest doc_id, null only if there is no other; of rows that share that id, the first in
    the files. Texts without a word are one component with all others of fingerprint zero.
    """
    rows, places = storage.placed(docs)
    prints = storage.materialize(fingerprints(rows, ("doc_id", *places)), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *places)
    classes = storage.materialize(prints.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    stay = _reach(classes).where("fp = root").select("first.*")
    return storage.pick(rows, stay, places)
