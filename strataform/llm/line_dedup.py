"""Line dedup: a segment-partition edit join over distinct lines.

Lines within ``EDITS`` edits (insert, delete, replace a character) link. A line of length l is
cut into EDITS + 1 segments; any linked line holds one of them unchanged, at a place that the
edits around it allow. So every line is indexed by its segments and probes the
indexes of lines of its own length and of up to EDITS less by the substrings at those places.
Lines that meet are verified with a banded bit-parallel edit distance, many pairs at once.

Equal lines are one line throughout. Every key carries its line's character counts (16 classes,
modulo 16): an edit moves them by two at most, so pairs further apart are no links and are not sent on.
Lines under a key that more than ``CROWD`` lines share are cut again, finer: of EDITS + 2 segments a linked
line holds two, of EDITS + 3 three, and keys are made of these. Only lines alike in three of five segments,
or too short to be cut so (under 5 characters), are dealt into pairs of blocks of ``CROWD`` lines and verified there.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textarrays import U64, WORD_BYTE, mix, place_hash, slices, span_strings, texts, words

EDITS = 2
#: Shorter lines, of no more characters than edits, are compared for equality only: any two of them would link.
MIN_CHARS = EDITS + 1
CROWD = 1024
#: Rounds of keys: in round n, lines of crowded keys are told apart by n unchanged segments out of EDITS + n.
ROUNDS = 3
#: Up to so many candidate lines (8 bytes each) are broadcast to fetch their texts; more by a shuffle.
BROADCAST_LINES = 1_000_000
PACK_BYTES = 8 << 20

_LINE_BYTE = np.ones(256, bool)
_LINE_BYTE[0x0A] = False


def _line_rows(column: pa.Array):
    """Lines with a word: (text's index, number of the line in its text, start, end, hash), and the texts."""
    t = texts(column)
    raw = words(t, _LINE_BYTE)
    gaps = np.flatnonzero(t.data == 0x0A)
    doc = raw.doc()
    number = np.searchsorted(gaps, raw.start) - np.searchsorted(gaps, t.offsets[:-1])[doc]
    solid = np.concatenate([[0], np.cumsum(WORD_BYTE[t.data])])
    some = solid[raw.end] > solid[raw.start]
    return t, doc[some], number[some], raw.start[some], raw.end[some], raw.hash[some]


def _occurrences(carry: tuple[str, ...]):
    """A row per line, and one without a line for each text that has none; ``row`` numbers the texts."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                _, doc, number, _, _, h = _line_rows(part.column("text"))
                none = np.flatnonzero(np.bincount(doc, minlength=part.num_rows) == 0)
                owner = np.concatenate([doc, none])
                is_none = np.arange(len(owner)) >= len(doc)
                line = np.concatenate([h.view(np.int64), np.zeros(len(none), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + owner), pa.array(np.concatenate([number, np.zeros(len(none), np.int64)]), pa.int32()), pa.array(line, mask=is_none), *(part.column(c).take(pa.array(owner)) for c in ("doc_id", *carry))],
                    ["row", "line_no", "line", "doc_id", *carry],
                )
                row += part.num_rows

    return run


def _line_texts(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            t, _, _, start, end, h = _line_rows(part.column("text"))
            _, one = np.unique(h, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), span_strings(t, start[one], end[one])], ["line", "text"])


def _segment(length: np.ndarray, i: int, edits: int, same: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of ``edits + same`` of lines of these lengths; the last ones are longer by one."""
    base, longer = length // (edits + same), length % (edits + same)
    short = edits + same - longer
    return i * base + np.maximum(i - short, 0), base + (i >= short)


def _gaps(chosen: tuple[int, ...], segments: int) -> list[int]:
    """How many segments stand before, between and after those chosen."""
    return [b - a - 1 for a, b in zip((-1, *chosen), (*chosen, segments), strict=True)]


def line_keys(points: np.ndarray, first: np.ndarray, edits: int = EDITS, same: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Index keys (even) and probe keys (odd) of lines given as code points, with each key's line.

    Of ``edits + same`` segments of a line, every linked line holds some ``same`` unchanged, and one can choose them
    so that no gap around them has more edits than segments. A key is the text of ``same`` segments, which ones they
    are and the length of the line cut. Bit 1 marks lines too short to be cut into one segment more.
    """
    length = np.diff(first)
    segments = edits + same
    begin, size = [[] for _ in range(same)], [[] for _ in range(same)]
    owner, salt, marks = [], [], []
    for less in range(edits + 1):
        who = np.flatnonzero(length - less >= segments)
        cut, start = length[who] - less, first[who]
        spans = [_segment(cut, i, edits, same) for i in range(segments)]
        short = (cut <= segments).astype(np.uint64) << U64(1)
        for which, chosen in enumerate(combinations(range(segments), same)):
            of = cut.astype(np.uint64) * U64(64) + U64(which)
            shifts = [s for s in product(*(range(-g, g + 1) for g in _gaps(chosen, segments))) if sum(s) == less]
            for probe, grown in ([] if less else [(0, (0,) * same)]) + [(1, s) for s in shifts]:
                shift = 0
                for j, i in enumerate(chosen):
                    shift += grown[j]
                    begin[j].append(start + spans[i][0] + shift)
                    size[j].append(spans[i][1])
                owner.append(who)
                salt.append(of)
                marks.append(short | U64(probe))
    h = None
    for at, n in zip(begin, size, strict=True):
        at = np.concatenate(at)
        one = place_hash(points, at, at + np.concatenate(n))
        h = one if h is None else mix(h) + one
    key = mix(h ^ mix(np.concatenate(salt)))
    return (key & ~U64(3)) | np.concatenate(marks), np.concatenate(owner)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t = texts(column)
    points = np.frombuffer(t.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    return points, lead[t.offsets]


def signatures(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of each line's code points in 16 classes, modulo 16, four bits each."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    kind = ((points * np.uint32(2654435761)) >> np.uint32(28)).astype(np.int64)
    counts = np.bincount(owner * 16 + kind, minlength=16 * n).reshape(n, 16).astype(np.uint64) & U64(15)
    return np.bitwise_or.reduce(counts << (np.arange(16, dtype=np.uint64) * U64(4)), axis=1)


_LANES = U64(0x0F0F0F0F0F0F0F0F)
_ONES = U64(0x0101010101010101)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of how far the character counts behind two signatures differ."""
    total = np.zeros(np.broadcast(a, b).shape, np.uint64)
    for shift in (U64(0), U64(4)):
        d = (((a >> shift) & _LANES) + U64(16) * _ONES - ((b >> shift) & _LANES)) & _LANES
        far = (d >> U64(3)) & _ONES  # 8 and more: the shorter way round is 16 - d
        total += (((d ^ (far * U64(15))) + far) * _ONES) >> U64(56)
    return total


def _pack(buckets: int, edits: int, least: int, same: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                t, _, _, start, end, h = _line_rows(part.column("text"))
                _, one = np.unique(h, return_index=True)
                points, first = _points(span_strings(t, start[one], end[one]))
                long = np.flatnonzero(np.diff(first) >= least)
                if not len(long):
                    continue
                size = np.diff(first)[long]
                flat = np.concatenate([[0], np.cumsum(size)])
                points = points[np.arange(flat[-1]) + np.repeat(first[long] - flat[:-1], size)]
                key, owner = line_keys(points, flat, edits, same)
                line, mark = h[one][long][owner], signatures(points, flat)[owner]
                bucket = (((key >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts) > 0)
                key, line, mark = key[order], line[order], mark[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([key[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                        pa.array([line[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                        pa.array([mark[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                    ],
                    ["bucket", "keys", "lines", "marks"],
                )

    return run


_MEETS = pa.schema([("grp", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _pairs(line: np.ndarray, mark: np.ndarray, cut: np.ndarray, indexed: np.ndarray, probing: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an index row and a probe row of one key whose character counts are near enough."""
    lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = np.cumsum(indexed * probing)
    lo = 0
    while lo < len(cut):  # about two million pairs at a time
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (2 << 20), "right")))
        n, m, at = indexed[lo:hi], probing[lo:hi], cut[lo:hi]
        count = n * m
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wide = np.repeat(m, count)
        a = np.repeat(at, count) + nth // wide
        b = np.repeat(at + n, count) + nth % wide
        near = (line[a] != line[b]) & (apart(mark[a], mark[b]) <= U64(2 * edits))
        a, b = line[a[near]], line[b[near]]
        lows.append(np.minimum(a, b))
        highs.append(np.maximum(a, b))
        lo = hi
    low, high = np.concatenate(lows), np.concatenate(highs)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    once = np.ones(len(low), bool)
    once[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[once], high[once]


def _meet(edits: int, crowd: int, last: bool):
    """Lines of one bucket that share a key: pairs (a, b), and the lines of crowded keys.

    The latter go on alone (a), for the next round of keys; from the last round, or if too short for it, with their key and its blocks.
    """

    def run(key, packs):
        k, line, mark = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in packs.column(c)]) for c, kind in (("keys", np.uint64), ("lines", np.int64), ("marks", np.uint64)))
        order = np.lexsort((line, k))
        k, line, mark = k[order], line[order], mark[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (line[1:] != line[:-1])])
        k, line, mark = k[new], line[new], mark[new]
        name = k >> U64(1)
        cut = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.concatenate([cut, [len(k)]]))
        indexed = np.add.reduceat((k & U64(1)) == 0, cut).astype(np.int64)
        probing = size - indexed
        live = (indexed > 0) & (probing > 0)
        crowded = live & (np.maximum(indexed, probing) > crowd)
        few = np.flatnonzero(live & ~crowded)
        low, high = _pairs(line, mark, cut[few], indexed[few], probing[few], edits)
        none = pa.nulls(len(low), pa.int32())
        out = [pa.table([pa.nulls(len(low), pa.int64()), none, none, pa.array(low), pa.array(high)], schema=_MEETS)]
        onward = [np.zeros(0, np.int64)]
        for g in np.flatnonzero(crowded):
            members = np.unique(line[cut[g] : cut[g] + size[g]])
            if not last and not name[cut[g]] & U64(1):
                onward.append(members)
                continue
            n, blocks = len(members), -(-len(members) // crowd)
            grp = np.full(n, name[cut[g]]).view(np.int64)
            out.append(pa.table([pa.array(grp), pa.array(np.arange(n) * blocks // n, pa.int32()), pa.array(np.full(n, blocks), pa.int32()), pa.array(members), pa.nulls(n, pa.int64())], schema=_MEETS))
        alone = np.unique(np.concatenate(onward))
        none = pa.nulls(len(alone), pa.int32())
        out.append(pa.table([pa.nulls(len(alone), pa.int64()), none, none, pa.array(alone), pa.nulls(len(alone), pa.int64())], schema=_MEETS))
        return pa.concat_tables(out)

    return run


def within(a: list[str], b: list[str], edits: int = EDITS) -> np.ndarray:
    """Whether each pair of strings is within ``edits``: banded bit-parallel edit distance over all pairs.

    Bit r of a column's vectors is the row edits + r - width + 1 below the diagonal, so the band moves with it.
    """
    n = len(a)
    out = np.zeros(n, bool)
    if not n:
        return out
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    tall = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    s, t = np.array([len(x) for x in short]), np.array([len(x) for x in tall])
    tiny = s <= edits
    for i in np.flatnonzero(tiny):
        out[i] = _plain(short[i], tall[i]) <= edits
    live = np.flatnonzero((t - s <= edits) & ~tiny)
    live = live[np.argsort(t[live], kind="stable")]
    lo = 0
    while lo < len(live):  # longest last: up to 2048 pairs of about 2**19 characters in all
        hi = lo + max(1, min(2048, (1 << 19) // (int(t[live[lo]]) + 1)))
        if hi < len(live) and t[live[hi - 1]] > 2 * t[live[lo]] + 64:
            hi = lo + int(np.searchsorted(t[live[lo:hi]], 2 * t[live[lo]] + 64, "right"))
        rows = live[lo:hi]
        lo = hi
        out[rows] = _band([short[i] for i in rows], [tall[i] for i in rows], s[rows], t[rows], edits)
    return out


def _matrix(rows: list[str], width: int, before: int, after: int, fill: int) -> np.ndarray:
    m = np.full((width + before + after, len(rows)), fill, np.uint32)
    for i, x in enumerate(rows):
        m[before : before + len(x), i] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return m


def _band(short: list[str], tall: list[str], s: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    """The pattern is the shorter string: rows; the taller one is read a character a step."""
    width = 2 * k + 2  # bits: pattern places step - k - 1 to step + k
    full, top = U64((1 << width) - 1), U64(1 << (width - 1))
    pattern = _matrix(short, int(t.max()), k + 1, 2 * k + 2, 0xFFFFFFFF)
    text = _matrix(tall, int(t.max()), 0, 0, 0xFFFFFFFE)
    n = len(short)
    vp = np.full(n, int(full) & ~((1 << (k + 1)) - 1), np.uint64)
    vn = np.zeros(n, np.uint64)
    score = np.full(n, k, np.int64)
    edge = np.full(n, int(top) >> 1, np.uint64)
    for j in range(int(t.max())):
        x = np.zeros(n, np.uint64)
        for r in range(width):
            x |= (pattern[j + r] == text[j]).astype(np.uint64) << U64(r)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        slanted = j < s - k
        flat = ~slanted & (j < t)
        score += slanted & ((d0 & top) == 0)
        score += flat & ((hp & edge) != 0)
        score -= flat & ((hn & edge) != 0)
        edge = np.where(flat, edge >> U64(1), edge)
        vp = (hn | ~((d0 >> U64(1)) | hp)) & full
        vn = (d0 >> U64(1)) & hp
    return score <= k


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _verify(edits: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                good = pa.array(within(part.column("a_text").to_pylist(), part.column("b_text").to_pylist(), edits))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], ["a", "b"])

    return run


def _verify_blocks(edits: int):
    def run(key, rows):
        rows = rows.sort_by("a")
        line, block, column = rows.column("a").to_numpy(), rows.column("block").to_numpy(), rows.column("text")
        two = len(np.unique(block)) > 1  # pairs within a block are met where it stands alone
        text = column.to_pylist()
        mark = signatures(*_points(column))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(line), 256):
            i, j = np.nonzero(apart(mark[lo : lo + 256, None], mark[None, :]) <= U64(2 * edits))
            i += lo
            fresh = (i < j) & ((block[i] != block[j]) | (not two))
            i, j = i[fresh], j[fresh]
            good = within([text[x] for x in i], [text[x] for x in j], edits)
            us.append(line[i[good]])
            vs.append(line[j[good]])
        return pa.table([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["a", "b"])

    return run


def _round(texts: DataFrame, buckets: int, same: int, last: bool, edits: int, min_chars: int, crowd: int) -> DataFrame:
    packs = texts.select("text").mapInArrow(_pack(buckets, edits, min_chars, same), "bucket int, keys binary, lines binary, marks binary")
    met = packs.groupBy("bucket").applyInArrow(_meet(edits, crowd, last), "grp long, block int, blocks int, a long, b long")
    return storage.materialize(met.withColumn("round", F.lit(same)), "meets")


def line_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, crowd: int = CROWD, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): all pairs a < b of distinct lines (by hash) within ``edits``, of ``min_chars`` characters or more."""
    if min_chars <= edits:
        raise ValueError("lines must be longer than the edits allowed")
    met = _round(docs, storage.parts(docs, PACK_BYTES), 1, rounds == 1, edits, min_chars, crowd)
    wanted = storage.materialize(met.select(F.explode(F.array("a", "b")).alias("line")).where("line is not null").distinct(), "candidates")
    few = wanted.count() <= BROADCAST_LINES
    lines = docs.select("text").mapInArrow(_line_texts, "line long, text string")
    found = lines.join(F.broadcast(wanted) if few else wanted, "line", "left_semi").groupBy("line").agg(F.max("text").alias("text"))
    found = storage.materialize(found, "line-texts")
    every = met
    for same in range(2, rounds + 1):
        onward = met.where("grp is null and b is null").select(F.col("a").alias("line")).distinct()
        if onward.isEmpty():
            break
        texts_left = storage.materialize(found.join(onward, "line", "left_semi"), "crowded-lines")
        met = _round(texts_left, storage.parts(texts_left, PACK_BYTES // same), same, same == rounds, edits, min_chars, crowd)
        every = every.unionByName(met)
    pairs, crowds = every.where("b is not null").select("a", "b").distinct(), every.where("grp is not null").drop("b")
    a = found.select(F.col("line").alias("a"), F.col("text").alias("a_text"))
    b = found.select(F.col("line").alias("b"), F.col("text").alias("b_text"))
    close = pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(_verify(edits), "a long, b long")
    members = crowds.join(a.withColumnRenamed("a_text", "text"), "a").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = members.select("round", "grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "a", "text")
    dense = blocks.groupBy("round", "grp", "low", "high").applyInArrow(_verify_blocks(edits), "a long, b long")
    return close.unionByName(dense).distinct()


def _verdicts(docs: DataFrame, carry: tuple[str, ...], edits: int, min_chars: int) -> DataFrame:
    """The result of ``line_dedup`` with the columns ``carry`` (longs) of ``docs``."""
    docs = storage.texts_of(docs, ("doc_id", "long"), ("text", "string"), keep=carry)
    schema = ", ".join(["row long, line_no int, line long, doc_id long", *(f"`{c}` long" for c in carry)])
    every = storage.materialize(docs.mapInArrow(_occurrences(carry), schema), "lines")
    held = every.where("line is not null")
    place = F.struct("doc_id", "row", "line_no")
    classes = storage.materialize(held.groupBy("line").agg(F.min(place).alias("first")), "line-classes")
    links = storage.materialize(line_links(docs, edits, min_chars), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    firsts = both.join(classes.select(F.col("line").alias("b"), F.col("first").alias("other")), "b")
    near = firsts.groupBy("a").agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("links")).withColumnRenamed("a", "line")
    verdict = classes.join(near, "line", "left").select("line", "first", F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("near_earlier"), F.coalesce("links", F.lit(0)).alias("links"))
    judged = storage.skew_join(held, verdict, "line").withColumn("goes", F.col("near_earlier") | (place != F.col("first")))
    per = judged.groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", *carry)),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("goes").alias("n_removed"),
        F.sum("links").cast("long").alias("n_links"),
        F.array_sort(F.collect_list(F.when(F.col("goes"), F.col("line_no")))).alias("removed"),
    )
    figures = ["n_lines", "n_removed", "n_links"]
    none = every.where("line is null").select("doc_id", *carry, *(F.lit(0).cast("long").alias(c) for c in figures), F.array().cast("array<int>").alias("removed"))
    return per.select("doc_id", *carry, *figures, "removed").unionByName(none)


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, removed), one row per row of ``docs``.

    Lines are the parts between line feeds that hold a word. A line goes if an equal line, or one
    that links to it, stands earlier: in a smaller doc_id, or before it in the same document.
    Lines are judged on the input. ``removed`` lists their numbers from 0; ``n_links`` sums,
    over the document's lines, the distinct lines that link to each. Null and empty
    texts have no line. Lines under ``min_chars`` characters (1 or 2 by default) link to none and go
    by equality only. Null ids come first; rows that repeat an id are documents of their own, in the order in
    which they are read. Other columns are not read.
    """
    return _verdicts(docs, (), edits, min_chars)


def remaining_text(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines that ``line_dedup`` removes taken out of ``text``, row by row; null texts stay null."""
    rows, places = storage.placed(docs)
    gone = storage.fresh(rows, "removed_")
    verdicts = _verdicts(rows, tuple(places), edits, min_chars).where("n_removed > 0").select(*places, F.col("removed").alias(gone))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    return rows.join(verdicts, places, "left").withColumn("text", text).select(*(F.col(f"`{c}`") for c in docs.columns))
