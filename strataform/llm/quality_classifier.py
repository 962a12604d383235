"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every token has a sparse random index vector made from its hash. A token's word vector is the
sum of its neighbours' index vectors over all documents that are not held out. A text is the mean and the
spread of its tokens' vectors, with a few shares of the text as a whole; a two-layer numpy
network gives a logit, and a temperature fitted on texts set aside makes it a probability.
Tokens that the model does not know stand as their shape (which kinds of characters, how long).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textarrays import U64, Texts, Words, mix, slices, texts, words

#: Bounds of the fit: labelled texts (whole ones) and bytes of them in all, bytes at a time, known tokens, passes.
FIT_TEXTS = 3000
FIT_BYTES = 64 << 20
FIT_PIECE = 1 << 20
KNOWN_TOKENS = 20_000
MIN_COUNT = 3
DIMENSIONS = 48
NONZERO = 6
REACH = 2
HIDDEN = 24
EPOCHS = 40
SEED = 7

_KINDS = np.zeros(256, np.uint8)  # bits: upper, lower or beyond ASCII, digit, symbol, other punctuation
_KINDS[65:91] = 1
_KINDS[97:123] = 2
_KINDS[128:] = 2
_KINDS[48:58] = 4
_KINDS[list(b"#*$%&|<>")] = 8
_KINDS[list(b"!?.,;:'\"-()[]{}/\\_+=@^~`")] = 16


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of known tokens
    vectors: np.ndarray  # one row per known token
    center: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float


def _tokens(column: pa.Array) -> tuple[Texts, Words, np.ndarray]:
    """Words and, for each, the hash of its shape."""
    t = texts(column)
    w = words(t)
    if not len(w.start):
        return t, w, np.zeros(0, np.uint64)
    kinds = np.zeros(len(w.start), np.uint64)
    step = 1 << 16
    for lo in range(0, len(w.start), step):  # white space is of no kind, so a word may be taken up to the next one
        s, e = w.start[lo : lo + step], w.end[lo : lo + step]
        kinds[lo : lo + step] = np.bitwise_or.reduceat(_KINDS[t.data[s[0] : e[-1]]], s - s[0])
    size = np.minimum(w.end - w.start, 15).astype(np.uint64) >> U64(2)
    return t, w, mix((kinds << U64(8)) + size + U64(1 << 40))


def _index_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary vectors that depend on the token's hash alone: places and signs of their entries."""
    h = np.stack([mix(keys + np.array([k * 2 + 1], np.uint64) * U64(0x9E3779B97F4A7C15)) for k in range(NONZERO)], axis=1)
    return (h % U64(DIMENSIONS)).astype(np.int64), np.where(h >> U64(63), 1, -1)


def _ids(keys: np.ndarray, w: Words, shape: np.ndarray) -> np.ndarray:
    """Each word's row among known tokens; -1 where neither it nor its shape is known."""
    if not len(keys):
        return np.full(len(w.start), -1)
    at = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
    miss = np.flatnonzero(keys[at] != w.hash)
    other = np.minimum(np.searchsorted(keys, shape[miss]), len(keys) - 1)
    at[miss] = np.where(keys[other] == shape[miss], other, -1)
    return at


def _shares(t: Texts, w: Words) -> np.ndarray:
    """Figures of each text as a whole: size, distinct words, symbols, upper case, digits."""
    n = np.diff(w.first)
    doc = w.doc()
    distinct = np.unique(mix(w.hash + mix(doc.astype(np.uint64) + U64(1))), return_index=True)[1] if len(doc) else doc
    kinds = _KINDS[t.data]
    size = np.maximum(np.diff(t.offsets), 1)

    def share(bit: int) -> np.ndarray:
        total = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum((kinds & bit) > 0, out=total[1:])
        return np.diff(total[t.offsets]) / size

    return np.stack([np.log1p(n), np.bincount(doc[distinct], minlength=len(n)) / np.maximum(n, 1), share(8), share(1), share(4), share(16)], axis=1)


def features(keys: np.ndarray, vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    t, w, shape = _tokens(column)
    rows = _ids(keys, w, shape)
    table = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])  # row -1: unknown
    mean = np.zeros((len(t), table.shape[1]))
    square = np.zeros_like(mean)
    count = np.diff(w.first)
    full = np.flatnonzero(count > 0)
    for lo in range(0, len(full), 128):
        part = full[lo : lo + 128]
        begin, stop = w.first[part[0]], w.first[part[-1] + 1]
        near = table[rows[begin:stop]]
        at = w.first[part] - begin
        mean[part] = np.add.reduceat(near, at, axis=0, dtype=np.float32)
        square[part] = np.add.reduceat(near * near, at, axis=0, dtype=np.float32)
    each = np.maximum(count, 1)[:, None]
    mean /= each
    return np.concatenate([mean, np.sqrt(np.maximum(square / each - mean * mean, 0)), _shares(t, w)], axis=1)


def _token_counts(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            _, w, shape = _tokens(part.column("text"))
            found, count = np.unique(w.hash, return_counts=True)
            shapes = np.unique(shape)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([found, shapes]).view(np.int64)),
                    pa.array(np.concatenate([count, np.zeros(len(shapes), np.int64)])),
                    pa.array(np.arange(len(found) + len(shapes)) >= len(found)),
                ],
                ["token", "n", "shape"],
            )


def neighbour_sums(keys: np.ndarray, places: np.ndarray, signs: np.ndarray, column: pa.Array) -> np.ndarray:
    """For each known token, the sum of its neighbours' index vectors in these texts, in whole numbers."""
    _, w, shape = _tokens(column)
    ids, doc = _ids(keys, w, shape), w.doc()
    out = np.zeros(len(keys) * DIMENSIONS, np.int64)
    for gap in range(1, REACH + 1):
        a, b = ids[:-gap], ids[gap:]
        ok = (a >= 0) & (b >= 0) & (doc[:-gap] == doc[gap:])
        a, b = a[ok], b[ok]
        for own, other, turn in ((a, b, 0), (b, a, gap)):  # the left side has its own order
            at = own[:, None] * DIMENSIONS + (places[other] + turn) % DIMENSIONS
            out += np.bincount(at.ravel(), signs[other].ravel(), len(out)).astype(np.int64)
    return out.reshape(len(keys), DIMENSIONS)


_SUMS = [f"v{k}" for k in range(DIMENSIONS)]


def _neighbours(box):
    def run(batches):
        keys, places, signs = box.value
        total = np.zeros((len(keys), DIMENSIONS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += neighbour_sums(keys, places, signs, part.column("text"))
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(total[some, k]) for k in range(DIMENSIONS))], ["token", *_SUMS])

    return run


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Known tokens' sorted hashes, and the word vector of each, over all rows of ``docs``.

    The KNOWN_TOKENS most frequent words are known, and every shape. Sums are of whole
    numbers, so they don't depend on how rows are dealt. Tasks send one row per token at most.
    """
    text = docs.select("text").where("text is not null")
    counts = storage.materialize(text.mapInArrow(_token_counts, "token long, n long, shape boolean").groupBy("token", "shape").agg(F.sum("n").alias("n")), "tokens")
    known = counts.where(~F.col("shape") & (F.col("n") >= MIN_COUNT)).orderBy(F.desc("n"), "token").limit(KNOWN_TOKENS)
    found = known.select("token").unionByName(counts.where("shape").select("token")).toPandas()["token"]
    keys = np.unique(found.to_numpy(np.int64).view(np.uint64))
    out = np.zeros((len(keys), DIMENSIONS))
    if len(keys):
        box = docs.sparkSession.sparkContext.broadcast((keys, *_index_places(keys)))
        rows = text.mapInArrow(_neighbours(box), ", ".join(["token int", *(f"{c} long" for c in _SUMS)]))
        sums = rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in _SUMS]).toPandas()
        out[sums["token"].to_numpy(int)] = sums[_SUMS].to_numpy(float)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return keys, (out / np.maximum(size, 1e-9)).astype(np.float32)


def _logit(layers, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _network(x: np.ndarray, y: np.ndarray, rng: np.random.Generator):
    """Two layers by Adam on the log loss, with small weight decay."""
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            i = order[lo : lo + 64]
            h = np.tanh(x[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[i]) / len(i)
            back = d[:, None] * p[2][None, :] * (1 - h * h)
            grads = [x[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def fit(rows: pd.DataFrame, keys: np.ndarray, vectors: np.ndarray) -> Model:
    """Learn from a bounded table (text, quality), some ``FIT_PIECE`` bytes at a time, and word vectors."""
    batch = pa.RecordBatch.from_arrays([pa.array(rows["text"].tolist(), pa.string())], ["text"])
    parts = [features(keys, vectors, part.column("text")) for part in slices(batch, "text", FIT_PIECE)]
    x, y = np.concatenate(parts or [features(keys, vectors, batch.column("text"))]), rows["quality"].to_numpy(float)
    center, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    x = np.clip((x - center) / scale, -6, 6)
    if len(x) < 10 or len(np.unique(y)) < 2:  # nothing to tell apart: the share of good labels
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Model(keys, vectors, center, scale, (np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share)))), 1.0)
    rng = np.random.default_rng(SEED)
    aside = rng.random(len(x)) < 0.2
    layers = _network(x[~aside], y[~aside], rng)
    z = _logit(layers, x[aside])
    grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    temperature = float(min(grid, key=lambda t: _loss(z / t, y[aside]))) if aside.any() else 1.0
    return Model(keys, vectors, center, scale, layers, temperature)


def predict(model: Model, column: pa.Array) -> np.ndarray:
    x = np.clip((features(model.keys, model.vectors, column) - model.center) / model.scale, -6, 6)
    return 1 / (1 + np.exp(-np.clip(_logit(model.layers, x) / model.temperature, -40, 40)))


def held_out_column():
    """The query's held-out rows: crc32(doc_id as text) mod 3 is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, held_out, most: int = FIT_TEXTS, most_bytes: int = FIT_BYTES) -> pd.DataFrame:
    """(text, quality): whole texts of the labelled rows that are not held out with the smallest id hashes.

    ``most`` rows in all; texts that would bring them over ``most_bytes`` are passed over.
    The rows are chosen by hashes and sizes before any text is fetched. Of labels that repeat an id the
    lowest counts, and of its documents one, the text with the smallest hash.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out)
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # ``most`` rows of ids and labels are broadcast
    text = text.withColumn("mark", F.xxhash64("text"))
    sizes = text.groupBy("doc_id").agg(F.min(F.struct("mark", F.octet_length("text").alias("size"))).alias("one"))
    sizes = sizes.select("doc_id", "one.*").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()  # ``most`` rows at most
    fits, total = [], 0
    for doc_id, mark, size in zip(sizes["doc_id"], sizes["mark"], sizes["size"], strict=True):
        if total + size <= most_bytes:
            fits.append((int(doc_id), int(mark)))
            total += size
    wanted = docs.sparkSession.createDataFrame(fits, "doc_id long, mark long")
    rows = text.join(F.broadcast(wanted), ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.max("text").alias("text"), F.max("quality").alias("quality")).toPandas()
    return rows.sort_values(["doc_id", "text"])[["text", "quality"]]


def train(docs: DataFrame, labels: DataFrame, held_out=None, most: int = FIT_TEXTS) -> Model:
    """Word vectors from all documents that are not held out; the network from ``training_rows``."""
    held_out = held_out_column() if held_out is None else held_out
    return fit(training_rows(docs, labels, held_out, most), *word_vectors(docs.where(~held_out)))


def _score(box):
    def run(batches):
        model = box.value
        for batch in batches:
            for part in slices(batch, "text"):
                score = predict(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Null and empty texts are scored as texts without a token. Rows that repeat an id are scored
    on their own. Labels without a document, and null labels, are not used; with too few or
    only one kind of label every score is that label's share (0.5 without any). Other
    columns are not read. The model is broadcast: it holds KNOWN_TOKENS tokens and their shapes at most.
    """
    docs = storage.texts_of(docs, ("doc_id", "long"), ("text", "string"))
    box = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))
    return docs.select("doc_id", "text", held_out_column().alias("held_out")).mapInArrow(_score(box), "doc_id long, held_out boolean, score double, predicted int")
