"""Language identification: known words first, then shorter and shorter character n-grams.

A model holds, per language, smoothed log frequencies of words and of character n-grams of
lengths ``MAX_GRAM`` down to 1, learned from labelled texts. A known word scores by its own log
frequencies. An unseen word scores by the mean of its known n-grams of the greatest length of
which the model knows any. A text's language has the greatest sum over its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textarrays import LETTER_BYTE, Texts, mix, slices, span_strings, texts, words

MAX_GRAM = 4
#: Bounds of the fit: labelled texts (whole ones) and bytes of them in all, and known words and n-grams.
FIT_TEXTS = 4000
FIT_BYTES = 64 << 20
KNOWN_WORDS = 50_000
KNOWN_GRAMS = 100_000
MIN_COUNT = 3
#: The fit takes so many characters, or distinct words, at a time; results don't depend on it.
FIT_PIECE = 1 << 20
FIT_WORDS = 50_000
UNDETERMINED = "und"
#: Texts count as this many independent words at most when the score is made.
EVIDENCE = 20.0


@dataclass
class Model:
    """Sorted 64-bit hashes of words and of n-grams, with a row of log frequencies for each."""

    languages: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    grams: list[np.ndarray]
    gram_scores: list[np.ndarray]


def letter_words(column: pa.Array) -> tuple[Texts, object]:
    """The lower-case text and its letter runs; bytes of characters beyond ASCII count as letters."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    t = texts(pc.utf8_lower(column))
    return t, words(t, LETTER_BYTE)


def _grams(t: Texts, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-grams of code points of padded words, and each one's word."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.cumsum(size + 2)
    flat = np.full(int(total[-1]), 0x20, np.uint8)  # a space before and after each word
    inside = np.ones(len(flat), bool)
    inside[total - 1] = False
    inside[np.concatenate([[0], total[:-1]])] = False
    body = np.repeat(start - (total - size - 1), size)
    at = np.flatnonzero(inside)
    flat[at] = t.data[at + body]
    points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    gaps = np.flatnonzero(points == 0x20)
    owner = np.repeat(np.arange(len(size)), gaps[1::2] - gaps[::2] + 1)
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(len(points) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix((h + points[k : len(points) - n + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    same = owner[: len(points) - n + 1] == owner[n - 1 :]
    if n == 1:
        same &= points != 0x20
    return h[same], owner[: len(points) - n + 1][same]


def _count(h: np.ndarray, label: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and how often each stands in every language."""
    keys, inverse = np.unique(h, return_inverse=True)
    return keys, np.bincount(inverse * languages + label, minlength=len(keys) * languages).reshape(len(keys), languages)


def _table(pieces: list[tuple[np.ndarray, np.ndarray]], most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Known entries (the most frequent, ties by hash) and their smoothed log frequencies by language."""
    every, part = (np.concatenate(x) for x in zip(*pieces, strict=True))
    keys, inverse = np.unique(every, return_inverse=True)
    counts = np.zeros((len(keys), part.shape[1]))
    np.add.at(counts, inverse, part)
    total = counts.sum(axis=1)
    order = np.lexsort((keys, -total))[:most]
    order = np.sort(order[total[order] >= least])
    size = counts.sum(axis=0, keepdims=True)
    scores = np.log((counts[order] + 0.1) / (size + 0.1 * (len(order) + 1)))
    return keys[order], scores.astype(np.float32)


def fit(rows: pd.DataFrame) -> Model:
    """Learn from a bounded table (text, lang), some ``FIT_PIECE`` characters at a time."""
    languages = sorted(rows["lang"].unique())
    n = len(languages)
    label = np.searchsorted(np.array(languages, object), rows["lang"].to_numpy(object)) if n else np.zeros(0, int)
    piece = rows["text"].str.len().cumsum().to_numpy(np.int64) // FIT_PIECE if len(rows) else np.zeros(0, int)
    counts, keys, spelled, spoken = [(np.zeros(0, np.uint64), np.zeros((0, n)))], [np.zeros(0, np.uint64)], [pa.array([], pa.string())], [np.zeros(0, int)]
    for k in np.unique(piece):
        here = piece == k
        t, w = letter_words(pa.array(rows["text"][here].tolist(), pa.string()))
        if not len(w.start):
            continue
        by_word = label[here][w.doc()]
        counts.append(_count(w.hash, by_word, n))
        found, one = np.unique(w.hash, return_index=True)
        keys.append(found)
        spelled.append(span_strings(t, w.start[one], w.end[one]))
        spoken.append(by_word[one])
    known, scores = _table(counts, KNOWN_WORDS, MIN_COUNT)
    _, one = np.unique(np.concatenate(keys), return_index=True)  # n-grams count per distinct word, as unseen words are rare ones
    t = texts(pa.concat_arrays(spelled).take(pa.array(one)))
    by_word = np.concatenate(spoken)[one]
    grams, gram_scores = [], []
    for size in range(MAX_GRAM, 0, -1):
        counts = [(np.zeros(0, np.uint64), np.zeros((0, n)))]
        for lo in range(0, len(t), FIT_WORDS):
            h, owner = _grams(t, t.offsets[:-1][lo : lo + FIT_WORDS], t.offsets[1:][lo : lo + FIT_WORDS], size)
            counts.append(_count(h, by_word[lo:][owner], n))
        found, s = _table(counts, KNOWN_GRAMS, MIN_COUNT)
        grams.append(found)
        gram_scores.append(s)
    return Model(languages, known, scores, grams, gram_scores)


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def word_scores(model: Model, t: Texts, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of log scores for each distinct word."""
    out = np.zeros((len(h), len(model.languages)), np.float32)
    at, known = _find(model.words, h)
    out[known] = model.word_scores[at[known]]
    left = np.flatnonzero(~known)
    for n, keys, scores in zip(range(MAX_GRAM, 0, -1), model.grams, model.gram_scores, strict=True):
        if not len(left):
            break
        g, owner = _grams(t, start[left], end[left], n)
        at, known = _find(keys, g)
        owner, at = owner[known], at[known]
        count = np.bincount(owner, minlength=len(left))
        hit = count > 0
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[left[hit]] = np.add.reduceat(scores[at], first, axis=0) / count[hit, None]
        left = left[~hit]
    return out


def predict(model: Model, column: pa.Array, has_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 where a text has no letter."""
    if not model.languages:
        return [UNDETERMINED] * len(column), np.zeros(len(column))
    t, w = letter_words(column)
    unique, one, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    scores = word_scores(model, t, unique, w.start[one], w.end[one])
    sums = np.zeros((len(t), len(model.languages)))
    count = np.diff(w.first)
    full = np.flatnonzero(count > 0)
    for lo in range(0, len(full), 512):  # so that the rows of many words are never all gathered
        part = full[lo : lo + 512]
        begin, stop = w.first[part[0]], w.first[part[-1] + 1]
        sums[part] = np.add.reduceat(scores[inverse[begin:stop]], w.first[part] - begin, axis=0, dtype=np.float64)
    mean = sums / np.maximum(count, 1)[:, None] * np.minimum(np.maximum(count, 1), EVIDENCE)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    langs = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)]
    return langs, np.where(has_letter, p[np.arange(len(p)), best], 0.0)


def sample_quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many rows each language gives: equal shares of ``most``, one at least; what a rare one leaves goes to the others."""
    quotas, left = {}, most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        quotas[lang] = min(n, max(1, left // (len(counts) - k)))
        left -= quotas[lang]
    return quotas


def training_sample(docs: DataFrame, held_out, most: int = FIT_TEXTS, most_bytes: int = FIT_BYTES) -> pd.DataFrame:
    """(text, lang): of each language, the labelled rows that are not held out with the smallest hashes of id and text.

    ``most`` rows in all (one a language at least), whole texts; those that would bring them over
    ``most_bytes`` are passed over. Equal rows count once. The rule is the same at every size: the bound on hashes by which most
    rows are dropped early is raised until each language has its number.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out).select("text", "lang", F.xxhash64("doc_id", "text").alias("mark"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    quotas = sample_quotas(counts, most)
    wide = {lang: (q + 10 * q**0.5 + 50) / counts[lang] for lang, q in quotas.items()}
    while True:
        bounds = [(lang, min((1 << 63) - 1, int(rate * 2**64) - (1 << 63))) for lang, rate in wide.items()]
        near = usable.join(F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang").where("mark <= bound")
        found = near.groupBy("lang", "mark").agg(F.max(F.octet_length("text")).alias("size")).toPandas()
        have = found["lang"].value_counts()
        short = [lang for lang, q in quotas.items() if wide[lang] < 1 and have.get(lang, 0) < q]
        if not short:
            break
        wide |= {lang: 4 * wide[lang] for lang in short}
    found = found.sort_values(["lang", "mark"])
    found["rank"] = found.groupby("lang").cumcount()
    found = found[found["rank"] < found["lang"].map(quotas)].sort_values(["rank", "mark"])
    chosen, total = [], 0
    for lang, mark, size in zip(found["lang"], found["mark"], found["size"], strict=True):
        if total + size <= most_bytes:
            chosen.append((lang, int(mark)))
            total += size
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, mark long")
    rows = usable.join(F.broadcast(wanted), ["lang", "mark"]).groupBy("lang", "mark").agg(F.max("text").alias("text")).toPandas()
    return rows.sort_values(["lang", "mark"])[["text", "lang"]]


def held_out_column():
    """The query's held-out rows: crc32(doc_id as text) mod 4 is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, held_out=None, most: int = FIT_TEXTS) -> Model:
    held_out = held_out_column() if held_out is None else held_out
    return fit(training_sample(docs, held_out, most))


def _score(model_box):
    def run(batches):
        model = model_box.value
        for batch in batches:
            for part in slices(batch, "text"):
                letters = part.column("has_letter").to_numpy(zero_copy_only=False)
                langs, score = predict(model, part.column("text"), letters)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _accept(model_box, width: int, least: float):
    def run(batches):
        model = model_box.value
        for batch in batches:
            names = batch.schema.names
            plain = pa.RecordBatch.from_arrays(batch.columns, [f"c{k}" for k in range(len(names))])
            for part in slices(plain, f"c{width}"):
                langs, score = predict(model, part.column(width), part.column(width + 1).to_numpy(zero_copy_only=False))
                good = pa.array((score >= least) & (np.array(langs, object) != UNDETERMINED))
                yield pa.RecordBatch.from_arrays([c.filter(good) for c in part.columns[:width]], names[:width])

    return run


def _has_letter():
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def _model_box(docs: DataFrame, model: Model | None):
    if model is None:
        model = train(storage.texts_of(docs, ("doc_id", "long"), ("text", "string"), ("lang", "string")))
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    Without a model, one is learned from the rows that are not held out. Null texts and those
    without a letter are ``und`` with score 0; so is every text if nothing can be learned.
    Rows that repeat an id are scored on their own. Other columns than doc_id, text and lang
    are not read. The model is broadcast: it holds KNOWN_WORDS words and KNOWN_GRAMS
    n-grams of each length at most, whatever the input.
    """
    box = _model_box(docs, model)
    rows = storage.texts_of(docs, ("doc_id", "long"), ("text", "string"))
    return rows.select("doc_id", "text", held_out_column().alias("held_out"), _has_letter().alias("has_letter")).mapInArrow(_score(box), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language has a score of ``least`` or more.

    Scores are those of ``identify``, row by row: null texts and those without a letter go,
    rows that repeat an id or have none are judged on their own. Nothing is shuffled.
    """
    storage.bound_batches(docs.sparkSession)
    box = _model_box(docs, model)
    text, letter = storage.fresh(docs, "text_"), storage.fresh(docs, "has_letter")
    rows = docs.select("*", F.col("text").cast("string").alias(text), _has_letter().alias(letter))
    return rows.mapInArrow(_accept(box, len(docs.columns), least), docs.schema)


__all__ = ["Model", "accepted", "fit", "identify", "predict", "train"]
