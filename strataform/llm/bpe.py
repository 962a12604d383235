"""BPE encoding and decoding with a public word-level vocabulary, in batched numpy merge rounds.

Texts are normalised (NFC, white space to one space, lower case) and split into runs of
letters, single digits, runs of other characters and a few contractions. The distinct
pieces of a batch are merged together: their symbols lie in one flat array; each round finds the
rank of every adjacent pair by binary search over the sorted pair keys, and merges each
piece's lowest-ranked pairs, from the left, until no pair has a rank.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import storage
from .textarrays import Texts, ordered_strings, slices, texts

_NO_RANK = np.int64(1 << 40)
# The contractions that the vocabulary's splitter keeps whole, after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + extra))
        extra += b not in plain
    return out


# White space as Unicode defines it (property White_Space).
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Letters and numbers that Unicode 16.0 adds to the 15.1 of Python's tables; the splitter knows 16.0.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Lower case of letters added after Unicode 15.1; the normaliser knows 17.0.
LOWER_17 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER_17 |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# Marks with a combining class that came after Unicode 9.0, and the second half of a later composite (U+11938).
# NFC as the tokenizer does it knows 9.0: there they neither move nor join.
MARKS_LATER = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47),
    (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136),
    (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
_MARK_LATER = regex.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in MARKS_LATER) + "])")
_LOWER_LATER = regex.compile("[" + "".join(map(chr, LOWER_17)) + "]")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 space, 1 letter, 2 number, 3 other."""
    major = {"L": 1, "N": 2}
    out = np.fromiter((major.get(unicodedata.category(chr(c))[0], 3) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[list(SPACES)] = 0
    for kind, ranges in ((1, LETTERS_16), (2, NUMBERS_16)):
        for first, last in ranges:
            out[first : last + 1] = kind
    return out


class Vocabulary:
    """Merges, symbols and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.width = max(self.tokens) + 1
        left, right, made = [], [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left.append(self.vocab[a])
            right.append(self.vocab[b])
            made.append(self.vocab[a + b])
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        keys, first = np.unique(keys, return_index=True)  # the lowest rank of a pair
        self.pair_keys, self.pair_ranks, self.pair_made = keys, first.astype(np.int64), np.array(made, np.int64)[first]
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.final = np.array([self.vocab[s + self.suffix] for s in symbols], np.int64)
        pieces = [self.tokens.get(i, "").encode() + b" " for i in range(self.width)]
        self.token_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.token_ends = np.cumsum([len(p) for p in pieces])
        self.token_sizes = np.array([len(p) for p in pieces], np.int64)
        self.splitter = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    # -- merging ---------------------------------------------------------------

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces given as one flat array of ids; piece i is symbols[first[i]:first[i + 1]]."""
        n = len(first) - 1
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        piece = np.repeat(np.arange(n), np.diff(first))
        ids = symbols.astype(np.int64)
        while len(ids):
            rank = np.full(len(ids), _NO_RANK, np.int64)
            made = np.zeros(len(ids), np.int64)
            if len(ids) > 1:
                key = ids[:-1] * self.width + ids[1:]
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                found = (self.pair_keys[at] == key) & (piece[:-1] == piece[1:])
                rank[:-1][found] = self.pair_ranks[at[found]]
                made[:-1][found] = self.pair_made[at[found]]
            head = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            size = np.diff(np.concatenate([head, [len(ids)]]))
            low = np.repeat(np.minimum.reduceat(rank, head), size)
            over = low == _NO_RANK
            if over.any():
                done.append((piece[over], ids[over], np.flatnonzero(over)))
                go = ~over
                ids, piece, rank, made, low = ids[go], piece[go], rank[go], made[go], low[go]
            if not len(ids):
                break
            hit = rank == low
            clash = np.flatnonzero(hit[1:] & hit[:-1]) + 1  # a pair that overlaps the one before it
            if len(clash):
                run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
                start = run[np.searchsorted(run, clash, "right") - 1]
                hit[clash[(clash - start) % 2 == 1]] = False
            spot = np.flatnonzero(hit)
            ids[spot] = made[spot]
            keep = np.ones(len(ids), bool)
            keep[spot + 1] = False
            ids, piece = ids[keep], piece[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        owner, out = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return out[order], np.searchsorted(owner[order], np.arange(n + 1))

    def pieces(self, t: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte spans of normalised text, each merged as a word of its own."""
        size = end - start
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(first[-1]) + np.repeat(start - first[:-1], size)
        raw = t.data[at]
        symbols = self.inner[raw]
        last = first[1:] - 1
        symbols[last] = self.final[raw[last]]
        return self.merge(symbols, first)

    # -- texts -----------------------------------------------------------------

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where each text's ids begin."""
        raw = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
        parts: list[str] = []  # stretches between special tokens
        owner: list[int] = []
        marks: list[tuple[int, int]] = []  # (stretch before which it stands, id)
        for i, text in enumerate(raw):
            text = text or ""
            if self.splitter is not None and any(s in text for s in self.special):
                at = 0
                for m in self.splitter.finditer(text):
                    parts.append(text[at : m.start()])
                    owner.append(i)
                    marks.append((len(parts), self.special[m[0]]))
                    at = m.end()
                text = text[at:]
            parts.append(text)
            owner.append(i)
        flat, stretch = self._words([normalize(p) for p in parts])
        if not marks:
            return flat, stretch
        at = stretch[[m[0] for m in marks]]
        flat = np.insert(flat, at, [m[1] for m in marks])
        begin = np.searchsorted(np.array(owner), np.arange(len(raw)))  # each text's first stretch
        bounds = stretch + np.searchsorted(np.array([m[0] for m in marks]), np.arange(len(parts) + 1), "right")
        return flat, np.concatenate([bounds[begin], [len(flat)]])

    def _words(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        t = texts(pa.array(parts, pa.string()))
        start, end = split(t)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(parts) + 1, np.int64)
        named = ordered_strings(t, start, end).dictionary_encode()  # equal bytes, one entry
        inverse, each = named.indices.to_numpy(), texts(named.dictionary)
        ids, first = self.pieces(each, each.offsets[:-1], each.offsets[1:])
        size = np.diff(first)[inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.arange(total[-1]) + np.repeat(first[:-1][inverse] - total[:-1], size)]
        return flat, total[np.searchsorted(start, t.offsets)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> Texts:
        """Tokens of each text joined by one space, as bytes."""
        size = self.token_sizes[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        begin = (self.token_ends - self.token_sizes)[ids]
        data = self.token_bytes[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        return Texts(data, total[first])  # each text ends in a space too many

    def text(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


def normalize(text: str) -> str:
    """NFC, then lower case character by character; white space is left to ``split``."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = "".join(unicodedata.normalize("NFC", x) for x in _MARK_LATER.split(text))
    if _LOWER_LATER.search(text):
        text = text.translate(LOWER_17)
    # a final sigma depends on its neighbours; each character is lowered alone here
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def split(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pieces of normalised texts: letter runs, digits, other runs, contractions."""
    if not len(t.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(t.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([np.flatnonzero((t.data & 0xC0) != 0x80), [len(t.data)]])  # byte of each code point
    kind = _classes()[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[np.searchsorted(lead, t.offsets)] = True
    fresh = edge[:-1].copy()
    fresh[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    fresh[0] = True
    start = np.flatnonzero(fresh)
    end = np.concatenate([start[1:], [len(points)]])
    apostrophe = np.flatnonzero((points[start[:-1]] == 0x27) & (end[:-1] - start[:-1] == 1) & (kind[start[1:]] == 1) & ~edge[start[1:]])
    if len(apostrophe):
        after, stop = start[apostrophe + 1], end[apostrophe + 1]
        wide = np.concatenate([points, [0, 0]])
        a, b = wide[after], wide[after + 1]
        take = np.zeros(len(after), np.int64)
        for c in CONTRACTIONS:
            hit = a == ord(c[0])
            if len(c) == 2:
                hit &= (b == ord(c[1])) & (stop - after >= 2)
            take[hit & (take == 0)] = len(c)
        some = take > 0
        at, after, take = apostrophe[some], after[some], take[some]
        end[at] = after + take
        start[at + 1] = after + take
    keep = (kind[np.minimum(start, len(kind) - 1)] > 0) & (end > start)
    return lead[start[keep]], lead[end[keep]]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def _run(path: str, with_ids: bool):
    def run(batches):
        v = load(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, first = v.encode(part.column("text"))
                out = v.decode(ids, first)
                words, n = ids.astype("<u4"), np.diff(first)
                hashes = [hashlib.sha256(words[a:b].tobytes()).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                texts_ = [hashlib.sha256(out.data[a : max(a, b - 1)].tobytes()).hexdigest() for a, b in zip(out.offsets[:-1], out.offsets[1:], strict=True)]
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes), pa.array(texts_)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]), one row per row of ``docs``.

    Null text is empty: no token. The vocabulary file at ``path`` must be on every executor.
    Special tokens in a text get their ids. Repeated rows and null ids stay as they are; other
    columns are not read. Every text is encoded on its own, so a lost task is simply run again.
    """
    docs = storage.texts_of(docs, ("doc_id", "long"), ("text", "string"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.mapInArrow(_run(path, with_ids), schema)
