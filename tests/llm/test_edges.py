"""Odd rows for every operator: repeated and missing ids, clashing columns, words that collide in polynomial hashes, long texts, rare characters."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strataform.llm import bpe, exact_dedup, langid, line_dedup, mixing, quality_classifier, quality_rules, simhash, substring_dedup, textarrays, warc
from strataform.llm.queries import WORD_BPE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, row_file string, row_number long, removed_ int, turn string, fp long, name string"
P = " ".join(f"p{i}" for i in range(30))
#: Rows that repeat ids with other texts and with the same one, rows without an id, and empty ones.
ROWS = [
    (7, "the cat and the dog\nsat on the mat\n" + P),
    (7, "the cat and the dog\nsat on the mat\n" + P),
    (7, "another text of the same id\nsat on the mut"),
    (None, "the cat and the dog\nsat on the mat\n" + P),
    (None, "the cat and the dog\nsat on the mat\n" + P),
    (None, None),
    (None, ""),
    (3, None),
    (3, "   \n\t"),
    (2, "x " + P + " y"),
    (9, "the cat and the dog\nsat on the mat\n" + P),
]


def odd(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", None if k % 3 else "s", "clash", k, 1, "clash", k, "clash") for k, (i, t) in enumerate(rows)], SCHEMA)


def multiset(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def thue_morse(n):
    """Two words of 2**n letters whose polynomial hashes modulo 2**64 are equal for every odd base, once n is 11 or so."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hash_has_no_structure():
    for n in range(1, 13):
        t = textarrays.texts(pa.array([" ".join(thue_morse(n))]))
        assert len(set(textarrays.words(t).hash.tolist())) == 2
    rng = random.Random(1)
    spans = {bytes(rng.choices(b"ab\0", k=rng.randrange(0, 40))) for _ in range(4000)} | {b"a" * k for k in range(1, 3000, 7)}
    data = b"".join(sorted(spans))
    ends = np.cumsum([len(x) for x in sorted(spans)])
    starts = np.concatenate([[0], ends[:-1]])
    h = textarrays.span_hash(np.frombuffer(data, np.uint8), starts, ends)
    assert len(set(h.tolist())) == len(spans)
    again = textarrays.span_hash(np.frombuffer(b"xyz" + data, np.uint8), starts + 3, ends + 3)
    assert (h == again).all()


def test_words_of_equal_polynomials_stay_apart(spark):
    a, b = thue_morse(11)
    df = odd(spark, [(1, f"{a}\n{b}"), (2, " ".join([a] * 20)), (3, " ".join([b] * 20))])
    lines = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert lines[1]["n_removed"] == 0
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.quality_rules(df).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()} == {1: 0, 2: 0, 3: 0}
    from tokenizers import Tokenizer

    ids, _ = bpe.load(WORD_BPE).encode([f"{a} {b}"])
    assert ids.tolist() == Tokenizer.from_file(WORD_BPE).encode(f"{a} {b}", add_special_tokens=False).ids


def test_exact_rows(spark):
    got = exact_dedup.exact_dedup(odd(spark), block_bytes=16).collect()
    want = Counter()
    for i, t in ROWS:
        same = [x for x, y in ROWS if (y or "") == (t or "")]
        keep = max((x for x in same if x is not None), default=None)
        want[i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert multiset(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    left = exact_dedup.distinct_texts(odd(spark), block_bytes=16)
    assert left.columns == odd(spark).columns
    assert multiset(left.collect(), "doc_id", "text") in [Counter({(9, ROWS[0][1]): 1, (7, ROWS[2][1]): 1, (3, None): 1, (3, "   \n\t"): 1, (2, ROWS[9][1]): 1})]


def test_exact_rounds(spark):
    """Texts of one to many blocks that share blocks in other orders, over several rounds."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["aaaa", "bbbb", "ab"]) for _ in range(rng.choice([0, 1, 2, 3, 9, 40])))) for i in range(120)]
    rows += [(200 + i, t) for i, t in rows[::3]]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(odd(spark, rows).repartition(5), block_bytes=4).collect()}
    for i, t in rows:
        same = [x for x, y in rows if y == t]
        assert (got[i]["keep_id"], got[i]["group_size"]) == (max(same), len(same))


def test_simhash_rows(spark):
    got = simhash.simhash_dedup(odd(spark)).collect()
    prints = {t: r["fingerprint"] for (_, t), r in zip(ROWS, [next(r for r in got if r["doc_id"] == i) for i, _ in ROWS]) if t is None}
    assert set(prints.values()) == {"0" * 16} and len(got) == len(ROWS)
    left = simhash.one_of_each(odd(spark)).collect()
    fps = dict(zip([t for _, t in ROWS], [int(x) for x in simhash.fingerprints_of(pa.array([t for _, t in ROWS], pa.string()))]))
    groups, texts = [], {t for _, t in ROWS}
    while texts:
        group, more = set(), {texts.pop()}
        while more:
            group |= more
            more = {t for t in texts if any((fps[t] ^ fps[x]).bit_count() <= 2 for x in group)}
            texts -= more
        groups.append(group)
    assert len(left) == len(groups)
    for group in groups:
        own = [r for r in left if r["text"] in group]
        least = min((i for i, t in ROWS if t in group and i is not None), default=None)
        assert len(own) == 1 and own[0]["doc_id"] == least


def test_anchors_meet_at_every_flip_of_one_and_two_bits():
    x = np.random.default_rng(9).integers(0, 2**64, 3, dtype=np.uint64)
    flips = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    assert len(flips) == 2080
    for one in x:
        own = set(simhash.anchors(np.array([one]))[1].tolist())
        row, anchor = simhash.anchors(one ^ np.array(flips, np.uint64))
        met = defaultdict(set)
        for r, a in zip(row.tolist(), anchor.tolist()):
            met[r].add(a)
        assert all(own & met[k] for k in range(len(flips)))


def test_simhash_crowd(spark):
    """Over 256 fingerprints at one anchor, joined by links of up to two bits, and some apart."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(700)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in links:
        root[find(r["u"] % (1 << 64))] = find(r["v"] % (1 << 64))
    want = {f: f for f in fps}

    def seek(f):
        while want[f] != f:
            f = want[f]
        return f

    every = sorted(fps)
    for k, a in enumerate(every):
        for b in every[:k]:
            if (a ^ b).bit_count() <= 2:
                want[seek(a)] = seek(b)
    assert len({find(f) for f in fps}) == len({seek(f) for f in fps})
    assert all((find(a) == find(b)) == (seek(a) == seek(b)) for a, b in zip(every, every[1:]))


def test_language_against_plain_python(spark):
    """The backoff word by word: known words, then n-grams of falling length."""
    rng = random.Random(5)
    make = {"aa": "abcde", "bb": "cdefg", "cc": "éàfgh"}
    train = [(" ".join("".join(rng.choices(chars, k=rng.randrange(1, 7))) for _ in range(300)), lang) for lang, chars in make.items() for _ in range(3)]
    model = langid.fit(pd.DataFrame(train, columns=["text", "lang"]))
    langs = sorted(make)
    runs = re.compile(r"[a-z\u0080-\U0010ffff]+")
    words = Counter((w, lang) for t, lang in train for w in runs.findall(t.lower()))
    total = Counter()
    for (w, _), n in words.items():
        total[w] += n

    def table(counts, known):
        size = Counter()
        for (_, lang), n in counts.items():
            size[lang] += n
        return {k: [math.log((counts[k, lang] + 0.1) / (size[lang] + 0.1 * (len(known) + 1))) for lang in langs] for k in known}

    known = table(words, {w for w, n in total.items() if n >= langid.MIN_COUNT})
    grams = {}
    spoken = {}
    for t, lang in train:
        for w in runs.findall(t.lower()):
            spoken.setdefault(w, lang)
    for n in range(langid.MAX_GRAM, 0, -1):
        counts = Counter((g, lang) for w, lang in spoken.items() for g in ngrams(w, n))
        each = Counter()
        for (g, _), c in counts.items():
            each[g] += c
        grams[n] = table(counts, {g for g, c in each.items() if c >= langid.MIN_COUNT})

    def score(text):
        sums, words_ = [0.0] * len(langs), runs.findall(text.lower())
        for w in words_:
            own = known.get(w)
            for n in range(langid.MAX_GRAM, 0, -1):
                if own is None and (found := [grams[n][g] for g in ngrams(w, n) if g in grams[n]]):
                    own = [sum(x) / len(found) for x in zip(*found)]
            sums = [a + b for a, b in zip(sums, own or [0.0] * len(langs))]
        k = max(len(words_), 1)
        mean = [s / k * min(k, langid.EVIDENCE) for s in sums]
        p = [math.exp(m - max(mean)) for m in mean]
        return langs[p.index(max(p))], max(p) / sum(p)

    texts = [" ".join("".join(rng.choices(make[rng.choice(langs)], k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["zzz", "é", "1 a-b"]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string"), model).collect()}
    for i, t in enumerate(texts):
        lang, p = score(t)
        assert abs(got[i]["score"] - p) < 1e-3 and (got[i]["lang_pred"] == lang or p < 0.51)


def ngrams(word, n):
    padded = f" {word} "
    return [g for g in (padded[k : k + n] for k in range(len(padded) - n + 1)) if g != " "]


def test_language_rows(spark):
    model = langid.fit(pd.DataFrame({"text": ["the cat and the dog sat on mat another text of same id " * 20, "le chat et la souris " * 20], "lang": ["en", "fr"]}))
    df = odd(spark)
    good = langid.identify(df, model).where("lang_pred <> 'und' and score >= 0.5").collect()
    left = langid.accepted(df, 0.5, model)
    assert left.columns == df.columns and left.schema == df.schema
    assert multiset(left.collect(), "doc_id") == multiset(good, "doc_id") and left.where("text is null").count() == 0
    assert langid.accepted(df.limit(0), 0.5).count() == 0


def test_mixing_rows(spark):
    rows = [(i % 5 if i % 4 else None, "w " * (i % 9), "abc"[i % 3] if i % 11 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, nth_copy long")
    each = mixing.mix(df).collect()
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == sum((Counter({r["doc_id"]: r["copies"]}) for r in each), Counter())
    assert max(Counter(r["nth_copy"] for r in got).values()) <= 3
    taken, target = Counter(), {}
    for r in each:
        target[r["source_size"], r["target"]] = r["target"]
        taken[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(taken[k] - target[k]) <= 0.1 * target[k] + 9 for k in target)


def test_warc_rows(spark, tmp_path):
    a, b = "<a>" + "x" * 200, "<b>" + "y" * 200
    rows = [(1, "u", a), (2, "u", a), (2, "v", b), (3, "w", b), (1, "again", a), (None, None, a), (None, "n", "small"), (4, "z", None)]
    df = spark.createDataFrame([(*r, "clash", 5, "clash") for r in rows], "page_id long, url string, html string, payload_digest string, original long, refers_to string")
    got = warc.archive_pages(df, str(tmp_path / "w"))
    want = Counter()
    for i, _, h in rows:
        least = min((x for x, _, y in rows if y == h and x is not None), default=None)
        revisit = len(h or "") >= 100 and i != least
        want[i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if revisit else "response", least if revisit else None] += 1
    assert multiset(got.collect(), *got.columns) == want
    assert warc.archive_pages(df.limit(0), str(tmp_path / "none")).count() == 0


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MAX_RECORDS", 3)
    df = spark.createDataFrame([(i, f"u{i}", f"text {i % 7} " * 40) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r for r in warc.archive_pages(df, str(tmp_path / "w")).collect()}
    assert len(got) == 40 and all(got[i]["refers_to"] == (i % 7 if i >= 7 else None) for i in got)
    assert len(list((tmp_path / "w").glob("part-*"))) >= 14


@pytest.mark.parametrize("chunk_bytes", [200, 8 << 20])
def test_substring_rows(spark, chunk_bytes):
    """Every window of rows that repeat an id stays in one of them; the rest is by brute force."""
    got = substring_dedup.substring_dedup(odd(spark), with_text=True, chunk_bytes=chunk_bytes).collect()
    assert multiset(got, "doc_id", "n_words") == Counter((i, len(WORD.findall(t or ""))) for i, t in ROWS)
    assert all(r["n_words"] - r["n_removed"] == len(WORD.findall(r["kept_text"])) for r in got)
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in (2, 9)} == {2: 30, 9: 39}
    assert sorted(r["n_removed"] for r in got if r["doc_id"] is None) == [0, 0, 0, 39]
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 7) == [0, 39, 39]


@pytest.mark.parametrize("chunk_bytes", [300, 8 << 20])
def test_substring_against_brute_force(spark, chunk_bytes):
    rng = random.Random(6)
    parts = [[f"s{k}w{j}" for j in range(rng.randrange(5, 45))] for k in range(12)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(0, 5)) for w in rng.choice(parts))) for i in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        w = t.split()
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            if (k := tuple(w[s : s + 20])) in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(k)
        want[i] = " ".join(x for x, k in zip(w, keep) if k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.substring_dedup(df, with_text=True, chunk_bytes=chunk_bytes).collect()}
    assert got == want


def test_line_rows(spark):
    got = line_dedup.line_dedup(odd(spark)).collect()
    order = sorted(range(len(ROWS)), key=lambda k: (ROWS[k][0] is not None, ROWS[k][0] or 0, k))
    lines = {k: [(n, x) for n, x in enumerate((ROWS[k][1] or "").split("\n")) if WORD.search(x)] for k in order}
    distinct = {x for own in lines.values() for _, x in own}
    near = {x: {y for y in distinct if y != x and min(len(x), len(y)) > 2 and line_dedup._plain(x, y) <= 2} for x in distinct}
    seen, want = set(), Counter()
    for k in order:
        gone = []
        for n, x in lines[k]:
            if x in seen or near[x] & seen:
                gone.append(n)
            seen.add(x)
        want[ROWS[k][0], len(lines[k]), len(gone), sum(len(near[x]) for _, x in lines[k]), tuple(gone)] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["n_links"], tuple(r["removed"])) for r in got) == want
    left = line_dedup.remaining_text(odd(spark))
    assert left.columns == odd(spark).columns and left.count() == len(ROWS)


def test_bpe_knows_the_tokenizer_s_tables():
    """Classes, case and normal form as the library has them: each listed code point, a sample of all, and rare marks in any order."""
    from tokenizers import Tokenizer

    t, v, rng = Tokenizer.from_file(WORD_BPE), bpe.load(WORD_BPE), random.Random(8)
    listed = [c for ranges in (bpe.LETTERS_16, bpe.NUMBERS_16, bpe.MARKS_LATER) for a, b in ranges for c in range(a, min(b, a + 40) + 1)] + list(bpe.LOWER_17) + list(bpe.SPACES)
    plain = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in plain if unicodedata.combining(chr(c))] + listed
    rows = [f"a{chr(c)}b 1{chr(c)}1 {chr(c)}'s" for c in listed + rng.sample(plain, 20000) + [0x558, 0xC5C, 0x208F, 0x10940, 0x16E80, 0x187C0, 0x18CC0]]
    rows += ["".join(chr(rng.choice(marks if rng.random() < 0.5 else plain)) for _ in range(rng.randrange(1, 12))) for _ in range(5000)]
    ids, first = v.encode(rows)
    for k, e in enumerate(t.encode_batch(rows, add_special_tokens=False)):
        assert ids[first[k] : first[k + 1]].tolist() == e.ids, rows[k]


def test_classifier_rows(spark):
    df = odd(spark, ROWS * 3)
    labels = spark.createDataFrame([(7, 1), (7, 0), (9, 1), (2, 0), (2, None), (None, 1), (3, 0)] * 2, "doc_id long, quality int")
    always = F.lit(False)
    rows = quality_classifier.training_rows(df, labels, always)
    assert len(rows) == 4 and rows["quality"].tolist() == [0, 0, 0, 1]  # one text an id; the lowest label
    again = quality_classifier.training_rows(df.repartition(3), labels.repartition(2), always)
    assert rows.values.tolist() == again.values.tolist()
    got = quality_classifier.classify(df, labels).collect()
    assert len(got) == 3 * len(ROWS) and all(0 <= r["score"] <= 1 for r in got)


def test_classifier_against_plain_python():
    rng = random.Random(11)
    keys = np.unique(np.array([int(textarrays.words(textarrays.texts(pa.array([x]))).hash[0]) for x in ("aa", "bb", "Cc", "d1")], np.uint64))
    vectors = np.random.default_rng(1).normal(size=(len(keys), quality_classifier.DIMENSIONS)).astype(np.float32)
    texts = [" ".join(rng.choices(["aa", "bb", "Cc", "d1", "zz!", "é#"], k=rng.randrange(0, 30))) for _ in range(40)] + [None, ""]
    wide = 2 * quality_classifier.DIMENSIONS + 6
    layers = (np.random.default_rng(2).normal(size=(wide, quality_classifier.HIDDEN)) * 0.1, np.zeros(quality_classifier.HIDDEN), np.ones(quality_classifier.HIDDEN) * 0.2, 0.1)
    model = quality_classifier.Model(keys, vectors, np.zeros(wide), np.ones(wide), layers, 1.7)
    got = quality_classifier.predict(model, pa.array(texts, pa.string()))
    place = {x: int(np.searchsorted(keys, np.uint64(textarrays.words(textarrays.texts(pa.array([x]))).hash[0]))) for x in ("aa", "bb", "Cc", "d1")}
    for text, p in zip(texts, got):
        w = (text or "").split()
        rows = np.array([vectors[place[x]] if x in place else np.zeros(quality_classifier.DIMENSIONS) for x in w] or [np.zeros(quality_classifier.DIMENSIONS)])
        raw = (text or "").encode()
        share = lambda chars: sum(c in chars for c in raw) / max(len(raw), 1)
        shares = [math.log1p(len(w)), len(set(w)) / max(len(w), 1), share(b"#*$%&|<>"), share(bytes(range(65, 91))), share(b"0123456789"), share(b"!?.,;:'\"-()[]{}/\\_+=@^~`")]
        x = np.clip(np.concatenate([rows.mean(axis=0), rows.std(axis=0), shares]), -6, 6)
        z = (np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3]) / 1.7
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-4


def test_long_texts(spark):
    """A text of 12 MB with one word of 2 MB, beside short ones, through every operator's slices, chunks and flushes."""
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1_200_000)) + " " + "x" * (2 << 20) + "\n" + P
    rows = [(1, long), (2, P), (3, long), (4, "short")]
    df = odd(spark, rows)
    size = {i: len(WORD.findall(t)) for i, t in rows}
    kept = {r["doc_id"]: r["kept"] for r in exact_dedup.exact_dedup(df).collect()}
    assert kept == {1: False, 2: True, 3: True, 4: True}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()} == {1: 0, 2: size[2], 3: size[3], 4: 0}
    assert {r["doc_id"]: r["component_id"] for r in simhash.simhash_dedup(df).collect()}[3] == 1
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert all(got[i]["n_words"] == size[i] and got[i]["word_chars"] == sum(map(len, WORD.findall(t))) for i, t in rows)
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(df).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == size
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(df, WORD_BPE).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows}
    model = langid.fit(pd.DataFrame({"text": ["w x short " * 50], "lang": ["en"]}))
    assert langid.identify(df, model).where("lang_pred = 'en'").count() == 4
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(df, labels).count() == 4


def test_pipeline_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", s) for k, (i, t) in enumerate(ROWS) for s in [None if k % 2 else "s"]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "odd/documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "odd/documents.parquet"))
    one = corpus_pipeline.exact(spark, docs, "")
    assert one.columns == docs.columns and multiset(one.collect(), "text").most_common(1)[0][1] == 1
    near = corpus_pipeline.near(spark, docs, "")
    assert near.columns == docs.columns and near.count() < one.count() + 1
    assert corpus_pipeline.weights(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path / "odd")).columns[0] == "doc_id"
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_xxhash_of_shingles():
    rng = random.Random(13)
    spans = [bytes(rng.choices(range(256), k=k)) for k in [*range(0, 100), 511, 512, 513, 600, 5000] for _ in range(2)]
    ends = np.cumsum([len(x) for x in spans])
    h = simhash.xxh64(np.frombuffer(b"".join(spans), np.uint8), ends - [len(x) for x in spans], ends)
    assert h.tolist() == [xxhash.xxh64_intdigest(x, seed=42) for x in spans]
