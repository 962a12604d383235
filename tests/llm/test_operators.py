"""Operators against brute force on small fixtures: nulls, empty and repeated texts, ties, odd columns."""

import hashlib
import importlib.util
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strataform.llm import bpe, exact_dedup, langid, line_dedup, mixing, quality_classifier, quality_rules, simhash, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 400
ROWS = [
    (1, "The cat sat on the mat. " * 30, "en", "a"),
    (2, "The cat sat on the mat. " * 30, "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, "le chat est sur la table et la souris " * 8 + "\nune ligne\nune ligne", "fr", "b"),
    (6, LONG, "en", "c"),
    (7, LONG + "x", "en", "a"),
    (8, "0 1 2 3 !!", "en", None),
    (None, "the end of it all", "en", "a"),
    (9, " ".join(f"w{i}" for i in range(40)), "fr", "c"),
    (10, "pre " + " ".join(f"w{i}" for i in range(5, 35)) + " post", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, start string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", None) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact(docs, empty):
    got = by_id(exact_dedup.exact_dedup(docs, block_bytes=64))
    for i, t, *_ in ROWS:
        same = [r[0] for r in ROWS if (r[1] or "") == (t or "")]
        keep = max((x for x in same if x is not None), default=None)
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, len(same), i == keep)
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_simhash(docs, empty):
    got = by_id(simhash.simhash_dedup(docs))

    def brute(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    fp = {r[0]: brute(r[1]) for r in ROWS}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{v:016x}" for i, v in fp.items()}
    for i in fp:
        reach, more = {i}, {i}
        while more:
            more = {j for j in fp if j not in reach and any((fp[j] ^ fp[k]).bit_count() <= 2 for k in reach)}
            reach |= more
        assert got[i]["component_id"] == min((j for j in reach if j is not None), default=None)
    assert simhash.simhash_dedup(empty).count() == 0


def test_crowded_anchor_links_agree():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    fp = np.unique([base ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 4))))) for _ in range(60)])
    u, v = simhash._thin(*simhash._around(fp))
    x, y = simhash._thin(*simhash._links(np.zeros(len(fp), np.int64), fp))
    assert set(zip(u, v)) == set(zip(x, y))


def test_covering_code():
    x = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    assert np.bitwise_count(x ^ simhash.home(x)).max() <= 8
    row, anchor = simhash.anchors(x)
    assert np.bitwise_count(x[row] ^ anchor).max() <= 10
    near = x ^ np.uint64((1 << 5) | (1 << 40))
    other = set(zip(*map(list, simhash.anchors(near))))
    assert {i for i, _ in set(zip(row, anchor)) & other} == set(range(500))


def test_substring(docs, empty):
    got = by_id(substring_dedup.substring_dedup(docs))
    seen = set()
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(k)
        text = " ".join(x for x, k in zip(w, keep) if k)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), keep.count(False), hashlib.sha256(text.encode()).hexdigest())
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_quality_rules(docs, empty):
    got = by_id(quality_rules.quality_rules(docs, limit=1))
    norm = lambda line: " ".join(re.sub("[0-9]", "0", x.lower()) for x in WORD.findall(line))
    lines = {r[0]: [x for x in (r[1] or "").split("\n") if WORD.search(x)] for r in ROWS}
    held = Counter((r[3], x) for r in ROWS for x in {norm(y) for y in lines[r[0]]})
    for i, t, _, s in ROWS:
        w = WORD.findall(t or "")
        n = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {k for j in range(len(w) - 2) if n[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lost = sum(len(WORD.findall(x)) for x in lines[i] if held[s, norm(x)] > 1)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines[i]) - len(set(lines[i])), len(cover), failed, not failed and len(w) - lost >= 0.5 * len(w), lost)
        assert tuple(got[i])[1:] == want
    assert quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("broadcast", [quality_rules.BROADCAST_LINES, -1])
def test_frequent_lines_are_taken_out(docs, spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", broadcast)
    odd = [(20, "Page 1\n\n kept é \nPAGE 2\n", "s"), (20, " page  7\nown 1\r\npage 9", "s"), (21, "own 2\n\n\n", "s"), (None, "page 3", None), (22, "page 4\nx", None), (23, None, None), (20, "Page 1\n\n kept é \nPAGE 2\n", "s")]
    rows = [(r[0], r[1], r[3]) for r in ROWS] + odd
    norm = lambda line: " ".join(re.sub("[0-9]", "0", x.lower()) for x in WORD.findall(line))
    held = Counter((s, x) for _, t, s in rows for x in {norm(y) for y in (t or "").split("\n")} if x)
    want = [(i, s, t and "\n".join(x for x in t.split("\n") if held[s, norm(x)] <= 1)) for i, t, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.cleaned(df, limit=1).collect()
    key = lambda r: tuple((x is None, x or 0) if k == 0 else (x is None, x or "") for k, x in enumerate(r))
    assert sorted(((r["doc_id"], r["source"], r["text"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["n_words"] - r["n_line_words"] == len(WORD.findall(r["text"] or "")) for r in got)
    whole = {tuple(r) for r in quality_rules.cleaned(df).drop("text").collect()}
    assert {tuple(r)[:1] + tuple(r)[1:-1] for r in quality_rules.digests(df).collect()} == {r[:1] + r[2:] for r in whole}


def test_line_limit_follows_host(spark):
    """The limit in use by default: a share of the host's documents, over a small floor."""
    sizes, rows = {"small": 8, "mid": 90, "large": 400, None: 90}, []
    for host, n in sizes.items():
        for i in range(n):  # of each host: a line in 3 documents, one in a twentieth of them, one in a few more
            shared = [f"line {k} of all" for k, most in (("a", 3), ("b", n // 20), ("c", max(4, n // 20 + 1))) if i < most]
            rows.append((len(rows), "\n".join(["\n".join(shared), *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))]), host))
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    held = Counter((h, x) for _, t, h in rows for x in set(t.split("\n")))
    over = {(h, x) for (h, x), n in held.items() if n > 3 and 20 * n > sizes[h]}
    assert {h for h, _ in over} == set(sizes)  # hosts of any size can lose a line
    for i, t, h in rows:
        assert got[i]["n_line_words"] == sum(len(x.split()) for x in t.split("\n") if (h, x) in over)


def test_bpe(docs, empty):
    path = "/opt/tokenizers/word_bpe_49k.json"
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(path), bpe.load(path)
    odd = ["", None, "Hello's  wörld!! 12 <|endoftext|> naïve\ncafé 'tis I'RE ''s é😀", "ΣΣ İ é ſ's", "|||'''s a'sb'reX 'll"] + [r[1] for r in ROWS]
    ids, first = v.encode(odd)
    for i, x in enumerate(odd):
        assert ids[first[i] : first[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids
    got = by_id(bpe.encode_documents(docs, path))
    for i, x, *_ in ROWS:
        e = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(e)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(empty, path).count() == 0


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert sizes == {r[0]: len(WORD.findall(r[1] or "")) for r in ROWS}
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6 for r in rows)
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix(docs).collect()}
    total = mixing.mixed_documents(docs)
    assert total.columns == docs.columns
    assert total.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200
    rows = [(2, "u2", body), (1, "u1", body), (3, None, None), (4, "u\r\n4", "short"), (5, "u5", "short"), (6, "u", "é" * 80 + "\r\n\r\nWARC/1.1\r\n")]
    got = {r["page_id"]: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w")).collect()}
    assert got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == len(body)
    assert all(got[i]["record_type"] == "response" for i in (1, 3, 4, 5, 6))
    for i, _, h in rows:
        assert got[i]["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest()


def test_language(docs, empty):
    model = langid.fit(pd.DataFrame({"text": ["the cat and the dog " * 20, "le chat et la souris " * 20], "lang": ["en", "fr"]}))
    got = by_id(langid.identify(docs, model))
    assert got[1]["lang_pred"] == "en" and got[5]["lang_pred"] == "fr"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 8))
    assert langid.identify(empty).count() == 0


@pytest.mark.parametrize("n", [60, 3000])
def test_language_sample(spark, n):
    """One rule at every size: whole texts, each language by its own ranks, rows of one id apart."""
    rows = [(None if i % 3 == 0 else i, f"text {i} " + "long words " * (4000 if i % 50 == 0 else 1), "rare" if i in (1, 5, 8, 11, 22, 55) else "ab"[i % 2]) for i in range(n)]
    df = spark.createDataFrame(rows + rows[3:4] * 500, "doc_id long, text string, lang string")
    held_out = langid.held_out_column()
    marks = df.where(~held_out).select("text", "lang", F.xxhash64("doc_id", "text").alias("mark")).distinct().orderBy("mark").collect()
    count = Counter(r["lang"] for r in df.where(~held_out).collect())
    quotas = langid.sample_quotas(dict(count), 24)
    want = {(r["text"], r["lang"]) for lang, q in quotas.items() for r in [m for m in marks if m["lang"] == lang][:q]}
    got = langid.training_sample(df, held_out, 24)
    assert set(zip(got["text"], got["lang"])) == want and len(got) == len(want) == 24
    assert (got["lang"] == "rare").sum() == count["rare"] > 0
    less = langid.training_sample(df, held_out, 24, most_bytes=1000)
    assert less["text"].str.len().sum() <= 1000 and set(less["text"]) <= {t for t, _ in want}


def test_classifier(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality_classifier.classify(empty, labels).count() == 0


def test_classifier_fits_whole_texts(spark):
    rows = [(i, ("good words stay here " * 20 if i % 2 else "bad <b> junk $$ ") + "mid " * 9000 + f"end{i // 4} tail{i // 4}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    held_out = quality_classifier.held_out_column()
    free = [r["doc_id"] for r in df.where(~held_out).collect()]
    whole = {rows[i][1] for i in free}
    got = quality_classifier.training_rows(df, labels, held_out)
    assert set(got["text"]) == whole and len(got) == len(free)
    few = quality_classifier.training_rows(df, labels, held_out, most_bytes=100_000)
    assert 0 < len(few) < len(got) and set(few["text"]) <= whole
    huge = df.withColumn("text", F.when(F.xxhash64("doc_id") == df.where(~held_out).agg(F.min(F.xxhash64("doc_id"))).first()[0], F.repeat("text", 4)).otherwise(F.col("text")))
    assert len(quality_classifier.training_rows(huge, labels, held_out, most_bytes=100_000)) == len(few)  # a text too large alone ends nothing
    model = quality_classifier.train(df, labels)
    column = pa.array([rows[i][1] for i in free])
    x = quality_classifier.features(model.keys, model.vectors, column)
    assert np.allclose(model.center, x.mean(axis=0))  # centred on the features that texts are scored by


def test_word_vectors_over_documents(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 60))) for _ in range(50)] + [None, ""]
    keys, vectors = quality_classifier.word_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7))
    hashes = {x: int(quality_classifier._tokens(pa.array([x]))[1].hash[0]) for x in "abcdefgh"}
    place = {x: int(np.searchsorted(keys, np.uint64(h))) for x, h in hashes.items()}
    places, signs = quality_classifier._index_places(keys)
    index = np.zeros(vectors.shape)
    np.add.at(index, (np.arange(len(keys))[:, None], places), signs)
    want = np.zeros(vectors.shape)
    for t in texts:
        w = [place[x] for x in (t or "").split()]
        for i, a in enumerate(w):
            for gap in (1, 2):
                if i + gap < len(w):
                    want[a] += index[w[i + gap]]
                    want[w[i + gap]] += np.roll(index[a], gap)
    assert set(hashes.values()) <= set(keys.tolist())
    assert np.allclose(vectors, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9), atol=1e-6)


def test_edit_distance():
    rng = np.random.default_rng(3)
    a = ["".join(rng.choice(list("abé"), rng.integers(0, 12))) for _ in range(600)]
    b = [x[:2] + "c" + x[3:] + "ab"[: rng.integers(0, 3)] for x in a]
    for k in (1, 2, 3):
        assert line_dedup.within(a, b, k).tolist() == [line_dedup._plain(x, y) <= k for x, y in zip(a, b)]


def test_lines(spark, empty):
    base = "the quick brown fox jumps over it"
    texts = [base, base[:-1], base + "\n" + base.replace("quick", "quack"), "short\nshort", None, "\n \n", "another line of some length here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(line_dedup.line_dedup(df))
    assert [got[i]["removed"] for i in range(len(texts))] == [[], [0], [0, 1], [1], [], [], []]
    assert {tuple(r) for r in line_dedup.line_links(df).collect()} == {tuple(r) for r in line_dedup.line_links(df, crowd=1).collect()}
    assert line_dedup.line_dedup(empty).count() == 0
    left = line_dedup.remaining_text(df).orderBy("doc_id").collect()
    assert [r["text"] for r in left] == [base, "", "", "short", None, "\n \n", texts[-1]]


def test_close_lines_share_keys():
    """In every round, of two lines within the edits the longer one probes a key of the shorter one."""
    rng = np.random.default_rng(11)
    for same in (1, 2, 3):
        for _ in range(400):
            x = "".join(rng.choice(list("abcé"), rng.integers(2 + same, 24)))
            y = x
            for _ in range(rng.integers(1, 3)):
                at = int(rng.integers(0, len(y) + 1))
                y = (y[:at] + str(rng.choice(list("abz"))) + y[at + int(rng.integers(0, 2)) :]) if rng.random() < 0.6 else y[:at] + y[at + 1 :]
            if min(len(x), len(y)) < 2 + same:
                continue
            short, tall = sorted((x, y), key=len)
            key, owner = line_dedup.line_keys(*line_dedup._points(pa.array([short, tall])), same=same)
            index, probe = ({int(k) >> 1 for k in key[(owner == n) & (key % np.uint64(2) == n)]} for n in (0, 1))
            assert index & probe, (same, x, y)


def test_rounds_lose_no_link(spark):
    """Boilerplate: many lines share their first or last part; by brute force, for every number of rounds."""
    rng = np.random.default_rng(12)
    lines = {f"Copyright of the house {''.join(rng.choice(list('abc'), 9))}" for _ in range(60)}
    lines |= {f"{''.join(rng.choice(list('xyz'), rng.integers(3, 8)))}, all rights reserved" for _ in range(60)}
    lines |= {f"Page {n} of 90" for n in range(1, 60)}
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    text = {r["line"]: r["text"] for b in [df.select("text").mapInArrow(line_dedup._line_texts, "line long, text string")] for r in b.collect()}
    want = {frozenset((x, y)) for k, x in enumerate(lines) for y in lines[:k] if line_dedup._plain(x, y) <= 2}
    for rounds in (1, 2, 3):
        got = line_dedup.line_links(df, crowd=4, rounds=rounds).collect()
        assert len(got) == len(want) and {frozenset((text[r["a"]], text[r["b"]])) for r in got} == want


def test_short_lines_link(spark):
    """Every pair of lines longer than the edits, by brute force, whether keys are crowded or not."""
    rng = np.random.default_rng(5)
    lines = {"".join(rng.choice(list("abé "), rng.integers(1, 14))) for _ in range(250)}
    lines |= {"The anhely eran.", "The, anhely eran.", "Th the anhely eran.", "Than the anhely eran.", "Der eingeä erer.", "Der, eingeä erer."}
    lines = sorted(x for x in lines if x.strip())
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    number = {r["line"]: r["doc_id"] for r in df.mapInArrow(line_dedup._occurrences(()), "row long, line_no int, line long, doc_id long").collect()}
    want = {(i, j) for i, x in enumerate(lines) for j, y in enumerate(lines[:i]) if min(len(x), len(y)) > 2 and line_dedup._plain(x, y) <= 2}
    for crowd in (line_dedup.CROWD, 3):
        got = {tuple(sorted((number[r["a"]], number[r["b"]]), reverse=True)) for r in line_dedup.line_links(df, crowd=crowd).collect()}
        assert got == want and want


def test_pipeline(spark, tmp_path, docs):
    spec = importlib.util.find_spec("corpus_pipeline")
    assert spec is not None
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {r[0] for r in ROWS if re.search("[a-z]", r[1] or "")} and got
    assert 1 not in {r["doc_id"] for r in got}  # of equal texts the largest id stays
