"""N-gram join, repeated windows and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from wayfold.llm import bpe_codec, ngram_join, repeats, secret_scan

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(90).split()
    rows = [text(rng.randint(1, 120)) for _ in range(60)]
    for k in range(40):  # near copies at all distances from the base
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    rows += [text(30) + " " + passage + " " + text(30) for _ in range(25)] + [rows[3]] * 12 + [rows[5].upper(), "one two three", "One  two three", None, "", " \n", "é " * 300, "a" * 500]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = BLANK.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_classes(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_classes(docs).collect()}
    assert got == brute_classes(corpus())


def test_classes_in_small_parts(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_classes(docs).collect()}
    assert got == {i: c for i, (_, c) in brute_classes(corpus()).items()}


def test_tree_agrees_with_sets():
    rng = np.random.default_rng(2)
    base = rng.permutation(2000)[:200].astype(np.uint64)
    sets = []
    for _ in range(60):
        x = base.copy()
        k = rng.integers(0, 40)
        x[rng.permutation(200)[:k]] = rng.permutation(np.arange(5000, 9000))[:k]
        sets.append(np.sort(x)[::-1])
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))}
    assert set(ngram_join.part_links(sets, sets)) == want and set(ngram_join.part_links(sets, sets, budget=20_000)) == want
    blobs = [x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for x in sets]
    assert {(0, j) for j in np.flatnonzero(ngram_join.tree_links(blobs[0], blobs))} == {p for p in want if p[0] == 0}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_classes(empty).count() == 0 and repeats.remove_repeats(empty).count() == 0


def brute_repeats(rows, size=200):
    count = Counter(b[i : i + size] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - size + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("often, many", [(2, 1024), (16, 1024), (16, 3)])
def test_repeats(docs, monkeypatch, often, many):
    monkeypatch.setattr(repeats, "OFTEN", often)
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "LISTED", 7 if many == 3 else repeats.LISTED)
    monkeypatch.setattr(repeats, "REFINED", 4096 if many == 3 else repeats.REFINED)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs).collect()}
    assert got == brute_repeats(corpus())


def thue_morse(n=11):
    out = "a"
    for _ in range(n):
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


def test_radix_passes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    starts = np.arange(len(data) - 29)
    count = Counter(data[i : i + 30].tobytes() for i in starts)
    want = {i for i in starts.tolist() if count[data[i : i + 30].tobytes()] > 1}
    assert set(repeats.repeated_windows(data, starts, np.zeros(len(starts), np.int64), 30).tolist()) == want


def test_texts_that_defeat_polynomials(spark):
    u, v = thue_morse()
    rows = [(1, u), (2, v), (3, f"{u} one two three four"), (4, f"{v} one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(docs).collect()} == brute_repeats(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_classes(docs).collect()} == brute_classes(rows)


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i, t in corpus():
        t = None if t is None else re.sub(r"((?:\S+ ){9}\S+) ", lambda m: m.group(1).capitalize() + ".\n", t) + "."
        rows.append((i, t, "en", "s", len(t or "")))
    item = " ".join(rng.choice("qrstuv") * 3 + str(k) for k in range(14))
    extra = " ".join(f"zz{k}" for k in range(40)) + ".\n"
    rows += [(900, extra + item.upper() + ".", "en", "s", 1), (901, extra.replace("z", "y") + 'token = "0123456789abcdef0123456789abcdef" done.', "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = []
    for i, t, *_ in rows:
        w = BLANK.findall(t or "")
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
        good = dict.fromkeys(x for x in lines if re.search(r"[.!?:;…。！？»”\"')\]][ \t-\r]*$", x))
        if len(w) >= 20 and 100 * len(hit) <= 30 * len(w) and 2 * sum(map(len, good)) >= sum(map(len, lines)):
            kept.append((i, t))
    classes = brute_classes(kept)
    kept = [(i, t) for i, t in kept if classes[i][1] == i and i != 900]
    assert set(got) == {i for i, _ in kept} and 901 in got
    codec = bpe_codec.Codec.get(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))
    for i, t in kept:
        masked = secret_scan.redact(t, secret_scan.base_spans(t), "<secret>")
        assert got[i]["decoded_sha256"] == hashlib.sha256(masked.encode()).hexdigest()
        assert got[i]["n_tokens"] == len(codec.encode([masked])[0])
