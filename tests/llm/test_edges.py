"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import bpe_codec, decontamination, licenses, ngram_join, pii, quality, repeats, secret_scan, token_counts, url_filter

LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(130_000))  # over 1 MB
ROWS = [(1, LONG), (2, None), (3, ""), (4, " \n"), (5, "a tie of two rows with some more words"), (6, "a tie of two rows with some more words"), (7, "once"), (7, "once"), (7, "twice"), (None, "once"), (None, None)]
BENCHMARK = "item_id string, text string"


def _operators(spark):
    items = spark.createDataFrame([("a", "word1x1 word2x2 word3x3"), (None, "once"), ("b", None), ("c", "")], BENCHMARK)
    return {
        "token_counts": lambda d: token_counts.token_counts(d),
        "quality": lambda d: quality.quality_rules(d.select("doc_id", "text")).drop("text", "cleaned"),
        "url_filter": lambda d: url_filter.filter_urls(d, "doc_id", "text"),
        "ngram_join": lambda d: ngram_join.similar_classes(d),
        "licenses": lambda d: licenses.license_scan(d.select("doc_id", "text")).drop("text", "paragraphs"),
        "repeats": lambda d: repeats.remove_repeats(d),
        "pii": lambda d: pii.pseudonymise(d, b"key"),
        "secrets": lambda d: secret_scan.secret_spans(d),
        "decontamination": lambda d: decontamination.contaminated_words(d, items),
        "codec": lambda d: bpe_codec.digests(d),
    }


NAMES = ["token_counts", "quality", "url_filter", "ngram_join", "licenses", "repeats", "pii", "secrets", "decontamination", "codec"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_all_kinds(spark, name):
    rows = [r for r in ROWS if name != "url_filter" or r[0] != 1]  # a URL of a megabyte has its own test
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    run = _operators(spark)[name]
    out = run(docs)
    got = sorted(map(str, out.collect()))
    assert len(got) == len(rows)
    # further columns with the names of results and of the operators' own columns change nothing
    clashing = docs
    for c in (*out.columns, "id", "uid", "sig", "n", "kind", "digit", "listed", "row", "s"):
        if c not in ("doc_id", "text"):
            clashing = clashing.withColumn(c, F.lit("clash"))
    assert sorted(map(str, run(clashing).collect())) == got
    assert run(docs.limit(0)).count() == 0


def test_very_long_url(spark):
    docs = spark.createDataFrame([(1, "http://a.org/fr/" + "x" * 30_000), (2, "http://b.net/y"), (3, "http://c.com/" + "x" * 30_000)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.filter_urls(docs).orderBy("page_id").collect()] == ["allow", "block", "allow"]


def test_classes_of_repeated_and_null_ids(spark):
    w = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(1, w), (1, other), (2, w + " now"), (None, other), (3, other + " now"), (4, other + " now then"), (None, "alone and without any id")]
    found = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((str(r["doc_id"]), r["component_id"]) for r in found if r["doc_id"] != 1), key=str)
    assert got == [("2", 1), ("3", 1), ("4", 1), ("None", 1), ("None", None)]
    rows = [(None, w), (2, w + " now"), (3, w + " now then")]  # a chain through a row without an id
    assert {r["component_id"] for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {2}


def test_one_row_of_each_class(spark):
    w = " ".join(f"w{i}" for i in range(30))
    rows = [(1, w, "a"), (1, w, "a"), (None, w, "b"), (None, w, "b"), (5, w + " now", "c"), (6, None, "d"), (6, None, "d"), (7, "", "e"), (None, "no other like it at all", "f"), (None, "no other like it at all", "f")]
    out = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.columns == ["doc_id", "text", "source"]
    assert sorted((str(r["doc_id"]), r["source"]) for r in out.collect()) == [("1", "a"), ("6", "d"), ("6", "d"), ("7", "e"), ("None", "f")]


def test_hot_shingles_link_nothing_away(spark):
    rng = random.Random(2)
    shared = "one two three four five"
    rows = [(i, f"{shared} a{i} b{i} c{i} d{i} e{i}") for i in range(600)]
    rows += [(1000 + i, f"{shared} x y z {rng.choice('pq')} r s t u v w{'' if i % 2 else ' k'}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_classes(docs).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    late = sorted(i for i in sets if i >= 1000)
    assert all(got[i] == i for i in range(600))
    for i in late:
        for j in late:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                assert got[i] == got[j]


def test_pipeline_on_odd_tables(spark, tmp_path):
    good = "\n".join(f"Line {i} has {i}a few words {i}of its own, {i}enough for {i}a document {i}that stays." for i in range(6))
    rows = [(1, good), (1, good), (None, good), (None, good), (2, None), (3, ""), (4, LONG)]
    for name, some in (("rows", rows), ("none", [])):
        d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long")
        d.withColumn("kept", F.lit("clash")).withColumn("_uid", F.lit(1)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], BENCHMARK).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    assert [r["doc_id"] for r in out] == [1]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
