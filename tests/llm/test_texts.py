"""Packing, mixing, repetition and token counts."""

import os
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fragsql.llm import mixing, packing, queries, repetition, tokens


# -- tokens ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = os.path.join(os.path.dirname(tokens.VOCABULARY), name)
    texts = ["hello world", "", None, "Straße – улица <|endoftext|>", "a " * 30_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n_tokens"] for r in tokens.with_token_count(df, "t", vocabulary=path).orderBy("i").collect()]
    assert got[1] == got[2] == 0 and got[0] >= 2 and got[3] > 4 and got[4] >= 30_000
    assert got[3] == len(tokens.encoder(path)(texts[3]))


def test_unknown_vocabulary():
    with pytest.raises(ValueError):
        tokens.encoder("/opt/none.txt")


# -- packing ----------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=7), st.integers(0, 60))
def test_fullest_is_the_best_sum(available, space):
    chosen = packing.fullest(Counter(available), space)
    assert all(n <= available[s] for s, n in chosen.items())
    sums = {0}
    for s, n in available.items():
        sums = {x + s * k for x in sums for k in range(n + 1) if x + s * k <= space}
    assert sum(s * n for s, n in chosen.items()) == max(sums)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_every_item_lands_in_one_container(sizes):
    got, containers = Counter(), 0
    for bin_, times in packing.minimum_bin_slack(sizes, 50):
        assert 0 < sum(s * n for s, n in bin_.items()) <= 50
        containers += times
        for s, n in bin_.items():
            got[s] += n * times
    assert got == Counter(sizes)
    assert containers >= sum(s * n for s, n in sizes.items()) / 50


def test_pack_keeps_items_whole(spark):
    rnd = random.Random(1)
    sizes = [rnd.choice([0, None, 5, 17, 100, 250, 400, 1000, 1001, 2500, -3]) if rnd.random() < 0.2 else rnd.randrange(1, 300) for _ in range(3000)]
    df = spark.createDataFrame([(i if i % 50 else None, s, "x") for i, s in enumerate(sizes)], "id long, size int, container string").repartition(5)
    rows = packing.pack(df, "id", "size", 1000, pool_size=60_000).collect()
    total = sum(max(s or 0, 0) for s in sizes)
    assert sum(r["size"] for r in rows) == total
    used = Counter()
    for r in rows:
        assert (r["container"] is None) == (r["size"] == 0)
        assert r["n_pieces"] == max(1, -(-r["size"] // 1000)) or r["n_pieces"] > 1
        used[r["container"]] += r["size"]
    del used[None]
    assert max(used.values()) <= 1000
    assert sum(1000 - v for v in used.values()) < 0.02 * total
    whole = Counter(r["id"] for r in rows if r["piece"] == 0)
    assert whole[None] == 60 and all(n == 1 for i, n in whole.items() if i is not None)
    big = [r for r in rows if r["n_pieces"] == 3]
    assert {r["size"] for r in big} <= {1000, 500}
    assert packing.pack(df.where("false"), "id", "size").count() == 0


def test_packed_texts(spark, data):
    packed = queries.p7_method(spark, data)
    report = packing.fill_report(packed).collect()
    assert all(0 <= r["slack"] for r in report)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert packed.select("doc_id").distinct().count() == docs.count()
    encode = tokens.encoder()
    big = {r["doc_id"] for r in docs.collect() if r["text"] and len(encode(r["text"])) > 2048}
    assert {r["doc_id"] for r in queries.p7_found(spark, data).collect()} == big


# -- mixing -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("rate", "cap"), [(0.0, 3), (0.2, 1), (0.9, 2), (2.5, 3), (4.0, 4), (1.7, 40), (0.5, 0)])
def test_cut_poisson_has_the_mean(rate, cap):
    cdf = mixing.copies_distributions(np.array([0.1, rate]), cap)[1].tolist()
    assert len(cdf) == cap and all(a <= b for a, b in zip(cdf, cdf[1:], strict=False))
    assert sum(1 - c for c in cdf) == pytest.approx(min(rate, cap), abs=1e-6)


def docs_frame(spark, n=4000):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        source = rnd.choice(["big"] * 12 + ["Mid ", " MID"] * 2 + ["tiny", None, "other"])
        rows.append((i, source, None if i % 97 == 0 else "word " * rnd.randrange(1, 30)))
    df = spark.createDataFrame(rows, "id long, source string, text string").repartition(4)
    return df.withColumns({"copies": F.lit("extra"), "n_tokens": F.lit(-1), "cdf": F.lit(None)})


def test_mixture_reaches_its_shares(spark):
    df = docs_frame(spark)
    target = spark.createDataFrame([("big", 0.3, 2), ("mid", 0.4, 3), ("tiny", 0.28, 2), ("absent", 0.02, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    prepared = mixing.prepare(df, target, "id", "text")
    report = {r["source"]: r for r in mixing.share_report(prepared).collect()}
    assert set(report) == {"big", "mid", "tiny", "absent"}
    assert report["big"]["reachable"] and report["mid"]["reachable"] and not report["tiny"]["reachable"] and not report["absent"]["reachable"]
    for s in ("big", "mid"):
        assert abs(report[s]["used"] - report[s]["wanted"]) < 0.005 * report[s]["wanted"]
    assert report["tiny"]["used"] == 2 * report["tiny"]["available"] and report["absent"]["used"] == 0
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    rows = mixing.mixture(prepared).select("id", "copy", "copies", "source_key", "place").collect()
    most = Counter(r["id"] for r in rows)
    cap = {"big": 2, "mid": 3, "tiny": 2}
    assert all(most[r["id"]] == r["copies"] <= cap[r["source_key"]] for r in rows)
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)
    again = mixing.mixture(mixing.prepare(df.repartition(7), target, "id", "text")).select("id", "copy", "copies", "source_key", "place").collect()
    assert again == rows
    assert mixing.mixture(prepared).select("record.*").columns == df.columns
    assert sum(r["n_tokens"] for r in mixing.mixture(prepared).select("n_tokens").collect()) == sum(r["used"] for r in report.values())
    # a mixture without tiny and absent sources' limits: as large as lets every share be reached
    target = target.where("source in ('big', 'mid', 'tiny')").withColumn("target_share", F.when(F.col("source") == "mid", 0.42).otherwise(F.col("target_share")))
    report = {r["source"]: r for r in mixing.share_report(mixing.prepare(df, target, "id", "text", size=mixing.REACHABLE)).collect()}
    assert all(r["reachable"] for r in report.values())
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.01 for r in report.values())


def test_no_text_is_staged(spark, data):
    from fragsql import runtime

    before = set(runtime.staged_tables())
    assert queries.p8_method(spark, data).count() > 0
    for _, path in set(runtime.staged_tables()) - before:
        assert not {"text", "record"} & set(spark.read.parquet(path).columns)


def test_mixture_edges(spark):
    target = spark.createDataFrame([("a", 1.0, 2), ("b", None, None)], "source string, target_share double, max_repeats int")
    none = docs_frame(spark, 1).where("false")
    p = mixing.prepare(none, target, "id", "text")
    assert mixing.mixture(p).count() == 0
    assert {r["source"]: r["used"] for r in mixing.share_report(p).collect()} == {"a": 0, "b": 0}
    p = mixing.prepare(docs_frame(spark, 50), target.where("false"), "id", "text")
    assert mixing.share_report(p).count() == 0 and mixing.mixture(p).count() == 0


def test_mix_found(spark, data):
    encode = tokens.encoder()
    sizes, total = Counter(), 0
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        n = len(encode(r["text"])) if r["text"] else 0
        total += n
        if r["source"]:
            sizes[r["source"].strip().lower()] += n
    want = {r["source"] for r in spark.read.parquet(f"{data}/mix_target.parquet").collect() if r["target_share"] * total > r["max_repeats"] * sizes[r["source"]]}
    assert {r["source"] for r in queries.p8_found(spark, data).collect()} == want


# -- repetition -------------------------------------------------------------------------------------------------------


def brute_repetition(words, k):
    seen, covered, late = {}, set(), set()
    longest = 0
    for i in range(len(words) - k + 1):
        gram = tuple(words[i : i + k])
        if gram in seen:
            covered |= set(range(i, i + k))
            late.add(gram)
        seen.setdefault(gram, i)
    for i in range(len(words)):
        for j in range(i):
            n = 0
            while i + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            longest = max(longest, n)
    return len(words), len(covered), longest if longest >= k else 0, len(late)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=5), st.integers(1, 6))
def test_suffix_arrays_against_brute_force(docs, k):
    words = np.array([w for d in docs for w in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got = repetition.repeated_words(words, doc, len(docs), k)
    assert [tuple(r) for r in got.tolist()] == [brute_repetition(d, k) for d in docs]


def test_suffix_order():
    words = np.array([1, 0, 1, 0, 1, 1], np.int64)
    order, common = repetition.suffix_array(words, np.zeros(6, np.int64))
    lists = [words[i:].tolist() for i in order]
    assert lists == sorted(lists)
    assert common.tolist() == [0, 2, 0, 1, 3, 1]


def test_repetition_edges(spark):
    long = "one two three four five six seven " * 20_000
    rows = [(1, None, 0), (2, "", 0), (3, " .,_ ", 0), (4, "A b c d e f a B C D E F", 0), (None, long, 0), (4, "x", 1)]
    df = spark.createDataFrame(rows, "id long, text string, share int")
    got = repetition.repetition(df, "id", "text").collect()
    assert sorted((r["id"] or 0, r["n_words"], r["n_repeated"], r["longest"], r["excessive"]) for r in got) == [
        (0, 140_000, 139_993, 139_993, True),
        (1, 0, 0, 0, False),
        (2, 0, 0, 0, False),
        (3, 0, 0, 0, False),
        (4, 1, 0, 0, False),
        (4, 12, 6, 6, True),
    ]
    assert repetition.repetition(df.where("false"), "id", "text").count() == 0
    limited = repetition.repetition(df, "id", "text", max_share=None, max_longest=7).where("excessive")
    assert [r["id"] for r in limited.collect()] == [None]
    exact = repetition.repetition(df.where("id = 4"), "id", "text", max_share=Fraction(1, 2)).where("excessive")
    assert exact.count() == 1


@pytest.mark.parametrize("name", ["p1_found", "p1_top100", "p3_found", "p3_top10", "p9_found", "p9_repetition"])
def test_against_sql(spark, data, duck, name):
    same(queries.QUERIES[name](spark, data), duck, queries.SQL[name])


def test_no_query_drops_rows_by_id(spark, data):
    assert queries.p7_method(spark, data).agg(F.count_distinct("doc_id")).first()[0] == spark.read.parquet(f"{data}/documents.parquet").count()


@pytest.mark.parametrize("cap", [600, 800, 3000])
def test_cut_poisson_reaches_rates_near_large_caps(cap):
    rates = np.array([0.3, 0.9, 0.999]) * cap
    below = mixing.copies_distributions(rates, cap)
    assert np.allclose(cap - below.sum(axis=1), rates, rtol=1e-9)
    assert (np.diff(below, axis=1) >= 0).all() and below.max() <= 1
