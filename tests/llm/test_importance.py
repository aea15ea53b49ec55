"""Bit-sliced importance weights against plain sums over features."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import importance


def runs(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, buckets=10_000, longest=2, least=20, percent=25, seed=7):
    """(doc_id, n_features, weight, score) of every row and the scores and keys drawn, in order."""
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for text in texts for f in runs(text, longest)[1])

    s, t = count(text for _, text in rows), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    out, able = [], []
    for key, text in rows:
        words, found = runs(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in (zlib.crc32(f.encode()) % buckets for f in found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, len(found), weight, score))
        if len(words) >= least:
            able.append((-score, key is None, key or 0))
    return out, sorted(able)[:len(able) * percent // 100]


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *(x or 0 for x in r)))


def check(found, rows, target, **options):
    want, drawn = brute(rows, target, **options)
    got = found.collect()
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert by_key(r[:4] for r in got) == by_key(want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == drawn


TARGET = ["the quick wolf sings in the night", None, "", "Stone house and river; RIVER rain " * 3]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TARGET)], "doc_id long, text string, bucket string")


def test_documents(docs, rows, target):
    check(importance.resample(docs, target), [(i, t) for i, t, _ in rows], TARGET)


def test_repeated_rows_and_ties(spark, rows, target):
    """A third of the rows is one document; ties among different keys come from one seed string for null keys."""
    some = [(i, t) for i, t, _ in rows] + [(40, rows[40][1])] * 60 + [(None, rows[41][1])] * 5
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    check(importance.resample(docs, target, percent=60), some, TARGET, percent=60)


def test_three_words_and_few_buckets(docs, rows, target):
    check(importance.resample(docs, target, buckets=37, longest=3, least_words=1, percent=100, seed=11),
          [(i, t) for i, t, _ in rows], TARGET, buckets=37, longest=3, least=1, percent=100, seed=11)


def test_nothing(spark, docs, rows, no_docs, target):
    assert importance.resample(no_docs, target).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    check(importance.resample(docs, none), [(i, t) for i, t, _ in rows], [])


@given(st.lists(st.lists(st.text("aZé0 \n", max_size=6) | st.sampled_from(["x" * 62, "y" * 63, "é" * 32, "z" * 64, "w" * 500, " "])).map(" ".join), max_size=5), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_checksums_of_runs(texts, longest):
    owner, bucket, n_words = importance.Features(10_000, longest).count(texts)
    assert n_words.tolist() == [len(runs(t)[0]) for t in texts]
    assert Counter(zip(owner.tolist(), bucket.tolist(), strict=True)) == Counter(
        (i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in runs(t, longest)[1])


def test_sliced_sums_are_exact():
    rng = random.Random(4)
    for buckets in (1, 63, 64, 65, 1000):
        gains = np.array([rng.choice([0, 1, -1, 1023, -1024, -40_000, 40_000, rng.randint(-9999, 9999)]) for _ in range(buckets)])
        owner, bucket = (np.array([rng.randrange(n) for _ in range(5000)]) for n in (4, buckets))
        want = [int(gains[bucket[owner == i]].sum()) for i in range(5)]
        assert importance.Gains(gains).weighted(owner, bucket, 5).tolist() == want


def test_ranks_over_many_parts(spark):
    table = spark.range(5000).select((F.col("id") % 7).alias("s"), "id").repartition(9)
    got = importance.ranked(table, [F.col("s").desc(), F.col("id")]).orderBy("rank").collect()
    assert [(r["s"], r["id"]) for r in got] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert [r["rank"] for r in got] == list(range(1, 5001))
