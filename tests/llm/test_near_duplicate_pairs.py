"""The near-duplicate stage against all pairs: which documents stay when every pair of texts is compared."""

import random

import numpy as np
import pyarrow as pa
import pytest

from docketry.llm import simhash


def shingles(text):
    found = text.lower().split()
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)}


def all_pairs_stay(rows, least=0.8):
    """(doc_id, text) of the first row of every group; the groups join all pairs of that similarity."""
    rows = sorted(set(rows))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= least * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return sorted(rows[i] for i in range(len(rows)) if root(i) == i)


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r["doc_id"], r["text"]) for r in simhash.keep_one_of_each(docs).collect())


def pages(seed, n, length):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    return rng, lambda k=length: rng.choices(vocabulary, weights, k=k), [rng.choices(vocabulary, weights, k=length) for _ in range(n)]


@pytest.mark.parametrize("length", [12, 60, 300])
def test_appended_truncated_and_edited_copies(spark, length):
    rng, prose, bases = pages(length, 40, length)
    texts = []
    for base in bases:
        texts += [base, base + prose(length // 5), base + prose(length // 7), base[:length * 5 // 6], base[length // 6:]]
        edited = list(base)
        edited[rng.randrange(length)] = "changed"
        texts.append(edited)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert kept(spark, rows) == all_pairs_stay(rows)


def family_rows(seed=3):
    """Pages of one template with fields of their own: some pairs similar, others with nearer fingerprints are not."""
    rng, prose, (base,) = pages(seed, 1, 80)
    rows = []
    for _ in range(150):
        page = list(base)
        for _ in range(rng.randint(1, 4)):
            page[rng.randrange(80)] = f"field{rng.randrange(4)}"
        rows.append((len(rows), " ".join(page)))
    return rows


def test_family_of_similar_pages(spark, monkeypatch):
    """Links that fail the verification must not stand in for others: no common shingles last, hot shards in several cuts."""
    monkeypatch.setattr(simhash, "TREE", 16)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    rows = family_rows()
    assert kept(spark, rows) == all_pairs_stay(rows)


def test_texts_of_one_fingerprint(spark):
    """A repeated passage decides all bits; the ends make pairs similar that the first document of the fingerprint is not part of."""
    rng, prose, _ = pages(9, 1, 10)
    line, rows = "same line again ", []
    for i in range(12):
        rows.append((2 * i, line * 300 + " ".join(ends := prose(30))))
        rows.append((2 * i + 1, line * 300 + " ".join([*ends, "more"])))
    assert len({simhash.fingerprint(t, 2) for _, t in rows}) == 1
    assert kept(spark, rows) == all_pairs_stay(rows)


def test_different_texts_of_one_key(spark):
    rng, prose, _ = pages(11, 1, 10)
    rows = [(i // 2, " ".join(prose(40))) for i in range(8)]
    rows += [rows[0], (9, rows[3][1])]
    assert kept(spark, rows) == all_pairs_stay(rows)


def template_pages(n, length=60, exchanged=2, seed=4):
    """Pages of one template, each with words of its own in it: hardly any two are similar enough."""
    rng, prose, (base,) = pages(seed, 1, length)
    rows = []
    for i in range(n):
        page = list(base)
        for j in rng.sample(range(length), exchanged):
            page[j] = f"own{i}x{j}"
        rows.append((i, " ".join(page)))
    return rows


def proposals(spark, monkeypatch, rows):
    """Result, and how many pairs were verified in both rounds."""
    counts, write = {}, simhash.stored

    def counting(table, purpose):
        out = write(table, purpose)
        counts[purpose] = out.count()
        return out

    with monkeypatch.context() as patch:
        patch.setattr(simhash, "stored", counting)
        result = kept(spark, rows)
    return result, counts["candidates"] + counts["rest-candidates"]


def test_pages_of_one_template_send_few_pairs(spark, monkeypatch):
    """The number of pairs that leave the shards follows the number of pages, not its square."""
    seen = {}
    for n in (200, 400, 800):
        rows = template_pages(n)
        result, seen[n] = proposals(spark, monkeypatch, rows)
        if n == 200:
            assert result == all_pairs_stay(rows)
    assert all(sent <= 2 * n for n, sent in seen.items()), seen  # of 19,900, 79,800 and 319,600 pairs


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 40, 60, 300, 500, 6000)]
    sets += [np.unique(np.concatenate([s[len(s) // 9:], rng.integers(0, 1 << 63, len(s) // 7).astype(np.uint64)])) for s in sets]
    sketches = simhash.Sketches(pa.chunked_array([pa.array([simhash.sketch(s) for s in sets], pa.binary())]))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = sketches.apart(a, b)
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert (apart <= true).all() and (apart[a == b] == 0).all()
    # tight for sets near in size and content; where sizes differ much, the length filter decides
    size = np.array([len(x) for x in sets])
    near = (true > 0) & (true < 150) & (np.minimum(size[a], size[b]) >= 0.9 * np.maximum(size[a], size[b]))
    assert near.sum() >= 8 and (apart[near] > 0.8 * true[near]).all()
