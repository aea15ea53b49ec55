"""Product quantisation over tries against plain rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from docketry.llm import product_trie

MOST = (1 << 63) - 1


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, digest) of every usable row."""
    def whole(x):
        return max(-(1 << 62), min(1 << 62, math.floor(x * scale)))

    kept = [(i, [whole(x) for x in v], label, v) for i, v, label in rows if v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) if kept else 0
    cuts = [width * i // parts for i in range(parts + 1)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(cuts, cuts[1:])]

    def near(p, v):
        return min((sum((x - y) ** 2 for x, y in zip(v[cuts[p]:cuts[p + 1]], e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(near(p, r[1])[1], []).append(r[1][cuts[p]:cuts[p + 1]])
            for i, members in groups.items():
                books[p][i] = [sum(x) // len(members) for x in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, label, _ in kept:
        found = [near(p, v) for p in range(parts)]
        error = min(sum(d for d, _ in found), MOST)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
        total[label] = total.get(label, 0) + error
    return [(i, code, error, min(total[label], MOST), digest) for i, code, error, label in out]


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *(x or 0 for x in r)))


def vectors(kind):
    rng = np.random.default_rng(5)
    made = {"random": rng.normal(size=(300, 32)), "clusters": np.repeat(rng.normal(size=(6, 16)), 50, axis=0) + rng.integers(-1, 2, (300, 16)) / 4096,
            "ties": rng.integers(-1, 2, (300, 24)) / 4096, "copies": np.tile(rng.normal(size=(3, 8)), (100, 1)), "odd width": rng.normal(size=(60, 13)),
            "narrow": rng.normal(size=(60, 5)), "large": rng.normal(size=(60, 16)) * 1e12, "huge": rng.normal(size=(40, 8)) * 1e300}[kind]
    return [(i, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(made)]


@pytest.mark.parametrize("kind", ["random", "clusters", "ties", "copies", "odd width", "narrow", "large", "huge"])
def test_codes_equal_plain_rounds(spark, kind, monkeypatch):
    monkeypatch.setattr(product_trie, "BLOCK", 7)
    rows = vectors(kind)
    width = len(rows[0][1])
    rows += [(1000, None, 1), (1001, [None] + [0.0] * (width - 1), 1), (1002, [float("nan")] * width, 1), (1003, [float("inf")] * width, 0), (1004, [1.0, 2.0], 2),
             (None, [0.5] * width, 2), (None, [0.25] * width, None), (3, [0.125] * width, 1), (3, [0.125] * width, 1), (1005, [], 2)]
    table = spark.createDataFrame([(*r, "x", 9, 0.0) for r in rows], "vec_id long, embedding array<double>, label int, code string, `group` int, error double").repartition(4)
    found = product_trie.compress(table)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert by_key(tuple(r) for r in found.collect()) == by_key(brute(rows))


def test_fewer_vectors_than_entries(spark):
    rows = [(7, [1.0] * 8, "a"), (2, [2.0] * 8, "a"), (9, [1.0] * 8, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert by_key(tuple(r) for r in product_trie.compress(table).collect()) == by_key(brute(rows))
    assert product_trie.compress(table.filter("vec_id > 99")).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, [None], "b")], "vec_id long, embedding array<float>, label string")
    assert product_trie.compress(none).count() == 0
    empty = spark.createDataFrame([(1, [], "a"), (1, [], "a")], "vec_id long, embedding array<float>, label string")
    assert [tuple(r)[:4] for r in product_trie.compress(empty).collect()] == [(1, "00" * 8, 0, 0)] * 2


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_walk_visits_every_prefix_once(monkeypatch, block):
    """Rows that share prefixes share the sums of these: a level has as many nodes as there are different prefixes."""
    monkeypatch.setattr(product_trie, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows, place, counts = product_trie.distinct_rows(rng.integers(0, 3, (500, 6)))
    trie = product_trie.Trie(rows)
    assert [len(x) for x in trie.nodes] == [len(np.unique(rows[:, :k + 1], axis=0)) for k in range(6)]
    assert counts.sum() == 500 and (np.lexsort(rows.T[::-1]) == np.arange(len(rows))).all()
    book = rng.integers(0, 3, (16, 6))
    distance = ((rows[:, None] - book) ** 2).sum(axis=2)
    code, error = trie.nearest(book)
    assert (code == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
