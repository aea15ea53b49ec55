import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import pivot_index


def brute(rows, k, scale=256):
    usable = {}
    for key, vector in rows:
        if key is None or vector is None or any(x is None or x != x or abs(x) == float("inf") for x in vector):
            continue
        ints = [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(x * scale)))) for x in vector]
        usable[key] = min(usable.get(key, ints), ints)
    out = []
    for q, a in usable.items():
        if q % 5 == 0:
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True)))), c) for c, b in usable.items() if c != q and len(a) == len(b)]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clusters", "ties", "large"])
def test_search_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK_ROWS", 32)
    monkeypatch.setattr(pivot_index, "QUERY_ROWS", 8)
    rng = np.random.default_rng(7)
    vectors = {"random": rng.normal(size=(400, 8)), "clusters": np.repeat(rng.normal(size=(8, 8)) * 9, 50, axis=0) + rng.normal(size=(400, 8)) / 20,
               "ties": np.tile(rng.integers(-1, 2, (4, 8)), (100, 1)).astype(float), "large": rng.normal(size=(400, 8)) * 1e9}[kind]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(500, None), (505, [1.0, None] + [0.0] * 6), (510, [float("nan")] * 8), (515, [float("inf")] * 8), (None, [1.0] * 8), (5, [0.5] * 8), (520, [1.0, 2.0]), (521, [3.0, 4.0]), (525, [])]
    table = spark.createDataFrame([(*r, 0.0, "c") for r in rows], "vec_id long, embedding array<double>, distance double, cell string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_index.search(table, F.col("vec_id") % 5 == 0, 5).collect())
    assert got == brute(rows, 5)


def test_search_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_index.search(table, F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_leave_blocks_out(spark):
    """In well separated clusters most annuli are never visited."""
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(20, 8)) * 50, 40, axis=0) + rng.normal(size=(800, 8))
    pivots = pivot_index.Pivots(np.floor(vectors * 256).astype(int).tolist(), {8: float((np.floor(vectors * 256) ** 2).sum(axis=1).max())}, 20)
    assert len(pivots.centres[8]) == 20


def test_pipeline_stages(spark, tmp_path, docs, rows):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    passage = " ".join(rows[30][1].split()[:40]) if len(rows[30][1].split()) >= 40 else rows[30][1]
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, table, str(tmp_path)), name)
        assert after.columns == table.columns
        kept[name], table = {r["doc_id"]: r["text"] for r in after.collect()}, after
    assert not {0, 1, 2, 4, 5} & set(kept["language_id"]) and 6 in kept["language_id"]
    assert 7 not in kept["near_duplicates"] and 8 not in kept["near_duplicates"]
    assert 30 not in kept["decontamination"]
    assert "[EMAIL]" in kept["personal_data"][14] and "[CARD]" in kept["personal_data"][14]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept["personal_data"])


def test_pipeline_of_nothing(spark, tmp_path, no_docs):
    no_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
