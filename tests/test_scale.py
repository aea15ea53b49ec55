"""Hot keys, many blocks, whole results: against brute force in plain Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketry.functions import pii, text as T
from docketry.operators import cosine_index, evaluation, intake, retrieval, verification as X
from docketry.sources import files
from docketry.streaming import arrivals


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, 16)).astype("float32")
    out[5] = out[3]          # exact copies
    out[9] = out[3]
    return out


def clustered(n, seed):
    """Tight groups, one of them with a third of all vectors, two vectors without a length."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 16))
    v = np.stack([centres[0 if i % 3 == 0 else i % 8] + rng.normal(scale=0.02, size=16) for i in range(n)]).astype("float32")
    v[7], v[8] = 0, 1e-6
    return v


@pytest.mark.parametrize("make, n, blocks", [(vectors, 120, True), (clustered, 120, True), (clustered, 5000, False)])
def test_blocked_search_equals_brute_force(spark, monkeypatch, make, n, blocks):
    if blocks:
        monkeypatch.setattr(cosine_index, "PACKET", 7)
        monkeypatch.setattr(cosine_index, "BLOCK", 11)
        monkeypatch.setattr(cosine_index, "PAGE", 3)
        monkeypatch.setattr(cosine_index, "SPLIT", 50)
    v = make(n, 1)
    # two thirds of the corpus lie in one bucket
    bucket = ["hot" if i % 3 else "cold" for i in range(len(v))]
    corpus = spark.createDataFrame([(i, [float(x) for x in v[i]], bucket[i]) for i in range(len(v))], "doc_id bigint, vec array<float>, bucket string")
    asked = corpus.select(F.col("doc_id").alias("query_id"), "vec")
    for wanted in (["hot"], ["cold", "hot"], ["none", "cold"]):
        got = retrieval.cosine_topk(retrieval.ask(asked, T.lits(wanted), 6), corpus).collect()
        found = {}
        for row in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(row["query_id"], []).append(row["doc_id"])
        d = v.astype("float64")
        s = np.round(d @ d.T / (np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1)) + 1e-9), 9)
        for q in range(0, len(v), 1 if blocks else 97):
            allowed = [i for i in range(len(v)) if i != q and bucket[i] in wanted]
            assert found[q] == sorted(allowed, key=lambda i: (-s[q, i], i))[:6]


def many(kind):
    """20,000 vectors: tight groups, or without any order; some without a length, a thousand copies of one."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(20_000, 16))
    if kind == "groups":
        v = rng.normal(size=(100, 16))[np.arange(20_000) % 100] + rng.normal(scale=0.05, size=(20_000, 16))
    v[100:1100], v[50], v[51] = v[100], 0, 1e-7
    return v


@pytest.mark.parametrize("kind, share", [("groups", 0.05), ("random", 1.0)])
def test_bounds_close_blocks_and_lose_nothing(spark, monkeypatch, kind, share):
    """Every 50th vector asks all 20,000; in groups most blocks are closed, without any order hardly one is."""
    monkeypatch.setattr(cosine_index, "BLOCK", 512)
    counted, visits = [], cosine_index.visits

    def counting(*args):
        out = visits(*args).cache()
        counted.append(out.count())
        return out

    made, build = [], cosine_index.build

    def building(corpus):
        out = build(corpus)
        made.append(out.filter("n is not null").count())
        return out

    monkeypatch.setattr(cosine_index, "visits", counting)
    monkeypatch.setattr(cosine_index, "build", building)
    v = many(kind)
    corpus = spark.createDataFrame([(i, x.tolist(), "all") for i, x in enumerate(v)], "doc_id bigint, vec array<double>, bucket string").repartition(4)
    asked = corpus.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    found = {}
    for row in retrieval.cosine_topk(retrieval.ask(asked, T.lits(["all"]), 10), corpus).orderBy("rank").collect():
        found.setdefault(row["query_id"], []).append((row["doc_id"], row["score"]))
    norms = np.linalg.norm(v, axis=1)
    for q in range(0, 20_000, 50):
        scores = np.round(v[q] @ v.T / (norms[q] * norms + 1e-9), 9)
        scores[q] = -np.inf
        assert [i for i, _ in found[q]] == np.lexsort((np.arange(len(v)), -scores))[:10].tolist()
    assert counted[0] <= 3 * 400 and counted[1] <= share * 400 * made[0], (counted, made)
    print(kind, counted, made)


def test_a_query_moves_to_groups_of_blocks(spark, monkeypatch):
    """Without any order no block closes; still a query moves once for each group, of which a bucket has a fixed number."""
    monkeypatch.setattr(cosine_index, "BLOCK", 64)
    moved, visits = [], cosine_index.visits

    def counting(*args):
        out = visits(*args).cache()
        moved.append(out.toPandas()["query_ids"].map(len).sum())
        return out

    monkeypatch.setattr(cosine_index, "visits", counting)
    v = vectors(6000, 3)
    corpus = spark.createDataFrame([(i, x.tolist(), "all") for i, x in enumerate(v)], "doc_id bigint, vec array<float>, bucket string")
    asked = corpus.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    got = retrieval.cosine_topk(retrieval.ask(asked, T.lits(["all"]), 5), corpus)
    d = v.astype("float64")
    norms = np.linalg.norm(d, axis=1)
    found = {}
    for row in got.orderBy("rank").collect():
        found.setdefault(row["query_id"], []).append(row["doc_id"])
    for q in range(0, 6000, 10):
        scores = np.round(d[q] @ d.T / (norms[q] * norms + 1e-9), 9)
        scores[q] = -np.inf
        assert found[q] == np.lexsort((np.arange(len(v)), -scores))[:5].tolist()
    assert sum(moved) <= 600 * (cosine_index.GRID + 2), moved


@pytest.mark.parametrize("n", [700, 4200])
def test_layers_and_buckets_ride_with_one_vector(spark, monkeypatch, n):
    """Two layers over four buckets: a query moves once for each group, whatever the number of vectors, buckets and layers, and in its own precision."""
    monkeypatch.setattr(cosine_index, "BLOCK", 32)
    moved, visits, copied, hits, wide, build = [], cosine_index.visits, [], cosine_index.hits, [], cosine_index.build

    def counting(*args):
        out = visits(*args).cache()
        moved.append(out.toPandas()["query_ids"].map(len).sum())
        return out

    def copying(visited, blocks, listed, copies, *rest):
        copied.append(copies)
        return hits(visited, blocks, listed, copies, *rest)

    def building(corpus):
        out = build(corpus)
        wide.extend(r[0] for r in out.select(F.octet_length("vec")).distinct().collect())
        return out

    for name, wrapped in (("visits", counting), ("hits", copying), ("build", building)):
        monkeypatch.setattr(cosine_index, name, wrapped)
    v, kinds = vectors(n, 4), ["law", "common_law", "interpretation", "judgment", "decision"]
    corpus = spark.createDataFrame([(i, x.tolist(), kinds[i % 5], "waste") for i, x in enumerate(v)], "doc_id bigint, vec array<float>, doc_type string, doc_route string")
    asked = corpus.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    found = {}
    for row in retrieval.layered_search(asked, corpus).orderBy("rank").collect():
        found.setdefault((row["query_id"], row["layer"]), []).append((row["doc_id"], row["score"]))
    d = v.astype("float64")
    norms = np.linalg.norm(d, axis=1)
    for q in range(0, n, 7):
        scores = np.round(d[q] @ d.T / (norms[q] * norms + 1e-9), 9)
        for layer, wanted, k in (("law", (0, 1), 5), ("reference", (2, 3), 2)):
            allowed = [i for i in np.lexsort((np.arange(n), -scores)).tolist() if i != q and i % 5 in wanted][:k]
            assert [i for i, _ in found[q, layer]] == allowed
            assert np.abs(np.array([s for _, s in found[q, layer]]) - scores[allowed]).max() < 2e-9
    assert moved[-1] <= n / 7 * cosine_index.GRID, moved
    assert copied[-1] <= cosine_index.SPOTS, copied
    assert wide == [4 * 16]


def test_full_groups_are_cut_further(spark, monkeypatch):
    """A group holds a bounded number of bytes; queries of double precision meet vectors of single precision."""
    monkeypatch.setattr(cosine_index, "BLOCK", 16)
    monkeypatch.setattr(cosine_index, "HELD", 64 * 64)
    made, directory = [], cosine_index.directory

    def listing(*args):
        out = directory(*args)
        made.extend(r[0] for r in out.groupBy("group").agg(F.sum("n")).collect())
        return out

    monkeypatch.setattr(cosine_index, "directory", listing)
    v = vectors(500, 5)
    corpus = spark.createDataFrame([(i, x.tolist(), "all" if i % 2 else "other") for i, x in enumerate(v)], "doc_id bigint, vec array<float>, bucket string")
    exact = v.astype("float64") + 1e-9
    asked = spark.createDataFrame([(i, exact[i].tolist()) for i in range(0, 500, 5)], "query_id bigint, vec array<double>")
    found = {}
    for row in retrieval.cosine_topk(retrieval.ask(asked, T.lits(["all", "other"]), 4), corpus).orderBy("rank").collect():
        found.setdefault(row["query_id"], []).append(row["doc_id"])
    d = v.astype("float64")
    for q in range(0, 500, 5):
        scores = np.round(exact[q] @ d.T / (np.linalg.norm(exact[q]) * np.linalg.norm(d, axis=1) + 1e-9), 9)
        scores[q] = -np.inf
        assert found[q] == np.lexsort((np.arange(500), -scores))[:4].tolist()
    assert len(made) >= 8 and max(made) <= 64 + 16, made


def test_case_flow_runs_the_gate_once_for_both_searches(spark, monkeypatch):
    """What asks is read by two searches, several times each; none of them may go back to the cases."""
    asking = []
    for name in ("find_similar", "layered_search"):
        def noted(vectors, corpus, *rest, real=getattr(retrieval, name)):
            asking.append(vectors.inputFiles())
            return real(vectors, corpus, *rest)
        monkeypatch.setattr(retrieval, name, noted)
    from __spark_entry__ import queries
    queries()["case_disposition_flow"](spark, "/root/testdata/sf0.001")
    assert len(asking) == 2 and asking[0] == asking[1]
    assert not [f for files in asking for f in files if "orders" in f], asking


def test_no_vector_beats_the_bound():
    rng = np.random.default_rng(2)
    for scale in (1e-12, 1e-6, 1.0, 1e6):
        docs = np.concatenate([rng.normal(size=(200, 6)), np.zeros((1, 6)), rng.normal(size=(3, 6)) * 1e-9]) * scale
        queries = np.concatenate([rng.normal(size=(50, 6)), docs[:20], np.zeros((1, 6))])
        units = cosine_index.unit(docs)
        centre = cosine_index.unit(units.mean(axis=0))
        cosines, norms = units @ centre, np.linalg.norm(docs, axis=1)
        bound = cosine_index.highest(queries, centre[None], cosines.min(keepdims=True), cosines.max(keepdims=True), norms.min(keepdims=True))
        scores = np.round(queries @ docs.T / (np.outer(np.linalg.norm(queries, axis=1), norms) + 1e-9), 9)
        assert (scores.max(axis=1) <= bound[:, 0]).all()


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0])]
    corpus = spark.createDataFrame([(*r, "b") for r in rows], "doc_id bigint, vec array<double>, bucket string")
    asked = corpus.select(F.col("doc_id").alias("query_id"), "vec")
    got = retrieval.cosine_topk(retrieval.ask(asked, T.lits(["b", "c"]), 5), corpus).collect()
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in got) == [(1, 2, 1), (1, 6, 2), (2, 1, 1), (2, 6, 2), (6, 1, 1), (6, 2, 2)]


def test_search_over_nothing_is_empty(spark):
    corpus = spark.createDataFrame([], "doc_id bigint, vec array<float>, bucket string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vec array<float>")
    assert retrieval.cosine_topk(retrieval.ask(asked, T.lits(["x"]), 3), corpus).count() == 0


def test_fallback_only_for_queries_without_a_hit(spark):
    v = vectors(12, 2)
    rows = [(i, [float(x) for x in v[i]], "law", "waste" if i else "noise") for i in range(len(v))]
    corpus = spark.createDataFrame(rows, "doc_id bigint, vec array<float>, doc_type string, doc_route string")
    asked = corpus.select(F.col("doc_id").alias("query_id"), "vec", F.col("doc_route").alias("query_route"), retrieval.corpus_bucket(True).alias("own_bucket"))
    got = retrieval.search_with_fallback(asked, corpus, ["law"], False, F.col("query_route"), 3).collect()
    layers = {r["query_id"]: r["layer"] for r in got}
    # the only 'noise' document is the query itself: its filter finds nothing
    assert layers[0] == "fallback" and all(layers[i] == "filtered" for i in range(1, 12))
    assert all(r["doc_id"] != 0 for r in got if r["query_id"] != 0)


def test_boost_never_lowers_a_score(spark):
    hits = spark.createDataFrame([(1, "a", d, 0.1 * d, 10 - d) for d in range(1, 9)], "query_id bigint, query_route string, doc_id bigint, score double, rank int")
    routes = spark.createDataFrame([(d, "a" if d % 2 else "b") for d in range(1, 9)], "doc_id bigint, doc_route string")
    for row in retrieval.rerank_similar(hits, routes, 8).collect():
        assert row["similarity"] >= round(row["score"], 4)
        assert row["route_match"] == row["doc_id"] % 2


def hot_paragraphs(n=3000):
    """A third of all paragraphs belong to one case."""
    rows = []
    for i in range(n):
        case = 0 if i % 3 == 0 else i
        rows.append((case, f"依訴願法第{i % 700 + 1}條", [f"訴願法§{i % 400 + 1}"] if i % 5 else [], [f"C{i % 4}"]))
    return pd.DataFrame(rows, columns=["case_id", "text", "cites", "responds_to"])


def test_set_checks_with_a_hot_case(spark):
    table = hot_paragraphs()
    paragraphs = spark.createDataFrame([tuple(r) for r in table.itertuples(index=False)], "case_id bigint, text string, cites array<string>, responds_to array<string>")
    cases = paragraphs.select("case_id").distinct()
    allowed = spark.createDataFrame([(c, f"訴願法第{k}條") for c in table.case_id.unique().tolist() for k in range(1, 40)], "case_id bigint, item string")
    items = X.cited_items(paragraphs, allowed)
    verdicts = {(r["case_id"], r["check_id"]): r for r in X.results(cases, *X.citation_set_checks(items)).collect()}
    evidence = {(r["case_id"], r["check_id"], r["item"]) for c in X.citation_set_checks(items) for r in c.evidence.collect()}
    white = {f"訴願法第{k}條" for k in range(1, 40)}
    for case, group in table.groupby("case_id"):
        declared = {c.replace("§", "第") + "條" for cites in group.cites for c in cites}
        inline = {t[1:] for t in group.text}
        v1, v2 = verdicts[(case, "V1")], verdicts[(case, "V2")]
        assert v1["n_evidence"] == len(declared - white) and v2["n_evidence"] == len(inline - declared)
        assert v1["status"] == ("skipped" if not declared else "fail" if declared - white else "pass")
        assert {i for c, k, i in evidence if (c, k) == (case, "V1")} == declared - white
        assert not {i for c, k, i in evidence if (c, k) == (case, "V1")} & white


def test_report_counts_add_up(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id bigint")
    paragraphs = spark.createDataFrame([(1, "依訴願法第77條", ["訴願法§77"], ["C1"])], "case_id bigint, text string, cites array<string>, responds_to array<string>")
    checks = [*X.citation_set_checks(X.cited_items(paragraphs)), X.v3_article_format(paragraphs), X.v4_claim_coverage(
        spark.createDataFrame([(1, "C1"), (1, "C2")], "case_id bigint, claim_id string"), paragraphs)]
    report = {r["case_id"]: r for r in X.verification_report(X.judge(cases, checks)).collect()}
    for row in report.values():
        assert row["passed"] + row["failed"] + row["skipped"] == row["total"] == 4
        assert row["red"] + row["amber"] == row["failed"]
    assert report[1]["blocking"] == "V4" and report[2]["skipped"] == 4


def plan_of(table):
    """The plan as it was run."""
    table.collect()
    return table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_tables_of_cases_are_never_broadcast(spark):
    """However small the files of a stage look, what has a row per case stays off the driver."""
    analysis = spark.range(50).selectExpr("id AS case_id", "id % 2 AS batch_id", "'x' AS detail")
    assert "Broadcast" not in plan_of(arrivals.latest(analysis, analysis))
    paragraphs = spark.createDataFrame([(c, "依訴願法第77條", ["訴願法§77"], ["C1"]) for c in range(50)], "case_id bigint, text string, cites array<string>, responds_to array<string>")
    findings = paragraphs.selectExpr("case_id", "'red' AS level", "'D1' AS check_id", "'事項不完備' AS title")
    drafts = paragraphs.selectExpr("case_id", "'訴願駁回。' AS main", "'' AS remedy_notice")
    claims = spark.range(50).selectExpr("id AS case_id", "'C1' AS claim_id")
    checks = [X.v3_article_format(paragraphs), X.v4_claim_coverage(claims, paragraphs), X.v8_remedy_notice(drafts), X.v9_ruling_consistency(drafts, paragraphs),
              X.v10_red_addressed(findings, paragraphs)]
    judged = X.judge(paragraphs.select("case_id"), checks)
    assert "Broadcast" not in plan_of(judged) and judged.count() == 50


def test_sums_of_a_check_carry_no_metrics_of_others(spark):
    cases = spark.range(20).selectExpr("id AS case_id").unionByName(spark.range(3).selectExpr("id AS case_id"))
    tables = [spark.range(40).selectExpr("id % 25 AS case_id", f"1 AS m{i}") for i in range(3)] + [spark.range(10).selectExpr("id AS case_id", "5 AS m2")]
    checks = [X.Check(f"T{i}", [table], F.lit("pass"), F.lit("red"), F.col(f"m{min(i, 2)}"), F.lit(0)) for i, table in enumerate(tables)]
    judged = X.judge(cases, checks)
    wide = [line for line in plan_of(judged).split("\n") if "partial_sum(m0" in line and "partial_sum(m1" in line]
    assert not wide
    found = {r["case_id"]: [c["n_items"] for c in r["checks"]] for r in judged.collect()}
    assert found == {c: [n, n, n + 5 * (c < 10), n + 5 * (c < 10)] for c in range(20) for n in [2 if c < 15 else 1]}


def test_dates_are_searched_once_for_verdict_and_evidence(spark):
    cases = spark.createDataFrame([(1, "民國113年1月1日")], "case_id bigint, filed_date string") \
        .selectExpr("*", "'' AS disposition_date", "'' AS service_date", "'' AS act_date")
    paragraphs = spark.createDataFrame([(1, "於民國113年1月1日、113年2月3日及113年2月3日")], "case_id bigint, text string")
    check = X.v6_ungrounded_dates(cases, paragraphs)
    assert "Generate" not in plan_of(check.evidence)
    (row,) = X.with_evidence(cases, check).collect()
    assert (row["status"], row["n_evidence"], row["item"]) == ("fail", 2, "113年2月3日")


def test_hot_packet_is_split_and_whole(spark):
    items = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS case_id", "'law' AS kind", "id AS item_key", "'x' || id AS payload")
    packets = intake.review_packet(items.unionByName(items), width=100)
    hot = packets.filter("case_id = 0")
    assert hot.agg(F.max("n_items")).head()[0] <= 100
    assert packets.agg(F.sum("n_items")).head()[0] == 5000
    # one key with very many payloads, of a case and of none
    one = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 END AS case_id", "'claim' AS kind", "CAST(3 AS bigint) AS item_key", "'x' || id AS payload")
    pieces = intake.review_packet(one, width=100)
    assert pieces.agg(F.max("n_items")).head()[0] <= 200 and pieces.count() == 200
    assert pieces.selectExpr("explode(from_json(items, 'array<string>')) AS x").distinct().count() == 20_000


def test_votes_of_a_hot_case(spark):
    votes = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS case_id", "CAST(id AS int) AS rank", "CASE id % 9 WHEN 0 THEN 'a' WHEN 3 THEN 'b' WHEN 6 THEN 'b' ELSE '' END AS label")
    top = {r["case_id"]: r["top"] for r in evaluation.top_disposition(votes).collect()}
    assert top == {0: "b"}
    tie = spark.createDataFrame([(1, 2, "x"), (1, 1, "y")], "case_id int, rank int, label string")
    assert evaluation.top_disposition(tie).head()["top"] == "y"


def test_hot_stem_and_hot_request(spark):
    docs = spark.range(900).selectExpr("'r' AS route", "'k' AS kind", "CASE WHEN id % 3 = 0 THEN '同 名/檔' ELSE 'n' || id END AS stem", "id AS seq", "'t' || id AS text", "'{}' AS metadata")
    kept = files.index_docs(docs)
    row = kept.filter("n_copies > 1").head()
    assert (row["stem"], row["n_copies"], row["text"]) == ("同_名_檔", 300, "t897") and kept.count() == 601
    asked = spark.range(900).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE 'q' || id END AS body", "CASE WHEN id < 6 THEN 1 ELSE 0 END AS is_mock")
    hot = arrivals.dedup_requests(asked, ["body"], ["id"]).filter("n_asked > 1").head()
    assert (hot["n_asked"], hot["id"]) == (300, 6)


def test_versions_are_half_open_and_may_repeat(spark):
    cases = spark.createDataFrame([(1, "民國89年1月1日"), (2, "民國90年1月1日"), (3, "民國80年1月1日"), (4, "")], "case_id bigint, act_date string")
    paragraphs = spark.createDataFrame([(c, "", ["訴願法§1"], []) for c in (1, 2, 3, 4)], "case_id bigint, text string, cites array<string>, responds_to array<string>")
    versions = spark.createDataFrame([("訴願法第1條", "1995-01-01", "2001-01-01"), ("訴願法第1條", "2000-06-01", "2001-01-01")], "citation string, a string, b string") \
        .selectExpr("citation", "date(a) AS effective_from", "date(b) AS repealed_on")
    check = X.v5_effective_at_act(cases, X.cited_items(paragraphs, inline=False), versions)
    assert {r["case_id"]: r["status"] for r in X.results(cases, check).collect()} == {1: "pass", 2: "fail", 3: "fail", 4: "skipped"}


def test_similar_cases_are_decisions_only(spark):
    """A law nearer than any decision is not a case."""
    rows = [(1, [1.0, 0.0], "decision", "waste"), (2, [1.0, 0.01], "law", "waste"), (3, [0.5, 1.0], "decision", "noise")]
    corpus = spark.createDataFrame(rows, "doc_id bigint, vec array<float>, doc_type string, doc_route string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "waste")], "query_id bigint, vec array<float>, query_route string")
    assert [r["doc_id"] for r in retrieval.find_similar(asked, corpus).collect()] == [3]


@pytest.mark.parametrize("head", ["訴願人 王小明", "沒有當事人"])
def test_masking_of_many_short_lines(spark, head):
    """Names below a party line are masked however many there are; no pattern may recurse over lines."""
    text = "\n".join([head, *["陳大文"] * 100_000, "以下為理由之說明文字", "林小華"])
    table = spark.createDataFrame([(text,)], "text string")
    masked, n = pii.mask_following_names(F.col("text"))
    row = table.select(masked.alias("text"), n.alias("n")).head()
    lines = row["text"].split("\n")
    if head.startswith("訴願人"):
        assert row["n"] == 100_000 and lines[1] == lines[100_000] == "陳○文" and lines[-1] == "林小華"
    else:
        assert row["n"] == 0 and row["text"] == text


def test_packets_keep_different_payloads_of_a_key(spark):
    items = spark.createDataFrame([(1, "law", 5, "a"), (1, "law", 5, "b"), (1, "law", 5, "a")], "case_id bigint, kind string, item_key bigint, payload string")
    (row,) = intake.review_packet(items).collect()
    assert row["n_items"] == 2 and row["items"] == '["a","b"]'


def test_request_key_ignores_the_order_of_columns(spark):
    row = spark.createDataFrame([("x", "y")], "a string, b string").select(arrivals.request_key("a", "b").alias("p"), arrivals.request_key("b", "a").alias("q")).head()
    assert row["p"] == row["q"]


def test_effective_state_with_very_many_versions(spark):
    """One citation with 100,000 versions that a third of all cases cite, open ends, gaps, overlaps, empty and unknown ones."""
    day = "date_add(DATE '1990-01-01', CAST({} AS int))".format
    many = spark.range(100_000).selectExpr("'hot' AS citation", f"{day('id % 9000 * 2')} AS effective_from", f"{day('id % 9000 * 2 + 1 + id % 3 % 2')} AS repealed_on")
    rows = [("open", "2001-01-01", None), ("open", "1995-01-01", "1996-01-01"), ("past", None, "2000-05-05"), ("all", None, None), ("empty", "2000-01-01", "2000-01-01"),
            ("turned", "2001-01-01", "2000-01-01"), ("two", "1992-03-01", "1999-12-31"), ("two", "1999-06-01", "2003-01-01"), ("two", "2004-02-29", "2004-03-01"), (None, None, None)]
    few = spark.createDataFrame(rows, "citation string, effective_from string, repealed_on string").selectExpr("citation", "CAST(effective_from AS date)", "CAST(repealed_on AS date)")
    versions = many.union(few).union(few)
    names = "array('hot', 'hot', 'open', 'past', 'all', 'empty', 'turned', 'two', 'none')"
    cited = spark.range(9000).selectExpr("id AS case_id", f"element_at({names}, CAST(id % 9 AS int) + 1) AS item", f"{day('id * 7 % 6000')} AS act")
    got = {r["case_id"]: r["state"] for r in X.effective_state(cited, versions).collect()}
    spans = {}
    for r in versions.distinct().collect():
        spans.setdefault(r["citation"], []).append((r["effective_from"], r["repealed_on"]))
    wanted = {}
    hot = {}
    for r in cited.collect():
        if (r["item"], r["act"]) not in hot:
            inside = any((a is None or a <= r["act"]) and (b is None or r["act"] < b) for a, b in spans.get(r["item"], []))
            hot[r["item"], r["act"]] = "unknown" if r["item"] not in spans else "effective" if inside else "not_effective"
        wanted[r["case_id"]] = hot[r["item"], r["act"]]
    assert got == wanted and set(got.values()) == {"effective", "not_effective", "unknown"}
    whole, yearly = X.effective_periods(versions)
    assert whole.groupBy("item").count().filter("count > 1").isEmpty() and yearly.selectExpr("max(size(periods))").first()[0] <= 183
