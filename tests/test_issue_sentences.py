"""Sentences of red failures: whole evidence in bounded parts, detail in the text."""

import re

from pyspark.sql import functions as F

from docketry import values as V
from docketry.operators import verification as X


def drafted(spark, n_hot):
    """Case 1 cites very many articles that nobody recommended, case 2 one, case 3 none that is not on the list."""
    paragraphs = spark.createDataFrame(
        [(1, "按洗錢防制法第條規定", [f"洗錢防制法第{i}條" for i in range(1, n_hot + 1)], ["C1"]), (2, "並無違誤", ["廢棄物清理法第7條"], []), (3, "無", ["洗錢防制法第1條"], ["C1"])],
        "case_id long, text string, cites array<string>, responds_to array<string>")
    laws = spark.createDataFrame([(c, "洗錢防制法第1條") for c in (1, 2, 3)], "case_id long, citation string") \
        .select("*", *[F.lit(None).cast("string").alias(c) for c in ("law", "article", "title", "text", "source")])
    drafts = spark.createDataFrame([(1, "訴願駁回。", "得提起救濟"), (2, "原處分撤銷。", ""), (3, "訴願駁回。", V.REMEDY_NOTICE)], "case_id long, main string, remedy_notice string")
    cases = drafts.select("case_id", F.lit("112年1月1日").alias("act_date"), F.lit("2023-01-02").cast("date").alias("_service"), F.lit("2023-03-02").cast("date").alias("_filed"), "main")
    versions = spark.createDataFrame([("廢棄物清理法第7條", "2024-01-01")], "citation string, start string").selectExpr("citation", "CAST(start AS date) AS effective_from", "CAST(NULL AS date) AS repealed_on")
    claims = spark.createDataFrame([(c, "C1") for c in (1, 2, 3)], "case_id long, claim_id string")
    facts = X.paragraph_facts(paragraphs)
    items = X.cited_items(facts, X.allowed_items(laws))
    checks = [*X.citation_set_checks(items), X.v3_article_format(facts), X.v4_claim_coverage(claims, facts), X.v5_effective_at_act(cases, items, versions),
              X.v7_period_recheck(cases), X.v8_remedy_notice(drafts), X.v9_ruling_consistency(drafts, facts)]
    return X.judge(cases, checks), checks


def test_detail_and_evidence(spark):
    judged, checks = drafted(spark, 3)
    rows = {(r["case_id"], r["check_id"]): r["sentence"] for r in X.issue_sentences(judged, checks).collect()}
    name, hint = V.CHECK_NAMES, V.FIX_HINTS
    assert rows[2, "V1"] == f"{name['V1']}未通過：有 1 項引用不在可引用清單內，須確認是否捏造。（涉及：['廢棄物清理法第7條']）{hint['V1']}"
    assert rows[1, "V1"].count("洗錢防制法第") == 2
    assert rows[1, "V3"] == f"{name['V3']}未通過：內文有 1 處條號寫法不完整（如「條之」缺數字）。（涉及：['按洗錢防制法第條規定']）{hint['V3']}"
    assert rows[2, "V4"] == f"{name['V4']}未通過：共 1 項主張，1 項未獲回應。（涉及：['C1']）{hint['V4']}"
    assert rows[2, "V5"] == f"{name['V5']}未通過：有 1 項引用於行為日（2023-01-01）尚未生效或已刪除。（涉及：['廢棄物清理法第7條']）{hint['V5']}"
    assert rows[3, "V7"] == f"{name['V7']}未通過：送達 2023-01-02 → 提起 2023-03-02，經過 59 日（法定 30 日）。 已逾法定期間，但主文非「不受理」，請確認是否漏判逾期。{hint['V7']}"
    assert rows[1, "V8"].startswith(f"{name['V8']}未通過：教示未載明") and "（涉及：['教示未載明" in rows[1, "V8"]
    assert rows[2, "V9"] == f"{name['V9']}未通過：主文為「原處分撤銷。」，但理由出現相反結論用語 ['並無違誤']。（涉及：['並無違誤']）{hint['V9']}"
    assert {key for key in rows if key[0] == 3} == {(3, "V7")}
    report = {r["case_id"]: r for r in X.verification_report(judged).collect()}
    assert report[3]["issues"] == rows[3, "V7"] and report[2]["blocking"] == "V1,V4,V5,V7,V9"


def test_parts_of_a_large_case_hold_every_item_once(spark):
    judged, checks = drafted(spark, 3000)
    parts = X.issue_sentences(judged, checks, width=50).filter("case_id = 1 AND check_id = 'V1'").collect()
    assert len(parts) == 60 and max(p["n_items"] for p in parts) < 100
    found = [article for p in parts for article in re.findall(r"'洗錢防制法第(\d+)條'", p["sentence"])]
    assert sorted(map(int, found)) == list(range(2, 3001))
    assert all("有 2999 項" in p["sentence"] for p in parts)


def test_lists_quote_as_they_must(spark):
    row = spark.createDataFrame([(["a", "b['c']"],)], "x array<string>").select(X._py_list(F.col("x")).alias("x")).head()
    assert row["x"] == """['a', "b['c']"]"""
