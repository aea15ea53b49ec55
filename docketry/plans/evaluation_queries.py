"""Queries that hold predictions against truth, and the review cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import values as V
from docketry.operators import evaluation, intake
from docketry.plans.derive import roc
from docketry.plans.intake_queries import _CATEGORY, _CATEGORY_BASIS, _FLAT_DOCS
from docketry.plans.registry import query, sql_case


def _matched(t):
    truth = evaluation.latest_truth(t.labels.selectExpr("doc_id", "quality AS truth", "toxic"), "doc_id", F.col("truth"))
    predictions = t.verdicts.selectExpr("doc_id", "label AS pred", "clause", "reason")
    return evaluation.match_truth(predictions, truth, "doc_id")


_MATCH_SQL = """
truth AS (SELECT doc_id, quality AS truth FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC) = 1),
matched AS (SELECT v.doc_id, v.label AS pred, clause, reason, truth FROM verdicts v LEFT JOIN truth USING (doc_id))"""


@query("confusion_matrix", f"""WITH {_MATCH_SQL.strip()},
c AS (SELECT count(*) FILTER (pred = 1 AND truth = 1) AS tp, count(*) FILTER (pred = 0 AND truth = 0) AS tn, count(*) FILTER (pred = 1 AND truth = 0) AS fp, count(*) FILTER (pred = 0 AND truth = 1) AS fn,
  count(*) FILTER (pred = truth) AS correct, count(*) FILTER (pred <> truth) AS wrong, count(*) FILTER (pred IS NULL OR truth IS NULL) AS skipped FROM matched)
SELECT *, round(correct * 100.0::DOUBLE / (correct + wrong), 1) AS accuracy FROM c""", inputs=("verdicts",))
def confusion_matrix(spark, t):
    return evaluation.confusion_matrix(_matched(t))


@query("error_list", f"WITH {_MATCH_SQL.strip()} SELECT doc_id, pred, truth, clause, reason FROM matched WHERE pred <> truth", inputs=("verdicts",))
def error_list(spark, t):
    return evaluation.error_list(_matched(t)).select("doc_id", "pred", "truth", "clause", "reason")


@query("unmatched_predictions", "SELECT doc_id, label FROM verdicts WHERE doc_id NOT IN (SELECT doc_id FROM labels)", inputs=("verdicts",))
def unmatched_predictions(spark, t):
    return evaluation.unmatched_predictions(t.verdicts.select("doc_id", "label"), t.labels, "doc_id")


@query("run_summary", f"""
SELECT accepted, category, count(*) AS n_cases, {sql_case("CAST(category AS VARCHAR)", V.CATEGORY_TEXT, "''")} AS category_text FROM
 (SELECT CASE WHEN user_id % 10 = 0 THEN NULL WHEN value > 50 THEN 1 ELSE 0 END AS accepted, CASE WHEN value > 50 THEN CAST(event_id % 4 + 1 AS INT) ELSE 0 END AS category FROM events)
WHERE accepted IS NOT NULL GROUP BY ALL""")
def run_summary(spark, t):
    return evaluation.run_summary(t.events.selectExpr(
        "CASE WHEN user_id % 10 = 0 THEN NULL WHEN value > 50 THEN 1 ELSE 0 END AS accepted", "CASE WHEN value > 50 THEN CAST(event_id % 4 + 1 AS int) ELSE 0 END AS category"))


_CASCADE_SQL = """
j AS (SELECT *, CASE WHEN label IS NULL OR label = 1 OR coalesce(confidence <> '高', true) THEN 1 ELSE 0 END AS reviewed FROM verdicts LEFT JOIN reviews USING (doc_id)),
cascade_ AS (SELECT *, CASE WHEN reviewed = 1 AND label_2 IS NOT NULL THEN label_2 ELSE label END AS final_label, CASE WHEN reviewed = 1 AND label_2 IS NOT NULL THEN clause_2 ELSE clause END AS final_clause,
  CASE WHEN reviewed = 1 AND label_2 IS NOT NULL THEN reason_2 ELSE reason END AS final_reason,
  CASE WHEN reviewed = 0 THEN 'first' WHEN label_2 IS NOT NULL THEN 'second' ELSE 'first (no review result)' END AS used FROM j)"""


def _cascade(t):
    return evaluation.cascade_review(t.verdicts, t.reviews, "doc_id")


@query("cascade_review", f"WITH {_CASCADE_SQL.strip()} SELECT doc_id, reviewed, final_label, final_clause, final_reason, used FROM cascade_", inputs=("verdicts", "reviews"))
def cascade_review(spark, t):
    return _cascade(t).select("doc_id", "reviewed", "final_label", "final_clause", "final_reason", "used")


@query("review_share", f"WITH {_CASCADE_SQL.strip()} SELECT count(*) AS n_cases, CAST(sum(reviewed) AS BIGINT) AS n_reviewed, round(avg(reviewed), 6) AS share_reviewed FROM cascade_", inputs=("verdicts", "reviews"))
def review_share(spark, t):
    return evaluation.review_share(_cascade(t))


@query("capacity_guard", f"""WITH {_CASCADE_SQL.strip()},
p AS (SELECT d.*, {roc('born')} AS born_roc, date_sub('year', born, fil) AS age, CASE WHEN date_sub('year', born, fil) >= 18 THEN 1 ELSE 0 END AS is_adult, CASE WHEN cust_key % 10 = 0 THEN 1 ELSE 0 END AS is_company FROM case_days d),
g AS (SELECT c.*, born_roc, age, is_adult, is_company, CASE WHEN reviewed = 1 AND label_2 = 0 AND starts_with(replace(coalesce(clause_2, ''), ' ', ''), '77(4)') AND (is_adult = 1 OR is_company = 1) THEN 1 ELSE 0 END AS overruled
  FROM cascade_ c JOIN p ON p.case_id = c.doc_id)
SELECT doc_id, overruled, CASE WHEN overruled = 1 THEN label ELSE final_label END AS final_label, CASE WHEN reviewed = 1 AND overruled = 0 THEN clause_2 ELSE clause END AS final_clause,
  CASE WHEN overruled = 1 THEN reason || '【防呆】覆核以77(4)無訴願能力為由不受理,惟依訴願書所載出生年月日' || born_roc || '計算,提起訴願時為' || age || '歲' || CASE WHEN is_adult = 1 THEN '(已成年)' ELSE '' END
      || CASE WHEN is_company = 1 THEN '/訴願人為法人' ELSE '' END || ',訴願能力無欠缺,故不採用該覆核結論,回歸初判。'
    WHEN reviewed = 1 THEN reason_2 ELSE reason END AS final_reason FROM g""", inputs=("verdicts", "reviews", "case_days"))
def capacity_guard(spark, t):
    people = intake.with_age(t.case_days.selectExpr("case_id AS doc_id", f"{roc('born')} AS born", f"{roc('fil')} AS filed", "CASE WHEN cust_key % 10 = 0 THEN 1 ELSE 0 END AS is_company"))
    guarded = evaluation.capacity_guard(_cascade(t).join(people, "doc_id"))
    return guarded.select("doc_id", "overruled", "final_label", "final_clause", "final_reason")


@query("category_gate", f"""WITH {_FLAT_DOCS}, {_CATEGORY.strip()},
w AS (SELECT doc_id, CAST(label AS INT) AS by_words, {_CATEGORY_BASIS} AS words FROM cat JOIN flat USING (doc_id)),
c AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 0 WHEN d.doc_id % 17 = 0 THEN NULL ELSE 1 END AS accepted,
  CASE d.doc_id % 5 WHEN 0 THEN '洗錢防制法' WHEN 1 THEN '其餘案件' WHEN 2 THEN '建築' END AS model_category, by_words, words FROM topic_docs d JOIN w USING (doc_id))
SELECT doc_id, accepted, model_category, CASE WHEN coalesce(accepted, 0) = 0 THEN 0 WHEN model_category = '洗錢防制法' THEN 2 WHEN model_category = '其餘案件' THEN 4 ELSE by_words END AS category,
  CASE WHEN coalesce(accepted, 0) = 0 THEN '不受理案件,類別註記為0' WHEN model_category IN ('洗錢防制法', '其餘案件') THEN 'LLM判定:' || model_category || ';依據' || doc_id ELSE words END AS category_basis FROM c""", inputs=("topic_docs",))
def category_gate(spark, t):
    return evaluation.category_gate(t.topic_docs.selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 17 = 0 THEN NULL ELSE 1 END AS accepted",
        "CASE doc_id % 5 WHEN 0 THEN '洗錢防制法' WHEN 1 THEN '其餘案件' WHEN 2 THEN '建築' END AS model_category", "'依據' || doc_id AS model_basis", "text"))
