"""Votes, predictions against truth, review cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import text as T
from docketry.operators.intake import category_by_keywords


def top_disposition(votes: DataFrame) -> DataFrame:
    """Most frequent label per case; a tie goes to the label seen first.

    ``votes``: case_id, rank, label (null or '' does not count). Two partial aggregations, no window:
    a case with very many votes stays spread out.
    """
    counted = votes.filter(F.coalesce("label", F.lit("")) != "").groupBy("case_id", "label").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"))
    return counted.groupBy("case_id").agg(F.max_by("label", F.struct("n", (-F.col("first")).alias("f"))).alias("top"))


def reference_ruling(n_red: Column, top: Column) -> tuple[Column, Column]:
    """Ruling and its basis: red findings first, then the majority, then dismiss."""
    ruling = F.when(n_red > 0, V.REVOKE).otherwise(F.coalesce(top, F.lit(V.DISMISS)))
    basis = F.when(n_red > 0, F.format_string(V.BASIS_RED, n_red.cast("string"))) \
        .when(top.isNotNull(), F.format_string(V.BASIS_MAJORITY, top)) \
        .otherwise(V.BASIS_NONE)
    return ruling, basis


def majority_disposition(cases: DataFrame, votes: DataFrame, red_findings: DataFrame) -> DataFrame:
    """Reference ruling per case from its votes and its red findings, one row each."""
    reds = red_findings.groupBy("case_id").agg(F.count("*").alias("n_red"))
    joined = cases.select("case_id").join(top_disposition(votes), "case_id", "left").join(reds, "case_id", "left")
    ruling, basis = reference_ruling(F.coalesce("n_red", F.lit(0)), F.col("top"))
    return joined.select("case_id", ruling.alias("disposition"), basis.alias("basis"))


def majority_label(votes: DataFrame, key: str = "query_id") -> DataFrame:
    """Most frequent label per key; on a tie the label seen first."""
    counted = votes.groupBy(key, "label").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return counted.groupBy(key).agg(
        F.max_by("label", F.struct("n", (-F.col("first")).alias("f"))).alias("label"), F.max("n").alias("votes"))


def match_truth(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predictions with the truth of their case; ``truth`` has one row per key (see ``latest_truth``)."""
    return predictions.join(truth, key, "left")


def latest_truth(records: DataFrame, key: str, order: Column) -> DataFrame:
    """The last record per key wins, as a partial aggregation."""
    rest = [c for c in records.columns if c != key]
    last = records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("t"))
    return last.select(key, *[F.col(f"t.{c}").alias(c) for c in rest])


def confusion_matrix(matched: DataFrame) -> DataFrame:
    """``matched``: pred and truth, 1 = accepted; a null on either side is skipped."""
    p, t = F.col("pred"), F.col("truth")
    scored = p.isNotNull() & t.isNotNull()
    counts = matched.agg(
        F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 0) & (t == 0)).alias("tn"),
        F.count_if((p == 1) & (t == 0)).alias("fp"), F.count_if((p == 0) & (t == 1)).alias("fn"),
        F.count_if(scored & (p == t)).alias("correct"), F.count_if(scored & (p != t)).alias("wrong"),
        F.count_if(~scored).alias("skipped"),
    )
    total = F.col("correct") + F.col("wrong")
    return counts.withColumn("accuracy", F.round(F.when(total > 0, F.col("correct") * 100.0 / total), 1))


def error_list(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("pred") != F.col("truth"))


def unmatched_predictions(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    return predictions.join(truth.select(key), key, "left_anti")


def run_summary(results: DataFrame) -> DataFrame:
    """Cases per accept flag and category; failed runs (no flag) stay out."""
    ok = results.filter(F.col("accepted").isNotNull())
    name = F.coalesce(F.try_element_at(T.lit_map(V.CATEGORY_TEXT), F.col("category")), F.lit(""))
    return ok.groupBy("accepted", "category").agg(F.count("*").alias("n_cases")).withColumn("category_text", name)


def needs_review(label: Column, confidence: Column) -> Column:
    """The cheap result stands only for a confident rejection."""
    return label.isNull() | (label == 1) | F.coalesce(confidence != V.HIGH_CONFIDENCE, F.lit(True))


def cascade_review(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two-stage verdicts. ``first``: label, clause, reason, confidence; ``second``: label_2, clause_2, reason_2, one row per key."""
    joined = first.join(second, key, "left").withColumn("reviewed", needs_review(F.col("label"), F.col("confidence")).cast("int"))
    adopt = (F.col("reviewed") == 1) & F.col("label_2").isNotNull()

    def pick(name: str) -> Column:
        return F.when(adopt, F.col(f"{name}_2")).otherwise(F.col(name)).alias(f"final_{name}")

    used = F.when(F.col("reviewed") == 0, "first").when(adopt, "second").otherwise("first (no review result)")
    return joined.select(*joined.columns, pick("label"), pick("clause"), pick("reason"), used.alias("used"))


def review_share(cascade: DataFrame) -> DataFrame:
    return cascade.agg(F.count("*").alias("n_cases"), F.sum("reviewed").alias("n_reviewed"),
                       F.round(F.avg("reviewed"), 6).alias("share_reviewed"))


def capacity_guard(cascade: DataFrame) -> DataFrame:
    """Overrule a review that rejects for incapacity when the filer is of age or a company.

    Needs final_* of ``cascade_review`` plus is_adult, is_company, born, age. The adopted ground and
    reason follow the stage that is adopted.
    """
    capacity = F.startswith(F.replace(F.coalesce("clause_2", F.lit("")), F.lit(" "), F.lit("")), F.lit(V.CAPACITY_CLAUSE))
    adult, company = F.coalesce(F.col("is_adult") == 1, F.lit(False)), F.coalesce(F.col("is_company") == 1, F.lit(False))
    overruled = (F.col("reviewed") == 1) & F.coalesce(F.col("label_2") == 0, F.lit(False)) & capacity & (adult | company)
    note = F.format_string(
        V.CAPACITY_NOTE, F.coalesce("born", F.lit("None")), F.coalesce(F.col("age").cast("string"), F.lit("None")),
        F.when(adult, V.CAPACITY_ADULT).otherwise(""), F.when(company, V.CAPACITY_COMPANY).otherwise(""))
    staged = cascade.withColumn("overruled", overruled.cast("int"))
    back = F.col("overruled") == 1
    # a review without a verdict still is the second stage: its ground and reason are the adopted ones
    by_second = (F.col("reviewed") == 1) & ~back
    return staged.select(
        *[c for c in staged.columns if not c.startswith("final_")],
        F.when(back, F.col("label")).otherwise(F.col("final_label")).alias("final_label"),
        F.when(by_second, F.col("clause_2")).otherwise(F.col("clause")).alias("final_clause"),
        F.when(back, F.concat(F.coalesce("reason", F.lit("None")), note))
        .when(by_second, F.col("reason_2")).otherwise(F.col("reason")).alias("final_reason"),
    )


def category_gate(cases: DataFrame) -> DataFrame:
    """Category of accepted cases only. ``cases``: accepted, model_category, model_basis, text."""
    by_model = F.try_element_at(T.lit_map(V.MODEL_CATEGORY_TO_CODE), F.col("model_category"))
    rest = [c for c in cases.columns if c not in ("text", "model_basis")]
    cases = cases.withColumn("_k", category_by_keywords(F.col("text")))
    by_words, words = F.col("_k.category"), F.col("_k.basis")
    accepted = F.coalesce(F.col("accepted") == 1, F.lit(False))
    basis = F.when(by_model.isNotNull(), F.format_string(V.CATEGORY_BY_MODEL, "model_category", F.coalesce("model_basis", F.lit(""))))
    return cases.select(
        *rest,
        F.when(accepted, F.coalesce(by_model, by_words)).otherwise(V.CATEGORY_NONE).alias("category"),
        F.when(accepted, F.coalesce(basis, words)).otherwise(V.CATEGORY_NOT_ACCEPTED).alias("category_basis"),
    )
