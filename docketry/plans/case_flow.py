"""The whole review of cases as one plan: contract, gate, findings, similar cases, reference ruling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import values as V
from docketry.operators import evaluation, intake, rules


def review_cases(cases: DataFrame, similar_votes: Callable[[DataFrame], DataFrame], recommended_laws: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """State and reference ruling of every case.

    ``cases``: the payload columns of the timeline, plus schema_version, route_key, has_* flags,
    is_admissible, note. ``similar_votes`` gets the open cases only, so that the search and the
    findings never run for cases that end at the gate; ``recommended_laws`` gets the same and gives case_id and citation,
    the whitelist of later checks, of which the review carries the number.
    """
    checked = rules.validate_contract(intake.normalize_missing(cases))
    gated = rules.procedure_gate(rules.appeal_timeline(checked))
    front = ~F.coalesce(F.col("is_admissible"), F.lit(True))
    state = F.when(F.col("is_valid") == 0, "error").when(front | (F.col("is_inadmissible") == 1), "inadmissible").otherwise("merits")
    staged = gated.withColumn("state", state).withColumn("front", front)
    asking = staged.filter(F.col("state") == "merits").select("case_id")
    votes = similar_votes(asking)
    n_laws = recommended_laws(asking).groupBy("case_id").agg(F.count("*").alias("n_laws"))
    is_open = F.col("state") == "merits"
    # findings belong to the row, so the open cases need neither a second pass nor a join for them
    n_red = F.size(F.filter(rules.defect_findings(rules.violations(staged.columns)), lambda f: f["level"] == "red"))
    joined = staged.withColumn("n_red", F.when(is_open, n_red)).join(evaluation.top_disposition(votes), "case_id", "left").join(n_laws, "case_id", "left")
    ruling, basis = evaluation.reference_ruling(F.col("n_red"), F.col("top"))
    return joined.select(
        "case_id", "state",
        F.when(is_open, ruling).when(F.col("state") == "inadmissible", V.INADMISSIBLE).alias("disposition"),
        F.when(is_open, basis)
        .when(F.col("state") == "error", F.array_join("problems", "；"))
        .when(F.col("front"), V.BASIS_FRONT)
        .otherwise(F.format_string(V.BASIS_GATE, "clause", "reason")).alias("basis"),
        F.coalesce("n_laws", F.lit(0)).cast("bigint").alias("n_laws"))
