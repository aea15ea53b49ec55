"""Deadlines, procedural gates, defect checks, contract checks, triage rules, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import dates, labels, text as T
from docketry.functions.labels import contains_any, has_all
from docketry.functions.text import blank_to_null


def appeal_timeline(cases: DataFrame) -> DataFrame:
    """Parsed dates, effective service, filing deadline and end of the limitation period."""
    parsed = cases.select(
        *cases.columns,
        dates.parse_date(F.col("act_date")).alias("_act"),
        dates.parse_date(F.col("disposition_date")).alias("_disposition"),
        dates.parse_date(F.col("service_date")).alias("_service"),
        dates.parse_date(F.col("filed_date")).alias("_filed"),
    )
    return (
        parsed.withColumn("_effective", dates.service_effective(F.col("_service"), F.col("service_method")))
        .withColumn("_deadline", dates.appeal_deadline(F.col("_effective")))
        .withColumn("_limitation", dates.limitation_end(F.col("_act")))
        .withColumn("service_effective_date", dates.format_roc(F.col("_effective")))
        .withColumn("appeal_deadline", dates.format_roc(F.col("_deadline")))
        .withColumn("penalty_limitation_date", dates.format_roc(F.col("_limitation")))
    )


def procedure_gate(timeline: DataFrame) -> DataFrame:
    """Ordered procedural rules: late, revoked, decided before; everything else passes."""
    late = F.coalesce(F.col("_filed") > F.col("_deadline"), F.lit(False))
    overdue = F.when(late, F.date_diff("_filed", "_deadline"))
    gone = dates.is_true(F.col("revoked")) | dates.is_true(F.col("disposition_revoked"))
    clause = F.when(late, "77-2").when(gone, "77-6").when(dates.is_true(F.col("previously_decided")), "77-7")
    staged = timeline.withColumn("clause", clause).withColumn("overdue_days", overdue)
    late_text = F.format_string(V.GATE_REASONS["77-2"], dates.format_roc(F.col("_filed")), dates.format_roc(F.col("_deadline")), F.col("overdue_days").cast("string"))
    reason = F.when(F.col("clause") == "77-2", late_text).otherwise(F.try_element_at(T.lit_map(V.GATE_REASONS), F.col("clause")))
    return staged.withColumn("is_inadmissible", F.col("clause").isNotNull().cast("int")).withColumn("reason", reason)


def violations(columns: list[str]) -> Column:
    """Number of violations: ``repeat_count`` stands in where ``violation_count`` is missing or 0."""
    counts = [F.nullif(F.col("violation_count"), F.lit(0)), *[F.col("repeat_count")] * ("repeat_count" in columns)]
    return F.coalesce(*counts)


def defect_findings(n_violations: Column) -> Column:
    """Findings of one case as an array, in rule order; reads the columns of a timeline."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", name) for c, name in V.REQUIRED_FIELDS.items()]),
                       lambda m: m.isNotNull())
    no_basis = F.array_contains(missing, V.REQUIRED_FIELDS["legal_basis"])

    def finding(check: str, fires: Column, level: Column | str, *facts: Column) -> Column:
        """Struct of a rule that fires; its effect is suggested on the red level only."""
        title, basis, evidence, effect = V.FINDINGS[check]
        level = level if isinstance(level, Column) else F.lit(level)
        return F.when(F.coalesce(fires, F.lit(False)), F.struct(
            F.lit(check).alias("check_id"), level.alias("level"), F.lit(title).alias("title"), F.lit(basis).alias("basis"),
            (T.fill(evidence, *facts) if facts else F.lit(evidence)).alias("evidence"),
            F.when(level == "red", effect).otherwise("").alias("suggested_effect")))

    def roc(name: str) -> Column:
        return dates.format_roc(F.col(name))

    def number(value: Column | str) -> Column:
        return (F.col(value) if isinstance(value, str) else value).cast("string")

    rules = F.array(
        finding("D1", F.size(missing) > 0, F.when(no_basis, "red").otherwise("amber"), F.array_join(missing, "、")),
        finding("D2", F.col("_disposition") > F.col("_limitation"), "red", roc("_disposition"), roc("_limitation"),
                number(F.date_diff("_disposition", "_limitation"))),
        finding("D3", (F.coalesce("penalty_amount", F.lit(0)) != 0) & (n_violations > 1), "amber",
                number(n_violations), number("penalty_amount")),
        finding("D4", F.year("_disposition") - F.year("_act") >= 1, "amber", roc("_act"), roc("_disposition")),
        finding("D5", F.col("requires_prior_order") & ~F.coalesce("prior_order_done", F.lit(False)), "red"),
        finding("D6", F.col("_service").isNull(), "amber"),
    )
    return F.filter(rules, lambda f: f.isNotNull())


def defect_checks(timeline: DataFrame) -> DataFrame:
    """Long table of findings: one row per case and rule that fired, red rules ranked first."""
    fired = timeline.select("case_id", F.explode(defect_findings(violations(timeline.columns))).alias("f"))
    rank = F.when(F.col("f.level") == "red", 0).when(F.col("f.level") == "amber", 1).otherwise(2)
    return fired.select("case_id", rank.alias("level_rank"), "f.*")


def validate_contract(payloads: DataFrame) -> DataFrame:
    """Problems of a case payload; ``payloads`` carries has_* flags for the three required blocks."""
    route_ok = F.coalesce(F.col("route_key").isin(V.ROUTES), F.lit(False))
    version_ok = F.coalesce(F.col("schema_version") == V.SCHEMA_VERSION, F.lit(False))
    problems = F.filter(F.array(
        F.when(~version_ok, V.CONTRACT_VERSION % V.SCHEMA_VERSION),
        F.when(~route_ok, F.format_string(V.CONTRACT_ROUTE, F.coalesce("route_key", F.lit("None")))),
        *[F.when(~F.coalesce(F.col(f"has_{block}"), F.lit(False)), V.CONTRACT_MISSING % block)
          for block in ("admissibility", "extracted_fields", "raw_text")],
    ), lambda p: p.isNotNull())
    return payloads.withColumn("problems", problems).withColumn("is_valid", (F.size("problems") == 0).cast("int"))


def _holds(text: Column, alternatives: list[list[str]]) -> Column:
    """One alternative has all its words in the text."""
    tests = [has_all(text, *words) for words in alternatives]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _first_rule(records: DataFrame, rules: list[tuple[Column, str, Column | str]]) -> DataFrame:
    """Label, clause and reason of the first rule that holds; accepted when none does."""
    clause = reason = F.lit(None).cast("string")
    for test, number, text in reversed(rules):
        clause = F.when(test, number).otherwise(clause)
        reason = F.when(test, text).otherwise(reason)
    return records.withColumn("clause", clause).withColumn("reason", F.coalesce(reason, F.lit(V.TRIAGE_ACCEPT))) \
        .withColumn("label", F.col("clause").isNull().cast("int"))


def _first_date(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[dates.parse_date(blank_to_null(F.regexp_extract(text, pattern, 1))) for pattern in patterns])


def triage_rules(records: DataFrame) -> DataFrame:
    """Admissibility by text rules on ``narrative``; dates of the text first, component dates second."""
    text = F.coalesce(F.col("narrative"), F.lit(""))

    def component(name: str) -> Column:
        return _first_date(F.coalesce(F.col(name), F.lit("")), f"({V.TRIAGE_DATE})")

    staged = records.select(
        *records.columns,
        F.coalesce(_first_date(text, V.TRIAGE_SERVED), component("service_component")).alias("_served"),
        F.coalesce(_first_date(text, V.TRIAGE_FILED), component("filed_component")).alias("_filed"),
        F.coalesce(F.when(F.col("statutory_days") != 0, F.col("statutory_days")), F.lit(V.APPEAL_PERIOD_DAYS)).alias("_allowed"),
        F.regexp_extract(text, V.TRIAGE_STATUS, 1).alias("_status"),
    )
    rules = []
    for number, alternatives, reason in V.TRIAGE_RULES:
        test, shown = _holds(text, alternatives), F.lit(reason)
        if "%s" in reason:     # the clause that also looks at the quoted state of the disposition
            test = test | contains_any(F.col("_status"), V.GONE_WORDS)
            shown = F.format_string(reason, F.coalesce(blank_to_null(F.col("_status")), F.lit(V.TRIAGE_GONE_DEFAULT)))
        rules.append((test, number, shown))
    elapsed, allowed = F.date_diff("_filed", "_served"), F.col("_allowed")
    late = F.format_string(V.TRIAGE_LATE, allowed.cast("string"), elapsed.cast("string"), (elapsed - allowed).cast("string"))
    return _first_rule(staged, rules + [(F.coalesce(elapsed > allowed, F.lit(False)), "77(2)", late)])


def triage_rules_pdf(records: DataFrame) -> DataFrame:
    """The variant for full petition texts: conjunctions, and the stated number of days as a fallback."""
    staged = records.withColumn("_flat", T.drop_blanks(F.coalesce(F.col("text"), F.lit(""))))
    flat = F.col("_flat")
    staged = staged.select(
        *staged.columns, _first_date(flat, *V.PDF_SERVED).alias("_served"), _first_date(flat, *V.PDF_FILED).alias("_filed"),
        F.regexp_extract(flat, V.PDF_STATED, 1).try_cast("int").alias("_stated"))
    own = F.date_diff("_filed", "_served")
    elapsed = F.coalesce(own, F.col("_stated"))
    late = F.format_string(V.PDF_LATE, F.when(own.isNotNull(), V.PDF_LATE_OWN).otherwise(V.PDF_LATE_STATED),
                           elapsed.cast("string"), (elapsed - V.APPEAL_PERIOD_DAYS).cast("string"))
    rules = [(_holds(flat, alternatives), number, reason) for number, alternatives, reason in V.PDF_TRIAGE_RULES]
    return _first_rule(staged, rules + [(F.coalesce(elapsed > V.APPEAL_PERIOD_DAYS, F.lit(False)), "77(2)", late)])


def clause_template(cases: DataFrame) -> DataFrame:
    """Ruling text of an inadmissible case from the template of its clause.

    ``cases``: clause, reason, filed_date, service_effective_date, appeal_deadline.
    """
    known = labels.clause_number(F.col("clause"))
    dated = (F.coalesce("service_effective_date", F.lit("")) != "") & (F.coalesce("appeal_deadline", F.lit("")) != "") \
        & (F.coalesce("filed_date", F.lit("")) != "")
    overdue = F.when(dated, F.format_string(V.OVERDUE_DATED, "service_effective_date", "filed_date", "appeal_deadline")) \
        .otherwise(V.OVERDUE_UNDATED)
    generic = F.concat(F.lit(V.CLAUSE_GENERIC_TEXT), F.when(
        F.coalesce("reason", F.lit("")) != "", F.format_string(V.CLAUSE_UPSTREAM, "reason")).otherwise(""))
    texts = {number: text for number, (_, text) in V.CLAUSE_TEMPLATES.items()}
    cites = {number: "；".join(found) for number, (found, _) in V.CLAUSE_TEMPLATES.items()}
    staged = cases.withColumn("clause_no", known)
    return staged.select(
        *cases.columns, "clause_no",
        F.coalesce(F.replace(F.try_element_at(T.lit_map(texts), F.col("clause_no")), F.lit("{overdue}"), overdue), generic).alias("text"),
        F.coalesce(F.try_element_at(T.lit_map(cites), F.col("clause_no")), F.lit(V.CLAUSE_GENERIC_CITE)).alias("cites"),
        F.lit(V.REMEDY_NOTICE).alias("remedy_notice"), F.lit(V.INADMISSIBLE + "。").alias("main"),
        F.col("clause_no").isNull().cast("int").alias("needs_human_review"),
    )
