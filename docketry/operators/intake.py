"""Intake: petitions, model replies, claims and the assembled case payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from docketry import values as V
from docketry.functions import citations, dates, labels, merging, text as T
from docketry.functions.text import blank_to_null


def normalize_missing(table: DataFrame) -> DataFrame:
    """Empty strings become null once, so that every rule tests null only."""
    return table.select(*[
        blank_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, S.StringType) else F.col(f.name)
        for f in table.schema.fields
    ])


def structure_petition(petitions: DataFrame) -> DataFrame:
    """Labelled fields of a petition text; what is not found is null."""
    text, flat = F.col("text"), F.col("_flat")

    def find(source: Column, pattern: str) -> Column:
        return blank_to_null(F.regexp_extract(source, pattern, 1))

    def section(start: str, ends: list[str]) -> Column:
        begin = F.locate(start, text)
        after = F.substr(text, begin + F.lit(len(start)))
        # the nearest end word: the lazy match stops before the first one
        return F.when(begin > 0, T.strip(F.regexp_extract(after, rf"(?s)^(.*?)(?:{'|'.join(ends)}|\z)", 1)))

    label = V.PETITION_AGENCY_LABEL
    front = F.when(F.contains(text, F.lit(label)), F.substring_index(text, label, 1)).otherwise(F.left(text, F.lit(600)))
    fields = petitions.withColumn("_flat", T.drop_blanks(text)).select(
        *petitions.columns,
        *[find(text, T.wide_blanks(pattern)).alias(name) for name, pattern in V.PETITION_RAW_PATTERNS.items()],
        *[find(flat, pattern).alias(name) for name, pattern in V.PETITION_FLAT_PATTERNS.items()],
        find(T.drop_blanks(front), V.PETITION_BIRTH_PATTERN).alias("born"),
        T.contains_any(flat, V.COMPANY_WORDS).cast("int").alias("is_company"),
        *[section(start, ends).alias(name) for name, (start, ends) in V.PETITION_SECTIONS.items()],
    )
    return with_age(fields)


def with_age(people: DataFrame) -> DataFrame:
    """Full years and the adult flag at filing, from the ``born`` and ``filed`` texts."""
    age = dates.full_years(dates.parse_date(F.col("born")), dates.parse_date(F.col("filed")))
    return people.withColumn("age", age).withColumn("is_adult", (F.col("age") >= V.ADULT_AGE).cast("int"))


def parse_model_json(replies: DataFrame, schema: str) -> DataFrame:
    """Stored model replies as a struct; both tolerant readings, null when neither parses."""
    fenced = F.from_json(T.fenced_json(F.col("reply")), schema, {"mode": "PERMISSIVE"})
    braced = F.from_json(T.braced_json(F.col("reply")), schema, {"mode": "PERMISSIVE"})
    return replies.select(*replies.columns, fenced.alias("fenced"), braced.alias("braced"))


def reply_rulings(replies: DataFrame) -> DataFrame:
    """The replies with the ruling (main) and the remedy notice they state; both null where a reply is no JSON or has none."""
    parsed = F.from_json(T.fenced_json(F.col("reply")), "struct<main:string,remedy_notice:string>")
    return replies.withColumn("said", parsed).select(*replies.columns, F.col("said.main").alias("main"), F.col("said.remedy_notice").alias("remedy_notice"))


def reply_paragraphs(replies: DataFrame) -> DataFrame:
    """One row per drafted paragraph; a reply that is no JSON is one paragraph itself."""
    item = "struct<text:string,responds_to:array<string>,cites:array<string>,based_on_case:string,source:string>"
    parsed = F.from_json(T.fenced_json(F.col("reply")), f"struct<paragraphs:array<{item}>>")["paragraphs"]
    none = F.array().cast("array<string>")
    whole = F.array(F.struct(F.col("reply").alias("text"), none.alias("responds_to"), none.alias("cites"),
                             F.lit("").alias("based_on_case"), F.lit("llm").alias("source")))
    keys = [c for c in replies.columns if c != "reply"]
    rows = replies.select(*keys, F.posexplode(F.coalesce(parsed, whole)).alias("pos", "p"))
    return rows.select(
        *keys, "pos", F.col("p.text").alias("text"),
        F.coalesce("p.responds_to", none).alias("responds_to"),
        citations.reconcile_cites(F.col("p.cites"), F.coalesce(F.col("p.text"), F.lit(""))).alias("cites"),
        F.coalesce("p.based_on_case", F.lit("")).alias("based_on_case"), F.coalesce("p.source", F.lit("llm")).alias("source"),
    )


#: what a model is asked for; claims come as objects or as plain texts, so each is read on its own
MODEL_FIELDS = (
    "petitioner struct<name:string,address:string,agent:string>, original_disposition struct<agency:string,date:string,doc_no:string,"
    "legal_basis:array<string>,penalty_amount:bigint,service_date:string,act_date:string>, petition_filed_date string, "
    "requests array<string>, claims array<string>, evidence_list array<string>")


def model_fields(replies: DataFrame) -> DataFrame:
    """The fields a model reply states, as columns instead of ``reply``; all null where a reply is no JSON object.

    Claims become structs of id, summary and quote: an id that is missing becomes C<n> by the claim's place, a plain text is a summary.
    """
    said = F.from_json(T.fenced_json(F.col("reply")), MODEL_FIELDS)
    keys = [c for c in replies.columns if c != "reply"]
    return replies.select(*keys, said.alias("_said")).select(*keys, "_said.*").withColumn("claims", F.transform("claims", _claim))


def _claim(raw: Column, at: Column) -> Column:
    number = F.concat(F.lit("C"), (at + 1).cast("string"))
    parsed = F.from_json(raw, "id string, summary string, quote string")
    said = T.bind(parsed, lambda c: F.struct(
        F.coalesce(blank_to_null(c["id"]), number).alias("id"), F.coalesce(c["summary"], F.lit("")).alias("summary"), F.coalesce(c["quote"], F.lit("")).alias("quote")))
    plain = F.struct(number.alias("id"), F.coalesce(raw, F.lit("")).alias("summary"), F.lit("").alias("quote"))
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")), said).otherwise(plain)


def merge_extracted_fields(by_pattern: DataFrame, by_model: DataFrame, key: str) -> DataFrame:
    """Fields of both layers, merged leaf by leaf as deep as their schemas go: the pattern layer wins, the model fills what it lacks.

    Every case of the pattern layer stays; the key is unique on both sides. Leaves that say nothing (empty texts, 0, empty arrays)
    are null in the result, see ``merging.filled`` and ``merging.merged``.
    """
    def prepared(table: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, S.DataType]]:
        kinds = {f.name: f.dataType for f in table.schema.fields if f.name != key}
        return table.select(key, *[merging.filled(F.col(c), kind).alias(prefix + c) for c, kind in kinds.items()]), kinds

    (left, first), (right, second) = prepared(by_pattern, "_p_"), prepared(by_model, "_m_")

    def field(name: str) -> Column:
        if name in first and name in second:
            return merging.merged(F.col(f"_p_{name}"), first[name], F.col(f"_m_{name}"), second[name])
        return F.col(f"_p_{name}" if name in first else f"_m_{name}")

    return left.join(right, key, "left").select(key, *[field(name).alias(name) for name in first | second])


def normalize_claims(claims: DataFrame) -> DataFrame:
    """``claims``: key columns and an array of structs; ids that are missing become C<n>."""
    keys = [c for c in claims.columns if c != "claims"]
    rows = claims.select(*keys, F.posexplode("claims").alias("pos", "claim"))
    return rows.select(
        *keys, (F.col("pos") + 1).alias("pos"),
        F.coalesce(blank_to_null(F.col("claim.id")), F.concat(F.lit("C"), (F.col("pos") + 1).cast("string"))).alias("claim_id"),
        F.coalesce("claim.summary", F.lit("")).alias("summary"), F.coalesce("claim.quote", F.lit("")).alias("quote"),
    )


def explode_claims(cases: DataFrame, column: str) -> DataFrame:
    keys = [c for c in cases.columns if c != column]
    rows = cases.select(*keys, F.explode(T.split_claims(F.col(column))).alias("c"))
    return rows.select(*keys, "c.claim_id", "c.summary", "c.quote")


def backfill_legal_basis(facts: Column, reasons: Column, full_text: Column) -> Column:
    joined = F.concat_ws("\n", blank_to_null(facts), blank_to_null(reasons), blank_to_null(full_text))
    return citations.citation_names(joined)


def case_type_of(text: Column) -> Column:
    """Struct<label, confidence> by keyword hits."""
    found = labels.keyword_label(text, V.CASE_TYPE_KEYWORDS, V.CASE_TYPE_NAME_BONUS, V.OTHER_LABEL)
    return T.bind(found, lambda k: F.struct(
        k["label"].alias("label"), F.least(F.lit(1.0), F.round(k["score"] / V.CONFIDENCE_DIVISOR, 2)).alias("confidence")))


def classify_by_keywords(documents: DataFrame) -> DataFrame:
    rest = [c for c in documents.columns if c != "text"]
    return documents.select(*rest, case_type_of(F.col("text")).alias("k")) \
        .select(*rest, F.col("k.label").alias("case_type"), F.col("k.confidence").alias("confidence"))


def category_by_keywords(text: Column) -> Column:
    """Struct<category, basis>: category code and the words it rests on."""
    found = T.bind(T.drop_blanks(F.coalesce(text, F.lit(""))), lambda flat: labels.keyword_label(
        flat, V.CATEGORY_KEYWORDS, V.CATEGORY_NAME_BONUS, V.CATEGORY_OTHER))
    return T.bind(found, lambda k: F.struct(
        k["label"].alias("category"),
        F.when(k["score"] == 0, V.CATEGORY_NO_HIT)
        .otherwise(F.format_string(V.CATEGORY_BY_WORDS, F.array_join(k["words"], ", "))).alias("basis")))


def route_of_label(label: Column) -> Column:
    return F.coalesce(F.try_element_at(T.lit_map(V.LABEL_TO_ROUTE), label), F.lit(V.DEFAULT_ROUTE))


def adapt_triage_to_case(triage: DataFrame) -> DataFrame:
    """Triage record to case payload: admissibility note, route with keyword fallback, fields.

    ``triage``: case_id, accepted, category, clause, reason, accept_note, petitioner, agency, issued,
    doc_no, received, filed, facts, reasons, full_text, request.
    """
    accepted = F.coalesce(F.col("accepted"), F.lit(1)) == 1
    why = F.coalesce(blank_to_null(F.col("reason")), F.col("accept_note"), F.lit(""))
    clause = blank_to_null(F.col("clause"))
    note = F.when(accepted, "").when(clause.isNotNull(), T.strip(F.concat(F.lit("（"), clause, F.lit("）"), why))).otherwise(why)
    triage = triage.withColumn("_k", case_type_of(F.coalesce(F.col("full_text"), F.lit(""))))
    keyword_label = F.col("_k.label")
    category = F.coalesce(F.col("category"), F.lit(V.CATEGORY_OTHER))
    label = F.coalesce(F.try_element_at(T.lit_map(V.CATEGORY_LABEL), category), keyword_label)
    route = F.coalesce(F.try_element_at(T.lit_map(V.CATEGORY_TO_ROUTE), category), route_of_label(keyword_label))
    return triage.select(
        F.lit(V.SCHEMA_VERSION).alias("schema_version"), F.coalesce("case_id", F.lit("")).alias("case_id"),
        F.struct(accepted.alias("is_admissible"), note.alias("note")).alias("admissibility"),
        F.struct(label.alias("label"), route.alias("route_key"), F.lit(0.0).alias("confidence"),
                 F.lit(False).alias("need_human_review")).alias("case_type"),
        F.struct(
            F.struct("petitioner").alias("petitioner"),
            F.struct("agency", F.col("issued").alias("date"), "doc_no",
                     backfill_legal_basis(F.col("facts"), F.col("reasons"), F.col("full_text")).alias("legal_basis"),
                     F.col("received").alias("service_date")).alias("original_disposition"),
            F.col("filed").alias("petition_filed_date"),
            F.filter(F.array("request"), lambda r: F.coalesce(r, F.lit("")) != "").alias("requests"),
            T.split_claims(F.col("reasons")).alias("claims"),
        ).alias("extracted_fields"),
        F.struct(F.col("full_text").alias("petition"),
                 F.concat(F.coalesce("facts", F.lit("")), F.lit("\n"), F.coalesce("reasons", F.lit(""))).alias("original_disposition_doc"),
                 ).alias("raw_text"),
    )


def assemble_intake(cases: DataFrame) -> DataFrame:
    """Route, confidence and review flag from the texts; ``cases``: case_id, petition, disposition_doc."""
    found = case_type_of(F.concat_ws(" ", F.coalesce("petition", F.lit("")), F.coalesce("disposition_doc", F.lit(""))))
    staged = cases.withColumn("_k", found).select(*cases.columns, "_k.label", "_k.confidence")
    return staged.select(
        *cases.columns, "label", route_of_label(F.col("label")).alias("route_key"), "confidence",
        (F.col("confidence") < V.CONFIDENCE_THRESHOLD).cast("int").alias("need_human_review"),
        T.document_number(F.coalesce("disposition_doc", F.lit(""))).alias("doc_no"),
        T.penalty_amount(F.coalesce("disposition_doc", F.lit(""))).alias("penalty_amount"),
    )


def assemble_payload(cases: DataFrame, replies: DataFrame, key: str = "case_id") -> DataFrame:
    """``assemble_intake`` with the fields of the model merged under those of the patterns, and the raw texts.

    ``cases``: key, petition, disposition_doc; ``replies``: key, reply, at most one per case. Adds extracted_fields (struct) and
    raw_text (struct of petition and original_disposition_doc, '' where missing).
    """
    found = assemble_intake(cases)
    by_pattern = found.select(key, F.struct("doc_no", "penalty_amount").alias("original_disposition"))
    fields = merge_extracted_fields(by_pattern, model_fields(replies.select(key, "reply")), key)
    raw = F.struct(F.coalesce("petition", F.lit("")).alias("petition"), F.coalesce("disposition_doc", F.lit("")).alias("original_disposition_doc"))
    return found.select(*[c for c in found.columns if c not in ("petition", "disposition_doc")], raw.alias("raw_text")).join(
        fields.select(key, F.struct(*[c for c in fields.columns if c != key]).alias("extracted_fields")), key)


def mask_answer_columns(records: DataFrame, answers: list[str] | None = None) -> DataFrame:
    """What a scorer may see: the answer columns are gone from the plan, not only from the output."""
    return records.drop(*(answers or V.ANSWER_COLUMNS))


def public_projection(cases: DataFrame) -> DataFrame:
    """Leave out the internal typed columns, which all start with an underscore."""
    return cases.select(*[c for c in cases.columns if not c.startswith("_")])


def build_query_text(doc: Column, petition: Column, claims: Column) -> Column:
    """Search text of a case, cut to what the search accepts."""
    summaries = F.array_join(F.transform(claims, lambda c: F.coalesce(c["summary"], F.lit(""))), " ")
    joined = F.concat(F.coalesce(doc, F.lit("")), F.lit("\n"), F.coalesce(petition, F.lit("")), F.lit("\n"), summaries)
    return F.left(T.strip(joined), F.lit(V.QUERY_LIMIT))


def search_requests(cases: DataFrame) -> DataFrame:
    """Search text and route per case; the route is classified from the texts where none is given.

    ``cases``: disposition_doc, petition, claims (array of structs with summary), route_key or null.
    """
    text = F.concat_ws(" ", F.coalesce("disposition_doc", F.lit("")), F.coalesce("petition", F.lit("")))
    rest = [c for c in cases.columns if c not in ("disposition_doc", "petition", "claims", "route_key")]
    return cases.select(
        *rest, build_query_text(F.col("disposition_doc"), F.col("petition"), F.col("claims")).alias("query_text"),
        F.coalesce(blank_to_null(F.col("route_key")), route_of_label(case_type_of(text)["label"])).alias("route_key"))


def review_packet(items: DataFrame, width: int = 1000) -> DataFrame:
    """All items of a case as JSON, in parts and pieces.

    ``items``: case_id, kind, item_key bigint, payload. Equal rows collapse in the first (partial) aggregation;
    different payloads of one key all stay. A part spans ``width`` keys; a part of more than ``width`` items is dealt by the hash of the payload
    to pieces of about that many, so that neither a case nor a key with any number of payloads gathers in a task.
    """
    group = ["case_id", "kind", "part"]
    once = items.select("case_id", "kind", "item_key", "payload").distinct().withColumn("part", F.expr(f"item_key div {width}"))
    large = once.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > width).select(*[F.col(c).alias(f"_{c}") for c in group], "_n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    piece = F.coalesce(F.pmod(F.xxhash64("payload"), F.ceil(F.col("_n") / width)), F.lit(0).cast("bigint"))
    return once.join(large, same, "left").select(*group, piece.alias("piece"), "item_key", "payload").groupBy(*group, "piece").agg(
        F.count("*").alias("n_items"),
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("item_key", "payload"))), lambda s: s["payload"])).alias("items"))


def packet_items(similar: DataFrame, findings: DataFrame) -> DataFrame:
    """Similar cases and findings of the cases as items of the packet.

    ``similar``: case_id, position, doc_id, similarity; ``findings``: case_id, check_id (D<n>), level, title, evidence.
    """
    cases = similar.select("case_id", F.lit("similar").alias("kind"), F.col("position").cast("bigint").alias("item_key"),
                           F.concat_ws(" ", F.col("doc_id").cast("string"), F.format_number("similarity", 4)).alias("payload"))
    defects = findings.select("case_id", F.lit("finding").alias("kind"), F.substring("check_id", 2, 9).cast("bigint").alias("item_key"),
                              F.concat_ws("：", "check_id", "level", "title", "evidence").alias("payload"))
    return cases.unionByName(defects)


def issue_profile(route: Column) -> Column:
    """Common issues of the route of the writer profile, as one text."""
    table = {route_key: "；".join(issues) for route_key, issues in V.ROUTE_ISSUES.items()}
    return F.coalesce(F.try_element_at(T.lit_map(table), route), F.lit(table[V.DEFAULT_ROUTE]))
