"""Queries over petitions, model replies, claims and case payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import text as T
from docketry.operators import intake, rules
from docketry.plans.derive import roc
from docketry.plans.registry import query, sql_case, sql_list
from docketry.plans.rule_queries import FINDINGS_SQL, timeline_of
from docketry.plans.search_queries import SIMILAR_SQL, similar_of
from docketry.plans.text_queries import _DOC_NO_2, _CJK, strip_sql


def _section(start: str, ends: list[str]) -> str:
    rest = f"substr(text, instr(text, '{start}') + {len(start)})"
    cuts = ", ".join(f"coalesce(nullif(instr({rest}, '{e}'), 0), length({rest}) + 1)" for e in ends)
    return f"CASE WHEN contains(text, '{start}') THEN {strip_sql(f'substr({rest}, 1, CAST(least({cuts}, length({rest}) + 1) AS INT) - 1)')} END"


_PETITION_SQL = f"""
f AS (SELECT *, regexp_replace(text, '[\\s　]+', '', 'g') AS flat, regexp_replace(substr(text, 1, instr(text, '原行政處分機關') - 1), '[\\s　]+', '', 'g') AS front FROM petition_rows),
fields AS (SELECT case_id, cust_key, text,
  nullif(regexp_extract(text, '訴願人[\\s　]*\\n?[\\s　]*([^\\n]{{1,30}}?)(?:\\n|民國|（)', 1), '') AS petitioner,
  nullif(regexp_extract(text, '原行政處分機關[\\s　]*\\n[\\s　]*([^\\n]+)', 1), '') AS agency, nullif(regexp_extract(text, '受理訴願機關[\\s　]*\\n[\\s　]*([^\\n]+)', 1), '') AS appeal_agency,
  nullif(regexp_extract(flat, '(新北\\S{{0,6}}字第[0-9]+號)', 1), '') AS doc_no, nullif(regexp_extract(flat, '發文日[:：]?(民國[0-9]+年[0-9]+月[0-9]+日)', 1), '') AS issued,
  nullif(regexp_extract(flat, '收受知悉行政處分之年月日(民國[0-9]+年[0-9]+月[0-9]+日)', 1), '') AS received,
  nullif(replace(regexp_extract(flat, '中華民國[0-9]+年[0-9]+月[0-9]+日'), '中華', ''), '') AS filed,
  nullif(regexp_extract(front, '(民國[0-9]+年[0-9]+月[0-9]+日)', 1), '') AS born,
  CASE WHEN contains(flat, '統一編號') OR contains(flat, '有限公司') THEN 1 ELSE 0 END AS is_company,
  nullif(regexp_extract(text, '訴願請求事項[:：][\\s　]*\\n?[\\s　]*([^\\n]+)', 1), '') AS request,
  {_section('事實：', ['理由：', '檢附之證據'])} AS facts, {_section('理由：', ['檢附之證據', '此致'])} AS reasons, {_section('檢附之證據或附件：', ['此致'])} AS evidence FROM f),
parts AS (SELECT *, CAST(regexp_extract(born, '民國([0-9]+)', 1) AS INT) AS b_y, CAST(regexp_extract(born, '年([0-9]+)', 1) AS INT) * 100 + CAST(regexp_extract(born, '月([0-9]+)', 1) AS INT) AS b_md,
  CAST(regexp_extract(filed, '民國([0-9]+)', 1) AS INT) AS f_y, CAST(regexp_extract(filed, '年([0-9]+)', 1) AS INT) * 100 + CAST(regexp_extract(filed, '月([0-9]+)', 1) AS INT) AS f_md FROM fields),
aged AS (SELECT case_id, cust_key, text, petitioner, agency, appeal_agency, doc_no, issued, received, filed, born, is_company, request, facts, reasons, evidence,
  f_y - b_y - CASE WHEN f_md < b_md THEN 1 ELSE 0 END AS age FROM parts),
petitions AS (SELECT *, CASE WHEN age >= 18 THEN 1 ELSE 0 END AS is_adult FROM aged)"""


@query("structure_petition", f"WITH {_PETITION_SQL.strip()} SELECT * FROM petitions", inputs=("petition_rows",))
def structure_petition(spark, t):
    return intake.structure_petition(t.petition_rows)


@query("compute_age", f"""
SELECT case_id, {roc('born')} AS born, {roc('fil')} AS filed, CAST(date_sub('year', born, fil) AS INT) AS age, CASE WHEN date_sub('year', born, fil) >= 18 THEN 1 ELSE 0 END AS is_adult
FROM case_days""", inputs=("case_days",))
def compute_age(spark, t):
    return intake.with_age(t.case_days.selectExpr("case_id", f"{roc('born')} AS born", f"{roc('fil')} AS filed"))


@query("parse_model_json", r"""
WITH f AS (SELECT event_id, reply, regexp_extract(reply, '(?s)```(?:json)?\s*(\{.*\})\s*```', 1) AS inner_, regexp_extract(reply, '(?s)\{.*\}') AS braced FROM replies),
g AS (SELECT event_id, CASE WHEN inner_ <> '' THEN inner_ ELSE trim(reply, ' ' || chr(10)) END AS fenced, nullif(braced, '') AS braced FROM f)
SELECT event_id, CASE WHEN json_valid(fenced) THEN CAST(json_extract_string(fenced, '$.k') AS INT) END AS fenced_k,
  CASE WHEN json_valid(braced) THEN CAST(json_extract_string(braced, '$.k') AS INT) END AS braced_k FROM g""", inputs=("replies",))
def parse_model_json(spark, t):
    return intake.parse_model_json(t.replies, "k int").select("event_id", F.col("fenced.k").alias("fenced_k"), F.col("braced.k").alias("braced_k"))


@query("reply_paragraphs", """
SELECT case_id, 0 AS pos, '按洗錢防制法第' || (case_id % 90 + 1) || '條及第9條規定' AS text,
  CASE WHEN user_id % 90 = case_id % 90 THEN '' ELSE '洗錢防制法第' || (user_id % 90 + 1) || '條；' END
  || CASE WHEN user_id % 90 + 1 = 9 AND case_id % 90 + 1 <> 9 THEN '洗錢防制法第' || (case_id % 90 + 1) || '條'
          WHEN case_id % 90 + 1 = 9 THEN '洗錢防制法第9條' ELSE '洗錢防制法第' || (case_id % 90 + 1) || '條；洗錢防制法第9條' END AS cites
FROM event_days""", inputs=("event_days",))
def reply_paragraphs(spark, t):
    rows = intake.reply_paragraphs(t.event_cases.select("case_id", "reply"))
    return rows.select("case_id", "pos", "text", F.array_join("cites", "；").alias("cites"))


def _reply_of(key: str, **disposition: str) -> Column:
    """A model reply per case: fenced, plain, padded, or no JSON at all; with empty leaves and claims of several forms."""
    leaf = lambda sql: F.expr(sql.replace("KEY", key))
    said = F.to_json(F.struct(
        F.struct(leaf("CASE WHEN KEY % 3 = 0 THEN '' ELSE '王' || KEY END").alias("name"), F.lit("板橋").alias("address"), F.lit("").alias("agent")).alias("petitioner"),
        F.struct(*[leaf(sql).alias(name) for name, sql in disposition.items()], F.array(F.lit(""), F.lit("洗錢防制法第22條")).alias("legal_basis")).alias("original_disposition"),
        leaf("CASE WHEN KEY % 2 = 0 THEN '113年1月1日' END").alias("petition_filed_date"),
        leaf("CASE WHEN KEY % 7 = 0 THEN array('') ELSE array('', '撤銷原處分', '另為處分') END").alias("requests"),
        F.array(F.struct(F.lit("").alias("id"), F.lit("違法").alias("summary"), F.lit(None).cast("string").alias("quote")),
                F.struct(F.lit("C9").alias("id"), F.lit("過重").alias("summary"), F.lit("摘句").alias("quote"))).alias("claims"),
        leaf("CASE WHEN KEY % 6 = 0 THEN array('照片') ELSE array() END").alias("evidence_list")))
    # one more claim as a plain text
    said = F.regexp_replace(said, r'("quote":"摘句"\})\]', '$1,"字串主張"]')
    return F.when(F.col(key) % 4 == 0, "無法判斷").when(F.col(key) % 4 == 1, F.concat(F.lit("說明\n```json\n"), said, F.lit("\n```\n完"))) \
        .when(F.col(key) % 4 == 2, said).otherwise(F.concat(F.lit("  "), said, F.lit("\n")))


def _merged_sql(key: str) -> str:
    said = f"{key} % 4 <> 0"
    return f"""CASE WHEN {said} AND {key} % 3 <> 0 THEN '王' || {key} END AS petitioner, CASE WHEN {said} THEN '板橋' END AS address,
  CASE WHEN {said} THEN '洗錢防制法第22條' END AS legal_basis, CASE WHEN {said} AND {key} % 2 = 0 THEN '113年1月1日' END AS filed,
  CASE WHEN {said} AND {key} % 7 <> 0 THEN '撤銷原處分；另為處分' END AS requests, CASE WHEN {said} THEN 'C1:違法:|C9:過重:摘句|C3:字串主張:' END AS claims,
  CASE WHEN {said} AND {key} % 6 = 0 THEN '照片' END AS evidence"""


def _flat_fields(fields: str = "") -> list:
    """The merged fields as texts."""
    at = lambda name: F.col(f"{fields}{name}")
    claims = F.transform(at("claims"), lambda c: F.concat_ws(":", c["id"], F.coalesce(c["summary"], F.lit("")), F.coalesce(c["quote"], F.lit(""))))
    return [at("petitioner.name").alias("petitioner"), at("petitioner.address").alias("address"), F.array_join(at("original_disposition.legal_basis"), "；").alias("legal_basis"),
            at("petition_filed_date").alias("filed"), F.array_join(at("requests"), "；").alias("requests"), F.array_join(claims, "|").alias("claims"), F.array_join(at("evidence_list"), "；").alias("evidence")]


@query("merge_extracted_fields", f"""
WITH p AS (SELECT o_orderkey AS case_id, {_DOC_NO_2} AS text FROM orders),
r AS (SELECT case_id, replace(regexp_extract(text, '({_CJK}{{2,8}}字第\\s*[0-9A-Za-z]+\\s*號)', 1), ' ', '') AS raw FROM p),
n AS (SELECT case_id, nullif(substr(raw, CAST(least(length(regexp_extract(raw, '^([{V.DOC_NO_LEADING}]*)', 1)), greatest(instr(raw, '字第') - 3, 0)) AS INT) + 1), '') AS doc_no FROM r)
SELECT case_id, coalesce(n.doc_no, CASE WHEN case_id % 4 <> 0 THEN nullif(c.doc_no, '') END) AS doc_no, CASE WHEN case_id % 4 <> 0 THEN c.penalty_amount END AS penalty_amount,
  CASE WHEN case_id % 4 <> 0 THEN nullif(agency, '') END AS agency, CASE WHEN case_id % 4 <> 0 THEN nullif(service_date, '') END AS service_date, {_merged_sql('case_id')}
FROM n JOIN cases c USING (case_id)""", inputs=("cases",))
def merge_extracted_fields(spark, t):
    texts = t.orders.selectExpr("o_orderkey AS case_id", f"{_DOC_NO_2} AS text")
    by_pattern = texts.select("case_id", F.struct(T.document_number(F.col("text")).alias("doc_no"), T.penalty_amount(F.col("text")).alias("penalty_amount")).alias("original_disposition"))
    replies = t.cases.select("case_id", _reply_of("case_id", doc_no="doc_no", penalty_amount="penalty_amount", agency="agency", service_date="service_date").alias("reply"))
    fields = intake.merge_extracted_fields(by_pattern, intake.model_fields(replies), "case_id")
    return fields.select("case_id", *[f"original_disposition.{c}" for c in ("doc_no", "penalty_amount", "agency", "service_date")], *_flat_fields())


@query("normalize_claims", """
SELECT conv_id, turn, 1 AS pos, CASE WHEN turn % 2 = 0 THEN 'C1' ELSE 'X' || turn END AS claim_id, left(text, 20) AS summary, text AS quote FROM conversations
UNION ALL SELECT conv_id, turn, 2, 'C2', role, '' FROM conversations""")
def normalize_claims(spark, t):
    claims = ("array(named_struct('id', CASE WHEN turn % 2 = 0 THEN '' ELSE 'X' || turn END, 'summary', left(text, 20), 'quote', text),"
              " named_struct('id', CAST(NULL AS string), 'summary', role, 'quote', CAST(NULL AS string))) AS claims")
    return intake.normalize_claims(t.conversations.selectExpr("conv_id", "turn", claims))


_REASONS = "CASE doc_id % 3 WHEN 0 THEN '一、' || replace(text, '\n', '\n(二) ') WHEN 1 THEN replace(text, '.', '。') ELSE '全 ' || text END"


def claims_sql(name: str, source: str, key: str) -> str:
    number = "(?:^|\\n)[\\s　]*(?:[一二三四五六七八九十]+[、.．)）]|[（(][一二三四五六七八九十]+[)）]|[0-9]+[、.．)）])[\\s　]*"
    clean = "list_filter(list_transform({0}, lambda p: {1}), lambda p: p <> '')".format("{0}", strip_sql("p"))
    return f"""
{name}_t AS (SELECT {key}, {strip_sql('text')} AS text FROM {source}),
{name}_p AS (SELECT {key}, text, {clean.format(f"string_split_regex(text, '{number}')")} AS numbered, {clean.format("string_split_regex(text, '[。；][\\s　]*')")} AS sentences FROM {name}_t),
{name}_c AS (SELECT {key}, CASE WHEN len(numbered) > 1 THEN numbered ELSE sentences END AS parts FROM {name}_p),
{name} AS (SELECT {key}, 'C' || generate_subscripts(parts, 1) AS claim_id, unnest(parts) AS quote FROM {name}_c)"""


@query("split_claims", f"""WITH src AS (SELECT doc_id, {_REASONS} AS text FROM documents), {claims_sql('claims', 'src', 'doc_id').strip()}
SELECT doc_id, claim_id, CASE WHEN length(quote) <= 60 THEN quote ELSE left(quote, 57) || '…' END AS summary, quote FROM claims""")
def split_claims(spark, t):
    return intake.explode_claims(t.documents.selectExpr("doc_id", f"{_REASONS} AS reasons"), "reasons")


def score_sql(text: str, words: list[str], bonus: int) -> str:
    return f"(len([w for w in {sql_list(words)} if contains({text}, w)]) + CASE WHEN contains({text}, '{words[0]}') THEN {bonus} ELSE 0 END)"


def label_sql(name: str, source: str, key: str, table: dict, bonus: int, other: str) -> str:
    """CTEs: ``name``(key, label, best), the first listed class among those with the best score."""
    ranks = " UNION ALL ".join(f"SELECT {key}, '{label}' AS label, {i} AS o, {score_sql('text', words, bonus)} AS score FROM {source}" for i, (label, words) in enumerate(table.items()))
    return f"""
{name}_s AS ({ranks}),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, o) AS rn FROM {name}_s),
{name} AS (SELECT {key}, CASE WHEN score = 0 THEN '{other}' ELSE label END AS label, score AS best FROM {name}_r WHERE rn = 1)"""


_CASE_TYPE = label_sql("kw", "topic_docs", "doc_id", V.CASE_TYPE_KEYWORDS, V.CASE_TYPE_NAME_BONUS, V.OTHER_LABEL)


@query("classify_by_keywords", f"""WITH {_CASE_TYPE.strip()}
SELECT doc_id, label AS case_type, least(1.0, round(best / 5.0, 2))::DOUBLE AS confidence FROM kw""", inputs=("topic_docs",))
def classify_by_keywords(spark, t):
    return intake.classify_by_keywords(t.topic_docs.select("doc_id", "text"))


_FLAT_DOCS = "flat AS (SELECT doc_id, regexp_replace(text, '[\\s　]+', '', 'g') AS text FROM topic_docs)"
_CATEGORY = label_sql("cat", "flat", "doc_id", {str(k): v for k, v in V.CATEGORY_KEYWORDS.items()}, V.CATEGORY_NAME_BONUS, "4")
_CATEGORY_BASIS = "CASE WHEN best = 0 THEN '" + V.CATEGORY_NO_HIT + "' ELSE '關鍵詞命中: ' || array_to_string(CASE label " + " ".join(
    f"WHEN '{k}' THEN [w for w in {sql_list(v)} if contains(text, w)]" for k, v in V.CATEGORY_KEYWORDS.items()) + " END, ', ') END"


@query("classify_by_keywords_v2", f"""WITH {_FLAT_DOCS}, {_CATEGORY.strip()}
SELECT doc_id, CAST(label AS INT) AS category, {_CATEGORY_BASIS} AS basis FROM cat JOIN flat USING (doc_id)""", inputs=("topic_docs",))
def classify_by_keywords_v2(spark, t):
    return t.topic_docs.select("doc_id", intake.category_by_keywords(F.col("text")).alias("k")).select("doc_id", "k.category", "k.basis")


@query("assemble_intake", f"""
WITH src AS (SELECT doc_id, topic, text FROM topic_docs), {label_sql("kw", "src", "doc_id", V.CASE_TYPE_KEYWORDS, V.CASE_TYPE_NAME_BONUS, V.OTHER_LABEL).strip()}
SELECT doc_id, label, {sql_case('label', V.LABEL_TO_ROUTE, "'general'")} AS route_key, least(1.0, round(best / 5.0, 2))::DOUBLE AS confidence,
  CASE WHEN best / 5.0 < 0.5 THEN 1 ELSE 0 END AS need_human_review, '新北環字第' || doc_id || '號' AS doc_no, CAST((doc_id % 9 + 1) * 1000 AS BIGINT) AS penalty_amount,
  text AS petition, topic || '，依新北環字第' || doc_id || '號裁處' || (doc_id % 9 + 1) || ',000元' AS disposition_doc,
  CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 <> 0 THEN '環保局' || (doc_id % 5) END AS agency, '新北環字第' || doc_id || '號' AS merged_doc_no, {_merged_sql('doc_id')}
FROM kw JOIN src USING (doc_id)""", inputs=("topic_docs",))
def assemble_intake(spark, t):
    cases = t.topic_docs.selectExpr("doc_id", "text AS petition", "topic || '，依新北環字第' || doc_id || '號裁處' || (doc_id % 9 + 1) || ',000元' AS disposition_doc")
    replies = t.topic_docs.select("doc_id", _reply_of("doc_id", doc_no="'模型字第1號'", agency="CASE WHEN KEY % 5 = 0 THEN '' ELSE '環保局' || (KEY % 5) END").alias("reply"))
    payload = intake.assemble_payload(cases, replies, "doc_id")
    return payload.select(*[c for c in payload.columns if c not in ("raw_text", "extracted_fields")], "raw_text.petition", F.col("raw_text.original_disposition_doc").alias("disposition_doc"),
                          "extracted_fields.original_disposition.agency", F.col("extracted_fields.original_disposition.doc_no").alias("merged_doc_no"), *_flat_fields("extracted_fields."))


@query("adapt_triage_to_case", """
SELECT CAST(case_id AS VARCHAR) AS case_id, '1.1' AS schema_version, CASE WHEN case_id % 3 = 0 THEN 0 ELSE 1 END AS is_admissible,
  CASE WHEN case_id % 3 <> 0 THEN '' WHEN case_id % 2 = 0 THEN '（77(2)）逾期' ELSE '逾期' END AS note,
  CASE case_id % 5 WHEN 1 THEN '空氣污染防制法' WHEN 3 THEN '廢棄物清理法' ELSE '洗錢防制法' END AS label,
  CASE case_id % 5 WHEN 1 THEN 'air_pollution' WHEN 3 THEN 'waste' ELSE 'money_laundering' END AS route_key,
  '洗錢防制法第' || (cust_key % 90 + 1) || '條' AS legal_basis, 'C1:原處分認定事實有誤。|C2:依洗錢防制法第' || (cust_key % 90 + 1) || '條不應處罰。' AS claims,
  '撤銷原處分' AS requests, """ + roc("svc") + """ AS service_date, """ + roc("fil") + """ AS filed_date
FROM case_days JOIN customer ON case_days.cust_key = customer.c_custkey""", inputs=("case_days",))
def adapt_triage_to_case(spark, t):
    p = intake.structure_petition(t.petition_rows)
    triage = p.selectExpr(
        "CAST(case_id AS string) AS case_id", "CASE WHEN case_id % 3 = 0 THEN 0 ELSE 1 END AS accepted", "CAST(case_id % 5 AS int) AS category",
        "CASE WHEN case_id % 2 = 0 THEN '77(2)' ELSE '' END AS clause", "'逾期' AS reason", "'不受理' AS accept_note", "petitioner", "agency", "issued", "doc_no",
        "received", "filed", "facts", "reasons", "text AS full_text", "request")
    payload = intake.adapt_triage_to_case(triage)
    fields = F.col("extracted_fields")
    return payload.select(
        "case_id", "schema_version", F.col("admissibility.is_admissible").cast("int").alias("is_admissible"), F.col("admissibility.note").alias("note"),
        F.col("case_type.label").alias("label"), F.col("case_type.route_key").alias("route_key"),
        F.array_join(fields["original_disposition"]["legal_basis"], "；").alias("legal_basis"),
        F.array_join(F.transform(fields["claims"], lambda c: F.concat(c["claim_id"], F.lit(":"), c["summary"])), "|").alias("claims"),
        F.array_join(fields["requests"], "；").alias("requests"), fields["original_disposition"]["service_date"].alias("service_date"),
        fields["petition_filed_date"].alias("filed_date"))


@query("mask_answer_columns", "SELECT CAST(doc_id AS VARCHAR) AS \"案號\", lang AS \"案件類型\", text AS \"訴願書敘述\" FROM documents LEFT JOIN labels USING (doc_id)")
def mask_answer_columns(spark, t):
    records = t.documents.join(t.labels, "doc_id", "left").selectExpr(
        "CAST(doc_id AS string) AS `案號`", "lang AS `案件類型`", "text AS `訴願書敘述`", "CASE WHEN quality = 1 THEN '受理' ELSE '不受理' END AS `受理與否`",
        "'77(2)' AS `不受理款次`", "source AS `判定理由`", "'駁回' AS `實體結果`", "toxic AS `逾期天數`")
    return intake.mask_answer_columns(records)


@query("build_query_text", f"""
SELECT conv_id, turn, left({strip_sql("CASE turn % 3 WHEN 0 THEN '夜間噪音 ' WHEN 1 THEN '菸蒂 ' ELSE '' END || text || chr(10) || role || chr(10) || left(text, 30) || ' ' || 'C' || turn")}, 500) AS query_text,
  CASE WHEN conv_id % 2 = 0 THEN 'building' ELSE CASE turn % 3 WHEN 0 THEN 'noise' WHEN 1 THEN 'waste' ELSE 'general' END END AS route_key FROM conversations""")
def build_query_text(spark, t):
    claims = F.array(F.struct(F.left("text", F.lit(30)).alias("summary")), F.struct(F.concat(F.lit("C"), "turn").alias("summary")))
    cases = t.conversations.select(
        "conv_id", "turn", F.expr("CASE turn % 3 WHEN 0 THEN '夜間噪音 ' WHEN 1 THEN '菸蒂 ' ELSE '' END || text").alias("disposition_doc"), F.col("role").alias("petition"),
        claims.alias("claims"), F.when(F.col("conv_id") % 2 == 0, "building").alias("route_key"))
    return intake.search_requests(cases)


@query("review_packet", f"""
WITH {SIMILAR_SQL}, {FINDINGS_SQL.strip()}, items AS (SELECT l_orderkey AS case_id, 'law' AS kind, l_partkey AS item_key, '法條' || l_partkey AS payload FROM lineitem
  UNION SELECT l_orderkey, 'claim', l_linenumber, 'C' || l_linenumber FROM lineitem
  UNION SELECT query_id, 'similar', position, doc_id || ' ' || printf('%.4f', similarity) FROM similar_cases
  UNION SELECT case_id, 'finding', CAST(substr(check_id, 2) AS BIGINT), concat_ws('：', check_id, level, title, evidence) FROM findings
  UNION SELECT o_orderkey, 'profile', 0, {sql_case("CASE o_custkey % 7 WHEN 0 THEN 'money_laundering' WHEN 1 THEN 'waste' WHEN 2 THEN 'air_pollution' WHEN 3 THEN 'building' WHEN 4 THEN 'noise' ELSE 'general' END",
     {r: '；'.join(i) for r, i in V.ROUTE_ISSUES.items()}, "''")} FROM orders)
SELECT case_id, kind, item_key // 1000 AS part, CAST(0 AS BIGINT) AS piece, count(*) AS n_items, CAST(to_json(list(payload ORDER BY item_key)) AS VARCHAR) AS items FROM items GROUP BY ALL""",
       inputs=("vectors", "cases", "case_days"))
def review_packet(spark, t):
    laws = t.lineitem.selectExpr("l_orderkey AS case_id", "'law' AS kind", "l_partkey AS item_key", "'法條' || l_partkey AS payload")
    claims = t.lineitem.selectExpr("l_orderkey AS case_id", "'claim' AS kind", "CAST(l_linenumber AS bigint) AS item_key", "'C' || l_linenumber AS payload")
    profile = t.cases.select("case_id", F.lit("profile").alias("kind"), F.lit(0).cast("bigint").alias("item_key"), intake.issue_profile(F.col("route_key")).alias("payload"))
    found = intake.packet_items(similar_of(t).withColumnRenamed("query_id", "case_id"), rules.defect_checks(timeline_of(t)))
    return intake.review_packet(laws.unionByName(claims).unionByName(profile).unionByName(found))
