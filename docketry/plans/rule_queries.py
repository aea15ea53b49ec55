"""Queries over dates, deadlines, gates, findings and triage rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import dates
from docketry.operators import intake, rules
from docketry.plans.derive import dashed, dotted, pick, q, roc, slashed
from docketry.plans.registry import query


def timeline_of(t):
    return rules.appeal_timeline(intake.normalize_missing(t.cases))


def gate_of(t):
    return rules.procedure_gate(timeline_of(t))


TIMELINE_SQL = f"""
tl0 AS (SELECT c.*, CASE WHEN c.case_id % 37 = 0 THEN NULL ELSE svc END AS d_svc, CASE WHEN c.cust_key % 29 = 0 THEN NULL ELSE act END AS d_act, svc AS d_disp, fil AS d_fil
  FROM cases c JOIN case_days d USING (case_id)),
tl1 AS (SELECT *, d_svc + CASE WHEN contains(service_method, '寄存') THEN 10 ELSE 0 END AS d_eff FROM tl0),
tl2 AS (SELECT *, d_eff + 30 + CASE isodow(d_eff + 30) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS d_dead,
  TRY_CAST((year(d_act) + 3) || '-' || month(d_act) || '-' || day(d_act) AS DATE) AS d_lim FROM tl1),
tl AS (SELECT *, {roc('d_eff')} AS eff_roc, {roc('d_dead')} AS dead_roc, {roc('d_lim')} AS lim_roc FROM tl2)"""

GATE_SQL = f"""{TIMELINE_SQL.strip()},
gate AS (SELECT *, CASE WHEN d_fil > d_dead THEN '77-2' WHEN revoked = '已撤銷' THEN '77-6' WHEN lower(trim(previously_decided)) = 'yes' THEN '77-7' END AS clause,
  CASE WHEN d_fil > d_dead THEN d_fil - d_dead END AS overdue_days FROM tl)"""


_DATE_TEXT = (f"CASE o_orderkey % 6 WHEN 0 THEN {roc('d')} WHEN 1 THEN ' ' || {dotted('d')} || ' 起' WHEN 2 THEN {dashed('d')} WHEN 3 THEN {slashed('d')} "
              f"WHEN 4 THEN (year(d) - 1911) || ' 年 ' || month(d) || ' 月 ' || (day(d) + 20) || ' 日' ELSE CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '日期不詳 ' || o_custkey END END")


@query("parse_roc_date", f"""
WITH s AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS date) AS d FROM orders)
SELECT o_orderkey, {_DATE_TEXT} AS raw, CAST(CASE o_orderkey % 6 WHEN 4 THEN TRY_CAST(year(d) || '-' || month(d) || '-' || (day(d) + 20) AS DATE) WHEN 5 THEN NULL ELSE d END AS VARCHAR) AS day FROM s""")
def parse_roc_date(spark, t):
    rows = t.orders.selectExpr("o_orderkey", "o_custkey", "CAST(o_orderdate AS date) AS d").selectExpr("o_orderkey", f"{_DATE_TEXT} AS raw")
    return rows.withColumn("day", dates.parse_date(F.col("raw")).cast("string"))


@query("format_roc_date", f"""
SELECT o_orderkey, {roc('CAST(o_orderdate AS date)')} AS roc, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE year(o_orderdate) - 1911 END AS roc_year FROM orders""")
def format_roc_date(spark, t):
    published = F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return t.orders.select("o_orderkey", dates.format_roc(F.col("o_orderdate").cast("date")).alias("roc"), dates.roc_year(published).cast("bigint").alias("roc_year"))


@query("appeal_timeline", f"""WITH {TIMELINE_SQL.strip()}
SELECT case_id, CAST(d_act AS VARCHAR) AS act, CAST(d_svc AS VARCHAR) AS service, CAST(d_eff AS VARCHAR) AS effective, CAST(d_dead AS VARCHAR) AS deadline,
  CAST(d_lim AS VARCHAR) AS limitation, eff_roc AS service_effective_date, dead_roc AS appeal_deadline, lim_roc AS penalty_limitation_date FROM tl""", inputs=("cases", "case_days"))
def appeal_timeline(spark, t):
    text = {"act": "_act", "service": "_service", "effective": "_effective", "deadline": "_deadline", "limitation": "_limitation"}
    return timeline_of(t).select("case_id", *[F.col(c).cast("string").alias(n) for n, c in text.items()],
                                 "service_effective_date", "appeal_deadline", "penalty_limitation_date")


@query("public_projection", f"""WITH {TIMELINE_SQL.strip()}
SELECT case_id, cust_key, nullif(agency, '') AS agency, nullif(doc_no, '') AS doc_no, nullif(legal_basis, '') AS legal_basis, penalty_amount, violation_count, repeat_count, requires_prior_order, prior_order_done,
  disposition_date, nullif(service_date, '') AS service_date, nullif(act_date, '') AS act_date, filed_date, service_method, nullif(revoked, '') AS revoked, CAST(NULL AS VARCHAR) AS disposition_revoked,
  previously_decided, route_key, eff_roc AS service_effective_date, dead_roc AS appeal_deadline, lim_roc AS penalty_limitation_date FROM tl""", inputs=("cases", "case_days"))
def public_projection(spark, t):
    return intake.public_projection(timeline_of(t))


@query("procedure_gate", f"""WITH {GATE_SQL.strip()}
SELECT case_id, CASE WHEN clause IS NULL THEN 0 ELSE 1 END AS is_inadmissible, clause, overdue_days,
  CASE clause WHEN '77-2' THEN '提起訴願日（' || filed_date || '）逾法定期間末日（' || dead_roc || '）' || overdue_days || ' 日，依訴願法第77條第2款應不受理。'
    WHEN '77-6' THEN '原行政處分已經撤銷或失效，依訴願法第77條第6款應不受理。' WHEN '77-7' THEN '就同一處分前已提起訴願並經決定或撤回，依訴願法第77條第7款應不受理。' END AS reason FROM gate""", inputs=("cases", "case_days"))
def procedure_gate(spark, t):
    return gate_of(t).select("case_id", "is_inadmissible", "clause", "overdue_days", "reason")


FINDINGS_SQL = f"""{TIMELINE_SQL.strip()},
miss AS (SELECT *, concat_ws('、', CASE WHEN agency = '' THEN '處分機關' END, CASE WHEN doc_no = '' THEN '處分書字號' END, CASE WHEN legal_basis = '' THEN '法令依據' END) AS missing FROM tl),
findings AS (
  SELECT case_id, 'D1' AS check_id, CASE WHEN legal_basis = '' THEN 'red' ELSE 'amber' END AS level, '原處分應記載事項不完備' AS title, '缺漏：' || missing AS evidence FROM miss WHERE missing <> ''
  UNION ALL SELECT case_id, 'D2', 'red', '裁處已逾裁處權時效', '處分作成日 ' || disposition_date || ' 逾時效末日 ' || lim_roc || ' 共 ' || (d_disp - d_lim) || ' 日' FROM tl WHERE d_disp > d_lim
  UNION ALL SELECT case_id, 'D3', 'amber', '累犯次數與罰鍰金額宜複核', '宣稱累犯 ' || coalesce(nullif(violation_count, 0), repeat_count) || ' 次、罰鍰 ' || penalty_amount || '，請對照裁罰基準確認級距' FROM tl WHERE coalesce(nullif(violation_count, 0), repeat_count) > 1
  UNION ALL SELECT case_id, 'D4', 'amber', '應審酌從新從輕原則', '行為時 ' || act_date || ' 與裁處時 ' || disposition_date || ' 跨越法規可能修正之期間，應比較行為時法與裁處時法擇有利者' FROM tl WHERE year(d_disp) - year(d_act) >= 1
  UNION ALL SELECT case_id, 'D5', 'red', '未完成法定前置程序即為裁處', '本案需先行限期改善／令停工等前置處分，卷內查無完成紀錄' FROM tl WHERE requires_prior_order AND NOT prior_order_done
  UNION ALL SELECT case_id, 'D6', 'amber', '原處分送達日期不明', '卷內查無合法送達日期，救濟期間無從起算' FROM tl WHERE d_svc IS NULL)"""


@query("defect_checks", f"""WITH {FINDINGS_SQL.strip()} SELECT *, CASE level WHEN 'red' THEN 0 ELSE 1 END AS level_rank FROM findings""", inputs=("cases", "case_days"))
def defect_checks(spark, t):
    return rules.defect_checks(timeline_of(t)).select("case_id", "check_id", "level", "title", "evidence", "level_rank")


_PAYLOAD = """'{"case_id":"' || event_id || '"' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',"schema_version":"1.0"' ELSE ',"schema_version":"1.1"' END
 || ',"case_type":{' || CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '"route_key":"' || event_type || '"' ELSE '"route_key":"waste"' END || '}'
 || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"admissibility":' || props END || CASE WHEN event_id % 9 = 0 THEN '' ELSE ',"extracted_fields":{}' END || ',"raw_text":{}}'"""


@query("validate_contract", """
SELECT event_id, concat_ws('；', CASE WHEN event_id % 4 < 2 THEN 'schema_version 應為 1.1' END,
  CASE event_id % 7 WHEN 0 THEN 'route_key ''None'' 不在枚舉' WHEN 1 THEN 'route_key ''' || event_type || ''' 不在枚舉' END,
  CASE WHEN event_id % 5 = 0 THEN '缺少必填欄位 admissibility' END, CASE WHEN event_id % 9 = 0 THEN '缺少必填欄位 extracted_fields' END) AS problems,
  CASE WHEN event_id % 4 < 2 OR event_id % 7 < 2 OR event_id % 5 = 0 OR event_id % 9 = 0 THEN 0 ELSE 1 END AS is_valid FROM events""")
def validate_contract(spark, t):
    raw = t.events.selectExpr("event_id", f"{_PAYLOAD} AS payload")
    field = lambda path: F.get_json_object("payload", path)
    flat = raw.select("event_id", field("$.schema_version").alias("schema_version"), field("$.case_type.route_key").alias("route_key"),
                      *[field(f"$.{b}").isNotNull().alias(f"has_{b}") for b in ("admissibility", "extracted_fields", "raw_text")])
    return rules.validate_contract(flat).select("event_id", F.array_join("problems", "；").alias("problems"), "is_valid")


_TRIAGE_SQL = f"""
n AS (SELECT n.*, CASE WHEN statutory_days = 0 THEN 30 ELSE statutory_days END AS allowed, fil - svc AS elapsed FROM narratives n JOIN case_days d USING (case_id)),
triage AS (SELECT case_id, CASE case_id % 9 WHEN 0 THEN '77(3)' WHEN 1 THEN '77(6)' WHEN 2 THEN '77(7)' WHEN 3 THEN '77(4)' WHEN 4 THEN '77(1)' WHEN 5 THEN '77(8)'
  ELSE CASE WHEN elapsed > allowed THEN '77(2)' END END AS clause,
  CASE case_id % 9 WHEN 0 THEN '訴願人非原處分相對人或利害關係人,當事人不適格。' WHEN 1 THEN '原處分已不存在(現況:已撤銷)。' WHEN 2 THEN '就同一事件重複提起訴願。'
    WHEN 3 THEN '訴願人無訴願能力(未成年且未由法定代理人代為訴願)。' WHEN 4 THEN '訴願書未具備法定應記載事項,經通知仍未補正。' WHEN 5 THEN '所爭執標的性質上非屬行政處分。'
    ELSE CASE WHEN elapsed > allowed THEN '提起訴願逾法定 ' || allowed || ' 日期間(實際 ' || elapsed || ' 日,逾期 ' || (elapsed - allowed) || ' 日)。' ELSE '{V.TRIAGE_ACCEPT}' END END AS reason FROM n)"""


@query("triage_rules", f"""WITH {_TRIAGE_SQL.strip()} SELECT case_id, clause, reason, CASE WHEN clause IS NULL THEN 1 ELSE 0 END AS label FROM triage""", inputs=("narratives", "case_days"))
def triage_rules(spark, t):
    return rules.triage_rules(t.narratives).select("case_id", "clause", "reason", "label")


@query("triage_rules_pdf", f"""
WITH n AS (SELECT case_id, fil - svc AS elapsed FROM petition_rows JOIN case_days USING (case_id)),
r AS (SELECT case_id, CASE case_id % 6 WHEN 0 THEN '77(3)' WHEN 1 THEN '77(1)' WHEN 2 THEN '77(6)' WHEN 3 THEN '77(7)' ELSE CASE WHEN elapsed > 30 THEN '77(2)' END END AS clause,
  CASE case_id % 6 WHEN 0 THEN '訴願人非原處分相對人或利害關係人,當事人不適格。' WHEN 1 THEN '訴願書未具備法定應記載事項,經通知後仍未補正。'
    WHEN 2 THEN '原處分已不存在(執行完畢/撤銷/失效,效力已消滅)。' WHEN 3 THEN '就同一事件重複提起訴願。'
    ELSE CASE WHEN elapsed > 30 THEN '提起訴願逾法定 30 日期間(實際 ' || elapsed || ' 日,逾期 ' || (elapsed - 30) || ' 日)。' ELSE '{V.TRIAGE_ACCEPT}' END END AS reason FROM n)
SELECT case_id, clause, reason, CASE WHEN clause IS NULL THEN 1 ELSE 0 END AS label FROM r""", inputs=("petition_rows", "case_days"))
def triage_rules_pdf(spark, t):
    return rules.triage_rules_pdf(t.petition_rows.select("case_id", "text")).select("case_id", "clause", "reason", "label")


_CLAUSES = pick("case_id % 8", *q("77-2", "77(6)", "7", "77（3）", "99", "第77條第2款", "8"), other="NULL")
_TEMPLATES = " ".join(f"WHEN '{n}' THEN '{text}'" for n, (_, text) in V.CLAUSE_TEMPLATES.items())
_CITES = " ".join(f"WHEN '{n}' THEN '{'；'.join(c)}'" for n, (c, _) in V.CLAUSE_TEMPLATES.items())


@query("clause_template", f"""WITH {TIMELINE_SQL.strip()},
c AS (SELECT *, CASE case_id % 8 WHEN 0 THEN '2' WHEN 1 THEN '6' WHEN 2 THEN '7' WHEN 3 THEN '3' WHEN 6 THEN '8' END AS clause_no, '上游' || case_id AS up FROM tl)
SELECT case_id, clause_no, CASE WHEN clause_no IS NULL THEN '{V.CLAUSE_GENERIC_TEXT}（前段判定：' || up || '）' ELSE replace(CASE clause_no {_TEMPLATES} END, '{{overdue}}',
   CASE WHEN d_eff IS NULL THEN '本件訴願之提起已逾法定30日訴願期間；' ELSE '本件原行政處分於' || eff_roc || '發生送達效力，訴願人遲至' || filed_date || '始提起訴願，已逾法定30日訴願期間（末日為' || dead_roc || '）；' END) END AS text,
  coalesce(CASE clause_no {_CITES} END, '{V.CLAUSE_GENERIC_CITE}') AS cites, '{V.REMEDY_NOTICE}' AS remedy_notice, '{V.INADMISSIBLE}。' AS main,
  CASE WHEN clause_no IS NULL THEN 1 ELSE 0 END AS needs_human_review FROM c""", inputs=("cases", "case_days"))
def clause_template(spark, t):
    cases = timeline_of(t).selectExpr("case_id", f"{_CLAUSES} AS clause", "'上游' || case_id AS reason", "filed_date", "service_effective_date", "appeal_deadline")
    return rules.clause_template(cases).select("case_id", "clause_no", "text", "cites", "remedy_notice", "main", "needs_human_review")
