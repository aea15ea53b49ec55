"""Domain inputs derived from the given tables.

The expressions are plain SQL both engines read alike, so that Spark and the SQL check start
from the same derived rows. Each entry: source, then output columns and their expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry import values as V
from docketry.sources.files import spread


def roc(day: str) -> str:
    return f"('民國' || (year({day}) - 1911) || '年' || month({day}) || '月' || day({day}) || '日')"


def dashed(day: str) -> str:
    return f"(year({day}) || '-' || month({day}) || '-' || day({day}))"


def slashed(day: str) -> str:
    return f"(year({day}) || '/' || month({day}) || '/' || day({day}))"


def dotted(day: str) -> str:
    return f"((year({day}) - 1911) || '.' || month({day}) || '.' || day({day}))"


def pick(value: str, *choices: str, other: str = "''") -> str:
    """CASE over small numbers; the choices are expressions."""
    whens = " ".join(f"WHEN {i} THEN {choice}" for i, choice in enumerate(choices))
    return f"CASE {value} {whens} ELSE {other} END"


def q(*texts: str) -> list[str]:
    return ["'" + text.replace("'", "''") + "'" for text in texts]


ROUTE_PICK = q("money_laundering", "waste", "air_pollution", "building", "noise", "general")
LAWS_WRITTEN = q("訴願人違反洗錢防制法", "揆諸前揭廢棄物清理法", "依空氣汙染防制法", "按行政罰法", "惟同法",
                 "業者違反攤販管理自治條例", "按棄物清理法", "依據道路交通管理處罰條例")
LAWS_CLEAN = q("洗錢防制法", "廢棄物清理法", "空氣污染防制法", "行政罰法", "同法", "攤販管理自治條例", "廢棄物清理法", "道路交通管理處罰條例")

_TOPIC = q("違反廢棄物清理法案，任意棄置菸蒂", "違章建築未申請使用執照", "夜間噪音音量逾分貝標準", "固定污染源粒狀污染物逾排放標準",
           "交付帳戶成為人頭帳戶，經書面告誡", "建築法與噪音管制法併罰", "空氣 污染 防制法 之 排放標準", "廢棄物一批", "洗錢防制法第22條",
           "停車場管理")

#: Grounds of an arriving draft: now and then a date of its own, a word against the ruling, the title of a finding.
FLOW_TEXT = ("'按洗錢防制法第' || (case_id % 90 + 1) || '條及第9條規定' || CASE WHEN case_id % 5 = 0 THEN '，民國113年1月1日作成' ELSE '' END"
             " || CASE WHEN case_id % 5 = 1 THEN '，原處分並無違誤' ELSE '' END || CASE WHEN case_id % 8 = 0 THEN '，原處分應記載事項不完備部分另述' ELSE '' END")

INPUTS: dict[str, tuple[str, dict[str, str]]] = {
    # ---- cases --------------------------------------------------------------
    "case_days": ("orders", {
        "case_id": "o_orderkey", "cust_key": "o_custkey", "order_status": "o_orderstatus", "order_priority": "o_orderpriority",
        "svc": "CAST(o_orderdate AS date)",
        "fil": "CAST(o_orderdate AS date) + CAST((o_orderkey * 7) % 61 - 1 AS int)",
        "act": "CAST(o_orderdate AS date) - CAST(o_custkey % 1600 AS int)",
        "born": "CAST(o_orderdate AS date) - CAST(4000 + o_custkey % 9000 AS int)",
    }),
    "cases": ("case_days", {
        "case_id": "case_id", "cust_key": "cust_key",
        "agency": f"CASE WHEN cust_key % 11 = 0 THEN '' ELSE '新北市政府環境保護局' END",
        "doc_no": "CASE WHEN cust_key % 13 = 0 THEN '' ELSE '新北環字第' || case_id || '號' END",
        "legal_basis": "CASE WHEN cust_key % 17 = 0 THEN '' ELSE '洗錢防制法第22條' END",
        "penalty_amount": "1000 * (1 + case_id % 60)",
        "violation_count": "case_id % 4",
        "repeat_count": "case_id % 3",
        "requires_prior_order": "cust_key % 5 = 0",
        "prior_order_done": "case_id % 2 = 0",
        "disposition_date": roc("svc"),
        "service_date": f"CASE WHEN case_id % 37 = 0 THEN '' WHEN case_id % 3 = 0 THEN {roc('svc')} WHEN case_id % 3 = 1 THEN {dotted('svc')} ELSE {dashed('svc')} END",
        "act_date": f"CASE WHEN cust_key % 29 = 0 THEN '' ELSE {roc('act')} END",
        "filed_date": roc("fil"),
        "service_method": "CASE WHEN order_priority = '5-LOW' THEN '寄存送達' ELSE '本人送達' END",
        "revoked": "CASE WHEN order_status = 'P' THEN '已撤銷' ELSE '' END",
        "disposition_revoked": "''",
        "previously_decided": "CASE WHEN case_id % 23 = 0 THEN ' YES ' ELSE 'no' END",
        "route_key": pick("cust_key % 7", *ROUTE_PICK, other="'traffic'"),
    }),
    "narratives": ("case_days", {
        "case_id": "case_id",
        "narrative": "CASE WHEN case_id % 11 = 0 THEN '' ELSE '訴願人對於' || " + roc("svc") + " || '送達之行政處分,於' || " + roc("fil") + " || '提起訴願。' END || "
                     + pick("case_id % 9", *q("訴願人為無關第三人。", "原處分現況為「已撤銷」。", "前曾就同一事件提起訴願。", "訴願人未成年。",
                                              "書狀程式不合且未補正。", "所爭執標的非行政處分。"), other="'程序無瑕疵。'"),
        "service_component": roc("svc"), "filed_component": roc("fil"),
        "statutory_days": "CASE WHEN case_id % 5 = 0 THEN 0 WHEN case_id % 7 = 0 THEN 60 ELSE 30 END",
    }),
    "petition_rows": ("case_days JOIN customer ON case_days.cust_key = customer.c_custkey", {
        "case_id": "case_id", "cust_key": "cust_key",
        "text": "'訴願人 ' || c_name || '（代理人' || c_mktsegment || '）\n出生 " + "' || " + roc("born") + " || '\n原行政處分機關\n 新北市政府環境保護局\n受理訴願機關\n新北市政府\n"
                "處分書 新北環稽字第 ' || case_id || ' 號\n發 文 日：' || " + roc("act") + " || '\n收受知悉行政處分之年月日 ' || " + roc("svc") + " || '\n訴願請求事項：\n撤銷原處分\n"
                "事實：' || " + pick("case_id % 6", *q("訴願人為無關第三人。", "本件業經通知補正而未補正，應記載事項空白。", "原處分執行完畢效力已消滅。",
                                                      "訴願人重複提起。", "距收受原處分之日已45日。"), other="'訴願人經營商號。'")
                + " || '\n理由：一、原處分認定事實有誤。\n二、依洗錢防制法第' || (cust_key % 90 + 1) || '條不應處罰。\n檢附之證據或附件：收據' || case_id || '\n此致\n新北市政府\n中華民國 '"
                " || (year(fil) - 1911) || ' 年 ' || month(fil) || ' 月 ' || day(fil) || ' 日' || CASE WHEN cust_key % 10 = 0 THEN '\n統一編號 12345678' ELSE '' END",
    }),
    "date_paragraphs": ("case_days", {
        "case_id": "case_id",
        "text": "'原處分於' || " + roc("svc") + " || '送達，訴願人於' || " + slashed("fil") + " || '提起訴願'"
                " || CASE WHEN case_id % 4 = 0 THEN '，另於' || " + dashed("born") + " || '陳述意見' ELSE '' END"
                " || CASE WHEN case_id % 10 = 0 THEN '，又於民國88年2月30日到場' ELSE '。' END",
    }),
    # ---- citation texts -----------------------------------------------------
    "cite_keys": ("lineitem", {
        "case_id": "l_orderkey", "pk": "l_partkey", "sk": "l_suppkey", "m": "l_linenumber", "n": "l_suppkey % 90 + 1",
        "written": pick("l_partkey % 8", *LAWS_WRITTEN), "law_clean": pick("l_partkey % 8", *LAWS_CLEAN),
    }),
    "paragraph_rows": ("cite_keys", {
        "case_id": "case_id", "pos": "m", "pk": "pk", "sk": "sk",
        "text": "written || " + pick("m % 3", "'§' || n", "'第 ' || n || ' 條第 1 項'", other="'第' || n || '條之' || m")
                + " || CASE WHEN sk % 4 = 0 THEN '及第' || (n % 30 + 1) || '條' ELSE '' END || '規定，'"
                " || CASE WHEN pk % 10 = 0 THEN '另見第15條之，' ELSE '' END || "
                + pick("sk % 8", *q("原處分並無違誤。", "應予撤銷。", "本案實體部分。"), other="'。'") + " || "
                + pick("pk % 7", *q("裁處已逾裁處權時效", "原處分應記載事項不完備")),
        "cites_text": "CASE WHEN pk % 5 = 0 THEN '' ELSE law_clean || '§' || n END || CASE WHEN sk % 9 = 0 THEN '|臺北高等行政法院判決-洗錢防制法第22條' ELSE '' END",
        "responds": "'C' || (m % 4 + 1)",
    }),
    "cite_texts": ("paragraph_rows", {
        "case_id": "case_id", "pos": "pos", "pk": "pk", "sk": "sk", "cites_text": "cites_text",
        "text": "text || '；另訴願法第' || (sk % 5 + 1) || '條，再依訴願法第0' || (sk % 5 + 1) || '條、第' || (pk % 9 + 1) || '條辦理'"
                " || CASE sk % 6 WHEN 0 THEN '，見第 條' WHEN 1 THEN '，§之' WHEN 2 THEN '，第3條之 4' ELSE '' END",
    }),
    "law_rows": ("cite_keys", {
        "case_id": "case_id",
        "citation": "CASE WHEN pk % 3 = 0 THEN law_clean || '第' || (n + CASE WHEN pk % 4 = 0 THEN 1 ELSE 0 END) || '條' ELSE '' END",
        "law": "CASE WHEN pk % 3 = 1 THEN law_clean ELSE '' END",
        "article": "CAST(n + CASE WHEN pk % 4 = 0 THEN 1 ELSE 0 END AS string)",
        "title": "''", "source": "''",
        "text": "'檢索段落提及' || law_clean || '第' || (n + CASE WHEN pk % 4 = 0 THEN 1 ELSE 0 END) || '條等語'",
    }),
    # ---- documents ----------------------------------------------------------
    "topic_docs": ("documents", {
        "doc_id": "doc_id", "lang": "lang", "source": "source", "n_chars": "n_chars",
        "topic": pick("doc_id % 11", *_TOPIC),
        "text": pick("doc_id % 11", *_TOPIC) + " || '\n' || text",
    }),
    "pii_docs": ("documents", {
        "doc_id": "doc_id", "source": "source", "n_chars": "n_chars",
        "route": pick("doc_id % 4", *ROUTE_PICK[:3], other="'general'"),
        "text": pick("doc_id % 5", *q("訴訟代理人 劉杉涼\n陳錦英\n主文\n", "05 訴 願 人　王綉 律師\n歐陽大同\n林一\n", "訴願人 遂於\n原告 司馬中原（送達）\n張三\n", "代表人 李四\n新北市政府\n"),
                     other="'負責人 趙雲\n'")
                + " || '電話09' || lpad(CAST(doc_id % 100 AS string), 2, '0') || '-345-678，身分證A1' || lpad(CAST(doc_id AS string), 8, '0') || '號，文號1131914523\n'"
                " || CASE WHEN doc_id % 2 = 0 THEN '住新北市板橋區文化路一段' || (doc_id % 90 + 1) || '號3樓\n' ELSE '新北市政府訴願字\n' END"
                " || CASE doc_id % 6 WHEN 0 THEN '周杰\n' WHEN 1 THEN '王大明\n' WHEN 2 THEN '事實\n' ELSE '' END || text",
    }),
    "ruling_docs": ("documents", {
        "doc_id": "doc_id", "lang": "lang", "source": "source",
        "meta_disposition": pick("doc_id % 5", *q("訴願不受理。", "原處分撤銷", "訴願駁回")),
        "meta_year": pick("doc_id % 4", *q("112", "不詳")),
        "route_key": pick("doc_id % 7", *ROUTE_PICK, other="'traffic'"),
        "text": pick("doc_id % 6", *q("主文：訴願駁回。 110年度決定", "主文：原處分撤銷，另為適法之處分。", "主文：訴願不受理。 99 年度", "交付帳戶有無正當理由及行為人認定")) + " || ' ' || text",
    }),
    # ---- vectors ------------------------------------------------------------
    "vectors": ("embeddings", {
        "doc_id": "vec_id", "label": "label", "vec": "embedding",
        "doc_type": pick("label % 5", *q("law", "common_law", "interpretation", "judgment"), other="'decision'"),
        "doc_route": pick("vec_id % 4", *ROUTE_PICK[:3], other="'building'"),
        "query_route": pick("vec_id % 5", *ROUTE_PICK[:4], other="'noise'"),
        "law_name": pick("label % 5", *q("洗錢防制法", "訴願法", "法務部函釋第9號"), other="''"),
        "text": "'段落 ' || " + pick("vec_id % 3", "'第' || (vec_id % 90 + 1) || '條及第' || (vec_id % 7 + 1) || '條之2'", "'無條號'", other="'第 ' || (label + 1) || ' 條'") + " || ' 節錄'",
        "uri": "CASE WHEN vec_id % 6 = 0 THEN '' ELSE 'laws/' || (vec_id % 40) || '.txt' END",
        "disposition": pick("label % 4", *q("訴願駁回", "原處分撤銷", "訴願不受理。")),
    }),
    # ---- triage predictions -------------------------------------------------
    "verdicts": ("documents", {
        "doc_id": "doc_id",
        "label": "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 1 END",
        "clause": pick("doc_id % 7", other="''", *["''", "'77(4)'", "'77(2)'", "'77(6)'"]),
        "reason": "'初判' || (doc_id % 7)",
        "confidence": pick("n_chars % 3", *q("高", "中"), other="NULL"),
        "n_chars": "n_chars",
    }),
    "reviews": ("documents", {
        "doc_id": "doc_id",
        "label_2": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END",
        "clause_2": pick("doc_id % 5", "''", "'77 (4)'", "'77(3)'"),
        "reason_2": "'覆核' || (doc_id % 5)",
    }),
    # ---- events as cases ----------------------------------------------------
    "event_days": ("events", {
        "case_id": "event_id", "user_id": "user_id", "event_type": "event_type", "props": "props",
        "svc": "CAST(ts AS date)", "fil": "CAST(ts AS date) + CAST((event_id * 7) % 61 - 1 AS int)",
    }),
    "event_cases": ("event_days", {
        "case_id": "case_id",
        "agency": "'新北市政府'", "doc_no": "'新北字第' || case_id || '號'", "legal_basis": "''",
        "disposition_date": roc("svc"), "service_date": roc("svc"), "act_date": "''", "filed_date": roc("fil"),
        "service_method": "CASE WHEN event_type = 'view' THEN '寄存' ELSE '本人' END",
        "revoked": "CASE WHEN event_type = 'error' THEN 'true' ELSE '' END", "disposition_revoked": "''", "previously_decided": "''",
        "reply": "'```json\n{\"paragraphs\":[{\"text\":\"按洗錢防制法第' || (case_id % 90 + 1) || '條及第9條規定\",\"cites\":[\"洗錢防制法§' || (user_id % 90 + 1) || '\"]}]}\n```'",
    }),
    "flow_cases": ("event_days", {
        "case_id": "case_id",
        "agency": "'新北市政府'", "doc_no": "'新北字第' || case_id || '號'", "legal_basis": "CASE WHEN case_id % 2 = 0 THEN '' ELSE '廢棄物清理法第27條' END",
        "disposition_date": roc("svc"), "service_date": roc("svc"), "act_date": "''", "filed_date": roc("fil"),
        "service_method": "CASE WHEN event_type = 'view' THEN '寄存' ELSE '本人' END",
        "revoked": "CASE WHEN event_type = 'error' THEN 'true' ELSE '' END", "disposition_revoked": "''", "previously_decided": "''",
        "penalty_amount": "0", "violation_count": "0", "requires_prior_order": "false", "prior_order_done": "false",
        "claim_ids": pick("case_id % 3", "''", "'C1'", "'C1|C2'"),
        "reply": "'```json\n{\"main\":\"' || " + pick("case_id % 4", "'訴願駁回。'", "'原處分撤銷。'", "'訴願不受理。'", other="'另為處理'")
                 + " || '\",\"remedy_notice\":\"' || " + pick("case_id % 3", "''", "'得提起行政訴訟。'", f"'{V.REMEDY_NOTICE}'")
                 + " || '\",\"paragraphs\":[{\"text\":\"' || " + FLOW_TEXT
                 + " || '\",\"cites\":[\"洗錢防制法§' || (user_id % 90 + 1) || '\"],\"responds_to\":[\"C' || (case_id % 2 + 1) || '\"]}]}\n```'",
    }),
    "flow_laws": ("event_days", {
        "case_id": "case_id", "user_id": "user_id", "wide": "case_id % 3 = 0", "none": "case_id % 7 = 0",
    }),
    "replies": ("events", {
        "event_id": "event_id",
        "reply": "CASE event_id % 4 WHEN 0 THEN '說明\n```json\n' || props || '\n```\n完' WHEN 1 THEN '結果：' || props || ' 以上' WHEN 2 THEN '  ' || props || '\n' ELSE '無法判斷' END",
    }),
}


# tables whose rows become texts that are parsed
TEXT_SOURCES = {"orders", "lineitem", "documents", "events", "conversations"}


class Inputs:
    """Given and derived tables of one data folder, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._tables = spark, folder, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._build(name)
        return self._tables[name]

    def _build(self, name: str) -> DataFrame:
        if name not in INPUTS:
            scan = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
            return spread(scan) if name in TEXT_SOURCES else scan
        source, columns = INPUTS[name]
        if " JOIN " in source:
            left, rest = source.split(" JOIN ")
            right, condition = rest.split(" ON ")
            a, b = condition.split(" = ")
            left_table, right_table = self.table(left), self.table(right)
            base = left_table.join(right_table, left_table[a.split(".")[1]] == right_table[b.split(".")[1]])
        else:
            base = self.table(source)
        return base.selectExpr(*[f"{expression} AS {name_}" for name_, expression in columns.items()])

    def __getattr__(self, name: str) -> DataFrame:
        return self.table(name)


def with_inputs(*names: str) -> str:
    """WITH entries of derived inputs and what they rest on, for the SQL counterparts."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in INPUTS or name in ordered:
            return
        for part in INPUTS[name][0].replace(" JOIN ", " ").split():
            visit(part)
        ordered.append(name)

    for name in names:
        visit(name)
    entries = []
    for name in ordered:
        source, columns = INPUTS[name]
        entries.append(f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})")
    return ",\n".join(entries)
