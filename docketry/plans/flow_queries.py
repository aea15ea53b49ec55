"""Queries over files, stage tables, the whole case flow and streams."""

from __future__ import annotations

from datetime import timedelta
from functools import cache

from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import labels
from docketry.operators import retrieval
from docketry.plans.case_flow import review_cases
from docketry.plans.derive import FLOW_TEXT, pick
from docketry.plans.registry import query
from docketry.plans.rule_queries import FINDINGS_SQL, GATE_SQL, gate_of
from docketry.plans.search_queries import DISPOSITION_SQL, MERGED_SQL, PAIRS_SQL, _vectors, majority_sql, merged_hits
from docketry.session import stored, work_dir
from docketry.sources import files
from docketry.streaming import arrivals, requests


@query("scan_json_docs", """
SELECT CASE WHEN doc_id % 50 = 7 THEN NULL ELSE doc_id END AS doc_id, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE text END AS text,
  CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END AS unreadable FROM documents""")
def scan_json_docs(spark, t):
    folder = work_dir(spark, "json-docs")
    line = F.to_json(F.struct("doc_id", "lang", "text"))
    t.documents.select(F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("broken "), line)).otherwise(line)).write.text(folder)
    docs = files.scan_json_docs(spark, folder, "doc_id bigint, lang string, text string", glob="*.txt", multi_line=False)
    return docs.select("doc_id", "lang", "text", "unreadable")


@query("scan_jsonl_labels", """
SELECT 'SYN' || doc_id AS case_id, quality AS label, CASE WHEN quality = 0 THEN '77(' || (doc_id % 8 + 1) || ')' END AS ground FROM labels""")
def scan_jsonl_labels(spark, t):
    folder = work_dir(spark, "labels")
    records = t.labels.selectExpr("doc_id", "'SYN' || doc_id AS `案號`", "CASE WHEN quality = 1 THEN '受理' ELSE '不受理' END AS `受理與否`",
                                  "CASE WHEN quality = 0 THEN '77(' || (doc_id % 8 + 1) || ')' END AS `不受理款次`")
    line = F.to_json(F.struct("案號", "受理與否", "不受理款次"))
    # every tenth record is followed by blank lines
    records.select(F.when(F.col("doc_id") % 10 == 3, F.concat(line, F.lit("\n\n  "))).otherwise(line)).write.text(folder)
    return files.scan_jsonl_labels(spark, folder, "案號", "受理與否", "受理", "不受理款次")


@query("encoding_audit", """
SELECT CASE doc_id % 4 WHEN 2 THEN 'big5' WHEN 3 THEN 'utf-8 (lossy)' ELSE 'utf-8' END AS charset, count(*) AS n_files,
  CAST(sum(CASE doc_id % 4 WHEN 1 THEN length(text) + 1 WHEN 2 THEN length(regexp_replace(text, '[^ -~]', '', 'g')) + 2 ELSE length(text) END) AS BIGINT) AS n_chars FROM documents GROUP BY ALL""")
def encoding_audit(spark, t):
    raw, k = F.encode("text", "UTF-8"), F.col("doc_id") % 4
    plain = F.encode(F.regexp_replace("text", "[^ -~]", ""), "UTF-8")
    content = F.when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(k == 2, F.concat(F.unhex(F.lit("A7DAADCC")), plain)) \
        .when(k == 3, F.concat(F.unhex(F.lit("FFFE80")), raw)).otherwise(raw)
    return files.encoding_audit(t.documents.select("doc_id", content.alias("content")))


@query("write_index_docs", r"""
WITH d AS (SELECT *, regexp_replace('案 ' || source || '/' || lang || '#' || (n_chars % 7), '[^\w一-鿿.\-]+', '_', 'g') AS stem, CASE doc_id % 3 WHEN 0 THEN 'waste' WHEN 1 THEN 'noise' ELSE 'general' END AS route,
  CASE WHEN n_chars % 2 = 0 THEN 'decisions' ELSE 'laws' END AS kind FROM documents)
SELECT route, kind, stem, count(*) AS n_copies, max(doc_id) AS seq, arg_max(text, doc_id) AS text FROM d GROUP BY route, kind, stem""")
def write_index_docs(spark, t):
    folder = work_dir(spark, "index")
    docs = t.documents.selectExpr(
        "CASE doc_id % 3 WHEN 0 THEN 'waste' WHEN 1 THEN 'noise' ELSE 'general' END AS route", "CASE WHEN n_chars % 2 = 0 THEN 'decisions' ELSE 'laws' END AS kind",
        "'案 ' || source || '/' || lang || '#' || (n_chars % 7) AS stem", "doc_id AS seq", "text", "'{}' AS metadata")
    files.write_index_docs(docs, folder)
    return spark.read.parquet(folder).select("route", "kind", "stem", "n_copies", "seq", "text")


@query("write_predictions", """
SELECT 'SYN' || v.doc_id AS case_id, label, clause, reason, quality AS truth FROM verdicts v LEFT JOIN labels USING (doc_id)""", inputs=("verdicts",))
def write_predictions(spark, t):
    folder = work_dir(spark, "predictions")
    joined = t.verdicts.join(t.labels, "doc_id", "left").selectExpr("'SYN' || doc_id AS case_id", "label", "clause", "reason", "quality AS truth")
    files.write_predictions(joined, folder)
    return spark.read.schema("case_id string, label int, clause string, reason string, truth int").json(folder)


@query("stage_layout", f"""WITH {GATE_SQL.strip()}
SELECT case_id, CAST(case_id % 8 AS INT) AS slice, clause, CASE WHEN case_id % 8 = 3 THEN 2 ELSE 1 END AS revision FROM gate""", inputs=("cases", "case_days"))
def stage_layout(spark, t):
    root = work_dir(spark, "stages")
    analysis = gate_of(t).select("case_id", "clause", (F.col("case_id") % 8).cast("int").alias("slice"))
    files.write_stage(analysis.withColumn("revision", F.lit(1)), root, "analysis", "slice")
    files.write_stage(analysis.filter("slice = 3").withColumn("revision", F.lit(2)), root, "analysis", "slice")
    return files.read_stage(spark, root, "analysis").select("case_id", "slice", "clause", "revision")


def _payload_cases(t):
    return t.cases.withColumn("schema_version", F.lit(V.SCHEMA_VERSION)).withColumn("has_admissibility", F.lit(True)) \
        .withColumn("has_extracted_fields", F.lit(True)).withColumn("has_raw_text", F.lit(True)) \
        .withColumn("is_admissible", F.col("case_id") % 19 != 0).withColumn("note", F.lit("前段"))


@query("case_disposition_flow", f"""WITH {DISPOSITION_SQL}, {GATE_SQL.strip()}, {FINDINGS_SQL[FINDINGS_SQL.index('miss AS'):]},
{majority_sql("SELECT case_id, count(*) AS n_red FROM findings WHERE level = 'red' GROUP BY case_id")},
{MERGED_SQL[len(PAIRS_SQL.strip()):].lstrip(", ").strip()},
found_laws AS (SELECT query_id AS case_id, count(*) AS n_laws FROM merged GROUP BY query_id),
s AS (SELECT *, CASE WHEN route_key = 'traffic' THEN 'error' WHEN case_id % 19 = 0 OR clause IS NOT NULL THEN 'inadmissible' ELSE 'merits' END AS state FROM gate)
SELECT s.case_id, state, CASE state WHEN 'inadmissible' THEN '訴願不受理' WHEN 'merits' THEN d.disposition END AS disposition,
  CASE WHEN state = 'error' THEN 'route_key ''traffic'' 不在枚舉' WHEN state = 'merits' THEN d.basis WHEN s.case_id % 19 = 0 THEN '前段判定程序不受理（快速通道，未進實體審查）'
   ELSE '後段程序審查判定不受理（§' || clause || '）：' || CASE clause WHEN '77-2' THEN '提起訴願日（' || filed_date || '）逾法定期間末日（' || dead_roc || '）' || overdue_days || ' 日，依訴願法第77條第2款應不受理。'
    WHEN '77-6' THEN '原行政處分已經撤銷或失效，依訴願法第77條第6款應不受理。' ELSE '就同一處分前已提起訴願並經決定或撤回，依訴願法第77條第7款應不受理。' END END AS basis,
  CASE WHEN state = 'merits' THEN coalesce(n_laws, 0) ELSE 0 END AS n_laws FROM s LEFT JOIN decided d USING (case_id) LEFT JOIN found_laws USING (case_id)""", inputs=("vectors", "cases", "case_days"))
def case_disposition_flow(spark, t):
    @cache
    def asking(open_cases):
        # both searches ask the same, and read it more than once: the gate is not to be run for each
        return stored(_vectors(t).join(open_cases.withColumnRenamed("case_id", "query_id"), "query_id", "left_semi"), "asking")

    def laws(open_cases):
        return merged_hits(t, asking(open_cases)).select(F.col("query_id").alias("case_id"), "citation")

    def votes(open_cases):
        found = retrieval.find_similar(asking(open_cases), t.vectors.drop("query_route"))
        return found.select(F.col("query_id").alias("case_id"), F.col("position").alias("rank"), labels.normalized_disposition(F.col("disposition")).alias("label"))

    return review_cases(_payload_cases(t), votes, laws)


# ---- streams ---------------------------------------------------------------
_EVENT_SCHEMA = ("case_id bigint, agency string, doc_no string, legal_basis string, disposition_date string, service_date string, act_date string, filed_date string, "
                 "service_method string, revoked string, disposition_revoked string, previously_decided string, reply string")

_EVENT_GATE_SQL = """
e0 AS (SELECT *, svc + CASE WHEN event_type = 'view' THEN 10 ELSE 0 END AS eff FROM event_days),
e1 AS (SELECT *, eff + 30 + CASE isodow(eff + 30) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS dead FROM e0),
eg AS (SELECT *, CASE WHEN fil > dead THEN '77-2' WHEN event_type = 'error' THEN '77-6' END AS clause FROM e1)"""


@query("case_arrival_stream", f"WITH {_EVENT_GATE_SQL.strip()} SELECT case_id, clause, CASE WHEN fil > dead THEN fil - dead END AS overdue_days FROM eg", inputs=("event_days",))
def case_arrival_stream(spark, t):
    root = work_dir(spark, "arrivals")
    t.event_cases.write.json(f"{root}/input")
    arrivals.land_cases(spark, f"{root}/input", _EVENT_SCHEMA, f"{root}/tables")
    return arrivals.analyze(spark.read.parquet(f"{root}/tables/landed")).select("case_id", "clause", "overdue_days")


@query("arrival_quarantine", """
SELECT CASE WHEN case_id % 50 = 0 THEN 'quarantine' ELSE 'landed' END AS place, case_id, CAST(NULL AS BIGINT) AS n FROM event_days
UNION ALL SELECT 'good', NULL, count(*) FILTER (case_id % 50 <> 0) FROM event_days UNION ALL SELECT 'bad', NULL, count(*) FILTER (case_id % 50 = 0) FROM event_days
UNION ALL SELECT 'empty files', NULL, 1""", inputs=("event_days",))
def arrival_quarantine(spark, t):
    """Every 50th record is cut off in its middle, and one file holds a blank line only."""
    root = work_dir(spark, "quarantine")
    record = F.to_json(F.struct("*"))
    t.event_cases.select(F.when(F.col("case_id") % 50 == 0, F.left(record, F.lit(60))).otherwise(record).alias("value")).write.text(f"{root}/input")
    t.event_cases.agg(F.lit("").alias("value")).write.mode("append").text(f"{root}/input")
    arrivals.land_cases(spark, f"{root}/input", _EVENT_SCHEMA, f"{root}/tables", glob="*.txt")
    landed = spark.read.parquet(f"{root}/tables/landed").select(F.lit("landed").alias("place"), "case_id", F.lit(None).cast("long").alias("n"))
    aside = spark.read.parquet(f"{root}/tables/quarantine").select(F.lit("quarantine"), F.regexp_extract("record", '"case_id":([0-9]+)', 1).cast("long"), F.lit(None).cast("long"))
    report = arrivals.arrival_report(spark, f"{root}/tables").agg(F.sum("n_good"), F.sum("n_bad"), F.sum((F.col("state") == "empty").cast("long")))
    numbers = report.select(F.explode(F.map_from_arrays(F.array(F.lit("good"), F.lit("bad"), F.lit("empty files")), F.array(*report.columns))).alias("place", "n"))
    return landed.union(aside).union(numbers.select("place", F.lit(None).cast("long"), "n"))


_FLOW_SCHEMA = f"{_EVENT_SCHEMA}, penalty_amount bigint, violation_count int, requires_prior_order boolean, prior_order_done boolean, claim_ids string"

_FLOW_CHECKS = {
    "V1": ("CASE WHEN case_id % 7 = 0 THEN 'skipped' WHEN case_id % 3 = 0 OR user_id % 90 + 1 IN (9, case_id % 90 + 1) THEN 'pass' ELSE 'fail' END", "'red'"),
    "V2": ("'pass'", "'amber'"),
    "V3": ("'pass'", "'red'"),
    "V4": ("CASE WHEN case_id % 3 = 0 THEN 'skipped' WHEN case_id % 3 = 1 AND case_id % 2 = 0 THEN 'pass' ELSE 'fail' END", "'red'"),
    "V5": ("'skipped'", "'red'"),
    "V6": ("CASE WHEN case_id % 5 = 0 AND DATE '2024-01-01' NOT IN (svc, fil) THEN 'fail' ELSE 'pass' END", "'amber'"),
    "V7": ("CASE WHEN fil < svc OR (fil - svc > 30) <> (case_id % 4 = 2) THEN 'fail' ELSE 'pass' END", "CASE WHEN fil - svc BETWEEN 0 AND 30 AND case_id % 4 = 2 THEN 'amber' ELSE 'red' END"),
    "V8": ("CASE case_id % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN 'fail' ELSE 'pass' END", "'red'"),
    "V9": ("CASE WHEN case_id % 4 = 3 THEN 'skipped' WHEN case_id % 4 = 1 AND case_id % 5 = 1 THEN 'fail' ELSE 'pass' END", "'red'"),
    "V10": ("CASE WHEN case_id % 2 = 1 THEN 'skipped' WHEN case_id % 8 = 0 THEN 'pass' ELSE 'fail' END", "'amber'"),
}


def flow_laws(t):
    """Recommended laws of the arriving cases: two articles, for some also the one their draft declares, for some none."""
    articles = F.array(F.lit(9), F.col("case_id") % 90 + 1, F.when(F.col("wide"), F.col("user_id") % 90 + 1))
    rows = t.flow_laws.filter(~F.col("none")).select("case_id", F.explode(articles).alias("article")).filter(F.col("article").isNotNull())
    text = F.lit("").alias
    return rows.select("case_id", F.lit(None).cast("string").alias("citation"), F.lit("洗錢防制法").alias("law"), F.col("article").cast("string").alias("article"),
                       text("title"), text("text"), text("source"))


@query("stream_stage_flow", f"""WITH {_EVENT_GATE_SQL.strip()}, open AS (SELECT *, {FLOW_TEXT} AS grounds FROM eg WHERE clause IS NULL)
SELECT 'analysis' AS stage, case_id, coalesce(clause, '') AS detail FROM eg
UNION ALL SELECT 'findings', case_id, 'D1:red' FROM eg WHERE case_id % 2 = 0
UNION ALL SELECT 'draft', case_id, {pick("case_id % 4", "'訴願駁回。'", "'原處分撤銷。'", "'訴願不受理。'", other="'另為處理'")} || grounds FROM open
""" + "".join(f"UNION ALL SELECT 'verify', case_id, '{check}:' || {status} || ':' || {level} FROM open\n" for check, (status, level) in _FLOW_CHECKS.items()), inputs=("event_days",))
def stream_stage_flow(spark, t):
    root = work_dir(spark, "flow")
    t.flow_cases.write.json(f"{root}/input")
    arrivals.stage_flow(arrivals.case_arrivals(spark, f"{root}/input", _FLOW_SCHEMA), f"{root}/stages", f"{root}/checkpoint", flow_laws(t))

    def rows(stage, detail):
        return files.read_stage(spark, f"{root}/stages", stage).select(F.lit(stage).alias("stage"), "case_id", detail.alias("detail"))

    return rows("analysis", F.coalesce("clause", F.lit(""))).unionByName(rows("findings", F.concat_ws(":", "check_id", "level"))) \
        .unionByName(rows("draft", F.concat("main", "text"))).unionByName(rows("verify", F.concat_ws(":", "check_id", "status", "level")))


_KEY_SQL = "left(sha256('{\"event_type\":\"' || event_type || '\",\"props\":\"' || replace(props, '\"', '\\\"') || '\"}'), 32)"


@query("dedup_requests", f"""
SELECT {_KEY_SQL} AS request_key, count(*) AS n_asked, min(event_id) FILTER (event_id % 11 <> 0) AS event_id FROM events GROUP BY 1""")
def dedup_requests(spark, t):
    requests = t.events.selectExpr("event_id", "event_type", "props", "CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS is_mock")
    return arrivals.dedup_requests(requests, ["event_type", "props"], ["event_id"]).select("request_key", "n_asked", "event_id")


@query("dedup_stream", f"SELECT DISTINCT {_KEY_SQL} AS request_key, event_type, props FROM events")
def dedup_stream(spark, t):
    root = work_dir(spark, "requests")
    t.events.select("ts", "event_type", "props").write.parquet(f"{root}/input")
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string, props string").parquet(f"{root}/input")
    once = arrivals.dedup_stream(stream, ["event_type", "props"], "ts", "60 days")
    arrivals.land(once, f"{root}/once", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/once").select("request_key", "event_type", "props")


@query("dedup_state", f"""
WITH a AS (SELECT {_KEY_SQL} AS request_key, event_id % 3 AS batch, count(*) AS n, min(ts) AS first_at, min(event_id) FILTER (event_id % 11 <> 0) AS event_id FROM events GROUP BY 1, 2),
k AS (SELECT *, min(first_at) OVER (PARTITION BY request_key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM a)
SELECT request_key, CAST(sum(n) AS BIGINT) AS n_asked, count(*) FILTER (known IS NULL) AS n_first, count(*) FILTER (first_at < known) AS n_late, min(event_id) AS event_id FROM k GROUP BY 1""")
def dedup_state(spark, t):
    """The events come in three batches; none of the requests expires between them."""
    root = work_dir(spark, "asked")
    rows = t.events.selectExpr("event_id", "event_type", "props", "CAST(ts AS timestamp) AS ts", "CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS is_mock")
    for batch in range(3):
        rows.filter(F.col("event_id") % 3 == batch).write.mode("append").parquet(f"{root}/input")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/input")
        requests.collect_requests(stream, root, f"{root}/checkpoint/asked", ["event_type", "props"], "ts", ["event_id"])
    requests.book_requests(spark, root, f"{root}/checkpoint/book", timedelta(days=36_500))
    return requests.request_answers(requests.booked(spark, root)).select("request_key", "n_asked", "n_first", "n_late", "answer.event_id")
