"""Queries over documents: parsing, rendering, metadata, masking, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import citations as C
from docketry.functions import text as T
from docketry.operators import corpus
from docketry.plans.registry import query, sql_case

_CJK = "[一-鿿]"
_STRIP = "regexp_replace(regexp_replace({0}, '^[\\s　]+', ''), '[\\s　]+$', '')"


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


@query("route_from_path", r"""
SELECT page_id, path,
       CASE WHEN contains(path, '歷史訴願決定書') THEN 'decision' WHEN contains(path, '相關法規') THEN 'law'
            WHEN contains(path, '行政函釋') THEN 'interpretation' WHEN contains(path, '司法院釋字及行政判解') THEN 'judgment'
            ELSE 'unknown' END AS folder_type,
       regexp_extract(path, 'related-laws/([^/]*)', 1) AS sub_prefix,
       CASE regexp_extract(path, 'related-laws/([^/]*)', 1) WHEN 'statutes' THEN 'law' WHEN 'interpretations' THEN 'interpretation'
            WHEN 'judicial' THEN 'judgment' END AS prefix_type,
       CASE WHEN regexp_extract(path, 'related-laws/([^/]*)', 1) IN ('statutes', 'interpretations', 'judicial') THEN 0 ELSE 1 END AS skipped
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'related-laws/statutes/' WHEN 1 THEN 'related-laws/interpretations/' WHEN 2 THEN 'related-laws/judicial/'
      WHEN 3 THEN 'related-laws/drafts/' WHEN 4 THEN '歷史訴願決定書/' ELSE '相關法規/' END || url AS path FROM pages)
""")
def route_from_path(spark, t):
    path = "CASE page_id % 6 WHEN 0 THEN 'related-laws/statutes/' WHEN 1 THEN 'related-laws/interpretations/' WHEN 2 THEN 'related-laws/judicial/' " \
           "WHEN 3 THEN 'related-laws/drafts/' WHEN 4 THEN '歷史訴願決定書/' ELSE '相關法規/' END || url AS path"
    return corpus.route_from_path(t.pages.selectExpr("page_id", path), "related-laws/")


_FILE_NAMES = """CASE WHEN p_partkey % 10 = 0 THEN p_name || '.pdf' ELSE p_partkey || '.' || (105 + p_size % 10) || '年-'
 || CASE p_partkey % 4 WHEN 0 THEN '空氣汙染管制法' WHEN 1 THEN '空氣汙染防制法' WHEN 2 THEN '建築法' ELSE p_type END
 || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-77條2款-不受理' WHEN 2 THEN '-79條-' || p_name || '-駁回' WHEN 3 THEN '-81條-' || p_brand || '-撤銷-另為處分' ELSE '-79條' END
 || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.pdf 的副本.pdf' ELSE '' END END"""

_META_SQL = f"""
names AS (SELECT p_partkey, {_FILE_NAMES} AS file_name FROM part),
cut AS (SELECT *, regexp_replace(regexp_replace(file_name, '\\.pdf 的副本\\.pdf$', ''), '\\.pdf$', '') AS stem FROM names),
hit AS (SELECT *, regexp_matches(stem, '^[0-9]+\\.[0-9]{{3}}年-.+$') AS ok, string_split(regexp_extract(stem, '^[0-9]+\\.[0-9]{{3}}年-(.+)$', 1), '-') AS p FROM cut),
meta AS (SELECT p_partkey, file_name, CASE WHEN ok THEN 0 ELSE 1 END AS parse_error,
  CASE WHEN ok THEN regexp_extract(stem, '^([0-9]+)', 1) END AS serial,
  CASE WHEN ok THEN CAST(regexp_extract(stem, '^[0-9]+\\.([0-9]{{3}})', 1) AS INT) END AS year,
  CASE WHEN ok THEN CASE p[1] WHEN '空氣汙染防制法' THEN '空氣污染防制法' WHEN '空氣汙染管制法' THEN '空氣污染防制法' WHEN '空氣污染管制法' THEN '空氣污染防制法' ELSE p[1] END END AS case_type,
  CASE WHEN ok THEN p[1] END AS case_type_raw, CASE WHEN ok AND len(p) > 1 THEN p[2] END AS basis,
  CASE WHEN ok AND len(p) >= 4 THEN p[3] END AS reason,
  CASE WHEN ok AND len(p) = 3 THEN p[3] WHEN ok AND len(p) >= 4 THEN array_to_string(p[4:], '-') END AS disposition,
  CASE WHEN ok THEN regexp_extract(stem, '^[0-9]+\\.([0-9]{{3}})', 1) || '#' || regexp_extract(stem, '^([0-9]+)', 1) END AS doc_id FROM hit)
"""


def _file_metas(t):
    return corpus.parse_filename_meta(t.part.selectExpr("p_partkey", f"{_FILE_NAMES} AS file_name"))


@query("parse_filename_meta", f"WITH {_META_SQL} SELECT * FROM meta")
def parse_filename_meta(spark, t):
    return _file_metas(t)


@query("corpus_stats", f"""WITH {_META_SQL}
SELECT 'total' AS facet, '*' AS member, count(*) AS n_docs FROM meta WHERE parse_error = 0
UNION ALL SELECT 'case_type', case_type, count(*) FROM meta WHERE parse_error = 0 GROUP BY case_type
UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM meta WHERE parse_error = 0 GROUP BY year""")
def corpus_stats(spark, t):
    return corpus.corpus_stats(_file_metas(t))


_TYPE_NAMES = """CASE n_nationkey % 7 WHEN 0 THEN '違反洗錢防制法事件' WHEN 1 THEN '違反廢棄物清理法事件' WHEN 2 THEN '空氣污染防制法事件'
 WHEN 3 THEN '違反建築法事件' WHEN 4 THEN '違反噪音管制法事件' WHEN 5 THEN '空氣汙染管制法' ELSE n_name END"""


@query("canonical_case_type", f"""
SELECT c_custkey, raw_type,
  CASE raw_type WHEN '空氣汙染防制法' THEN '空氣污染防制法' WHEN '空氣汙染管制法' THEN '空氣污染防制法' WHEN '空氣污染管制法' THEN '空氣污染防制法' ELSE raw_type END AS case_type,
  {sql_case('raw_type', V.CASE_TYPE_TO_ROUTE, "'general'")} AS route_key
FROM (SELECT c_custkey, {_TYPE_NAMES} AS raw_type FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def canonical_case_type(spark, t):
    rows = t.customer.join(t.nation, t.customer.c_nationkey == t.nation.n_nationkey).selectExpr("c_custkey", f"{_TYPE_NAMES} AS raw_type")
    canonical = corpus.canonical_case_type(F.col("raw_type"))
    return rows.select("c_custkey", "raw_type", canonical.alias("case_type"), corpus.route_of_case_type(canonical).alias("route_key"))


@query("resolve_route", f"""
SELECT c_custkey, asked, CASE WHEN asked IN ({", ".join(f"'{r}'" for r in V.ROUTES)}) THEN asked ELSE 'general' END AS route_key
FROM (SELECT c_custkey, CASE c_nationkey % 8 WHEN 0 THEN 'money_laundering' WHEN 1 THEN 'waste' WHEN 2 THEN 'air_pollution' WHEN 3 THEN 'building'
 WHEN 4 THEN 'noise' WHEN 5 THEN 'general' WHEN 6 THEN 'traffic' END AS asked FROM customer)""")
def resolve_route(spark, t):
    asked = "CASE c_nationkey % 8 WHEN 0 THEN 'money_laundering' WHEN 1 THEN 'waste' WHEN 2 THEN 'air_pollution' WHEN 3 THEN 'building' " \
            "WHEN 4 THEN 'noise' WHEN 5 THEN 'general' WHEN 6 THEN 'traffic' END AS asked"
    return t.customer.selectExpr("c_custkey", asked).withColumn("route_key", corpus.resolve_route(F.col("asked")))


_WITH_DIGITS = "'案號 1\n13 年\r\n第 22\n\n 條\t\t完\n\n\n\n' || text || '  　 '"


@query("normalize_text", r"""
WITH src AS (SELECT doc_id, replace(""" + _WITH_DIGITS + r""", chr(13) || chr(10), chr(10)) AS t0 FROM documents),
-- no lookaround: capture both digits; a digit may be the right side of one break and the left side of the next, so two rounds
a AS (SELECT doc_id, regexp_replace(t0, '([0-9])[\s　\x1c-\x1f\x{85}\x{a0}]*\n[\s　\x1c-\x1f\x{85}\x{a0}]*([0-9])', '\1\2', 'g') AS t1 FROM src),
b AS (SELECT doc_id, regexp_replace(t1, '([0-9])[\s　\x1c-\x1f\x{85}\x{a0}]*\n[\s　\x1c-\x1f\x{85}\x{a0}]*([0-9])', '\1\2', 'g') AS t2 FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t2, '[ \t　]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t3 FROM b)
SELECT doc_id, regexp_replace(regexp_replace(t3, '^[\s　\x1c-\x1f\x{85}\x{a0}]+', ''), '[\s　\x1c-\x1f\x{85}\x{a0}]+$', '') AS text FROM c""")
def normalize_text(spark, t):
    return t.documents.selectExpr("doc_id", f"{_WITH_DIGITS} AS text").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


_DECISION_TEXT = """'前言 ' || source || CASE doc_id % 4 WHEN 0 THEN '\n主文：訴願駁回。\n\n' WHEN 1 THEN '\n主 文\n 原處分撤銷。\n\n' ELSE '\n' END
 || CASE doc_id % 3 WHEN 0 THEN '事實及理由：按洗錢防制法規定。卷查本件。綜上論結，訴願無理由。' WHEN 1 THEN '理由 經查屬實。綜上 駁回' ELSE '' END || '\n' || text"""


def _section_sql(text: str, markers: list[str]) -> str:
    out = "''"
    for m in reversed(markers):
        tail = f"ltrim(substr({text}, instr({text}, '{m}') + {len(m)}), '：: 　' || chr(10))"
        out = f"CASE WHEN contains({text}, '{m}') THEN {strip_sql(f'string_split({tail}, chr(10) || chr(10))[1]')} ELSE {out} END"
    return out


@query("split_sections", f"""
WITH src AS (SELECT doc_id, {_DECISION_TEXT} AS text FROM documents),
r AS (SELECT doc_id, {_section_sql('text', V.MAIN_MARKERS)} AS main_ruling,
  CASE WHEN {_section_sql('text', V.REASON_MARKERS)} = '' THEN text ELSE {_section_sql('text', V.REASON_MARKERS)} END AS reasons FROM src)
SELECT doc_id, main_ruling, reasons, {_section_sql('reasons', V.LAW_BASIS_MARKERS)} AS law_basis,
  {_section_sql('reasons', V.APPLICATION_MARKERS)} AS application, {_section_sql('reasons', V.CONCLUSION_MARKERS)} AS conclusion FROM r""")
def split_sections(spark, t):
    docs = t.documents.selectExpr("doc_id", f"{_DECISION_TEXT} AS text")
    block = T.section_after(F.col("text"), V.REASON_MARKERS)
    staged = docs.select("doc_id", T.section_after(F.col("text"), V.MAIN_MARKERS).alias("main_ruling"),
                         F.coalesce(T.blank_to_null(block), F.col("text")).alias("reasons"))
    return staged.select(
        "doc_id", "main_ruling", "reasons", T.section_after(F.col("reasons"), V.LAW_BASIS_MARKERS).alias("law_basis"),
        T.section_after(F.col("reasons"), V.APPLICATION_MARKERS).alias("application"),
        T.section_after(F.col("reasons"), V.CONCLUSION_MARKERS).alias("conclusion"))


_DECISION_ROWS = """SELECT o_orderkey AS case_id, '案' || o_orderkey AS case_number, c_name AS title, c_mktsegment AS law_category,
 CASE WHEN o_orderkey % 3 = 0 THEN ' 台灣 空氣汙染防制法第' || o_orderkey || '條 ' WHEN o_orderkey % 3 = 1 THEN '' ELSE NULL END AS source_law,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '新北府訴決字第' || o_orderkey || '號' END AS dispatch_number,
 CASE WHEN o_orderkey % 7 = 0 THEN '不詳' ELSE CAST(CAST(o_orderdate AS date) AS string) END AS publish_date,
 CASE o_orderstatus WHEN 'F' THEN '訴願駁回' WHEN 'O' THEN '原處分撤銷' ELSE '' END AS ruling_label, o_orderstatus AS ruling_class,
 CASE WHEN o_orderkey % 4 = 0 THEN '訴願駁回。' ELSE NULL END AS main_ruling, o_orderpriority AS original_agency,
 CASE WHEN o_orderkey % 2 = 0 THEN ' 事實 ' || c_acctbal ELSE '' END AS facts, CASE WHEN o_orderkey % 6 < 2 THEN '理由如下' END AS reasons, CASE WHEN o_orderkey % 6 = 1 THEN '  ' END AS remedy,
 ' 全文 ' || c_name AS full_text, o_custkey AS cust_key FROM orders JOIN customer ON o_custkey = c_custkey"""


def _decisions(spark, t):
    t.orders.createOrReplaceTempView("decision_orders")
    t.customer.createOrReplaceTempView("decision_customer")
    rows = spark.sql(_DECISION_ROWS.replace("FROM orders JOIN customer", "FROM decision_orders JOIN decision_customer"))
    return rows.withColumn("related_articles", F.array(F.concat(F.lit("訴願法第"), F.col("cust_key"), F.lit("條")), F.lit("行政罰法第7條")))


_DECISION_COLS = ["case_number", "title", "law_category", "source_law", "dispatch_number", "publish_date", "ruling_label", "ruling_class",
                  "main_ruling", "original_agency", "facts", "reasons", "remedy", "full_text", "related_articles"]


@query("render_decision_text", f"""
WITH d AS ({_DECISION_ROWS}),
s AS (SELECT *, CASE WHEN trim(facts) <> '' THEN '【事實】' || chr(10) || trim(facts) END AS s1, CASE WHEN trim(reasons) <> '' THEN '【理由】' || chr(10) || trim(reasons) END AS s2,
  CASE WHEN trim(remedy) <> '' THEN '【教示】' || chr(10) || trim(remedy) END AS s3 FROM d)
SELECT case_id, '案號：' || case_number || chr(10) || '案由：' || title || chr(10) || '法規類別：' || law_category
  || CASE WHEN trim(coalesce(source_law, '')) <> '' THEN chr(10) || '實際案由：' || translate(trim(source_law), '汙台', '污臺') ELSE '' END
  || chr(10) || '決定書字號：' || dispatch_number || chr(10) || '決定日期：' || publish_date || chr(10) || '主文：' || coalesce(main_ruling, ruling_label)
  || chr(10) || '原處分機關：' || original_agency || chr(10) || '相關法條：訴願法第' || cust_key || '條、行政罰法第7條' || chr(10) || chr(10)
  || CASE WHEN s1 IS NULL AND s2 IS NULL AND s3 IS NULL THEN '【全文】' || chr(10) || trim(full_text) ELSE concat_ws(chr(10) || chr(10), s1, s2, s3) END || chr(10) AS text FROM s""")
def render_decision_text(spark, t):
    columns = {c: F.col(c) for c in _DECISION_COLS}
    return _decisions(spark, t).select("case_id", corpus.render_decision(columns).alias("text"))


@query("render_statute_text", """
WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '台北空氣汙染自治條例' ELSE '法規' || p_brand END AS law,
  CASE WHEN p_size % 2 = 0 THEN '88年' ELSE '' END AS amended, '第  ' || p_size || ' 條' AS no1, CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE p_name END AS c1,
  CASE WHEN p_partkey % 8 = 0 THEN '' ELSE ' 內容 ' || p_type || ' ' END AS c2, '全文 ' || p_name AS full_text FROM part),
b AS (SELECT *, translate(law, '汙台', '污臺') AS name FROM a)
SELECT p_partkey, '法規名稱：' || name || chr(10) || '最新修正：' || amended || chr(10) || chr(10)
 || CASE WHEN trim(c1) = '' AND trim(c2) = '' THEN full_text ELSE
    concat_ws(chr(10) || chr(10), CASE WHEN trim(c1) <> '' THEN name || regexp_replace(no1, ' +', ' ', 'g') || chr(10) || trim(c1) END,
                                  CASE WHEN trim(c2) <> '' THEN name || '第2條' || chr(10) || trim(c2) END) END || chr(10) AS text FROM b""")
def render_statute_text(spark, t):
    rows = t.part.selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN '台北空氣汙染自治條例' ELSE '法規' || p_brand END AS law",
        "CASE WHEN p_size % 2 = 0 THEN '88年' ELSE '' END AS amended",
        "array(named_struct('article_no', '第  ' || p_size || ' 條', 'content', CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE p_name END),"
        " named_struct('article_no', '第2條', 'content', CASE WHEN p_partkey % 8 = 0 THEN '' ELSE ' 內容 ' || p_type || ' ' END)) AS articles",
        "'全文 ' || p_name AS full_text")
    return rows.select("p_partkey", corpus.render_statute(F.col("law"), F.col("amended"), F.col("articles"), F.col("full_text")).alias("text"))


@query("render_ref_text", """
SELECT item_id, '標題：' || CASE WHEN item_id % 2 = 0 THEN '函釋' || item_id ELSE 'f' || item_id || '.json' END || chr(10) || chr(10) || trim(text) || chr(10) AS text FROM benchmark""")
def render_ref_text(spark, t):
    title = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("函釋"), F.col("item_id"))).otherwise("")
    return t.benchmark.select("item_id", corpus.render_reference(title, F.concat(F.lit("f"), F.col("item_id"), F.lit(".json")), F.col("text")).alias("text"))


_CLEAN = "left(translate(regexp_replace(coalesce(source_law, ''), '\\s+', '', 'g'), '汙台', '污臺'), 30)"


@query("build_doc_metadata", f"""
WITH d AS ({_DECISION_ROWS})
SELECT case_id, 'waste' AS case_type, 'decision' AS doc_type, CASE WHEN publish_date = '不詳' THEN 0 ELSE CAST(substr(publish_date, 1, 4) AS INT) - 1911 END AS year,
  nullif(ruling_label, '') AS disposition, ruling_class, CASE WHEN dispatch_number = '' THEN case_number ELSE dispatch_number END AS doc_id, nullif({_CLEAN}, '') AS source_law,
  CASE case_id % 4 WHEN 0 THEN 'common_law' WHEN 1 THEN 'law' WHEN 2 THEN 'interpretation' ELSE 'law' END AS law_doc_type,
  CASE case_id % 4 WHEN 0 THEN '行政罰法' WHEN 1 THEN '空氣污染防制法' WHEN 2 THEN '行政罰法' ELSE NULL END AS law_name FROM d""")
def build_doc_metadata(spark, t):
    rows = _decisions(spark, t)
    attributes = corpus.decision_attributes(F.lit("waste"), {c: F.col(c) for c in _DECISION_COLS})
    kind = F.when(F.col("case_id") % 4 == 2, "interpretation").otherwise("law")
    name = F.when(F.col("case_id") % 4 == 1, "空氣汙染防制法").when(F.col("case_id") % 4 == 3, "").otherwise("行政罰法")
    law = corpus.law_attributes(F.lit("waste"), kind, name, F.lit(""))
    staged = rows.select("case_id", attributes.alias("a"), law.alias("l"))
    return staged.select("case_id", "a.case_type", "a.doc_type", "a.year", "a.disposition", "a.ruling_class", "a.doc_id", "a.source_law",
                         F.col("l.doc_type").alias("law_doc_type"), F.col("l.law_name").alias("law_name"))


@query("metadata_size_check", r"""
WITH m AS (SELECT doc_id, '{"metadataAttributes":{"case_type":"' || source || '","year":' || n_chars || ',"title":"' || repeat('訴願', CAST(n_chars % 300 AS INT)) || '"}}' AS simple FROM documents)
SELECT doc_id, octet_length(encode(simple)) AS n_bytes, CASE WHEN octet_length(encode(simple)) > 1024 THEN 1 ELSE 0 END AS oversized,
  octet_length(encode(simple)) + 126 AS typed_bytes FROM m""")
def metadata_size_check(spark, t):
    attributes = F.struct(F.col("source").alias("case_type"), F.col("n_chars").alias("year"),
                          F.repeat(F.lit("訴願"), (F.col("n_chars") % 300).cast("int")).alias("title"), F.lit(None).cast("string").alias("dropped"))
    staged = t.documents.select("doc_id", attributes.alias("a"))
    simple = corpus.metadata_bytes(corpus.simple_metadata(F.col("a")))
    typed = corpus.metadata_bytes(corpus.typed_metadata(F.col("a"), {"case_type": "string", "year": "number", "title": "string", "dropped": "string"}))
    return staged.select("doc_id", simple.cast("bigint").alias("n_bytes"), (simple > V.METADATA_BYTE_LIMIT).cast("int").alias("oversized"),
                         typed.cast("bigint").alias("typed_bytes"))


_DOC_NO = "'於民國88年3月1日以新北環' || CASE o_orderkey % 3 WHEN 0 THEN '稽' WHEN 1 THEN '空' ELSE '' END || '字第 ' || o_orderkey || ' 號裁處' || CASE o_orderkey % 4 WHEN 0 THEN '，依環字第9號' ELSE '' END"
_DOC_NO_2 = f"CASE o_orderkey % 5 WHEN 0 THEN '無字號' WHEN 1 THEN '依日府字第A' || o_orderkey || '號' ELSE {_DOC_NO} END"


@query("extract_doc_no", f"""
WITH s AS (SELECT o_orderkey, {_DOC_NO_2} AS text FROM orders),
r AS (SELECT o_orderkey, replace(regexp_extract(text, '({_CJK}{{2,8}}字第\\s*[0-9A-Za-z]+\\s*號)', 1), ' ', '') AS raw FROM s),
n AS (SELECT *, least(length(regexp_extract(raw, '^([{V.DOC_NO_LEADING}]*)', 1)), greatest(instr(raw, '字第') - 1 - 2, 0)) AS drop_n FROM r)
SELECT o_orderkey, substr(raw, CAST(drop_n AS INT) + 1) AS doc_no FROM n""")
def extract_doc_no(spark, t):
    return t.orders.selectExpr("o_orderkey", f"{_DOC_NO_2} AS text").select("o_orderkey", T.document_number(F.col("text")).alias("doc_no"))


_AMOUNTS = "'依第' || l_linenumber || '條，第2元，' || CASE l_partkey % 3 WHEN 0 THEN '處新臺幣' || (l_suppkey + 1) || ',000元罰鍰' WHEN 1 THEN '罰鍰 ' || (l_suppkey % 9 + 1) || ' 萬元' ELSE '裁處' || CAST(l_quantity AS int) || '元及' || (1000 + l_suppkey) || '元' END"


@query("extract_amount", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_AMOUNTS} AS text FROM lineitem),
h AS (SELECT *, regexp_extract_all(text, '[0-9,]+\\s*萬?\\s*元') AS hits FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_transform(list_filter(hits, lambda h: contains(h, '萬') OR CAST(nullif(regexp_replace(h, '[^0-9]', '', 'g'), '') AS BIGINT) >= 1000),
  lambda h: CAST(regexp_replace(h, '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN contains(h, '萬') THEN 10000 ELSE 1 END)[1] AS amount FROM h""")
def extract_amount(spark, t):
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_AMOUNTS} AS text")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.penalty_amount(F.col("text")).alias("amount"))


# ---- personal data ---------------------------------------------------------
_LABELS = "(?:" + "|".join("[ \\t　]*".join(label) for label in V.PARTY_LABELS) + ")"
_NOT_NAMES = ", ".join(f"'{w}'" for w in V.NOT_NAMES)
_SHORT = ", ".join(f"'{w}'" for w in V.SHORT_LINE_WORDS)
_NAME_END = "(?:[ \\t　]*$|[ \\t　]*[（(].*|[ \\t　]+(?:" + "|".join(V.PARTY_TITLES) + ").*)"
_MASK_NAME = "CASE WHEN length({0}) <= 2 THEN left({0}, 1) || '○' ELSE left({0}, 1) || repeat('○', CAST(length({0}) - 2 AS INT)) || right({0}, 1) END"
_PII_SQL = f"""
src AS (SELECT doc_id, text FROM pii_docs),
p1 AS (SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^A-Z0-9])[A-Z][12][0-9]{{8}}(?:$|[^0-9])')) AS n_id,
  regexp_replace(text, '(^|[^A-Z0-9])[A-Z][12][0-9]{{8}}($|[^0-9])', '\\1○○○\\2', 'g') AS t FROM src),
p2 AS (SELECT doc_id, n_id, len(regexp_extract_all(t, '{V.ADDRESS_PATTERN}')) AS n_address, regexp_replace(t, '{V.ADDRESS_PATTERN}', '○○○', 'g') AS t FROM p1),
p3 AS (SELECT doc_id, n_id, n_address, len(regexp_extract_all(t, '(?:^|[^0-9])09[0-9]{{2}}[-\\s]?[0-9]{{3}}[-\\s]?[0-9]{{3}}(?:$|[^0-9])')) AS n_phone,
  regexp_replace(t, '(^|[^0-9])09[0-9]{{2}}[-\\s]?[0-9]{{3}}[-\\s]?[0-9]{{3}}($|[^0-9])', '\\1○○○\\2', 'g') AS t FROM p2),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM p3),
head AS (SELECT *, regexp_matches(line, '^[ \\t　]*(?:[0-9]{{1,3}}[ \\t　]+)?{_LABELS}[ \\t　]') AS party,
  regexp_extract(line, '^([ \\t　]*(?:[0-9]{{1,3}}[ \\t　]+)?{_LABELS}[ \\t　]{{1,8}}){_CJK}{{2,4}}{_NAME_END}', 1) AS before,
  regexp_extract(line, '^[ \\t　]*(?:[0-9]{{1,3}}[ \\t　]+)?{_LABELS}[ \\t　]{{1,8}}({_CJK}{{2,4}}){_NAME_END}', 1) AS name,
  regexp_extract(line, '^[ \\t　]*({_CJK}{{2,4}})[ \\t　]*$', 1) AS alone FROM lines),
named AS (SELECT *, name <> '' AND name NOT IN ({_NOT_NAMES}) AS masked, NOT party AND alone <> '' AND alone NOT IN ({_SHORT}) AS orphan FROM head),
-- a run of orphan lines counts when the line before the run is a party line
runs AS (SELECT *, max(CASE WHEN NOT orphan THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opener FROM named),
state AS (SELECT r.*, coalesce(o.party, false) AND r.orphan AS follows FROM runs r LEFT JOIN named o ON o.doc_id = r.doc_id AND o.i = r.opener),
out_lines AS (SELECT doc_id, i, masked, follows, CASE WHEN masked THEN before || {_MASK_NAME.format('name')} || substr(line, length(before) + length(name) + 1)
  WHEN follows THEN replace(line, alone, {_MASK_NAME.format('alone')}) ELSE line END AS line FROM state),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) FILTER (masked) AS n_party, count(*) FILTER (follows) AS n_following FROM out_lines GROUP BY doc_id),
masked_docs AS (SELECT doc_id, text, n_id, n_address, n_phone, n_party, n_following FROM joined JOIN p3 USING (doc_id))"""


@query("mask_pii", f"WITH {_PII_SQL.strip()} SELECT * FROM masked_docs", inputs=("pii_docs",))
def mask_pii(spark, t):
    masked = corpus.mask_pii(t.pii_docs.select("doc_id", "text"))
    return masked.select("doc_id", "text", *[F.col(c).cast("bigint").alias(c) for c in ("n_id", "n_address", "n_phone", "n_party", "n_following")])


@query("pii_residual_report", f"""WITH {_PII_SQL.strip()}
SELECT DISTINCT suspect FROM (SELECT regexp_extract(unnest(string_split(text, chr(10))), '^[ \\t　]*({_CJK}{{2,4}})[ \\t　]*$', 1) AS suspect FROM masked_docs)
WHERE suspect <> '' AND suspect NOT IN ({_SHORT})""", inputs=("pii_docs",))
def pii_residual_report(spark, t):
    return corpus.pii_residual_report(corpus.mask_pii(t.pii_docs.select("doc_id", "text")))


_STATS_SQL = f"""{_PII_SQL.strip()},
conv AS (SELECT d.route, CASE WHEN d.doc_id % 3 = 0 THEN 'law' ELSE 'decision' END AS kind, CASE WHEN d.n_chars % 13 = 0 THEN 1 ELSE 0 END AS skipped,
  CASE WHEN d.n_chars > 5000 THEN 1 ELSE 0 END AS oversized, m.* FROM pii_docs d JOIN masked_docs m USING (doc_id))"""


@query("conversion_stats", f"""WITH {_STATS_SQL},
names AS (SELECT DISTINCT route, suspect FROM (SELECT route, regexp_extract(unnest(string_split(text, chr(10))), '^[ \\t　]*({_CJK}{{2,4}})[ \\t　]*$', 1) AS suspect FROM conv WHERE skipped = 0)
  WHERE suspect <> '' AND suspect NOT IN ({_SHORT})),
s AS (SELECT route, count(*) AS suspects FROM names GROUP BY route UNION ALL SELECT '(all)', count(DISTINCT suspect) FROM names),
c AS (SELECT coalesce(route, '(all)') AS route, count(*) FILTER (kind = 'decision' AND skipped = 0) AS decisions, count(*) FILTER (kind <> 'decision' AND skipped = 0) AS laws,
  count(*) FILTER (skipped = 1) AS skipped, count(*) FILTER (oversized = 1 AND skipped = 0) AS oversized,
  CAST(sum(CASE WHEN skipped = 0 THEN n_id ELSE 0 END) AS BIGINT) AS n_id, CAST(sum(CASE WHEN skipped = 0 THEN n_address ELSE 0 END) AS BIGINT) AS n_address,
  CAST(sum(CASE WHEN skipped = 0 THEN n_phone ELSE 0 END) AS BIGINT) AS n_phone, CAST(sum(CASE WHEN skipped = 0 THEN n_party ELSE 0 END) AS BIGINT) AS n_party,
  CAST(sum(CASE WHEN skipped = 0 THEN n_following ELSE 0 END) AS BIGINT) AS n_following FROM conv GROUP BY ROLLUP (route))
SELECT c.*, coalesce(s.suspects, 0) AS suspects FROM c LEFT JOIN s USING (route)""", inputs=("pii_docs",))
def conversion_stats(spark, t):
    docs = t.pii_docs.selectExpr(
        "doc_id", "route", "CASE WHEN doc_id % 3 = 0 THEN 'law' ELSE 'decision' END AS kind", "CASE WHEN n_chars % 13 = 0 THEN 1 ELSE 0 END AS skipped",
        "CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END AS oversized", "text")
    masked = corpus.mask_pii(docs)
    counts = corpus.conversion_stats(masked)
    names = corpus.suspects_per_route(masked.filter(F.col("skipped") == 0))
    return counts.join(names, "route", "left").withColumn("suspects", F.coalesce("suspects", F.lit(0)))
