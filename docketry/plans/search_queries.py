"""Queries over vectors, hits and past decisions. Every vector asks, every other vector answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import labels, text as T
from docketry.operators import evaluation, retrieval
from docketry.plans.registry import query, sql_list


def _vectors(t):
    return t.vectors.select(F.col("doc_id").alias("query_id"), "vec", "query_route",
                            retrieval.corpus_bucket(True).alias("own_bucket"))


PAIRS_SQL = """
v AS (SELECT *, vec::DOUBLE[] AS x, sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[])) AS nrm FROM vectors),
pairs AS (SELECT a.doc_id AS query_id, a.query_route, b.doc_id, b.doc_type, b.doc_route, round(list_inner_product(a.x, b.x) / (a.nrm * b.nrm + 1e-9), 9) AS score
  FROM v a JOIN v b ON a.doc_id <> b.doc_id)"""


def top_sql(name: str, source: str, k: int, key: str = "query_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k})"


@query("cosine_topk", f"WITH {PAIRS_SQL.strip()}, {top_sql('top', 'pairs', 5)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM top", inputs=("vectors",))
def cosine_topk(spark, t):
    corpus = t.vectors.select("doc_id", "vec", F.lit(retrieval.WHOLE).alias("bucket"))
    hits = retrieval.cosine_topk(retrieval.ask(_vectors(t), T.lits([retrieval.WHOLE]), 5), corpus)
    return hits.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("metadata_filter", f"""WITH {PAIRS_SQL.strip()},
ok AS (SELECT * FROM pairs WHERE doc_type IN ('law', 'common_law') AND (doc_route = query_route OR doc_type = 'common_law')), {top_sql('top', 'ok', 5)}
SELECT query_id, doc_id, doc_type, doc_route, rank, round(score, 6) AS score FROM top""", inputs=("vectors",))
def metadata_filter(spark, t):
    hits = retrieval.filtered_search(_vectors(t), t.vectors, ["law"], True, F.col("query_route"), 5)
    attributes = t.vectors.select("doc_id", "doc_type", "doc_route")
    return hits.join(attributes, "doc_id").select("query_id", "doc_id", "doc_type", "doc_route", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("filtered_search_with_fallback", f"""WITH {PAIRS_SQL.strip()},
ok AS (SELECT *, 'filtered' AS layer FROM pairs WHERE doc_type IN ('interpretation', 'judgment') AND doc_route = query_route),
every AS (SELECT * FROM ok UNION ALL SELECT *, 'fallback' FROM pairs WHERE query_id NOT IN (SELECT query_id FROM ok)), {top_sql('top', 'every', 5)}
SELECT query_id, layer, doc_id, rank, round(score, 6) AS score FROM top""", inputs=("vectors",))
def filtered_search_with_fallback(spark, t):
    hits = retrieval.search_with_fallback(_vectors(t), t.vectors, ["interpretation", "judgment"], False, F.col("query_route"), 5)
    return hits.select("query_id", "layer", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


_LAYERS = f"""{PAIRS_SQL.strip()},
law AS (SELECT *, 'law' AS layer FROM pairs WHERE doc_type IN ('law', 'common_law')), {top_sql('law_top', 'law', 5)},
ref AS (SELECT *, 'reference' AS layer FROM pairs WHERE doc_type IN ('interpretation', 'judgment')), {top_sql('ref_top', 'ref', 2)},
layered AS (SELECT * FROM law_top UNION ALL SELECT * FROM ref_top)"""


@query("layered_retrieval", f"WITH {_LAYERS} SELECT query_id, layer, doc_id, rank, round(score, 6) AS score FROM layered", inputs=("vectors",))
def layered_retrieval(spark, t):
    hits = retrieval.layered_search(_vectors(t), t.vectors)
    return hits.select("query_id", "layer", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


MERGED_SQL = f"""{_LAYERS},
hits AS (SELECT h.query_id, h.score, CASE WHEN h.layer = 'law' THEN h.rank ELSE 100 + h.rank END AS pos, d.doc_type, d.law_name, d.text, d.uri FROM layered h JOIN vectors d USING (doc_id)),
cut AS (SELECT *, regexp_extract_all(text, '第\\s*([0-9]+)\\s*條(?:\\s*之\\s*([0-9]+))?') AS arts FROM hits),
cited AS (SELECT query_id, score, pos, doc_type, uri, text, generate_subscripts(arts, 1) AS i, unnest(arts) AS art, law_name FROM cut WHERE doc_type IN ('law', 'common_law')),
named AS (SELECT query_id, score, pos, doc_type, uri, text, i, law_name || '第' || CAST(regexp_extract(art, '第\\s*([0-9]+)', 1) AS INT) || '條'
    || CASE WHEN contains(art, '之') THEN '之' || CAST(regexp_extract(art, '之\\s*([0-9]+)', 1) AS INT) ELSE '' END AS citation FROM cited
  UNION ALL SELECT query_id, score, pos, doc_type, uri, text, 1, CASE WHEN law_name <> '' THEN law_name ELSE regexp_extract(uri, '([^/]*)/*$', 1) END FROM hits WHERE doc_type NOT IN ('law', 'common_law')),
ordered AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY query_id, citation ORDER BY pos, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS raises FROM named WHERE citation <> ''),
merged AS (SELECT query_id, citation, max(score) AS score, arg_max(text, score * 1e9 - pos * 1e-3) AS reason, arg_min(doc_type, pos) AS doc_type, coalesce(arg_min(uri, pos * 1000 + i) FILTER (uri <> '' AND raises), '') AS source
  FROM ordered GROUP BY query_id, citation)"""


def merged_hits(t, asking=None):
    """Laws and references of all vectors, or of those that ask."""
    hits = retrieval.layered_search(_vectors(t) if asking is None else asking, t.vectors)
    joined = hits.join(t.vectors.select("doc_id", "doc_type", "law_name", "text", F.col("uri").alias("source")), "doc_id")
    position = F.when(F.col("layer") == "law", F.col("rank")).otherwise(100 + F.col("rank"))
    return retrieval.merge_hits_by_citation(joined.withColumn("pos", position))


@query("merge_hits_by_citation", f"WITH {MERGED_SQL} SELECT query_id, citation, round(score, 6) AS score, reason, doc_type, source FROM merged", inputs=("vectors",))
def merge_hits_by_citation(spark, t):
    return merged_hits(t).select("query_id", "citation", F.round("score", 6).alias("score"), "reason", "doc_type", "source")


@query("annotate_law_status", f"""WITH {MERGED_SQL},
ver AS (SELECT '洗錢防制法第' || (s_suppkey + 1) || '條' AS citation, CASE s_nationkey % 4 WHEN 0 THEN '現行' WHEN 1 THEN '已修正' WHEN 2 THEN '' ELSE '已刪除' END AS status FROM supplier)
SELECT query_id, citation, coalesce(nullif(status, ''), 'unknown') AS status FROM merged LEFT JOIN ver USING (citation)""", inputs=("vectors",))
def annotate_law_status(spark, t):
    versions = t.supplier.selectExpr("'洗錢防制法第' || (s_suppkey + 1) || '條' AS citation",
                                     "CASE s_nationkey % 4 WHEN 0 THEN '現行' WHEN 1 THEN '已修正' WHEN 2 THEN '' ELSE '已刪除' END AS status")
    return retrieval.annotate_law_status(merged_hits(t), versions).select("query_id", "citation", "status")


SIMILAR_SQL = f"""{PAIRS_SQL.strip()}, decisions AS (SELECT * FROM pairs WHERE doc_type = 'decision'), {top_sql('fetched', 'decisions', 20)},
boosted AS (SELECT *, CASE WHEN doc_route = query_route THEN 1 ELSE 0 END AS route_match, round(score * CASE WHEN doc_route = query_route THEN 1.25 ELSE 1.0 END, 4) AS similarity FROM fetched),
similar_cases AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rank) AS position FROM boosted) WHERE position <= 5)"""


def similar_of(t):
    # pooled decisions: the route is a weight here, never a filter
    return retrieval.find_similar(_vectors(t), t.vectors.drop("query_route"))


@query("rerank_similar", f"WITH {SIMILAR_SQL} SELECT query_id, doc_id, similarity, route_match, position FROM similar_cases", inputs=("vectors",))
def rerank_similar(spark, t):
    return similar_of(t).select("query_id", "doc_id", "similarity", "route_match", F.col("position").cast("bigint").alias("position"))


VOTE_SQL = f"""{SIMILAR_SQL},
votes AS (SELECT s.query_id, d.label, count(*) AS n, min(position) AS first_seen FROM similar_cases s JOIN vectors d USING (doc_id) GROUP BY ALL),
vote AS (SELECT query_id, label, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first_seen) AS rn FROM votes) WHERE rn = 1)"""


def _vote(t):
    cases = similar_of(t).select("query_id", "label", F.col("position").alias("rank"))
    return evaluation.majority_label(cases)


@query("similar_case_vote", f"""WITH {VOTE_SQL}
SELECT query_id, vote.label AS predicted, votes, d.label AS truth, CASE WHEN vote.label = d.label THEN 1 ELSE 0 END AS correct FROM vote JOIN vectors d ON d.doc_id = query_id""", inputs=("vectors",))
def similar_case_vote(spark, t):
    truth = t.vectors.select(F.col("doc_id").alias("query_id"), F.col("label").alias("truth"))
    return _vote(t).join(truth, "query_id").select("query_id", F.col("label").alias("predicted"), "votes", "truth", (F.col("label") == F.col("truth")).cast("int").alias("correct"))


DISPOSITION_SQL = f"""{SIMILAR_SQL},
ruled AS (SELECT s.query_id, s.position, CASE WHEN contains(d.disposition, '不受理') THEN '訴願不受理' WHEN contains(d.disposition, '撤銷') THEN '{V.REVOKE}' WHEN contains(d.disposition, '駁回') THEN '訴願駁回' END AS label
  FROM similar_cases s JOIN vectors d USING (doc_id)),
counted AS (SELECT query_id, label, count(*) AS n, min(position) AS f FROM ruled WHERE label IS NOT NULL GROUP BY ALL),
top AS (SELECT query_id, arg_max(label, n * 100 - f) AS label FROM counted GROUP BY query_id)"""


def disposition_votes(t):
    return similar_of(t).select(F.col("query_id").alias("case_id"), F.col("position").alias("rank"), labels.normalized_disposition(F.col("disposition")).alias("label"))


def majority_sql(reds: str) -> str:
    return f"""reds AS ({reds}),
decided AS (SELECT c.case_id, CASE WHEN n_red > 0 THEN '{V.REVOKE}' ELSE coalesce(label, '{V.DISMISS}') END AS disposition,
  CASE WHEN n_red > 0 THEN '原處分健檢發現 ' || n_red || ' 項重大瑕疵，傾向撤銷' WHEN label IS NOT NULL THEN '相似歷史案例多數為「' || label || '」' ELSE '無明顯瑕疵且無相似案例可參，暫採駁回為參考' END AS basis
  FROM (SELECT case_id FROM cases) c LEFT JOIN top ON top.query_id = c.case_id LEFT JOIN reds ON reds.case_id = c.case_id)"""


@query("majority_disposition", f"""WITH {DISPOSITION_SQL}, {majority_sql("SELECT case_id, count(*) AS n_red FROM cases WHERE legal_basis = '' GROUP BY case_id")}
SELECT * FROM decided""", inputs=("vectors", "cases"))
def majority_disposition(spark, t):
    reds = t.cases.filter(F.col("legal_basis") == "").select("case_id")
    return evaluation.majority_disposition(t.cases, disposition_votes(t), reds)


@query("derive_disposition", """
SELECT doc_id, CASE WHEN contains(meta_disposition, '不受理') THEN '訴願不受理' WHEN contains(meta_disposition, '撤銷') THEN '原處分撤銷' WHEN contains(meta_disposition, '駁回') THEN '訴願駁回'
  WHEN contains(left(text, 200), '不受理') THEN '訴願不受理' WHEN contains(left(text, 200), '撤銷') THEN '原處分撤銷' WHEN contains(left(text, 200), '駁回') THEN '訴願駁回' ELSE '' END AS disposition FROM ruling_docs""", inputs=("ruling_docs",))
def derive_disposition(spark, t):
    return retrieval.derive_case_fields(t.ruling_docs).select("doc_id", "disposition")


@query("derive_year", """
SELECT doc_id, coalesce(TRY_CAST(nullif(meta_year, '') AS INT), TRY_CAST(nullif(regexp_extract(left(text, 120), '([0-9]{2,3})\\s*年度?', 1), '') AS INT)) AS year FROM ruling_docs""", inputs=("ruling_docs",))
def derive_year(spark, t):
    return retrieval.derive_case_fields(t.ruling_docs).select("doc_id", "year")


_HEADS = " ".join(f"WHEN '{r}' THEN {sql_list(i)}" for r, i in V.ROUTE_ISSUES.items())


@query("shared_issues", f"""
WITH i AS (SELECT doc_id, text, CASE route_key {_HEADS} ELSE {sql_list(V.ROUTE_ISSUES['general'])} END AS pool FROM ruling_docs)
SELECT doc_id, array_to_string([x for x in pool if contains(text, trim(string_split(x, '(')[1]))], '；') AS issues FROM i""", inputs=("ruling_docs",))
def shared_issues(spark, t):
    return t.ruling_docs.select("doc_id", F.array_join(retrieval.shared_issues(F.col("route_key"), F.col("text")), "；").alias("issues"))


_FLAT = "trim(regexp_replace(text, '[\\s　\\x1c-\\x1f\\x{85}\\x{a0}]+', ' ', 'g'))"


@query("summarize_text", f"""
SELECT doc_id, left(f, 200) || CASE WHEN length(f) > 200 THEN '…' ELSE '' END AS summary, left(f, 120) || CASE WHEN length(f) > 120 THEN '…' ELSE '' END AS reason FROM (SELECT doc_id, {_FLAT} AS f FROM documents)""")
def summarize_text(spark, t):
    return t.documents.select("doc_id", T.summarize(F.col("text"), V.SUMMARY_LIMIT).alias("summary"), T.summarize(F.col("text"), V.REASON_LIMIT).alias("reason"))


@query("source_fallback_id", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'doc' || page_id WHEN 2 THEN url || '//' ELSE '' END AS source,
  CASE page_id % 5 WHEN 0 THEN 'D' || page_id WHEN 1 THEN 'K' || page_id ELSE regexp_extract(CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'doc' || page_id WHEN 2 THEN url || '//' ELSE '' END, '([^/]*)/*$', 1) END AS identity FROM pages""")
def source_fallback_id(spark, t):
    k = F.col("page_id")
    source = retrieval.hit_source(F.when(k % 4 == 0, F.col("url")).otherwise(""), F.when(k % 4 == 1, F.concat(F.lit("doc"), k)).otherwise(""),
                                  F.when(k % 4 == 2, F.concat(F.col("url"), F.lit("//"))))
    staged = t.pages.select("page_id", source.alias("source"))
    return staged.select("page_id", "source", retrieval.case_identity(
        F.when(k % 5 == 0, F.concat(F.lit("D"), k)).otherwise(""), F.when(k % 5 == 1, F.concat(F.lit("K"), k)), F.col("source")).alias("identity"))
