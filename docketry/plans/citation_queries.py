"""Queries over citations in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import citations as C
from docketry.operators import intake
from docketry.plans.registry import query, sql_list

_CITE = V.CITATION_PATTERN.replace("\\d", "[0-9]")
_FOLLOW = V.FOLLOW_ON_PATTERN.replace("\\d", "[0-9]")


def resolve_sql(law: str) -> str:
    """Law name of a captured name whose blanks and variants are settled."""
    known, long_known = sql_list(V.REGISTERED_LAWS), sql_list([k for k in V.REGISTERED_LAWS if len(k) >= 5])
    return f"""coalesce(list_sort([{{'n': length(k), 'k': k}} for k in {known} if ends_with({law}, k)], 'DESC')[1].k,
  [k for k in {long_known} if ends_with({law}, substr(k, 2))][1], [k for k in {sql_list(V.PRONOUN_LAWS)} if ends_with({law}, k)][1],
  substr({law}, CAST(list_max([CASE WHEN instr(reverse({law}), reverse(w)) > 2 THEN length({law}) - instr(reverse({law}), reverse(w)) + 1 ELSE 0 END for w in {sql_list(V.LAW_LEAD_WORDS)}]) AS INT) + 1))"""


def parts_sql(name: str, source: str, keys: str) -> str:
    """CTEs that turn ``source``(keys, hit, i) into ``name``(keys, i, law, article, sub_article, citation)."""
    return f"""
{name}_raw AS (SELECT {keys}, i, translate(regexp_replace(regexp_extract(hit, '{_CITE}', 1), '\\s+', '', 'g'), '汙台', '污臺') AS l,
  ltrim(coalesce(nullif(regexp_extract(hit, '{_CITE}', 2), ''), regexp_extract(hit, '{_CITE}', 4)), '0') AS a,
  ltrim(coalesce(nullif(regexp_extract(hit, '{_CITE}', 3), ''), regexp_extract(hit, '{_CITE}', 5)), '0') AS s FROM {source}),
{name}_law AS (SELECT *, {resolve_sql('l')} AS law FROM {name}_raw),
{name} AS (SELECT {keys}, i, law, a AS article, nullif(s, '') AS sub_article, law || '第' || a || '條' || CASE WHEN s <> '' THEN '之' || s ELSE '' END AS citation
  FROM {name}_law WHERE law <> '' AND law NOT IN ({", ".join(f"'{p}'" for p in V.PRONOUN_LAWS)}))"""


def text_hits_sql(name: str, source: str, keys: str) -> str:
    return f"""
{name} AS (SELECT {keys}, unnest(regexp_extract_all(text, '{_CITE}')) AS hit, generate_subscripts(regexp_extract_all(text, '{_CITE}'), 1) AS i FROM {source})"""


_ROWS = "rows_ AS (SELECT *, row_number() OVER () AS rid FROM cite_texts)"


@query("extract_citations", f"""WITH {_ROWS}, {text_hits_sql('hits', 'rows_', 'rid')}, {parts_sql('parts', 'hits', 'rid')},
firsts AS (SELECT rid, law, article, sub_article, citation, min(i) AS i FROM parts GROUP BY ALL)
SELECT case_id, pk, sk, row_number() OVER (PARTITION BY rid ORDER BY i) AS seq, law, article, sub_article, citation FROM firsts JOIN rows_ USING (rid)""", inputs=("cite_texts",))
def extract_citations(spark, t):
    rows = t.cite_texts.select("case_id", "pk", "sk", F.posexplode(C.extract_citations(F.col("text"))).alias("seq", "c"))
    return rows.select("case_id", "pk", "sk", (F.col("seq") + 1).cast("bigint").alias("seq"), "c.law", "c.article", "c.sub_article", "c.citation")


_DECLARED = """declared AS (SELECT case_id, pk, sk, unnest(string_split(cites_text, '|')) AS raw FROM paragraph_rows)"""


@query("normalize_citation", f"""WITH {_DECLARED},
hits AS (SELECT raw, regexp_extract(trim(raw), '^{_CITE}') AS hit, 1 AS i FROM (SELECT DISTINCT raw FROM declared) WHERE regexp_matches(trim(raw), '^{_CITE}')), {parts_sql('parts', 'hits', 'raw')}
SELECT case_id, pk, sk, raw, citation FROM declared LEFT JOIN parts USING (raw)""", inputs=("paragraph_rows",))
def normalize_citation(spark, t):
    raw = t.paragraph_rows.select("case_id", "pk", "sk", F.explode(F.split("cites_text", r"\|", -1)).alias("raw"))
    return raw.withColumn("citation", C.normalize_citation(F.col("raw")))


_RESOLVE_SQL = f"""
WITH r AS (SELECT case_id, pk, CASE pk % 3 WHEN 0 THEN written WHEN 1 THEN '本件 ' || written ELSE '申請人不服依據' || law_clean END AS raw FROM cite_keys),
l AS (SELECT *, translate(regexp_replace(raw, '\\s+', '', 'g'), '汙台', '污臺') AS l FROM r)
SELECT case_id, pk, raw, {resolve_sql('l')} AS law FROM l"""


def _captured_names(t):
    return t.cite_keys.selectExpr("case_id", "pk", "CASE pk % 3 WHEN 0 THEN written WHEN 1 THEN '本件 ' || written ELSE '申請人不服依據' || law_clean END AS raw")


@query("resolve_law_name", _RESOLVE_SQL, inputs=("cite_keys",))
def resolve_law_name(spark, t):
    return _captured_names(t).withColumn("law", C.resolve_law(F.col("raw")))


@query("resolve_law_by_table", _RESOLVE_SQL, inputs=("cite_keys",))
def resolve_law_by_table(spark, t):
    """The same names against a table of laws, as a join."""
    laws = spark.createDataFrame(list(enumerate(V.REGISTERED_LAWS)), "place long, law string")
    return C.resolve_laws(_captured_names(t), "raw", laws).select("case_id", "pk", "raw", "law")


@query("find_malformed", f"""WITH {_ROWS},
spots AS (SELECT rid, unnest(generate_series(1, length(text))) AS p FROM rows_),
hit AS (SELECT rid, p FROM spots JOIN rows_ USING (rid) WHERE substr(text, p, 1) IN ('第', '§')
  AND regexp_matches(substr(text, p), '^(?:第\\s*[0-9]+\\s*條\\s*之(?:[^0-9]|$)|第\\s*條|§(?:[^0-9]|$))'))
SELECT case_id, pk, sk, row_number() OVER (PARTITION BY rid ORDER BY p) AS seq,
  substr(text, greatest(p - 12, 1), p + 12 - greatest(p - 12, 1)) AS context FROM hit JOIN rows_ USING (rid)""", inputs=("cite_texts",))
def find_malformed(spark, t):
    rows = t.cite_texts.select("case_id", "pk", "sk", F.posexplode(C.malformed_citations(F.col("text"))).alias("seq", "context"))
    return rows.withColumn("seq", (F.col("seq") + 1).cast("bigint"))


_FOLLOW_SQL = f"""
f AS (SELECT rid, text, unnest(regexp_extract_all(text, '{_FOLLOW}')) AS fhit, generate_subscripts(regexp_extract_all(text, '{_FOLLOW}'), 1) AS k,
  string_split_regex(text, '{_FOLLOW}') AS pieces, regexp_extract_all(text, '{_FOLLOW}') AS fhits FROM rows_),
fpos AS (SELECT rid, k, fhit, text, CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(fhits[1:k - 1], lambda x: length(x))), 0) AS INT) AS start FROM f),
prefix AS (SELECT rid, k, substr(text, 1, start) AS text FROM fpos),
{text_hits_sql('phits', 'prefix', 'rid, k').strip()}, {parts_sql('pparts', 'phits', 'rid, k').strip()},
pfirst AS (SELECT rid, k, law, citation, min(i) AS i FROM pparts GROUP BY ALL),
lastlaw AS (SELECT rid, k, arg_max(law, i) AS law FROM pfirst GROUP BY rid, k),
{text_hits_sql('hits', 'rows_', 'rid').strip()}, {parts_sql('parts', 'hits', 'rid').strip()},
firstlaw AS (SELECT rid, arg_min(law, i) AS law FROM parts GROUP BY rid),
follow AS (SELECT rid, k, coalesce(l.law, fl.law) || '第' || ltrim(regexp_extract(fhit, '{_FOLLOW}', 1), '0') || '條'
   || CASE WHEN regexp_extract(fhit, '{_FOLLOW}', 2) <> '' THEN '之' || ltrim(regexp_extract(fhit, '{_FOLLOW}', 2), '0') ELSE '' END AS citation
  FROM fpos JOIN firstlaw fl USING (rid) LEFT JOIN lastlaw l USING (rid, k))"""


@query("follow_on_citations", f"""WITH {_ROWS}, {_FOLLOW_SQL.strip()}
SELECT case_id, pk, sk, k AS seq, citation FROM follow JOIN rows_ USING (rid)""", inputs=("cite_texts",))
def follow_on_citations(spark, t):
    rows = t.cite_texts.select("case_id", "pk", "sk", F.posexplode(C.follow_on_citations(F.col("text"))).alias("seq", "citation"))
    return rows.withColumn("seq", (F.col("seq") + 1).cast("bigint"))


@query("reconcile_cites", f"""WITH {_ROWS}, {_FOLLOW_SQL.strip()},
d AS (SELECT rid, trim(unnest(string_split(cites_text, '|'))) AS raw, generate_subscripts(string_split(cites_text, '|'), 1) AS j FROM rows_),
dh AS (SELECT rid, j, regexp_extract(raw, '^{_CITE}') AS hit, 1 AS i FROM d WHERE regexp_matches(raw, '^{_CITE}')), {parts_sql('dparts', 'dh', 'rid, j').strip()},
every AS (SELECT d.rid, coalesce(p.citation, d.raw) AS cite, 0 AS grp, j AS o FROM d LEFT JOIN dparts p USING (rid, j)
  UNION ALL SELECT rid, citation, 1, i FROM parts UNION ALL SELECT rid, citation, 2, k FROM follow),
firsts AS (SELECT rid, cite, min(grp * 1000 + o) AS o FROM every WHERE cite <> '' GROUP BY rid, cite),
lists AS (SELECT rid, string_agg(cite, '；' ORDER BY o) AS cites FROM firsts GROUP BY rid)
SELECT case_id, pk, sk, coalesce(cites, '') AS cites FROM rows_ LEFT JOIN lists USING (rid)""", inputs=("cite_texts",))
def reconcile_cites(spark, t):
    cites = C.reconcile_cites(F.split("cites_text", r"\|", -1), F.col("text"))
    return t.cite_texts.select("case_id", "pk", "sk", F.array_join(cites, "；").alias("cites"))


@query("backfill_legal_basis", f"""
WITH s AS (SELECT case_id, regexp_extract(text, '事實：((?:.|\\n)*?)理由：', 1) || chr(10) || regexp_extract(text, '理由：((?:.|\\n)*?)檢附之證據', 1) || chr(10) || text AS text FROM petition_rows),
{text_hits_sql('hits', 's', 'case_id').strip()}, {parts_sql('parts', 'hits', 'case_id').strip()},
firsts AS (SELECT case_id, citation, min(i) AS i FROM parts GROUP BY ALL)
SELECT case_id, string_agg(citation, '；' ORDER BY i) AS legal_basis FROM firsts GROUP BY case_id""", inputs=("petition_rows",))
def backfill_legal_basis(spark, t):
    fields = intake.structure_petition(t.petition_rows)
    return fields.select("case_id", F.array_join(intake.backfill_legal_basis(F.col("facts"), F.col("reasons"), F.col("text")), "；").alias("legal_basis"))
