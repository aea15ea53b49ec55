"""One query for each operator, over its whole table, with the columns its contract asks for; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import (
    decontamination, importance, language_id, license_scan, ngram_model, packing, pair_index, personal_data, pivot_index, product_trie, simhash, token_cache,
    token_files,
)
from docketry.llm.common import documents
from docketry.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@_query
def op1_pivot_index(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_index.search(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op1_pivot_index"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op2_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.lit(None).cast("long").alias("doc_id"), "text")
    return ngram_model.score(documents(spark, folder), items)


@_query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "token-files")
    token_files.write_token_files(documents(spark, folder), path)
    return token_files.read_token_files(spark, path, digest=True)


@_query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op5_token_cache(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_cache.count_tokens(documents(spark, folder), "word_bpe_49k.json", work_dir(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@_query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.summary(license_scan.scan_licenses(documents(spark, folder)))


@_query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(documents(spark, folder))


@_query
def op8_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), with_ids=False)


@_query
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.digests(personal_data.spans_of(documents(spark, folder)))


@_query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.find_contamination(documents(spark, folder), items).drop("spans")


@_query
def op11_product_trie(spark: SparkSession, folder: str) -> DataFrame:
    return product_trie.compress(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _product_trie_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds as tables that follow from each other: nearest entries n0, n1, ... and codebooks c0, c1, ..."""
    def nearest(k: int) -> str:
        return f"""n{k} AS MATERIALIZED (
    SELECT r, p, arg_min(e, 100 * d + e) AS e, min(d) AS d
    FROM (SELECT r, p, e, CAST(list_sum(list_transform(list_zip(s.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM slices s JOIN c{k} c USING (p))
    GROUP BY r, p
)"""

    def moved(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (
    SELECT c.p, c.e, coalesce(m.v, c.v) AS v
    FROM c{k} c LEFT JOIN (
        SELECT p, e, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
        FROM (SELECT p, e, i, CAST(sum(v[i]) AS BIGINT) AS total, count(*) AS n
              FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM slices JOIN n{k} USING (r, p)) GROUP BY ALL)
        GROUP BY p, e) m USING (p, e)
)"""

    tables = [x for k in range(rounds) for x in (nearest(k), moved(k))] + [nearest(rounds)]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), slices AS MATERIALIZED (
    SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM (SELECT r, v, unnest(range({parts})) AS p FROM kept)
), c0 AS MATERIALIZED (
    SELECT p, r - 1 AS e, v FROM slices WHERE r <= {entries}
), {", ".join(tables)}, coded AS (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY r
), digest AS (
    SELECT sha256(string_agg(CAST(v[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM c{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


ORACLES["op11_product_trie"] = _product_trie_sql()


@_query
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))


ORACLES["op12_importance_resampling"] = r"""
WITH crc_table AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t
    FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))
), texts AS (
    SELECT false AS target, row_number() OVER () AS r, doc_id, text FROM documents
    UNION ALL
    SELECT true, row_number() OVER (), NULL, text FROM benchmark
), words AS (
    SELECT target, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
    SELECT target, r, unnest(w) AS feature FROM words
    UNION ALL
    SELECT target, r, w[i] || ' ' || w[i + 1] FROM (SELECT target, r, w, unnest(range(1, len(w))) AS i FROM words)
), counted AS (
    SELECT target, r, feature, count(*) AS n FROM features GROUP BY ALL
), hashed AS (
    SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(len(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                                    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT feature, hex(feature) AS h FROM (SELECT DISTINCT feature FROM counted)), crc_table
), bucketed AS (
    SELECT target, r, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL
), sums AS (
    SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM bucketed GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1.0::DOUBLE) * (all_s + 10000.0::DOUBLE)) / ((s + 1.0::DOUBLE) * (all_t + 10000.0::DOUBLE)))) AS BIGINT) AS gain
    FROM sums, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums)
), weights AS (
    SELECT r, sum(n * gain) AS total, sum(n) AS n_features FROM bucketed JOIN gains USING (bucket) WHERE NOT target GROUP BY r
), scored AS (
    SELECT words.r, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features,
        coalesce(CASE WHEN total % n_features < 0 THEN (total - total % n_features) / n_features - 1 ELSE (total - total % n_features) / n_features END, 0) AS weight,
        CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise
    FROM words LEFT JOIN weights USING (r) WHERE NOT target
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY able ORDER BY weight + noise DESC, doc_id, r) AS place FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
    CASE WHEN able AND place <= 25 * (SELECT count(*) FROM scored WHERE able) // 100 THEN CAST(place AS BIGINT) END AS rank
FROM placed
"""


@_query
def op13_pair_index(spark: SparkSession, folder: str) -> DataFrame:
    return pair_index.round_trip_digests(documents(spark, folder), "word_bpe_49k.json")
