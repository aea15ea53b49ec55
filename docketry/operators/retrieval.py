"""Exact vector search, metadata filters, layering, re-ranking, merging of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import citations, labels, text as T
from docketry.functions.text import blank_to_null
from docketry.operators import cosine_index

#: Bucket of a search without filter.
WHOLE = "*"


def metadata_predicate(doc_types: list[str], include_common: bool, route: Column | None, pooled: bool) -> Column | None:
    """Filter over doc_type and doc_route; None when nothing is to be filtered.

    ``pooled`` (or a dedicated index) leaves the route out of the filter.
    """
    clauses = []
    if doc_types:
        wanted = list(dict.fromkeys(doc_types + (["common_law"] if include_common else [])))
        clauses.append(F.col("doc_type").isin(wanted))
    if route is not None and not pooled:
        own = F.col("doc_route") == route
        clauses.append(own | (F.col("doc_type") == "common_law") if include_common else own)
    out = None
    for clause in clauses:
        out = clause if out is None else out & clause
    return out


def corpus_bucket(by_route: bool) -> Column:
    """Bucket a document lies in: its type, and its route where the route filters."""
    if not by_route:
        return F.col("doc_type")
    return F.when(F.col("doc_type") == "common_law", "common_law").otherwise(F.concat_ws("|", "doc_type", "doc_route"))


def query_buckets(doc_types: list[str], include_common: bool, route: Column | None) -> Column:
    """Buckets a query may look into, the counterpart of ``corpus_bucket``."""
    own = [F.lit(t) if route is None or t == "common_law" else F.concat_ws("|", F.lit(t), route) for t in doc_types]
    return F.array_distinct(F.array(*own, *([F.lit("common_law")] if include_common else [])))


def cosine_topk(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Exact top k by cosine per (query_id, layer).

    ``queries``: query_id, vec, asks (for each layer: layer, k, skip_self to leave out the document of the same id, buckets), see ``ask``.
    ``corpus``: doc_id, vec, bucket. See ``cosine_index``: blocks of near vectors inside each bucket, of which a query
    visits those whose bound reaches its k-th score; pairs of vectors never become rows.
    """
    return cosine_index.search(queries, corpus).select("query_id", "layer", "doc_id", "score", "rank")


def layer_of(buckets: Column, k: int, layer: Column | str = "all", skip_self: bool = True) -> Column:
    """One thing that a query asks."""
    return F.struct((layer if isinstance(layer, Column) else F.lit(layer)).alias("layer"), F.lit(k).alias("k"), F.lit(skip_self).alias("skip_self"), buckets.alias("buckets"))


def ask(vectors: DataFrame, buckets: Column, k: int, layer: Column | str = "all", skip_self: bool = True) -> DataFrame:
    """Query table of ``cosine_topk`` for vectors with columns query_id and vec."""
    return vectors.select("query_id", "vec", F.array(layer_of(buckets, k, layer, skip_self)).alias("asks"))


def filtered_search(vectors: DataFrame, corpus: DataFrame, doc_types: list[str], include_common: bool,
                    route: Column | None, k: int) -> DataFrame:
    """Filter first, then score: a query only meets the blocks its filter lets through."""
    wanted = metadata_predicate(doc_types, include_common, None, True)
    table = corpus.filter(wanted).withColumn("bucket", corpus_bucket(route is not None))
    return cosine_topk(ask(vectors, query_buckets(doc_types, include_common, route), k), table.select("doc_id", "vec", "bucket"))


def search_with_fallback(vectors: DataFrame, corpus: DataFrame, doc_types: list[str], include_common: bool,
                         route: Column, k: int) -> DataFrame:
    """Queries whose filter finds nothing look through the whole corpus instead, and only those.

    Whether a filter finds anything follows from the rows of its buckets, so the search runs once.
    ``vectors`` carries own_bucket: where the query's own document lies, null if it has none.
    """
    table = corpus.select("doc_id", "vec", corpus_bucket(True).alias("bucket"))
    sizes = table.groupBy("bucket").agg(F.count("*").alias("n"))
    asked = vectors.withColumn("wanted", query_buckets(doc_types, include_common, route))
    # documents each query may look at, without its own
    wanted = asked.select("query_id", "own_bucket", F.explode("wanted").alias("bucket")).join(sizes, "bucket") \
        .groupBy("query_id").agg(F.sum(F.col("n") - F.coalesce((F.col("own_bucket") == F.col("bucket")).cast("int"), F.lit(0))).alias("found"))
    known = asked.join(wanted, "query_id", "left")
    empty = F.coalesce(F.col("found"), F.lit(0)) <= 0
    # the names of all buckets: one for each type, or type and route; a query without hits asks in all of them, in the same search
    every = sizes.agg(F.sort_array(F.collect_set("bucket"))).scalar()
    layer = F.when(empty, "fallback").otherwise("filtered")
    return cosine_topk(ask(known, F.when(empty, every).otherwise(F.col("wanted")), k, layer), table)


def layered_search(vectors: DataFrame, corpus: DataFrame, n: int = 5) -> DataFrame:
    """Statutes and references are ranked apart, so references cannot push statutes out."""
    table = corpus.withColumn("bucket", corpus_bucket(False)).filter(F.col("bucket") != "decision")
    law = layer_of(query_buckets(["law"], True, None), n, "law")
    refs = layer_of(query_buckets(["interpretation", "judgment"], False, None), max(n // 2, 2), "reference")
    # both layers ride with one vector
    return cosine_topk(vectors.select("query_id", "vec", F.array(law, refs).alias("asks")), table.select("doc_id", "vec", "bucket"))


def merge_hits_by_citation(hits: DataFrame) -> DataFrame:
    """One row per query and citation: best score, reason of the best hit, first source.

    ``hits``: query_id, pos, score, doc_type, law_name, text, source.
    """
    law_like = F.col("doc_type").isin("law", "common_law")
    name = blank_to_null(T.strip(F.coalesce("law_name", F.lit(""))))
    cites = F.when(law_like & name.isNotNull(), citations.article_citations(name, F.col("text"))) \
        .when(law_like, citations.citation_names(F.col("text"))) \
        .otherwise(F.filter(F.array(F.coalesce(name, T.last_segment(F.col("source")))), lambda c: c != ""))
    rows = hits.select("query_id", "pos", "score", "doc_type", "source", T.summarize(F.col("text"), V.REASON_LIMIT).alias("reason"),
                       F.posexplode(cites).alias("inner", "citation"))
    first = F.struct("pos", "inner")
    # hits of a query are few (k of each layer): the window is bounded by the search
    earlier = Window.partitionBy("query_id", "citation").orderBy("pos", "inner").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("raises", F.coalesce(F.col("score") > F.max("score").over(earlier), F.lit(True)))
    return rows.groupBy("query_id", "citation").agg(
        F.max("score").alias("score"),
        F.max_by("reason", F.struct(F.col("score"), (-F.col("pos")).alias("p"))).alias("reason"),
        F.min_by("doc_type", first).alias("doc_type"),
        F.coalesce(F.min_by("source", F.when(F.col("raises") & (F.col("source") != ""), first)), F.lit("")).alias("source"),
    )


def annotate_law_status(laws: DataFrame, versions: DataFrame) -> DataFrame:
    """Status from the version store; unknown where it has none. ``versions``: citation (unique), status."""
    return laws.join(versions.select("citation", blank_to_null(F.col("status")).alias("status")), "citation", "left") \
        .withColumn("status", F.coalesce("status", F.lit("unknown")))


def rerank_similar(hits: DataFrame, routes: DataFrame, k: int = 5) -> DataFrame:
    """Raise hits of the query's own route, round, keep the best k.

    ``hits``: query_id, query_route, doc_id, score, rank. ``routes``: doc_id, doc_route and more attributes.
    """
    matched = hits.join(routes, "doc_id")
    same = (F.col("doc_route") == F.col("query_route")) & (F.col("doc_route") != "")
    scored = matched.withColumn("route_match", F.coalesce(same, F.lit(False)).cast("int")) \
        .withColumn("similarity", F.round(F.col("score") * F.when(same, V.ROUTE_BONUS).otherwise(1.0), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "rank")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def find_similar(vectors: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Over-fetch from the pooled decisions, and only these, then re-rank; ``vectors`` also carries query_route."""
    decisions = corpus.filter(F.col("doc_type") == "decision").select("doc_id", "vec", F.col("doc_type").alias("bucket"))
    hits = cosine_topk(ask(vectors, T.lits(["decision"]), max(4 * k, 20)), decisions)
    hits = hits.join(vectors.select("query_id", "query_route"), "query_id")
    return rerank_similar(hits, corpus.drop("vec"), k)


def shared_issues(route: Column, text: Column) -> Column:
    """Common issues of the route whose head, before any bracket, occurs in the text."""
    pool = {key: issues for key, issues in V.ROUTE_ISSUES.items()}
    out = T.lits(pool[V.DEFAULT_ROUTE])
    for key, issues in pool.items():
        out = F.when(route == key, T.lits(issues)).otherwise(out)
    return F.filter(out, lambda issue: F.contains(text, T.strip(F.regexp_extract(issue, r"^([^（(]*)", 1)))
                    & (T.strip(F.regexp_extract(issue, r"^([^（(]*)", 1)) != ""))


def derive_case_fields(documents: DataFrame) -> DataFrame:
    """Disposition and year of a past decision, from metadata first."""
    return documents.withColumn("disposition", labels.disposition_of(F.col("meta_disposition"), F.col("text"))) \
        .withColumn("year", labels.year_of(F.col("meta_year"), F.col("text")))


def hit_source(uri: Column, document_id: Column, meta_uri: Column) -> Column:
    return F.coalesce(blank_to_null(uri), blank_to_null(document_id), meta_uri, F.lit(""))


def case_identity(doc_id: Column, case_id: Column, source: Column) -> Column:
    return F.coalesce(blank_to_null(doc_id), blank_to_null(case_id), T.last_segment(source))
