"""Corpus preparation: file names, document types, rendering, metadata, masking, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import dates, pii, text as T
from docketry.functions.text import blank_to_null


def canonical_case_type(raw: Column) -> Column:
    return F.coalesce(_lookup(V.CASE_TYPE_ALIASES, raw), raw)


def _lookup(table: dict, key: Column) -> Column:
    """Value for a key of a fixed table, null when it has none."""
    return F.try_element_at(T.lit_map(table), key)


def route_of_case_type(case_type: Column) -> Column:
    return F.coalesce(_lookup(V.CASE_TYPE_TO_ROUTE, case_type), F.lit(V.DEFAULT_ROUTE))


def resolve_route(route: Column) -> Column:
    return F.when(route.isin(V.ROUTES), route).otherwise(V.DEFAULT_ROUTE)


def parse_filename_meta(files: DataFrame) -> DataFrame:
    """``serial.YYY年-type-basis[-reason]-disposition`` to columns; unparsable names keep a flag."""
    name = F.regexp_replace(F.regexp_replace(F.col("file_name"), V.COPY_SUFFIX_PATTERN, ""), r"\.pdf\z", "")
    pattern = V.FILE_NAME_PATTERN
    parts = F.split(F.regexp_extract(name, pattern, 3), "-", -1)
    ok, count = name.rlike(pattern), F.size(parts)
    raw_type = F.when(ok, F.get(parts, F.lit(0)))
    return files.select(
        *files.columns,
        (~ok).cast("int").alias("parse_error"),
        F.when(ok, F.regexp_extract(name, pattern, 1)).alias("serial"),
        F.when(ok, F.regexp_extract(name, pattern, 2).try_cast("int")).alias("year"),
        canonical_case_type(raw_type).alias("case_type"),
        raw_type.alias("case_type_raw"),
        F.when(ok, F.get(parts, F.lit(1))).alias("basis"),
        F.when(ok & (count >= 4), F.get(parts, F.lit(2))).alias("reason"),
        F.when(ok & (count == 3), F.get(parts, F.lit(2)))
        .when(ok & (count >= 4), F.array_join(F.slice(parts, 4, F.greatest(count - 3, F.lit(1))), "-")).alias("disposition"),
        F.when(ok, F.concat(F.regexp_extract(name, pattern, 2), F.lit("#"), F.regexp_extract(name, pattern, 1))).alias("doc_id"),
    )


def folder_doc_type(path: Column) -> Column:
    """Document type of the first listed folder that occurs in the path."""
    out = F.lit("unknown")
    for folder, doc_type in reversed(V.FOLDER_TO_DOC_TYPE.items()):
        out = F.when(F.contains(path, F.lit(folder)), doc_type).otherwise(out)
    return out


def route_from_path(files: DataFrame, prefix: str) -> DataFrame:
    """Document types by folder and by sub-prefix; an unknown sub-prefix marks the file as skipped."""
    sub = F.regexp_extract("path", rf"{prefix}([^/]*)", 1)
    by_prefix = _lookup(V.SUBFOLDER_TO_DOC_TYPE, sub)
    return files.select(
        *files.columns,
        folder_doc_type(F.col("path")).alias("folder_type"),
        sub.alias("sub_prefix"),
        by_prefix.alias("prefix_type"),
        by_prefix.isNull().cast("int").alias("skipped"),
    )


def render_decision(d: dict[str, Column]) -> Column:
    """Structured decision as headed text, the ruling early; sections only when they hold text."""
    shown = {
        **d,
        "source_law": blank_to_null(T.unify_variants(T.strip(F.coalesce(d["source_law"], F.lit(""))))),
        "ruling": F.coalesce(blank_to_null(d["main_ruling"]), d["ruling_label"]),
        "articles": F.array_join(d["related_articles"], "、"),
    }
    # every line stands, only the optional source law leaves none when it is missing
    head = F.concat_ws("\n", *[
        F.concat(F.lit(label), shown[name] if name == "source_law" else F.coalesce(shown[name], F.lit("")))
        for name, label in V.DECISION_HEAD.items()])
    body = F.concat_ws("\n\n", *[F.concat(F.lit(label), blank_to_null(T.strip(d[name]))) for name, label in V.DECISION_BODY.items()])
    whole = F.concat(F.lit(V.DECISION_WHOLE), T.strip(F.coalesce(d["full_text"], F.lit(""))))
    return F.concat(head, F.lit("\n\n"), F.coalesce(blank_to_null(body), whole), F.lit("\n"))


def render_statute(name: Column, amended: Column, articles: Column, full_text: Column) -> Column:
    """Every article under the full law name, so that citations stay recognisable."""
    law = T.unify_variants(F.coalesce(name, F.lit("")))
    filled = F.filter(articles, lambda a: T.strip(F.coalesce(a["content"], F.lit(""))) != "")
    rows = F.transform(filled, lambda a: F.concat(
        law, T.squeeze(F.coalesce(a["article_no"], F.lit(""))), F.lit("\n"), T.strip(a["content"])))
    body = F.when(F.size(filled) > 0, F.array_join(rows, "\n\n")).otherwise(T.strip(F.coalesce(full_text, F.lit(""))))
    text = F.concat(F.format_string(V.STATUTE_HEAD, law, F.coalesce(amended, F.lit(""))), body)
    return F.concat(F.regexp_replace(text, T.BLANK + r"+\z", ""), F.lit("\n"))


def render_reference(title: Column, source_file: Column, full_text: Column) -> Column:
    name = F.coalesce(blank_to_null(title), source_file, F.lit(""))
    return F.concat(F.format_string(V.REFERENCE_HEAD, name), T.strip(F.coalesce(full_text, F.lit(""))), F.lit("\n"))


def decision_attributes(route: Column, d: dict[str, Column]) -> Column:
    """Index attributes of a decision; empty ones are null and so drop out of the JSON text."""
    return F.struct(
        route.alias("case_type"), F.lit("decision").alias("doc_type"),
        dates.roc_year(d["publish_date"]).alias("year"),
        blank_to_null(d["ruling_label"]).alias("disposition"), blank_to_null(d["ruling_class"]).alias("ruling_class"),
        blank_to_null(F.coalesce(blank_to_null(d["dispatch_number"]), d["case_number"])).alias("doc_id"),
        blank_to_null(d["case_number"]).alias("case_id"),
        blank_to_null(T.clean_source_law(d["source_law"])).alias("source_law"),
    )


def law_attributes(route: Column, doc_type: Column, name: Column, amended: Column) -> Column:
    law = T.unify_variants(F.coalesce(name, F.lit("")))
    return F.struct(
        route.alias("case_type"),
        F.when((doc_type == "law") & law.isin(V.COMMON_LAWS), "common_law").otherwise(doc_type).alias("doc_type"),
        blank_to_null(law).alias("law_name"), blank_to_null(amended).alias("amended_date"), F.lit(0).alias("year"),
    )


def simple_metadata(attributes: Column) -> Column:
    return F.to_json(F.struct(attributes.alias("metadataAttributes")), {"ignoreNullFields": "true"})


def typed_metadata(attributes: DataFrame | Column, fields: dict[str, str]) -> Column:
    """The form that spells the type of each value; ``fields`` maps names to string or number."""
    def wrap(name: str, kind: str) -> Column:
        value = attributes[name]
        typed = F.struct(F.lit(kind.upper()).alias("type"), value.alias(f"{kind}Value"))
        return F.when(value.isNotNull(), F.struct(typed.alias("value"))).alias(name)

    inner = F.struct(*[wrap(name, kind) for name, kind in fields.items()])
    return F.to_json(F.struct(inner.alias("metadataAttributes")), {"ignoreNullFields": "true"})


def metadata_bytes(metadata: Column) -> Column:
    return F.octet_length(metadata)


def mask_pii(documents: DataFrame, column: str = "text") -> DataFrame:
    """Mask the text column pass by pass; each count is taken on the text the pass starts from."""
    out = documents
    for name, mask in pii.MASK_PASSES:
        masked, count = mask(F.col(column))
        # one projection per pass: both the count and the new text read the text before it
        out = out.select(*[F.col(c) for c in out.columns if c != column], masked.alias(column), count.alias(name))
    return out


def pii_residual_report(documents: DataFrame, column: str = "text") -> DataFrame:
    """Distinct lines that may be unmasked names; distinct runs as a map-side aggregation first."""
    return documents.select(F.explode(pii.short_line_suspects(F.col(column))).alias("suspect")).distinct()


def corpus_stats(metas: DataFrame) -> DataFrame:
    """Total, counts per case type and per year in one pass; parse errors stay out."""
    kept = metas.filter(F.col("parse_error") == 0)
    grouped = kept.groupingSets([[], [F.col("case_type")], [F.col("year")]], F.col("case_type"), F.col("year"))
    return grouped.agg(F.count("*").alias("n_docs"), F.grouping_id().alias("gid")).select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "case_type").otherwise("year").alias("facet"),
        F.coalesce(F.col("case_type"), F.col("year").cast("string"), F.lit("*")).alias("member"), "n_docs",
    )


def conversion_stats(converted: DataFrame) -> DataFrame:
    """Counts per route and over all routes.

    ``converted``: route, kind, skipped, oversized, mask counts per document.
    """
    masks = [name for name, _ in pii.MASK_PASSES]
    return converted.rollup("route").agg(
        F.count_if((F.col("kind") == "decision") & (F.col("skipped") == 0)).alias("decisions"),
        F.count_if((F.col("kind") != "decision") & (F.col("skipped") == 0)).alias("laws"),
        F.count_if(F.col("skipped") == 1).alias("skipped"),
        F.count_if((F.col("oversized") == 1) & (F.col("skipped") == 0)).alias("oversized"),
        *[F.sum(F.when(F.col("skipped") == 0, F.col(name)).otherwise(0)).alias(name) for name in masks],
    ).withColumn("route", F.coalesce("route", F.lit("(all)")))


def suspects_per_route(documents: DataFrame) -> DataFrame:
    """Distinct suspect names per route and over all routes."""
    names = documents.select("route", F.explode(pii.short_line_suspects(F.col("text"))).alias("suspect")).distinct()
    per_route = names.groupBy("route").agg(F.count("*").alias("suspects"))
    overall = names.select("suspect").distinct().agg(F.count("*").alias("suspects"))
    return per_route.unionByName(overall.withColumn("route", F.lit("(all)")))
