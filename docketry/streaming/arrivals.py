"""Case files as they arrive: exactly once per file, the batch operators inside every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketry.operators import intake, rules, verification
from docketry.session import stored
from docketry.sources.files import CORRUPT, read_stage, write_stage


def case_arrivals(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.json",
                  files_per_batch: int = 1000, corrupt: str | None = None) -> DataFrame:
    """Stream of case files put into a folder. ``corrupt`` names a column for the raw text of records that cannot be read."""
    if corrupt:
        schema = f"{schema if isinstance(schema, str) else schema.toDDL()}, `{corrupt}` string"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader).json(folder)


def land(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append what has arrived to a parquet table and stop; the checkpoint remembers the files."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target) \
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()


def land_cases(spark: SparkSession, folder: str, schema: StructType | str, root: str, glob: str = "*.json", files_per_batch: int = 1000) -> None:
    """Land the cases that have arrived, put aside what cannot be read, and count both.

    Tables below ``root``, all partitioned by batch_id: ``landed`` (the cases and their file), ``quarantine`` (file, raw record),
    ``counts`` (file, n_good, n_bad; files without a record are not in it) and ``arrived`` (file, bytes of every file, also of
    one that holds blank lines only; Spark's listing leaves files of no bytes out). Each file is read once; a batch that is run again replaces its own partitions. See ``arrival_report``.
    """
    stream = case_arrivals(spark, folder, schema, glob, files_per_batch, CORRUPT).withColumn("file_path", F.col("_metadata.file_path"))

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        mark = F.lit(batch_id).cast("long").alias("batch_id")
        # three sinks read the batch: parse its files once; lost blocks are read again from the files
        rows = batch.persist()
        try:
            bad = F.col(CORRUPT).isNotNull()
            _replace(rows.filter(~bad).drop(CORRUPT).select("*", mark), f"{root}/landed")
            _replace(rows.filter(bad).select("file_path", F.col(CORRUPT).alias("record"), mark), f"{root}/quarantine")
            counted = rows.groupBy("file_path").agg(F.sum((~bad).cast("long")).alias("n_good"), F.sum(bad.cast("long")).alias("n_bad"))
            _replace(counted.select("*", mark), f"{root}/counts")
        finally:
            rows.unpersist()

    _run(stream, one_batch, f"{root}/checkpoint-cases")
    # names and sizes only: the contents are not selected, so they are not read
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary") \
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder).select(F.col("path").alias("file_path"), F.col("length").alias("n_bytes"))
    _run(files, lambda batch, batch_id: _replace(batch.select("*", F.lit(batch_id).cast("long").alias("batch_id")), f"{root}/arrived"), f"{root}/checkpoint-files")


def _replace(table: DataFrame, path: str) -> None:
    """Write the partitions of a batch in place of those of an earlier attempt."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def arrival_report(spark: SparkSession, root: str) -> DataFrame:
    """file_path, n_bytes, n_good, n_bad of every file that arrived, and its state: good, partly, broken or empty (no record at all)."""
    arrived = spark.read.schema("file_path string, n_bytes long, batch_id long").parquet(f"{root}/arrived").drop("batch_id")
    counts = spark.read.schema("file_path string, n_good long, n_bad long, batch_id long").parquet(f"{root}/counts").drop("batch_id")
    good, bad = (F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("n_good", "n_bad"))
    found = arrived.join(counts, "file_path", "left").groupBy("file_path", "n_bytes").agg(good, bad)
    state = F.when(F.col("n_good") + F.col("n_bad") == 0, "empty").when(F.col("n_bad") == 0, "good").when(F.col("n_good") == 0, "broken").otherwise("partly")
    return found.withColumn("state", state)


def analyze(cases: DataFrame) -> DataFrame:
    return rules.procedure_gate(rules.appeal_timeline(intake.normalize_missing(cases)))


def draft_paragraphs(analysis: DataFrame) -> DataFrame:
    """Paragraphs of the admissible cases from their stored model replies, each with the ruling and the remedy notice of its draft."""
    replies = intake.reply_rulings(analysis.filter((F.col("is_inadmissible") == 0) & F.col("reply").isNotNull()).select("case_id", "reply"))
    return intake.reply_paragraphs(replies)


def claims_of(analysis: DataFrame) -> DataFrame:
    """case_id and claim_id of the claims that came with a case, listed in ``claim_ids`` between bars."""
    if "claim_ids" not in analysis.columns:
        return analysis.select("case_id", F.lit("").alias("claim_id")).filter("claim_id <> ''")
    return analysis.select("case_id", F.explode(F.split(F.coalesce("claim_ids", F.lit("")), r"\|", -1)).alias("claim_id")).filter("claim_id <> ''")


def verify_drafts(analysis: DataFrame, paragraphs: DataFrame, findings: DataFrame, laws: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """All ten checks of drafts against the stored analysis, findings and recommended laws of their cases.

    ``paragraphs``: see ``draft_paragraphs``; each case with a draft and an analysis has a row per check. Without a version store V5 is skipped.
    """
    drafts = paragraphs.select("case_id", "main", "remedy_notice").distinct()
    cases = stored(rules.appeal_timeline(analysis.join(drafts.hint("merge"), "case_id")), "drafted-cases")
    known = cases.select("case_id").hint("merge")    # a row per case is no table for the driver, however small its file
    facts = verification.paragraph_facts(paragraphs.join(known, "case_id", "left_semi"))
    items = verification.cited_items(facts, verification.allowed_items(laws.join(known, "case_id", "left_semi")))
    return verification.results(
        cases, *verification.citation_set_checks(items), verification.v3_article_format(facts), verification.v4_claim_coverage(claims_of(cases), facts),
        verification.v5_effective_at_act(cases, items, versions), verification.v6_ungrounded_dates(cases, facts), verification.v7_period_recheck(cases),
        verification.v8_remedy_notice(cases), verification.v9_ruling_consistency(cases, facts),
        verification.v10_red_addressed(findings.join(known, "case_id", "left_semi"), facts)).select("case_id", "check_id", "status", "level")


def _run(stream: DataFrame, one_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _stage_stream(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """What has come to a stage table. A batch that was written anew is seen again; its former files may be gone."""
    return spark.readStream.schema(read_stage(spark, root, stage).schema).option("ignoreMissingFiles", "true").parquet(f"{root}/{stage}")


def _batches(rows: DataFrame) -> list[int]:
    """Numbers of the batches that rows of a stage table belong to."""
    return sorted(row["batch_id"] for row in rows.select("batch_id").distinct().collect())


def latest(table: DataFrame, analysis: DataFrame) -> DataFrame:
    """Of cases that were analysed in several batches the rows of the last one, which may have none."""
    last = analysis.groupBy(F.col("case_id").alias("key")).agg(F.max("batch_id").alias("last"))
    return table.join(last.hint("merge"), (F.col("case_id") == F.col("key")) & (F.col("batch_id") == F.col("last"))).drop("key", "last", "batch_id")


def analysis_stage(stream: DataFrame, root: str, checkpoint: str) -> None:
    """Arrived cases -> tables analysis and findings."""
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        mark = F.lit(batch_id).cast("long").alias("batch_id")
        # two sinks read the batch: parse its files once; lost blocks are read again from the files
        analysis = analyze(batch).persist()
        try:
            write_stage(rules.defect_checks(analysis).select("*", mark), root, "findings", "batch_id")
            write_stage(intake.public_projection(analysis).select("*", mark), root, "analysis", "batch_id")
        finally:
            analysis.unpersist()

    _run(stream, one_batch, checkpoint)


def land_drafts(replies: DataFrame, root: str, batch_id: int) -> None:
    """Put drafts of cases that were analysed before into the draft table, as a batch of their own. ``replies``: case_id, reply."""
    paragraphs = intake.reply_paragraphs(intake.reply_rulings(replies.select("case_id", "reply")))
    write_stage(paragraphs.select("*", F.lit(batch_id).cast("long").alias("batch_id")), root, "draft", "batch_id")


def draft_stage(spark: SparkSession, root: str, checkpoint: str) -> None:
    """Table analysis -> table draft; the batches that new files belong to are written as a whole."""
    def one_batch(batch: DataFrame, _: int) -> None:
        analysis = read_stage(spark, root, "analysis").filter(F.col("batch_id").isin(_batches(batch)))
        marks = analysis.select("case_id", "batch_id").distinct()
        write_stage(draft_paragraphs(analysis).join(marks.hint("merge"), "case_id"), root, "draft", "batch_id")

    _run(_stage_stream(spark, root, "analysis"), one_batch, checkpoint)


def verify_stage(spark: SparkSession, root: str, checkpoint: str, laws: DataFrame, versions: DataFrame | None = None) -> None:
    """Table draft -> table verify, joined with the latest analysis and findings of the cases, in whatever batch these came."""
    def one_batch(batch: DataFrame, _: int) -> None:
        analysed = read_stage(spark, root, "analysis")
        analysis, findings = latest(analysed, analysed), latest(read_stage(spark, root, "findings"), analysed)
        for number in _batches(batch):  # a case may have a draft in each
            drafts = read_stage(spark, root, "draft").filter(F.col("batch_id") == number).drop("batch_id")
            verdicts = verify_drafts(analysis, drafts, findings, laws, versions)
            write_stage(verdicts.select("*", F.lit(number).cast("long").alias("batch_id")), root, "verify", "batch_id")

    _run(_stage_stream(spark, root, "draft"), one_batch, checkpoint)


def stage_flow(stream: DataFrame, root: str, checkpoint: str, laws: DataFrame, versions: DataFrame | None = None) -> None:
    """analysis -> draft -> verify, each stage a stream over the table of the stage before it.

    Every table is partitioned by batch_id and a batch replaces its own partition, so a batch that
    is run again after a lost executor or driver leaves the same rows. ``laws``: the recommended laws, see ``verification.allowed_items``.
    """
    spark = stream.sparkSession
    analysis_stage(stream, root, f"{checkpoint}/analysis")
    draft_stage(spark, root, f"{checkpoint}/draft")
    verify_stage(spark, root, f"{checkpoint}/verify", laws, versions)


def request_key(*payload: Column | str) -> Column:
    """Hash of the payload; equal requests have equal keys, in whatever order their columns are named."""
    names = sorted(payload) if all(isinstance(x, str) for x in payload) else payload
    return F.left(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256), F.lit(32))


def dedup_requests(requests: DataFrame, payload: list[str], order: list[str]) -> DataFrame:
    """One answer per request: the first reply that is no mock, and how often it was asked for.

    A partial aggregation instead of a window: one request asked very often does not gather.
    """
    keyed = requests.withColumn("request_key", request_key(*payload))
    real = F.struct(*order)
    rest = [c for c in requests.columns if c != "is_mock"]
    grouped = keyed.groupBy("request_key").agg(
        F.count("*").alias("n_asked"),
        F.min_by(F.struct(*rest), F.when(F.col("is_mock") == 0, real)).alias("first"))
    return grouped.select("request_key", "n_asked", *[F.col(f"first.{c}").alias(c) for c in rest])


def dedup_stream(stream: DataFrame, payload: list[str], time: str, delay: str) -> DataFrame:
    """The streaming form: state is kept for the watermark delay only.

    ``delay`` is a parameter of the result, not a tuning value: a request that comes later than the watermark is dropped, and a
    repeat after the delay counts as a new request. Set it above the longest time within which requests may repeat or be late;
    ``dedup_requests`` over the stored requests has no such limit.
    """
    keyed = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("request_key", request_key(*payload))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["request_key"])
