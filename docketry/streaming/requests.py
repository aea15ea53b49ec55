"""Requests as they arrive: told apart by a stateful processor with expiry per request; what comes late goes to a side output."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from docketry.sources.files import replace_partitions
from docketry.streaming.arrivals import request_key

FIRST, REPEAT, LATE = "first", "repeat", "late"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def asked_in_batch(requests: DataFrame, payload: list[str], time: str, order: list[str]) -> DataFrame:
    """One row per request of a batch: request_key, n_asked, first_us, last_us (microseconds), order_ and answer.

    ``answer`` is the first record by ``order`` that is no mock, ``order_`` its place; both are null where all are mocks. A request
    that is asked for very often is combined before any shuffle. Requests without a time count as asked at the earliest time there is.
    """
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(0))
    place = F.when(F.coalesce(F.col("is_mock"), F.lit(0)) == 0, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]))
    record = F.struct(*[c for c in requests.columns if c != "is_mock"])
    return requests.withColumn("request_key", request_key(*payload)).groupBy("request_key").agg(
        F.count("*").alias("n_asked"), F.min(at).alias("first_us"), F.max(at).alias("last_us"),
        F.min(place).alias("order_"), F.min_by(record, place).alias("answer"))


class RequestBook(StatefulProcessor):
    """Tells first, repeated and late requests apart. Rows: request_key, batch_id, first_us, last_us; the answers never pass through Python.

    State per request: when it was asked first and last, and the last batch counted, so that a batch that is written
    anew adds nothing. A request asked more than ``keep`` after it was asked last has expired: it is a first one again. One asked before the first
    time known is late: that time moves back, and the row goes to the side output. Nothing is dropped.
    ``forget_ms``: processing time after which Spark itself clears a state that nobody asked for again; None keeps it.
    """

    def __init__(self, keep: timedelta, forget_ms: int | None):
        self.keep_us, self.forget_ms = keep // timedelta(microseconds=1), forget_ms

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "first_us bigint, last_us bigint, batch_id bigint", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.known.get()
        # a request has one row per batch
        for batch_id, first, last in sorted((row["batch_id"], row["first_us"], row["last_us"]) for row in rows):
            if state is not None and batch_id <= state[2]:
                continue
            if state is None or first > state[1] + self.keep_us:
                kind, state = FIRST, (first, last, batch_id)
            else:
                kind, state = LATE if first < state[0] else REPEAT, (min(state[0], first), max(state[1], last), batch_id)
            yield Row(request_key=key[0], batch_id=batch_id, kind=kind)
        if state is not None:
            self.known.update(state)

    def close(self) -> None:
        pass


def collect_requests(stream: DataFrame, root: str, checkpoint: str, payload: list[str], time: str, order: list[str]) -> None:
    """Stream of requests -> table ``asked``; a batch replaces its own partition."""
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        rows = asked_in_batch(batch, payload, time, order)
        replace_partitions(rows.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{root}/asked", "batch_id")

    stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def book_requests(spark: SparkSession, root: str, checkpoint: str, keep: timedelta, forget: timedelta | None = None) -> None:
    """Table ``asked`` -> table ``book`` (request_key, batch_id), partitioned by kind: the partition ``late`` is the side output."""
    schema = spark.read.parquet(f"{root}/asked").schema
    asked = spark.readStream.schema(schema).option("ignoreMissingFiles", "true").parquet(f"{root}/asked") \
        .select("request_key", "batch_id", "first_us", "last_us")
    forget_ms = int(forget.total_seconds() * 1000) if forget else None
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)    # the store this kind of state needs; a running query keeps what it began with
    try:
        booked = asked.groupBy("request_key").transformWithState(
            RequestBook(keep, forget_ms), "request_key string, batch_id bigint, kind string", "Append", "ProcessingTime" if forget else "None")
        query = booked.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", f"{root}/book") \
            .partitionBy("kind").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


def follow_requests(stream: DataFrame, root: str, checkpoint: str, payload: list[str], time: str, order: list[str],
                    keep: timedelta, forget: timedelta | None = None) -> None:
    """Both stages over what has arrived: requests -> asked -> book."""
    collect_requests(stream, root, f"{checkpoint}/asked", payload, time, order)
    book_requests(stream.sparkSession, root, f"{checkpoint}/book", keep, forget)


def booked(spark: SparkSession, root: str) -> DataFrame:
    """The requests of every batch with their kind; both tables have one row per request and batch."""
    return spark.read.parquet(f"{root}/asked").join(spark.read.schema("request_key string, batch_id bigint, kind string").parquet(f"{root}/book"), ["request_key", "batch_id"])


def request_answers(book: DataFrame) -> DataFrame:
    """request_key, n_asked, n_first, n_late and the answer over all batches of ``booked``: what ``dedup_requests`` gives for all requests at once."""
    def batches(kind: str):
        return F.count_if(F.col("kind") == kind)

    return book.groupBy("request_key").agg(
        F.sum("n_asked").alias("n_asked"), batches(FIRST).alias("n_first"), batches(LATE).alias("n_late"), F.min_by("answer", "order_").alias("answer"))
