"""Requests of several batches through the stateful processor, against the batch form and a plain replay."""

from datetime import datetime, timedelta

import pytest

from docketry.sources import files
from docketry.streaming import arrivals, requests

SCHEMA = "id bigint, at timestamp, body string, reply string, is_mock int"


@pytest.fixture
def feed(spark, tmp_path):
    source, root = str(tmp_path / "input"), str(tmp_path / "tables")

    def batch(*rows):
        spark.createDataFrame([(i, at and datetime.fromisoformat(at), body, reply, mock) for i, at, body, reply, mock in rows], SCHEMA) \
            .coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        requests.follow_requests(stream, root, f"{root}-checkpoint", ["body"], "at", ["id"], timedelta(days=10))
        return requests.booked(spark, root)

    batch.source, batch.root = source, root
    return batch


def kinds(book):
    return sorted((r["batch_id"], r["answer"] and r["answer"]["body"], r["kind"], r["n_asked"]) for r in book.collect())


def test_late_and_repeated_requests_over_three_batches(spark, feed):
    feed((5, "2024-01-05", "a", "five", 0), (6, "2024-01-06", "a", "six", 0), (7, "2024-01-05", "b", "mock", 1))
    # a is asked again, and by a record that is older; b has its first real reply
    feed((8, "2024-01-08", "a", "eight", 0), (9, "2024-01-09", "b", "nine", 0), (1, "2024-01-01", "a", "one", 0), (10, "2024-01-09", "c", "ten", 0))
    # a after it expired, b late, c repeated by a mock and once without a time, a request without a body
    book = feed((11, "2024-03-01", "a", "x", 0), (2, "2024-01-02", "b", "two", 0), (12, "2024-01-10", "c", "y", 1), (13, None, "d", "z", 0), (14, "2024-01-01", None, "n", 0))
    assert kinds(book.filter("answer is not null and answer.body is not null")) == [
        (0, "a", "first", 2), (1, "a", "late", 2), (1, "b", "repeat", 1), (1, "c", "first", 1), (2, "a", "first", 1), (2, "b", "late", 1), (2, "d", "first", 1)]
    assert book.filter("answer is null").count() == 2      # mocks alone
    # nothing is lost: the answers are those of the batch form over all requests
    every = spark.read.schema(SCHEMA).parquet(feed.source)
    want = arrivals.dedup_requests(every, ["body"], ["id"]).select("request_key", "n_asked", "id", "reply")
    got = requests.request_answers(book).select("request_key", "n_asked", "answer.id", "answer.reply")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
    # a run without anything new adds nothing
    stream = spark.readStream.schema(SCHEMA).parquet(feed.source)
    requests.follow_requests(stream, feed.root, f"{feed.root}-checkpoint", ["body"], "at", ["id"], timedelta(days=10))
    assert requests.booked(spark, feed.root).count() == book.count()


def test_a_batch_written_anew_is_not_counted_twice(spark, feed):
    feed((1, "2024-01-01", "a", "one", 0))
    book = feed((2, "2024-01-02", "a", "two", 0), (3, "2024-01-02", "b", "three", 0))
    before = kinds(book)
    # the driver was lost after the write and before its commit: the same partition is written once more, as new files
    rows = spark.read.parquet(f"{feed.root}/asked").filter("batch_id = 1").collect()
    schema = spark.read.parquet(f"{feed.root}/asked").schema
    files.replace_partitions(spark.createDataFrame(rows, schema), f"{feed.root}/asked", "batch_id")
    requests.book_requests(spark, feed.root, f"{feed.root}-checkpoint/book", timedelta(days=10))
    assert kinds(requests.booked(spark, feed.root)) == before


def test_hot_request_is_one_row_per_batch(spark):
    asked = spark.range(9000).selectExpr("id", "timestamp_seconds(id) AS at", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS body", "'r' AS reply", "0 AS is_mock")
    rows = requests.asked_in_batch(asked, ["body"], "at", ["id"])
    hot = rows.orderBy("n_asked", ascending=False).head()
    assert (rows.count(), hot["n_asked"], hot["answer"]["id"]) == (6001, 3000, 0)
    assert requests.asked_in_batch(asked.limit(0), ["body"], "at", ["id"]).count() == 0
