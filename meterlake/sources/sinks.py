"""Sinks: appends, job topics, reports, signed webhooks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from meterlake.functions.scalar import signature
from meterlake.session import exists

#: The statuses of posts that need not be repeated.
DELIVERED = "status BETWEEN 1 AND 399"


def append(rows: DataFrame, path: str, time: str | None = None, now: Column | None = None) -> None:
    """Appends rows; a missing time is now, that of the append if none is given."""
    if time:
        rows = rows.withColumn(time, F.coalesce(F.col(time), (F.current_timestamp() if now is None else now).cast(rows.schema[time].dataType)))
    rows.write.mode("append").parquet(path)


def envelopes(jobs: DataFrame) -> DataFrame:
    """Messages of queued jobs: routing key and JSON body, ready for a topic sink."""
    return jobs.select(F.concat(F.lit("jobs."), F.col("job_type")).alias("key"), F.to_json(F.struct("job_id", "job_type", "payload")).alias("value"), "job_type")


def publish(jobs: DataFrame, path: str) -> None:
    """Job messages as files, one folder per type."""
    envelopes(jobs).write.mode("append").partitionBy("job_type").json(path)


def report_csv(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header. One file: reports are pages of bounded length."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_lines(rows: DataFrame, path: str, line: str) -> None:
    """A text file per task, one line per row."""
    rows.select(F.col(line).cast("string")).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in one folder per value of a column if told which."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def signed(events: DataFrame, secret: str) -> DataFrame:
    """events (webhook_id, payload as JSON text) with their signature."""
    return events.withColumn("signature", signature(secret)("payload"))


def delivery_key() -> Column:
    """What tells deliveries of a batch apart: webhook and payload."""
    return F.sha2(F.to_json(F.struct("webhook_id", "payload")), 256)


def deliver(events: DataFrame, secret: str, post: Callable[[str, str, str], int], checkpoint: str) -> DataStreamWriter:
    """A streaming sink that posts signed events by post(webhook_id, payload, signature) on the executors, each webhook and payload once a batch.

    What a batch has posted goes to a ledger below the checkpoint before the batch counts. A post that raises, or
    whose status is 400 or more, fails the batch after all others are done; when Spark runs the batch again
    it asks the ledger and posts only the rest. The ledger of a batch is of the batch's size, and no batch
    reads another's. If an executor is lost in the middle of a task, that task's rows are posted again: a
    receiver tells them by their signature.
    """

    def attempt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            status = []
            for r in rows.itertuples():
                try:
                    status.append(int(post(r.webhook_id, r.payload, r.signature)))
                except Exception:  # noqa: BLE001 whatever a transport raises is a refusal of this one post
                    status.append(0)
            yield pd.DataFrame({"key": rows.key, "webhook_id": rows.webhook_id, "status": status})

    def send(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger, kind = f"{checkpoint}/ledger/{number}", "key string, webhook_id string, status int"
        wanted = batch.select("webhook_id", "payload", delivery_key().alias("key")).dropDuplicates(["key"])
        # an own folder for each attempt: what an earlier one has written is never written over
        before = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], kind)
        rest = wanted.join(before.where(DELIVERED).select("key"), "key", "left_anti")
        path = f"{ledger}/{uuid.uuid4().hex}"
        signed(rest, secret).mapInPandas(attempt, kind).write.parquet(path)
        refused = [r.webhook_id for r in spark.read.schema(kind).parquet(path).where(f"NOT ({DELIVERED})").select("webhook_id").distinct().limit(10).collect()]
        if refused:
            raise RuntimeError(f"webhooks that refused: {', '.join(map(str, refused))}")

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
