"""Job lifecycle and running requests per tenant as state of a stream, with timers in event time.

Rows wait in a list state until the watermark has passed them and are then taken in the order of their
times, so the result depends neither on the order in which they come nor on where batches end. Times are
microseconds inside, timers milliseconds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterlake.streaming.jobs import FINAL

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, below their checkpoint; other streams of the session are as before."""
    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, old)


def micros(interval: str) -> int:
    """The microseconds of an interval such as '1 hour'."""
    import pandas as pd

    return pd.Timedelta(interval).value // 1000


class _Waiting(StatefulProcessor):
    """Keeps rows in a list state until the watermark has passed; one timer a key is set for the earliest of them."""

    def wait(self, rows: list[tuple]) -> None:
        if rows:
            self.waiting.appendList(rows)
            self.wake(min(r[0] for r in rows))

    def wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def due(self, passed: int) -> list[tuple]:
        """The waiting rows before passed, in order; those after it wait on."""
        rows = sorted(tuple(r) for r in self.waiting.get())
        now = [r for r in rows if r[0] < passed]
        later = rows[len(now) :]
        if later:
            self.waiting.put(later)
            self.wake(later[0][0])
        else:
            self.waiting.clear()
        return now

    def close(self) -> None:
        pass


class RunningRequests(_Waiting):
    """Per tenant how many requests run, told at every start and end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "n long")
        self.waiting = handle.getListState("waiting", "at long, delta int, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.wait([m for r in rows for m in ((r.started, 1, r.id), (r.ended, -1, r.id))])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self.due(timerValues.getCurrentWatermarkInMs() * 1000)
        running = self.running.get()[0] if self.running.exists() else 0
        for at, delta, request in due:
            running += delta
            yield Row(tenant=key[0], id=request, at=at, delta=delta, running=running)
        if due:
            # a tenant at rest keeps no state
            if running or self.waiting.exists():
                self.running.update((running,))
            else:
                self.running.clear()


def running_requests(requests: DataFrame, tenant: str, start: str, end: str, key: str, late: str = "1 hour") -> DataFrame:
    """(tenant, key, at, delta, running) for every start and end of the stream's requests [start, end) that the watermark has passed.

    At equal times ends come first, then by key, as in metrics.in_flight. A request that comes more than
    late after later ones is dropped. A tenant's state holds its requests of the last late and those still
    running, so it does not grow with the stream's length; null tenants are one.
    """
    rows = requests.withWatermark(start, late).select(F.col(tenant).alias("tenant"), F.col(key).alias("id"), start, F.unix_micros(start).alias("started"), F.unix_micros(end).alias("ended"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    told = rows.groupBy("tenant").transformWithState(RunningRequests(), f"tenant {kinds['tenant']}, id long, at long, delta int, running long", "Append", "EventTime")
    return told.select(F.col("tenant").alias(tenant), F.col("id").alias(key), F.timestamp_micros("at").alias("at"), "delta", "running")


class Lifecycle(_Waiting):
    """The states of a bucket's jobs; one that is silent for too long expires, one that has ended is forgotten after a while."""

    def __init__(self, kind: str, silent: int, forget: int):
        self.kind, self.silent, self.forget = kind, silent, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # columns of many jobs as arrays: a row of state is one pickle on its way to the store
        self.current = handle.getValueState("current", f"job array<{self.kind}>, status array<string>, last array<long>")
        self.waiting = handle.getListState("waiting", f"at array<long>, status array<string>, job array<{self.kind}>")
        self.told: dict[tuple, int] = {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [(r.at, r.status, r.job_id) for r in rows]
        if came:
            self.waiting.appendValue(_columns(came))
            self.wake(min(r[0] for r in came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # a bucket's first timer of a batch does the work of all that the watermark has passed
        if self.told.get(key) == passed:
            return
        self.told[key] = passed
        due, awaited = defaultdict(list), set()
        for at, status, job in self.due(passed, awaited):
            due[job].append((at, status))
        known = {job: (status, last) for job, status, last in zip(*(self.current.get() or ()))}
        kept = {}
        for job in known.keys() | due.keys():
            status, last = known.get(job, (None, None))
            for at, new in [*due.get(job, ()), (passed, None)]:
                if status is not None and status not in FINAL and last + self.silent < at:
                    status, last = "expired", last + self.silent
                    yield Row(job_id=job, status=status, at=last)
                if new is not None and status not in FINAL:
                    if new != status:
                        yield Row(job_id=job, status=new, at=at)
                    status, last = new, at
            if status not in FINAL or last + self.forget >= passed or job in awaited:
                kept[job] = (status, last)
        if kept:
            if kept != known:
                self.current.update(_columns([(job, *state) for job, state in kept.items()]))
            self.wake(max(passed, min(last + (self.forget if status in FINAL else self.silent) for status, last in kept.values())))
        elif known:
            self.current.clear()

    def due(self, passed: int, awaited: set) -> list[tuple]:
        """The waiting rows before passed, by time and status; those after it wait on, and awaited gets their jobs."""
        now, later = [], []
        for lot in self.waiting.get():
            for row in zip(*lot):
                (now if row[0] < passed else later).append(row)
        awaited.update(r[2] for r in later)
        if later:
            if now:
                self.waiting.put([_columns(later)])
            self.wake(min(r[0] for r in later))
        elif now:
            self.waiting.clear()
        return sorted(now, key=lambda r: r[:2])


def _columns(rows: list[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows)))


def lifecycle(updates: DataFrame, expire_after: str = "1 hour", late: str = "10 minutes", forget_after: str = "7 days", buckets: int = 1 << 13) -> DataFrame:
    """(job_id, status, at) whenever a job's status changes, from a stream of updates (job_id, status, at).

    A job in a final state moves no more. One that is silent for more than expire_after of event time
    expires, at that time, whether or not updates come later. forget_after an end the job's state is freed, and
    an update that still comes begins it anew. Updates of one time go by status. Null status is no update.

    A call to the store costs far more than a row in it, so jobs, whose ids are strings or whole numbers, share
    the state and timers of a bucket, by a hash of their ids. A task holds one bucket at a time: what came
    within late, and a row for each job that is not forgotten. With very many jobs take more buckets; a stream keeps their number.
    """
    rows = updates.where("status IS NOT NULL").withWatermark("at", late).select("job_id", "status", F.col("at").alias("event_time"), F.unix_micros("at").alias("at"))
    kind = rows.schema["job_id"].dataType.simpleString()
    told = rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets))).groupBy("bucket").transformWithState(
        Lifecycle(kind, micros(expire_after), micros(forget_after)), f"job_id {kind}, status string, at long", "Append", "EventTime"
    )
    return told.select("job_id", "status", F.timestamp_micros("at").alias("at"))
