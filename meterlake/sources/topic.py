"""The job topic as a data source of Spark: format("job_topic") to read and write, in batches and as a stream.

A topic is a folder. Writing tasks leave segments of JSON lines; a commit, one small file with a number,
names the segments of a batch, and only what a commit names is in the topic. Offsets are numbers of
commits, a reading task takes one segment. Options: path, and for writers writer, the name of a stream:
a batch that a stream has committed before is not committed again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "key string, value string, job_type string"
#: Messages that a reading task hands over at once.
LINES = 4096


class Topic:
    """The folder of a topic, by way of a file system that driver and executors share."""

    def __init__(self, path: str):
        self.store, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def commits(self) -> list[str]:
        """The paths of all commits, in order."""
        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(".json"))

    def read(self, path: str) -> dict:
        with self.store.open_input_stream(path) as file:
            return json.loads(file.read())

    def commit(self, writer: str, batch: int | None, segments: list[str]) -> bool:
        """Adds a batch unless this writer has committed it before; the new file gets its name once it is whole."""
        known = self.commits()
        if batch is not None and any((c := self.read(p))["writer"] == writer and c["batch"] == batch for p in reversed(known)):
            return False
        self.store.create_dir(f"{self.root}/commits")
        name = f"{self.root}/commits/{len(known):012d}"
        draft = f"{name}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as file:
            file.write(json.dumps({"writer": writer, "batch": batch, "segments": segments}).encode())
        self.store.move(draft, f"{name}.json")
        return True

    def drop(self, segments: list[str]) -> None:
        for name in segments:
            self.store.delete_file(f"{self.root}/segments/{name}")


class Segment(InputPartition):
    def __init__(self, name: str):
        self.name = name


@dataclass
class Written(WriterCommitMessage):
    segments: list[str]


class _Reading:
    """What readers of both kinds share; tasks open the topic anew."""

    def __init__(self, path: str):
        self.path = path

    def segments(self, first: int, last: int | None) -> list[InputPartition]:
        topic = Topic(self.path)
        return [Segment(s) for c in topic.commits()[first:last] for s in topic.read(c)["segments"]]

    def read(self, partition: Segment | None) -> Iterator[pa.RecordBatch]:
        """The messages of a segment; Spark asks for None where a topic has no segment at all."""
        if partition is None:
            return
        topic = Topic(self.path)
        kind = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])
        lines: list[dict] = []
        with topic.store.open_input_stream(f"{topic.root}/segments/{partition.name}") as raw:
            for line in _lines(raw):
                lines.append(json.loads(line))
                if len(lines) == LINES:
                    yield pa.RecordBatch.from_pylist(lines, schema=kind)
                    lines = []
        yield pa.RecordBatch.from_pylist(lines, schema=kind)


def _lines(raw: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a file, read piece by piece."""
    rest = b""
    while piece := raw.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


class _BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.segments(0, None)


class _StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(Topic(self.path).commits())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.segments(start["commits"], end["commits"])


class _Writing:
    def __init__(self, path: str, writer: str):
        self.path, self.writer = path, writer

    def write(self, iterator) -> Written:
        """A segment a task; a task without rows leaves none."""
        topic, name, rows = Topic(self.path), uuid.uuid4().hex, iter(iterator)
        first = next(rows, None)
        if first is None:
            return Written([])
        topic.store.create_dir(f"{topic.root}/segments")
        with topic.store.open_output_stream(f"{topic.root}/segments/{name}") as file:
            file.write((json.dumps(first.asDict()) + "\n").encode())
            for row in rows:
                file.write((json.dumps(row.asDict()) + "\n").encode())
        return Written([name])

    def finish(self, messages: list[Written | None], batch: int | None) -> None:
        topic, segments = Topic(self.path), [s for m in messages if m is not None for s in m.segments]
        if segments and not topic.commit(self.writer, batch, segments):
            topic.drop(segments)

    def undo(self, messages: list[Written | None]) -> None:
        Topic(self.path).drop([s for m in messages if m is not None for s in m.segments])


class _BatchWriter(_Writing, DataSourceWriter):
    def commit(self, messages) -> None:
        self.finish(messages, None)

    def abort(self, messages) -> None:
        self.undo(messages)


class _StreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self.finish(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        self.undo(messages)


class JobTopic(DataSource):
    """format("job_topic"); one writer at a time."""

    @classmethod
    def name(cls) -> str:
        return "job_topic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("messages are appended to a topic; use mode append")
        return _BatchWriter(self.options["path"], self.options.get("writer", ""))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        if not self.options.get("writer"):
            raise ValueError("a stream that writes to a topic needs the option writer, a name that it keeps")
        return _StreamWriter(self.options["path"], self.options["writer"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(JobTopic)
