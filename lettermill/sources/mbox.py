"""Mailboxes: messages of mbox files, and their headers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..storage import full_uri

SCHEMA = "file string, msg_no long, raw binary"


def split_mbox(data: bytes, drop_last: bool = False) -> list[bytes]:
    """The messages of a mailbox, with their 'From ' lines.

    Such a line begins a message unless it stands among headers, which reach from one to the next blank line; no
    blank line need precede it. What precedes the first one is a message too. drop_last leaves out the last one.
    """
    starts, headers, at = [], False, 0
    for line in data.splitlines(keepends=True):
        if not headers and line.startswith(b"From "):
            starts.append(at)
            headers = True
        elif not line.strip():
            headers = False
        at += len(line)
    if not data:
        return []
    if not starts or starts[0]:
        starts.insert(0, 0)
    messages = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    return messages[:-1] if drop_last else messages


def read_mbox(spark: SparkSession, path: str, drop_last: bool = False) -> DataFrame:
    """Rows (file, msg_no, raw) of the mailboxes under a path; messages count from 1 in each file. A task holds one mailbox at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split_mbox(data, drop_last)
                for at in range(0, len(found), 500):
                    part = found[at : at + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(at + 1, at + len(part) + 1), pa.int64()), pa.array(part, pa.binary())], names=["file", "msg_no", "raw"])

    return files.mapInArrow(run, SCHEMA)


@udtf(returnType="msg_no: bigint, raw: binary")
class SplitMbox:
    """SQL: SELECT * FROM split_mbox(content) once registered by register()."""

    def eval(self, data: bytes):
        for k, raw in enumerate(split_mbox(bytes(data)) if data is not None else [], 1):
            yield k, raw


def write_mbox(messages: DataFrame, path: str) -> None:
    """Messages (msg_no, raw) as one binary mailbox piece per partition, in order of msg_no, through a data source sink."""
    write_raw(messages.sortWithinPartitions("msg_no").select(F.lit("").alias("box"), "raw"), path, ".mbox")


def write_mailboxes(messages: DataFrame, verdict: str, path: str) -> None:
    """Messages (msg_no, raw) appended to one mailbox for each verdict: the folder path/test_<verdict>, with a piece from each task that had such messages."""
    box = F.concat(F.lit("test_"), F.regexp_replace(F.coalesce(F.col(verdict), F.lit("none")), r"[^\w.%-]+", "_"))
    write_raw(messages.select(box.alias("box"), "msg_no", "raw").sortWithinPartitions("box", "msg_no").select("box", "raw"), path, ".mbox")


def write_raw(rows: DataFrame, path: str, ending: str) -> None:
    """The bytes of rows (box, raw), one after the other, in files of the folder path/box, on any file system that pyarrow knows; files appear once all tasks are done."""
    spark = rows.sparkSession
    spark.dataSource.register(RawSink)
    uri = full_uri(spark, spark._jvm.org.apache.hadoop.fs.Path(path))
    rows.select("box", "raw").write.format("rawfiles").option("ending", ending).mode("append").save(uri)


def header_lines(messages: DataFrame) -> DataFrame:
    """Rows (msg_no, seq, name, value) of raw messages (msg_no, raw): header lines with continuation lines unfolded."""
    text = F.decode("raw", "UTF-8")
    head = F.split(F.regexp_replace(text, r"\r\n", "\n"), r"\n[ \t]*\n", 2)[0]
    # a line that starts with a blank goes on the line before, whose end is trimmed
    lines = F.split(F.regexp_replace(head, r"[ \t]*\n([ \t])", "$1"), "\n")
    rows = messages.select("msg_no", F.posexplode(lines).alias("seq", "line")).where(~F.startswith(F.col("line"), F.lit("From ")) & F.contains(F.col("line"), F.lit(":")))
    parts = F.split("line", ":", 2)
    return rows.select("msg_no", "seq", parts[0].alias("name"), F.ltrim(parts[1]).alias("value"))


from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage  # noqa: E402


class RawSink(DataSource):
    """Sink 'rawfiles': the raw bytes of rows, in one file for each task and box."""

    @classmethod
    def name(cls) -> str:
        return "rawfiles"

    def schema(self) -> str:
        return "box string, raw binary"

    def writer(self, schema, overwrite):
        return _RawWriter(self.options["path"], self.options.get("ending", ""))


@dataclass
class _Written(WriterCommitMessage):
    """Files that a task has written, by their temporary and their final names."""

    files: list[tuple[str, str]]


class _RawWriter(DataSourceWriter):
    def __init__(self, uri: str, ending: str):
        self.uri, self.ending = uri, ending

    def _system(self):
        import pyarrow.fs

        return pyarrow.fs.FileSystem.from_uri(self.uri)

    def write(self, rows):
        import uuid

        system, root = self._system()
        name, opened, files = uuid.uuid4().hex, None, []
        for row in rows:
            if opened is None or opened[0] != row.box:
                if opened is not None:
                    opened[1].close()
                folder = f"{root}/{row.box}" if row.box else root
                system.create_dir(folder, recursive=True)
                last = f"{folder}/part-{name}-{len(files)}{self.ending}"
                files.append((f"{folder}/_part-{name}-{len(files)}", last))
                opened = (row.box, system.open_output_stream(files[-1][0]))
            opened[1].write(bytes(row.raw))
        if opened is not None:
            opened[1].close()
        return _Written(files)

    def commit(self, messages):
        system, _ = self._system()
        for message in messages:
            for temporary, last in message.files if message else []:
                system.move(temporary, last)

    def abort(self, messages):
        system, _ = self._system()
        for message in messages:
            for temporary, _last in message.files if message else []:
                system.delete_file(temporary)


def register(spark: SparkSession) -> None:
    """Make split_mbox callable from SQL."""
    spark.udtf.register("split_mbox", SplitMbox)
