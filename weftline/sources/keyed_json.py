"""JSON-lines sink with one folder per key, a metrics file, and a commit: batch and stream.

A task writes its rows to files of its own attempt under ``_attempts`` and
tells their names, rows and sums in its commit message. The commit moves the
files of the successful attempts into the keys' folders and writes the metrics
of all keys, then a manifest; an abort, or a task that died, leaves nothing
outside ``_attempts``. A stream commits every batch into a folder of its own,
and a batch whose manifest is there already is not committed again. Readers
take what a manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

MANIFEST = "_manifest.json"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def safe(key: object) -> str:
    """A key as a folder name: ``/`` becomes ``_``; null and empty keys are ``_null``."""
    return str(key).replace("/", "_") if key not in (None, "") else "_null"


@dataclass
class Written(WriterCommitMessage):
    """(folder, file, rows, sums) of one attempt."""

    files: list = field(default_factory=list)


class _Attempts:
    def __init__(self, options: dict):
        self.path, self.key = options["path"], options["key"]
        self.sums = [c for c in options.get("sums", "").split(",") if c]

    def write(self, iterator: Iterator[Row]) -> Written:
        """Rows come sorted by key; a key's file is closed when the next one begins."""
        where, root = _files(self.path)
        attempt, out, told = f"{root}/_attempts/{uuid.uuid4().hex}", None, []
        where.create_dir(attempt, recursive=True)
        for row in iterator:
            folder = safe(row[self.key])
            if not told or told[-1][0] != folder:
                if out is not None:
                    out.close()
                name = f"{attempt}/{len(told):06d}.jsonl"
                out = where.open_output_stream(name)
                told.append([folder, name, 0, [0] * len(self.sums)])
            out.write((json.dumps(row.asDict(True), ensure_ascii=False, default=str) + "\n").encode())
            told[-1][2] += 1
            told[-1][3] = [s + (row[c] or 0) for s, c in zip(told[-1][3], self.sums)]
        if out is not None:
            out.close()
        return Written(told)

    def publish(self, messages: list, folder: str) -> None:
        """Move what the attempts wrote into ``folder`` and write metrics and manifest; once it has a manifest it stays as it is."""
        from pyarrow import fs

        where, root = _files(folder)
        if where.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            return self.discard(messages)
        metrics: dict[str, dict] = {}
        names = []
        for part, message in enumerate(m for m in messages if m is not None):
            for number, (key, name, rows, sums) in enumerate(message.files):
                target = f"{root}/{key}/part-{part:05d}-{number:05d}.jsonl"
                where.create_dir(f"{root}/{key}", recursive=True)
                # a commit that broke off has moved some files already
                if where.get_file_info(name).type == fs.FileType.File:
                    where.move(name, target)
                names.append(f"{key}/part-{part:05d}-{number:05d}.jsonl")
                told = metrics.setdefault(key, {"rows": 0, **{c: 0 for c in self.sums}})
                told["rows"] += rows
                for c, s in zip(self.sums, sums):
                    told[c] += s
        where.create_dir(root, recursive=True)
        for name, value in (("metrics.json", metrics), (MANIFEST, names)):
            with where.open_output_stream(f"{root}/{name}") as out:
                out.write(json.dumps(value, ensure_ascii=False, sort_keys=True).encode())

    def discard(self, messages: list) -> None:
        from pyarrow import fs

        where, _ = _files(self.path)
        for message in messages:
            for _, name, _, _ in message.files if message is not None else []:
                if where.get_file_info(name).type == fs.FileType.File:
                    where.delete_file(name)


class KeyedJsonWriter(_Attempts, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.publish(messages, self.path)

    def abort(self, messages: list) -> None:
        self.discard(messages)


class KeyedJsonStreamWriter(_Attempts, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, f"{self.path}/batch={batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self.discard(messages)


class KeyedJson(DataSource):
    """``format("keyed_json")`` with options path, key and, comma-joined, the numeric columns summed in the metrics."""

    @classmethod
    def name(cls) -> str:
        return "keyed_json"

    def writer(self, schema, overwrite: bool) -> KeyedJsonWriter:
        return KeyedJsonWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> KeyedJsonStreamWriter:
        return KeyedJsonStreamWriter(self.options)


def write_keyed_json(df: DataFrame, path: str, key: str, sums: list[str] | None = None) -> None:
    """Rows of every key as JSON lines under ``path``/<key>, with ``metrics.json``: rows of each key and the sums of some columns.

    ``path`` is a folder that nothing was committed to before.
    """
    df.sparkSession.dataSource.register(KeyedJson)
    sorted_ = df.sortWithinPartitions(key)
    sorted_.write.format("keyed_json").mode("append").option("path", path).option("key", key).option("sums", ",".join(sums or [])).save()


def stream_keyed_json(df: DataFrame, path: str, key: str, checkpoint: str, sums: list[str] | None = None) -> StreamingQuery:
    """Start the streaming form over what is available: a folder per batch, each with its metrics and manifest."""
    df.sparkSession.dataSource.register(KeyedJson)
    writer = df.writeStream.format("keyed_json").option("path", path).option("key", key).option("sums", ",".join(sums or []))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_keyed_json(spark, path: str, schema: str) -> DataFrame:
    """Rows of all committed files of a folder, or of the batch folders below it."""
    from pyarrow import fs

    where, root = _files(path)
    found = where.get_file_info(fs.FileSelector(root, recursive=True))
    base = path[: len(path) - len(root)] if path.endswith(root) else ""
    names = []
    for info in found:
        if info.base_name == MANIFEST:
            with where.open_input_stream(info.path) as f:
                names += [f"{base}{info.path[: -len(MANIFEST) - 1]}/{n}" for n in json.loads(f.read())]
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)
