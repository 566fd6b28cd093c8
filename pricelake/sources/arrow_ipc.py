"""Spark data source `arrow_ipc`: one Arrow IPC file per task, read back per file."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)


def _resolve(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        store, base = _resolve(self.path)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}.arrow"
        sink = writer = None
        rows = 0
        for batch in iterator:
            if writer is None:
                sink = store.open_output_stream(f"{base}/_{name}")
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return _Written(None, 0)
        writer.close()
        sink.close()
        return _Written(name, rows)

    def commit(self, messages):
        """New files take their names first, then the files of former jobs go if asked for."""
        from pyarrow import fs

        store, base = _resolve(self.path)
        store.create_dir(base, recursive=True)
        for done in messages:
            if done is not None and done.name:
                store.move(f"{base}/_{done.name}", f"{base}/{done.name}")
        for found in store.get_file_info(fs.FileSelector(base)):
            ours = found.base_name.startswith((f"part-{self.job}-", f"_part-{self.job}-"))
            left = found.base_name.startswith("_part-") and ours  # of a task that failed
            if left or self.overwrite and found.base_name.startswith(("part-", "_part-")) and not ours:
                store.delete_file(found.path)

    def abort(self, messages):
        store, base = _resolve(self.path)
        for done in messages:
            if done is not None and done.name:
                store.delete_file(f"{base}/_{done.name}")


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        store, base = _resolve(self.path)
        listed = store.get_file_info(fs.FileSelector(base))
        names = sorted(f.path for f in listed if f.base_name.startswith("part-") and f.base_name.endswith(".arrow"))
        return [_File(n) for n in names]

    def read(self, partition):
        import pyarrow as pa

        store, _ = _resolve(self.path)
        with store.open_input_file(partition.name) as source:
            reader = pa.ipc.open_file(source)
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls):
        return "arrow_ipc"

    def schema(self):
        return "timestamp bigint, price string, source string, assetPair string"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)
