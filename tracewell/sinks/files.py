"""A sink of files that are there whole or not at all.

Every attempt of a task writes below a folder of its own. When the job is done,
the driver moves the files of the attempts that count to their places; when it
fails, all of that is deleted. A file is made of many rows, so that no value has
to hold a recording.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_PENDING = "_pending"


@dataclass
class Written(WriterCommitMessage):
    """What an attempt has written: its folder and the names of its files."""

    folder: str
    names: list[str]


class RecordingWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.run = folder, uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = self._store()
        attempt = f"{base}/{_PENDING}-{self.run}/{uuid.uuid4().hex}"
        names: list[str] = []
        out = None
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                    if not names or name != names[-1]:
                        if out:
                            out.close()
                        if not name or name.startswith(("/", _PENDING)) or ".." in name.split("/") or name in names:
                            raise ValueError(f"no name for a file, or one that comes twice: {name!r}")
                        place = f"{attempt}/{name}"
                        store.create_dir(place.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(place)
                        names.append(name)
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out:
                out.close()
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        done = [m for m in messages if m]
        if len({n for m in done for n in m.names}) != sum(len(m.names) for m in done):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of one name")
        for message in done:
            for name in message.names:
                store.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                store.move(f"{message.folder}/{name}", f"{base}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, base = self._store()
        pending = f"{base}/{_PENDING}-{self.run}"
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)


class RecordingSink(DataSource):
    """``df.write.format("recordings")`` of rows (name, content): neighbouring rows of one name are one file."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(self.options["path"])


def write_recordings(parts: DataFrame, folder: str, name: Column, order: str, content: str = "content") -> None:
    """Write the ``content`` of all rows of one ``name``, in ``order``, to ``folder``/``name``.

    ``folder`` is a path or URI that all executors and the driver share. A job
    that fails leaves nothing; of a task that ran more than once, one attempt
    counts. Files that are there already are replaced. Null contents add nothing;
    a null or empty name, or one that leads out of the folder, is an error. The
    driver holds the names and renames files one by one.
    """
    parts.sparkSession.dataSource.register(RecordingSink)
    rows = parts.select(name.alias("name"), F.col(order).alias("_order"), F.col(content).alias("content"))
    dealt = rows.repartition("name").sortWithinPartitions("name", "_order")
    dealt.select("name", "content").write.format("recordings").mode("append").save(folder)
