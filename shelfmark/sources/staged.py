"""Staging folders as a sink that is all or nothing: ``staged_files``.

Tasks write their files and a list of them under <root>/.staging-<job>; what a lost or repeated task wrote stays there and goes with it. The commit marks the
job, moves every listed file to its path, removes covers of other formats beside a new one, and drops the folder. Nothing is visible before. A driver that is
lost while it commits leaves the mark, and ``recover`` ends its work; jobs without the mark are dropped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Names of covers.
COVERS = tuple(f"cover.{x}" for x in ("jpg", "jpeg", "png", "webp"))
PREFIX, MARK, MOVERS = ".staging-", "COMMIT", 16


@dataclass
class TaskFiles(WriterCommitMessage):
    listed: str
    files: int


class StagedWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.job = f"{PREFIX}{uuid.uuid4().hex}"

    def _at(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        return system, root, f"{root}/{self.job}"

    def write(self, iterator: Iterator[Row]) -> TaskFiles:
        system, root, folder = self._at()
        own, made = f"{folder}/{uuid.uuid4().hex}", 0
        system.create_dir(own, recursive=True)
        with system.open_output_stream(f"{own}.list") as listed:
            for row in iterator:
                path = row["path"].removeprefix(self.root).lstrip("/")
                if ".." in path.split("/") or not path:
                    raise ValueError(f"{row['path']} isn't below {self.root}")
                with system.open_output_stream(f"{own}/{made}") as out:
                    out.write(bytes(row["content"] or b""))
                listed.write((json.dumps([f"{own}/{made}", f"{root}/{path}"]) + "\n").encode())
                made += 1
        return TaskFiles(f"{own}.list", made)

    def commit(self, messages: list[TaskFiles | None]) -> None:
        system, _, folder = self._at()
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{MARK}") as out:
            out.write("\n".join(m.listed for m in messages if m is not None).encode())
        finish(system, folder)

    def abort(self, messages: list[TaskFiles | None]) -> None:
        system, _, folder = self._at()
        _drop(system, folder)


def _drop(system, folder: str) -> None:
    from pyarrow import fs

    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


def finish(system, folder: str) -> None:
    """Do what a marked job has still to do; files that were moved already are passed over."""
    from pyarrow import fs

    def place(line: bytes) -> None:
        source, path = json.loads(line)
        if system.get_file_info(source).type == fs.FileType.File:
            parent, _, name = path.rpartition("/")
            system.create_dir(parent, recursive=True)
            if system.get_file_info(path).type == fs.FileType.File:
                system.delete_file(path)
            system.move(source, path)
            for other in COVERS if name in COVERS else ():
                if other != name and system.get_file_info(f"{parent}/{other}").type == fs.FileType.File:
                    system.delete_file(f"{parent}/{other}")

    with system.open_input_stream(f"{folder}/{MARK}") as mark, ThreadPoolExecutor(MOVERS) as movers:
        for listed in mark.read().decode().split():
            with system.open_input_stream(listed) as lines:
                list(movers.map(place, lines.read().splitlines()))
    _drop(system, folder)


def recover(root: str) -> int:
    """End the commits below ``root`` that a lost driver left, drop what wasn't committed; how many were ended. No job may be writing."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root)
    ended = 0
    for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if f.base_name.startswith(PREFIX):
            if system.get_file_info(f"{f.path}/{MARK}").type == fs.FileType.File:
                finish(system, f.path)
                ended += 1
            else:
                _drop(system, f.path)
    return ended


class StagedFiles(DataSource):
    """``df.write.format("staged_files").mode("append").save(root)`` of (path, content), paths below the root."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return StagedWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StagedFiles)
