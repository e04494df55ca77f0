"""Image files as a Spark sink: `df.write.format("rasterloom").save(folder)` writes one file a row.

Rows are (name string, data binary). Tasks write to a folder of their job's own; when all tasks have ended, the driver moves the files of the attempts that
count to their names. Attempts that failed, and jobs that were stopped, leave nothing. Files go through `pyarrow.fs`, which has to know the folder's scheme.
"""

from __future__ import annotations

import contextlib
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

from ..errors import CodecError
from ..packaging import ship
from .images import encode_files, format_of

_TEMPORARY = "_temporary"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder's address."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """What one attempt has written: final and temporary names."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex
        place(folder)[0].create_dir(self.temporary, recursive=True)

    @property
    def temporary(self) -> str:
        return posixpath.join(place(self.folder)[1], _TEMPORARY, self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, own, files = place(self.folder)[0], posixpath.join(self.temporary, uuid.uuid4().hex), []
        store.create_dir(own, recursive=False)  # an attempt that outlives its job finds no folder to write to
        for batch in iterator:
            for name, data in zip(batch.column("name"), batch.column("data")):
                name = name.as_py()
                if not name or name.startswith("/") or ".." in name.split("/") or name.split("/")[0] == _TEMPORARY:
                    raise CodecError(f"{name!r} can't be the name of a file in {self.folder}")
                at = posixpath.join(own, str(len(files)))
                with store.open_output_stream(at) as out:
                    out.write(data.as_buffer() if data.is_valid else b"")
                files.append((name, at))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = place(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for name, _ in files]
        try:
            if len(set(names)) < len(names):
                raise CodecError(f"two rows are named {next(n for n in names if names.count(n) > 1)}")
            targets = [posixpath.join(root, name) for name in names]
            there = [i.path for i in store.get_file_info(targets) if i.type != fs.FileType.NotFound] if targets else []
            if there and not self.overwrite:
                raise CodecError(f"{there[0]} exists already")
            for folder in {posixpath.dirname(t) for t in targets} | {root}:
                store.create_dir(folder, recursive=True)
            for (_, at), target in zip(files, targets):
                if target in there:
                    store.delete_file(target)
                store.move(at, target)
        finally:
            self._clear()
        with store.open_output_stream(posixpath.join(root, "_SUCCESS")):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = place(self.folder)
        for _ in range(20):  # attempts that are being stopped may still write
            if store.get_file_info(self.temporary).type == fs.FileType.NotFound:
                break
            with contextlib.suppress(OSError):
                store.delete_dir(self.temporary)
            time.sleep(0.1)
        above = posixpath.join(root, _TEMPORARY)
        if store.get_file_info(above).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(above)):  # of no other job
            store.delete_dir(above)


class ImageFiles(DataSource):
    """The format `rasterloom`: mode `append` refuses names that exist, `overwrite` replaces them; other files of the folder stay."""

    @classmethod
    def name(cls) -> str:
        return "rasterloom"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        kinds = {f.name: f.dataType for f in schema.fields}
        if kinds != {"name": StringType(), "data": BinaryType()}:
            raise CodecError(f"files are written from name string, data binary, not from {schema.simpleString()}")
        if "path" not in self.options:
            raise CodecError("a folder is needed: save(folder)")
        return FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship(spark)
    spark.dataSource.register(ImageFiles)


def write_images(pixels8: DataFrame, folder: str, kind: str = "png", quality: int = 90, name: Column | None = None, mode: str = "append") -> None:
    """One file an image of pixels8 in a folder, encoded by bands on the executors. `name`: an expression of img_id, its number by default; the kind's ending is added."""
    kind = format_of(f"a.{kind}")
    register(pixels8.sparkSession)
    files = encode_files(pixels8, kind, quality)
    named = files.select(F.concat((F.col("img_id") if name is None else name).cast("string"), F.lit({"png": ".png", "jpeg": ".jpg", "webp": ".webp"}[kind])).alias("name"), F.col(kind).alias("data"))
    named.write.format("rasterloom").mode(mode).save(folder)
