"""Images to files named by their content: a Python data source to write to, and the names and tags as columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.marks import Tags, tag

#: First bytes, in hexadecimal, of image formats; anything else is named like the first.
FORMATS = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D", "webp": "52494646.{8}57454250", "tiff": "(49492A00|4D4D002A)"}


def image_name(content: Column) -> Column:
    """32 digits of the content's SHA-256 and the format's extension; null for null or empty content."""
    start = F.hex(F.substring(content, 1, 12))
    kind = F.lit(None)
    for name, first in reversed(FORMATS.items()):
        kind = F.when(start.rlike(f"^{first}"), name).otherwise(kind)
    return F.when(F.length(content) > 0, F.concat(F.substring(F.sha2(content, 256), 1, 32), F.lit("."), F.coalesce(kind, F.lit(next(iter(FORMATS))))))


def image_tag(content: Column, folder: str, tags: Tags = Tags()) -> Column:
    """The tag of an image saved in a folder."""
    return tag("image", F.concat(F.lit(folder.rstrip("/") + "/"), image_name(content)), tags)


@dataclass
class Saved(WriterCommitMessage):
    images: int
    bytes: int


class ImageWriter(DataSourceWriter):
    """Writes rows (name, content), each name once however often a row or a task comes.

    A task writes to a name of its own in the job's folder and then moves the file into place. Names follow from contents, so a
    file that is there needn't be written again, and what a failed task has moved is what the next one would.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.job = path, uuid.uuid4().hex
        if overwrite:
            where, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            if where.get_file_info(folder).type == fs.FileType.Directory:
                where.delete_dir_contents(folder)

    def place(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            where, folder = fs.FileSystem.from_uri(self.path)
        else:
            where, folder = fs.LocalFileSystem(), self.path
        return where, folder.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Saved:
        where, folder = self.place()
        held = f"{folder}/_{self.job}"
        where.create_dir(held, recursive=True)
        images = size = 0
        for row in rows:
            if row["name"] is None or row["content"] is None:
                continue
            final = f"{folder}/{row['name']}"
            if where.get_file_info(final).type == fs.FileType.NotFound:
                mine = f"{held}/{uuid.uuid4().hex}"
                with where.open_output_stream(mine) as out:
                    out.write(bytes(row["content"]))
                where.move(mine, final)
                images, size = images + 1, size + len(row["content"])
        return Saved(images, size)

    def _end(self) -> None:
        where, folder = self.place()
        held = f"{folder}/_{self.job}"
        if where.get_file_info(held).type == fs.FileType.Directory:
            where.delete_dir(held)

    def commit(self, messages: list[Saved | None]) -> None:
        self._end()

    def abort(self, messages: list[Saved | None]) -> None:
        self._end()


class ImageSink(DataSource):
    """The format `docweave_images`: rows (name string, content binary) to files below the option path."""

    @classmethod
    def name(cls) -> str:
        return "docweave_images"

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("images have a name and a content")
        return ImageWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageSink)


def save_images(images: DataFrame, path: str, mode: str = "append") -> None:
    """Save images (content; others are ignored) below path, each content once; null and empty contents are left out.

    The path must be one that every executor reaches. `overwrite` empties it first.
    """
    register(images.sparkSession)
    named = images.select(image_name(F.col("content")).alias("name"), "content").where("name is not null")
    named.write.format("docweave_images").mode(mode).option("path", path).save()
