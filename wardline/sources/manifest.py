"""The manifest of an appended table: which folders count, and up to which id.

A writer leaves its rows, and what it has indexed of them, in folders of its own name and then creates the
next manifest file, which must not exist yet. Until then nobody reads the folders: a writer that fails leaves
rows that nobody sees, and of two writers that started from the same manifest the second fails. A file that is
no manifest (a writer died while it wrote it) is passed over.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

FOLDER = "_manifest"


class ConcurrentAppendError(RuntimeError):
    """Another writer has appended since this one read the manifest; nothing of this one's counts."""


@dataclass(frozen=True)
class Manifest:
    """The committed appends, in order, the last id, and the number of the latest manifest file."""

    number: int = 0
    last_id: int = 0
    appends: tuple[str, ...] = ()

    def new_name(self) -> str:
        """A folder name for the next append, no other writer's."""
        return f"{self.number + 1}-{uuid.uuid4().hex[:12]}"

    def folders(self, path: str, part: str = "") -> list[str]:
        return [f"{path.rstrip('/')}{part}/append={name}" for name in self.appends]


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _text(spark: SparkSession, files, place) -> str:
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The latest manifest of the table at ``path``; one without appends if there is none."""
    files, folder = _file_system(spark, f"{path.rstrip('/')}/{FOLDER}")
    if not files.exists(folder):
        return Manifest()
    found = {int(f.getPath().getName().split(".")[0]): f.getPath() for f in files.listStatus(folder) if f.getPath().getName().endswith(".json")}
    for number in sorted(found, reverse=True):
        try:
            got = json.loads(_text(spark, files, found[number]))
            return Manifest(max(found), got["last_id"], tuple(got["appends"]))
        except ValueError:
            continue
    return Manifest(max(found, default=0))


def commit(spark: SparkSession, path: str, before: Manifest, append: str, last_id: int) -> Manifest:
    """Make an append count. Fails if another one was committed since ``before`` was read."""
    now = Manifest(before.number + 1, last_id, (*before.appends, append))
    files, place = _file_system(spark, f"{path.rstrip('/')}/{FOLDER}/{now.number}.json")
    try:
        stream = files.create(place, False)
    except Exception as error:
        if files.exists(place):
            raise ConcurrentAppendError(f"{path}: append {now.number} is another writer's") from error
        raise
    try:
        stream.write(bytearray(json.dumps({"last_id": now.last_id, "appends": now.appends}).encode()))
    finally:
        stream.close()
    return now


def names_below(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    files, folder = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
