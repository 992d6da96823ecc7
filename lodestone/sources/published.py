"""Versions of a stored table: data first, then a manifest that makes it readable.

A writer puts its files into a folder of its own and publishes by creating the next numbered manifest, which exactly one
writer can do. Readers take the newest manifest that is whole and read only the folders it names, so that they see neither
a writer at work nor one that failed, and what they read stays while newer versions appear.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NAME = re.compile(r"v-(\d{12})\.json")


class VersionConflict(RuntimeError):
    """Another writer published first; read the newest version and try again."""


@dataclass(frozen=True)
class Version:
    number: int
    content: dict


class Published:
    """The versions below ``path``, on whatever storage it lies. Folders are named in manifests relative to ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def numbers(self) -> list[int]:
        """Numbers of all manifests, whole or not."""
        return [int(m[1]) for n in self._names("manifests") if (m := _NAME.fullmatch(n))]

    def read(self, number: int) -> Version | None:
        """One version; None if its manifest is gone or isn't whole."""
        try:
            stream = self._fs.open(self._at(f"manifests/v-{number:012d}.json"))
        except Py4JJavaError:
            return None
        try:
            return Version(number, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        except ValueError:
            return None
        finally:
            stream.close()

    def newest(self) -> Version | None:
        for number in reversed(self.numbers()):
            if version := self.read(number):
                return version
        return None

    def folder(self, kind: str) -> str:
        """A name for a new data folder, shared with no other writer."""
        return f"data/{kind}-{uuid.uuid4().hex}"

    def full(self, folder: str) -> str:
        return f"{self.path}/{folder}"

    def drop(self, folder: str) -> None:
        """Delete a folder that no manifest names."""
        self._fs.delete(self._at(folder), True)

    def publish(self, content: dict, after: Version | None) -> Version:
        """Make ``content`` the version that follows ``after``; raises ``VersionConflict`` if there is one already."""
        numbers = self.numbers()
        number = max([after.number if after else 0, *[n for n in numbers if self.read(n) is None]]) + 1
        if any(n >= number for n in numbers):
            raise VersionConflict(f"version {number} of {self.path} exists")
        try:
            out = self._fs.create(self._at(f"manifests/v-{number:012d}.json"), False)
        except Py4JJavaError as problem:
            raise VersionConflict(f"version {number} of {self.path} exists") from problem
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        return Version(number, content)

    def expire(self, keep: int = 3) -> list[str]:
        """Drop all but the newest ``keep`` versions and the folders that only those named; returns the folders.

        Folders that no version has ever named belong to writers, at work or failed, and are left alone.
        """
        versions = [v for n in self.numbers() if (v := self.read(n))]
        old, live = versions[:-keep], versions[-keep:]
        needed = {f for v in live for f in _folders(v.content)}
        gone = sorted({f for v in old for f in _folders(v.content)} - needed)
        for v in old:
            self._fs.delete(self._at(f"manifests/v-{v.number:012d}.json"), False)
        for f in gone:
            self._fs.delete(self._at(f), True)
        return gone


def _folders(content) -> set[str]:
    """All data folders that a manifest names, at any depth."""
    if isinstance(content, dict):
        return set().union(*map(_folders, content.values()))
    if isinstance(content, list):
        return set().union(*map(_folders, content))
    return {content} if isinstance(content, str) and content.startswith("data/") else set()
