"""Files and folders, local or in any store that Spark reaches."""

from __future__ import annotations

import dataclasses
import glob
import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any, ClassVar, Self

from weft.model import Fingerprint, frozendict
from weft.partitions import InputFingerprints
from weft.session import current
from weft.sources.base import DEFAULT, Partition, Snapshot, Storage, wanted_only

#: A folder's note of its rows' digest, hidden from Spark's readers by its first letter.
NOTE = "_weft.json"


@dataclasses.dataclass(frozen=True, kw_only=True)
class FileStorage(Storage):
    located: ClassVar[tuple[str, ...]] = ("path",)
    path: str = DEFAULT

    def _found(self, pattern: str) -> list[str]:
        raise NotImplementedError

    def discover(self, wanted: Mapping = InputFingerprints()) -> tuple[Snapshot, ...]:
        template = self.templates["path"]
        out = []
        for path in self._found(template.wildcard(self.keys())):
            fingerprint, key = template.parse(path, self.keys())
            out.append(Partition(storage=self, key=key, input_fingerprint=fingerprint, location=frozendict({"path": path})))
        return tuple(p.snapshot() for p in wanted_only(out, wanted))


@dataclasses.dataclass(frozen=True, kw_only=True)
class LocalFile(FileStorage):
    """Files on disks that the driver and all executors see under one path.

    A file's fingerprint is that of its bytes. A folder that was written here has that of its rows, from its
    note; any other folder that of its files' bytes, whatever their names.
    """

    path: str = os.path.join(tempfile.gettempdir(), DEFAULT)

    @classmethod
    def rooted_at(cls, root: str | Path, path: str = DEFAULT) -> Self:
        return cls(path=os.path.join(str(root), path))

    def _found(self, pattern: str) -> list[str]:
        return sorted(glob.glob(pattern))

    def exists(self, partition: Partition) -> bool:
        return os.path.exists(partition.path)

    def content_fingerprint(self, partition: Partition) -> Fingerprint:
        path = partition.path
        if os.path.isfile(path):
            return Fingerprint.from_string(_sha256(path))
        note = os.path.join(path, NOTE)
        if os.path.isfile(note):
            with open(note) as f:
                return Fingerprint.from_int(json.load(f)["rows"])
        if not os.path.isdir(path):
            raise FileNotFoundError(path)
        inner = sorted(_sha256(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n[0] not in "._")
        return Fingerprint.of(inner)

    def publish(self, staged: str, path: str, rows: Fingerprint | None = None) -> None:
        """Move what was written beside its place into it; readers see all of it or nothing."""
        if rows is not None:
            with open(os.path.join(staged, NOTE), "w") as f:
                json.dump({"rows": int(rows.key)}, f)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if os.path.isdir(path):
            shutil.rmtree(path)
        os.replace(staged, path)

    def drop(self, path: str) -> None:
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.remove(path)


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@dataclasses.dataclass(frozen=True, kw_only=True)
class SparkFile(FileStorage):
    """Files in any store that Spark's own readers reach (hdfs, s3a, gs, viewfs, file).

    A raw file's fingerprint is the checksum that its store keeps, if it keeps one (HDFS does, object stores mostly
    do); else that of its path, length and time of change, which a listing gives without
    reading the data, or with `by_content` that of its bytes, which are read for it. That of a folder is made of its files'. A folder that
    was written here has that of its rows.
    """

    plain_fields: ClassVar[tuple[str, ...]] = ()
    by_content: bool = False

    @staticmethod
    def _system(path: str) -> tuple[Any, Any]:
        spark = current()
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def _found(self, pattern: str) -> list[str]:
        system, where = self._system(pattern)
        listed = system.globStatus(where) or []
        plain = "://" not in self.path
        return sorted(x.getPath().toUri().getPath() if plain else x.getPath().toString() for x in listed)

    def exists(self, partition: Partition) -> bool:
        system, where = self._system(partition.path)
        return system.exists(where)

    def content_fingerprint(self, partition: Partition) -> Fingerprint:
        system, where = self._system(partition.path)
        note = f"{partition.path}/{NOTE}"
        beside, at = self._system(note)
        if beside.exists(at):
            return Fingerprint.from_int(json.loads(self.get(note))["rows"])
        if not system.exists(where):
            raise FileNotFoundError(partition.path)
        status = system.getFileStatus(where)
        if status.isFile():
            return Fingerprint.of(*self._stamp(system, status))
        found, files = [], system.listFiles(where, True)
        while files.hasNext():
            x = files.next()
            if x.getPath().getName()[0] not in "._":
                found.append(self._stamp(system, x))
        return Fingerprint.of(sorted(found, key=str))

    def _stamp(self, system: Any, status: Any) -> list:
        """What tells a file's content from another: the store's checksum, its bytes' digest, or its place, length and time."""
        kept = system.getFileChecksum(status.getPath())
        if kept is not None:
            return [kept.getAlgorithmName(), bytes(kept.getBytes()).hex()]
        if not self.by_content:
            return [status.getPath().toString() if "://" in self.path else status.getPath().toUri().getPath(), status.getLen(), status.getModificationTime()]
        stream = system.open(status.getPath())
        try:  # a buffer at a time, in the driver's JVM
            return ["SHA-256", current()._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)]
        finally:
            stream.close()

    def get(self, path: str) -> bytes:
        """A small file's bytes."""
        system, where = self._system(path)
        stream = system.open(where)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def put(self, path: str, raw: bytes) -> None:
        system, where = self._system(path)
        stream = system.create(where, True)
        try:
            stream.write(bytearray(raw))
        finally:
            stream.close()

    def publish(self, staged: str, path: str, rows: Fingerprint | None = None) -> None:
        system, source = self._system(staged)
        if rows is not None:
            self.put(f"{staged}/{NOTE}", json.dumps({"rows": int(rows.key)}).encode())
        _, target = self._system(path)
        system.mkdirs(target.getParent())
        system.delete(target, True)
        if not system.rename(source, target):
            raise OSError(f"can't move {staged} to {path}")

    def drop(self, path: str) -> None:
        system, where = self._system(path)
        system.delete(where, True)


@dataclasses.dataclass(frozen=True, kw_only=True)
class CloudFile(SparkFile):
    """Objects of a bucket, by Hadoop's file system of the scheme. Not tested without a network."""

    plain_fields = ("bucket", "scheme")
    bucket: str = ""
    scheme: str = "gs"
    path: str = DEFAULT

    def __post_init__(self) -> None:
        if self.bucket and "://" not in self.path:
            object.__setattr__(self, "path", f"{self.scheme}://{self.bucket}/{self.path}")
