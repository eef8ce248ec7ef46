"""Values held in the metadata itself."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from typing import ClassVar

from weft.model import Fingerprint, frozendict
from weft.partitions import InputFingerprints
from weft.sources.base import DEFAULT, Partition, Snapshot, Storage, wanted_only

#: Values by partition; a driver's memory, so a new process doesn't find them.
_VALUES: dict[Partition, str] = {}


@dataclasses.dataclass(frozen=True, kw_only=True)
class StringLiteral(Storage):
    """A string with a preset value, or one for each partition that a producer writes."""

    plain_fields: ClassVar[tuple[str, ...]] = ("value",)
    located: ClassVar[tuple[str, ...]] = ("id",)
    id: str = DEFAULT
    value: str | None = None

    def discover(self, wanted: Mapping = InputFingerprints()) -> tuple[Snapshot, ...]:
        if self.value is not None:
            if self.keys():
                raise ValueError("a preset literal can't be partitioned")
            return (Partition(storage=self, location=frozendict({"id": self.id})).snapshot(),)
        found = [p for p in _VALUES if p.storage == self]
        return tuple(p.snapshot() for p in wanted_only(found, wanted))

    def read(self, partition: Partition) -> str:
        found = self.value if self.value is not None else _VALUES.get(partition)
        if found is None:
            raise FileNotFoundError(f"nothing was written to {partition.location}")
        return found

    def write(self, partition: Partition, value: str) -> None:
        if self.value is not None:
            raise ValueError("a literal that is set can't be written again")
        _VALUES[partition] = value

    def exists(self, partition: Partition) -> bool:
        return self.value is not None or partition in _VALUES

    def content_fingerprint(self, partition: Partition) -> Fingerprint:
        return Fingerprint.from_string(self.read(partition))
