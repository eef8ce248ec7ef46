"""Versions of producers, by which their outputs are made anew."""

from __future__ import annotations

import dataclasses
import datetime
import inspect
import subprocess
from functools import cached_property
from typing import Any

from weft.model import Fingerprint, Model


@dataclasses.dataclass(frozen=True, kw_only=True)
class Version(Model):
    pass


@dataclasses.dataclass(frozen=True, kw_only=True)
class SemVer(Version):
    """From 1.0.0 on only the major number counts; before, all three."""

    major: int
    minor: int
    patch: int

    @cached_property
    def fingerprint(self) -> Fingerprint:
        return Fingerprint.of("SemVer", self.major) if self.major else Fingerprint.of("SemVer", 0, self.minor, self.patch)


@dataclasses.dataclass(frozen=True, kw_only=True)
class String(Version):
    value: str


@dataclasses.dataclass(frozen=True, kw_only=True)
class Timestamp(Version):
    """Now, where nothing is given, so that outputs are always made anew."""

    dt: datetime.datetime = dataclasses.field(default_factory=lambda: datetime.datetime.now(datetime.UTC))

    def __post_init__(self) -> None:
        if self.dt.tzinfo is None:
            raise ValueError("a Timestamp needs a time zone")


@dataclasses.dataclass(frozen=True, kw_only=True)
class GitCommit(Version):
    """The commit of the working folder, or one in an environment variable."""

    envvar: str = "GIT_SHA"

    @cached_property
    def sha(self) -> str:
        import os

        return os.environ.get(self.envvar) or subprocess.run(["git", "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()

    @cached_property
    def fingerprint(self) -> Fingerprint:
        return Fingerprint.of("GitCommit", self.sha)


@dataclasses.dataclass(frozen=True, kw_only=True)
class Source(Version):
    """The text of a class or function."""

    text: str

    @classmethod
    def of(cls, found: Any) -> Source:
        return cls(text=inspect.getsource(found))
