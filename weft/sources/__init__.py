"""Where data lie: templated storage, its partitions and their contents' fingerprints."""

from weft.sources.base import Partition, Snapshot, Storage
from weft.sources.files import CloudFile, LocalFile, SparkFile
from weft.sources.literal import StringLiteral

__all__ = ["CloudFile", "LocalFile", "Partition", "Snapshot", "SparkFile", "Storage", "StringLiteral"]
