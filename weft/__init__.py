"""Declarative data production on Spark: typed, stored artifacts, producers over DataFrames, graphs that build what is missing."""

from weft.artifact import Annotation, Artifact
from weft.backend import Backend, Connection, FolderBackend, MemoryBackend
from weft.executor import SparkExecutor
from weft.formats import CSV, JSON, Format, Parquet, Pickle
from weft.graph import Graph, GraphSnapshot
from weft.io import read, register_reader, register_writer, write
from weft.model import Fingerprint
from weft.partitions import InputFingerprints, NotPartitioned, PartitionField, PartitionKey
from weft.producer import PartitionDependencies, Producer, producer
from weft.sources import CloudFile, LocalFile, Partition, Snapshot, SparkFile, Storage, StringLiteral
from weft.stats import Statistic, Threshold
from weft.types import Type
from weft.versions import Version
from weft.views import View

__all__ = [
    "CSV", "JSON", "Annotation", "Artifact", "Backend", "CloudFile", "Connection", "Fingerprint", "FolderBackend", "Format", "Graph", "GraphSnapshot", "InputFingerprints", "LocalFile", "MemoryBackend", "NotPartitioned", "Parquet",
    "Partition", "PartitionDependencies", "PartitionField", "PartitionKey", "Pickle", "Producer", "Snapshot", "SparkExecutor", "SparkFile", "Statistic", "Storage", "StringLiteral", "Threshold",
    "Type", "Version", "View", "producer", "read", "register_reader", "register_writer", "write",
]
