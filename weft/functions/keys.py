"""Partition components and fingerprints as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft import types
from weft.partitions import FIELDS


def components(x: Column, t: types.Type) -> dict[str, Column]:
    """Every component that paths can show of a partition field of this type."""
    if type(t) not in FIELDS:
        raise TypeError(f"a {t.friendly_key} can't part a collection")
    return FIELDS[type(t)].columns(x)


def fold_xor(x: Column) -> Column:
    """The combination of many fingerprints: an aggregate, equal ones of which cancel."""
    return F.coalesce(F.bit_xor(x.cast("long")), F.lit(0).cast("long"))
