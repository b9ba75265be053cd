"""Keeping intermediate frames and small model tables."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from riskmart.lineage import materialize

SMALL_BYTES = 8 << 20       # of ids that may be broadcast
FIELD_BYTES = 8             # of a field beside its text


def kept(df: DataFrame) -> DataFrame:
    """The frame, written once to the shared folder."""
    return materialize(df)


def extended(df: DataFrame, names, more: str) -> StructType:
    """The schema of some columns and of new ones after them."""
    return StructType([*(df.schema[c] for c in names), *StructType.fromDDL(more).fields])


def with_text(df: DataFrame, text_col: str, without=()) -> tuple[DataFrame, list]:
    """The columns but those in `without`, the text as a string, and their names.

    Texts travel to the tasks once, under their own name.
    """
    names = [c for c in df.columns if c not in without or c == text_col]
    columns = [F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return df.select(*columns), names


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rows_with(df: DataFrame, ids: DataFrame, on, limit=SMALL_BYTES, how="inner") -> DataFrame:
    """Rows of a wide frame joined to a stored narrow frame of ids.

    The bytes of the ids are summed; up to `limit` of them are broadcast, so the wide rows stay
    where they are. Beyond it the join shuffles both sides.
    """
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + FIELD_BYTES for c in ids.columns), F.lit(0))
    few = ids.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] <= limit
    return df.join(F.broadcast(ids) if few else ids, on, how)
