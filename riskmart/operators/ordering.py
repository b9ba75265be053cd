"""Recency order, global row index and ordered splits."""

from itertools import accumulate

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.ml.feature import Bucketizer

from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.lineage import materialize
from riskmart.operators import selection

PARTITION_ROWS = 5_000_000      # rows of a sorted partition, about
ROW_BITS = 33     # monotonically_increasing_id keeps the row within a partition below this bit


def recency_keys(df, first="DAYS_ID_PUBLISH", second="DAYS_REGISTRATION", key=S.KEY) -> list:
    """Sort keys: two absolute offsets, missing ones at their median, then the row key."""
    offsets = {c: F.abs(F.col(c).cast("double")) for c in (first, second)}
    middle = selection.medians(df, offsets)
    filled = [F.coalesce(c, F.lit(float(middle[n] or 0.0))) for n, c in offsets.items()]
    return filled + [F.col(key)]


def global_index(df, keys, column="row_index", partitions=None) -> DataFrame:
    """0-based position of every row in the order of the keys.

    Rows are range-partitioned and sorted on the whole key tuple, so ties on the
    first keys still spread out. The sorted rows are stored with their place: partition
    boundaries come from a sample and must not move between counting and numbering. There are
    as many partitions as the rows need.
    """
    spark = df.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PARTITION_ROWS))
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    placed = (
        keyed.repartitionByRange(partitions, *names)
        .sortWithinPartitions(*names)
        .drop(*names)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    placed = materialize(placed)
    part = F.shiftright("__place", ROW_BITS)
    row = F.col("__place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    sizes = {r["__part"]: r["n"] for r in sizes.collect()}             # one row per partition
    width = max(sizes, default=0) + 1
    starts = [0, *accumulate(sizes.get(i, 0) for i in range(width))]
    start = F.get(X.number_array(starts), part.cast("int"))
    return placed.withColumn(column, start + row).drop("__place")


def recency_index(
    df, first="DAYS_ID_PUBLISH", second="DAYS_REGISTRATION", key=S.KEY, column="row_index"
) -> DataFrame:
    return global_index(df, recency_keys(df, first, second, key), column)


def split_starts(rows, starts=S.SPLIT_STARTS) -> list[int]:
    """Positions at which the later splits begin; float product, truncated."""
    return [int(rows * s) for s in starts]


def split_by_order(df, keys, starts=S.SPLIT_STARTS, names=S.SPLIT_NAMES, column="split") -> DataFrame:
    """Labels rows by position in the key order.

    Only the key tuples at the split positions are looked up; the labelling itself
    is a comparison per row and moves nothing.
    """
    cuts = selection.tuples_at(df, keys, lambda rows: split_starts(rows, starts))
    label = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, cuts))):
        if cut is not None:
            label = F.when(X.precedes(keys, cut), F.lit(name)).otherwise(label)
        else:
            label = F.lit(name)
    return df.withColumn(column, label)


def ordered_split(
    df, first="DAYS_ID_PUBLISH", second="DAYS_REGISTRATION", key=S.KEY, column="split"
) -> DataFrame:
    return split_by_order(df, recency_keys(df, first, second, key), column=column)


def bucket_of(df, column, bounds, output) -> DataFrame:
    """Adds the number of bounds at or below the value (0 when below all)."""
    splits = [-float("inf"), *bounds, float("inf")]
    return (
        Bucketizer(splits=splits, inputCol=column, outputCol=output, handleInvalid="keep")
        .transform(df)
        .withColumn(output, F.col(output).cast("int"))
    )


def running_sums(df, order, names, partitions=None, following=False) -> tuple[DataFrame, dict]:
    """Whole-number sums over all rows ordered above each row, as `<name>_above`; and totals.

    `order` is unique per row. Rows are range-partitioned and stored with the number of their
    partition: whole partitions above come from their totals, the rest from a window inside
    the partition. A partition's boundaries cannot move once it is stored. With `following`,
    `<name>_next` holds the value of the row ordered next below, whichever partition it is in.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = materialize(df.repartitionByRange(partitions, order).withColumn("__bucket", F.spark_partition_id()))
    totals = out.groupBy("__bucket").agg(
        *[F.sum(n).alias(n) for n in names], *[F.max_by(n, order).alias(f"{n}_first") for n in names]
    )
    totals = {r["__bucket"]: r for r in totals.collect()}              # one row per partition
    width = max(totals, default=0) + 1
    below = Window.partitionBy("__bucket").orderBy(F.desc(order))
    above = below.rowsBetween(Window.unboundedPreceding, -1)
    whole = {}
    for name in names:
        per_bucket = [int(totals[b][name] or 0) if b in totals else 0 for b in range(width)]
        higher = list(accumulate(reversed(per_bucket), initial=0))
        whole[name] = higher.pop()
        base = F.get(X.number_array(higher[::-1]), F.col("__bucket"))
        out = out.withColumn(f"{name}_above", base + F.coalesce(F.sum(name).over(above), F.lit(0)))
        if following:
            # the highest row of the next partition below that has rows; -1 past the last
            firsts = accumulate((int(totals[b][f"{name}_first"]) if b in totals else None for b in range(width)), lambda last, v: last if v is None else v)
            heads = [-1, *[-1 if v is None else v for v in firsts]]
            beyond = F.nullif(F.get(X.number_array(heads), F.col("__bucket")), F.lit(-1))
            out = out.withColumn(f"{name}_next", F.coalesce(F.lead(name).over(below), beyond))
    return out.drop("__bucket"), whole
