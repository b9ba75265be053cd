"""Shards of bounded size by extendible hashing.

A row's hash is read bit by bit. A bucket is a prefix of the hash; it is split on the next bit
only while it holds more than the byte limit, so the directory is deep only where the data
needs it. The sizes of all prefixes come from one aggregate per round of bits, and further
rounds see only the rows of buckets that are still too large.
"""

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from riskmart.llm.storing import kept

BITS = 60
ROUND_BITS = 8              # bits by which later rounds go deeper
LIMIT_BYTES = 1 << 20


def hashed_rows(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_bytes, hash): 60 bits of the MD5 of id and text, so only equal rows share all bits."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)
    return docs.select(
        F.col(id_col),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long").alias("hash"),
    )


def prefix(depth):
    return F.expr(f"shiftright(hash, {BITS} - {depth})")


def _cells(rows, shallow, deep, limit):
    """(cell, depth): for each prefix of `deep` bits the shortest one that fits, NULL if none from
    `shallow` bits on does. A bucket of a single row fits whatever its size."""
    cells = rows.groupBy(prefix(deep).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    each = cells.withColumn("d", F.explode(F.sequence(F.lit(shallow), F.lit(deep)))).withColumn(
        "p", F.expr(f"shiftright(cell, {deep} - d)")
    )
    fits = each.groupBy("d", "p").agg(((F.sum("bytes") <= limit) | (F.sum("n") == 1)).alias("fits"))
    return each.join(fits, ["d", "p"]).groupBy("cell").agg(F.min(F.when(F.col("fits"), F.col("d"))).alias("depth"))


def shard_rows(docs: DataFrame, limit=LIMIT_BYTES, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: the id, n_bytes, depth, prefix and page of its shard.

    The rows of a shard hold at most `limit` bytes of text, unless it is a single longer row.
    Null ids and texts are hashed as empty ones and stay, and so do repeated rows; rows that
    agree in all bits and exceed the limit together go to numbered overflow pages. Empty
    tables give no rows. Other columns are not read.
    """
    rows = kept(hashed_rows(docs, id_col, text_col))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    shallow, deep = 0, min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 3))
    done, left = [], rows
    while True:
        cells = kept(_cells(left, shallow, deep, limit))
        placed = left.withColumn("cell", prefix(deep)).join(cells, "cell")
        done.append(placed.where("depth is not null").withColumn("page", F.lit(0).cast("long")).drop("cell"))
        if cells.where("depth is null").isEmpty():
            break
        left = kept(placed.where("depth is null").drop("cell", "depth"))
        if deep == BITS:
            done.append(_overflow(left, limit))
            break
        shallow, deep = deep + 1, min(BITS, deep + ROUND_BITS)
    out = reduce(DataFrame.unionByName, done)
    return out.select(
        id_col, "n_bytes", F.col("depth").cast("int").alias("depth"), F.expr(f"shiftright(hash, {BITS} - cast(depth as int))").alias("prefix"), "page"
    )


def _overflow(rows, limit):
    """Pages for rows that agree in every bit: numbered within stored partitions, then across them."""
    spots = kept(rows.withColumns({"at": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}))
    sizes = spots.groupBy("hash", "at").agg(F.count("*").alias("n"), F.max("n_bytes").alias("most"))
    every = Window.partitionBy("hash")
    starts = sizes.select(
        "hash", "at", (F.sum("n").over(every.orderBy("at")) - F.col("n")).alias("before"), F.max("most").over(every).alias("most")
    )
    local = F.row_number().over(Window.partitionBy("hash", "at").orderBy("nth")) - 1
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("most"), F.lit(1))))
    return (
        spots.withColumn("local", local)
        .join(starts, ["hash", "at"])
        .withColumn("page", F.floor((F.col("before") + F.col("local")) / per_page).cast("long"))
        .withColumn("depth", F.lit(BITS))
        .drop("at", "nth", "local", "before", "most")
    )
