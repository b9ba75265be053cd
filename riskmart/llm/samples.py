"""Bounded samples of labelled rows for fitting models on the driver."""

import math

from pyspark.sql import DataFrame, Window, functions as F

from riskmart.llm.storing import kept


def per_class(labelled: DataFrame, id_col: str, label_col: str, limit: int) -> DataFrame:
    """At most `limit` ids of each class, those with the smallest hashes, and the class weights.

    Columns: id, label, weight (rows of the class that one sampled row stands for). A null
    id or label takes no part; a repeated id is one id. The classes have to be few. Hashes
    spread evenly, so those below a cut that leaves a little more than `limit` ids of a class
    hold its smallest; only these few are ranked, however large the class is.
    """
    clean = labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label")
    )
    counted = kept(clean.groupBy("label", "id").agg(F.count("*").alias("n")))
    sizes = counted.groupBy("label").agg(F.sum("n").alias("size"), F.count("*").alias("ids"))
    # seven deviations above the limit; the whole range for a small class
    share = F.least(F.lit(1.0), F.lit(limit + 7 * math.sqrt(limit) + 50) / F.col("ids"))
    cut = (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).alias("cut")
    near = counted.withColumn("h", F.xxhash64("id")).join(F.broadcast(sizes.withColumn("cut", cut)), "label").where("double(h) <= cut")
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("h", "id")))
    return kept(ranked.where(F.col("place") <= limit).select(
        "id", "label", (F.col("size") / F.least("ids", F.lit(limit))).alias("weight")
    ))


def with_sample(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, label, weight, id) of a sample: one row per sampled id, that with its smallest text.

    The sample is bounded, so it is broadcast.
    """
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    return met.groupBy("id", "label").agg(F.min("text").alias("text"), F.first("weight").alias("weight"))
