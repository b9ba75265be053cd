"""Categories as positions in a sparse vector, for any number of values.

The dictionary is a table (column, value, index, n). Rows find their index by a join: over a
broadcast copy if its size in bytes is proven small, otherwise shuffled, with values that hold
very many rows spread over salts. Columns are told apart by their place, never by the name of
a value, so values that differ only in case stay two.
"""

import json
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.operators import features, ordering
from riskmart.operators.categories import BROADCAST_BYTES, category_counts
from riskmart.operators.keys import HOT_SHARE, join_many_to_one, salt_count


def fit_dictionary(df, columns, min_count=S.RARE_MIN_COUNT, fill="MISSING", other="OTHER") -> DataFrame:
    """(column, value, index, n), stored: kept values, and `other` where any were pooled.

    Missing values count as `fill`. Indexes run over all columns in order, values sorted within
    each; they come from range partitions, so no column has to fit into one task.
    """
    kept = F.when(F.col("n") >= min_count, F.col("value")).otherwise(F.lit(other)).alias("value")
    entries = category_counts(df, columns, fill).groupBy("column", kept).agg(F.sum("n").alias("n"))
    place = F.array_position(F.lit(list(columns)), F.col("column"))
    return ordering.global_index(entries, [place, F.col("value")], column="index").select("column", "value", "index", "n")


def column_spans(dictionary, columns) -> dict:
    """(first index, number of values) per column; one row per column comes back."""
    found = dictionary.groupBy("column").agg(F.min("index").alias("first"), F.count("*").alias("size"))
    spans = {r["column"]: (r["first"], r["size"]) for r in found.collect()}
    return {c: spans.get(c, (0, 0)) for c in columns}


def encode(df, dictionary, columns, fill="MISSING", other="OTHER", suffix="_INDEX") -> DataFrame:
    """Adds the index of each column's value; an unseen value has that of `other`, or none without one."""
    size = dictionary.agg(
        F.coalesce(F.sum(F.octet_length("value") + 24), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    ).first()
    others = {r["column"]: r["index"] for r in dictionary.where(F.col("value") == other).collect()}      # one per column
    least = size["n"] / max(len(columns), 1) / (HOT_SHARE * salt_count(df))
    out = df
    for c in columns:
        entries = dictionary.where(F.col("column") == c)
        found = entries.select(F.col("value").alias("__value"), F.col("index").alias(c + suffix))
        keyed = out.withColumn("__value", F.coalesce(F.col(X.quoted(c)).cast("string"), F.lit(fill)))
        if size["bytes"] <= BROADCAST_BYTES:
            out = keyed.join(F.broadcast(found), "__value", "left")
        else:
            # fewer than HOT_SHARE times the partitions
            hot = [r["value"] for r in entries.where(F.col("n") > least).select("value").collect()]
            out = join_many_to_one(keyed, found, "__value", "left", hot=hot)
        out = out.drop("__value").withColumn(c + suffix, F.coalesce(c + suffix, F.lit(others.get(c)).cast("long")))
    return out


def sparse_vectors(df, dense, indexes: dict, output="features") -> DataFrame:
    """A vector of the `dense` columns (missing ones NaN) and one place per dictionary entry.

    `indexes` maps index columns to their (first index, number of values). A row without an
    index has no 1 among the places of that column.
    """
    names, places = [f"__d{i}" for i in range(len(dense))], [f"__i{i}" for i in range(len(indexes))]
    out = df.withColumns({n: F.coalesce(F.col(X.quoted(c)).cast("double"), F.lit(float("nan"))) for n, c in zip(names, dense)})
    for place, (c, (first, size)) in zip(places, indexes.items()):
        at = F.coalesce(F.col(X.quoted(c)) - first, F.lit(size)).cast("double")
        # the number of values as metadata, so that the encoder has nothing to look for
        out = out.withColumn(place, at.alias(place, metadata={"ml_attr": {"type": "nominal", "num_vals": max(size, 1)}}))
    dots = [f"__o{i}" for i in range(len(places))]
    if places:
        # an extra place for rows without an index, which is the last one and is left out
        out = OneHotEncoder(inputCols=places, outputCols=dots, dropLast=True, handleInvalid="keep").fit(out).transform(out)
    whole = VectorAssembler(inputCols=[*names, *dots], outputCol=output, handleInvalid="keep").transform(out)
    return whole.drop(*names, *places, *dots)


@dataclass
class SparseBuilder:
    """A fitted builder whose categories are a table; its features are one sparse vector.

    Numeric columns come first, then the missing flags, then the dictionary's entries.
    """

    numeric: list
    categorical: list
    flags: list
    imputers: dict
    scales: dict
    fill: str
    other: str
    dictionary: DataFrame

    @classmethod
    def fit(cls, df, numeric, categorical, min_count=S.RARE_MIN_COUNT, rate=S.MISSING_FLAG_RATE, fill="MISSING", other="OTHER"):
        flags, imputers, scales = features.fit_numeric(df, numeric, rate)
        dictionary = fit_dictionary(df, categorical, min_count, fill, other)
        return cls(list(numeric), list(categorical), flags, imputers, scales, fill, other, dictionary)

    def transform(self, df, for_linear=False, output="features") -> DataFrame:
        """The rows with their index columns and the vector; numeric columns are filled and scaled for linear models."""
        flagged = features.apply_missing_flags(df, self.flags)
        if for_linear:
            flagged = features.apply_scaler(features.apply_fill(flagged, self.imputers), self.scales)
        out = encode(flagged, self.dictionary, self.categorical, self.fill, self.other)
        spans = column_spans(self.dictionary, self.categorical)
        dense = [*self.numeric, *[c + features.FLAG_SUFFIX for c in self.flags]]
        return sparse_vectors(out, dense, {f"{c}_INDEX": spans[c] for c in self.categorical}, output)

    def save(self, path) -> None:
        """The dictionary as Parquet, the rest as one row of JSON."""
        spark = self.dictionary.sparkSession
        rest = {k: v for k, v in vars(self).items() if k != "dictionary"}
        spark.range(1).select(F.lit(json.dumps(rest)).alias("value")).write.mode("overwrite").text(f"{path}/fitted")
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")

    @classmethod
    def load(cls, spark, path):
        rest = json.loads(spark.read.text(f"{path}/fitted").first()["value"])
        return cls(**rest, dictionary=spark.read.parquet(f"{path}/dictionary"))
