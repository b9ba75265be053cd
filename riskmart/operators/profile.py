"""Profile tables and the data-quality report."""

from contextlib import contextmanager
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskmart.operators import selection
from riskmart.operators.ordering import bucket_of

METHOD_BYTES = 8000         # of code up to which the JVM compiles a method
LEAST_VARIANCE = 1e-12      # a variance up to this counts as rounding, as in MLlib
MOMENTS = ["n", "low", "high", "mean", "products"]


def _long(one_row, columns, name, value) -> DataFrame:
    """One row of many columns as (name, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])
    return one_row.select(F.inline(pairs))


def value_counts(df, column, shares=True) -> DataFrame:
    """(value, n, share) of the present values, from one scan."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if not shares:
        return out
    total = out.agg(F.lit(1).alias("__one"), F.sum("n").alias("__total"))                           # one row
    shared = out.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")
    return shared.select(column, "n", (F.col("n") / F.col("__total")).alias("share"))


def missing_rates(df, columns=None) -> DataFrame:
    """(column, rate) of every column, one scan."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return _long(row, columns, "column", "rate")


def top_missing(df, limit=40, columns=None) -> DataFrame:
    """Columns with missing values, highest rate first."""
    rates = missing_rates(df, columns).where(F.col("rate") > 0)
    return rates.orderBy(F.desc("rate"), "column").limit(limit)


@contextmanager
def _compiled(spark):
    """Plans made inside give no method that is too long for the JVM to compile.

    A projection of very many columns becomes one method of more than 8,000 bytes of code, which
    the JVM interprets; beyond the limit Spark splits it.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, METHOD_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _moments(x):
    """(n, low, high, mean, products) of the rows of a matrix; products of the differences from the mean."""
    mean = x.mean(axis=0)
    apart = x - mean
    return len(x), x.min(axis=0), x.max(axis=0), mean, apart.T @ apart


def _joined(one, two):
    """The moments of the rows of both."""
    if one is None:
        return two
    n = one[0] + two[0]
    delta = two[3] - one[3]
    products = one[4] + two[4] + np.outer(delta, delta) * (one[0] * two[0] / n)
    return n, np.minimum(one[1], two[1]), np.maximum(one[2], two[2]), one[3] + delta * (two[0] / n), products


def _packed(moments):
    """A batch of one row, or of none."""
    rows = [[moments[0]], *[[m.tobytes()] for m in moments[1:]]] if moments else [[]] * 5
    kinds = [pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=MOMENTS)


def _unpacked(n, *arrays):
    low, high, mean, products = (np.frombuffer(a) for a in arrays)
    return n, low, high, mean, products.reshape(len(mean), -1)


def _moments_of(batches):
    """The moments of a task's rows in which all columns are present."""
    found = None
    with np.errstate(invalid="ignore", over="ignore"):
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = x[~np.isnan(x).any(axis=1)]
            found = _joined(found, _moments(x)) if len(x) else found
    yield _packed(found)


def _merged(batches):
    """The moments of several tasks as one."""
    found = None
    with np.errstate(invalid="ignore", over="ignore"):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                found = _joined(found, _unpacked(*row))
    yield _packed(found)


def correlations(df, columns) -> DataFrame:
    """Pearson correlation of every pair, over rows where all columns are present.

    Missing where a column of the pair is constant, also with itself. One pass: a task sums the
    products of its rows around their mean as one matrix, for any number of columns, and the
    matrices of all tasks are merged by a few; the driver receives one from each of these.
    """
    spark = df.sparkSession
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    kinds = ", ".join(f"{c} {'long' if c == 'n' else 'binary'}" for c in MOMENTS)
    mergers = ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5)
    found = None
    with _compiled(spark), np.errstate(invalid="ignore", over="ignore"):
        for row in values.mapInArrow(_moments_of, kinds).repartition(mergers).mapInArrow(_merged, kinds).collect():   # one per merger
            found = _joined(found, _unpacked(*row))
        several = found is not None and found[0] > 1
        varies = [several and bool(found[1][i] < found[2][i]) for i in range(len(columns))]
        if several:
            covariance = found[4] / (found[0] - 1)
            variance = np.diag(covariance)
            spread = np.sqrt(np.where(variance > LEAST_VARIANCE, variance, np.nan))
            matrix = covariance / np.outer(spread, spread)
    rows = [
        (a, b, (1.0 if i == j else float(matrix[i, j])) if varies[i] and varies[j] else None)
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    kinds = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("corr", T.DoubleType())])
    return selection.small_table(spark, rows, kinds)


def histogram(df, column, bins=50, clip_upper=None) -> DataFrame:
    """(bin, low, high, n) of equal-width bins over the present values.

    Bins are half-open, the last one closed. Bins without rows are listed with 0.
    """
    value = F.col(column).cast("double")
    if clip_upper is not None:
        value = F.when(value > F.lit(float(clip_upper)), F.lit(float(clip_upper))).otherwise(value)
    present = df.select(value.alias("__x")).where(F.col("__x").isNotNull())
    low, high = present.agg(F.min("__x"), F.max("__x")).first()
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    edges = [low + i * step for i in range(bins)] + [high]
    counts = (
        bucket_of(present, "__x", edges[1:-1], "bin").groupBy("bin").agg(F.count("*").alias("n"))
    )
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    cells = [
        F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("low"), F.lit(edges[i + 1]).alias("high"))
        for i in range(bins)
    ]
    return found.select("m", F.inline(F.array(*cells))).select(
        "bin", "low", "high", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("n")
    )


def quantiles(df, columns, probabilities) -> DataFrame:
    """(column, p, value) with exact, linearly interpolated quantiles."""
    found = selection.exact_quantiles(df, {c: c for c in columns}, probabilities)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.lit(float(p)).alias("p"), F.lit(v).cast("double").alias("value")
        )
        for c in columns
        for p, v in zip(probabilities, found[c])
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*cells)))


def split_sizes(df, split="split") -> DataFrame:
    """Rows per split and their share of all rows."""
    return value_counts(df, split)


def assert_split_sizes(df, rows, first="train", low=0.599, high=0.601, split="split") -> None:
    """Splits add up to the whole, and the first has its share of it."""
    sizes = {r[split]: r["n"] for r in split_sizes(df, split).collect()}    # one row per split
    if sum(sizes.values()) != rows:
        raise ValueError(f"splits hold {sum(sizes.values())} of {rows} rows")
    if not low <= sizes.get(first, 0) / rows <= high:
        raise ValueError(f"{first} holds {sizes.get(first, 0)} of {rows} rows")


def assert_balanced(df, label, tolerance=0.05) -> None:
    """Two labels, each within the tolerance of one half."""
    shares = {r[label]: r["share"] for r in value_counts(df, label).limit(3).collect()}
    if len(shares) != 2 or any(abs(s - 0.5) >= tolerance for s in shares.values()):
        raise ValueError(f"{label} is not balanced: {shares}")


def quality_report(app, split, dataset, target, flag, flag_name, cap, train="train") -> DataFrame:
    """One row: shape, default rate, class counts, sentinels, missing rates, cap, split sizes.

    `app` carries a split column. Two aggregates over it, one of them by split and
    class, meet as one row.
    """
    columns = [c for c in app.columns if c != split]
    in_train = F.col(split) == train
    one = app.agg(
        F.count("*").alias("total_rows"),
        F.sum(F.col(flag).cast("long")).alias("sentinels"),
        F.round(F.avg(F.when(in_train, F.col(target))), 4).alias("target_default_rate"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)],
    )
    cells = [F.struct(F.lit(c).alias("k"), F.col(f"m_{i}").alias("v")) for i, c in enumerate(columns)]
    rates = F.transform(
        F.filter(F.array(*cells), lambda e: e["v"] > 0),
        lambda e: F.struct(e["k"].alias("k"), F.round(e["v"], 4).alias("v")),
    )
    by_class = app.groupBy(split, F.col(target).cast("string").alias("k")).agg(F.count("*").alias("n"))
    by_split = by_class.groupBy(split).agg(
        F.sum("n").alias("n"),
        F.collect_list(F.when(in_train & F.col("k").isNotNull(), F.struct("k", "n"))).alias("classes"),
    )
    counts = by_split.agg(
        F.map_from_entries(F.flatten(F.collect_list("classes"))).alias("class_counts"),
        F.map_from_entries(F.collect_list(F.struct(split, "n"))).alias("split_sizes"),
    )
    report = one.select(
        F.lit(1).alias("__one"),
        F.lit(dataset).alias("dataset"),
        "total_rows",
        F.lit(len(columns)).alias("total_cols"),
        "target_default_rate",
        F.create_map(F.lit(flag_name), F.col("sentinels")).alias("sentinel_counts"),
        F.map_from_entries(rates).alias("missing_rates"),
        F.lit(None if cap is None else round(cap, 2)).cast("double").alias("income_cap_p99"),
    )
    return report.join(counts.withColumn("__one", F.lit(1)), "__one").drop("__one")
