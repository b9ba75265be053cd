"""Pooling of rare categories."""

from pyspark.sql import DataFrame, functions as F

from riskmart import schema as S
from riskmart.lineage import materialize
from riskmart.operators.keys import HOT_SHARE, join_many_to_one, salt_count

BROADCAST_BYTES = 8 << 20      # values up to this size travel to the rows

def pool_rare(df, column, min_count=S.RARE_MIN_COUNT, output=None, other="OTHER", kept=None) -> DataFrame:
    """Values below `min_count` rows become `other`, as text; missing counts as a value.

    `kept` gives the values instead.
    """
    if kept is not None:
        return df.withColumn(output or column, _keep(F.col(column).cast("string"), kept, F.lit(other)))
    return pool_rare_columns(df, {column: output or column}, min_count, other)


def pool_rare_columns(df, outputs: dict, min_count=S.RARE_MIN_COUNT, other="OTHER") -> DataFrame:
    """`pool_rare` for several columns (column to output), whose values are counted in one scan.

    Rows find out by a join whether their value stays: with a broadcast copy of the values that
    stay if their bytes are few, otherwise shuffled, with values of very many rows over salts.
    """
    columns = list(outputs)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    counts = materialize(df.select(F.inline(cells)).groupBy("i", "v").agg(F.count("*").alias("n")))
    # a missing value is a value; no other text starts with the mark
    marked = lambda v: F.coalesce(F.concat(F.lit("="), v), F.lit(""))
    stays = counts.where(F.col("n") >= min_count).select("i", marked(F.col("v")).alias("__value"), "n", F.lit(True).alias("__stays"))
    about = stays.agg(F.coalesce(F.sum(F.octet_length("__value") + 16), F.lit(0)).alias("bytes")).first()
    rows = counts.where("i = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = rows / (HOT_SHARE * salt_count(df))
    out = df
    for i, c in enumerate(columns):
        value = F.col(c).cast("string")
        mine = stays.where(F.col("i") == i)
        keyed, known = out.withColumn("__value", marked(value)), mine.select("__value", "__stays")
        if about["bytes"] <= BROADCAST_BYTES:
            joined = keyed.join(F.broadcast(known), "__value", "left")
        else:
            # fewer than HOT_SHARE times the partitions; values that go meet no row, spread or not
            hot = [r["__value"] for r in counts.where((F.col("i") == i) & (F.col("n") > least)).select(marked(F.col("v")).alias("__value")).collect()]
            joined = join_many_to_one(keyed, known, "__value", "left", hot=hot)
        pooled = F.when(F.col("__stays"), value).otherwise(F.lit(other))
        out = joined.withColumn("__pooled", pooled).drop("__value", "__stays")
        # the output may be the column itself
        out = out.withColumn(outputs[c], F.col("__pooled")).drop("__pooled")
    return out


def _keep(value, kept, otherwise):
    present = [v for v in kept if v is not None]
    cond = F.coalesce(value.isin(present), F.lit(False)) if present else F.lit(False)
    if len(present) < len(kept):
        cond = cond | value.isNull()
    return F.when(cond, value).otherwise(otherwise)


def category_counts(df, columns, fill="MISSING") -> DataFrame:
    """(column, value, n) over several columns in one scan, missing filled first."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias("value"),
            )
            for c in columns
        ]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .groupBy("p.column", "p.value")
        .agg(F.count("*").alias("n"))
    )


def rare_map(df, columns, min_count=S.RARE_MIN_COUNT, fill="MISSING") -> DataFrame:
    """(column, value, n) of the values frequent enough to be kept."""
    return category_counts(df, columns, fill).where(F.col("n") >= min_count)


def fit_rare_map(df, columns, min_count=S.RARE_MIN_COUNT, fill="MISSING"):
    """Kept values per column, and the columns in which anything was pooled."""
    if not columns:
        return {}, []
    pooled = F.when(F.col("n") >= min_count, F.col("value")).alias("value")
    rows = category_counts(df, columns, fill).groupBy("column", pooled).count().collect()      # a row per dummy
    kept = {c: sorted(r["value"] for r in rows if r["column"] == c and r["value"] is not None) for c in columns}
    with_rare = [c for c in columns if any(r["column"] == c and r["value"] is None for r in rows)]
    return kept, with_rare


def apply_rare_map(df, kept: dict, fill="MISSING", other="OTHER") -> DataFrame:
    """Pools by fitted values; a value unseen at fit becomes `other`."""
    out = {}
    for c, values in kept.items():
        if c in df.columns:
            filled = F.coalesce(F.col(c).cast("string"), F.lit(fill))
            known = filled.isin(list(values)) if values else F.lit(False)
            out[c] = F.when(known, filled).otherwise(F.lit(other))
    return df.withColumns(out) if out else df
