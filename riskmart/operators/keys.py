"""Key checks and joins along keys."""

from pyspark.sql import DataFrame, functions as F

from riskmart import schema as S

HOT_SHARE = 4            # a key is frequent beyond 1 / (HOT_SHARE * partitions) of the rows


def surplus_rows(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows repeat a key already seen (a NULL key is a key)."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def assert_unique_key(df: DataFrame, key: str, name: str) -> None:
    surplus = surplus_rows(df, key).first()["surplus"]
    if surplus > 0:
        raise ValueError(f"{name} is not unique on {key}: {surplus} duplicate keys")


def left_one_to_one(base, features, key=S.KEY, name="features", validate=True) -> DataFrame:
    """Left join of two frames that are both unique on the key.

    `validate` costs one key-only aggregate per side. A frame that came out of
    `groupBy(key)` is unique by construction and can skip it.
    """
    if validate:
        assert_unique_key(base, key, "base")
        assert_unique_key(features, key, name)
    return base.join(features, key, "left")


def parent_keys(parents, link=S.LINK_KEY, key=S.KEY, validate=True) -> DataFrame:
    """(link, key) pairs, one row per link.

    De-duplication and the many-to-one check share one aggregate: a link that
    leads to two keys fails the job while it runs, without a scan of its own.
    The result is partitioned by the link, so a join on it adds no exchange.
    """
    # one flag, so that the optimizer has no reason to spell the error out more than once
    two_keys = F.coalesce(
        (F.min(key) != F.max(key)) | ((F.count(key) > 0) & (F.count(key) < F.count("*"))), F.lit(False)
    )
    pairs = parents.where(F.col(link).isNotNull()).groupBy(link).agg(F.min(key).alias(key), two_keys.alias("__two"))
    if not validate:
        return pairs.select(link, key)
    # a filter, as a column that nobody reads would be pruned and the check with it
    message = F.concat(F.lit(f"{link} is not unique among parents: "), F.col(link).cast("string"))
    unique = F.when(F.col("__two"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return pairs.where(unique).select(link, key)


def frequent_values(df, column, parts=None) -> list:
    """All values that hold more than 1 / (HOT_SHARE * parts) of the rows, the most frequent first.

    `parts` is the number of shuffle partitions by default. One aggregate without a shuffle by
    value: a frequent-items summary per task, which merge. With eight counters for each value
    there can be, a count is off by less than half the share, so no such value is missed; a
    few values just below the share may be listed too.
    """
    most = HOT_SHARE * (parts or salt_count(df))
    tracked = min(8 * most, 1_000_000)
    present = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    found = present.agg(F.expr(f"approx_top_k(v, {2 * most}, {tracked})").alias("top"), F.count("*").alias("rows")).first()
    hot = [(r["count"], r["item"]) for r in found["top"] or [] if r["count"] > found["rows"] / most]
    return [v for _, v in sorted(hot, key=lambda r: (-r[0], r[1]))]


def salt_count(df) -> int:
    """Salts a hot key is spread over: as many as there are shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_many_to_one(child, parent, on, how="inner", hot=(), salts=None) -> DataFrame:
    """Join a child table to a parent that is unique on the key.

    Rows of hot keys carry a salt and meet a copy of their parent row per salt;
    other keys stay on salt 0. No key needs to fit into one task.
    """
    if not hot:
        return child.join(parent, on, how)
    salts = salts or salt_count(child)
    is_hot = F.col(on).isin(list(hot))
    # by place, as equal rows of one key have to part as well
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    salted = child.withColumn("__salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    copies = parent.withColumn(
        "__salt",
        F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return salted.join(copies, [on, "__salt"], how).drop("__salt")


def many_to_one_inner(
    child, parents, link=S.LINK_KEY, key=S.KEY, name="child", validate=True, hot=None
) -> DataFrame:
    """Child rows with the key of their parent; children without a parent drop out.

    A key column the child already carries has to agree with the parent's on every
    row, and the parent's is kept. `hot=()` skips the look for skewed links.
    """
    pairs = parent_keys(parents, link, key, validate)
    if hot is None:
        hot = frequent_values(child, link)
    carries = key in child.columns
    if carries:
        child = child.withColumnRenamed(key, "__child_key")
    joined = join_many_to_one(child.where(F.col(link).isNotNull()), pairs, link, hot=hot)
    if carries:
        if validate:
            joined = joined.where(keys_agree("__child_key", key, name))
        joined = joined.drop("__child_key")
    return joined


def keys_agree(carried, key, name):
    """A condition that fails the job where the carried key differs from the parent's."""
    message = f"{name} rows carry a {key} that differs from their parent's"
    differs = ~F.col(carried).eqNullSafe(F.col(key))
    return F.when(differs, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def key_conflicts(child, parents, link=S.LINK_KEY, key=S.KEY) -> DataFrame:
    """One row: joined child rows, and those whose carried key differs from the parent's.

    Children are counted per (link, key) first, so a link with very many children
    is one row by the time it is joined.
    """
    counts = (
        child.where(F.col(link).isNotNull())
        .groupBy(link, F.col(key).alias("__child_key"))
        .agg(F.count("*").alias("__n"))
    )
    joined = counts.join(parent_keys(parents, link, key), link)
    differs = ~F.col("__child_key").eqNullSafe(F.col(key))
    return joined.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(differs, F.col("__n"))), F.lit(0)).alias("n_conflicts"),
    )


def prefix_columns(df, prefix, key=S.KEY) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}".upper() for c in df.columns if c != key})


def align_columns(df, expected: dict) -> DataFrame:
    """Exactly the expected columns in order: absent ones are NULL, others go."""
    return df.select(
        [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in expected.items()]
    )
