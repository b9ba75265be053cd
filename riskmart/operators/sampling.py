"""Repeatable samples and splits of exact size, ordered by a hash of the key."""

from math import ceil

from pyspark.sql import DataFrame, functions as F

from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.lineage import materialize
from riskmart.operators import selection

SEED = 42


def hash_order(key, seed=SEED) -> list:
    """Sort keys of a repeatable shuffle: 60 bits of MD5 over seed and key, then the key.

    Depends on the key alone, not on partitioning, and any engine can recompute it.
    """
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    digits = F.substring(F.md5(text), 1, 15)
    return [F.conv(digits, 16, 10).cast("long"), F.col(key)]


def exact_sample(df, n, key=S.KEY, seed=SEED) -> DataFrame:
    """Exactly n rows (all, if there are fewer): those first in hash order."""
    order = hash_order(key, seed)
    (cut,) = selection.tuples_at(df, order, lambda rows: [n])
    return df if cut is None else df.where(X.precedes(order, cut))


def balanced_sample(a, b, key_a=S.KEY, key_b=S.KEY, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """Both frames cut to the size of the smaller one."""
    n = min(a.count(), b.count())
    return exact_sample(a, n, key_a, seed), exact_sample(b, n, key_b, seed)


def held_out_counts(counts: dict, fraction) -> dict:
    """Rows held out per label: ceil of the total, shared out by largest remainder."""
    rows = sum(counts.values())
    total = ceil(rows * fraction)
    exact = {v: n * total / rows for v, n in counts.items()} if rows else {}
    out = {v: int(x) for v, x in exact.items()}
    by_remainder = sorted(exact, key=lambda v: (out[v] - exact[v], str(v)))
    for v in by_remainder[: total - sum(out.values())]:
        out[v] += 1
    return out


def stratified_split(
    df, label, key=S.KEY, fraction=0.20, seed=SEED, names=("train", "val"), column="part"
) -> DataFrame:
    """Marks the held-out fraction of each label; sizes are exact, membership is by hash.

    A missing label is a label. Hashes are computed once and stored; each label's share and
    cut come in by a join on the label, so any number of labels is one plan.
    """
    order = hash_order(key, seed)
    keyed = materialize(df.withColumns({"__label": selection.group_name(label), "__h": order[0]}))
    counts = {r["__label"]: r["n"] for r in keyed.groupBy("__label").agg(F.count("*").alias("n")).collect()}  # one row per label
    held = held_out_counts(counts, fraction)
    cuts = selection.group_tuples_at(
        keyed, "__label", ["__h", key], {f"={v}": n for v, n in held.items() if 0 < n < counts[v]}
    )
    kind = df.schema[key].dataType.simpleString()
    rows = [(v, n == counts[v] and n > 0, *(cuts.get(f"={v}") or (None, None))) for v, n in held.items()]
    table = df.sparkSession.createDataFrame(rows, f"__label string, __all boolean, __cut long, __cut_key {kind}")
    before = (F.col("__h") < F.col("__cut")) | ((F.col("__h") == F.col("__cut")) & (F.col(key) < F.col("__cut_key")))
    in_held = F.col("__all") | F.coalesce(before, F.lit(False))
    out = keyed.join(table, "__label").withColumn(column, F.when(in_held, F.lit(names[1])).otherwise(F.lit(names[0])))
    return out.select(*df.columns, column)


def adversarial_set(
    train, test, key=S.KEY, test_key=None, label="ADV_LABEL", fraction=0.20, seed=SEED
) -> DataFrame:
    """Which population does a row come from: balanced union, label 0/1, split column `part`.

    Columns only one side has are NULL on the other.
    """
    test_key = test_key or key
    if test_key != key:
        test = test.withColumnRenamed(test_key, key)
    a, b = balanced_sample(train, test, key, key, seed)
    both = a.withColumn(label, F.lit(0)).unionByName(
        b.withColumn(label, F.lit(1)), allowMissingColumns=True
    )
    return stratified_split(both, label, key, fraction, seed)
