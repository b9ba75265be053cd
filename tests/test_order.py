import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import credit
from riskmart.operators import ordering as O, profile as P, sampling as SM, selection as SEL

rng = random.Random(3)


@pytest.fixture(params=[None, (30, 16, 8, 0)], ids=["as is", "coarse"])
def few(request, monkeypatch):
    """With coarse sketches, bounds that often miss, and little gathered, small data takes many passes."""
    if request.param:
        for name, value in zip(("GATHER_ROWS", "SKETCH_SIZE", "GRID", "REACH"), request.param):
            monkeypatch.setattr(SEL, name, value)
    return request.param


@pytest.mark.parametrize("shape", ["distinct", "ties", "one value", "heavy", "negative"])
def test_quantiles_equal_numpy(spark, few, shape):
    n = 3000
    data = {
        "distinct": [rng.uniform(-1e6, 1e6) for _ in range(n)],
        "ties": [float(rng.randrange(7)) for _ in range(n)],
        "one value": [4.5] * n,
        "heavy": [1.0 if i % 3 == 0 else rng.random() * 2 for i in range(n)],
        "negative": [-float(i * i) for i in range(n)],
    }[shape]
    df = spark.createDataFrame([(v,) for v in data + [None, float("nan")]], "v double")
    ps = [0.0, 0.01, 1 / 3, 0.5, 2 / 3, 0.99, 1.0]
    got = SEL.exact_quantiles(df, {"v": "v", "w": F.col("v") * 2}, ps)
    assert got["v"] == pytest.approx(list(np.quantile(data, ps)), rel=1e-12)
    assert got["w"] == pytest.approx(list(np.quantile(data, ps) * 2), rel=1e-12)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert SEL.exact_quantiles(df, {"v": "v"}, [0.5]) == {"v": [None]}
    got = SEL.exact_quantiles(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (3.0,)], "v double"), {"v": "v"}, [0.99])
    assert got["v"] == pytest.approx([3.97])


def test_tuples_with_heavy_ties(spark, few):
    rows = [(1 if i % 3 == 0 else rng.randrange(4), rng.randrange(3), i) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int, c long")
    ranks = [0, 1, 666, 1000, 1999, 2000, 5000]
    ordered = sorted(rows)
    expected = [ordered[r] if r < 2000 else None for r in ranks]
    assert SEL.tuples_at(df, ["a", "b", "c"], lambda n: ranks) == expected


@pytest.mark.parametrize("kind", ["double", "long"])
def test_extreme_ranges_end(spark, kind):
    """Values that lie next to each other and very far from others."""
    near = [1.0, float(np.nextafter(1.0, 2)), float(np.nextafter(1.0, 0))] if kind == "double" else [2**62, 2**62 + 1, 2**62 + 2]
    data = near * 3 + ([-1.7e308, 1.7e308, 5e-324, 0.0, -0.0] if kind == "double" else [-(2**63), 2**63 - 1, 0])
    df = spark.createDataFrame([(v,) for v in data], f"v {kind}")
    ranks = list(range(len(data)))
    assert [t[0] for t in SEL.tuples_at(df, ["v"], lambda n: ranks)] == sorted(data)


@pytest.fixture
def passes(monkeypatch):
    """The names of the aggregates that searches run, in order."""
    names = []
    for name in ("_sketch", "_gather"):
        def watched(*args, run=getattr(SEL, name), name=name):
            names.append(name)
            return run(*args)
        monkeypatch.setattr(SEL, name, watched)
    return names


def test_many_quantiles_take_three_passes(spark, passes):
    df = spark.range(20_000).selectExpr(*[f"cast(hash(id, {i}) as double) as v{i}" for i in range(20)])
    got = SEL.exact_quantiles(df, {c: c for c in df.columns}, [0.5])
    want = np.median(df.toPandas().to_numpy(), axis=0)
    assert [got[c][0] for c in df.columns] == pytest.approx(list(want))
    assert passes == ["_sketch", "_sketch", "_gather"]


def test_few_rows_take_two_passes(spark, passes):
    df = spark.range(9000).selectExpr("cast(id % 5 as double) as a", "id % 7 as b", "id")
    rows = sorted((float(i % 5), i % 7, i) for i in range(9000))
    assert SEL.tuples_at(df, ["a", "b", "id"], lambda n: [5400, 6300, 7200]) == [rows[i] for i in (5400, 6300, 7200)]
    assert passes == ["_sketch", "_gather"]


def test_passes_of_many_rows(spark, passes):
    """2 million rows, a third of them one value: counts settle it, the tie goes to the next key."""
    df = spark.range(2_000_000).selectExpr("if(id % 3 = 0, 5, hash(id) % 1000) as a", "id")
    pdf = df.toPandas().sort_values(["a", "id"])
    ranks = [0, 700_000, 1_199_999, 1_999_999]
    assert SEL.tuples_at(df, ["a", "id"], lambda n: ranks) == [tuple(map(int, pdf.iloc[r])) for r in ranks]
    assert len(passes) <= 6


def test_infinite_values(spark, few):
    data = [float("inf"), float("-inf"), 1.0, 2.0, 3.0] * 20
    df = spark.createDataFrame([(v,) for v in data], "v double")
    assert [t[0] for t in SEL.tuples_at(df, ["v"], lambda n: range(100))] == sorted(data)


def test_summaries(spark):
    data = [(1.0, None), (2.0, None), (4.0, None), (None, None), (float("nan"), None)]
    got = SEL.summaries(spark.createDataFrame(data, "a double, b double"), ["a", "b"])
    a = got["a"]
    assert (a.rows, a.present, a.median) == (5, 3, 2.0)
    assert a.mean == pytest.approx(7 / 3) and a.variance == pytest.approx(np.var([1, 2, 4]))
    assert (got["b"].rows, got["b"].present, got["b"].median) == (5, 0, None)
    assert SEL.summaries(spark.createDataFrame([], "a double"), ["a"])["a"].rows == 0


def recency_rows(n=400):
    rows = []
    for i in range(n):
        rows.append({
            "SK_ID_CURR": i,
            "DAYS_ID_PUBLISH": None if i % 7 == 0 else -float(rng.randrange(5)),
            "DAYS_REGISTRATION": None if i % 11 == 0 else -float(rng.randrange(4)),
        })
    return rows


def expected_order(rows):
    pdf = pd.DataFrame(rows)
    for c in ("DAYS_ID_PUBLISH", "DAYS_REGISTRATION"):
        pdf[c] = pdf[c].abs().fillna(pdf[c].abs().median())
    return list(pdf.sort_values(["DAYS_ID_PUBLISH", "DAYS_REGISTRATION", "SK_ID_CURR"])["SK_ID_CURR"])


def test_recency_index_and_split(spark, few):
    rows = recency_rows()
    df = credit.frame(spark, rows[1] | {"SK_ID_CURR": 0, "DAYS_ID_PUBLISH": 0.0, "DAYS_REGISTRATION": 0.0}, rows)
    order = expected_order(rows)
    got = O.recency_index(df).orderBy("row_index").collect()
    assert [r["SK_ID_CURR"] for r in got] == order
    assert [r["row_index"] for r in got] == list(range(len(rows)))
    split = {r["SK_ID_CURR"]: r["split"] for r in O.ordered_split(df).collect()}
    n = len(rows)
    edges = [int(n * 0.6), int(n * 0.7), int(n * 0.8)]
    names = ["train"] * edges[0] + ["val_model"] * (edges[1] - edges[0])
    names += ["val_policy"] * (edges[2] - edges[1]) + ["test"] * (n - edges[2])
    assert [split[k] for k in order] == names


@pytest.mark.parametrize("n, sizes", [(307511, [184506, 30751, 30751, 61503]), (90, [54, 8, 10, 18])])
def test_split_sizes_are_truncated_products(n, sizes):
    a, b, c = O.split_starts(n)
    assert [a, b - a, c - b, n - c] == sizes


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10])
def test_tiny_splits(spark, n):
    df = spark.range(n).select(
        F.col("id").alias("SK_ID_CURR"), F.col("id").cast("double").alias("DAYS_ID_PUBLISH"),
        F.lit(None).cast("double").alias("DAYS_REGISTRATION"),
    )
    got = {r["split"]: r["n"] for r in P.split_sizes(O.ordered_split(df)).collect()}
    a, b, c = O.split_starts(n)
    wanted = {"train": a, "val_model": b - a, "val_policy": c - b, "test": n - c}
    assert got == {k: v for k, v in wanted.items() if v}


def test_split_assertions(spark):
    df = spark.range(1000).select(
        F.col("id").alias("SK_ID_CURR"), F.col("id").cast("double").alias("DAYS_ID_PUBLISH"),
        F.col("id").cast("double").alias("DAYS_REGISTRATION"),
    )
    split = O.ordered_split(df)
    P.assert_split_sizes(split, 1000)
    with pytest.raises(ValueError, match="of 1001 rows"):
        P.assert_split_sizes(split, 1001)
    with pytest.raises(ValueError, match="train holds"):
        P.assert_split_sizes(split.where("split <> 'test'"), 800)


def test_exact_sample_is_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    ids = lambda d: sorted(r[0] for r in d.collect())
    first = ids(SM.exact_sample(df, 700, "k"))
    assert len(first) == 700
    assert ids(SM.exact_sample(df.repartition(13), 700, "k")) == first
    assert ids(SM.exact_sample(df, 700, "k", seed=7)) != first
    assert set(first) < set(ids(SM.exact_sample(df, 900, "k")))
    assert len(ids(SM.exact_sample(df, 9000, "k"))) == 5000
    assert ids(SM.exact_sample(df, 0, "k")) == []


def test_held_out_counts():
    assert SM.held_out_counts({0: 100, 1: 100}, 0.2) == {0: 20, 1: 20}
    out = SM.held_out_counts({"a": 7, "b": 5, "c": 1}, 0.2)
    assert sum(out.values()) == 3 and out["a"] >= out["b"] >= out["c"]


def test_stratified_split(spark):
    df = spark.range(1003).selectExpr("id as k", "cast(id % 3 = 0 as int) as y")
    out = SM.stratified_split(df, "y", "k")
    got = {(r["y"], r["part"]): r["count"] for r in out.groupBy("y", "part").count().collect()}
    assert got[0, "val"] + got[1, "val"] == 201
    assert got[1, "val"] in (67, 68) and sum(got.values()) == 1003
    again = SM.stratified_split(df.repartition(5), "y", "k")
    assert out.exceptAll(again).count() == 0


def test_adversarial_set(spark):
    train = spark.range(300).selectExpr("id as SK_ID_CURR", "id * 2 as only_train", "'x' as both")
    test = spark.range(100).selectExpr("id as SK_ID_CURR", "'y' as both", "id as only_test")
    out = SM.adversarial_set(train, test)
    sizes = {(r["ADV_LABEL"], r["part"]): r["count"] for r in out.groupBy("ADV_LABEL", "part").count().collect()}
    assert sizes == {(0, "train"): 80, (0, "val"): 20, (1, "train"): 80, (1, "val"): 20}
    assert out.where("ADV_LABEL = 0 and only_test is not null").count() == 0
    assert out.where("ADV_LABEL = 1 and only_train is not null").count() == 0
    P.assert_balanced(out.where("part = 'val'"), "ADV_LABEL")
    with pytest.raises(ValueError, match="not balanced"):
        P.assert_balanced(out.where("ADV_LABEL = 1"), "ADV_LABEL")


def test_running_sums(spark):
    data = [(float(i * 7 % 501), i % 5) for i in range(501)]
    df = spark.createDataFrame(data, "s double, n long")
    out, totals = O.running_sums(df, "s", ("n",), partitions=9)
    assert totals == {"n": sum(n for _, n in data)}
    for r in out.collect():
        assert r["n_above"] == sum(n for s, n in data if s > r["s"])


def test_split_of_many_and_missing_labels(spark):
    df = spark.range(6000).selectExpr("id", "if(id % 3 = 0, null, concat('l', id % 2000)) as label")
    out = SM.stratified_split(df, "label", "id")
    sizes = {r["label"]: (r["n"], r["held"]) for r in out.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "val").alias("held")).collect()}
    assert sum(h for _, h in sizes.values()) == 1200 and sizes[None] == (2000, 400) and len(sizes) > 1300
    assert out.columns == ["id", "label", "part"]


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 3.0, None), (1.0, 5.0, "a")], "c double, v double, t string")
    cells = {(r["a"], r["b"]): r["corr"] for r in P.correlations(df, ["c", "v"]).collect()}
    assert cells == {("c", "c"): None, ("c", "v"): None, ("v", "c"): None, ("v", "v"): 1.0}
    assert [tuple(r) for r in P.value_counts(df, "t").collect()] == [("a", 2, 1.0)]


def test_correlations_equal_numpy_in_one_pass(spark):
    """Rows with a missing value or NaN are left out, and every row is computed once."""
    rows = [[rng.gauss(1e6, 1), rng.random(), float(i % 3)] for i in range(400)]
    rows = [(*r, r[0] - 2 * r[1] + rng.random()) for r in rows]
    odd = [(None, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0)]
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows + odd, "a double, b double, c double, d double").repartition(20)
    found = {(r["a"], r["b"]): r["corr"] for r in P.correlations(df.mapInArrow(passed, df.schema), ["a", "b", "c", "d"]).collect()}
    wanted = np.corrcoef(np.array(rows).T)
    assert seen.value == len(rows) + len(odd)
    assert all(abs(found["abcd"[i], "abcd"[j]] - wanted[i, j]) < 1e-9 for i in range(4) for j in range(4))


def test_correlations_of_few_and_infinite_rows(spark):
    def found(rows):
        return {(r["a"], r["b"]): r["corr"] for r in P.correlations(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}

    nothing = {(x, y): None for x in "ab" for y in "ab"}
    assert found([]) == nothing and found([(1.0, 2.0)]) == nothing and found([(1.0, None), (2.0, 1.0)]) == nothing
    cells = found([(1.0, 1.0), (2.0, float("inf")), (4.0, 3.0)])
    assert cells["a", "a"] == cells["b", "b"] == 1.0 and np.isnan(cells["a", "b"])
