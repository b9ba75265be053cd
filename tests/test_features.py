import statistics

import pytest
from pyspark.sql import functions as F

import credit
from riskmart import schema as S
from riskmart.operators import categories as C, features as FE
from riskmart.sources.tables import load_or_fit_builder


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


# -- categories --------------------------------------------------------------

def letters(spark, counts):
    rows = [(v,) for v, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "s string")


def test_pool_rare(spark):
    df = letters(spark, {"A": 600, "B": 600, "C": 10})
    got = {r[0]: r[1] for r in C.pool_rare(df, "s", 500).groupBy("s").count().collect()}
    assert got == {"A": 600, "B": 600, "OTHER": 10}


def test_pool_rare_missing_is_a_value(spark):
    got = lambda d: {r[0]: r[1] for r in C.pool_rare(d, "s", 50).groupBy("s").count().collect()}
    assert got(letters(spark, {"A": 60, None: 55})) == {"A": 60, None: 55}
    assert got(letters(spark, {"A": 60, None: 5})) == {"A": 60, "OTHER": 5}


@pytest.mark.parametrize("missing", [3, 40])
def test_pool_rare_beyond_literals(spark, monkeypatch, missing):
    counts = {f"v{i}": 2 + i % 9 for i in range(60)} | {"hot": 400, None: missing}
    df = letters(spark, counts)
    keep = {v for v, n in counts.items() if n >= 5}
    plain = sorted(str(v if v in keep else "OTHER") for v, n in counts.items() for _ in range(n))
    for share, size in ((4, 1 << 20), (0.1, -1), (4, -1), (100, -1)):      # broadcast; shuffled: no value is frequent, some are, all are
        monkeypatch.setattr(C, "HOT_SHARE", share)
        monkeypatch.setattr(C, "BROADCAST_BYTES", size)
        joined = C.pool_rare(df, "s", 5)
        assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.columns == df.columns and sorted(map(str, column(joined, "s"))) == plain


def test_pool_rare_of_numbers_and_maps(spark):
    df = spark.range(60).selectExpr("cast(if(id < 50, 1, id) as int) as n", "map('k', id) as m")
    got = {r[0]: r[1] for r in C.pool_rare(df, "n", 10).groupBy("n").count().collect()}
    assert got == {"1": 50, "OTHER": 10}


def test_pool_rare_with_given_values(spark):
    df = letters(spark, {"A": 1, "B": 1, None: 1})
    assert sorted(column(C.pool_rare(df, "s", kept=["A"]), "s")) == ["A", "OTHER", "OTHER"]


def test_rare_map(spark):
    df = letters(spark, {"A": 9, "B": 3, None: 6}).withColumn("t", F.lit("x"))
    kept, with_rare = C.fit_rare_map(df, ["s", "t"], 5)
    assert kept == {"s": ["A", "MISSING"], "t": ["x"]} and with_rare == ["s"]
    new = spark.createDataFrame([("A", "x"), ("Z", None), (None, "y")], "s string, t string")
    out = C.apply_rare_map(new, kept)
    assert column(out, "s") == ["A", "OTHER", "MISSING"] and column(out, "t") == ["x", "OTHER", "OTHER"]


def test_many_categories(spark):
    kept, with_rare = C.fit_rare_map(spark.range(12_000).selectExpr("cast(id as string) as s"), ["s"], 1)
    assert len(kept["s"]) == 12_000 and with_rare == []


# -- policies ----------------------------------------------------------------

def test_missing_policy(spark):
    rows = [(float(i), None if i % 4 else "b", 1.0, "c") for i in range(20)]
    rows[1] = (None, "a", None, "c")
    df = spark.createDataFrame(rows, "n double, s string, x double, t string")
    flags, medians, modes = FE.fit_missing_policy(df)
    assert flags == ["n", "s", "x"]
    assert medians == {"n": 10.0, "x": 1.0} and modes == {"s": "b"}
    plain = FE.apply_missing_policy(df, flags, medians, modes)
    assert plain.columns == ["n", "s", "x", "t", "n_IS_MISSING", "s_IS_MISSING", "x_IS_MISSING"]
    assert plain.where("n is null").count() == 1
    filled = FE.apply_missing_policy(df, flags, medians, modes, for_linear=True)
    assert filled.where("n is null or s is null or x is null").count() == 0
    assert filled.agg(F.sum("n_IS_MISSING")).first()[0] == 1


def test_mode_tie_takes_smallest_and_empty_column(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "s string, e string")
    assert FE.fit_missing_policy(df)[2] == {"s": "a", "e": "MISSING"}


def test_imputers_and_scaler(spark):
    df = spark.createDataFrame(
        [(1.0, None, 0.1), (None, None, 0.1), (3.0, None, 0.1), (8.0, None, 0.1)], "a double, e double, k double"
    )
    imputers = FE.fit_imputers(df, ["a", "e", "k"])
    assert imputers == {"a": 3.0, "e": 0.0, "k": 0.1}
    scales = FE.fit_scaler(df, ["a", "e", "k"], imputers)
    values = [1, 3, 3, 8]
    mean = sum(values) / 4
    assert scales["a"] == pytest.approx((sum((v - mean) ** 2 for v in values) / 4) ** 0.5)
    assert scales["e"] == 1.0 and scales["k"] == 1.0


def test_application_features(spark):
    df = credit.applications(spark, 2, EXT_SOURCE_2=lambda i: None if i == 2 else 0.4)
    row = credit.one(FE.application_features(df), "SK_ID_CURR", 41)
    assert row["AGE_YEARS"] == pytest.approx(42.0)
    assert row["CREDIT_INCOME_RATIO"] == pytest.approx(91450 / 51700)
    scores = [0.71, 0.4, 0.53]
    assert row["EXT_SOURCE_MEAN"] == pytest.approx(1.64 / 3) and row["EXT_SOURCE_STD"] == pytest.approx(statistics.stdev(scores))
    assert row["SOCIAL_CIRCLE_SUM"] == 10 and row["BUREAU_REQUEST_SUM"] == 19
    for c in ("AMT_INCOME_TOTAL_CAPPED", "DAYS_EMPLOYED_ANOM"):
        with pytest.raises(ValueError, match=c):
            FE.application_features(df.drop(c))


# -- builder -----------------------------------------------------------------

def train(spark, n=40):
    return credit.applications(
        spark, n,
        AMT_CREDIT=lambda i: 200000.0 + 1000 * i,
        OWN_CAR_AGE=lambda i: None if i % 2 else float(i),
        NAME_CONTRACT_TYPE=lambda i: "Instalments" if i > 8 else "Overdraft",
        OCCUPATION_TYPE=lambda i: None if i <= 12 else "Welder",
    )


def test_reduced_builder_contract(spark):
    app = train(spark)
    model = FE.fit_reduced_builder(app, minCount=10)
    plain = FE.build_reduced(app, model)
    linear = FE.build_reduced(app, model, for_linear=True)
    assert plain.columns == linear.columns == ["SK_ID_CURR", *model.encoded_columns]
    assert plain.count() == 40
    FE.assert_no_blocked_columns(model.encoded_columns)
    dummies = [c for c in model.encoded_columns if c.startswith(S.CATEGORICAL_COLS)]
    flags = [c for c in model.encoded_columns if c.endswith("_IS_MISSING")]
    assert flags == ["OWN_CAR_AGE_IS_MISSING"]
    assert "NAME_CONTRACT_TYPE_OTHER" in dummies and "NAME_CONTRACT_TYPE_Instalments" in dummies
    assert {"OCCUPATION_TYPE_Welder", "OCCUPATION_TYPE_MISSING"} <= set(dummies)
    assert "OCCUPATION_TYPE_OTHER" not in dummies
    same = plain.select("SK_ID_CURR", *dummies, *flags)
    assert same.exceptAll(linear.select("SK_ID_CURR", *dummies, *flags)).count() == 0
    assert plain.where("OWN_CAR_AGE is null").count() == 20
    assert linear.where("OWN_CAR_AGE is null").count() == 0
    scales, imputers = model.getOrDefault("scales"), model.getOrDefault("imputers")
    a = credit.one(plain, "SK_ID_CURR", 43)
    b = credit.one(linear, "SK_ID_CURR", 43)
    assert b["AMT_CREDIT"] == pytest.approx(a["AMT_CREDIT"] / scales["AMT_CREDIT"])
    assert b["OWN_CAR_AGE"] == pytest.approx(imputers["OWN_CAR_AGE"] / scales["OWN_CAR_AGE"])
    assert imputers["OWN_CAR_AGE"] == 21.0


def test_unseen_categories(spark):
    app = train(spark)
    model = FE.fit_reduced_builder(app, minCount=10)
    new = credit.applications(spark, 1, NAME_CONTRACT_TYPE=lambda i: "New", OCCUPATION_TYPE=lambda i: "New")
    row = credit.one(FE.build_reduced(new, model))
    assert row["NAME_CONTRACT_TYPE_OTHER"] == 1.0
    assert row["OCCUPATION_TYPE_Welder"] == row["OCCUPATION_TYPE_MISSING"] == 0.0


def test_small_categories_all_become_other(spark):
    app = credit.applications(spark)
    model = FE.fit_reduced_builder(app)
    dummies = [f"{c}_{v}" for c, v in model.getOrDefault("dummies")]
    assert dummies == [f"{c}_OTHER" for c in S.CATEGORICAL_COLS]
    assert credit.one(FE.build_reduced(app, model), "SK_ID_CURR", 41)["OCCUPATION_TYPE_OTHER"] == 1.0


def test_absent_inputs_and_empty_frame(spark):
    app = train(spark)
    model = FE.fit_reduced_builder(app, minCount=10)
    frame = FE.pre_model_frame(app, "REDUCED").drop("OWN_CAR_AGE")
    out = model.transform(frame)
    assert out.columns[1:] == model.encoded_columns
    assert out.where("OWN_CAR_AGE_IS_MISSING = 0").count() == 0
    assert FE.build_reduced(app.limit(0), model).count() == 0


def test_full_builder_flattened_equals_tables(spark):
    app, tables = train(spark), credit.children(spark, 30)
    model = FE.fit_full_builder(app, tables, minCount=10)
    from_tables = FE.build_full(app, model, for_linear=True, tables=tables)
    flat = app.join(
        FE.pre_model_frame(app, "FULL", tables).select("SK_ID_CURR", *S.AGGREGATE_FEATURES), "SK_ID_CURR"
    )
    from_row = FE.build_full(flat, model, for_linear=True)
    assert from_row.columns == from_tables.columns
    assert from_row.exceptAll(from_tables).count() == 0 and from_row.count() == 40
    assert "BUREAU_LOAN_COUNT_IS_MISSING" in model.encoded_columns
    with pytest.raises(ValueError, match="44 of 45 child-table features"):
        FE.build_full(flat.drop("CC_DPD_MAX"), model)
    with pytest.raises(ValueError, match="child tables"):
        FE.build_full(app, model)
    # Fitting ignores flattened columns and aggregates again.
    wrong = flat.withColumn("BUREAU_LOAN_COUNT", F.lit(99).cast("long"))
    again = FE.fit_full_builder(wrong, tables, minCount=10)
    assert again.getOrDefault("imputers") == model.getOrDefault("imputers")


def test_guards(spark):
    app = train(spark)
    model = FE.fit_reduced_builder(app, minCount=10)
    with pytest.raises(ValueError, match="tier FULL"):
        FE.build_full(app, model)
    with pytest.raises(TypeError):
        FE.build_reduced(app, "no builder")
    with pytest.raises(ValueError, match=r"columns not found: \['AMT_CREDIT'\]"):
        FE.build_reduced(app.drop("AMT_CREDIT"), model)
    with pytest.raises(ValueError, match="CODE_GENDER"):
        FE.assert_no_blocked_columns(["AGE_YEARS", "CODE_GENDER"])
    with pytest.raises(ValueError, match="CNT_CHILDREN_IS_MISSING"):
        FE.assert_no_blocked_columns(["CNT_CHILDREN_IS_MISSING"])


def test_save_and_load(spark, tmp_path):
    app = train(spark)
    calls = []

    def fit():
        calls.append(1)
        return FE.fit_reduced_builder(app, minCount=10)

    path = str(tmp_path / "builder")
    first = load_or_fit_builder(spark, path, fit)
    second = load_or_fit_builder(spark, path, fit)
    assert len(calls) == 1
    assert first.encoded_columns == second.encoded_columns
    a = FE.build_reduced(app, first, for_linear=True)
    assert a.exceptAll(FE.build_reduced(app, second, for_linear=True)).count() == 0
    other = str(tmp_path / "other")
    app.limit(1).write.parquet(other)
    with pytest.raises(TypeError, match="must contain a FeatureBuilderModel"):
        load_or_fit_builder(spark, other, fit)


def test_vector_output(spark):
    app = train(spark)
    model = FE.fit_reduced_builder(app, minCount=10).setFeaturesCol("features")
    row = FE.build_reduced(app, model).first()
    assert row["features"].size == len(model.encoded_columns)
