import json
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F, types as T

import credit
from riskmart import schema as S
from riskmart.operators import evaluate as E, features as FE, profile as P
from riskmart.plans import jobs
from riskmart.sources import tables as IO
from riskmart.streaming import scoring


# -- sources -----------------------------------------------------------------

def test_unknown_tables_are_refused_before_reading(spark):
    with pytest.raises(ValueError, match=r"unknown tables: \['secrets'\]"):
        IO.read_tables(spark, "/does/not/exist", ["bureau", "secrets.csv"])


def test_csv_markers_types_and_quotes(spark, tmp_path):
    (tmp_path / "bureau.csv").write_text(
        'SK_ID_CURR,CREDIT_ACTIVE,AMT_CREDIT_SUM,AMT_CREDIT_SUM_DEBT,AMT_CREDIT_SUM_OVERDUE,'
        "CREDIT_DAY_OVERDUE,DAYS_CREDIT,CNT_CREDIT_PROLONG,CREDIT_TYPE\n"
        '100001,Active,1.5,,NA,nan,-3,0,"say ""hi"", all"\n'
        "100002.0,XNA,NULL,2e3,N/A,NaN,None,1,n/a\n"
    )
    rows = IO.read_table(spark, str(tmp_path), "bureau").orderBy("SK_ID_CURR").collect()
    a, b = rows[0].asDict(), rows[1].asDict()
    assert a["SK_ID_CURR"] == 100001 and b["SK_ID_CURR"] == 100002
    assert a["CREDIT_TYPE"] == 'say "hi", all' and b["CREDIT_TYPE"] is None
    assert b["CREDIT_ACTIVE"] == "XNA" and b["AMT_CREDIT_SUM"] is None and b["AMT_CREDIT_SUM_DEBT"] == 2000.0
    assert [a[c] for c in ("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "CREDIT_DAY_OVERDUE")] == [None] * 3
    assert b["DAYS_CREDIT"] is None and a["DAYS_CREDIT"] == -3.0
    few = IO.read_table(spark, str(tmp_path), "bureau", columns=["SK_ID_CURR"])
    assert few.columns == ["SK_ID_CURR"] and few.count() == 2


def test_csv_types_of_unlisted_columns(spark, tmp_path):
    """long < double < text: one value of a wider kind widens the column, wherever it lies."""
    wide = ["7", "-3", "+12", " 5 ", "007", "NA", ""] * 30
    columns = {
        "WHOLE": wide, "REAL": wide + ["2.50"], "SMALL": wide + ["1e-3"], "DOT": wide + [".5"], "INF": wide + ["-inf"],
        "HUGE": wide + ["9223372036854775808"], "MIXED": wide + ["7d"], "HEX": wide + ["0x10"], "DATE": wide + ["2020-01-02"],
        "NOTHING": ["NA", "", "null"] * 70, "LOGICAL": ["True", "False"] * 100, "A b,c": wide,
    }
    rows = max(map(len, columns.values()))
    lines = [",".join(f'"{c}"' for c in columns)]
    lines += [",".join(v[i] if i < len(v) else "" for v in columns.values()) for i in range(rows)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    df = IO.read_csv(spark, str(tmp_path / "t.csv"))
    kinds = {"WHOLE": "bigint", "MIXED": "string", "HEX": "string", "DATE": "string", "LOGICAL": "string", "A b,c": "bigint"}
    assert dict(df.dtypes) == {c: kinds.get(c, "double") for c in columns}
    sums = df.agg(F.sum("WHOLE"), F.sum("REAL"), F.max("HUGE"), F.min("INF"), F.count("NOTHING")).first()
    assert tuple(sums) == (28 * 30, 28 * 30 + 2.5, 2.0**63, float("-inf"), 0)
    assert set(dict(IO.read_csv(spark, str(tmp_path / "t.csv"), infer=False).dtypes).values()) == {"string"}
    few = IO.read_csv(spark, str(tmp_path / "t.csv"), {"WHOLE": T.DoubleType()}, ["WHOLE", "MIXED"])
    assert few.dtypes == [("WHOLE", "double"), ("MIXED", "string")]


def test_types_come_from_one_aggregate(spark):
    df = spark.range(10).selectExpr("cast(id as string) as a", "'x' as b", "cast(null as string) as c")
    assert {c: t.simpleString() for c, t in IO.infer_types(df).items()} == {"a": "bigint", "b": "string", "c": "double"}
    assert IO.infer_types(df, []) == {} and IO.infer_types(df.where("false"))["b"].simpleString() == "double"


def test_verification_does_not_read_the_source_again(spark, tmp_path):
    source, path = tmp_path / "source", str(tmp_path / "splits")
    spark.range(1000).selectExpr("id", "if(id < 600, 'train', 'test') as split").write.parquet(str(source))
    df = spark.read.parquet(str(source))
    rows = df.count()
    IO.write_split(df, path)
    for file in source.iterdir():
        file.unlink()
    assert IO.verify_written(df, path, "split", rows) == 1000
    P.assert_split_sizes(spark.read.parquet(path), rows)
    with pytest.raises(ValueError, match="holds 1000 of 999 rows"):
        IO.verify_written(df, path, "split", 999)
    plan = P.split_sizes(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_csv_bad_number_fails(spark, tmp_path):
    (tmp_path / "bureau.csv").write_text("SK_ID_CURR,DAYS_CREDIT\n1,soon\n")
    with pytest.raises(Exception, match="soon"):
        IO.read_table(spark, str(tmp_path), "bureau").collect()


def test_parquet_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "SK_ID_CURR long, DAYS_CREDIT double")
    df.write.parquet(str(tmp_path / "bureau.parquet"))
    got = IO.read_table(spark, str(tmp_path), "bureau", "parquet").orderBy("SK_ID_CURR").collect()
    assert [r["DAYS_CREDIT"] for r in got] == [None, 3.0]


def test_enforce_schema(spark):
    df = spark.createDataFrame([("1", "2", "x")], "SK_ID_CURR string, AMT_CREDIT string, OTHER string")
    out = IO.enforce_schema(df)
    assert dict(out.dtypes) == {"SK_ID_CURR": "bigint", "AMT_CREDIT": "double", "OTHER": "string"}
    missing = spark.createDataFrame([(None, 1.0)], "CNT_CHILDREN double, AMT_CREDIT double")
    with pytest.raises(Exception, match="CNT_CHILDREN has missing values"):
        IO.enforce_schema(missing).collect()
    assert IO.enforce_schema(missing, required=False).first()[0] is None


def test_values_and_splits_round_trip(spark, tmp_path):
    for name, value, kind in (("cap", 495000.0, "double"), ("ok", True, "boolean"), ("none", None, "double")):
        IO.write_value(spark, str(tmp_path / name), name, value)
        assert IO.read_value(spark, str(tmp_path / name), name, kind) == value
    df = spark.range(10).selectExpr("id", "if(id < 6, 'train', 'test') as split")
    path = str(tmp_path / "splits")
    IO.write_split(df, path)
    assert IO.read_split(spark, path, "test").count() == 4
    assert IO.verify_written(df, path, "split") == 10
    plan = IO.read_split(spark, path, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(ValueError, match="unknown split"):
        IO.read_split(spark, path, "holdout")
    with pytest.raises(ValueError, match="holds 10 of 5 rows"):
        IO.verify_written(df.limit(5), path, "split")
    with pytest.raises(ValueError, match="another schema"):
        IO.verify_written(df.withColumn("id", F.col("id").cast("string")), path, "split")


# -- prepare -----------------------------------------------------------------

def raw_applications(spark, n, target=True):
    rng = random.Random(n)
    rows = []
    for i in range(1, n + 1):
        rows.append({
            "SK_ID_CURR": 40 + i, "TARGET": int(rng.random() < 0.2),
            "AMT_INCOME_TOTAL": float(rng.randrange(20000, 400000)),
            "DAYS_EMPLOYED": 365243.0 if i % 5 == 0 else -float(rng.randrange(3000)),
            "DAYS_ID_PUBLISH": -float(rng.randrange(50)), "DAYS_REGISTRATION": -float(rng.randrange(50)),
            "EXT_SOURCE_1": rng.choice([None, rng.random()]), "EXT_SOURCE_2": rng.random(),
            "EXT_SOURCE_3": rng.random(), "AMT_CREDIT": float(rng.randrange(10000, 900000)),
            "CNT_CHILDREN": rng.randrange(4), "NAME_CONTRACT_TYPE": rng.choice(["Instalments", "Overdraft"]),
        })
    df = credit.frame(spark, credit.APPLICATION, rows).drop("AMT_INCOME_TOTAL_CAPPED", "DAYS_EMPLOYED_ANOM")
    return df if target else df.drop("TARGET")


def write_raw(spark, folder, n=400):
    tables = {
        "application_train": raw_applications(spark, n),
        "application_test": raw_applications(spark, 120, target=False),
        **credit.children(spark, n),
    }
    for name, df in tables.items():
        df.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")


def test_prepare_audit_and_stream(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    write_raw(spark, raw)
    done = jobs.run_prepare(spark, raw, out)

    stored = spark.read.parquet(f"{out}/splits")
    sizes = {r["split"]: r["n"] for r in P.split_sizes(stored).collect()}
    assert sizes == {"train": 240, "val_model": 40, "val_policy": 40, "test": 80}
    train = IO.read_split(spark, f"{out}/splits", "train")
    incomes = [r[0] for r in train.select("AMT_INCOME_TOTAL").collect()]
    assert done.income_cap == pytest.approx(np.quantile(incomes, 0.99))
    assert IO.read_value(spark, f"{out}/income_cap", "income_cap") == done.income_cap
    assert stored.where(F.col("AMT_INCOME_TOTAL_CAPPED") > done.income_cap).count() == 0
    assert stored.where("DAYS_EMPLOYED = 365243").count() == 0
    assert stored.where("DAYS_EMPLOYED_ANOM = 1").count() == 80
    # one loan, and a second one for every other applicant
    assert done.previous.where("DAYS_FIRST_DRAWING_ANOM = 1 and DAYS_FIRST_DRAWING is null").count() == 600
    report = json.loads(spark.read.text(f"{out}/quality_report").first()[0])
    assert report["total_rows"] == 400 and report["split_sizes"] == sizes
    assert report["sentinel_counts"] == {"DAYS_EMPLOYED_365243": 80}
    assert report["missing_rates"]["DAYS_EMPLOYED"] == 0.2
    assert sum(report["class_counts"].values()) == 240
    bundle = spark.read.parquet(f"{out}/adversarial")
    assert bundle.count() == 240 and bundle.where("part = 'val'").count() == 48

    charts = {name: spark.read.parquet(f"{out}/profile/{name}") for name in jobs.prepare_profile(stored, done.income_cap)}
    assert charts["employed_clean"].agg(F.sum("n")).first()[0] == 320
    assert charts["employed_raw"].agg(F.sum("n")).first()[0] == 400
    assert charts["income_capped"].count() == 60 and charts["correlations"].count() == 16
    assert {r["column"] for r in charts["missing_top"].collect()} == {"EXT_SOURCE_1", "DAYS_EMPLOYED"}
    assert charts["class_balance"].count() == 2

    # Models fitted elsewhere score the test split.
    tables = IO.read_tables(spark, raw, [t for t in S.SCORING_TABLES if t != "application_train"])
    path = f"{out}/full_builder"
    builder = IO.load_or_fit_builder(spark, path, lambda: FE.fit_full_builder(train, tables, minCount=50))
    matrix = FE.build_full(train, builder.copy().setFeaturesCol("features"), True, tables)
    labeled = matrix.join(train.select("SK_ID_CURR", "TARGET"), "SK_ID_CURR")
    model = LogisticRegression(labelCol="TARGET", maxIter=5).fit(labeled)
    raw_scores = E.score_batch(labeled, model)
    calibrator = IsotonicRegression(featuresCol="RAW_PD", labelCol="TARGET", predictionCol="cal").fit(
        raw_scores.select("RAW_PD", "TARGET")
    )
    names = ["EXT_SOURCE_MEAN", "CC_DPD_MAX", "AGE_YEARS"]
    test = IO.read_split(spark, f"{out}/splits", "test")
    given = test.select("SK_ID_CURR", F.array(*[F.col(f"EXT_SOURCE_{i}") for i in (1, 2, 3)]).alias("attribution"))
    result = jobs.run_audit(
        spark, f"{out}/splits", tables, model, calibrator, path, f"{out}/audit",
        attributions=given, feature_names=names, for_linear=True,
    )
    assert {"auc", "roc", "confusion", "fbeta_sweep", "best_threshold", "verdicts", "reasons",
            "importance_top", "attribution_sample", "local_examples"} <= set(result["tables"])
    assert IO.read_value(spark, f"{out}/audit/audit_passed", "audit_passed", "boolean") == result["passed"]
    scores = spark.read.parquet(f"{out}/audit/scores")
    assert scores.count() == 80 and scores.where("CALIBRATED_PD is null").count() == 0
    pairs = {(r["SK_ID_CURR"], r["TARGET"]) for r in scores.collect()}
    assert pairs == {(r["SK_ID_CURR"], r["TARGET"]) for r in test.collect()}
    assert spark.read.parquet(f"{out}/audit/local_examples").count() == 3
    assert spark.read.parquet(f"{out}/audit/confusion").agg(F.sum("n")).first()[0] == 80
    for family in ("primary", "secondary", "tertiary"):
        assert IO.read_audit(spark, f"{out}/audit", family).columns == list(S.AUDIT_COLS)

    # The same builder over a stream, with the child-table features on the row.
    flat = test.join(
        FE.pre_model_frame(test, "FULL", tables).select("SK_ID_CURR", *S.AGGREGATE_FEATURES), "SK_ID_CURR"
    )
    flat.write.parquet(str(tmp_path / "in"))
    query = scoring.run_stream(
        spark, str(tmp_path / "in"), flat.schema, builder, str(tmp_path / "sink"), str(tmp_path / "state"), True
    )
    query.awaitTermination(120)
    batch = FE.build_full(test, builder, True, tables)
    streamed = spark.read.parquet(str(tmp_path / "sink"))
    assert streamed.columns == batch.columns
    assert streamed.count() == 80 and streamed.exceptAll(batch).count() == 0


def test_stream_of_reduced(spark, tmp_path):
    app = credit.applications(spark, 20)
    model = FE.fit_reduced_builder(app, minCount=5)
    app.write.parquet(str(tmp_path / "in"))
    query = scoring.run_stream(
        spark, str(tmp_path / "in"), app.schema, model, str(tmp_path / "sink"), str(tmp_path / "state")
    )
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "sink")).exceptAll(FE.build_reduced(app, model)).count() == 0


def test_score_bands_without_calibrator(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (2.0, 1), (3.0, 1)], "x double, y int")
    from pyspark.ml.feature import VectorAssembler
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    out = E.score_batch(vec, LogisticRegression(labelCol="y", regParam=0.01).fit(vec)).orderBy("x").collect()
    assert [r["CALIBRATED_PD"] for r in out] == [r["RAW_PD"] for r in out]
    assert out[0]["DECISION"] == "APPROVE" and out[3]["DECISION"] == "DECLINE"


# -- profile -----------------------------------------------------------------

def test_histogram_equals_numpy(spark):
    rng = random.Random(2)
    data = [rng.gauss(0, 10) for _ in range(2000)] + [0.1 * i for i in range(50)]
    df = spark.createDataFrame([(v,) for v in data + [None]], "v double")
    counts, edges = np.histogram(data, bins=50)
    got = P.histogram(df, "v", 50).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(counts)
    assert [r["low"] for r in got] == pytest.approx(list(edges[:-1]))
    counts, _ = np.histogram(np.minimum(data, 4.0), bins=60)
    assert [r["n"] for r in P.histogram(df, "v", 60, 4.0).orderBy("bin").collect()] == list(counts)


def test_histogram_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    got = P.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(np.histogram([2.0, 2.0], 4)[0])
    assert sum(r["n"] for r in P.histogram(df.where("v > 5"), "v", 4).collect()) == 0


def test_correlations_drop_incomplete_rows(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 1.0, 1.0), (3.0, 5.0, 2.0), (9.0, None, 7.0), (4.0, 4.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    expected = np.corrcoef(np.array([r for r in rows if None not in r]).T)
    names = ["a", "b", "c"]
    for r in P.correlations(df, names).collect():
        assert r["corr"] == pytest.approx(expected[names.index(r["a"]), names.index(r["b"])])


def test_missing_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "a int, b int, c string")
    assert {r[0]: r[1] for r in P.missing_rates(df).collect()} == {"a": 0.5, "b": 1.0, "c": 0.0}
    assert [r["column"] for r in P.top_missing(df).collect()] == ["b", "a"]
    assert [r["column"] for r in P.top_missing(df, 1).collect()] == ["b"]
    shares = {r["c"]: r["share"] for r in P.value_counts(df, "c").collect()}
    assert shares == {"x": 0.5, "y": 0.5}
