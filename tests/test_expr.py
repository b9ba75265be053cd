import math

import pytest
from pyspark.sql import functions as F

from riskmart import schema as S
from riskmart.functions import expr as X


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_safe_div(spark):
    df = frame(spark, [(4.0, 2.0), (None, 2.0), (6.0, 0.0), (1.0, None)], "a double, b double")
    assert values(df, X.safe_div("a", "b")) == [2.0, None, None, None]


def test_nan_becomes_null(spark):
    df = frame(spark, [(float("nan"),), (1.0,), (None,)], "a double")
    assert values(df, X.nan_to_null("a")) == [None, 1.0, None]


def test_sentinel(spark):
    df = frame(spark, [(365243.0,), (-5.0,), (None,)], "a double")
    assert values(df, X.sentinel_flag("a")) == [1, 0, 0]
    assert values(df, X.sentinel_to_null("a")) == [None, -5.0, None]


def test_cap_keeps_missing(spark):
    df = frame(spark, [(5.0,), (15.0,), (None,)], "a double")
    assert values(df, X.cap_upper("a", 10)) == [5.0, 10.0, None]
    assert values(df, X.cap_upper("a", None)) == [5.0, 15.0, None]


def test_row_statistics_skip_missing(spark):
    df = frame(
        spark,
        [(0.2, 0.4, 0.6), (0.2, None, 0.6), (0.2, None, None), (None, None, None)],
        "a double, b double, c double",
    )
    cols = ["a", "b", "c"]
    assert values(df, X.row_mean(cols)) == pytest.approx([0.4, 0.4, 0.2, None])
    std = values(df, X.row_std(cols))
    assert std[:2] == pytest.approx([0.2, math.sqrt(0.08)]) and std[2:] == [None, None]
    assert values(df, X.row_sum(cols)) == pytest.approx([1.2, 0.8, 0.2, 0.0])


def test_days_late(spark):
    df = frame(spark, [(-10.0, -12.0), (-12.0, -10.0), (None, -1.0), (-1.0, None)], "p double, d double")
    assert values(df, X.days_late("p", "d")) == [2.0, 0.0, None, None]


def test_aggregate_helpers(spark):
    df = frame(spark, [("x", None), (None, None), ("y", None)], "s string, v double")
    row = df.agg(X.sum_or_zero("v").alias("s"), X.share(F.col("s") == "x").alias("p")).first()
    assert row["s"] == 0.0 and row["p"] == pytest.approx(1 / 3)


def test_decision_band_and_class(spark):
    df = frame(spark, [(0.1,), (0.15,), (0.34,), (0.35,), (None,)], "pd double")
    assert values(df, X.decision_band("pd")) == ["APPROVE", "REVIEW", "REVIEW", "DECLINE", "DECLINE"]
    assert values(df, X.predicted_class("pd", 0.35)) == [0, 0, 0, 1, 0]


def test_groups(spark):
    df = frame(spark, [(60000.0,), (80000.0,), (80001.0,), (None,)], "i double")
    assert values(df, X.income_tertile("i", 60000, 80000)) == ["T1", "T2", "T3", "MISSING"]
    df = frame(spark, [(0.0,), (-0.5,), (-1.0,), (0.5,), (1.0,), (4.0,), (None,)], "c double")
    assert values(df, X.children_bin("c")) == ["0", "0", "nan", "1", "1", "2_PLUS", "0"]
    df = frame(spark, [("T1", 2.0), ("T2", None), ("T3", 1.9)], "t string, r double")
    assert values(df, X.primary_group("t", "r")) == ["T1__2", "T2__-1", "T3__1"]
    df = frame(spark, [("Y", None), (None, "Y")], "c string, r string")
    assert values(df, X.own_asset_bin("c", "r")) == ["Y_N", "N_Y"]


def test_reason_text(spark):
    names = [
        "CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "INST_DPD_MEAN", "BUREAU_LOAN_COUNT",
        "CC_DPD_MAX", "POS_DPD_MEAN", "EXT_SOURCE_MEAN", "cc_dpd_max", "INST_MISSED_RATE",
    ]
    df = frame(spark, [(n,) for n in names], "n string")
    got = values(df, X.reason_text("n"))
    assert got[:6] == list(S.REASONS.values())
    assert got[6:] == [S.DEFAULT_REASON] * 3


def test_first_matching_prefix_wins(spark):
    df = frame(spark, [("AB_C",)], "n string")
    assert values(df, X.reason_text("n", {"A": "first", "AB": "second"})) == ["first"]


def test_f_beta(spark):
    df = frame(spark, [(2, 1, 1), (0, 0, 0), (0, 3, 2)], "tp long, fp long, fn long")
    assert values(df, X.f_beta("tp", "fp", "fn")) == pytest.approx([52 / (52 + 25 + 1), 0.0, 0.0])


def test_precedes_is_lexicographic(spark):
    rows = [(1, 5), (2, 1), (2, 2), (2, 3), (3, 0)]
    df = frame(spark, rows, "a int, b int")
    assert values(df, X.precedes(["a", "b"], (2, 2))) == [r < (2, 2) for r in rows]


def test_sql_text_round_trips(spark):
    for text in ("it's", "back\\slash", "plain", 'quo"te'):
        assert spark.range(1).selectExpr(f"{X.sql_text(text)} as t").first()[0] == text
    df = spark.createDataFrame([(1,)], "`odd ``name` int")
    assert df.selectExpr(f"{X.quoted('odd `name')} as t").first()[0] == 1
    for number in (0.1, -1e300, 5, -(2 ** 63)):
        assert spark.range(1).selectExpr(f"{X.sql_number(number)} as t").first()[0] == number
