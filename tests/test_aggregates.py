import pytest
from pyspark.sql import functions as F

import credit
from riskmart import schema as S
from riskmart.operators import aggregates as A


def test_hand_worked_values(spark):
    base = credit.applications(spark).select("SK_ID_CURR")
    mart = A.full_mart(base, credit.children(spark))
    assert mart.columns == ["SK_ID_CURR", *S.AGGREGATE_FEATURES]
    row = credit.one(mart, "SK_ID_CURR", 41)
    # loans 31 (refused, paid 9 days late, active) and 36 (approved, 3 days late, completed)
    expected = {
        "INST_RECORD_COUNT": 2, "INST_DPD_MEAN": 6, "INST_DPD_MAX": 9, "INST_LATE_COUNT": 2,
        "INST_PAYMENT_RATIO_MEAN": 1, "INST_MISSED_RATE": 0, "CC_UTILIZATION_MEAN": 0.225,
        "CC_PAYMENT_RATIO_MEAN": 1.25, "PREV_APP_CREDIT_DIFF_MEAN": 530, "PREV_APPROVAL_RATE": 0.5,
        "PREV_REFUSAL_RATE": 0.5, "BUREAU_DEBT_TO_CREDIT_RATIO": 2100 / 42000, "BUREAU_ACTIVE_COUNT": 1,
        "BUREAU_CLOSED_COUNT": 0, "POS_COMPLETED_RATE": 0.5, "POS_ACTIVE_RATE": 0.5, "CC_DRAWINGS_CURRENT_SUM": 180,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value), name


@pytest.mark.parametrize(
    "build, columns",
    [
        (lambda t: A.bureau_features(t["bureau"]), S.BUREAU_FEATURES),
        (lambda t: A.previous_features(t["previous_application"]), S.PREVIOUS_FEATURES),
        (lambda t: A.installment_features(t["installments_payments"], t["previous_application"]), S.INSTALLMENT_FEATURES),
        (lambda t: A.pos_features(t["POS_CASH_balance"], t["previous_application"]), S.POS_FEATURES),
        (lambda t: A.card_features(t["credit_card_balance"], t["previous_application"]), S.CARD_FEATURES),
    ],
)
def test_columns_and_order(spark, build, columns):
    out = build(credit.children(spark))
    assert out.columns == ["SK_ID_CURR", *columns]
    assert out.count() == 4


def test_missing_values(spark):
    gone = {k: None for k in credit.BUREAU if k not in ("SK_ID_CURR",)}
    row = credit.one(A.bureau_features(credit.frame(spark, credit.BUREAU, [gone, gone])))
    assert row["BUREAU_LOAN_COUNT"] == 2 and row["BUREAU_ACTIVE_COUNT"] == 0
    assert row["BUREAU_AMT_CREDIT_SUM_SUM"] == 0.0 and row["BUREAU_CNT_CREDIT_PROLONG_SUM"] == 0.0
    assert row["BUREAU_DEBT_TO_CREDIT_RATIO"] is None and row["BUREAU_DAYS_CREDIT_MAX"] is None

    parents = credit.frame(spark, credit.PREVIOUS, [{}])
    gone = {k: None for k in credit.INSTALLMENT if k != "SK_ID_PREV"}
    row = credit.one(A.installment_features(credit.frame(spark, credit.INSTALLMENT, [{}, gone]), parents))
    assert row["INST_RECORD_COUNT"] == 2 and row["INST_MISSED_RATE"] == 0.5
    assert row["INST_DPD_MEAN"] == 9.0 and row["INST_LATE_COUNT"] == 1
    row = credit.one(A.installment_features(credit.frame(spark, credit.INSTALLMENT, [gone]), parents))
    assert row["INST_DPD_MEAN"] is None and row["INST_LATE_COUNT"] == 0 and row["INST_MISSED_RATE"] == 1.0

    rows = [{"NAME_CONTRACT_STATUS": None}, {}, {}, {}]
    row = credit.one(A.pos_features(credit.frame(spark, credit.POS, rows), parents))
    assert row["POS_COMPLETED_RATE"] == 0.75 and row["POS_ACTIVE_RATE"] == 0.0

    rows = [{"AMT_CREDIT_LIMIT_ACTUAL": 0.0, "AMT_INST_MIN_REGULARITY": 0.0, "AMT_DRAWINGS_ATM_CURRENT": None}]
    row = credit.one(A.card_features(credit.frame(spark, credit.CARD, rows), parents))
    assert row["CC_UTILIZATION_MEAN"] is None and row["CC_PAYMENT_RATIO_MEAN"] is None
    assert row["CC_DRAWINGS_ATM_SUM"] == 0.0


def test_zero_due_amount_has_no_ratio(spark):
    parents = credit.frame(spark, credit.PREVIOUS, [{}])
    rows = [{"AMT_INSTALMENT": 0.0}, {"AMT_PAYMENT": 420.0}]
    row = credit.one(A.installment_features(credit.frame(spark, credit.INSTALLMENT, rows), parents))
    assert row["INST_PAYMENT_RATIO_MEAN"] == 0.5 and row["INST_PAYMENT_RATIO_MIN"] == 0.5


def test_orphans_and_keyless_rows(spark):
    parents = credit.frame(spark, credit.PREVIOUS, [{}])
    rows = [{}, {"SK_ID_PREV": 5}, {"SK_ID_PREV": None}]
    out = A.installment_features(credit.frame(spark, credit.INSTALLMENT, rows), parents)
    assert credit.one(out)["INST_RECORD_COUNT"] == 1
    rows = [{}, {"SK_ID_CURR": None}]
    assert A.bureau_features(credit.frame(spark, credit.BUREAU, rows)).count() == 1


def test_means_weigh_rows_not_links(spark):
    """Two links of one applicant with different numbers of rows."""
    parents = credit.frame(spark, credit.PREVIOUS, [{}, {"SK_ID_PREV": 2}])
    rows = [{"SK_DPD": 1.0}, {"SK_DPD": 2.0}, {"SK_DPD": 3.0}, {"SK_ID_PREV": 2, "SK_DPD": 10.0}]
    row = credit.one(A.pos_features(credit.frame(spark, credit.POS, rows), parents))
    assert row["POS_DPD_MEAN"] == 4.0 and row["POS_DPD_MAX"] == 10.0 and row["POS_RECORD_COUNT"] == 4


def test_carried_key_must_agree(spark):
    parents = credit.frame(spark, credit.PREVIOUS, [{}])
    good = credit.frame(spark, credit.POS, [{"SK_ID_CURR": 41}, {"SK_ID_CURR": 41}])
    assert credit.one(A.pos_features(good, parents))["POS_RECORD_COUNT"] == 2
    for wrong in (7, None):
        bad = credit.frame(spark, credit.POS, [{"SK_ID_CURR": 41}, {"SK_ID_CURR": wrong}])
        with pytest.raises(Exception, match="pos cash rows carry a SK_ID_CURR that differs"):
            A.pos_features(bad, parents).collect()
        assert A.pos_features(bad, parents, validate=False).count() == 1


def test_mart_rejects_repeated_applicants(spark):
    base = credit.applications(spark).select("SK_ID_CURR")
    with pytest.raises(ValueError, match="duplicate keys"):
        A.full_mart(base.unionAll(base), credit.children(spark))


def test_mart_keeps_applicants_without_children(spark):
    base = credit.applications(spark, 5).select("SK_ID_CURR")
    row = credit.one(A.full_mart(base, credit.children(spark, 4)), "SK_ID_CURR", 45)
    assert all(row[c] is None for c in S.AGGREGATE_FEATURES)


def test_hot_link_meets_the_join_as_one_row(spark):
    child = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-31)).otherwise(F.col("id")).alias("SK_ID_PREV"),
        F.lit(1.0).alias("SK_DPD"), F.lit(0.0).alias("SK_DPD_DEF"),
        F.lit("Active").alias("NAME_CONTRACT_STATUS"), F.lit(2.0).alias("CNT_INSTALMENT_FUTURE"),
    )
    out = A.pos_features(child, credit.frame(spark, credit.PREVIOUS, [{"SK_ID_PREV": -31}]))
    assert credit.one(out)["POS_RECORD_COUNT"] == 1667
