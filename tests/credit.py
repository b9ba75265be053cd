"""Small credit tables: defaults per column, with rows that change some of them."""

from pyspark.sql import types as T

from riskmart import schema as S

APPLICATION = {
    "SK_ID_CURR": 41, "AMT_INCOME_TOTAL": 58300.0, "AMT_INCOME_TOTAL_CAPPED": 51700.0,
    "AMT_CREDIT": 91450.0, "AMT_ANNUITY": 7310.0, "AMT_GOODS_PRICE": 88200.0,
    "DAYS_BIRTH": -15330.0, "DAYS_EMPLOYED": -412.0, "DAYS_REGISTRATION": -6208.0,
    "DAYS_ID_PUBLISH": -931.0, "DAYS_LAST_PHONE_CHANGE": -77.0, "REGION_POPULATION_RELATIVE": 0.0313,
    "EXT_SOURCE_1": 0.71, "EXT_SOURCE_2": 0.35, "EXT_SOURCE_3": 0.53, "CNT_FAM_MEMBERS": 3.0,
    "OWN_CAR_AGE": 14.0, "OBS_30_CNT_SOCIAL_CIRCLE": 4.0, "DEF_30_CNT_SOCIAL_CIRCLE": 2.0,
    "OBS_60_CNT_SOCIAL_CIRCLE": 3.0, "DEF_60_CNT_SOCIAL_CIRCLE": 1.0,
    "AMT_REQ_CREDIT_BUREAU_HOUR": 1.0, "AMT_REQ_CREDIT_BUREAU_DAY": 2.0,
    "AMT_REQ_CREDIT_BUREAU_WEEK": 0.0, "AMT_REQ_CREDIT_BUREAU_MON": 5.0,
    "AMT_REQ_CREDIT_BUREAU_QRT": 3.0, "AMT_REQ_CREDIT_BUREAU_YEAR": 8.0,
    "NAME_CONTRACT_TYPE": "Instalments", "NAME_TYPE_SUITE": "Partner",
    "NAME_EDUCATION_TYPE": "Vocational", "NAME_FAMILY_STATUS": "Divorced",
    "OCCUPATION_TYPE": "Welder", "ORGANIZATION_TYPE": "Shipyard",
    "WEEKDAY_APPR_PROCESS_START": "THURSDAY", "REGION_RATING_CLIENT_W_CITY": 3.0, "CNT_CHILDREN": 2,
    "NAME_INCOME_TYPE": "Self-employed", "NAME_HOUSING_TYPE": "Lodger", "FLAG_OWN_CAR": "Y",
    "FLAG_OWN_REALTY": "N", "DAYS_EMPLOYED_ANOM": 0, "CODE_GENDER": "X", "TARGET": 0,
}
BUREAU = {
    "SK_ID_CURR": 41, "CREDIT_ACTIVE": "Active", "AMT_CREDIT_SUM": 16800.0,
    "AMT_CREDIT_SUM_DEBT": 2100.0, "AMT_CREDIT_SUM_OVERDUE": 0.0, "CREDIT_DAY_OVERDUE": 0.0,
    "DAYS_CREDIT": -37.0, "CNT_CREDIT_PROLONG": 0.0,
}
PREVIOUS = {
    "SK_ID_PREV": 31, "SK_ID_CURR": 41, "NAME_CONTRACT_STATUS": "Refused",
    "AMT_APPLICATION": 5200.0, "AMT_CREDIT": 4700.0, "AMT_GOODS_PRICE": 4100.0,
    "DAYS_DECISION": -64.0, "RATE_DOWN_PAYMENT": 0.25, "DAYS_FIRST_DRAWING": 365243.0,
    "DAYS_LAST_DUE": -18.0,
}
INSTALLMENT = {
    "SK_ID_PREV": 31, "DAYS_ENTRY_PAYMENT": -7.0, "DAYS_INSTALMENT": -16.0,
    "AMT_INSTALMENT": 840.0, "AMT_PAYMENT": 840.0,
}
POS = {
    "SK_ID_PREV": 31, "SK_DPD": 0.0, "SK_DPD_DEF": 0.0, "NAME_CONTRACT_STATUS": "Completed",
    "CNT_INSTALMENT_FUTURE": 3.0,
}
CARD = {
    "SK_ID_PREV": 31, "AMT_CREDIT_LIMIT_ACTUAL": 8000.0, "AMT_BALANCE": 1800.0,
    "AMT_INST_MIN_REGULARITY": 320.0, "AMT_PAYMENT_TOTAL_CURRENT": 400.0, "SK_DPD": 0.0,
    "AMT_DRAWINGS_ATM_CURRENT": 75.0, "AMT_DRAWINGS_CURRENT": 90.0,
}
KINDS = {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}


def frame(spark, defaults, rows):
    """Rows are dicts of what differs from the defaults; extra keys become columns."""
    merged = [{**defaults, **r} for r in rows]
    extra = {k: type(v) for r in rows for k, v in r.items() if k not in defaults and v is not None}
    kinds = {**{k: type(v) for k, v in defaults.items()}, **extra}
    schema = T.StructType([T.StructField(k, KINDS[t]) for k, t in kinds.items()])
    return spark.createDataFrame([tuple(m.get(k) for k in kinds) for m in merged], schema)


def applications(spark, n=4, **change):
    rows = []
    for i in range(1, n + 1):
        row = {"SK_ID_CURR": 40 + i, "TARGET": (i + 1) % 2}
        row.update({k: f(i) for k, f in change.items()})
        rows.append(row)
    return frame(spark, APPLICATION, rows)


def children(spark, n=4):
    """Child tables of uneven depth: one to three bureau rows per applicant, one or two loans, each
    with its instalment, point-of-sale and card row; some debts are missing."""
    people = [(i, 40 + i) for i in range(1, n + 1)]
    loans = [(i, c, k, 31 * i + 5 * k) for i, c in people for k in range(1 + i % 2)]
    state = ("Closed", "Active", "Sold")
    return {
        "bureau": frame(spark, BUREAU, [
            {"SK_ID_CURR": c, "CREDIT_ACTIVE": state[(i + k) % 3], "AMT_CREDIT_SUM": 8400.0 * (k + 2),
             "AMT_CREDIT_SUM_DEBT": None if k == 1 else 2100.0 * i, "DAYS_CREDIT": -37.0 * (i + k)}
            for i, c in people for k in range(1 + i % 3)]),
        "previous_application": frame(spark, PREVIOUS, [
            {"SK_ID_PREV": p, "SK_ID_CURR": c, "NAME_CONTRACT_STATUS": ("Approved", "Refused")[(i + k) % 2],
             "AMT_APPLICATION": 5200.0 + 100.0 * k, "AMT_CREDIT": 4700.0 + 40.0 * k, "DAYS_DECISION": -64.0 - i}
            for i, c, k, p in loans]),
        "installments_payments": frame(spark, INSTALLMENT, [
            {"SK_ID_PREV": p, "DAYS_ENTRY_PAYMENT": -7.0 - 6.0 * k} for _, _, k, p in loans]),
        "POS_CASH_balance": frame(spark, POS, [
            {"SK_ID_PREV": p, "NAME_CONTRACT_STATUS": ("Active", "Completed")[k]} for _, _, k, p in loans]),
        "credit_card_balance": frame(spark, CARD, [{"SK_ID_PREV": p} for _, _, _, p in loans]),
    }


def one(df, key=None, value=None):
    """The row (of a key) as a dict."""
    rows = df.where(f"{key} = {value}").collect() if key else df.collect()
    assert len(rows) == 1
    return rows[0].asDict(recursive=True)


ALL_FEATURES = S.AGGREGATE_FEATURES
