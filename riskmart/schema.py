"""Column lists, table schemas and thresholds of the credit preset.

Operators take column names as arguments; these values are their defaults.
"""

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Table names, column names, thresholds and wording that results
# have to agree on.
# --------------------------------------------------------------------------

KEY = "SK_ID_CURR"
LINK_KEY = "SK_ID_PREV"
TARGET = "TARGET"

SCORING_TABLES = (
    "application_train",
    "bureau",
    "previous_application",
    "installments_payments",
    "POS_CASH_balance",
    "credit_card_balance",
)
ADVERSARIAL_TABLES = ("application_test",)

SENTINEL_DAYS = 365243
PREVIOUS_SENTINEL_COLS = (
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
)

APPLICATION_TYPES = {
    "SK_ID_CURR": T.LongType(),
    "CNT_CHILDREN": T.LongType(),
    "CNT_FAM_MEMBERS": T.DoubleType(),
    "AMT_INCOME_TOTAL": T.DoubleType(),
    "AMT_CREDIT": T.DoubleType(),
    "AMT_ANNUITY": T.DoubleType(),
    "AMT_GOODS_PRICE": T.DoubleType(),
    "DAYS_BIRTH": T.DoubleType(),
    "DAYS_EMPLOYED": T.DoubleType(),
    "DAYS_REGISTRATION": T.DoubleType(),
    "DAYS_ID_PUBLISH": T.DoubleType(),
    "DAYS_LAST_PHONE_CHANGE": T.DoubleType(),
    "EXT_SOURCE_1": T.DoubleType(),
    "EXT_SOURCE_2": T.DoubleType(),
    "EXT_SOURCE_3": T.DoubleType(),
    "NAME_CONTRACT_TYPE": T.StringType(),
    "NAME_TYPE_SUITE": T.StringType(),
    "NAME_EDUCATION_TYPE": T.StringType(),
    "NAME_FAMILY_STATUS": T.StringType(),
    "OCCUPATION_TYPE": T.StringType(),
    "ORGANIZATION_TYPE": T.StringType(),
    "WEEKDAY_APPR_PROCESS_START": T.StringType(),
    "NAME_INCOME_TYPE": T.StringType(),
    "NAME_HOUSING_TYPE": T.StringType(),
    "FLAG_OWN_CAR": T.StringType(),
    "FLAG_OWN_REALTY": T.StringType(),
    "REGION_RATING_CLIENT_W_CITY": T.DoubleType(),
}

CATEGORICAL_COLS = (
    "NAME_CONTRACT_TYPE",
    "NAME_TYPE_SUITE",
    "NAME_EDUCATION_TYPE",
    "NAME_FAMILY_STATUS",
    "OCCUPATION_TYPE",
    "ORGANIZATION_TYPE",
    "WEEKDAY_APPR_PROCESS_START",
)

NUMERIC_COLS = (
    "AMT_INCOME_TOTAL_CAPPED",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    "DAYS_REGISTRATION",
    "DAYS_ID_PUBLISH",
    "DAYS_LAST_PHONE_CHANGE",
    "REGION_POPULATION_RELATIVE",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "CNT_FAM_MEMBERS",
    "OWN_CAR_AGE",
    "OBS_30_CNT_SOCIAL_CIRCLE",
    "DEF_30_CNT_SOCIAL_CIRCLE",
    "OBS_60_CNT_SOCIAL_CIRCLE",
    "DEF_60_CNT_SOCIAL_CIRCLE",
    "AMT_REQ_CREDIT_BUREAU_HOUR",
    "AMT_REQ_CREDIT_BUREAU_DAY",
    "AMT_REQ_CREDIT_BUREAU_WEEK",
    "AMT_REQ_CREDIT_BUREAU_MON",
    "AMT_REQ_CREDIT_BUREAU_QRT",
    "AMT_REQ_CREDIT_BUREAU_YEAR",
)

FAIRNESS_COLS = (
    "REGION_RATING_CLIENT_W_CITY",
    "NAME_INCOME_TYPE",
    "NAME_HOUSING_TYPE",
    "FLAG_OWN_CAR",
    "FLAG_OWN_REALTY",
    "CNT_CHILDREN",
)

BLOCKED_COLS = ("SK_ID_CURR", "TARGET", "CODE_GENDER", "SK_ID_PREV")

EXT_SOURCE_COLS = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")

SOCIAL_CIRCLE_COLS = (
    "OBS_30_CNT_SOCIAL_CIRCLE",
    "DEF_30_CNT_SOCIAL_CIRCLE",
    "OBS_60_CNT_SOCIAL_CIRCLE",
    "DEF_60_CNT_SOCIAL_CIRCLE",
)

BUREAU_REQUEST_COLS = (
    "AMT_REQ_CREDIT_BUREAU_HOUR",
    "AMT_REQ_CREDIT_BUREAU_DAY",
    "AMT_REQ_CREDIT_BUREAU_WEEK",
    "AMT_REQ_CREDIT_BUREAU_MON",
    "AMT_REQ_CREDIT_BUREAU_QRT",
    "AMT_REQ_CREDIT_BUREAU_YEAR",
)

ENGINEERED_COLS = (
    "AGE_YEARS",
    "CREDIT_INCOME_RATIO",
    "ANNUITY_INCOME_RATIO",
    "GOODS_CREDIT_RATIO",
    "CREDIT_TERM_RATIO",
    "EMPLOYED_BIRTH_RATIO",
    "ID_PUBLISH_REG_RATIO",
    "EXT_SOURCE_MEAN",
    "EXT_SOURCE_STD",
    "SOCIAL_CIRCLE_SUM",
    "BUREAU_REQUEST_SUM",
    "DAYS_EMPLOYED_ANOM",
)

BUREAU_FEATURES = (
    "BUREAU_LOAN_COUNT",
    "BUREAU_ACTIVE_COUNT",
    "BUREAU_CLOSED_COUNT",
    "BUREAU_AMT_CREDIT_SUM_SUM",
    "BUREAU_AMT_CREDIT_SUM_DEBT_SUM",
    "BUREAU_DEBT_TO_CREDIT_RATIO",
    "BUREAU_AMT_CREDIT_SUM_OVERDUE_SUM",
    "BUREAU_CREDIT_DAY_OVERDUE_MAX",
    "BUREAU_DAYS_CREDIT_MAX",
    "BUREAU_CNT_CREDIT_PROLONG_SUM",
)

PREVIOUS_FEATURES = (
    "PREV_APP_COUNT",
    "PREV_APPROVED_COUNT",
    "PREV_REFUSED_COUNT",
    "PREV_APPROVAL_RATE",
    "PREV_REFUSAL_RATE",
    "PREV_AMT_APPLICATION_MEAN",
    "PREV_AMT_CREDIT_MEAN",
    "PREV_AMT_GOODS_PRICE_MEAN",
    "PREV_APP_CREDIT_DIFF_MEAN",
    "PREV_DAYS_DECISION_MAX",
    "PREV_RATE_DOWN_PAYMENT_MEAN",
)

INSTALLMENT_FEATURES = (
    "INST_RECORD_COUNT",
    "INST_MISSED_RATE",
    "INST_DPD_MEAN",
    "INST_DPD_MAX",
    "INST_PAYMENT_RATIO_MEAN",
    "INST_PAYMENT_RATIO_MIN",
    "INST_LATE_COUNT",
)

POS_FEATURES = (
    "POS_RECORD_COUNT",
    "POS_DPD_MEAN",
    "POS_DPD_MAX",
    "POS_DPD_DEF_MEAN",
    "POS_DPD_DEF_MAX",
    "POS_COMPLETED_RATE",
    "POS_ACTIVE_RATE",
    "POS_CNT_INSTALMENT_FUTURE_MEAN",
)

CARD_FEATURES = (
    "CC_RECORD_COUNT",
    "CC_BALANCE_MEAN",
    "CC_LIMIT_MEAN",
    "CC_UTILIZATION_MEAN",
    "CC_PAYMENT_RATIO_MEAN",
    "CC_DPD_MEAN",
    "CC_DPD_MAX",
    "CC_DRAWINGS_ATM_SUM",
    "CC_DRAWINGS_CURRENT_SUM",
)

RARE_MIN_COUNT = 500
MISSING_FLAG_RATE = 0.05

APPROVE_BELOW = 0.15
DECLINE_FROM = 0.35

SPLIT_NAMES = ("train", "val_model", "val_policy", "test")
SPLIT_STARTS = (0.60, 0.70, 0.80)

CELL_MIN_ROWS = 200
CELL_MIN_DEFAULTS = 20
DI_MIN_RATIO = 0.80
EOD_MAX_GAP = 0.10
BRIER_MAX_RATIO = 1.25

REASONS = {
    "CREDIT_INCOME_RATIO": "Requested credit is high relative to stated income",
    "ANNUITY_INCOME_RATIO": "Repayment burden is high relative to stated income",
    "INST_DPD": "Past installment payments show late-payment behavior",
    "BUREAU_": "External credit history indicates elevated repayment risk",
    "CC_": "Credit card utilization or delinquency history indicates elevated risk",
    "POS_": "Past point-of-sale loan behavior indicates elevated risk",
}
DEFAULT_REASON = "Combined application and repayment profile increased model risk"

AUDIT_COLS = (
    "group_value",
    "n",
    "n_defaults",
    "approve_rate",
    "tpr",
    "brier_score",
    "di_ratio",
    "eod",
    "brier_ratio",
    "evaluable",
    "di_pass",
    "eod_pass",
    "brier_pass",
)

# Cell texts a CSV reader takes as missing.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --------------------------------------------------------------------------
# Derived from the lists above.
# --------------------------------------------------------------------------

AGGREGATE_FEATURES = (
    BUREAU_FEATURES + PREVIOUS_FEATURES + INSTALLMENT_FEATURES + POS_FEATURES + CARD_FEATURES
)
REQUIRED_APPLICATION_COLS = NUMERIC_COLS + CATEGORICAL_COLS + ("DAYS_EMPLOYED_ANOM",)


def _doubles(*names):
    return {n: T.DoubleType() for n in names}


_APPLICATION = {
    **APPLICATION_TYPES,
    **_doubles("REGION_POPULATION_RELATIVE", "OWN_CAR_AGE", *SOCIAL_CIRCLE_COLS, *BUREAU_REQUEST_COLS),
    "CODE_GENDER": T.StringType(),
}

# Types of the columns the jobs use; other columns of a file stay strings.
TABLE_TYPES = {
    "application_train": {**_APPLICATION, TARGET: T.IntegerType()},
    "application_test": _APPLICATION,
    "bureau": {
        KEY: T.LongType(),
        "CREDIT_ACTIVE": T.StringType(),
        **_doubles(
            "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE",
            "CREDIT_DAY_OVERDUE", "DAYS_CREDIT", "CNT_CREDIT_PROLONG",
        ),
    },
    "previous_application": {
        LINK_KEY: T.LongType(),
        KEY: T.LongType(),
        "NAME_CONTRACT_STATUS": T.StringType(),
        **_doubles(
            "AMT_APPLICATION", "AMT_CREDIT", "AMT_GOODS_PRICE", "DAYS_DECISION",
            "RATE_DOWN_PAYMENT", *PREVIOUS_SENTINEL_COLS,
        ),
    },
    "installments_payments": {
        LINK_KEY: T.LongType(),
        KEY: T.LongType(),
        **_doubles("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT", "AMT_INSTALMENT", "AMT_PAYMENT"),
    },
    "POS_CASH_balance": {
        LINK_KEY: T.LongType(),
        KEY: T.LongType(),
        "NAME_CONTRACT_STATUS": T.StringType(),
        **_doubles("SK_DPD", "SK_DPD_DEF", "CNT_INSTALMENT_FUTURE"),
    },
    "credit_card_balance": {
        LINK_KEY: T.LongType(),
        KEY: T.LongType(),
        **_doubles(
            "AMT_CREDIT_LIMIT_ACTUAL", "AMT_BALANCE", "AMT_INST_MIN_REGULARITY",
            "AMT_PAYMENT_TOTAL_CURRENT", "SK_DPD", "AMT_DRAWINGS_ATM_CURRENT",
            "AMT_DRAWINGS_CURRENT",
        ),
    },
}
