"""Child tables rolled up to one row per applicant."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.operators import keys as K


@dataclass(frozen=True)
class Measure:
    """One output column, stated as partial aggregates and the way they merge.

    kind: rows | count_if | share | sum | mean | max | min. `value` is SQL text: a
    condition for count_if and share, a number for the others.
    """

    name: str
    kind: str
    value: str | None = None

    def partials(self) -> dict[str, str]:
        n, v = self.name, self.value
        parts = {
            "rows": {f"{n}__n": "count(*)"},
            "count_if": {f"{n}__n": f"count_if({v})"},
            "share": {f"{n}__n": f"count_if({v})", f"{n}__d": "count(*)"},
            "sum": {f"{n}__s": f"sum({v})"},
            "mean": {f"{n}__s": f"sum({v})", f"{n}__d": f"count({v})"},
            "max": {f"{n}__m": f"max({v})"},
            "min": {f"{n}__m": f"min({v})"},
        }
        return parts[self.kind]

    def merged(self) -> str:
        n = self.name
        return {
            "rows": f"sum({n}__n)",
            "count_if": f"sum({n}__n)",
            "share": f"try_divide(sum({n}__n), sum({n}__d))",
            "sum": f"coalesce(sum({n}__s), 0D)",
            "mean": f"try_divide(sum({n}__s), sum({n}__d))",
            "max": f"max({n}__m)",
            "min": f"min({n}__m)",
        }[self.kind]

    def direct(self) -> str:
        v = self.value
        return {
            "rows": "count(*)",
            "count_if": f"count_if({v})",
            "share": f"try_divide(count_if({v}), count(*))",
            "sum": f"coalesce(sum({v}), 0D)",
            "mean": f"avg({v})",
            "max": f"max({v})",
            "min": f"min({v})",
        }[self.kind]


def _aggregate(df, key, named: dict) -> DataFrame:
    """Groups the rows that have a key by it; `named` maps output names to SQL text."""
    rows = df.where(f"{X.quoted(key)} is not null").groupBy(key)
    return rows.agg(*[F.expr(f"{e} as {X.quoted(n)}") for n, e in named.items()])


def aggregate_by_key(df, key, measures) -> DataFrame:
    """One row per non-missing key."""
    return _aggregate(df, key, {m.name: m.direct() for m in measures})


def aggregate_through_parent(
    child, parents, measures, link=S.LINK_KEY, key=S.KEY, name="child", validate=True
) -> DataFrame:
    """One row per key for a child table that only knows its parent's link.

    The child is reduced to one row per link before the join. So the join meets
    unique links on both sides, already partitioned by the link, and a link with a
    third of all child rows weighs no more than any other. Measures then merge by key.
    """
    partials = {}
    for m in measures:
        partials.update(m.partials())
    carries = key in child.columns
    if carries and validate:
        carried = X.quoted(key)
        partials["__key_min"] = f"min({carried})"
        partials["__key_max"] = f"max({carried})"
        partials["__key_absent"] = f"count_if({carried} is null)"
    reduced = _aggregate(child, link, partials)
    joined = reduced.join(K.parent_keys(parents, link, key, validate), link)
    if carries and validate:
        agrees = (
            F.col("__key_min").eqNullSafe(F.col(key))
            & F.col("__key_max").eqNullSafe(F.col(key))
            & ((F.col("__key_absent") == 0) | F.col(key).isNull())
        )
        message = f"{name} rows carry a {key} that differs from their parent's"
        joined = joined.withColumn(
            key,
            F.when(agrees, F.col(key)).otherwise(
                F.raise_error(F.lit(message)).cast(parents.schema[key].dataType)
            ),
        )
    return _aggregate(joined, key, {m.name: m.merged() for m in measures})


def bureau_features(bureau, key=S.KEY) -> DataFrame:
    out = aggregate_by_key(
        bureau,
        key,
        [
            Measure("BUREAU_LOAN_COUNT", "rows"),
            Measure("BUREAU_ACTIVE_COUNT", "count_if", "CREDIT_ACTIVE = 'Active'"),
            Measure("BUREAU_CLOSED_COUNT", "count_if", "CREDIT_ACTIVE = 'Closed'"),
            Measure("BUREAU_AMT_CREDIT_SUM_SUM", "sum", "AMT_CREDIT_SUM"),
            Measure("BUREAU_AMT_CREDIT_SUM_DEBT_SUM", "sum", "AMT_CREDIT_SUM_DEBT"),
            Measure("BUREAU_AMT_CREDIT_SUM_OVERDUE_SUM", "sum", "AMT_CREDIT_SUM_OVERDUE"),
            Measure("BUREAU_CREDIT_DAY_OVERDUE_MAX", "max", "CREDIT_DAY_OVERDUE"),
            Measure("BUREAU_DAYS_CREDIT_MAX", "max", "DAYS_CREDIT"),
            Measure("BUREAU_CNT_CREDIT_PROLONG_SUM", "sum", "CNT_CREDIT_PROLONG"),
        ],
    ).withColumn(
        "BUREAU_DEBT_TO_CREDIT_RATIO",
        X.safe_div("BUREAU_AMT_CREDIT_SUM_DEBT_SUM", "BUREAU_AMT_CREDIT_SUM_SUM"),
    )
    return out.select(key, *S.BUREAU_FEATURES)


def previous_features(previous, key=S.KEY) -> DataFrame:
    out = aggregate_by_key(
        previous,
        key,
        [
            Measure("PREV_APP_COUNT", "rows"),
            Measure("PREV_APPROVED_COUNT", "count_if", "NAME_CONTRACT_STATUS = 'Approved'"),
            Measure("PREV_REFUSED_COUNT", "count_if", "NAME_CONTRACT_STATUS = 'Refused'"),
            Measure("PREV_AMT_APPLICATION_MEAN", "mean", "AMT_APPLICATION"),
            Measure("PREV_AMT_CREDIT_MEAN", "mean", "AMT_CREDIT"),
            Measure("PREV_AMT_GOODS_PRICE_MEAN", "mean", "AMT_GOODS_PRICE"),
            Measure("PREV_APP_CREDIT_DIFF_MEAN", "mean", "AMT_APPLICATION - AMT_CREDIT"),
            Measure("PREV_DAYS_DECISION_MAX", "max", "DAYS_DECISION"),
            Measure("PREV_RATE_DOWN_PAYMENT_MEAN", "mean", "RATE_DOWN_PAYMENT"),
        ],
    ).withColumns(
        {
            "PREV_APPROVAL_RATE": X.safe_div("PREV_APPROVED_COUNT", "PREV_APP_COUNT"),
            "PREV_REFUSAL_RATE": X.safe_div("PREV_REFUSED_COUNT", "PREV_APP_COUNT"),
        }
    )
    return out.select(key, *S.PREVIOUS_FEATURES)


def installment_features(installments, previous, link=S.LINK_KEY, key=S.KEY, validate=True):
    late = X.sql_days_late("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT")
    ratio = X.sql_ratio("AMT_PAYMENT", "AMT_INSTALMENT")
    return aggregate_through_parent(
        installments,
        previous,
        [
            Measure("INST_RECORD_COUNT", "rows"),
            Measure("INST_MISSED_RATE", "share", "DAYS_ENTRY_PAYMENT is null"),
            Measure("INST_DPD_MEAN", "mean", late),
            Measure("INST_DPD_MAX", "max", late),
            Measure("INST_PAYMENT_RATIO_MEAN", "mean", ratio),
            Measure("INST_PAYMENT_RATIO_MIN", "min", ratio),
            Measure("INST_LATE_COUNT", "count_if", f"({late}) > 0"),
        ],
        link, key, "installments", validate,
    )


def pos_features(pos, previous, link=S.LINK_KEY, key=S.KEY, validate=True) -> DataFrame:
    return aggregate_through_parent(
        pos,
        previous,
        [
            Measure("POS_RECORD_COUNT", "rows"),
            Measure("POS_DPD_MEAN", "mean", "SK_DPD"),
            Measure("POS_DPD_MAX", "max", "SK_DPD"),
            Measure("POS_DPD_DEF_MEAN", "mean", "SK_DPD_DEF"),
            Measure("POS_DPD_DEF_MAX", "max", "SK_DPD_DEF"),
            Measure("POS_COMPLETED_RATE", "share", "NAME_CONTRACT_STATUS = 'Completed'"),
            Measure("POS_ACTIVE_RATE", "share", "NAME_CONTRACT_STATUS = 'Active'"),
            Measure("POS_CNT_INSTALMENT_FUTURE_MEAN", "mean", "CNT_INSTALMENT_FUTURE"),
        ],
        link, key, "pos cash", validate,
    )


def card_features(cards, previous, link=S.LINK_KEY, key=S.KEY, validate=True) -> DataFrame:
    used = X.sql_ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL")
    paid = X.sql_ratio("AMT_PAYMENT_TOTAL_CURRENT", "AMT_INST_MIN_REGULARITY")
    return aggregate_through_parent(
        cards,
        previous,
        [
            Measure("CC_RECORD_COUNT", "rows"),
            Measure("CC_BALANCE_MEAN", "mean", "AMT_BALANCE"),
            Measure("CC_LIMIT_MEAN", "mean", "AMT_CREDIT_LIMIT_ACTUAL"),
            Measure("CC_UTILIZATION_MEAN", "mean", used),
            Measure("CC_PAYMENT_RATIO_MEAN", "mean", paid),
            Measure("CC_DPD_MEAN", "mean", "SK_DPD"),
            Measure("CC_DPD_MAX", "max", "SK_DPD"),
            Measure("CC_DRAWINGS_ATM_SUM", "sum", "AMT_DRAWINGS_ATM_CURRENT"),
            Measure("CC_DRAWINGS_CURRENT_SUM", "sum", "AMT_DRAWINGS_CURRENT"),
        ],
        link, key, "credit card", validate,
    )


def full_mart(base, tables, link=S.LINK_KEY, key=S.KEY, validate=True) -> DataFrame:
    """The base with all 45 child-table features, NULL where an applicant has no rows.

    Every roll-up ends partitioned by the key, so the five left joins move only the
    base, once. They are unique on the key by construction; only the base is checked.
    """
    if validate:
        K.assert_unique_key(base, key, "base")
    previous = tables["previous_application"]
    parts = [
        bureau_features(tables["bureau"], key),
        previous_features(previous, key),
        installment_features(tables["installments_payments"], previous, link, key, validate),
        pos_features(tables["POS_CASH_balance"], previous, link, key, validate),
        card_features(tables["credit_card_balance"], previous, link, key, validate),
    ]
    for part in parts:
        base = K.left_one_to_one(base, part, key, validate=False)
    return base
