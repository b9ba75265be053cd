"""Scans, projections, joins, child-table roll-ups and the feature builder."""

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F, types as T

from checks.frames import (
    BUREAU, check, round_columns, rounded, rounded_sql, scratch, shape, shape_sql, table, with_shapes,
)
from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.lineage import materialize
from riskmart.operators import (
    aggregates as A, categories as C, encoding as EN, evaluate as E, features as FE, keys as K,
)
from riskmart.plans import jobs
from riskmart.sources import tables as IO
from riskmart.streaming import scoring

MIN_COUNT = 60      # pooling threshold fit for the size of the test tables


# -- scans and keys ----------------------------------------------------------

@check("prev_keys", """
    select distinct o_orderkey as "SK_ID_PREV", o_custkey as "SK_ID_CURR" from orders
""")
def prev_keys(spark, d):
    return K.parent_keys(shape(spark, d, "previous"))


@check("schema_cast", """
    select cast(p_partkey as bigint) as p_partkey, cast(p_size as double) as p_size,
           cast(p_retailprice as varchar) as p_retailprice, p_name,
           cast(p_partkey as double) as as_text
    from part
""")
def schema_cast(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey", "p_size", "p_retailprice", "p_name", F.col("p_partkey").cast("string").alias("as_text")
    )
    types = {
        "p_partkey": T.LongType(), "p_size": T.DoubleType(), "p_retailprice": T.StringType(),
        "as_text": T.DoubleType(), "not_there": T.LongType(),
    }
    return IO.enforce_schema(part, types)


@check("dup_keys", """
    select 'orders' as name, count(*) - count(distinct o_orderkey) as surplus from orders
    union all
    select 'lineitem', count(*) - count(distinct l_orderkey) from lineitem
    union all
    select 'clerks', count(*) - count(distinct k) - max(case when k is null then 1 else 0 end)
    from (select nullif(l_partkey, 3) as k from lineitem)
""")
def dup_keys(spark, d):
    lines = table(spark, d, "lineitem")
    frames = {
        "orders": (table(spark, d, "orders"), "o_orderkey"),
        "lineitem": (lines, "l_orderkey"),
        "clerks": (lines.selectExpr("nullif(l_partkey, 3) as k"), "k"),
    }
    out = [K.surplus_rows(df, k).select(F.lit(n).alias("name"), "surplus") for n, (df, k) in frames.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@check("left_one_to_one", f"""
    select c_custkey, c_mktsegment, cast(n_orders as double) as n_orders, {rounded_sql("total", 4)} as total
    from customer left join (
        select o_custkey, count(*) as n_orders, sum(o_totalprice) as total
        from orders group by o_custkey
    ) on c_custkey = o_custkey
""")
def left_one_to_one(spark, d):
    features = (
        table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    )
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    out = K.left_one_to_one(base, features, "c_custkey")
    return round_columns(out, {"total": 4}).withColumn("n_orders", F.col("n_orders").cast("double"))


# Unfinished orders get a link of their own: parents without children, and children without a parent.
LINK = "case when o_orderstatus = 'P' then -o_orderkey else o_orderkey end"


@check("many_to_one_inner", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_custkey
    from lineitem join (select """ + LINK + """ as link, o_custkey from orders) on l_orderkey = link
""")
def many_to_one_inner(spark, d):
    child = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    ).withColumnRenamed("l_orderkey", "o_orderkey")
    parents = table(spark, d, "orders").withColumn("o_orderkey", F.expr(LINK))
    joined = K.many_to_one_inner(child, parents, "o_orderkey", "o_custkey", "lines")
    return joined.withColumnRenamed("o_orderkey", "l_orderkey")


@check("key_conflicts", """
    select count(*) as n_rows,
           count(*) filter (where carried is distinct from o_custkey) as n_conflicts
    from orders join (
        select l_orderkey, case when l_linenumber = 7 then null when l_quantity = 50 then l_suppkey
                                else c end as carried
        from lineitem join (select o_orderkey as k, o_custkey as c from orders) on k = l_orderkey
    ) on """ + LINK + """ = l_orderkey
""")
def key_conflicts(spark, d):
    orders = table(spark, d, "orders")
    carried = table(spark, d, "lineitem").join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c")), "l_orderkey"
    ).selectExpr(
        "l_orderkey as o_orderkey",
        "case when l_linenumber = 7 then null when l_quantity = 50 then l_suppkey else c end as o_custkey",
    )
    return K.key_conflicts(carried, orders.withColumn("o_orderkey", F.expr(LINK)), "o_orderkey", "o_custkey")


@check("prefix_columns", """
    select c_custkey, c_name as "CUST_C_NAME", c_nationkey as "CUST_C_NATIONKEY",
           c_acctbal as "CUST_C_ACCTBAL", c_mktsegment as "CUST_C_MKTSEGMENT" from customer
""")
def prefix_columns(spark, d):
    return K.prefix_columns(table(spark, d, "customer"), "cust", "c_custkey")


@check("align_columns", """
    select s_acctbal, cast(null as double) as s_limit, s_suppkey, cast(null as varchar) as s_phone
    from supplier
""")
def align_columns(spark, d):
    expected = {
        "s_acctbal": T.DoubleType(), "s_limit": T.DoubleType(), "s_suppkey": T.LongType(),
        "s_phone": T.StringType(),
    }
    return K.align_columns(table(spark, d, "supplier"), expected)


# -- row expressions ---------------------------------------------------------

@check("sentinel_clean", with_shapes("application", "previous") + """
    , cleaned as (select "SK_ID_PREV" as id, """ + ", ".join(
        f'cast(coalesce("{c}" = 365243, false) as int) as "{c}_ANOM", nullif("{c}", 365243) as "{c}"'
        for c in S.PREVIOUS_SENTINEL_COLS
    ) + """ from previous)
    select cleaned.*, cast(a."DAYS_EMPLOYED_ANOM" as double) as "DAYS_EMPLOYED_ANOM", a."DAYS_EMPLOYED" from cleaned left join (
        select "SK_ID_CURR" as id, cast(coalesce("DAYS_EMPLOYED" = 365243, false) as int) as "DAYS_EMPLOYED_ANOM",
               nullif("DAYS_EMPLOYED", 365243) as "DAYS_EMPLOYED" from application) a using (id)
""")
def sentinel_clean(spark, d):
    flags = [f"{c}_ANOM" for c in S.PREVIOUS_SENTINEL_COLS]
    previous = jobs.clean_previous(shape(spark, d, "previous")).select(
        F.col("SK_ID_PREV").alias("id"),
        *[F.col(c).cast("int").alias(c) for c in flags],
        *S.PREVIOUS_SENTINEL_COLS,
    )
    app = jobs.clean_application(shape(spark, d, "application")).select(
        F.col("SK_ID_CURR").alias("id"), F.col("DAYS_EMPLOYED_ANOM").cast("double").alias("DAYS_EMPLOYED_ANOM"),
        "DAYS_EMPLOYED",
    )
    return previous.join(app, "id", "left")


@check("safe_div", f"""
    select l_orderkey, l_linenumber,
           {rounded_sql("l_extendedprice / nullif(l_tax, 0)", 4)} as price_by_tax,
           {rounded_sql("nullif(l_discount, 0) / nullif(l_quantity - 1, 0)", 8)} as discount_by_rest
    from lineitem
""")
def safe_div(spark, d):
    out = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        X.safe_div("l_extendedprice", "l_tax").alias("price_by_tax"),
        X.safe_div(F.nullif("l_discount", F.lit(0.0)), F.col("l_quantity") - 1).alias("discount_by_rest"),
    )
    return round_columns(out, {"price_by_tax": 4, "discount_by_rest": 8})


SQL_APP_FEATURES = {
    "AGE_YEARS": "-DAYS_BIRTH / 365",
    "CREDIT_INCOME_RATIO": "AMT_CREDIT / nullif(AMT_INCOME_TOTAL_CAPPED, 0)",
    "ANNUITY_INCOME_RATIO": "AMT_ANNUITY / nullif(AMT_INCOME_TOTAL_CAPPED, 0)",
    "GOODS_CREDIT_RATIO": "AMT_GOODS_PRICE / nullif(AMT_CREDIT, 0)",
    "CREDIT_TERM_RATIO": "AMT_ANNUITY / nullif(AMT_CREDIT, 0)",
    "EMPLOYED_BIRTH_RATIO": "DAYS_EMPLOYED / nullif(DAYS_BIRTH, 0)",
    "ID_PUBLISH_REG_RATIO": "DAYS_ID_PUBLISH / nullif(DAYS_REGISTRATION, 0)",
    "EXT_SOURCE_MEAN": "list_aggregate([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3], 'avg')",
    "EXT_SOURCE_STD": "list_aggregate([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3], 'stddev_samp')",
    "SOCIAL_CIRCLE_SUM": "coalesce(list_aggregate([" + ", ".join(S.SOCIAL_CIRCLE_COLS) + "], 'sum'), 0)",
    "BUREAU_REQUEST_SUM": "coalesce(list_aggregate([" + ", ".join(S.BUREAU_REQUEST_COLS) + "], 'sum'), 0)",
}

# Cleaned application rows with the engineered columns, as SQL.
CLEAN_SQL = f"""(
    select * replace (nullif(DAYS_EMPLOYED, 365243) as DAYS_EMPLOYED),
           cast(coalesce(DAYS_EMPLOYED = 365243, false) as int) as "DAYS_EMPLOYED_ANOM"
    from {shape_sql("application")})"""
ENGINEERED_SQL = (
    "(select *, " + ", ".join(f'{e} as "{n}"' for n, e in SQL_APP_FEATURES.items()) + f" from {CLEAN_SQL})"
)


def cleaned(spark, d):
    return jobs.clean_application(shape(spark, d, "application", spread=True))


@check("app_features", "select SK_ID_CURR, DAYS_EMPLOYED_ANOM, " + ", ".join(
    f'{rounded_sql(n)} as "{n}"' for n in SQL_APP_FEATURES) + f" from {ENGINEERED_SQL}")
def app_features(spark, d):
    out = FE.application_features(cleaned(spark, d))
    return out.select(
        "SK_ID_CURR", F.col("DAYS_EMPLOYED_ANOM").cast("int").alias("DAYS_EMPLOYED_ANOM"),
        *[rounded(n).alias(n) for n in SQL_APP_FEATURES],
    )


@check("decision_band", with_shapes("audit") + """
    select SK_ID_CURR, case when CALIBRATED_PD < 0.15 then 'APPROVE' when CALIBRATED_PD < 0.35 then 'REVIEW'
                       else 'DECLINE' end as decision from audit
""")
def decision_band(spark, d):
    return shape(spark, d, "audit").select("SK_ID_CURR", X.decision_band("CALIBRATED_PD").alias("decision"))


@check("reason_text", "select p_partkey, name, case " + " ".join(
    f"when starts_with(name, '{k}') then '{v}'" for k, v in S.REASONS.items()
) + f" else '{S.DEFAULT_REASON}' end as reason from (" + """
    select p_partkey, case p_type when 'ECONOMY' then 'CC_' when 'STANDARD' then 'BUREAU_' when 'PROMO' then 'cc_'
                      when 'LARGE' then 'INST_DPD_' when 'MEDIUM' then 'CREDIT_INCOME_RATIO' else 'POS_' end
                      || p_brand as name from part)
""")
def reason_text(spark, d):
    named = table(spark, d, "part").selectExpr(
        "p_partkey",
        "case p_type when 'ECONOMY' then 'CC_' when 'STANDARD' then 'BUREAU_' when 'PROMO' then 'cc_' "
        "when 'LARGE' then 'INST_DPD_' when 'MEDIUM' then 'CREDIT_INCOME_RATIO' else 'POS_' end || p_brand as name",
    )
    return named.withColumn("reason", X.reason_text("name"))


# -- roll-ups ----------------------------------------------------------------

def _agg_sql(source, key_from, exprs, digits, where="true"):
    cols = ", ".join(
        f'{rounded_sql(e, digits[n]) if n in digits else e} as "{n}"' for n, e in exprs.items()
    )
    return f"select SK_ID_CURR, {cols} from {source} {key_from} where {where} group by SK_ID_CURR"


THROUGH = f" join (select {LINK} as SK_ID_PREV, o_custkey as SK_ID_CURR from orders) using (SK_ID_PREV)"

BUREAU_SQL = {
    "BUREAU_LOAN_COUNT": "count(*)",
    "BUREAU_ACTIVE_COUNT": "count(*) filter (where CREDIT_ACTIVE = 'Active')",
    "BUREAU_CLOSED_COUNT": "count(*) filter (where CREDIT_ACTIVE = 'Closed')",
    "BUREAU_AMT_CREDIT_SUM_SUM": "coalesce(sum(AMT_CREDIT_SUM), 0)",
    "BUREAU_AMT_CREDIT_SUM_DEBT_SUM": "coalesce(sum(AMT_CREDIT_SUM_DEBT), 0)",
    "BUREAU_DEBT_TO_CREDIT_RATIO":
        "coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) / nullif(coalesce(sum(AMT_CREDIT_SUM), 0), 0)",
    "BUREAU_AMT_CREDIT_SUM_OVERDUE_SUM": "coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0)",
    "BUREAU_CREDIT_DAY_OVERDUE_MAX": "max(CREDIT_DAY_OVERDUE)",
    "BUREAU_DAYS_CREDIT_MAX": "max(DAYS_CREDIT)",
    "BUREAU_CNT_CREDIT_PROLONG_SUM": "coalesce(sum(CNT_CREDIT_PROLONG), 0)",
}
PREVIOUS_SQL = {
    "PREV_APP_COUNT": "count(*)",
    "PREV_APPROVED_COUNT": "count(*) filter (where NAME_CONTRACT_STATUS = 'Approved')",
    "PREV_REFUSED_COUNT": "count(*) filter (where NAME_CONTRACT_STATUS = 'Refused')",
    "PREV_APPROVAL_RATE": "count(*) filter (where NAME_CONTRACT_STATUS = 'Approved') / count(*)",
    "PREV_REFUSAL_RATE": "count(*) filter (where NAME_CONTRACT_STATUS = 'Refused') / count(*)",
    "PREV_AMT_APPLICATION_MEAN": "avg(AMT_APPLICATION)",
    "PREV_AMT_CREDIT_MEAN": "avg(AMT_CREDIT)",
    "PREV_AMT_GOODS_PRICE_MEAN": "avg(AMT_GOODS_PRICE)",
    "PREV_APP_CREDIT_DIFF_MEAN": "avg(AMT_APPLICATION - AMT_CREDIT)",
    "PREV_DAYS_DECISION_MAX": "max(DAYS_DECISION)",
    "PREV_RATE_DOWN_PAYMENT_MEAN": "avg(RATE_DOWN_PAYMENT)",
}
_LATE = ("case when DAYS_ENTRY_PAYMENT is not null and DAYS_INSTALMENT is not null"
         " then greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0) end")
_RATIO = "case when AMT_INSTALMENT > 0 and AMT_PAYMENT is not null then AMT_PAYMENT / AMT_INSTALMENT end"
INSTALLMENT_SQL = {
    "INST_RECORD_COUNT": "count(*)",
    "INST_MISSED_RATE": "avg(cast(DAYS_ENTRY_PAYMENT is null as int))",
    "INST_DPD_MEAN": f"avg({_LATE})",
    "INST_DPD_MAX": f"max({_LATE})",
    "INST_PAYMENT_RATIO_MEAN": f"avg({_RATIO})",
    "INST_PAYMENT_RATIO_MIN": f"min({_RATIO})",
    "INST_LATE_COUNT": f"count(*) filter (where ({_LATE}) > 0)",
}
POS_SQL = {
    "POS_RECORD_COUNT": "count(*)",
    "POS_DPD_MEAN": "avg(SK_DPD)",
    "POS_DPD_MAX": "max(SK_DPD)",
    "POS_DPD_DEF_MEAN": "avg(SK_DPD_DEF)",
    "POS_DPD_DEF_MAX": "max(SK_DPD_DEF)",
    "POS_COMPLETED_RATE": "count(*) filter (where NAME_CONTRACT_STATUS = 'Completed') / count(*)",
    "POS_ACTIVE_RATE": "count(*) filter (where NAME_CONTRACT_STATUS = 'Active') / count(*)",
    "POS_CNT_INSTALMENT_FUTURE_MEAN": "avg(CNT_INSTALMENT_FUTURE)",
}
CARD_SQL = {
    "CC_RECORD_COUNT": "count(*)",
    "CC_BALANCE_MEAN": "avg(AMT_BALANCE)",
    "CC_LIMIT_MEAN": "avg(AMT_CREDIT_LIMIT_ACTUAL)",
    "CC_UTILIZATION_MEAN": "avg(case when AMT_CREDIT_LIMIT_ACTUAL > 0 then AMT_BALANCE / AMT_CREDIT_LIMIT_ACTUAL end)",
    "CC_PAYMENT_RATIO_MEAN":
        "avg(case when AMT_INST_MIN_REGULARITY > 0 then AMT_PAYMENT_TOTAL_CURRENT / AMT_INST_MIN_REGULARITY end)",
    "CC_DPD_MEAN": "avg(SK_DPD)",
    "CC_DPD_MAX": "max(SK_DPD)",
    "CC_DRAWINGS_ATM_SUM": "coalesce(sum(AMT_DRAWINGS_ATM_CURRENT), 0)",
    "CC_DRAWINGS_CURRENT_SUM": "coalesce(sum(AMT_DRAWINGS_CURRENT), 0)",
}

# Places per column: money to 4, other fractions to 6; counts are exact.
DIGITS = {
    **{n: 4 for n in ("BUREAU_AMT_CREDIT_SUM_SUM", "BUREAU_AMT_CREDIT_SUM_DEBT_SUM",
                      "BUREAU_AMT_CREDIT_SUM_OVERDUE_SUM", "PREV_AMT_APPLICATION_MEAN",
                      "PREV_AMT_CREDIT_MEAN", "PREV_AMT_GOODS_PRICE_MEAN", "PREV_APP_CREDIT_DIFF_MEAN")},
    **{n: 6 for n in S.AGGREGATE_FEATURES
       if n.endswith(("_RATE", "_RATIO", "_MEAN", "_MIN")) and not n.startswith("PREV_A")},
    "PREV_APPROVAL_RATE": 6,
}


def _mart_digits(names):
    return {n: DIGITS[n] for n in names if n in DIGITS}


def parents(spark, d):
    return table(spark, d, "orders").selectExpr(f"{LINK} as SK_ID_PREV", "o_custkey as SK_ID_CURR")


@check("agg_bureau", _agg_sql(shape_sql("bureau"), "", BUREAU_SQL, DIGITS))
def agg_bureau(spark, d):
    return round_columns(A.bureau_features(shape(spark, d, "bureau")), _mart_digits(S.BUREAU_FEATURES))


@check("agg_previous", _agg_sql(shape_sql("previous"), "", PREVIOUS_SQL, DIGITS))
def agg_previous(spark, d):
    return round_columns(A.previous_features(shape(spark, d, "previous")), _mart_digits(S.PREVIOUS_FEATURES))


@check("agg_installments", _agg_sql(shape_sql("installments"), THROUGH, INSTALLMENT_SQL, DIGITS))
def agg_installments(spark, d):
    out = A.installment_features(shape(spark, d, "installments"), parents(spark, d))
    return round_columns(out, _mart_digits(S.INSTALLMENT_FEATURES))


@check("agg_pos", _agg_sql(shape_sql("pos"), THROUGH, POS_SQL, DIGITS))
def agg_pos(spark, d):
    return round_columns(A.pos_features(shape(spark, d, "pos"), parents(spark, d)), _mart_digits(S.POS_FEATURES))


@check("agg_card", _agg_sql(shape_sql("card"), THROUGH, CARD_SQL, DIGITS))
def agg_card(spark, d):
    return round_columns(A.card_features(shape(spark, d, "card"), parents(spark, d)), _mart_digits(S.CARD_FEATURES))


def mart_tables(spark, d):
    """The five child tables, whole. A third of the customers have no order, so no rows in any."""
    return {
        "bureau": shape(spark, d, "bureau"),
        "previous_application": shape(spark, d, "previous").withColumn(
            "SK_ID_PREV", F.expr("case when NAME_CONTRACT_STATUS is null then -SK_ID_PREV else SK_ID_PREV end")
        ),
        "installments_payments": shape(spark, d, "installments"),
        "POS_CASH_balance": shape(spark, d, "pos"),
        "credit_card_balance": shape(spark, d, "card"),
    }


def mart_joins(digits):
    parts = [
        (shape_sql("bureau"), "", BUREAU_SQL), (shape_sql("previous"), "", PREVIOUS_SQL),
        (shape_sql("installments"), THROUGH, INSTALLMENT_SQL), (shape_sql("pos"), THROUGH, POS_SQL),
        (shape_sql("card"), THROUGH, CARD_SQL),
    ]
    return " ".join(f"left join ({_agg_sql(s, k, e, digits)}) using (SK_ID_CURR)" for s, k, e in parts)


@check("full_mart", f"""
    select SK_ID_CURR, segment, {", ".join(f'cast("{c}" as double) as "{c}"' for c in S.AGGREGATE_FEATURES)}
    from (select c_custkey as SK_ID_CURR, c_mktsegment as segment from customer)
    {mart_joins(DIGITS)}
""")
def full_mart(spark, d):
    base = table(spark, d, "customer").selectExpr("c_custkey as SK_ID_CURR", "c_mktsegment as segment")
    mart = round_columns(A.full_mart(base, mart_tables(spark, d)), _mart_digits(S.AGGREGATE_FEATURES))
    return mart.select("SK_ID_CURR", "segment", *[F.col(c).cast("double").alias(c) for c in S.AGGREGATE_FEATURES])


# -- policies ----------------------------------------------------------------

POLICY_COLS = [
    "DAYS_EMPLOYED", "DAYS_REGISTRATION", "OWN_CAR_AGE", "EXT_SOURCE_1", "EXT_SOURCE_3",
    "OCCUPATION_TYPE", "NAME_TYPE_SUITE", "NAME_CONTRACT_TYPE",
]
POLICY_NUMERIC = POLICY_COLS[:5]
POLICY_TEXT = POLICY_COLS[5:]
FLAGGED = "avg(cast({c} is null as int)) >= 0.05"


def policy_frame(spark, d):
    return cleaned(spark, d).select("SK_ID_CURR", *POLICY_COLS)


def _policy_fit_sql():
    rows = []
    for c in POLICY_COLS:
        number = f"quantile_cont({c}, 0.5)" if c in POLICY_NUMERIC else "cast(null as double)"
        text = (
            "cast(null as varchar)" if c in POLICY_NUMERIC else
            f"(select {c} from {CLEAN_SQL} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
        )
        rows.append(
            f"select '{c}' as name, {number} as median, {text} as most_frequent from {CLEAN_SQL}"
            f" having {FLAGGED.format(c=c)}"
        )
    return f"select name, {rounded_sql('median')} as median, most_frequent from (" + " union all ".join(rows) + ")"


def _rows(spark, cells):
    """A few driver-side results as a frame."""
    return spark.range(1).select(F.inline(F.array(*cells))) if cells else None


@check("missing_policy_fit", _policy_fit_sql())
def missing_policy_fit(spark, d):
    flags, medians, modes = FE.fit_missing_policy(policy_frame(spark, d))
    cells = [
        F.struct(
            F.lit(c).alias("name"), F.lit(medians.get(c)).cast("double").alias("median"),
            F.lit(modes.get(c)).cast("string").alias("most_frequent"),
        )
        for c in flags
    ]
    return round_columns(_rows(spark, cells), {"median": 6})


def _policy_apply_sql():
    cols = []
    for c in POLICY_COLS:
        hit = f"(select {FLAGGED.format(c=c)} from {CLEAN_SQL})"
        if c in POLICY_NUMERIC:
            fill = f"(select quantile_cont({c}, 0.5) from {CLEAN_SQL})"
            cols.append(f"{rounded_sql(f'case when {hit} then coalesce({c}, {fill}) else {c} end')} as {c}")
        else:
            fill = (f"(select {c} from {CLEAN_SQL} where {c} is not null group by {c}"
                    f" order by count(*) desc, {c} limit 1)")
            cols.append(f"case when {hit} then coalesce({c}, {fill}) else {c} end as {c}")
        cols.append(f"case when {hit} then cast({c} is null as int) end as {c}_IS_MISSING")
    return f"select SK_ID_CURR, {', '.join(cols)} from {CLEAN_SQL}"


def _with_all_flags(df, columns):
    """Flag columns of every candidate, NULL for those without a flag."""
    return df.select(
        *[c for c in df.columns if not c.endswith(FE.FLAG_SUFFIX)],
        *[
            (F.col(c + FE.FLAG_SUFFIX).cast("int") if c + FE.FLAG_SUFFIX in df.columns else F.lit(None).cast("int"))
            .alias(c + FE.FLAG_SUFFIX)
            for c in columns
        ],
    )


@check("missing_policy_apply", _policy_apply_sql())
def missing_policy_apply(spark, d):
    df = policy_frame(spark, d)
    out = FE.apply_missing_policy(df, *FE.fit_missing_policy(df), for_linear=True)
    return round_columns(_with_all_flags(out, POLICY_COLS), {c: 6 for c in POLICY_NUMERIC})


@check("flag_fit", " union all ".join(
    f"select '{c}' as name from {CLEAN_SQL} having {FLAGGED.format(c=c)}" for c in POLICY_NUMERIC))
def flag_fit(spark, d):
    flags = FE.fit_missing_flags(policy_frame(spark, d), POLICY_NUMERIC)
    return _rows(spark, [F.struct(F.lit(c).alias("name")) for c in flags])


@check("flag_apply", "select SK_ID_CURR, " + ", ".join(
    f"cast({c} is null as int) as {c}_IS_MISSING" for c in POLICY_NUMERIC) + f" from {CLEAN_SQL}")
def flag_apply(spark, d):
    out = FE.apply_missing_flags(policy_frame(spark, d), POLICY_NUMERIC)
    return _with_all_flags(out, POLICY_NUMERIC).select("SK_ID_CURR", *[f"{c}_IS_MISSING" for c in POLICY_NUMERIC])


@check("imputer_fit", " union all ".join(
    f"select '{c}' as name, {rounded_sql(f'coalesce(quantile_cont({c}, 0.5), 0)')} as median from {CLEAN_SQL}"
    for c in POLICY_NUMERIC))
def imputer_fit(spark, d):
    fitted = FE.fit_imputers(policy_frame(spark, d), POLICY_NUMERIC)
    cells = [F.struct(F.lit(c).alias("name"), F.lit(v).alias("median")) for c, v in fitted.items()]
    return round_columns(_rows(spark, cells), {"median": 6})


@check("imputer_apply", "select SK_ID_CURR, " + ", ".join(
    rounded_sql(f"coalesce({c}, (select quantile_cont({c}, 0.5) from {CLEAN_SQL}))") + f" as {c}"
    for c in POLICY_NUMERIC) + f" from {CLEAN_SQL}")
def imputer_apply(spark, d):
    df = policy_frame(spark, d).select("SK_ID_CURR", *POLICY_NUMERIC)
    return round_columns(FE.apply_fill(df, FE.fit_imputers(df, POLICY_NUMERIC)), {c: 6 for c in POLICY_NUMERIC})


def _sd_sql(c):
    filled = f"coalesce({c}, (select coalesce(quantile_cont({c}, 0.5), 0) from {CLEAN_SQL}))"
    return f"(select coalesce(nullif(stddev_pop({filled}), 0), 1) from {CLEAN_SQL})"


@check("scaler_fit", " union all ".join(
    f"select '{c}' as name, {rounded_sql(_sd_sql(c))} as scale" for c in POLICY_NUMERIC))
def scaler_fit(spark, d):
    df = policy_frame(spark, d)
    fitted = FE.fit_scaler(df, POLICY_NUMERIC)
    cells = [F.struct(F.lit(c).alias("name"), F.lit(v).alias("scale")) for c, v in fitted.items()]
    return round_columns(_rows(spark, cells), {"scale": 6})


@check("scaler_apply", "select SK_ID_CURR, " + ", ".join(
    rounded_sql(f"{c} / {_sd_sql(c)}") + f" as {c}" for c in POLICY_NUMERIC) + f" from {CLEAN_SQL}")
def scaler_apply(spark, d):
    df = policy_frame(spark, d).select("SK_ID_CURR", *POLICY_NUMERIC)
    scales = FE.fit_scaler(df, POLICY_NUMERIC)
    return round_columns(FE.apply_scaler(df, scales), {c: 6 for c in POLICY_NUMERIC})


# -- categories --------------------------------------------------------------

CATS = list(S.CATEGORICAL_COLS)


@check("pool_rare", f"""
    select SK_ID_CURR, OCCUPATION_TYPE,
        case when count(*) over (partition by OCCUPATION_TYPE) >= {MIN_COUNT} then OCCUPATION_TYPE else 'OTHER' end
        as pooled from {shape_sql("application")}
""")
def pool_rare(spark, d):
    df = shape(spark, d, "application").select("SK_ID_CURR", "OCCUPATION_TYPE")
    return C.pool_rare(df, "OCCUPATION_TYPE", MIN_COUNT, "pooled")


@check("rare_map_fit", " union all ".join(
    f"select '{c}' as \"column\", coalesce({c}, 'MISSING') as value, count(*) as n from {shape_sql('application')}"
    f" group by 2 having count(*) >= {MIN_COUNT}" for c in CATS))
def rare_map_fit(spark, d):
    return C.rare_map(shape(spark, d, "application"), CATS, MIN_COUNT)


def pooled_sql(c, source):
    return (f"case when count(*) over (partition by coalesce({c}, 'MISSING')) >= {MIN_COUNT}"
            f" then coalesce({c}, 'MISSING') else 'OTHER' end")


@check("rare_map_apply", "select SK_ID_CURR, " + ", ".join(
    f"{pooled_sql(c, '')} as {c}" for c in CATS) + f" from {shape_sql('application')}")
def rare_map_apply(spark, d):
    df = shape(spark, d, "application").select("SK_ID_CURR", *CATS)
    kept, _ = C.fit_rare_map(df, CATS, MIN_COUNT)
    return C.apply_rare_map(df, kept)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER"]


@check("one_hot", "select SK_ID_CURR, TARGET, " + ", ".join(
    f'cast(NAME_CONTRACT_TYPE = \'{v}\' as double) as "NAME_CONTRACT_TYPE_{v}"' for v in SEGMENTS
) + f" from {shape_sql('application')}")
def one_hot(spark, d):
    df = shape(spark, d, "application").select("SK_ID_CURR", "NAME_CONTRACT_TYPE", "TARGET")
    return FE.one_hot(df, [("NAME_CONTRACT_TYPE", v) for v in SEGMENTS])


# -- matrices ----------------------------------------------------------------

def long_matrix(matrix, model):
    """(key, feature, value) rows: the columns of a matrix depend on the data."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in model.encoded_columns]
    )
    return round_columns(matrix.select("SK_ID_CURR", F.inline(cells)), {"value": 6})


def _matrix_sql(tier, linear):
    numeric = FE.numeric_inputs(tier)
    source = f"(select * from {ENGINEERED_SQL} {mart_joins({}) if tier == FE.FULL else ''})"
    parts = []
    for c in numeric:
        value = f"cast({c} as double)"
        if linear:
            value = (f"coalesce({value}, (select coalesce(quantile_cont({c}, 0.5), 0) from src)) / "
                     f"(select coalesce(nullif(case when stddev_pop(v) < 1e-9 then 0 else stddev_pop(v) end, 0), 1) from "
                     f"(select coalesce({c}, (select coalesce(quantile_cont({c}, 0.5), 0) from src)) as v from src))")
        parts.append(f"select SK_ID_CURR, '{c}' as feature, {rounded_sql(value)} as value from src")
        parts.append(
            f"select SK_ID_CURR, '{c}_IS_MISSING', cast({c} is null as int) from src"
            f" where (select {FLAGGED.format(c=c)} from src)"
        )
    for c in CATS:
        pooled = f"(select SK_ID_CURR as k, {pooled_sql(c, '')} as v from src)"
        parts.append(
            f"select k, '{c}_' || d.v, cast(p.v = d.v as double) from {pooled} p,"
            f" (select distinct v from {pooled}) d"
        )
    return f"with src as materialized {source} " + " union all ".join(parts)


@check("matrix_reduced", _matrix_sql(FE.REDUCED, True))
def matrix_reduced(spark, d):
    """Fit and linear transform of the REDUCED tier: imputed and scaled."""
    app = cleaned(spark, d)
    model = FE.fit_reduced_builder(app, minCount=MIN_COUNT)
    return long_matrix(FE.build_reduced(app, model, for_linear=True), model)


@check("matrix_full", _matrix_sql(FE.FULL, False))
def matrix_full(spark, d):
    """FULL tier, plain: the mart is stored once, fitted on, and transformed from the row."""
    frame = materialize(FE.pre_model_frame(cleaned(spark, d), FE.FULL, mart_tables(spark, d)))
    model = FE.fit_builder(frame, FE.FULL, minCount=MIN_COUNT)
    return long_matrix(FE.build_full(frame, model), model)


# -- storage -----------------------------------------------------------------

BUREAU_CSV = ["SK_ID_CURR", "CREDIT_ACTIVE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "DAYS_CREDIT"]
# columns whose types are not listed; one value decides where the others would fit a narrower type
UNLISTED = {
    "EXTRA_WHOLE": "case when o_orderkey % 3 = 0 then null else o_orderkey * 7 end",
    "EXTRA_NUMBER": "case when o_orderkey = 1 then 5e-1 else cast(o_orderkey as double) end",
    "EXTRA_TEXT": "case when o_orderkey = 1 then '1-A' else cast(o_orderkey as string) end",
}


@check("csv_scan", f"""select {", ".join(f"{e} as {c}" for c, e in [*((c, BUREAU[c]) for c in BUREAU_CSV), *UNLISTED.items()])} from orders""")
def csv_scan(spark, d):
    """Orders as a CSV bureau table, missing values written as NA, read back with given and inferred types."""
    path = scratch(spark, "csv")
    extra = [f"{e} as {c}" for c, e in UNLISTED.items()]
    bureau = table(spark, d, "orders").selectExpr(*[f"{e} as {c}" for c, e in BUREAU.items()], *extra)
    bureau.write.option("header", True).option("nullValue", "NA").csv(f"{path}/bureau.csv")
    return IO.read_table(spark, path, "bureau", columns=[*BUREAU_CSV, *UNLISTED])


@check("split_source", """
    select o_orderkey, o_totalprice from orders where o_orderstatus = 'P'
""")
def split_source(spark, d):
    """Writes orders in one folder per status, verifies them, and reads one back."""
    path = scratch(spark, "split")
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    IO.write_split(orders, path, "o_orderstatus")
    IO.verify_written(orders, path, "o_orderstatus")
    return IO.read_split(spark, path, "P", "o_orderstatus", names=("F", "O", "P"))


SCORE_COLS = {"EXT_SOURCE_2": 0.5, "EXT_SOURCE_3": 0.5, "CNT_FAM_MEMBERS": 0.0, "DAYS_LAST_PHONE_CHANGE": 0.0}


def _bayes_sql():
    """Log likelihoods of a Gaussian naive Bayes model, fitted and applied."""
    stats = ", ".join(
        f"avg(x{i}) filter (TARGET = {t}) as m{i}_{t}, var_pop(x{i}) filter (TARGET = {t}) + e as v{i}_{t}"
        for i in range(len(SCORE_COLS)) for t in (0, 1)
    )
    smooth = "1e-9 * greatest(" + ", ".join(f"var_pop(x{i})" for i in range(len(SCORE_COLS))) + ")"
    logs = [
        f"ln(n{t}) " + " ".join(
            f"- 5e-1 * (ln(v{i}_{t}) + (x{i} - m{i}_{t}) * (x{i} - m{i}_{t}) / v{i}_{t})" for i in range(len(SCORE_COLS)))
        for t in (0, 1)
    ]
    inputs = ", ".join(f"coalesce({c}, cast({v} as double)) as x{i}" for i, (c, v) in enumerate(SCORE_COLS.items()))
    return f"""
        inputs as (select SK_ID_CURR, TARGET, {inputs} from {shape_sql("application")}),
        smooth as (select {smooth} as e from inputs),
        model as (select {stats}, count(*) filter (TARGET = 0) as n0, count(*) filter (TARGET = 1) as n1 from inputs, smooth group by e),
        raw as (select SK_ID_CURR, TARGET, 1 / (1 + exp(({logs[0]}) - ({logs[1]}))) as pd from inputs, model)"""


@check("batch_score", f"""with {_bayes_sql()},
    cells as (select pd, count(*) as n, sum(TARGET) as k, row_number() over (order by pd) as i from raw group by pd),
    upto as (select pd, i, sum(n) over (order by i) as w, sum(k) over (order by i) as s, n, k from cells),
    spans as (select a.i as first, b.i as last, (b.s - a.s + a.k) / (b.w - a.w + a.n) as share
              from upto a join upto b on a.i <= b.i),
    lows as (select first, last, min(share) over (partition by first order by last desc rows unbounded preceding) as low from spans),
    fitted as (select last as i, max(low) as share from lows group by last),
    scored as (select SK_ID_CURR, share as CALIBRATED_PD from raw join cells using (pd) join fitted using (i))
    select SK_ID_CURR, {rounded_sql("CALIBRATED_PD")} as CALIBRATED_PD,
           case when CALIBRATED_PD < 0.15 then 'APPROVE' when CALIBRATED_PD < 0.35 then 'REVIEW' else 'DECLINE' end as DECISION
    from scored
""")
def batch_score(spark, d):
    """A Gaussian naive Bayes model and an isotonic calibration, both fitted on all rows, then scores and bands for all."""
    inputs = shape(spark, d, "application").select("SK_ID_CURR", "TARGET", *[
        F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in SCORE_COLS.items()
    ])
    vectors = inputs.select("SK_ID_CURR", "TARGET", array_to_vector(F.array(*SCORE_COLS)).alias("features"))
    model = NaiveBayes(labelCol="TARGET", modelType="gaussian").fit(vectors)
    raw = materialize(E.score_batch(vectors, model).select("RAW_PD", "TARGET"))
    scored = E.score_batch(vectors, model, E.Calibration.fit(raw))
    return round_columns(scored.select("SK_ID_CURR", "CALIBRATED_PD", "DECISION"), {"CALIBRATED_PD": 6})


# -- encodings ---------------------------------------------------------------

# 12,000 values at a large enough scale, some of which differ in case only; a few occur once
MANY = {
    "ORG": "concat(case when o_orderkey % 2 = 0 then 'Org ' else 'ORG ' end, cast(o_orderkey % 6007 as string))",
    "PRIORITY": "case when o_orderpriority = '5-LOW' then null else o_orderpriority end",
    "CLERK": "case when o_orderkey % 3 = 0 then 'same' else concat('c', cast(o_custkey % 900 as string)) end",
}


@check("dictionary_encode", f"""
    with src as (select o_orderkey, {", ".join(f"coalesce({e}, 'MISSING') as {c}" for c, e in MANY.items())} from orders),
    entries as ({" union all ".join(
        f"select distinct {i} as place, case when count(*) over (partition by {c}) >= 2 then {c} else 'OTHER' end as v from src"
        for i, c in enumerate(MANY))}),
    placed as (select *, row_number() over (order by place, v) - 1 as idx from entries)
    {" union all ".join(
        f"select o_orderkey, '{c}' as name, idx from (select o_orderkey, case when count(*) over (partition by {c}) >= 2"
        f" then {c} else 'OTHER' end as v from src) join placed using (v) where place = {i}" for i, c in enumerate(MANY))}
""")
def dictionary_encode(spark, d):
    """Every order's places in a sparse vector, from a dictionary fitted on all orders."""
    df = table(spark, d, "orders").selectExpr("o_orderkey", *[f"{e} as {c}" for c, e in MANY.items()])
    rows = EN.encode(df, EN.fit_dictionary(df, list(MANY), min_count=2), list(MANY))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}_INDEX").alias("idx")) for c in MANY])
    return rows.select("o_orderkey", F.inline(cells))


CASED = "case when c_nationkey % 3 = 0 then 'Yard' when c_nationkey % 3 = 1 then 'YARD' else 'yard' end"


@check("one_hot_case", "select c_custkey as SK_ID_CURR, 'ORGANIZATION_TYPE_' || v as feature, cast(v = " + CASED + """ as double) as value
    from customer, (values ('Yard'), ('YARD'), ('yard')) t(v)""")
def one_hot_case(spark, d):
    """Categories that differ in case only: a column of the matrix each, told apart by place."""
    app = cleaned(spark, d).withColumn("ORGANIZATION_TYPE", F.lit(None))
    names = table(spark, d, "customer").selectExpr("c_custkey as SK_ID_CURR", f"{CASED} as ORGANIZATION_TYPE")
    app = app.drop("ORGANIZATION_TYPE").join(names, "SK_ID_CURR")
    model = FE.fit_reduced_builder(app, minCount=1).setFeaturesCol("features")
    vectors = FE.build_reduced(app, model).select("SK_ID_CURR", vector_to_array("features").alias("v"))
    wanted = [(i, c) for i, c in enumerate(model.encoded_columns) if c.startswith("ORGANIZATION_TYPE_")]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.get("v", F.lit(i)).alias("value")) for i, c in wanted])
    return vectors.select("SK_ID_CURR", F.inline(cells))


# -- jobs --------------------------------------------------------------------

@check("builder_store", _matrix_sql(FE.REDUCED, True))
def builder_store(spark, d):
    """A builder that is fitted and saved on the first call and loaded on the second; the loaded one transforms."""
    app, path = cleaned(spark, d), scratch(spark, "builder")
    fit = lambda: FE.fit_reduced_builder(app, minCount=MIN_COUNT)
    IO.load_or_fit_builder(spark, path, fit)
    model = IO.load_or_fit_builder(spark, path, lambda: None)
    return long_matrix(FE.build_reduced(app, model, for_linear=True), model)


@check("stream_matrix", _matrix_sql(FE.REDUCED, True))
def stream_matrix(spark, d):
    """The reduced matrix by a stream: the second half of the files arrives after the first run has ended."""
    app, path = cleaned(spark, d), scratch(spark, "stream")
    model = FE.fit_reduced_builder(app, minCount=MIN_COUNT)
    for half in (0, 1):
        app.where(F.col("SK_ID_CURR") % 2 == half).write.mode("append").parquet(f"{path}/in")
        run = scoring.run_stream(spark, f"{path}/in", app.schema, model, f"{path}/out", f"{path}/state", True)
        run.awaitTermination()
    return long_matrix(spark.read.parquet(f"{path}/out"), model)
