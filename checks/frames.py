"""The test tables in the shapes the operators expect.

Each shape is a list of SQL expressions that Spark and the checking engine read alike,
so both sides start from the same rows. Missing values, sentinels, zero denominators
and children without a parent do not occur in the tables; the expressions make them
from column values. No shape drops rows of its table.
"""

from uuid import uuid4

from pyspark.sql import functions as F

from riskmart.functions.expr import quoted
from riskmart.lineage import shared_folder

CHECKS = {}

TASK_ROWS = 4000        # of a narrow table, from which very many values are derived

# 1/3 and 2/3 as doubles, for quantiles.
THIRD, TWO_THIRDS = 1 / 3, 2 / 3

APPLICATION = {
    "SK_ID_CURR": "c_custkey",
    "AMT_INCOME_TOTAL": "case when c_acctbal < 0 then null else c_acctbal end",
    "AMT_INCOME_TOTAL_CAPPED": "case when c_acctbal >= 0 then least(c_acctbal, 9e3) end",
    "AMT_CREDIT": "case when c_acctbal < 50 then 0e0 else c_acctbal * 3e0 end",
    "AMT_ANNUITY": "case when c_nationkey <> 3 then c_acctbal / 12e0 end",
    "AMT_GOODS_PRICE": "c_acctbal * 25e-1",
    "DAYS_BIRTH": "cast(-(7000 + c_custkey % 15000) as double)",
    "DAYS_EMPLOYED": "cast(case when c_nationkey in (4, 5) then 365243 when c_nationkey = 6 then null"
                     " else -(c_custkey % 4000) end as double)",
    "DAYS_REGISTRATION": "cast(case when c_nationkey = 7 then null else -(c_custkey % 97) end as double)",
    "DAYS_ID_PUBLISH": "cast(case when c_mktsegment = 'FURNITURE' then null else -c_nationkey end as double)",
    "DAYS_LAST_PHONE_CHANGE": "cast(-c_nationkey * 10 as double)",
    "REGION_POPULATION_RELATIVE": "c_nationkey / 1e2",
    "EXT_SOURCE_1": "case when c_acctbal >= 0 then c_acctbal / 1e4 end",
    "EXT_SOURCE_2": "case when c_nationkey <> 11 then c_nationkey / 25e0 end",
    "EXT_SOURCE_3": "case when c_mktsegment <> 'BUILDING' then (c_custkey % 100) / 1e2 end",
    "CNT_FAM_MEMBERS": "cast(1 + c_nationkey % 5 as double)",
    "OWN_CAR_AGE": "cast(case when c_mktsegment = 'AUTOMOBILE' then c_nationkey end as double)",
    "OBS_30_CNT_SOCIAL_CIRCLE": "cast(nullif(c_nationkey % 4, 0) as double)",
    "DEF_30_CNT_SOCIAL_CIRCLE": "cast(c_nationkey % 3 as double)",
    "OBS_60_CNT_SOCIAL_CIRCLE": "cast(nullif(c_nationkey % 6, 5) as double)",
    "DEF_60_CNT_SOCIAL_CIRCLE": "cast(c_nationkey % 2 as double)",
    "AMT_REQ_CREDIT_BUREAU_HOUR": "cast(case when c_mktsegment <> 'MACHINERY' then 0 end as double)",
    "AMT_REQ_CREDIT_BUREAU_DAY": "cast(c_custkey % 2 as double)",
    "AMT_REQ_CREDIT_BUREAU_WEEK": "cast(nullif(c_custkey % 3, 1) as double)",
    "AMT_REQ_CREDIT_BUREAU_MON": "cast(c_custkey % 5 as double)",
    "AMT_REQ_CREDIT_BUREAU_QRT": "cast(c_custkey % 7 as double)",
    "AMT_REQ_CREDIT_BUREAU_YEAR": "cast(c_custkey % 11 as double)",
    "NAME_CONTRACT_TYPE": "c_mktsegment",
    "NAME_TYPE_SUITE": "case when c_nationkey > 2 then concat('S', cast(c_nationkey % 6 as string)) end",
    "NAME_EDUCATION_TYPE": "case when c_acctbal < 0 then 'None' when c_acctbal < 5e3 then 'Basic' else 'Higher' end",
    "NAME_FAMILY_STATUS": "case when c_acctbal < -9e2 then 'Widow' else 'Married' end",
    "OCCUPATION_TYPE": "case when c_nationkey < 8 then null else concat('O', cast(c_nationkey as string)) end",
    "ORGANIZATION_TYPE": "concat('N', cast(c_nationkey as string))",
    "WEEKDAY_APPR_PROCESS_START": "concat('D', cast(c_custkey % 7 as string))",
    "REGION_RATING_CLIENT_W_CITY": "cast(c_nationkey % 3 + 1 as double)",
    "NAME_INCOME_TYPE": "c_mktsegment",
    "NAME_HOUSING_TYPE": "case when c_nationkey < 20 then 'House' else 'Rented' end",
    "FLAG_OWN_CAR": "case when c_mktsegment = 'AUTOMOBILE' then 'Y' else 'N' end",
    "FLAG_OWN_REALTY": "case when c_nationkey < 12 then 'Y' else 'N' end",
    "CNT_CHILDREN": "cast(c_nationkey % 4 as bigint)",
    "CODE_GENDER": "case when c_nationkey < 12 then 'F' else 'M' end",
    "TARGET": "cast(case when c_acctbal < 1e3 then 1 else 0 end as int)",
}

BUREAU = {
    "SK_ID_CURR": "o_custkey",
    "CREDIT_ACTIVE": "case o_orderstatus when 'F' then 'Closed' when 'O' then 'Active' end",
    "AMT_CREDIT_SUM": "case when o_orderpriority <> '1-URGENT' then o_totalprice end",
    "AMT_CREDIT_SUM_DEBT": "case when o_orderstatus = 'O' then o_totalprice / 2e0 end",
    "AMT_CREDIT_SUM_OVERDUE": "case when o_orderstatus = 'P' then o_totalprice else 0e0 end",
    "CREDIT_DAY_OVERDUE": "cast(case when o_orderpriority = '5-LOW' then o_orderkey % 40 end as double)",
    "DAYS_CREDIT": "cast(-(o_orderkey % 2900) as double)",
    "CNT_CREDIT_PROLONG": "cast(case when o_orderstatus = 'F' then o_orderkey % 3 end as double)",
}

PREVIOUS = {
    "SK_ID_PREV": "o_orderkey",
    "SK_ID_CURR": "o_custkey",
    "NAME_CONTRACT_STATUS": "case o_orderstatus when 'F' then 'Approved' when 'O' then 'Refused' end",
    "AMT_APPLICATION": "o_totalprice",
    "AMT_CREDIT": "case when o_orderpriority <> '4-NOT SPECIFIED' then o_totalprice * 75e-2 end",
    "AMT_GOODS_PRICE": "case when o_orderstatus <> 'P' then o_totalprice / 2e0 end",
    "DAYS_DECISION": "cast(-(o_orderkey % 2500) as double)",
    "RATE_DOWN_PAYMENT": "case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_totalprice / 1e6 end",
    "DAYS_FIRST_DRAWING": "cast(case when o_orderpriority = '1-URGENT' then 365243 else -(o_orderkey % 900) end as double)",
    "DAYS_FIRST_DUE": "cast(case when o_orderstatus = 'P' then null else -(o_orderkey % 800) end as double)",
    "DAYS_LAST_DUE_1ST_VERSION": "cast(case when o_orderstatus = 'O' then 365243 when o_orderstatus = 'P' then null else 5 end as double)",
    "DAYS_LAST_DUE": "cast(case when o_orderstatus = 'O' then 365243 else -(o_orderkey % 700) end as double)",
    "DAYS_TERMINATION": "cast(case when o_orderpriority = '5-LOW' then 365243 else -(o_orderkey % 600) end as double)",
}

INSTALLMENTS = {
    "SK_ID_PREV": "l_orderkey",
    "DAYS_ENTRY_PAYMENT": "cast(case when l_returnflag = 'R' and l_linestatus = 'O' then null else -(l_partkey % 30) end as double)",
    "DAYS_INSTALMENT": "cast(case when l_quantity = 50 then null else -(l_orderkey % 30) end as double)",
    "AMT_INSTALMENT": "case when l_tax = 0 then 0e0 else l_extendedprice end",
    "AMT_PAYMENT": "case when l_quantity <> 1 then l_extendedprice * (1e0 - l_discount) end",
}

POS = {
    "SK_ID_PREV": "l_orderkey",
    "SK_DPD": "case when l_quantity <> 7 then l_quantity - 5e0 end",
    "SK_DPD_DEF": "cast(case when l_linestatus = 'F' then l_linenumber end as double)",
    "NAME_CONTRACT_STATUS": "case l_returnflag when 'A' then 'Completed' when 'N' then 'Active' end",
    "CNT_INSTALMENT_FUTURE": "cast(l_linenumber as double)",
}

CARD = {
    "SK_ID_PREV": "l_orderkey",
    "AMT_CREDIT_LIMIT_ACTUAL": "l_quantity - 1e0",
    "AMT_BALANCE": "case when l_linenumber <> 6 then l_extendedprice / 1e3 end",
    "AMT_INST_MIN_REGULARITY": "nullif(l_tax, 1e-2)",
    "AMT_PAYMENT_TOTAL_CURRENT": "l_discount",
    "SK_DPD": "cast(case when l_returnflag = 'R' then l_linenumber else 0 end as double)",
    "AMT_DRAWINGS_ATM_CURRENT": "case when l_returnflag = 'A' then l_quantity end",
    "AMT_DRAWINGS_CURRENT": "case when l_linestatus = 'F' then l_quantity end",
}

# orders joined to customer
AUDIT = {
    "SK_ID_CURR": "o_orderkey",
    "TARGET": "cast(case when o_orderstatus = 'F' then 1 else 0 end as int)",
    "CALIBRATED_PD": "case when o_orderpriority = '2-HIGH' and o_totalprice < 3e3 then null else o_totalprice / 1e6 end",
    "AMT_INCOME_TOTAL": "case when c_acctbal >= 0 then c_acctbal end",
    "REGION_RATING_CLIENT_W_CITY": "cast(case when c_nationkey = 0 then null else c_nationkey % 3 + 1 end as double)",
    "NAME_INCOME_TYPE": "case when o_orderpriority = '5-LOW' then null else o_orderpriority end",
    "NAME_HOUSING_TYPE": "case when c_nationkey = 9 then concat('Rare ', c_mktsegment) else c_mktsegment end",
    "FLAG_OWN_CAR": "case when c_nationkey = 2 then null when c_nationkey < 12 then 'Y' else 'N' end",
    "FLAG_OWN_REALTY": "case o_orderstatus when 'O' then 'Y' when 'F' then 'N' end",
    "CNT_CHILDREN": "cast(case when c_nationkey = 5 then null when c_nationkey = 6 then -1 else c_nationkey % 4 end as double)",
}

SOURCES = {
    "application": ("customer", APPLICATION),
    "bureau": ("orders", BUREAU),
    "previous": ("orders", PREVIOUS),
    "installments": ("lineitem", INSTALLMENTS),
    "pos": ("lineitem", POS),
    "card": ("lineitem", CARD),
    "audit": ("orders join customer on o_custkey = c_custkey", AUDIT),
}


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_rows(df, rows=TASK_ROWS):
    """The rows of a stored narrow table, dealt over tasks of about so many rows, as many at most as shuffles have.

    A row group of a file is read by one task, and one of a narrow table holds very many rows.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(most, -(-df.count() // rows))))


def shape(spark, folder, name, spread=False):
    """A shape as a Spark frame; with `spread`, its rows are dealt over tasks."""
    source, columns = SOURCES[name]
    df = table(spark, folder, source.split()[0])
    df = spread_rows(df) if spread else df
    if " join " in source:
        df = df.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return df.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def shape_sql(name):
    """The same shape as a SQL subquery."""
    source, columns = SOURCES[name]
    cols = ", ".join(f"{e} as {c}" for c, e in columns.items())
    return f"(select {cols} from {source})"


def with_shapes(*names):
    return "with " + ", ".join(f"{n} as {shape_sql(n)}" for n in names)


def scratch(spark, name):
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def check(name, sql=None):
    """Registers a query under a name, with its SQL if there is any."""

    def add(function):
        CHECKS[name] = (function, sql)
        return function

    return add


# -- rounding ----------------------------------------------------------------
#
# Sums of doubles depend on their order in the last digits, so derived values are
# rounded on both sides, with the same arithmetic. Exact halves are common (means of
# cents over 32 rows); a fixed nudge moves them off the boundary first.

NUDGE = {4: "3.1e-6", 6: "3.1e-8", 8: "3.1e-10"}


def rounded_sql(expression, digits=6):
    return f"floor((cast({expression} as double) + {NUDGE[digits]}) * 1e{digits} + 5e-1) / 1e{digits}"


def rounded(column, digits=6):
    return F.expr(rounded_sql(quoted(column), digits))


def round_columns(df, digits):
    """Rounds the named columns; `digits` maps column to places."""
    return df.withColumns({c: rounded(c, d) for c, d in digits.items()})
