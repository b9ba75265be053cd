"""Recency order, splits, samples, quantiles and profile tables."""

from pyspark.sql import functions as F

from checks.frames import (
    APPLICATION, THIRD, TWO_THIRDS, check, round_columns, rounded_sql, scratch, shape, table,
)
from checks.marts import CLEAN_SQL, cleaned
from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.operators import ordering as O, profile as P, sampling as SM, selection
from riskmart.plans import jobs
from riskmart.sources import tables as IO

# -- order and splits --------------------------------------------------------

RECENCY_SQL = f"""
    app as (select * from {CLEAN_SQL}),
    mid as (select quantile_cont(abs(DAYS_ID_PUBLISH), 0.5) as m1,
                   quantile_cont(abs(DAYS_REGISTRATION), 0.5) as m2 from app),
    placed as (
        select app.*, row_number() over (order by coalesce(abs(DAYS_ID_PUBLISH), m1),
               coalesce(abs(DAYS_REGISTRATION), m2), SK_ID_CURR) - 1 as row_index
        from app, mid),
    total as (select count(*) as n from app),
    split as (
        select placed.*, case when row_index < trunc(n * cast(0.6 as double)) then 'train'
                              when row_index < trunc(n * cast(0.7 as double)) then 'val_model'
                              when row_index < trunc(n * cast(0.8 as double)) then 'val_policy'
                              else 'test' end as split
        from placed, total)"""


@check("recency_index", f"with {RECENCY_SQL} select SK_ID_CURR, row_index from split")
def recency_index(spark, d):
    out = O.recency_index(cleaned(spark, d).select("SK_ID_CURR", "DAYS_ID_PUBLISH", "DAYS_REGISTRATION"))
    return out.select("SK_ID_CURR", "row_index")


def split_frame(spark, d):
    return O.ordered_split(cleaned(spark, d))


@check("ordered_split", f"with {RECENCY_SQL} select SK_ID_CURR, split from split")
def ordered_split(spark, d):
    return split_frame(spark, d).select("SK_ID_CURR", "split")


@check("split_sizes", f"""with {RECENCY_SQL}
    select split, count(*) as n, {rounded_sql("count(*) / max(t.n)")} as share
    from split, total t group by split
""")
def split_sizes(spark, d):
    return round_columns(P.split_sizes(split_frame(spark, d)), {"share": 6})


@check("cap_p99", f"""with {RECENCY_SQL},
    cap as (select quantile_cont(AMT_INCOME_TOTAL, 0.99) as cap from split where split = 'train')
    select SK_ID_CURR, {rounded_sql("case when AMT_INCOME_TOTAL > cap then cap else AMT_INCOME_TOTAL end", 4)}
           as capped, {rounded_sql("cap", 4)} as cap
    from split, cap
""")
def cap_p99(spark, d):
    split = split_frame(spark, d)
    train = split.where(F.col("split") == "train")
    cap = selection.exact_quantiles(train, {"v": "AMT_INCOME_TOTAL"}, [0.99])["v"][0]
    out = split.select(
        "SK_ID_CURR", X.cap_upper("AMT_INCOME_TOTAL", cap).alias("capped"), F.lit(cap).alias("cap")
    )
    return round_columns(out, {"capped": 4, "cap": 4})


# -- samples -----------------------------------------------------------------

def hash_sql(key):
    return f"cast('0x' || substr(md5('{SM.SEED}:' || cast({key} as varchar)), 1, 15) as bigint)"


def ranked_sql(source, key, columns="*"):
    return f"(select {columns}, row_number() over (order by {hash_sql(key)}, {key}) - 1 as pos from {source})"


@check("balanced_sample", f"""
    with size as (select least((select count(*) from customer), (select count(*) from supplier)) as n)
    select 'customer' as side, c_custkey as id, c_acctbal as balance
    from {ranked_sql("customer", "c_custkey")}, size where pos < n
    union all
    select 'supplier', s_suppkey, s_acctbal from {ranked_sql("supplier", "s_suppkey")}, size where pos < n
""")
def balanced_sample(spark, d):
    a, b = SM.balanced_sample(
        table(spark, d, "customer"), table(spark, d, "supplier"), "c_custkey", "s_suppkey"
    )
    return a.selectExpr("'customer' as side", "c_custkey as id", "c_acctbal as balance").unionAll(
        b.selectExpr("'supplier' as side", "s_suppkey as id", "s_acctbal as balance")
    )


def held_sql(counts):
    """Rows held out per label: ceil(0.2 n) in all, shared by largest remainder."""
    return f"""
        held as (
            select label, cast(floor(exact) as bigint)
                   + case when row_number() over (order by floor(exact) - exact, label)
                     <= total - sum(cast(floor(exact) as bigint)) over () then 1 else 0 end as k
            from (select label, n, ceil(sum(n) over () * cast(0.2 as double)) as total,
                         n * ceil(sum(n) over () * cast(0.2 as double)) / sum(n) over () as exact
                  from {counts}))"""


@check("stratified_split", f"""
    with counts as (select o_orderstatus as label, count(*) as n from orders group by 1), {held_sql("counts")}
    select o_orderkey, label, case when pos < k then 'val' else 'train' end as part from (
        select o_orderkey, o_orderstatus as label,
               row_number() over (partition by o_orderstatus order by {hash_sql("o_orderkey")}, o_orderkey) - 1 as pos
        from orders) join held using (label)
""")
def stratified_split(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus as label")
    return SM.stratified_split(orders, "label", "o_orderkey")


@check("adversarial_set", f"""
    with size as (select least((select count(*) from customer), (select count(*) from supplier)) as n),
    both_sides as (
        select c_custkey as id, c_mktsegment as segment, c_acctbal as balance, cast(null as int) as s_nation,
               0 as label from {ranked_sql("customer", "c_custkey")}, size where pos < n
        union all
        select s_suppkey, null, s_acctbal, s_nationkey, 1
        from {ranked_sql("supplier", "s_suppkey")}, size where pos < n),
    counts as (select label, count(*) as n from both_sides group by 1), {held_sql("counts")}
    select id, segment, balance, s_nation, label as "ADV_LABEL",
           case when pos < k then 'val' else 'train' end as part
    from (select *, row_number() over (partition by label order by {hash_sql("id")}, id) - 1 as pos from both_sides)
    join held using (label)
""")
def adversarial_set(spark, d):
    train = table(spark, d, "customer").selectExpr("c_custkey as id", "c_mktsegment as segment", "c_acctbal as balance")
    test = table(spark, d, "supplier").selectExpr("s_suppkey", "s_acctbal as balance", "s_nationkey as s_nation")
    return SM.adversarial_set(train, test, "id", "s_suppkey")


# -- profile -----------------------------------------------------------------

QUANTILES = {"0.99": 0.99, repr(THIRD): THIRD, repr(TWO_THIRDS): TWO_THIRDS, "0.5": 0.5}


@check("quantiles", " union all ".join(
    f"select '{c}' as \"column\", round(cast({p} as double), 6) as p,"
    f" {rounded_sql(f'quantile_cont({c}, cast({p} as double))', 4)} as value from {t}"
    for t, c in (("orders", "o_totalprice"), ("lineitem", "nullif(l_quantity, 50)")) for p in QUANTILES
).replace("'nullif(l_quantity, 50)'", "'quantity'"))
def quantiles(spark, d):
    prices = P.quantiles(table(spark, d, "orders"), ["o_totalprice"], list(QUANTILES.values()))
    lines = table(spark, d, "lineitem").selectExpr("nullif(l_quantity, 50) as quantity")
    out = prices.unionAll(P.quantiles(lines, ["quantity"], list(QUANTILES.values())))
    return round_columns(out, {"value": 4}).withColumn("p", F.round("p", 6))


@check("value_counts", f"""
    select l_returnflag, count(*) as n, {rounded_sql("count(*) / sum(count(*)) over ()")} as share
    from lineitem group by l_returnflag
""")
def value_counts(spark, d):
    return round_columns(P.value_counts(table(spark, d, "lineitem"), "l_returnflag"), {"share": 6})


PROFILE_COLS = list(S.REQUIRED_APPLICATION_COLS) + ["AMT_INCOME_TOTAL", *S.FAIRNESS_COLS]
RATES_SQL = "(" + " union all ".join(
    f"select '{c}' as \"column\", avg(cast({c} is null as int)) as rate from {CLEAN_SQL}" for c in PROFILE_COLS
) + ")"


@check("missing_rates", f"select \"column\", {rounded_sql('rate')} as rate from {RATES_SQL}")
def missing_rates(spark, d):
    return round_columns(P.missing_rates(cleaned(spark, d).select(*PROFILE_COLS)), {"rate": 6})


@check("missing_top40", f"""
    select "column", {rounded_sql('rate')} as rate from {RATES_SQL} rates where rate > 0
    order by rates.rate desc, "column" limit 40
""")
def missing_top40(spark, d):
    return round_columns(P.top_missing(cleaned(spark, d).select(*PROFILE_COLS)), {"rate": 6})


CORR_COLS = [*S.EXT_SOURCE_COLS, S.TARGET]


@check("corr_matrix", f"with f as (select * from {CLEAN_SQL} where " + " and ".join(
    f"{c} is not null" for c in CORR_COLS) + ") " + " union all ".join(
    f"select '{a}' as a, '{b}' as b, {rounded_sql('1' if a == b else f'corr({a}, {b})')} as corr from f"
    " group by ()"
    for a in CORR_COLS for b in CORR_COLS))
def corr_matrix(spark, d):
    return round_columns(P.correlations(cleaned(spark, d), CORR_COLS), {"corr": 6})


# 40 numeric columns of the lines, a few of them missing in some rows, one of them constant
WIDE = {f"v{i:02}": f"cast((l_orderkey * {2 * i + 3} + l_partkey * {i + 1} + l_suppkey) % {89 + i} as double)" for i in range(37)}
WIDE |= {"v37": "case when l_linenumber < 7 then l_quantity end", "v38": "l_extendedprice", "v39": "cast(4 as double)"}


@check("corr_wide", f"""
    with src as (select {", ".join(f"{e} as {c}" for c, e in WIDE.items())} from lineitem),
    r as (select {", ".join(f"corr({a}, {b}) as {a}_{b}" for a in WIDE for b in WIDE if a < b)} from src where v37 is not null),
    long as ({" union all ".join(
        f"select unnest({[a for b in WIDE if a != b]}) as a, unnest({[b for b in WIDE if a != b]}) as b,"
        f" unnest([{', '.join(f'{min(a, b)}_{max(a, b)}' for b in WIDE if a != b)}]) as c from r" for a in WIDE)}
        union all select unnest({list(WIDE)}), unnest({list(WIDE)}), 1)
    select a, b, case when a <> 'v39' and b <> 'v39' then {rounded_sql("c")} end as corr from long
""")
def corr_wide(spark, d):
    """All 1,600 correlations of 40 columns from one pass over the lines."""
    return round_columns(P.correlations(table(spark, d, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in WIDE.items()]), list(WIDE)), {"corr": 6})


def histogram_sql(value, source, bins):
    return f"""
        with x as (select {value} as v from {source} where {value} is not null),
        edge as (select min(v) as lo, max(v) as hi, (max(v) - min(v)) / {bins} as step from x),
        bins as (select i as bin, lo + i * step as low, case when i = {bins} - 1 then hi else lo + (i + 1) * step end as high
                 from edge, range({bins}) t(i))
        select cast(bin as int) as bin, {rounded_sql("low", 4)} as low, {rounded_sql("high", 4)} as high,
               count(v) as n
        from bins left join x on v >= low and (v < high or bin = {bins} - 1)
        group by all"""


@check("histogram", histogram_sql("least(l_extendedprice, 90000)", "lineitem", 60))
def histogram(spark, d):
    out = P.histogram(table(spark, d, "lineitem"), "l_extendedprice", 60, clip_upper=90000)
    return round_columns(out, {"low": 4, "high": 4})


@check("quality_report", f"""with {RECENCY_SQL},
    train as (select * from split where split = 'train'),
    long as (
        select 'total_rows' as metric, '' as item, cast(count(*) as double) as value from split
        union all select 'total_cols', '', {len(PROFILE_COLS) + 3}
        union all select 'target_default_rate', '', round(avg(TARGET), 4) from train
        union all select 'class_counts', cast(TARGET as varchar), count(*) from train group by TARGET
        union all select 'sentinel_counts', 'DAYS_EMPLOYED_365243', sum(DAYS_EMPLOYED_ANOM) from split
        union all select 'missing_rates', "column", round(rate, 4) from {RATES_SQL} where rate > 0
        union all select 'income_cap_p99', '', round(quantile_cont(AMT_INCOME_TOTAL, 0.99), 2) from train
        union all select 'split_sizes', split, count(*) from split group by split)
    select metric, item, value from long
""")
def quality_report(spark, d):
    """The report of the prepare job, one line per entry."""
    app = cleaned(spark, d).select("SK_ID_CURR", "TARGET", "CODE_GENDER", *PROFILE_COLS)
    split = O.ordered_split(app)
    train = split.where(F.col("split") == "train")
    cap = selection.exact_quantiles(train, {"v": "AMT_INCOME_TOTAL"}, [0.99])["v"][0]
    report = P.quality_report(
        split, "split", "application_train", "TARGET", "DAYS_EMPLOYED_ANOM", "DAYS_EMPLOYED_365243", cap
    )
    single = ("total_rows", "total_cols", "target_default_rate", "income_cap_p99")
    several = ("class_counts", "sentinel_counts", "missing_rates", "split_sizes")
    entry = lambda m, i, v: F.struct(F.lit(m).alias("metric"), i.alias("item"), v.cast("double").alias("value"))
    lines = F.array(*[entry(m, F.lit(""), F.col(m)) for m in single])

    def entries(m):
        return F.transform(F.map_entries(m), lambda e: entry(m, e["key"], e["value"]))

    lines = F.concat(lines, *[entries(m) for m in several])
    return report.select(F.inline(lines))


# -- the prepare job ---------------------------------------------------------

RAW_COLS = [c for c in APPLICATION if c != "AMT_INCOME_TOTAL_CAPPED"]


def prepared_sql():
    rates = " union all ".join(f"select '{c}' as item, avg(cast(coalesce(cast({c} as varchar) = 'None', true) as int)) as rate from app" for c in [*RAW_COLS, "DAYS_EMPLOYED_ANOM"])
    return f"""with {RECENCY_SQL},
    train as (select * from split where split = 'train'),
    cap as (select quantile_cont(AMT_INCOME_TOTAL, 0.99) as cap from train),
    sides as (select SK_ID_CURR as id, 0 as label from app union all select SK_ID_CURR + 1000000, 1 from app where SK_ID_CURR % 3 = 0),
    size as (select least(count(*) filter (label = 0), count(*) filter (label = 1)) as m from sides),
    picked as (select id, label, row_number() over (partition by label order by {hash_sql("id")}, id) - 1 as pos from sides),
    bundle as (select id, label, pos from picked, size where pos < m),
    counts as (select label, count(*) as n from bundle group by 1), {held_sql("counts")},
    long as (
        select 'split' as kind, split as name, SK_ID_CURR as id,
               case when AMT_INCOME_TOTAL > cap then cap else AMT_INCOME_TOTAL end as value from split, cap
        union all select 'adversarial', case when pos < k then 'val' else 'train' end, id, label from bundle join held using (label)
        union all select 'income_cap', '', 0, cap from cap
        union all select 'total_rows', '', 0, count(*) from app
        union all select 'split_sizes', split, 0, count(*) from split group by split
        union all select 'class_counts', cast(TARGET as varchar), 0, count(*) from train group by TARGET
        union all select 'missing_rates', item, 0, round(rate, 4) from ({rates}) where rate > 0
        union all select 'class_balance', cast(TARGET as varchar), 0, count(*) from train group by TARGET)
    select kind, name, id, {rounded_sql("value", 4)} as value from long"""


@check("prepare_job", prepared_sql())
def prepare_job(spark, d):
    """The prepare job from raw CSV files to its stored outputs, read back as (kind, name, id, value).

    In the files the text None is a marker of a missing value.
    """
    path = scratch(spark, "prepare")
    app = shape(spark, d, "application").select(*RAW_COLS)
    later = app.where("SK_ID_CURR % 3 = 0").withColumn("SK_ID_CURR", F.col("SK_ID_CURR") + 1_000_000).drop("TARGET")
    previous = shape(spark, d, "previous")
    for name, df in (("application_train", app), ("application_test", later), ("previous_application", previous)):
        df.write.option("header", True).option("escape", '"').csv(f"{path}/raw/{name}.csv")
    jobs.run_prepare(spark, f"{path}/raw", f"{path}/out")

    def rows(df, kind, name="''", id="0", value="value"):
        return df.selectExpr(f"'{kind}' as kind", f"cast({name} as string) as name", f"cast({id} as bigint) as id", f"cast({value} as double) as value")

    # every split read from its own folder
    splits = [IO.read_split(spark, f"{path}/out/splits", n).withColumn("split", F.lit(n)) for n in S.SPLIT_NAMES]
    out = [rows(s, "split", "split", "SK_ID_CURR", "AMT_INCOME_TOTAL_CAPPED") for s in splits]
    out.append(rows(spark.read.parquet(f"{path}/out/adversarial"), "adversarial", "part", "SK_ID_CURR", "ADV_LABEL"))
    cap = IO.read_value(spark, f"{path}/out/income_cap", "income_cap")
    out.append(rows(spark.range(1).withColumn("value", F.lit(cap)), "income_cap"))
    maps = ", ".join(f"{m} map<string, double>" for m in ("split_sizes", "class_counts", "missing_rates"))
    report = spark.read.schema(f"total_rows double, {maps}").json(f"{path}/out/quality_report")
    out.append(rows(report, "total_rows", value="total_rows"))
    for m in ("split_sizes", "class_counts", "missing_rates"):
        out.append(rows(report.select(F.explode(m).alias("name", "value")), m, "name"))
    out.append(rows(spark.read.parquet(f"{path}/out/profile/class_balance"), "class_balance", "TARGET", value="n"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return round_columns(whole, {"value": 4})
