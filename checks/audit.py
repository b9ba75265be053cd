"""Groups, fairness audit, score evaluation and attributions."""

from pyspark.sql import functions as F

from checks.frames import (
    THIRD, TWO_THIRDS, check, round_columns, rounded_sql, scratch, shape, shape_sql, table, with_shapes,
)
from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.lineage import materialize
from riskmart.operators import evaluate as E, explain as EX, fairness as FA
from riskmart.plans import jobs
from riskmart.sources import tables as IO

BAND_SQL = ("case when CALIBRATED_PD < 0.15 then 'APPROVE' when CALIBRATED_PD < 0.35 then 'REVIEW'"
            " else 'DECLINE' end")
CUTS_SQL = (f"cuts as (select quantile_cont(AMT_INCOME_TOTAL, cast({THIRD!r} as double)) as q1,"
            f" quantile_cont(AMT_INCOME_TOTAL, cast({TWO_THIRDS!r} as double)) as q2 from audit)")
TERTILE_SQL = ("case when AMT_INCOME_TOTAL is null then 'MISSING' when AMT_INCOME_TOTAL <= q1 then 'T1'"
               " when AMT_INCOME_TOTAL <= q2 then 'T2' else 'T3' end")
CHILDREN_SQL = ("case when coalesce(CNT_CHILDREN, 0) <= -1 then 'nan' when coalesce(CNT_CHILDREN, 0) <= 0 then '0'"
                " when coalesce(CNT_CHILDREN, 0) <= 1 then '1' else '2_PLUS' end")


def audit_frame(spark, d):
    return shape(spark, d, "audit").withColumn("DECISION", X.decision_band("CALIBRATED_PD"))


@check("income_tertile", with_shapes("audit") + f", {CUTS_SQL} select SK_ID_CURR, {TERTILE_SQL} as tertile from audit, cuts")
def income_tertile(spark, d):
    df = materialize(shape(spark, d, "audit").select("SK_ID_CURR", "AMT_INCOME_TOTAL"))
    q1, q2 = jobs.income_cuts(df)
    return df.select("SK_ID_CURR", X.income_tertile("AMT_INCOME_TOTAL", q1, q2).alias("tertile"))


@check("children_bin", with_shapes("audit") + f" select SK_ID_CURR, CNT_CHILDREN, {CHILDREN_SQL} as children from audit")
def children_bin(spark, d):
    return shape(spark, d, "audit").select(
        "SK_ID_CURR", "CNT_CHILDREN", X.children_bin("CNT_CHILDREN").alias("children")
    )


def _pooled(c):
    return (f"coalesce(case when count(*) over (partition by {c}) >= 500 then {c} else 'OTHER' end, 'MISSING')")


GROUPS_SQL = with_shapes("audit") + f""", {CUTS_SQL},
    part as (select audit.*, {BAND_SQL} as decision, {TERTILE_SQL} as tertile,
             {_pooled("NAME_INCOME_TYPE")} as income_type, {_pooled("NAME_HOUSING_TYPE")} as housing_type,
             {CHILDREN_SQL} as children,
             coalesce(FLAG_OWN_CAR, 'N') || '_' || coalesce(FLAG_OWN_REALTY, 'N') as own from audit, cuts),
    grouped as (select *, tertile || '__' || cast(cast(coalesce(REGION_RATING_CLIENT_W_CITY, -1) as int) as varchar) as g1,
             income_type || '__' || housing_type as g2, own || '__' || children as g3 from part)"""


def grouped_frame(spark, d):
    """The scored applicants, stored once as in the audit job, with their groups."""
    df = materialize(audit_frame(spark, d))
    return FA.derive_groups(df, *jobs.income_cuts(df))


@check("fair_groups", GROUPS_SQL + """
    select SK_ID_CURR, tertile as "INCOME_TERTILE", g1 as "FAIR_GROUP_PRIMARY",
           income_type as "INCOME_TYPE_POOLED", housing_type as "HOUSING_TYPE_POOLED",
           g2 as "FAIR_GROUP_SECONDARY", children as "CHILDREN_BIN", own as "OWN_ASSET_BIN",
           g3 as "FAIR_GROUP_TERTIARY" from grouped
""")
def fair_groups(spark, d):
    return grouped_frame(spark, d).select(
        "SK_ID_CURR", "INCOME_TERTILE", "FAIR_GROUP_PRIMARY", "INCOME_TYPE_POOLED", "HOUSING_TYPE_POOLED",
        "FAIR_GROUP_SECONDARY", "CHILDREN_BIN", "OWN_ASSET_BIN", "FAIR_GROUP_TERTIARY",
    )


LABELED_SQL = "(select lang, 1 - quality as bad, toxic, n_chars from labels join documents using (doc_id))"


def labeled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").selectExpr(
        "lang", "1 - quality as bad", "toxic", "n_chars"
    )


@check("fair_cells", f"""
    select * from (select 'orders' as source, o_orderpriority as cell, count(*) as n,
                   cast(sum(cast(o_orderstatus = 'F' as int)) as bigint) as pos from orders group by 2
                   union all
                   select 'labels', lang, count(*), cast(sum(bad) as bigint) from {LABELED_SQL} group by 2)
    where n >= 200 and pos >= 20
""")
def fair_cells(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderpriority as cell", "cast(o_orderstatus = 'F' as int) as bad")
    texts = labeled(spark, d).withColumnRenamed("lang", "cell")
    tag = lambda name, df: FA.eligible_cells(df, "cell", "bad").withColumn("source", F.lit(name))
    return tag("orders", orders).unionByName(tag("labels", texts))


def metrics_sql(cells, family):
    """From per-cell sums (n, n_defaults, approved, good, good_approved, sq, scored) to the 13 columns."""
    over = f"over (partition by {family})" if family else "over ()"
    lead = f"{family}, " if family else ""
    return f"""
        rates as (select *, n >= 200 and n_defaults >= 20 as evaluable,
            case when n >= 200 and n_defaults >= 20 then approved / n end as approve_rate,
            case when n >= 200 and n_defaults >= 20 then good_approved / nullif(good, 0) end as tpr,
            case when n >= 200 and n_defaults >= 20 and scored = n then sq / n end as brier_score from {cells}),
        spread as (select *, max(approve_rate) {over} as a1, min(approve_rate) {over} as a0,
            max(tpr) {over} as t1, min(tpr) {over} as t0, max(brier_score) {over} as b1,
            min(brier_score) {over} as b0 from rates),
        metrics as (select {lead} group_value, n, n_defaults, approve_rate, tpr, brier_score,
            approve_rate / nullif(a1, 0) as di_ratio, tpr - t1 as eod,
            case when b0 > 0 then brier_score / b0 end as brier_ratio, evaluable,
            case when evaluable then coalesce(a1 > 0 and a0 / nullif(a1, 0) >= 0.8, false) end as di_pass,
            case when evaluable then coalesce(t1 - t0 <= cast(0.1 as double), false) end as eod_pass,
            case when evaluable then coalesce(b0 > 0 and b1 / nullif(b0, 0) <= 1.25, false) end as brier_pass
            from spread)"""


FLOATS = {c: 6 for c in ("approve_rate", "tpr", "brier_score", "di_ratio", "eod", "brier_ratio")}
ROUNDED_SQL = ", ".join(
    f"{rounded_sql(c)} as {c}" if c in FLOATS else (f"cast({c} as bigint) as {c}" if c in ("n", "n_defaults") else c)
    for c in S.AUDIT_COLS
)


def sums_sql(group, y, score, decision, source, lead=""):
    return f"""select {lead} cast({group} as varchar) as group_value, count(*) as n, sum({y}) as n_defaults,
        count(*) filter (where {decision} = 'APPROVE') as approved, count(*) filter (where {y} = 0) as good,
        count(*) filter (where {y} = 0 and {decision} = 'APPROVE') as good_approved,
        sum(({score} - {y}) * ({score} - {y})) as sq, count({score}) as scored from {source} group by all"""


TEXT_PD = "n_chars / (n_chars + 4e3)"
TEXT_BAND = BAND_SQL.replace("CALIBRATED_PD", f"({TEXT_PD})")


@check("fair_metrics", f"""
    with orders_audit as (select *, {BAND_SQL} as decision from {shape_sql("audit")}),
    texts as (select lang, bad, {TEXT_PD} as pd, {TEXT_BAND} as decision from {LABELED_SQL}),
    cells as (select * from ({sums_sql("coalesce(NAME_INCOME_TYPE, 'LOW')", "TARGET", "CALIBRATED_PD", "decision", "orders_audit", "'orders' as source,")})
              union all select * from ({sums_sql("lang", "bad", "pd", "decision", "texts", "'labels' as source,")})),
    {metrics_sql("cells", "source")}
    select source, {ROUNDED_SQL} from metrics
""")
def fair_metrics(spark, d):
    """Order priorities, all evaluable; and text languages, most of them too small."""
    orders = audit_frame(spark, d).withColumn("g", F.coalesce("NAME_INCOME_TYPE", F.lit("LOW")))
    texts = labeled(spark, d).withColumn("pd", F.expr(TEXT_PD)).withColumn("decision", X.decision_band("pd"))
    a = FA.group_metrics(orders, "g").withColumn("source", F.lit("orders"))
    b = FA.group_metrics(texts, "lang", "bad", "pd", "decision").withColumn("source", F.lit("labels"))
    return round_columns(a.unionByName(b), FLOATS)


AUDIT_SQL = GROUPS_SQL + ", cells as (" + " union all ".join(
    f"select * from ({sums_sql(g, 'TARGET', 'CALIBRATED_PD', 'decision', 'grouped', repr(f) + ' as family,')})"
    for f, g in zip(FA.FAMILIES, ("g1", "g2", "g3"))
) + "), " + metrics_sql("cells", "family")


@check("fair_audit", AUDIT_SQL + f" select family, {ROUNDED_SQL} from metrics")
def fair_audit(spark, d):
    return round_columns(FA.audit_cells(grouped_frame(spark, d)), FLOATS)


@check("audit_files", AUDIT_SQL + f" select family, {ROUNDED_SQL} from metrics")
def audit_files(spark, d):
    """The audit's three CSV files, written and read back."""
    df, path = materialize(audit_frame(spark, d)), scratch(spark, "audit")
    jobs.full_audit(df, *jobs.income_cuts(df), out=path)
    kinds = {c: "boolean" if c == "evaluable" or c.endswith("_pass") else "bigint" if c.startswith("n") else "double" for c in S.AUDIT_COLS}
    kinds["group_value"] = "string"
    files = [IO.read_audit(spark, path, f).withColumn("family", F.lit(f)) for f in FA.FAMILIES]
    rows = files[0].unionByName(files[1]).unionByName(files[2])
    return round_columns(rows.select("family", *[F.col(c).cast(t).alias(c) for c, t in kinds.items()]), FLOATS)


@check("fair_family", AUDIT_SQL + """
    select family, coalesce(bool_and(di_pass) filter (where evaluable), false) as di,
           coalesce(bool_and(eod_pass) filter (where evaluable), false) as eod,
           coalesce(bool_and(brier_pass) filter (where evaluable), false) as brier
    from metrics group by family
""")
def fair_family(spark, d):
    return FA.family_verdicts(FA.audit_cells(grouped_frame(spark, d)))


# -- evaluation --------------------------------------------------------------

@check("confusion", with_shapes("audit") + """
    , hit as (select TARGET as y, cast(coalesce(CALIBRATED_PD >= 0.35, false) as int) as p from audit),
    cell as (select * from (values (0, 0), (0, 1), (1, 0), (1, 1)) t(actual, predicted))
    select actual, predicted, count(y) as n from cell left join hit on y = actual and p = predicted group by all
""")
def confusion(spark, d):
    return E.confusion_matrix(audit_frame(spark, d))


ROC_SQL = with_shapes("audit") + """
    , scores as (select CALIBRATED_PD as threshold, count(*) filter (where TARGET = 1) as pos,
                 count(*) filter (where TARGET = 0) as neg from audit where CALIBRATED_PD is not null group by 1),
    curve as (select threshold, pos, neg,
              sum(pos) over (order by threshold desc) as tp, sum(neg) over (order by threshold desc) as fp,
              sum(pos) over () as p, sum(neg) over () as n from scores)"""


@check("roc_points", ROC_SQL + f"""
    select threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
           {rounded_sql("tp / p")} as tpr, {rounded_sql("fp / n")} as fpr from curve
    union all select null, 0, 0, {rounded_sql("0")}, {rounded_sql("0")}
""")
def roc_points(spark, d):
    return round_columns(E.roc_points(audit_frame(spark, d)), {"tpr": 6, "fpr": 6})


@check("roc_corners", ROC_SQL + f""",
    steps as (select *, lead(pos) over (order by threshold desc) as next_pos, lead(neg) over (order by threshold desc) as next_neg,
              row_number() over (order by threshold desc) as place from curve)
    select threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
           {rounded_sql("tp / p")} as tpr, {rounded_sql("fp / n")} as fpr from steps
    where place = 1 or next_pos is null or pos <> next_pos or neg <> next_neg
    union all select null, 0, 0, {rounded_sql("0")}, {rounded_sql("0")}
""")
def roc_corners(spark, d):
    """The curve without points between two equal steps."""
    return round_columns(E.roc_points(audit_frame(spark, d), drop_collinear=True), {"tpr": 6, "fpr": 6})


@check("auc", with_shapes("audit") + f"""
    , ranked as (select TARGET as y, rank() over (order by CALIBRATED_PD)
                 + (count(*) over (partition by CALIBRATED_PD) - 1) / 2 as r
                 from audit where CALIBRATED_PD is not null),
    parts as (select sum(r) filter (where y = 1) as s, count(*) filter (where y = 1) as p,
              count(*) filter (where y = 0) as n from ranked)
    select {rounded_sql("(s - p * (p + 1) / 2) / p / n", 8)} as auc from parts
""")
def auc(spark, d):
    return round_columns(E.auc(audit_frame(spark, d)), {"auc": 8})


def _fbeta_sql(tp, fp, fn):
    return f"coalesce(26e0 * {tp} / nullif(26e0 * {tp} + 25e0 * {fn} + {fp}, 0), 0)"


@check("fbeta", with_shapes("audit") + f"""
    , hit as (select TARGET as y, cast(coalesce(CALIBRATED_PD >= 0.35, false) as int) as h from audit),
    c as (select count(*) filter (where y = 1 and h = 1) as tp, count(*) filter (where y = 0 and h = 1) as fp,
          count(*) filter (where y = 1 and h = 0) as fn from hit)
    select tp, fp, fn, {rounded_sql(_fbeta_sql("tp", "fp", "fn"), 8)} as fbeta from c
""")
def fbeta(spark, d):
    df = audit_frame(spark, d).withColumn("PREDICTED", X.predicted_class("CALIBRATED_PD", 0.35))
    return round_columns(E.f_beta_score(df), {"fbeta": 8})


SWEEP_SQL = with_shapes("audit") + f"""
    , t as (select unnest([{', '.join(f"cast('{t!r}' as double)" for t in E.THRESHOLDS)}]) as threshold),
    c as (select threshold, count(*) filter (where TARGET = 1 and CALIBRATED_PD >= threshold) as tp,
          count(*) filter (where TARGET = 0 and CALIBRATED_PD >= threshold) as fp,
          count(*) filter (where TARGET = 1 and not coalesce(CALIBRATED_PD >= threshold, false)) as fn
          from audit, t group by threshold),
    sweep as (select *, {_fbeta_sql("tp", "fp", "fn")} as fbeta from c)"""


@check("fbeta_sweep", SWEEP_SQL + f"""
    , best as (select threshold from sweep order by fbeta desc, threshold limit 1)
    select s.threshold, tp, fp, fn, {rounded_sql("fbeta", 8)} as fbeta,
           s.threshold = best.threshold as is_best from sweep s, best
""")
def fbeta_sweep(spark, d):
    sweep = E.f_beta_sweep(audit_frame(spark, d))
    best = E.best_threshold(sweep).select("threshold", F.lit(True).alias("is_best"))
    out = sweep.join(F.broadcast(best), "threshold", "left")          # one row
    return round_columns(out, {"fbeta": 8}).withColumn("is_best", F.coalesce("is_best", F.lit(False)))


# -- attributions ------------------------------------------------------------

PREFIXES = ("CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "INST_DPD_", "BUREAU_", "CC_", "POS_", "EXT_", "cc_")
FEATURES = [f"{PREFIXES[i % 8]}{i:02d}" for i in range(64)]
NAMES_SQL = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
CELLS_SQL = f"""
    with cell as (select vec_id, i, cast(embedding[i] as double) as v, {NAMES_SQL}[i] as feature
                  from embeddings, range(1, 65) t(i)),
    ranked as (select *, row_number() over (partition by vec_id order by abs(v) desc, feature) as pos from cell),
    importance as (select feature, avg(abs(v)) as importance from cell group by feature),
    top20 as (select * from importance order by importance desc, feature limit 20)"""
REASON_SQL = "case " + " ".join(
    f"when starts_with(feature, '{k}') then '{v}'" for k, v in S.REASONS.items()
) + f" else '{S.DEFAULT_REASON}' end"


def attributions(spark, d):
    return table(spark, d, "embeddings").withColumn("score", F.col("label") / 20.0)


def _listed(df, column, *fields):
    out = df.select("vec_id", F.posexplode(column).alias("pos", "e"))
    return out.select("vec_id", (F.col("pos") + 1).alias("pos"), *[F.col(f"e.{f}").alias(f) for f in fields])


@check("top5_reasons", CELLS_SQL + f"""
    select vec_id, cast(pos as int) as pos, feature, {REASON_SQL} as reason from ranked where pos <= 5
""")
def top5_reasons(spark, d):
    out = EX.top_reasons(attributions(spark, d), "embedding", FEATURES)
    return _listed(out, "reasons", "feature", "reason")


@check("local_top10", CELLS_SQL + f"""
    select vec_id, cast(pos as int) as pos, feature, {rounded_sql("v", 8)} as value, v > 0 as raises_risk
    from ranked where pos <= 10
""")
def local_top10(spark, d):
    out = EX.top_values(attributions(spark, d), "embedding", FEATURES)
    return round_columns(_listed(out, "top", "feature", "value", "raises_risk"), {"value": 8})


@check("global_importance", CELLS_SQL + f" select feature, {rounded_sql('importance', 8)} as importance from importance")
def global_importance(spark, d):
    return round_columns(EX.global_importance(attributions(spark, d), "embedding", FEATURES), {"importance": 8})


@check("global_top20", CELLS_SQL + f" select feature, {rounded_sql('importance', 8)} as importance from top20")
def global_top20(spark, d):
    importance = EX.global_importance(attributions(spark, d), "embedding", FEATURES)
    return round_columns(EX.top_features(importance), {"importance": 8})


@check("band_examples", """
    with scored as (select o_orderkey as id, o_totalprice / 1e6 as pd, 'orders' as source from orders
                    union all select c_custkey, c_acctbal / 1e5, 'customers' from customer),
    banded as (select *, case when pd < 0.15 then 'APPROVE' when pd < 0.35 then 'REVIEW' else 'DECLINE' end as band
               from scored)
    select s.source, b.band, coalesce(min(id) filter (where banded.band = b.band), min(id)) as example,
           count(*) filter (where banded.band = b.band) > 0 as in_band
    from (select distinct source from scored) s, (values ('APPROVE'), ('REVIEW'), ('DECLINE')) b(band)
    join banded on banded.source = s.source group by all
""")
def band_examples(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_totalprice / 1e6 as pd")
    customers = table(spark, d, "customer").selectExpr("c_custkey as id", "c_acctbal / 1e5 as pd")
    a = EX.band_examples(orders, "id", "pd").withColumn("source", F.lit("orders"))
    return a.unionByName(EX.band_examples(customers, "id", "pd").withColumn("source", F.lit("customers")))


@check("attribution_sample", CELLS_SQL + f"""
    select feature, vec_id, {rounded_sql("v", 8)} as value from cell
    where feature in (select feature from top20)
      and vec_id in (select vec_id from embeddings order by vec_id limit 500)
""")
def attribution_sample(spark, d):
    out = EX.attribution_sample(attributions(spark, d), "vec_id", "embedding", FEATURES)
    return round_columns(out, {"value": 8})
