"""Proxy groups and the fairness audit over them."""

from pyspark.sql import DataFrame, functions as F

from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.operators.categories import pool_rare, pool_rare_columns

FAMILIES = {
    "primary": "FAIR_GROUP_PRIMARY",
    "secondary": "FAIR_GROUP_SECONDARY",
    "tertiary": "FAIR_GROUP_TERTIARY",
}


def derive_groups(df, q1, q2, min_count=S.RARE_MIN_COUNT, kept=None) -> DataFrame:
    """Adds the eight group columns.

    Rare categories are pooled over the audited frame itself; `kept` (column name to
    values) takes values fitted elsewhere.
    """
    pools = {"NAME_INCOME_TYPE": "INCOME_TYPE_POOLED", "NAME_HOUSING_TYPE": "HOUSING_TYPE_POOLED"}
    kept = kept or {}
    out = df.withColumn("INCOME_TERTILE", X.income_tertile("AMT_INCOME_TOTAL", q1, q2))
    fitted = {c: p for c, p in pools.items() if kept.get(c) is None}
    out = pool_rare_columns(out, fitted, min_count) if fitted else out
    for column, pooled in pools.items():
        if column not in fitted:
            out = pool_rare(out, column, min_count, pooled, kept=kept[column])
        out = out.withColumn(pooled, F.coalesce(F.col(pooled), F.lit("MISSING")))
    out = out.withColumns(
        {
            "FAIR_GROUP_PRIMARY": X.primary_group("INCOME_TERTILE", "REGION_RATING_CLIENT_W_CITY"),
            "FAIR_GROUP_SECONDARY": X.join_groups("INCOME_TYPE_POOLED", "HOUSING_TYPE_POOLED"),
            "CHILDREN_BIN": X.children_bin("CNT_CHILDREN"),
            "OWN_ASSET_BIN": X.own_asset_bin("FLAG_OWN_CAR", "FLAG_OWN_REALTY"),
        }
    )
    return out.withColumn("FAIR_GROUP_TERTIARY", X.join_groups("OWN_ASSET_BIN", "CHILDREN_BIN"))


def eligible_cells(
    df, group, target=S.TARGET, min_rows=S.CELL_MIN_ROWS, min_defaults=S.CELL_MIN_DEFAULTS
) -> DataFrame:
    """Groups with enough rows and enough defaults."""
    cells = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("pos")
    )
    return cells.where((F.col("n") >= min_rows) & (F.col("pos") >= min_defaults))


def _counts(y, score, decision, counted) -> list:
    """Additive per-cell sums; everything a cell's metrics need."""
    approve = F.coalesce(F.col(decision) == "APPROVE", F.lit(False))
    good = F.col(y) == 0
    error = X.nan_to_null(F.col(score).cast("double")) - F.col(y)
    return [
        F.count_if(counted).alias("n"),
        F.coalesce(F.sum(F.when(counted, F.col(y).cast("long"))), F.lit(0)).alias("n_defaults"),
        F.count_if(counted & approve).alias("__approved"),
        F.count_if(counted & good).alias("__good"),
        F.count_if(counted & good & approve).alias("__good_approved"),
        F.sum(F.when(counted, error * error)).alias("__sq"),
        F.count(F.when(counted, error)).alias("__scored"),
    ]


SUMS = ("n", "n_defaults", "__approved", "__good", "__good_approved", "__sq", "__scored")


def _cell_metrics(cells, family, min_rows, min_defaults) -> DataFrame:
    """From per-cell sums to metrics and family verdicts; works on a few rows per family."""
    ok = (F.col("n") >= min_rows) & (F.col("n_defaults") >= min_defaults)
    out = cells.withColumn("evaluable", ok).withColumns(
        {
            "approve_rate": F.when(ok, X.safe_div("__approved", "n")),
            "tpr": F.when(ok, X.safe_div("__good_approved", "__good")),
            # One missing score leaves the cell without a Brier score.
            "brier_score": F.when(
                ok & (F.col("__scored") == F.col("n")), X.safe_div("__sq", "n")
            ),
        }
    )
    rates = ("approve_rate", "tpr", "brier_score")
    spread = out.groupBy(family).agg(
        *[F.max(c).alias(f"hi_{c}") for c in rates], *[F.min(c).alias(f"lo_{c}") for c in rates]
    )
    hi = {c: F.col(f"hi_{c}") for c in rates}
    lo = {c: F.col(f"lo_{c}") for c in rates}
    verdict = lambda c: F.when(F.col("evaluable"), F.coalesce(c, F.lit(False)))
    return out.join(F.broadcast(spread), family).withColumns(           # one row per family
        {
            "di_ratio": X.safe_div("approve_rate", hi["approve_rate"]),
            "eod": F.col("tpr") - hi["tpr"],
            "brier_ratio": F.when(
                lo["brier_score"] > 0, X.safe_div("brier_score", lo["brier_score"])
            ),
            "di_pass": verdict(
                X.safe_div(lo["approve_rate"], hi["approve_rate"]) >= S.DI_MIN_RATIO
            ),
            "eod_pass": verdict(hi["tpr"] - lo["tpr"] <= S.EOD_MAX_GAP),
            "brier_pass": verdict(
                X.safe_div(hi["brier_score"], lo["brier_score"]) <= S.BRIER_MAX_RATIO
            ),
        }
    ).select(family, *S.AUDIT_COLS)


def group_metrics(
    df, group, target=S.TARGET, score="CALIBRATED_PD", decision="DECISION",
    min_rows=S.CELL_MIN_ROWS, min_defaults=S.CELL_MIN_DEFAULTS,
) -> DataFrame:
    """13 columns per cell of one group column. A missing group shows as `nan` with 0 rows."""
    cells = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("nan")).alias("group_value")).agg(
        *_counts(target, score, decision, F.col(group).isNotNull())
    )
    one_family = cells.withColumn("family", F.lit(group))
    return _cell_metrics(one_family, "family", min_rows, min_defaults).drop("family")


def audit_cells(
    df, families=None, target=S.TARGET, score="CALIBRATED_PD", decision="DECISION",
    min_rows=S.CELL_MIN_ROWS, min_defaults=S.CELL_MIN_DEFAULTS,
) -> DataFrame:
    """Metrics of all families in one scan.

    The rows are reduced once to combinations of the group columns. Sums are additive,
    so the families are then summed up from those few combinations.
    """
    families = families or FAMILIES
    sums = _counts(target, score, decision, F.lit(True))
    combos = df.groupBy(*families.values()).agg(*sums)
    present = lambda g: F.col(g).isNotNull()
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("family"),
                F.coalesce(F.col(g).cast("string"), F.lit("nan")).alias("group_value"),
                *[F.when(present(g), F.col(s)).alias(s) for s in SUMS],
            )
            for f, g in families.items()
        ]
    )
    cells = combos.select(F.inline(pairs)).groupBy("family", "group_value").agg(
        *[F.sum(s).alias(s) for s in SUMS]
    )
    cells = cells.withColumns(
        {s: F.coalesce(F.col(s), F.lit(0)) for s in SUMS if s != "__sq"}
    )
    return _cell_metrics(cells, "family", min_rows, min_defaults)


def family_verdicts(cells) -> DataFrame:
    """Per family whether each metric passes; a family without evaluable cells fails."""
    out = {
        m: F.coalesce(F.bool_and(F.when(F.col("evaluable"), F.col(f"{m}_pass"))), F.lit(False))
        for m in ("di", "eod", "brier")
    }
    return cells.groupBy("family").agg(*[c.alias(m) for m, c in out.items()])


def audit_passed(verdicts, families=3) -> bool:
    """True when every family passes every metric."""
    row = verdicts.agg(
        F.count("*").alias("n"), F.bool_and(F.col("di") & F.col("eod") & F.col("brier")).alias("ok")
    ).first()
    return row["n"] == families and bool(row["ok"])
