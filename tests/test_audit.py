import math
import random

import pytest
from pyspark.sql import functions as F

from riskmart import schema as S
from riskmart.operators import evaluate as E, explain as EX, fairness as FA
from riskmart.plans import jobs
from riskmart.sources.tables import read_audit

SCHEMA = (
    "SK_ID_CURR long, TARGET int, CALIBRATED_PD double, DECISION string, AMT_INCOME_TOTAL double,"
    " REGION_RATING_CLIENT_W_CITY double, NAME_INCOME_TYPE string, NAME_HOUSING_TYPE string,"
    " FLAG_OWN_CAR string, FLAG_OWN_REALTY string, CNT_CHILDREN double"
)


def population(spark, n=1500, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pd = rng.random()
        rows.append((
            i, int(rng.random() < 0.3), pd,
            "APPROVE" if pd < 0.15 else "REVIEW" if pd < 0.35 else "DECLINE",
            rng.choice([None, rng.uniform(1e4, 5e5)]), float(rng.choice([1, 2, 3])),
            rng.choice(["Working", "Pensioner", None]), rng.choice(["House", "Rented"]),
            rng.choice(["Y", "N", None]), rng.choice(["Y", "N"]), float(rng.randrange(5)),
        ))
    return spark.createDataFrame(rows, SCHEMA), rows


# -- groups ------------------------------------------------------------------

def test_three_rows(spark):
    rows = [
        (1, 0, 0.1, "APPROVE", 50000.0, 2.0, "Working", "House", "Y", "N", 0.0),
        (2, 1, 0.2, "REVIEW", 70000.0, None, "Pensioner", "House", None, "Y", 1.0),
        (3, 0, 0.9, "DECLINE", 90000.0, 1.0, None, "House", "N", None, 3.0),
    ]
    out = FA.derive_groups(spark.createDataFrame(rows, SCHEMA), 60000, 80000).orderBy("SK_ID_CURR").collect()
    assert [r["FAIR_GROUP_PRIMARY"] for r in out] == ["T1__2", "T2__-1", "T3__1"]
    assert {r["FAIR_GROUP_SECONDARY"] for r in out} == {"OTHER__OTHER"}
    assert [r["FAIR_GROUP_TERTIARY"] for r in out] == ["Y_N__0", "N_Y__1", "N_N__2_PLUS"]


def test_frequent_missing_category_shows_as_missing(spark):
    df, _ = population(spark, 300)
    out = FA.derive_groups(df, 1e5, 2e5, min_count=50)
    assert {r[0] for r in out.select("INCOME_TYPE_POOLED").distinct().collect()} == {"Working", "Pensioner", "MISSING"}
    kept = {"NAME_INCOME_TYPE": ["Working"], "NAME_HOUSING_TYPE": ["House"]}
    out = FA.derive_groups(df, 1e5, 2e5, kept=kept)
    assert {r[0] for r in out.select("INCOME_TYPE_POOLED").distinct().collect()} == {"Working", "OTHER"}


# -- metrics -----------------------------------------------------------------

def brute_metrics(rows, group_of):
    cells = {}
    for r in rows:
        cells.setdefault(group_of(r), []).append(r)
    out = {}
    for g, rs in cells.items():
        n, bad = len(rs), sum(r[1] for r in rs)
        ok = n >= 200 and bad >= 20
        good = [r for r in rs if r[1] == 0]
        out[g] = {
            "n": n, "n_defaults": bad, "evaluable": ok,
            "approve_rate": sum(r[3] == "APPROVE" for r in rs) / n if ok else None,
            "tpr": sum(r[3] == "APPROVE" for r in good) / len(good) if ok and good else None,
            "brier_score": sum((r[2] - r[1]) ** 2 for r in rs) / n if ok else None,
        }
    return out


def test_metrics_against_brute_force(spark):
    df, rows = population(spark)
    got = {r["group_value"]: r.asDict() for r in FA.group_metrics(df, "NAME_HOUSING_TYPE").collect()}
    expected = brute_metrics(rows, lambda r: r[7])
    assert set(got) == set(expected)
    rates = [e["approve_rate"] for e in expected.values()]
    briers = [e["brier_score"] for e in expected.values()]
    tprs = [e["tpr"] for e in expected.values()]
    for g, e in expected.items():
        for k, v in e.items():
            assert got[g][k] == (pytest.approx(v) if isinstance(v, float) else v)
        assert got[g]["di_ratio"] == pytest.approx(e["approve_rate"] / max(rates))
        assert got[g]["eod"] == pytest.approx(e["tpr"] - max(tprs))
        assert got[g]["brier_ratio"] == pytest.approx(e["brier_score"] / min(briers))
        assert got[g]["di_pass"] == (min(rates) / max(rates) >= 0.8)
        assert got[g]["eod_pass"] == (max(tprs) - min(tprs) <= 0.1)
        assert got[g]["brier_pass"] == (max(briers) / min(briers) <= 1.25)


def cell(spark, n, bad, pd, decision, group="g"):
    return spark.range(n).selectExpr(
        f"'{group}' as grp", f"cast(id < {bad} as int) as TARGET",
        f"cast({pd} as double) as CALIBRATED_PD", f"'{decision}' as DECISION",
    )


def test_small_cells_have_no_metrics(spark):
    df = cell(spark, 199, 50, 0.2, "APPROVE", "few rows").unionAll(cell(spark, 300, 19, 0.2, "APPROVE", "few bad"))
    out = FA.group_metrics(df, "grp")
    assert out.columns == list(S.AUDIT_COLS)
    for r in out.collect():
        assert r["evaluable"] is False
        assert all(r[c] is None for c in S.AUDIT_COLS[3:] if c != "evaluable")
    cells = out.withColumn("family", F.lit("f"))
    assert FA.family_verdicts(cells).first().asDict() == {"family": "f", "di": False, "eod": False, "brier": False}


def test_degenerate_families(spark):
    nobody = FA.group_metrics(cell(spark, 300, 30, 0.5, "DECLINE"), "grp").first()
    assert nobody["approve_rate"] == 0 and nobody["di_ratio"] is None and nobody["di_pass"] is False
    assert nobody["eod_pass"] is True
    all_bad = FA.group_metrics(cell(spark, 300, 300, 0.5, "DECLINE"), "grp").first()
    assert all_bad["tpr"] is None and all_bad["eod_pass"] is False
    exact = FA.group_metrics(cell(spark, 300, 300, 1.0, "DECLINE"), "grp").first()
    assert exact["brier_score"] == 0 and exact["brier_ratio"] is None and exact["brier_pass"] is False


def test_one_missing_score_leaves_no_brier(spark):
    df = cell(spark, 300, 30, 0.5, "APPROVE", "a").unionAll(cell(spark, 300, 30, 0.5, "APPROVE", "b"))
    df = df.withColumn("id", F.monotonically_increasing_id()).withColumn(
        "CALIBRATED_PD", F.when((F.col("grp") == "a") & (F.col("id") == 3), None).otherwise(F.col("CALIBRATED_PD"))
    )
    got = {r["group_value"]: r for r in FA.group_metrics(df, "grp").collect()}
    assert got["a"]["brier_score"] is None and got["b"]["brier_score"] == pytest.approx(0.25)
    assert got["a"]["brier_pass"] is True


def test_missing_group_counts_no_rows(spark):
    df = cell(spark, 300, 30, 0.5, "APPROVE").unionAll(
        cell(spark, 250, 30, 0.5, "APPROVE").withColumn("grp", F.lit(None).cast("string"))
    )
    got = {r["group_value"]: (r["n"], r["n_defaults"], r["evaluable"]) for r in FA.group_metrics(df, "grp").collect()}
    assert got == {"g": (300, 30, True), "nan": (0, 0, False)}


def test_eligible_cells(spark):
    df, rows = population(spark)
    got = {r[0] for r in FA.eligible_cells(df, "NAME_HOUSING_TYPE").collect()}
    assert got == {"House", "Rented"}
    assert FA.eligible_cells(df, "NAME_HOUSING_TYPE", min_rows=10 ** 6).count() == 0


def test_full_audit_equals_three_single_audits(spark, tmp_path):
    df, _ = population(spark)
    grouped = FA.derive_groups(df, 2e5, 3e5, min_count=100)
    cells = FA.audit_cells(grouped)
    for family, column in FA.FAMILIES.items():
        single = {r["group_value"]: r.asDict() for r in FA.group_metrics(grouped, column).collect()}
        joint = {r["group_value"]: r.asDict() for r in cells.where(F.col("family") == family).collect()}
        assert set(single) == set(joint)
        for g, row in single.items():
            assert {k: joint[g][k] for k in row} == {
                k: pytest.approx(v) if isinstance(v, float) else v for k, v in row.items()
            }
    audit = jobs.full_audit(df, 2e5, 3e5, out=str(tmp_path), min_count=100)
    verdicts = audit.verdicts.collect()
    assert len(verdicts) == 3
    assert audit.passed == all(v["di"] and v["eod"] and v["brier"] for v in verdicts)
    for family in FA.FAMILIES:
        stored = read_audit(spark, str(tmp_path), family)
        assert stored.columns == list(S.AUDIT_COLS)
        assert stored.count() == cells.where(F.col("family") == family).count()


# -- evaluation --------------------------------------------------------------

def scored(spark, rows):
    return spark.createDataFrame(rows, "TARGET int, CALIBRATED_PD double")


def test_confusion_is_always_two_by_two(spark):
    out = {(r[0], r[1]): r[2] for r in E.confusion_matrix(scored(spark, [(1, 0.9), (1, 0.35), (1, None)])).collect()}
    assert out == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 2}


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("levels", [2, 7, 10 ** 6])
def test_auc_and_roc_with_ties(spark, levels):
    rng = random.Random(levels)
    rows = [(int(rng.random() < 0.4), rng.randrange(levels) / levels) for _ in range(400)]
    df = scored(spark, rows)
    assert E.auc(df).first()[0] == pytest.approx(brute_auc(rows))
    points = E.roc_points(df).collect()
    assert len(points) == len({s for _, s in rows}) + 1
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    for r in points:
        t = math.inf if r["threshold"] is None else r["threshold"]
        assert r["tp"] == sum(y == 1 and s >= t for y, s in rows)
        assert r["fp"] == sum(y == 0 and s >= t for y, s in rows)
        assert r["tpr"] == pytest.approx(r["tp"] / p) and r["fpr"] == pytest.approx(r["fp"] / n)


def test_auc_of_one_class(spark):
    assert E.auc(scored(spark, [(1, 0.2), (1, 0.4)])).first()[0] is None
    assert E.auc(scored(spark, [(0, 0.2), (1, 0.4)])).first()[0] == 1.0


def test_f_beta_sweep(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), rng.choice([None, rng.random(), 0.29, 0.07 * 3])) for _ in range(500)]
    sweep = E.f_beta_sweep(scored(spark, rows))
    got = sweep.orderBy("threshold").collect()
    assert [r["threshold"] for r in got] == E.THRESHOLDS
    for r in got:
        hit = lambda s: s is not None and s >= r["threshold"]
        tp = sum(y == 1 and hit(s) for y, s in rows)
        fp = sum(y == 0 and hit(s) for y, s in rows)
        fn = sum(y == 1 and not hit(s) for y, s in rows)
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
        assert r["fbeta"] == pytest.approx(26 * tp / (26 * tp + 25 * fn + fp))
    best = max(r["fbeta"] for r in got)
    assert E.best_threshold(sweep).first()["threshold"] == min(r["threshold"] for r in got if r["fbeta"] == best)


def test_f_beta_of_nothing(spark):
    df = scored(spark, [(0, 0.1)]).withColumn("PREDICTED", F.lit(0))
    assert E.f_beta_score(df).first()["fbeta"] == 0.0
    sweep = E.f_beta_sweep(scored(spark, []))
    assert sweep.count() == 99 and E.best_threshold(sweep).first()["threshold"] == 0.01


# -- attributions ------------------------------------------------------------

NAMES = ["EXT_SOURCE_MEAN", "CC_DPD_MAX", "BUREAU_LOAN_COUNT", "CREDIT_INCOME_RATIO", "AGE_YEARS", "POS_DPD_MEAN"]


def attributions(spark, rows):
    return spark.createDataFrame(rows, "id int, a array<double>, pd double")


def test_top_reasons(spark):
    df = attributions(spark, [(1, [-0.67, 0.5, 0.4, -0.3, 0.2, 0.1], 0.1)])
    top = EX.top_reasons(df, "a", NAMES).first()["reasons"]
    assert [t["feature"] for t in top] == NAMES[:5]
    assert top[0]["reason"] == S.DEFAULT_REASON and top[1]["reason"] == S.REASONS["CC_"]


def test_ranking_of_ties_and_missing(spark):
    df = attributions(spark, [(1, [None, 0.5, -0.5, 0.1, None, 0.0], 0.1)])
    top = EX.top_values(df, "a", NAMES, k=6).first()["top"]
    assert [t["feature"] for t in top] == [
        "BUREAU_LOAN_COUNT", "CC_DPD_MAX", "CREDIT_INCOME_RATIO", "POS_DPD_MEAN", "AGE_YEARS", "EXT_SOURCE_MEAN"
    ]
    assert [t["raises_risk"] for t in top[:3]] == [False, True, True] and top[0]["value"] == -0.5


def test_empty_or_misaligned_attributions(spark):
    df = attributions(spark, [(1, [0.1], 0.1)])
    with pytest.raises(ValueError, match="no features"):
        EX.top_reasons(df, "a", [])
    with pytest.raises(Exception, match="expected 6 attributions, found 1"):
        EX.top_reasons(df, "a", NAMES).collect()


def test_importance_and_sample(spark):
    df = attributions(spark, [(2, [0.2, -0.4, 0.0, 0.0, 0.0, None], 0.1), (1, [-0.2, 0.2, 0.0, 0.0, 0.9, 0.5], 0.5)])
    got = {r[0]: r[1] for r in EX.global_importance(df, "a", NAMES).collect()}
    assert got["EXT_SOURCE_MEAN"] == pytest.approx(0.2) and got["CC_DPD_MAX"] == pytest.approx(0.3)
    assert got["POS_DPD_MEAN"] == pytest.approx(0.5)
    top = [r["feature"] for r in EX.top_features(EX.global_importance(df, "a", NAMES), 2).collect()]
    assert top == ["POS_DPD_MEAN", "AGE_YEARS"]
    sample = EX.attribution_sample(df, "id", "a", NAMES, rows=1, k=2).collect()
    assert {(r["feature"], r["id"], r["value"]) for r in sample} == {("POS_DPD_MEAN", 1, 0.5), ("AGE_YEARS", 1, 0.9)}


def test_band_examples(spark):
    df = attributions(spark, [(3, [], 0.2), (7, [], 0.1), (5, [], 0.05)])
    got = {r["band"]: (r["example"], r["in_band"]) for r in EX.band_examples(df, "id", "pd").collect()}
    assert got == {"APPROVE": (5, True), "REVIEW": (3, True), "DECLINE": (3, False)}


# -- calibration -------------------------------------------------------------

def plain_isotonic(rows):
    """{score: share} by the min-max formula."""
    cells = {}
    for x, y in rows:
        n, k = cells.get(x, (0, 0))
        cells[x] = n + 1, k + y
    xs = sorted(cells)
    upto = [(0, 0)]
    for x in xs:
        upto.append((upto[-1][0] + cells[x][0], upto[-1][1] + cells[x][1]))
    mean = lambda a, b: (upto[b + 1][1] - upto[a][1]) / (upto[b + 1][0] - upto[a][0])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("levels", [2, 40, 250])
def test_calibration_equals_plain_isotonic(spark, levels):
    rng = random.Random(levels)
    rows = []
    for _ in range(600):
        x = rng.randrange(levels) / levels
        rows.append((x, int(rng.random() < x * x)))
    df = spark.createDataFrame(rows + [(None, 1), (0.5, None), (float("nan"), 1)], "RAW_PD double, TARGET int").repartition(7)
    fitted = E.Calibration.fit(df)
    assert fitted.share == sorted(fitted.share) and len(set(fitted.share)) == len(fitted.share)
    want = plain_isotonic(rows)
    got = {r["RAW_PD"]: r["CALIBRATED_PD"] for r in fitted.transform(df.where("RAW_PD is not null and not isnan(RAW_PD)")).collect()}
    assert {x: got[x] for x in want} == pytest.approx(want)


def test_calibration_between_blocks_and_outside(spark):
    rows = [(0.1, 0), (0.2, 0), (0.4, 1), (0.5, 0), (0.9, 1)]
    fitted = E.Calibration.fit(spark.createDataFrame(rows, "RAW_PD double, TARGET int"))
    assert (fitted.low, fitted.high, fitted.share) == ([0.1, 0.4, 0.9], [0.2, 0.5, 0.9], [0.0, 0.5, 1.0])
    asked = [0.0, 0.15, 0.3, 0.45, 0.7, 0.95, None]
    got = fitted.transform(spark.createDataFrame([(x,) for x in asked], "RAW_PD double")).collect()
    assert [r["CALIBRATED_PD"] for r in got] == pytest.approx([0.0, 0.0, 0.25, 0.5, 0.75, 1.0, None])
    none = E.Calibration.fit(spark.createDataFrame([], "RAW_PD double, TARGET int"))
    assert none.transform(spark.createDataFrame([(0.5,)], "RAW_PD double")).first()["CALIBRATED_PD"] is None


@pytest.mark.parametrize("values", [1, 3, 400])
def test_corners_of_the_curve(spark, values):
    """Points between equal steps go, also where the steps lie in different partitions."""
    rng = random.Random(values)
    rows = [(rng.randrange(values) / values, int(rng.random() < 0.3)) for _ in range(900)]
    df = spark.createDataFrame(rows, "CALIBRATED_PD double, TARGET int")
    counts = {}
    for x, y in rows:
        p, n = counts.get(x, (0, 0))
        counts[x] = p + y, n + 1 - y
    xs = sorted(counts, reverse=True)
    want = [x for i, x in enumerate(xs) if i in (0, len(xs) - 1) or counts[x] != counts[xs[i + 1]]]
    got = [r["threshold"] for r in E.roc_points(df, drop_collinear=True).collect() if r["threshold"] is not None]
    assert sorted(got, reverse=True) == want
    full = {r["threshold"]: r for r in E.roc_points(df).collect()}
    assert all(full[r["threshold"]] == r for r in E.roc_points(df, drop_collinear=True).collect())
