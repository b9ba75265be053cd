"""The prepare, audit and profile jobs."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.lineage import materialize
from riskmart.operators import (
    evaluate, explain, fairness, features, ordering, profile, sampling, selection,
)
from riskmart.sources import tables as IO

CAPPED = "AMT_INCOME_TOTAL_CAPPED"
SENTINEL_FLAG = "DAYS_EMPLOYED_ANOM"


def clean_application(app) -> DataFrame:
    """Typed application rows with the employment sentinel turned into a flag."""
    app = IO.enforce_schema(app)
    return app.withColumns(
        {SENTINEL_FLAG: X.sentinel_flag("DAYS_EMPLOYED"), "DAYS_EMPLOYED": X.sentinel_to_null("DAYS_EMPLOYED")}
    )


def clean_previous(previous, columns=S.PREVIOUS_SENTINEL_COLS) -> DataFrame:
    """The same for the day columns of previous applications that are present."""
    out = {}
    for c in columns:
        if c in previous.columns:
            out[f"{c}_ANOM"] = X.sentinel_flag(c)
            out[c] = X.sentinel_to_null(c)
    return previous.withColumns(out) if out else previous


@dataclass
class Prepared:
    """What the prepare job hands on; frames are lazy."""

    splits: DataFrame
    adversarial: DataFrame
    previous: DataFrame
    income_cap: float | None
    report: DataFrame
    rows: int
    test_rows: int


def prepare(tables: dict, target=S.TARGET) -> Prepared:
    """Cleans, orders, splits and caps the applications.

    Needs application_train, application_test and previous_application. The split is
    a label column; the cap is the 99th percentile of the train split alone. Both
    application tables are stored once, typed and cleaned: finding medians, cuts and
    samples takes several passes, which then read a column or two of Parquet.
    """
    app = materialize(clean_application(tables["application_train"]))
    test = materialize(tables["application_test"])
    split = ordering.ordered_split(app)
    train = split.where(F.col("split") == "train")
    cap = selection.exact_quantiles(train, {"v": "AMT_INCOME_TOTAL"}, [0.99])["v"][0]
    capped = split.withColumn(CAPPED, X.cap_upper("AMT_INCOME_TOTAL", cap))
    report = profile.quality_report(
        split, "split", "application_train", target, SENTINEL_FLAG,
        f"DAYS_EMPLOYED_{S.SENTINEL_DAYS}", cap,
    )
    return Prepared(
        splits=capped,
        adversarial=sampling.adversarial_set(app, test),
        previous=clean_previous(tables["previous_application"]),
        income_cap=cap,
        report=report,
        rows=app.count(),           # of stored files
        test_rows=test.count(),
    )


def run_prepare(spark, raw, out, fmt="csv", verify=True, profiles=True) -> Prepared:
    """Reads the raw tables, writes splits, adversarial set, cap, report and profile tables under `out`.

    Verification scans nothing again: what went in and what was written are counted from the
    numbers in the stored files.
    """
    names = ("application_train", "application_test", "previous_application")
    done = prepare(IO.read_tables(spark, raw, names, fmt))
    IO.write_split(done.splits, f"{out}/splits")
    IO.write_split(done.adversarial, f"{out}/adversarial", column="part")
    IO.write_value(spark, f"{out}/income_cap", "income_cap", done.income_cap)
    IO.write_report(done.report, f"{out}/quality_report")
    stored = spark.read.parquet(f"{out}/splits")
    if verify:
        rows = IO.verify_written(done.splits, f"{out}/splits", "split", done.rows)
        IO.verify_written(done.adversarial, f"{out}/adversarial", "part", 2 * min(done.rows, done.test_rows))
        profile.assert_split_sizes(stored, rows)
        val = IO.read_split(spark, f"{out}/adversarial", "val", "part", names=None)
        profile.assert_balanced(val, "ADV_LABEL")
    if profiles:
        for name, table in prepare_profile(stored, done.income_cap).items():
            table.write.mode("overwrite").parquet(f"{out}/profile/{name}")
    return done


@dataclass
class Audit:
    """Audit tables; cells and verdicts are small."""

    passed: bool
    cells: DataFrame
    verdicts: DataFrame


def full_audit(
    scored, q1, q2, out=None, min_count=S.RARE_MIN_COUNT, kept=None,
    min_rows=S.CELL_MIN_ROWS, min_defaults=S.CELL_MIN_DEFAULTS,
) -> Audit:
    """Three families, three metrics each; passes only if all nine do.

    The cells are stored once; verdicts and files come from them.
    """
    grouped = fairness.derive_groups(scored, q1, q2, min_count, kept)
    cells = materialize(fairness.audit_cells(grouped, min_rows=min_rows, min_defaults=min_defaults))
    verdicts = fairness.family_verdicts(cells)
    if out:
        IO.write_audit(cells, out)
    return Audit(fairness.audit_passed(verdicts), cells, verdicts)


def income_cuts(train, column="AMT_INCOME_TOTAL") -> tuple[float, float]:
    """The two tertile cuts of the train split."""
    return tuple(selection.exact_quantiles(train, {"v": column}, [1 / 3, 2 / 3])["v"])


def run_audit(
    spark, splits, tables, model, calibrator, builder_path, out,
    attributions=None, feature_names=None, key=S.KEY, for_linear=False,
) -> dict:
    """Scores the test split with fitted models, audits it and writes every table.

    `attributions` (key, `array<double>` column `attribution`) adds the explanation
    tables. Scores meet the raw group columns by key.
    """
    train = IO.read_split(spark, splits, "train")
    test = IO.read_split(spark, splits, "test")
    builder = IO.load_or_fit_builder(
        spark, builder_path, lambda: features.fit_full_builder(train, tables, key)
    )
    matrix = features.build_full(
        test, builder.copy().setFeaturesCol("features"), for_linear, tables, key
    )
    scored = evaluate.score_batch(matrix.select(key, "features"), model, calibrator)
    raw = [c for c in ("AMT_INCOME_TOTAL", *S.FAIRNESS_COLS) if c in test.columns]
    audit_frame = test.select(key, S.TARGET, *raw).join(
        scored.select(key, "CALIBRATED_PD", "DECISION"), key
    )
    # Every table below reads the scores: store them once instead of scoring again.
    audit_frame.write.mode("overwrite").parquet(f"{out}/scores")
    audit_frame = spark.read.parquet(f"{out}/scores")
    audit = full_audit(audit_frame, *income_cuts(train), out=out)
    written = evaluation_tables(audit_frame)
    written["verdicts"] = audit.verdicts
    if attributions is not None:
        explained = materialize(
            attributions.select(key, "attribution").join(audit_frame.select(key, "CALIBRATED_PD"), key)
        )
        written.update(explanation_tables(explained, key, "attribution", feature_names))
    for name, table in written.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    IO.write_value(spark, f"{out}/audit_passed", "audit_passed", audit.passed)
    return {"passed": audit.passed, "tables": sorted(written)}


# -- tables behind the charts ------------------------------------------------

def prepare_profile(splits, cap, target=S.TARGET) -> dict[str, DataFrame]:
    """Class balance, missing rates, correlations, and four before/after histograms."""
    train = splits.where(F.col("split") == "train")
    inputs = [c for c in splits.columns if c not in ("split", CAPPED)]
    with_sentinel = F.when(F.col(SENTINEL_FLAG) == 1, F.lit(float(S.SENTINEL_DAYS))).otherwise(
        F.col("DAYS_EMPLOYED")
    )
    return {
        "class_balance": profile.value_counts(train, target),
        "missing_top": profile.top_missing(splits, 40, inputs),
        "correlations": profile.correlations(train, [*S.EXT_SOURCE_COLS, target]),
        "employed_raw": profile.histogram(splits.select(with_sentinel.alias("v")), "v", 50),
        "employed_clean": profile.histogram(splits, "DAYS_EMPLOYED", 50),
        "income_raw": profile.histogram(train, "AMT_INCOME_TOTAL", 60, clip_upper=2e6),
        "income_capped": profile.histogram(train, CAPPED, 60),
    }


def evaluation_tables(scored, target=S.TARGET, score="CALIBRATED_PD") -> dict[str, DataFrame]:
    """ROC points and area share one curve, the best threshold reads the stored sweep."""
    base = evaluate.curve(scored, target, score)
    sweep = materialize(evaluate.f_beta_sweep(scored, target, score))
    return {
        "confusion": evaluate.confusion_matrix(scored, target, score),
        "roc": evaluate.roc_points(base),
        "auc": evaluate.auc(base),
        "fbeta_sweep": sweep,
        "best_threshold": evaluate.best_threshold(sweep),
    }


def explanation_tables(df, key, attributions, names, score="CALIBRATED_PD") -> dict[str, DataFrame]:
    importance = explain.global_importance(df, attributions, names)
    examples = explain.band_examples(df, key, score)
    local = examples.join(df.select(F.col(key).alias("example"), attributions, score), "example")
    return {
        "reasons": explain.top_reasons(df, attributions, names).select(key, "reasons"),
        "importance": importance,
        "importance_top": explain.top_features(importance),
        "attribution_sample": explain.attribution_sample(df, key, attributions, names),
        "local_examples": explain.top_values(local, attributions, names).drop(attributions),
    }
