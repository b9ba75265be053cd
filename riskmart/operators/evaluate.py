"""Evaluation of scores against outcomes."""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.lineage import materialize
from riskmart.operators.ordering import bucket_of, running_sums

THRESHOLDS = [0.01 + i * 0.01 for i in range(99)]


def confusion_matrix(df, target=S.TARGET, score="CALIBRATED_PD", threshold=S.DECLINE_FROM) -> DataFrame:
    """(actual, predicted, n): always four rows."""
    y, hat = F.col(target), X.predicted_class(score, threshold)
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    one = df.agg(*[F.count_if((y == a) & (hat == p)).alias(f"n{a}{p}") for a, p in cells])
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("n")
                    )
                    for a, p in cells
                ]
            )
        )
    )


def score_counts(df, target=S.TARGET, score="CALIBRATED_PD") -> DataFrame:
    """Positives and negatives per distinct score; a much-repeated score is one row, a NaN is missing."""
    return (
        df.select(target, X.nan_to_null(F.col(score).cast("double")).alias("threshold"))
        .where("threshold is not null")
        .groupBy("threshold")
        .agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg"))
    )


@dataclass
class Curve:
    """Distinct scores from high to low with what lies above them and next below; and totals."""

    scores: DataFrame
    positives: int
    negatives: int


def curve(df, target=S.TARGET, score="CALIBRATED_PD") -> Curve:
    """The base of ROC points and area; both can be had from one curve."""
    scores, totals = running_sums(score_counts(df, target, score), "threshold", ("pos", "neg"), following=True)
    return Curve(scores, totals["pos"], totals["neg"])


def roc_points(df, target=S.TARGET, score="CALIBRATED_PD", drop_collinear=False) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at every distinct score, and the origin with no threshold.

    Rates are NULL when the outcome they are a share of does not occur. With `drop_collinear`,
    a point between two equal steps goes: the next lower score adds as many positives and
    negatives as its own. The highest and the lowest score stay. `df` may be a Curve.
    """
    base = df if isinstance(df, Curve) else curve(df, target, score)
    rows = base.scores
    if drop_collinear:
        same = (F.col("pos") == F.col("pos_next")) & (F.col("neg") == F.col("neg_next"))
        highest = (F.col("pos_above") == 0) & (F.col("neg_above") == 0)
        rows = rows.where(highest | ~F.coalesce(same, F.lit(False)))
    points = rows.select(
        "threshold",
        (F.col("pos_above") + F.col("pos")).alias("tp"),
        (F.col("neg_above") + F.col("neg")).alias("fp"),
    )
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    origin = rows.sparkSession.range(1).select(none.alias("threshold"), zero.alias("tp"), zero.alias("fp"))
    return origin.unionByName(points).select(
        "threshold", "tp", "fp",
        X.safe_div("tp", F.lit(base.positives)).alias("tpr"),
        X.safe_div("fp", F.lit(base.negatives)).alias("fpr"),
    )


def auc(df, target=S.TARGET, score="CALIBRATED_PD") -> DataFrame:
    """One row: exact area under the ROC curve with ties; NULL with one class only. `df` may be a Curve."""
    base = df if isinstance(df, Curve) else curve(df, target, score)
    area = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
    return base.scores.agg(X.safe_div(area, F.lit(float(base.positives) * float(base.negatives))).alias("auc"))


def f_beta_score(df, target=S.TARGET, predicted="PREDICTED", beta=5.0) -> DataFrame:
    """One row: F-beta of a 0/1 prediction, 0 where undefined."""
    y, hat = F.col(target), F.col(predicted)
    counts = df.agg(
        F.count_if((y == 1) & (hat == 1)).alias("tp"),
        F.count_if((y == 0) & (hat == 1)).alias("fp"),
        F.count_if((y == 1) & (hat == 0)).alias("fn"),
    )
    return counts.select("tp", "fp", "fn", X.f_beta("tp", "fp", "fn", beta).alias("fbeta"))


def f_beta_sweep(
    df, target=S.TARGET, score="CALIBRATED_PD", beta=5.0, thresholds=None
) -> DataFrame:
    """(threshold, tp, fp, fn, fbeta) per threshold from one scan.

    Each row falls into the bucket of the thresholds it reaches; a threshold's counts
    are the sums over the buckets from it upwards, at most one bucket per threshold.
    """
    cuts = thresholds or THRESHOLDS
    known = df.select(
        F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")), F.lit(-float("inf")))
        .alias("__score"),
        F.col(target).alias("__y"),
    )
    buckets = bucket_of(known, "__score", cuts, "b").groupBy("b").agg(
        F.count_if(F.col("__y") == 1).alias("pos"), F.count_if(F.col("__y") == 0).alias("neg")
    )
    gathered = buckets.agg(F.collect_list(F.struct("b", "pos", "neg")).alias("bs"))
    levels = F.array(
        *[F.struct(F.lit(i + 1).alias("level"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)]
    )
    total = lambda name, cond: F.aggregate(
        F.filter("bs", cond), F.lit(0).cast("long"), lambda acc, e: acc + e[name]
    )
    rows = gathered.select("bs", F.inline(levels)).select(
        "threshold",
        total("pos", lambda e: e["b"] >= F.col("level")).alias("tp"),
        total("neg", lambda e: e["b"] >= F.col("level")).alias("fp"),
        total("pos", lambda e: e["b"] < F.col("level")).alias("fn"),
    )
    return rows.withColumn("fbeta", X.f_beta("tp", "fp", "fn", beta))


def best_threshold(sweep) -> DataFrame:
    """The lowest threshold among those with the highest F-beta."""
    return sweep.orderBy(F.desc("fbeta"), F.asc("threshold")).limit(1)


# -- calibration -------------------------------------------------------------

def _pooled(low, high, rows, hits):
    """Pools neighbouring blocks until their shares of hits rise; whole numbers, so exactly."""
    out = []
    for block in zip(low.tolist(), high.tolist(), rows.tolist(), hits.tolist()):
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            lo, _, n, k = out.pop()
            block = lo, block[1], n + block[2], k + block[3]
        out.append(block)
    return out


def calibration_blocks(df, target=S.TARGET, score="RAW_PD") -> DataFrame:
    """(low, high, n, hits), stored: isotonic regression of a 0/1 target on a score.

    Pool-adjacent-violators: rows become distinct scores with their counts, each range
    partition of them pools its own, and what remains is pooled once more. Shares rise from
    block to block, and N rows of a 0/1 target have at most about 3 N^(2/3) different rising shares,
    so that the last step is small. Rows without score or target take no part.
    """
    counted = score_counts(df, target, score).where("pos + neg > 0")
    cells = counted.selectExpr("threshold as low", "threshold as high", "pos + neg as n", "pos as hits")

    def pool(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        blocks = _pooled(*(table.column(i).to_numpy() for i in range(4)))
        columns = [pa.array(c) for c in zip(*blocks)]
        yield pa.RecordBatch.from_arrays(columns, names=["low", "high", "n", "hits"])

    kinds = "low double, high double, n long, hits long"
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = materialize(cells.repartitionByRange(partitions, "low").sortWithinPartitions("low").mapInArrow(pool, kinds))
    return materialize(local.repartition(1).sortWithinPartitions("low").mapInArrow(pool, kinds))


@dataclass
class Calibration:
    """Fitted blocks of rising shares; between two blocks a score's share is interpolated."""

    low: list
    high: list
    share: list

    @classmethod
    def fit(cls, df, target=S.TARGET, score="RAW_PD"):
        blocks = calibration_blocks(df, target, score).orderBy("low").toArrow()
        low, high, n, hits = (blocks.column(i).to_pylist() for i in range(4))
        return cls(low, high, [k / m for k, m in zip(hits, n)])

    def transform(self, df, score="RAW_PD", output="CALIBRATED_PD") -> DataFrame:
        """Adds the calibrated score; missing scores stay missing, those outside get the end's share."""
        if not self.low:
            return df.withColumn(output, F.lit(None).cast("double"))
        numbers = {k: X.number_array(v, "double") for k, v in vars(self).items()}
        at = lambda name, step=0: F.get(numbers[name], F.col("__block") + step)
        score_of = F.col(score)
        way = (score_of - at("high")) / (at("low", 1) - at("high"))
        between = at("share") + (at("share", 1) - at("share")) * way
        inside = (score_of <= at("high")) | (F.col("__block") == len(self.low) - 1)
        placed = bucket_of(df, score, self.low[1:], "__block") if len(self.low) > 1 else df.withColumn("__block", F.lit(0))
        value = F.when(score_of.isNotNull(), F.when(inside, at("share")).otherwise(between))
        return placed.withColumn(output, value).drop("__block")


def score_batch(
    features, model, calibrator=None, score="CALIBRATED_PD", decision="DECISION",
    probability="probability", positive=1,
) -> DataFrame:
    """Scores, calibrates and bands rows with fitted models; lazy.

    `model` adds a probability vector. `calibrator` is a Calibration, or a fitted isotonic model
    of Spark ML, that takes the raw score from `RAW_PD`; without one the raw score stands. A
    score that is no number is missing.
    """
    scored = model.transform(features).withColumn(
        "RAW_PD", X.nan_to_null(vector_to_array(F.col(probability)).getItem(positive))
    )
    if calibrator is None:
        scored = scored.withColumn(score, F.col("RAW_PD"))
    elif isinstance(calibrator, Calibration):
        scored = calibrator.transform(scored, "RAW_PD", score)
    else:
        scored = calibrator.transform(scored).withColumnRenamed(
            calibrator.getOrDefault("predictionCol"), score
        ).withColumn(score, X.nan_to_null(score))
    return scored.withColumn(decision, X.decision_band(score))
