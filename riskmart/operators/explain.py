"""Feature attributions: ranked reasons, global importance, examples.

Attributions are an `array<double>` column whose elements line up with a list of
feature names, next to a row key.
"""

from pyspark.sql import DataFrame, functions as F

from riskmart.functions import expr as X


def _names(features) -> list[str]:
    features = list(features)
    if not features:
        raise ValueError("no features: cannot rank attributions")
    return features


def _ranked(attributions, features, k):
    """The k largest elements by absolute value; missing ones last, ties by feature name."""
    names = F.array(*[F.lit(f) for f in features])
    size = F.size(attributions)
    entries = F.transform(
        attributions,
        lambda x, i: F.struct(
            x.isNull().alias("absent"),
            (-F.abs(x.cast("double"))).alias("order"),
            F.get(names, i).alias("feature"),
            x.cast("double").alias("value"),
        ),
    )
    checked = F.when(size == len(features), entries).otherwise(
        F.raise_error(
            F.concat(F.lit(f"expected {len(features)} attributions, found "), size.cast("string"))
        )
    )
    return F.slice(F.array_sort(checked), 1, k)


def top_reasons(df, attributions, features, k=5, output="reasons") -> DataFrame:
    """The k strongest features of each row with their wording; stays inside the row."""
    features = _names(features)
    top = _ranked(F.col(attributions), features, k)
    return df.withColumn(
        output,
        F.transform(
            top,
            lambda e: F.struct(
                e["feature"].alias("feature"), X.reason_text(e["feature"]).alias("reason")
            ),
        ),
    )


def top_values(df, attributions, features, k=10, output="top") -> DataFrame:
    """The k strongest features of each row with signed value and direction."""
    features = _names(features)
    top = _ranked(F.col(attributions), features, k)
    return df.withColumn(
        output,
        F.transform(
            top,
            lambda e: F.struct(
                e["feature"].alias("feature"),
                e["value"].alias("value"),
                (e["value"] > 0).alias("raises_risk"),
            ),
        ),
    )


def _long(df, attributions, features, keep=()) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    size = F.size(attributions)
    message = F.concat(F.lit(f"expected {len(features)} attributions, found "), size.cast("string"))
    fits = F.when(size != len(features), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.where(fits).select(*keep, F.posexplode(attributions).alias("__i", "value")).select(
        *keep, F.get(names, F.col("__i")).alias("feature"), F.col("value").cast("double").alias("value")
    )


def global_importance(df, attributions, features) -> DataFrame:
    """Mean absolute attribution per feature; sums combine before the shuffle."""
    rows = _long(df, attributions, _names(features))
    return rows.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))


def top_features(importance, k=20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def band_examples(df, order, score="CALIBRATED_PD") -> DataFrame:
    """(band, example): the first row of each decision band, the first row of all if none."""
    bands = ("APPROVE", "REVIEW", "DECLINE")
    band = X.decision_band(score)
    one = df.agg(
        F.min(order).alias("__any"), *[F.min(F.when(band == b, F.col(order))).alias(b) for b in bands]
    )
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(b).alias("band"),
                        F.coalesce(F.col(b), F.col("__any")).alias("example"),
                        F.col(b).isNotNull().alias("in_band"),
                    )
                    for b in bands
                ]
            )
        )
    )


def attribution_sample(df, order, attributions, features, rows=500, k=20) -> DataFrame:
    """(feature, row, value) of the first rows for the globally strongest features."""
    features = _names(features)
    strongest = top_features(global_importance(df, attributions, features), k)
    first = df.select(order, attributions).orderBy(order).limit(rows)
    cells = _long(first, attributions, features, keep=[order])
    return cells.join(strongest.select("feature"), "feature", "left_semi").select(
        "feature", order, "value"
    )
