"""Application features and the fitted feature builder."""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F, types as T

from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.lineage import materialize
from riskmart.operators import aggregates, categories, selection

FULL, REDUCED = "FULL", "REDUCED"
FLAG_SUFFIX = "_IS_MISSING"


# -- stateless ---------------------------------------------------------------

def application_features(df) -> DataFrame:
    """The engineered columns next to the inputs; a pure projection."""
    for c in ("AMT_INCOME_TOTAL_CAPPED", "DAYS_EMPLOYED_ANOM"):
        if c not in df.columns:
            raise ValueError(f"{c} is missing: the prepare job has not been applied")
    return df.withColumns(
        {
            "AGE_YEARS": -F.col("DAYS_BIRTH") / F.lit(365.0),
            "CREDIT_INCOME_RATIO": X.safe_div("AMT_CREDIT", "AMT_INCOME_TOTAL_CAPPED"),
            "ANNUITY_INCOME_RATIO": X.safe_div("AMT_ANNUITY", "AMT_INCOME_TOTAL_CAPPED"),
            "GOODS_CREDIT_RATIO": X.safe_div("AMT_GOODS_PRICE", "AMT_CREDIT"),
            "CREDIT_TERM_RATIO": X.safe_div("AMT_ANNUITY", "AMT_CREDIT"),
            "EMPLOYED_BIRTH_RATIO": X.safe_div("DAYS_EMPLOYED", "DAYS_BIRTH"),
            "ID_PUBLISH_REG_RATIO": X.safe_div("DAYS_ID_PUBLISH", "DAYS_REGISTRATION"),
            "EXT_SOURCE_MEAN": X.row_mean(S.EXT_SOURCE_COLS),
            "EXT_SOURCE_STD": X.row_std(S.EXT_SOURCE_COLS),
            "SOCIAL_CIRCLE_SUM": X.row_sum(S.SOCIAL_CIRCLE_COLS),
            "BUREAU_REQUEST_SUM": X.row_sum(S.BUREAU_REQUEST_COLS),
        }
    )


def select_application(df, key=None, extra=()) -> DataFrame:
    """The key (if given), the required inputs, present group columns and extras."""
    absent = sorted(c for c in S.REQUIRED_APPLICATION_COLS if c not in df.columns)
    if absent:
        raise ValueError(f"application columns not found: {absent}")
    groups = [c for c in S.FAIRNESS_COLS if c in df.columns]
    return df.select(*([key] if key else []), *S.REQUIRED_APPLICATION_COLS, *groups, *extra)


def pre_model_frame(df, tier, tables=None, key=S.KEY, flattened=True, validate=True) -> DataFrame:
    """Inputs of the builder: application features, and child-table features for FULL.

    FULL takes the 45 child-table features from the row itself when all of them are
    there (and `flattened` allows it), otherwise from `tables`. The key, if the frame
    has one, stays as the first column; it never becomes a feature.
    """
    tier = tier.upper()
    given = set(df.columns)
    present = [c for c in S.AGGREGATE_FEATURES if c in given]
    if tier == FULL and present and len(present) < len(S.AGGREGATE_FEATURES):
        raise ValueError(f"{len(present)} of {len(S.AGGREGATE_FEATURES)} child-table features: give all or none")
    from_row = tier == FULL and flattened and bool(present)
    if tier == FULL and not from_row and (tables is None or key not in df.columns):
        raise ValueError(f"FULL needs the flattened aggregate columns, or child tables and {key}")
    lead = [key] if key in df.columns else []
    frame = select_application(df, *lead, extra=S.AGGREGATE_FEATURES if from_row else ())
    frame = application_features(frame).drop(*S.FAIRNESS_COLS)
    if tier == FULL and not from_row:
        frame = aggregates.full_mart(frame, tables, key=key, validate=validate)
    return frame.select(*lead, *numeric_inputs(tier), *S.CATEGORICAL_COLS)


def assert_no_blocked_columns(columns) -> None:
    """Keys, target, gender and group columns (and their flags) must not be features."""
    blocked = {*S.BLOCKED_COLS, *S.FAIRNESS_COLS, *[c + FLAG_SUFFIX for c in S.FAIRNESS_COLS]}
    found = [c for c in columns if c in blocked]
    if found:
        raise ValueError(f"not allowed as features: {found}")


# -- fitted pieces -----------------------------------------------------------

def _long(df, columns) -> DataFrame:
    """(i, v): the columns, cast to double, below each other.

    Aggregates over many columns group this by i: one expression that stays in
    generated code, and sums that combine before the shuffle, however many columns.
    """
    cells = ", ".join(
        f"struct({i} as i, cast({X.quoted(c)} as double) as v)" for i, c in enumerate(columns)
    )
    return df.selectExpr(f"inline(array({cells}))")


def missing_rates_of(df, columns) -> dict[str, float]:
    if not columns:
        return {}
    absent = ", ".join(f"{X.quoted(c)} is null" for c in columns)
    counts = df.selectExpr(f"posexplode(array({absent})) as (i, absent)")
    rows = counts.groupBy("i").agg(F.avg(F.col("absent").cast("double"))).collect()    # one per column
    rates = {r[0]: r[1] for r in rows}
    return {c: rates.get(i, 0.0) for i, c in enumerate(columns)}


def fit_missing_flags(df, columns, rate=S.MISSING_FLAG_RATE) -> list[str]:
    return [c for c, r in missing_rates_of(df, columns).items() if r >= rate]


def apply_missing_flags(df, columns) -> DataFrame:
    present = set(df.columns)
    flags = {c + FLAG_SUFFIX: X.is_missing(c) for c in columns if c in present}
    return df.withColumns(flags) if flags else df


def fit_imputers(df, columns) -> dict[str, float]:
    """Exact medians; 0 for a column without values."""
    found = selection.medians(df, {c: c for c in columns})
    return {c: m if m is not None else 0.0 for c, m in found.items()}


def apply_fill(df, values: dict) -> DataFrame:
    """Replaces missing values; numeric columns become double."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fills = {}
    for c, v in values.items():
        if c in types and v is not None:
            number = isinstance(types[c], T.NumericType)
            text = f"coalesce(cast({X.quoted(c)} as double), {X.sql_number(float(v))})" if number else (
                f"coalesce({X.quoted(c)}, {X.sql_text(v)})"
            )
            fills[c] = F.expr(text)
    return df.withColumns(fills) if fills else df


def _spread(summary, fill) -> float:
    """Population standard deviation of a summarised column whose missing values are filled; 1 if it is constant."""
    n, present, missing = summary.rows, summary.present, summary.rows - summary.present
    if not n or not present:
        return 1.0
    mean = (present * summary.mean + missing * fill) / n
    var = (present * (summary.variance + (summary.mean - mean) ** 2) + missing * (fill - mean) ** 2) / n
    # Rounding alone gives a constant column a variance of about this size.
    eps = 2.0 ** -52
    return 1.0 if var <= n * eps * var + (n * mean * eps) ** 2 else var ** 0.5


def fit_numeric(df, columns, rate=S.MISSING_FLAG_RATE) -> tuple[list, dict, dict]:
    """Columns to flag, medians and scales from the same passes.

    The first pass of the medians also counts missing values and gives mean and variance of
    the values; those of the filled column follow from them.
    """
    found = selection.summaries(df, columns)
    flags = [c for c, s in found.items() if s.rows and (s.rows - s.present) / s.rows >= rate]
    medians = {c: 0.0 if s.median is None else s.median for c, s in found.items()}
    return flags, medians, {c: _spread(s, medians[c]) for c, s in found.items()}


def fit_scaler(df, columns, imputers=None) -> dict[str, float]:
    """Population standard deviation of the imputed columns; 1 where a column is constant.

    Without `imputers`, missing values count as the median.
    """
    if imputers is None:
        return fit_numeric(df, columns)[2]
    if not columns:
        return {}
    rows = _long(df, columns).groupBy("i").agg(
        F.count("*").alias("n"), F.count("v").alias("present"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")
    ).collect()                                                                                # one per column
    out = {c: 1.0 for c in columns}
    for r in rows:
        c = columns[r["i"]]
        out[c] = _spread(selection.Summary(r["n"], r["present"], r["mean"], r["var"], None), float(imputers.get(c, 0.0)))
    return out


def apply_scaler(df, scales: dict) -> DataFrame:
    present = set(df.columns)
    out = {
        c: F.expr(f"cast({X.quoted(c)} as double) / {X.sql_number(float(s))}")
        for c, s in scales.items()
        if c in present
    }
    return df.withColumns(out) if out else df


def dummy_names(kept: dict, with_rare, other="OTHER") -> list[tuple[str, str]]:
    """(column, value) per dummy: columns in order, values sorted."""
    out = []
    for c, values in kept.items():
        out += [(c, v) for v in sorted(set(values) | ({other} if c in with_rare else set()))]
    return out


def one_hot(df, dummies) -> DataFrame:
    """0/1 doubles for frozen (column, value) pairs; the categorical columns go."""
    done = {c for c, _ in dummies}
    return df.selectExpr(
        *[X.quoted(c) for c in df.columns if c not in done],
        *[
            f"cast(coalesce({X.quoted(c)} = {X.sql_text(v)}, false) as double) as {X.quoted(f'{c}_{v}')}"
            for c, v in dummies
        ],
    )


# -- missing policy ----------------------------------------------------------

def fit_missing_policy(df, rate=S.MISSING_FLAG_RATE) -> tuple[list, dict, dict]:
    """Columns to flag, medians of the numeric ones, modes of the others.

    Modes come from counts grouped by (column, value), so a column with very many
    values is spread over tasks; on a tie the smallest value wins.
    """
    flags = fit_missing_flags(df, df.columns, rate)
    numeric = [c for c in flags if isinstance(df.schema[c].dataType, T.NumericType)]
    other = [c for c in flags if c not in numeric]
    medians = selection.medians(df, {c: c for c in numeric}) if numeric else {}
    modes = {c: "MISSING" for c in other}
    if other:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in other]
        )
        counts = (
            df.select(F.explode(pairs).alias("p"))
            .where(F.col("p.v").isNotNull())
            .groupBy("p.c", "p.v")
            .agg(F.count("*").alias("n"))
        )
        best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
        modes.update({r["c"]: r["b"]["v"] for r in best.collect()})     # one row per column
    return flags, medians, modes


def apply_missing_policy(df, flags, medians, modes, for_linear=False) -> DataFrame:
    out = apply_missing_flags(df, flags)
    return apply_fill(apply_fill(out, medians), modes) if for_linear else out


# -- builder -----------------------------------------------------------------

class _BuilderParams(Params):
    tier = Param(Params._dummy(), "tier", "FULL or REDUCED", TypeConverters.toString)
    numericCols = Param(Params._dummy(), "numericCols", "numeric inputs", TypeConverters.toListString)
    categoricalCols = Param(
        Params._dummy(), "categoricalCols", "categorical inputs", TypeConverters.toListString
    )
    minCount = Param(Params._dummy(), "minCount", "rows a category needs", TypeConverters.toInt)
    flagRate = Param(Params._dummy(), "flagRate", "missing rate that earns a flag", TypeConverters.toFloat)
    fill = Param(Params._dummy(), "fill", "category of missing values", TypeConverters.toString)
    other = Param(Params._dummy(), "other", "category of rare values", TypeConverters.toString)
    forLinear = Param(
        Params._dummy(), "forLinear", "impute and scale numeric columns", TypeConverters.toBoolean
    )
    featuresCol = Param(
        Params._dummy(), "featuresCol", "vector output, empty for none", TypeConverters.toString
    )


class FeatureBuilder(Estimator, _BuilderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns categories, flags, medians and scales from a pre-model frame."""

    @keyword_only
    def __init__(
        self, *, tier=REDUCED, numericCols=None, categoricalCols=None, minCount=S.RARE_MIN_COUNT,
        flagRate=S.MISSING_FLAG_RATE, fill="MISSING", other="OTHER", forLinear=False, featuresCol="",
    ):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._setDefault(
            tier=REDUCED, numericCols=[], categoricalCols=[], minCount=S.RARE_MIN_COUNT,
            flagRate=S.MISSING_FLAG_RATE, fill="MISSING", other="OTHER", forLinear=False, featuresCol="",
        )
        self._set(**given)

    def _fit(self, df):
        get = lambda p: self.getOrDefault(p)
        numeric, cats = get("numericCols"), get("categoricalCols")
        kept, with_rare = categories.fit_rare_map(df, cats, get("minCount"), get("fill"))
        # Categories are filled before flags are fitted, so only numeric columns get one.
        flags, imputers, scales = fit_numeric(df, numeric, get("flagRate"))
        dummies = dummy_names(kept, with_rare, get("other"))
        model = FeatureBuilderModel()
        model._resetUid(self.uid)
        values = {p.name: get(p.name) for p in self.params if self.isDefined(p)}
        model._set(
            **values,
            keptCategories=kept,
            flagColumns=flags,
            imputers=imputers,
            scales=scales,
            dummies=[list(d) for d in dummies],
        )
        return model


class FeatureBuilderModel(Model, _BuilderParams, DefaultParamsReadable, DefaultParamsWritable):
    """The frozen policy. `transform` is a projection: no aggregate, join or shuffle."""

    keptCategories = Param(Params._dummy(), "keptCategories", "kept values per column")
    flagColumns = Param(Params._dummy(), "flagColumns", "columns with a missing flag", TypeConverters.toListString)
    imputers = Param(Params._dummy(), "imputers", "median per numeric column")
    scales = Param(Params._dummy(), "scales", "divisor per numeric column")
    dummies = Param(Params._dummy(), "dummies", "(column, value) per dummy")

    def __init__(self):
        super().__init__()

    def setForLinear(self, value):
        return self._set(forLinear=value)

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    @property
    def pre_model_columns(self) -> list[str]:
        return [*self.getOrDefault("numericCols"), *self.getOrDefault("categoricalCols")]

    @property
    def encoded_columns(self) -> list[str]:
        flags = [c + FLAG_SUFFIX for c in self.getOrDefault("flagColumns")]
        dummies = [f"{c}_{v}" for c, v in self.getOrDefault("dummies")]
        return [*self.getOrDefault("numericCols"), *flags, *dummies]

    def _cells(self, given) -> list[str]:
        """The encoded columns in order, as SQL over the input columns."""
        get = lambda p: self.getOrDefault(p)
        linear, imputers, scales = get("forLinear"), get("imputers"), get("scales")
        value = lambda c, kind: f"cast({X.quoted(c)} as {kind})" if c in given else f"cast(null as {kind})"
        cells = []
        for c in get("numericCols"):
            number = value(c, "double")
            if linear:
                number = f"coalesce({number}, {X.sql_number(float(imputers[c]))}) / {X.sql_number(float(scales[c]))}"
            cells.append(number)
        cells += [f"cast({value(c, 'string')} is null as double)" for c in get("flagColumns")]
        for c, v in get("dummies"):
            filled, kept = f"coalesce({value(c, 'string')}, {X.sql_text(get('fill'))})", get("keptCategories")[c]
            is_value = f"{filled} = {X.sql_text(v)}" if v in kept else "false"
            if v == get("other"):
                # every value that is not kept
                rest = f"{filled} not in ({', '.join(map(X.sql_text, kept))})" if kept else "true"
                is_value = f"({is_value} or {rest})"
            cells.append(f"cast({is_value} as double)")
        return cells

    def _transform(self, df):
        get = lambda p: self.getOrDefault(p)
        encoded, inputs = self.encoded_columns, set(self.pre_model_columns)
        carried = [X.quoted(c) for c in df.columns if c not in inputs and c not in encoded]
        # cells are told apart by their place: names of values may differ in case only
        rows = df.selectExpr(*carried, f"array({', '.join(self._cells(set(df.columns)))}) as `__cells`")
        out = [F.expr(c) for c in carried] + [F.get("__cells", F.lit(i)).alias(c) for i, c in enumerate(encoded)]
        if get("featuresCol"):
            known = F.transform("__cells", lambda x: F.coalesce(x, F.lit(float("nan"))))
            out.append(array_to_vector(known).alias(get("featuresCol")))
        return rows.select(*out)


# -- credit preset -----------------------------------------------------------

def numeric_inputs(tier):
    cols = [*S.NUMERIC_COLS, "DAYS_EMPLOYED_ANOM"]
    cols += [c for c in S.ENGINEERED_COLS if c not in cols]
    return cols + (list(S.AGGREGATE_FEATURES) if tier == FULL else [])


def fit_builder(frame, tier, **params) -> FeatureBuilderModel:
    builder = FeatureBuilder(
        tier=tier, numericCols=numeric_inputs(tier), categoricalCols=list(S.CATEGORICAL_COLS), **params
    )
    return builder.fit(frame)


def fit_full_builder(train, tables, key=S.KEY, validate=True, **params) -> FeatureBuilderModel:
    """Fits on freshly aggregated child tables, whatever flattened columns the frame has."""
    base = train.drop(*S.AGGREGATE_FEATURES)
    frame = pre_model_frame(base, FULL, tables, key, False, validate)
    # The fit passes over its input several times; the child tables are scanned once.
    return fit_builder(materialize(frame), FULL, **params)


def fit_reduced_builder(train, key=S.KEY, **params) -> FeatureBuilderModel:
    return fit_builder(pre_model_frame(train, REDUCED, key=key), REDUCED, **params)


def check_tier(model, tier) -> None:
    if not isinstance(model, FeatureBuilderModel):
        raise TypeError(f"expected a FeatureBuilderModel, found {type(model).__name__}")
    if model.getOrDefault("tier").upper() != tier:
        raise ValueError(f"a builder of tier {tier} is needed here")


def _build(df, model, tier, for_linear, tables, key, validate):
    check_tier(model, tier)
    frame = pre_model_frame(df, tier, tables, key, validate=validate)
    out = model.copy({model.forLinear: for_linear}).transform(frame)
    assert_no_blocked_columns(model.encoded_columns)
    return out


def build_full(df, model, for_linear=False, tables=None, key=S.KEY, validate=True) -> DataFrame:
    """Feature matrix next to the key: flattened input or child tables."""
    return _build(df, model, FULL, for_linear, tables, key, validate)


def build_reduced(df, model, for_linear=False, key=S.KEY) -> DataFrame:
    return _build(df, model, REDUCED, for_linear, None, key, False)
