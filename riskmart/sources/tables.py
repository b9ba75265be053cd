"""Typed readers and writers. Files are Parquet, CSV or JSON in any Spark file system."""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from riskmart import schema as S
from riskmart.functions import expr as X
from riskmart.operators.features import FeatureBuilderModel

FORMATS = ("parquet", "csv")


def check_table_names(names) -> None:
    """Only known tables may be read; checked before any scan."""
    plain = {n[:-4] if n.endswith(".csv") else n for n in names}
    unknown = sorted(plain - set(S.SCORING_TABLES) - set(S.ADVERSARIAL_TABLES))
    if unknown:
        raise ValueError(f"unknown tables: {unknown}")


# Kinds of values in a text column, from narrow to wide; a column is of its widest value's kind.
NO_VALUE, WHOLE, NUMBER, TEXT = range(4)
WHOLE_FORM = r"^\\s*[+-]?[0-9]+\\s*$"
NUMBER_FORM = r"^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$|^\\s*[+-]?([iI]nf|INF|[iI]nfinity|INFINITY)\\s*$"


def infer_types(df, columns=None) -> dict:
    """The type of each text column: long < double < text, the narrowest that holds all its values.

    One aggregate over all rows: every value has a kind, and kinds combine by their maximum,
    within tasks first. A column without any value is double; whole numbers beyond 64 bits are
    doubles.
    """
    columns = list(df.columns if columns is None else columns)
    if not columns:
        return {}
    values = ", ".join(X.quoted(c) for c in columns)
    kind = (
        f"case when v is null then {NO_VALUE}"
        f" when v rlike '{WHOLE_FORM}' and try_cast(trim(v) as bigint) is not null then {WHOLE}"
        f" when v rlike '{NUMBER_FORM}' then {NUMBER} else {TEXT} end"
    )
    cells = df.selectExpr(f"posexplode(array({values})) as (i, v)")
    kinds = dict(cells.groupBy("i").agg(F.expr(f"max({kind})")).collect())                 # one per column
    types = {NO_VALUE: T.DoubleType(), WHOLE: T.LongType(), NUMBER: T.DoubleType(), TEXT: T.StringType()}
    return {c: types[kinds.get(i, NO_VALUE)] for i, c in enumerate(columns)}


def to_type(c, data_type):
    """Text to a typed value; text that is no such value fails the job."""
    if isinstance(data_type, (T.LongType, T.IntegerType)):
        whole = c.try_cast(data_type)
        return F.when(c.isNotNull() & whole.isNull(), c.cast("double").cast(data_type)).otherwise(whole)
    if isinstance(data_type, T.DoubleType):
        return X.nan_to_null(c.cast("double"))
    return c.cast(data_type)


def read_csv(spark, path, types=None, columns=None, multi_line=False, infer=True) -> DataFrame:
    """CSV with a header. Missing markers become NULL.

    Columns without a given type get the one that `infer_types` finds, at the cost of a pass
    over them; with `infer=False` they stay text.
    """
    text = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("inferSchema", False)
        .csv(path)
    )
    types = dict(types or {})
    wanted = list(columns or text.columns)
    missing = [F.when(~F.col(X.quoted(c)).isin(list(S.MISSING_MARKERS)), F.col(X.quoted(c))).alias(c) for c in wanted]
    text = text.select(*missing)
    if infer:
        types.update(infer_types(text, [c for c in wanted if c not in types]) if set(wanted) - set(types) else {})
    return text.select(*[
        (to_type(F.col(X.quoted(c)), types[c]) if c in types else F.col(X.quoted(c))).alias(c) for c in wanted
    ])


def read_parquet(spark, path, types=None, columns=None) -> DataFrame:
    """Parquet; NaN becomes NULL in floating-point columns."""
    df = spark.read.parquet(path)
    types = types or {}
    exprs = []
    for c in columns or df.columns:
        col = F.col(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            col = X.nan_to_null(col)
        exprs.append((col.cast(types[c]) if c in types else col).alias(c))
    return df.select(*exprs)


def read_table(spark, folder, name, fmt="csv", columns=None) -> DataFrame:
    """One of the known tables with its types; `columns` limits the scan."""
    check_table_names([name])
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = read_csv if fmt == "csv" else read_parquet
    return reader(spark, f"{folder.rstrip('/')}/{name}.{fmt}", S.TABLE_TYPES[name], columns)


def read_tables(spark, folder, names=S.SCORING_TABLES, fmt="csv") -> dict[str, DataFrame]:
    check_table_names(names)
    return {n: read_table(spark, folder, n, fmt) for n in names}


def enforce_schema(df, types=None, required=True) -> DataFrame:
    """Casts the listed columns that are present; others pass through.

    A value that does not fit fails the job, and so does a missing value in a whole-number
    column (`required=False` lets it pass as NULL).
    """
    types = S.APPLICATION_TYPES if types is None else types
    exprs = []
    for c in df.columns:
        col = F.col(c)
        if c in types:
            col = col.cast(types[c])
            if required and isinstance(types[c], (T.LongType, T.IntegerType)):
                missing = F.raise_error(F.lit(f"{c} has missing values")).cast(types[c])
                col = F.coalesce(col, missing)
        exprs.append(col.alias(c))
    return df.select(*exprs)


# -- splits and bundles ------------------------------------------------------

def write_split(df, path, column="split", mode="overwrite") -> None:
    """One folder per split, so reading one split reads only its files."""
    df.write.mode(mode).partitionBy(column).parquet(path)


def read_split(spark, path, name, column="split", names=S.SPLIT_NAMES) -> DataFrame:
    if names and name not in names:
        raise ValueError(f"unknown split {name}")
    return spark.read.parquet(path).where(F.col(column) == name).drop(column)


def verify_written(df, path, column=None, rows=None) -> int:
    """Row count and schema of what was written, against the source; returns the rows.

    With `rows`, known from the source's own files, the source is not read again, and the rows
    that are stored are counted from the files' numbers: no row is scanned.
    """
    stored = df.sparkSession.read.parquet(path)
    wanted, found = df.count() if rows is None else rows, stored.count()
    if wanted != found:
        raise ValueError(f"{path} holds {found} of {wanted} rows")
    skip = {column} if column else set()
    shape = lambda d: {f.name: f.dataType.simpleString() for f in d.schema if f.name not in skip}
    if shape(df) != shape(stored):
        raise ValueError(f"{path} has another schema: {shape(stored)}")
    return found


# -- scalars, reports, audit tables -----------------------------------------

def write_value(spark, path, name, value) -> None:
    """One named number or truth value as a one-row JSON dataset."""
    kind = "boolean" if isinstance(value, bool) else "double"
    row = [(value if kind == "boolean" or value is None else float(value),)]
    spark.createDataFrame(row, f"{name} {kind}").write.mode("overwrite").json(path)


def read_value(spark, path, name, kind="double"):
    return spark.read.schema(f"{name} {kind}").json(path).first()[name]


def write_audit(cells, path) -> None:
    """A CSV per family, 13 columns, one write; audits are a few dozen rows, so a file each will do."""
    rows = cells.select("family", *S.AUDIT_COLS).repartition(1).sortWithinPartitions("family", "group_value")
    rows.write.mode("overwrite").option("header", True).partitionBy("family").csv(f"{path}/audit")


def read_audit(spark, path, family) -> DataFrame:
    """The CSV of one family, as text."""
    return spark.read.option("header", True).csv(f"{path}/audit").where(F.col("family") == family).drop("family")


def write_report(report, path) -> None:
    """A one-row report as JSON."""
    report.write.mode("overwrite").json(path)


# -- fitted builder ----------------------------------------------------------

def path_exists(spark, path) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def load_or_fit_builder(spark, path, fit) -> FeatureBuilderModel:
    """The saved builder, or a newly fitted one that is saved there.

    Something else stored under the path is a TypeError; errors of the storage stay what they are.
    """
    if not path_exists(spark, path):
        fit().write().save(path)
    stored = None
    if path_exists(spark, f"{path}/metadata"):
        line = spark.read.text(f"{path}/metadata").first()
        try:
            stored = json.loads(line["value"])["class"] if line else None
        except (ValueError, KeyError, TypeError):
            stored = None
    if stored != f"{FeatureBuilderModel.__module__}.{FeatureBuilderModel.__name__}":
        raise TypeError(f"{path} must contain a FeatureBuilderModel")
    return FeatureBuilderModel.load(path)
