"""Column expressions. NULL is the only missing value; NaN never enters a frame."""

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from riskmart import schema as S


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c):
    """Missing marker of float columns coming from outside."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def safe_div(a, b) -> Column:
    """a / b, NULL when either side is missing or the divisor is zero."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def positive(c) -> Column:
    """The value where it is above zero, else NULL."""
    c = _col(c)
    return F.when(c > 0, c)


def sentinel_flag(c, value=S.SENTINEL_DAYS) -> Column:
    """1 where the column holds the sentinel; a missing value is 0."""
    return F.coalesce(_col(c) == F.lit(value), F.lit(False)).cast("tinyint")


def sentinel_to_null(c, value=S.SENTINEL_DAYS) -> Column:
    c = _col(c)
    return F.when(c != F.lit(value), c)


def cap_upper(c, cap) -> Column:
    """Values above the cap become the cap; missing stays missing."""
    c = _col(c)
    if cap is None:
        return c
    cap = F.lit(float(cap))
    return F.when(c > cap, cap).otherwise(c)


def is_missing(c) -> Column:
    return _col(c).isNull().cast("tinyint")


def sum_or_zero(c) -> Column:
    """Aggregate: sum of the present values, 0 when there are none."""
    return F.coalesce(F.sum(_col(c)), F.lit(0.0))


def share(condition) -> Column:
    """Aggregate: fraction of all rows that meet the condition; unknown counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def row_count_present(cols) -> Column:
    return reduce(add, [_col(c).isNotNull().cast("int") for c in cols])


def row_sum(cols) -> Column:
    """Sum across columns, missing = 0."""
    return reduce(add, [F.coalesce(_col(c), F.lit(0.0)) for c in cols])


def row_mean(cols) -> Column:
    """Mean across the present values of a row."""
    return safe_div(row_sum(cols), row_count_present(cols))


def row_std(cols) -> Column:
    """Sample standard deviation across the present values; NULL below two of them."""
    mean = row_mean(cols)
    squares = reduce(
        add, [F.coalesce((_col(c) - mean) * (_col(c) - mean), F.lit(0.0)) for c in cols]
    )
    return F.sqrt(safe_div(squares, positive(row_count_present(cols) - 1)))


def days_late(paid_day, due_day) -> Column:
    return F.expr(sql_days_late(quoted(paid_day), quoted(due_day)))


def decision_band(score, approve_below=S.APPROVE_BELOW, decline_from=S.DECLINE_FROM) -> Column:
    """APPROVE / REVIEW / DECLINE; a missing score declines, and so does NaN, which sorts above all."""
    score = _col(score)
    return (
        F.when(score < approve_below, F.lit("APPROVE"))
        .when(score < decline_from, F.lit("REVIEW"))
        .otherwise(F.lit("DECLINE"))
    )


def predicted_class(score, threshold) -> Column:
    """1 from the threshold on; a missing score or one that is no number is 0."""
    score = nan_to_null(_col(score).cast("double"))
    return F.coalesce(score >= F.lit(float(threshold)), F.lit(False)).cast("int")


def income_tertile(c, q1, q2) -> Column:
    c = _col(c)
    return (
        F.when(c.isNull(), F.lit("MISSING"))
        .when(c <= F.lit(float(q1)), F.lit("T1"))
        .when(c <= F.lit(float(q2)), F.lit("T2"))
        .otherwise(F.lit("T3"))
    )


def children_bin(c) -> Column:
    """0 / 1 / 2_PLUS over half-open bins; at or below -1 falls outside every bin."""
    c = F.coalesce(_col(c).cast("double"), F.lit(0.0))
    return (
        F.when(c <= -1, F.lit("nan"))
        .when(c <= 0, F.lit("0"))
        .when(c <= 1, F.lit("1"))
        .otherwise(F.lit("2_PLUS"))
    )


def primary_group(tertile, region) -> Column:
    code = F.coalesce(_col(region).cast("double"), F.lit(-1.0)).cast("int").cast("string")
    return F.concat(_col(tertile), F.lit("__"), code)


def own_asset_bin(car, realty) -> Column:
    return F.concat(
        F.coalesce(_col(car), F.lit("N")), F.lit("_"), F.coalesce(_col(realty), F.lit("N"))
    )


def join_groups(a, b) -> Column:
    return F.concat(_col(a), F.lit("__"), _col(b))


def reason_text(name, reasons=None, default=S.DEFAULT_REASON) -> Column:
    """Wording for a feature name: first prefix that matches, case-sensitive."""
    name = _col(name)
    out = F.lit(default)
    for prefix, text in reversed(list((reasons or S.REASONS).items())):
        out = F.when(name.startswith(prefix), F.lit(text)).otherwise(out)
    return out


def f_beta(tp, fp, fn, beta=5.0) -> Column:
    """F-beta from counts, 0 where it is undefined."""
    b2 = float(beta) * float(beta)
    hit = (1.0 + b2) * _col(tp)
    return F.coalesce(safe_div(hit, hit + b2 * _col(fn) + _col(fp)), F.lit(0.0))


def precedes(keys, cut) -> Column:
    """True where the key tuple sorts strictly before the literal tuple."""
    head, value = _col(keys[0]), F.lit(cut[0])
    if len(keys) == 1:
        return head < value
    return (head < value) | ((head == value) & precedes(keys[1:], cut[1:]))


def number_array(values, kind="bigint") -> Column:
    """A literal array written as one text: three plan nodes however long it is."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


# -- SQL text ----------------------------------------------------------------
#
# Wide projections and aggregates are built as text: one call per column instead of
# one per operation.

def quoted(name) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_number(value) -> str:
    kind = "double" if isinstance(value, float) else "bigint"
    return f"cast('{value!r}' as {kind})"


def sql_text(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values, kind) -> str:
    return f"cast(split('{','.join(repr(v) for v in values)}', ',') as array<{kind}>)"


def sql_ratio(a, b) -> str:
    """a / b where b is above zero, else NULL."""
    return f"case when {b} > 0 then {a} / {b} end"


def sql_days_late(paid_day, due_day) -> str:
    """Days past due, never negative; NULL if either day is missing."""
    return (
        f"case when {paid_day} is not null and {due_day} is not null"
        f" then greatest({paid_day} - {due_day}, 0D) end"
    )
