"""Scalar column functions. Every function maps Columns to a Column
built from Spark built-ins, so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rfmspark.schemas import PSI_MONITOR_UP_TO, PSI_STABLE_BELOW

_MICROS_PER_DAY = 86_400_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fn_day_diff(start, end) -> Column:
    """Whole 24-hour periods from ``start`` to ``end``, floored (not calendar dates)."""
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return F.floor(micros / F.lit(_MICROS_PER_DAY)).cast("bigint")


def fn_recency_days(last, as_of) -> Column:
    return fn_day_diff(last, as_of)


def fn_lifetime_days(first, last) -> Column:
    return fn_day_diff(first, last)


def fn_avg_order_value(monetary, frequency) -> Column:
    return F.try_divide(_c(monetary).cast("double"), _c(frequency).cast("double"))


def fn_purchase_freq_monthly(frequency, lifetime_days) -> Column:
    return F.try_divide(_c(frequency).cast("double"), (_c(lifetime_days) + F.lit(30)).cast("double")) * F.lit(30.0)


def fn_avg_qty_per_order(total_quantity, frequency) -> Column:
    return F.try_divide(_c(total_quantity).cast("double"), _c(frequency).cast("double"))


def fn_log1p(c) -> Column:
    return F.log1p(_c(c).cast("double"))


def fn_split_date(min_date, months: int) -> Column:
    """``min_date`` plus whole calendar months, keeping the time of day."""
    return _c(min_date) + F.make_ym_interval(F.lit(0), F.lit(int(months)))


def fn_month(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def fn_format_ts(ts, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_c(ts), pattern)


def fn_clean_customer_id(c) -> Column:
    """Text id with a trailing ``.0`` removed, then trimmed."""
    return F.trim(F.regexp_replace(_c(c).cast("string"), r"\.0$", ""))


def fn_id_float_to_str(c) -> Column:
    """Float id -> integer -> text (``12345.0`` -> ``'12345'``)."""
    return _c(c).cast("double").cast("bigint").cast("string")


def fn_to_int_default(c, default: int = 1) -> Column:
    """Coerce to a number first, then truncate; unparseable -> ``default``."""
    return F.coalesce(try_to_double(c).cast("int"), F.lit(int(default)))


def fn_to_double_default(c, default: float = 0.0) -> Column:
    return F.coalesce(try_to_double(c), F.lit(float(default)))


def try_to_double(c) -> Column:
    """``try_cast(trim(c) as double)``: NULL on failure, never raises."""
    return F.trim(_c(c).cast("string")).try_cast("double")


# Accepted textual timestamp layouts for uploads, tried in order (month first where both readings fit).
TIMESTAMP_FORMATS = ["yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS][XXX]", "yyyy-MM-dd HH:mm[:ss][.SSSSSSSSS][XXX]", "yyyy-MM-dd",
                     "yyyy/M/d H:mm[:ss]", "yyyy/M/d", "M/d/yyyy H:mm[:ss]", "M/d/yyyy", "d/M/yyyy H:mm[:ss]", "d/M/yyyy",
                     "M/d/yy H:mm[:ss]", "M/d/yy", "d-MMM-yyyy H:mm[:ss]", "d-MMM-yyyy", "d.M.yyyy H:mm[:ss]", "d.M.yyyy"]


# Shapes of the texts that a format can parse (and others): an attempt that fails costs an exception, far more than the look.
_YEAR, _MONTH, _DAY = r"[+-]?\d{4,}", r"0*(?:1[0-2]|[1-9])", r"0*(?:[12]\d|3[01]|[1-9])"
_DATE_SHAPES = {"yyyy-MM-dd": f"{_YEAR}-{_MONTH}-{_DAY}", "yyyy/M/d": f"{_YEAR}/{_MONTH}/{_DAY}", "M/d/yyyy": f"{_MONTH}/{_DAY}/{_YEAR}",
                "d/M/yyyy": f"{_DAY}/{_MONTH}/{_YEAR}", "M/d/yy": f"{_MONTH}/{_DAY}/\\d\\d", "d-MMM-yyyy": f"{_DAY}-[^-]+-{_YEAR}",
                "d.M.yyyy": rf"{_DAY}\.{_MONTH}\.{_YEAR}"}


def timestamp_shape(fmt: str) -> str | None:
    """Pattern that every text of a format of ``TIMESTAMP_FORMATS`` matches; none for other formats."""
    date, gap, _ = fmt.partition("'T'" if "'T'" in fmt else " ")
    if fmt not in TIMESTAMP_FORMATS or date not in _DATE_SHAPES:
        return None
    return rf"\A{_DATE_SHAPES[date]}" + (("[Tt]" if "T" in gap else " ") + ".+" if gap else "") + r"\z"


def fn_to_timestamp_safe(c, formats=None) -> Column:
    """Parse text with the first matching format; unparseable -> NULL."""
    col = F.trim(_c(c).cast("string"))

    def attempt(fmt):
        read, shape = F.try_to_timestamp(col, F.lit(fmt)), timestamp_shape(fmt)
        return F.when(col.rlike(shape), read) if shape else read
    return F.coalesce(*[attempt(f) for f in (formats or TIMESTAMP_FORMATS)]).cast("timestamp_ntz")


def fn_strip(c) -> Column:
    return F.trim(_c(c))


def fn_startswith(c, prefix: str) -> Column:
    return _c(c).startswith(prefix)


def fn_is_cancelled(invoice) -> Column:
    """Cancelled invoice: trimmed number starts with ``C`` (case-sensitive)."""
    return F.coalesce(F.trim(_c(invoice)).startswith("C"), F.lit(False))


def fn_truncate_label(c, n: int = 20) -> Column:
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def fn_title_case(c) -> Column:
    return F.initcap(F.regexp_replace(_c(c), "_", " "))


def fn_l2_distance(a, b) -> Column:
    """Euclidean distance of two equally long ``array<double>`` columns."""
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def fn_l2_distance_cols(xs: list, ys: list) -> Column:
    """Euclidean distance between two lists of scalar columns (no arrays built)."""
    acc = None
    for x, y in zip(xs, ys):
        t = (_c(x) - _c(y)) * (_c(x) - _c(y))
        acc = t if acc is None else acc + t
    return F.sqrt(acc)


def fn_psi_term(actual, expected) -> Column:
    a, e = _c(actual), _c(expected)
    return (a - e) * F.log(a / e)


def fn_psi_status(psi) -> Column:
    p = _c(psi)
    return (F.when(p < PSI_STABLE_BELOW, "Stable")
            .when(p <= PSI_MONITOR_UP_TO, "Monitor")
            .otherwise("Retrain Alert"))


def fn_clip(c, lo=None, hi=None) -> Column:
    col = _c(c)
    if lo is not None:
        col = F.greatest(col, F.lit(lo))
    if hi is not None:
        col = F.least(col, F.lit(hi))
    return col


def fn_round_half_even(c, scale: int = 0) -> Column:
    """NumPy-style rounding (half to even)."""
    return F.bround(_c(c), scale)


def fn_influence(c) -> Column:
    return F.when(_c(c) > 0, "positive").otherwise("negative")


def fn_to_json(*cols) -> Column:
    return F.to_json(F.struct(*[_c(c) for c in cols]))


def fn_from_json(c, schema) -> Column:
    return F.from_json(_c(c), schema)


def fn_sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def fn_round_half_up(c, digits: int = 4) -> Column:
    """Half-up rounding of the number's shortest decimal form."""
    return F.round(_c(c), digits)
