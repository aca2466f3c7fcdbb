"""Column-level cleaning and calendar expressions (all JVM-side, codegen'd).

Every function takes and returns a ``Column`` so it composes inside one
projection and never leaves whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month abbreviations in calendar order, as used by the
# wide monthly tables (column headers Jan..Dec).
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
              "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Default pass thresholds for level forecasts.
DEFAULT_THRESHOLDS = {"r2_min": 0.93, "mape_max": 3.5, "rmse_max": 8_000_000.0}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_money(col) -> Column:
    """Currency text -> double: strip ``,`` and ``"``; ``''``/``nan``/junk -> null."""
    s = F.trim(F.regexp_replace(_c(col).cast("string"), '[,"]', ""))
    s = F.when(s.isin("", "nan", "NaN"), F.lit(None)).otherwise(s)
    return s.try_cast("double")


def parse_percent(col, is_numeric: bool = False) -> Column:
    """``"5.70%"`` -> 5.70. Numeric columns pass through unchanged."""
    if is_numeric:
        return _c(col).cast("double")
    return F.rtrim(F.trim(_c(col).cast("string")), F.lit("%")).try_cast("double")


def _two_digit(fmt: str) -> bool:
    return "yy" in fmt and "yyyy" not in fmt


def parse_date(col, formats: Sequence[str] = ("M/d/yy", "M/d/yy H:mm"),
               fallback: bool = True, two_digit_pivot: int = 69,
               strict: bool = False) -> Column:
    """Multi-format date parse on the raw string.

    Tries each pattern in order and keeps the first hit, then (optionally) a
    generic ISO parse. Two-digit years follow the POSIX pivot: ``yy`` below
    ``two_digit_pivot`` maps to 20yy, the rest to 19yy (Spark alone would
    map all of them to 20yy). ``strict=True`` uses the single first format
    with ``to_date`` so a mismatch raises under ANSI mode.
    """
    raw = _c(col).cast("string")
    pivot_year = 2000 + two_digit_pivot

    def fix(d: Column, fmt: str) -> Column:
        if not _two_digit(fmt):
            return d
        return F.when(F.year(d) >= pivot_year, F.add_months(d, -1200)).otherwise(d)

    if strict:
        fmt = formats[0]
        return fix(F.to_date(raw, fmt), fmt)
    parts = [fix(F.to_date(F.try_to_timestamp(raw, F.lit(f))), f) for f in formats]
    if fallback:
        parts.append(F.to_date(F.try_to_timestamp(raw)))
    return F.coalesce(*parts)


def to_number(col) -> Column:
    """Lenient numeric cast: anything unparsable becomes null."""
    return _c(col).cast("string").try_cast("double")


def from_epoch(col) -> Column:
    """Epoch seconds -> timestamp (session time zone is UTC)."""
    return F.timestamp_seconds(_c(col))


def fmt_period(col, pattern: str = "yyyy-MM") -> Column:
    return F.date_format(_c(col), pattern)


def month_number(mon) -> Column:
    """Month abbreviation -> 1..12 via a literal map."""
    pairs = []
    for i, m in enumerate(MONTH_ABBR):
        pairs += [F.lit(m), F.lit(i + 1)]
    return F.try_element_at(F.create_map(*pairs), _c(mon))  # unknown name -> null


def month_start(year, mon) -> Column:
    """(year, month abbreviation) -> first-of-month DATE."""
    return F.make_date(_c(year).cast("int"), month_number(mon), F.lit(1))


def month_of(col) -> Column:
    return F.month(_c(col))


def cyclic_sin(month_col) -> Column:
    return F.sin(F.lit(2 * math.pi) * _c(month_col) / F.lit(12.0))


def cyclic_cos(month_col) -> Column:
    return F.cos(F.lit(2 * math.pi) * _c(month_col) / F.lit(12.0))


def log_target(col) -> Column:
    """Natural log; null for values <= 0 (log guard)."""
    c = _c(col)
    return F.when(c > 0, F.ln(c))


def exp_level(col) -> Column:
    return F.exp(_c(col))


def pct_effect(coef) -> Column:
    """Multiplicative effect of a log coefficient in percent: (e^b - 1)*100."""
    return F.expm1(_c(coef)) * F.lit(100.0)


def abs_pct_error(pred, actual) -> Column:
    """|pred - actual| / actual * 100; null when actual is 0."""
    a = _c(actual)
    return F.when(a != 0, F.abs(_c(pred) - a) / a * F.lit(100.0))


def threshold_label(r2, mape, rmse, r2_min=None, mape_max=None, rmse_max=None) -> Column:
    """PASS when R2 > r2_min and MAPE < mape_max and RMSE < rmse_max."""
    t = DEFAULT_THRESHOLDS
    r2_min = t["r2_min"] if r2_min is None else r2_min
    mape_max = t["mape_max"] if mape_max is None else mape_max
    rmse_max = t["rmse_max"] if rmse_max is None else rmse_max
    ok = (_c(r2) > _lit(r2_min)) & (_c(mape) < _lit(mape_max)) & (_c(rmse) < _lit(rmse_max))
    return F.when(ok, F.lit("PASS")).otherwise(F.lit("fail"))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)
