"""Column -> Column helpers: rounding, text formats, bands, defaulting, time.

All are built from JVM-side functions, so they stay inside whole-stage
codegen; none is a Python UDF.  ``petrograph.functions.sqltext`` holds the
same rules spelled for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from petrograph import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- rounding ---------------------------------------------------------------
def round_fixed(x, n: int) -> Column:
    """Half away from zero on the binary value: sign(x)*floor(|x|*10^n+0.5)/10^n.

    Spark's ``round`` goes through the decimal text and DuckDB's treats near
    ties differently; this form gives the same double in both engines.
    """
    x = _c(x)
    p = 10 ** n
    y = F.abs(x) * p + 0.5
    # y - (y % 1) is floor(y) for y >= 0, kept in DOUBLE (floor() would go
    # through BIGINT and overflow for large sums).
    return (F.signum(x) * (y - y % F.lit(1.0)) / p).cast("double")


def _scaled(x: Column, n: int) -> Column:
    """|x| in units of 10^-n, rounded half up, as BIGINT."""
    return F.floor(F.abs(x) * (10 ** n) + 0.5).cast("long")


def _int_div(m: Column, p: int) -> Column:
    return ((m - F.pmod(m, F.lit(p))) / p).cast("long")


def to_fixed(x, n: int) -> Column:
    """``Number.prototype.toFixed(n)`` text (sign kept for tiny negatives); NaN is ``NaN``.

    NULL where the value doesn't fit 18 digits in units of 10^-n.
    """
    x = _c(x)
    m = _scaled(x, n)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    p = 10 ** n
    text = F.concat(sign, m.cast("string")) if n == 0 else F.concat(
        sign, _int_div(m, p).cast("string"), F.lit("."), F.lpad(F.pmod(m, F.lit(p)).cast("string"), n, "0"))
    return F.when(F.isnan(x.cast("double")), F.lit("NaN")).when(F.abs(x) * p < 1e18, text)


def pct_text(x, n: int = 0) -> Column:
    """``(x*100).toFixed(n) + '%'``."""
    return F.concat(to_fixed(_c(x) * 100, n), F.lit("%"))


# -- number formats -----------------------------------------------------------
def _grouped(m: Column) -> Column:
    return F.format_number(m, 0)


def fmt_number(x) -> Column:
    """en-US grouping, at most 3 decimals, trailing zeros dropped."""
    x = _c(x)
    m = _scaled(x, 3)
    frac = F.pmod(m, F.lit(1000))
    frac_txt = F.when(frac == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.regexp_replace(F.lpad(frac.cast("string"), 3, "0"), "0+$", "")))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, _grouped(_int_div(m, 1000)), frac_txt)


def fmt_currency(x) -> Column:
    """USD with grouping and exactly 2 decimals; negatives as ``-$1.00``."""
    x = _c(x)
    m = _scaled(x, 2)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("$"), _grouped(_int_div(m, 100)), F.lit("."),
                    F.lpad(F.pmod(m, F.lit(100)).cast("string"), 2, "0"))


def fmt_percentage(x, decimals: int = 1) -> Column:
    return pct_text(x, decimals)


# -- text -----------------------------------------------------------------------
def truncate_text(x, max_len: int) -> Column:
    """Unchanged when it fits, else the first ``max_len`` characters + '...'."""
    x = _c(x)
    return F.when(F.char_length(x) <= max_len, x).otherwise(
        F.concat(F.substring(x, 1, max_len), F.lit("...")))


def label_prefix(x, n: int = S.LABEL_PREFIX_CHARS) -> Column:
    """First ``n`` characters + '...' (the ellipsis is always added)."""
    return F.concat(F.substring(_c(x), 1, n), F.lit("..."))


def valid_email(x) -> Column:
    return _c(x).rlike(S.EMAIL_PATTERN)


# -- JS-style defaulting ---------------------------------------------------------
def or_zero(x) -> Column:
    """``x || 0``: null, NaN and 0 all give 0."""
    return F.coalesce(F.nanvl(_c(x).cast("double"), F.lit(0.0)), F.lit(0.0))


def or_default(x, default: float) -> Column:
    """``x || d``: null, NaN **or 0** give ``d``."""
    x = _c(x).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(float(default))).otherwise(x)


# -- bands ------------------------------------------------------------------------
def severity_band(sev) -> Column:
    sev = _c(sev)
    out = None
    for name, colour in S.SEVERITY_COLOURS:
        out = (F.when(sev == name, colour) if out is None else out.when(sev == name, colour))
    return out.otherwise(S.SEVERITY_DEFAULT_COLOUR)


def impact_band(immediate) -> Column:
    """Strict cut-offs: 0.70 is yellow, 0.40 is green; missing impact -> NULL."""
    x = _c(immediate)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x > S.IMPACT_RED_ABOVE, "red")
            .when(x > S.IMPACT_YELLOW_ABOVE, "yellow")
            .otherwise("green"))


def strength_band(w) -> Column:
    """Strict: weight 0.80 is 'medium', 0.60 is 'weak'."""
    w = _c(w)
    return (F.when(w > S.STRONG_ABOVE, "strong").when(w > S.MEDIUM_ABOVE, "medium")
            .otherwise("weak"))


def event_node_colour(sev) -> Column:
    sev = _c(sev)
    (c1, v1), (c2, v2) = S.EVENT_NODE_COLOURS
    return F.when(sev == c1, v1).when(sev == c2, v2).otherwise(S.EVENT_NODE_DEFAULT_COLOUR)


# -- time ---------------------------------------------------------------------------
def elapsed_seconds(ts, as_of) -> Column:
    """floor((as_of - ts) in seconds), from the microsecond difference."""
    us = F.timestamp_diff("MICROSECOND", _c(ts), _c(as_of))
    return F.floor(us / 1e6).cast("long")


def time_ago(ts, as_of) -> Column:
    s = elapsed_seconds(ts, as_of)
    return (F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
            .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
            .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago"))))


def ts_ntz(text: str) -> Column:
    """A zone-less timestamp literal (the data's ``ts`` is TIMESTAMP_NTZ)."""
    return F.lit(text).cast("timestamp_ntz")
