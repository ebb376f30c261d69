"""Column expressions: text normalisation, typing, rounding, coordinates and labels.

Everything here is a built-in Spark expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from segpanel.roles import Box

UNKNOWN = "UNKNOWN"

# Spellings of a missing value, compared after trim and upper case.
NULL_TOKENS = (
    "", "(null)", "NULL", "null", "Null", "N/A", "n/a", "NA", "na", "NaN", "nan", "None", "none", "NONE",
)

# Labels that mean "no label" in published tables.
UNKNOWN_LABELS = ("", "UNKNOWN", "NULL", "(NULL)")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dround(c: Column | str, digits: int = 0) -> Column:
    """Round a double half away from zero on the scaled double, not on its decimal text.

    ``F.round(1.005, 2)`` gives 1.01; the engines this library is compared with give 1.0.
    """
    scale = float(10**digits)
    return F.round(col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def sround(c: Column | str, digits: int) -> Column:
    """Round a quotient of double sums so that the order of summation cannot show.

    The last bits of such sums depend on how rows were partitioned; a first rounding to ten
    digits removes them, so values that lie exactly between two results always go one way.
    """
    return dround(dround(c, 10), digits)


def pct(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """100·part/whole, NULL when the whole is missing or not positive."""
    value = F.when(whole > 0, part.cast("double") * 100.0 / whole.cast("double"))
    return value if digits is None else dround(value, digits)


def pct_change(new: Column, old: Column, digits: int = 2) -> Column:
    """Relative change in percent, NULL without a positive old value."""
    return dround(F.when(old > 0, (new - old).cast("double") * 100.0 / old.cast("double")), digits)


# ---- text ---------------------------------------------------------------------------------------

def normalize_text(c: Column | str, null_tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Trim and collapse whitespace; a null token becomes NULL."""
    trimmed = F.trim(col(c))
    tokens = sorted({t.upper() for t in null_tokens})
    return F.when(~F.upper(trimmed).isin(tokens), F.regexp_replace(trimmed, r"\s+", " "))


def upper_normalize(c: Column | str, null_tokens: Iterable[str] = NULL_TOKENS) -> Column:
    return F.upper(normalize_text(c, null_tokens))


def allow_list(c: Column | str, values: Sequence[str]) -> Column:
    return F.when(col(c).isin(list(values)), col(c))


def fill_unknown(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(UNKNOWN))


def is_unknown(c: Column | str) -> Column:
    """True for NULL and for every label that carries no information."""
    return F.coalesce(F.upper(F.trim(col(c))).isin(list(UNKNOWN_LABELS)), F.lit(True))


def label_match(c: Column | str, wanted: str | None) -> Column:
    """Trimmed, case-insensitive equality; no selection matches every row."""
    if wanted is None:
        return F.lit(True)
    return F.coalesce(F.lower(F.trim(col(c))) == F.lit(wanted.strip().lower()), F.lit(False))


# ---- typing -------------------------------------------------------------------------------------

def parse_date(c: Column | str) -> Column:
    """month/day/year with a four-digit year; NULL when it is no calendar date."""
    return F.try_to_timestamp(col(c), F.lit("M/d/yyyy")).cast("date")


def parse_datetime(day: Column | str, clock: Column | str) -> Column:
    """Date text and H:M:S text to a timestamp without zone; NULL if either is missing or wrong.

    The clock is put together from its parts, so no session time zone can move it.
    """
    date, text = parse_date(day), col(clock)
    hour, minute, second = (F.try_element_at(F.split(text, ":"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    stamp = F.try_make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), hour, minute, second)
    return F.when(text.rlike("^[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$") & (second < 60), stamp)


def try_double(c: Column | str) -> Column:
    return F.trim(col(c)).try_cast("double")


def try_int(c: Column | str) -> Column:
    """Numeric text to int, fractions rounded half away from zero, NULL if out of range."""
    return F.round(try_double(c)).try_cast("int")


def finite(c: Column | str) -> Column:
    value = col(c)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def canonical_number(c: Column | str, digits: int = 6) -> Column:
    """Rounded value, NULL for NaN and infinities, no negative zero."""
    value = col(c).cast("double")
    return F.when(finite(value), dround(value, digits) + F.lit(0.0))


def valid_time(c: Column | str) -> Column:
    """True/false for HH:MM:SS text, NULL for missing text."""
    return F.when(col(c).isNotNull(), col(c).rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"))


# ---- coordinates --------------------------------------------------------------------------------

def missing_xy(x: Column | str, y: Column | str) -> Column:
    return col(x).isNull() | col(y).isNull()


def zero_xy(x: Column | str, y: Column | str) -> Column:
    return F.coalesce(col(x) == 0, F.lit(False)) | F.coalesce(col(y) == 0, F.lit(False))


def inside_box(x: Column | str, y: Column | str, box: Box) -> Column:
    inside = col(x).between(box.x_min, box.x_max) & col(y).between(box.y_min, box.y_max)
    return F.coalesce(inside, F.lit(False))


def outside_xy(x: Column | str, y: Column | str, box: Box) -> Column:
    return ~missing_xy(x, y) & ~inside_box(x, y, box)


def valid_xy(x: Column | str, y: Column | str, box: Box, *flags: Column | str) -> Column:
    """Usable point: present, non-zero, inside the box, and none of the row flags set."""
    ok = ~missing_xy(x, y) & ~zero_xy(x, y) & inside_box(x, y, box)
    for flag in flags:
        ok = ok & ~col(flag)
    return ok


def classify_xy(x: Column | str, y: Column | str, box: Box) -> Column:
    return (
        F.when(missing_xy(x, y), "missing")
        .when(zero_xy(x, y), "zero")
        .when(~inside_box(x, y, box), "outside")
        .otherwise("valid")
    )


def grid_snap(c: Column | str, size: float) -> Column:
    """Centre of the grid cell that holds the value."""
    step = F.lit(float(size))
    return dround(F.floor(col(c) / step) * step + step / F.lit(2.0), 5)


def grid_round(c: Column | str, digits: int) -> Column:
    return dround(c, digits)


def grid_aligned(c: Column | str, size: float, tolerance: float = 1e-5) -> Column:
    """True when the value is a cell centre (k+½)·size within the tolerance."""
    offset = col(c) / F.lit(float(size)) - 0.5
    return F.abs(offset - F.round(offset)) * F.lit(float(size)) <= tolerance


# ---- classes and labels -------------------------------------------------------------------------

def bucketize(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first upper edge the value does not exceed; the last label has no edge."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    value = col(c)
    result = F.when(value <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1]):
        result = result.when(value <= edge, label)
    return result.when(value.isNotNull(), labels[-1])


# Day-lag classes.
LAG_EDGES = (-1, 0, 7, 30, 365)
LAG_LABELS = ("negative", "same day", "1-7 days", "8-30 days", "31-365 days", "over 365 days")


def classify_dates(start: Column, end: Column, report: Column, min_day, as_of) -> Column:
    """First date rule a row breaks, in rule order."""
    return (
        F.when(start.isNull(), "start missing")
        .when(start < F.lit(min_day), "start too old")
        .when(start > F.lit(as_of), "start in future")
        .when(end < start, "end before start")
        .when(report < start, "report before start")
        .otherwise("valid")
    )


def location_label(grain: Column, area: Column, grp: Column, x: Column, y: Column,
                   area_word: str = "AREA", digits: int = 4) -> Column:
    """``GRID y, x · grp`` for grid rows, ``<word> area · grp`` for area rows."""
    number = f"%.{digits}f"
    grid = F.format_string(f"GRID {number}, {number} · %s", y, x, grp)
    return F.when(grain == "grid", grid).otherwise(F.format_string(f"{area_word} %s · %s", area, grp))


def mappable_area(area: Column | str) -> Column:
    return F.coalesce(col(area).rlike("^[1-9][0-9]{0,2}$"), F.lit(False))


def location_key(area: Column | str, prefix: str = "area:") -> Column:
    """Join key to map features; NULL for areas that no map can hold."""
    return F.when(mappable_area(area), F.concat(F.lit(prefix), col(area)))


# ---- calendar -----------------------------------------------------------------------------------

def week_of(c: Column | str) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", col(c)).cast("date")


def month_of(c: Column | str) -> Column:
    return F.trunc(col(c), "month")


def is_monday(c: Column | str) -> Column:
    return F.weekday(col(c)) == 0


def boundary_hours(start: Column, end: Column) -> Column:
    """Number of hour boundaries between two timestamps without time zone."""
    def hour_no(t: Column) -> Column:
        return F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(t)

    return hour_no(end) - hour_no(start)
