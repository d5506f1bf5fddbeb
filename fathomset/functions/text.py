"""Cell parsing and label normalisation with built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: cells read as "missing", the summary-row prefix and the label-column pattern
MISSING_TOKENS = ["", "na", "n/a", "nan", "null", "none", "-", "."]
SUMMARY_PREFIX = "__"
LABEL_PATTERN = r"(?i)^(true[ _]?tissue|claimed[ _]?tissue|tissue|claimed|label)$"
FORMULA_PATTERN = r"^[=+\-@\t\r]"
CLOCK_PATTERN = r"^\d{1,2}:\d{2}(:\d{2})?$"
DATE_FORMATS = ["ddMMMyyyy", "MM/dd/yyyy", "yyyy-MM-dd"]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def unquote(x) -> Column:
    return F.regexp_replace(F.trim(_c(x)), r'^"|"$', "")


def number_cell(x) -> Column:
    """DOUBLE of a text cell; blank, NA-like and non-numeric cells are NULL, never 0."""
    cell = F.lower(unquote(x))
    number = cell.try_cast("double")
    return F.when(cell.isin(MISSING_TOKENS) | F.isnan(number) | number.isin(float("inf"), float("-inf")), None).otherwise(number)


def normal_label(x) -> Column:
    """Lower case, separators to single spaces, surrounding quotes removed."""
    spaced = F.regexp_replace(F.lower(F.trim(_c(x))), r"[_\-.]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"\s+", " "), r'^"|"$', "")


def bare_key(x) -> Column:
    """Only ``[a-z0-9]`` kept, for matching free-text names."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def strip_version(x) -> Column:
    return F.split(_c(x), r"\.").getItem(0)


def feature_key(x) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(x))), r"\.\d+$", "")


def safe_csv_cell(x) -> Column:
    """Prefix a quote where a spreadsheet would read the cell as a formula."""
    c = _c(x)
    return F.when(c.rlike(FORMULA_PATTERN), F.concat(F.lit("'"), c)).otherwise(c)


def clock_hours(x) -> Column:
    """``HH:MM[:SS]`` as hours."""
    c = F.when(F.trim(_c(x)).rlike(CLOCK_PATTERN), F.split(F.trim(_c(x)), ":"))
    sec = F.when(F.size(c) > 2, c.getItem(2).cast("double")).otherwise(F.lit(0.0))
    return c.getItem(0).cast("double") + c.getItem(1).cast("double") / 60 + sec / 3600


def any_date(x) -> Column:
    """First matching format; the month-only form falls on day 1."""
    c = F.trim(_c(x))
    tries = [F.when(c.rlike(pat), F.try_to_date(c, fmt)) for fmt, pat in
             zip(DATE_FORMATS, [r"^\d{2}[A-Za-z]{3}\d{4}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{4}-\d{2}-\d{2}$"])]
    tries.append(F.when(c.rlike(r"^[A-Za-z]{3} \d{4}$"), F.try_to_date(F.concat(F.lit("01 "), c), "dd MMM yyyy")))
    return F.coalesce(*tries)


def well_position(x) -> tuple[Column, Column]:
    """Row number (A = 1) and column number of a plate well such as ``C07``."""
    up = F.upper(F.trim(_c(x)))
    row = F.regexp_extract(up, r"^([A-H])(\d{1,2})$", 1)
    col = F.regexp_extract(up, r"^([A-H])(\d{1,2})$", 2)
    return F.when(row != "", F.ascii(row) - 64), F.when(col != "", col.try_cast("int"))
