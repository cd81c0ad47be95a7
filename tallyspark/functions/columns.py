"""Small column builders. All are built-in expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.or_, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.and_, conditions)


def ratio(num: str | Column, den: str | Column, scale: float = 1.0) -> Column:
    """``scale * num / den`` in double; null when the denominator is zero or null."""
    n = col(num).cast("double")
    return F.try_divide(n if scale == 1.0 else F.lit(float(scale)) * n, col(den).cast("double"))


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def days_inclusive(start: str | Column, end: str | Column) -> Column:
    return F.datediff(col(end), col(start)) + 1


def differs(a: str | Column, b: str | Column, null_safe: bool = False) -> Column:
    """``a != b``. A null on either side is no difference unless ``null_safe``."""
    return ~col(a).eqNullSafe(col(b)) if null_safe else col(a) != col(b)


def or_null(condition: Column, c: str | Column, nulls: str) -> Column:
    """Add the null rows to a rule when ``nulls='fail'``; ``'ignore'`` lets them pass."""
    if nulls not in ("ignore", "fail"):
        raise ValueError("nulls must be 'ignore' or 'fail'")
    return condition | col(c).isNull() if nulls == "fail" else condition


def normalise_token(c: str | Column, mode: str = "strict") -> Column:
    """``strict`` keeps the text, ``lower`` folds case, ``alnum_lower`` also drops all but letters and digits."""
    if mode == "strict":
        return col(c)
    if mode == "lower":
        return F.lower(col(c))
    if mode == "alnum_lower":
        return F.lower(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))
    raise ValueError(f"unknown mode {mode!r}")


def last_number_after(c: str | Column, marker: str, ignore_case: bool = False) -> Column:
    """Digits behind the last ``marker`` of the first line that has one, null when there are none.

    The pattern is anchored at line starts: each line is tried once, so long texts take linear time.
    """
    flags = "(?im)" if ignore_case else "(?m)"
    found = F.regexp_extract(col(c), f"{flags}^.*{re.escape(marker)}([0-9]+)", 1)
    return F.nullif(found, F.lit(""))


def token_at(c: str | Column, separator: str, index: int) -> Column:
    """Token ``index`` (from 0) of a split by regex; null when the text has fewer tokens."""
    return F.get(F.split(col(c), separator), F.lit(index))


def tokens_in(c: str | Column, separator: str) -> Column:
    return F.size(F.split(col(c), separator))


def date_text(c: str | Column, source: str, target: str) -> Column:
    """Rewrite a date text from one pattern to another; null when it does not parse."""
    return F.date_format(F.try_to_timestamp(col(c), F.lit(source)), target)


def base64_text(c: str | Column) -> Column:
    """Unbroken base64 of a text or binary column."""
    return F.translate(F.base64(col(c)), "\r\n", "")
