"""Matchers of values: as Python predicates, as Column builders for a typed column, and quantified over a table."""

from __future__ import annotations

import math
import numbers
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_NUMBERS = (*_INTEGERS, *_FLOATS, T.DecimalType)


def _number(v) -> bool:
    return isinstance(v, numbers.Number) and not isinstance(v, bool)


def missing(value) -> bool:
    """None, or a value that does not equal itself."""
    return value is None or bool(value != value)


def nonMissing(value) -> bool:
    return not missing(value)


def numeric(value) -> bool:
    return _number(value)


def nonNumeric(value) -> bool:
    return not numeric(value)


def zero(value) -> bool:
    return isinstance(value, numbers.Number) and value == 0


def nonZero(value) -> bool:
    return not zero(value)


def positive(value) -> bool:
    return isinstance(value, numbers.Number) and not isinstance(value, complex) and value > 0


def negative(value) -> bool:
    return isinstance(value, numbers.Number) and not isinstance(value, complex) and value < 0


def infinity(value) -> bool:
    return isinstance(value, float) and math.isinf(value)


def boolean(value) -> bool:
    return isinstance(value, bool)


def integer(value) -> bool:
    return isinstance(value, int)


def floating(value) -> bool:
    return isinstance(value, float)


def true(value) -> bool:
    return value is True


def false(value) -> bool:
    return value is False


def _typed(*kinds):
    return lambda c, t: F.lit(isinstance(t, kinds))


def _is_missing(c: Column, t: T.DataType) -> Column:
    return c.isNull() | F.isnan(c) if isinstance(t, _FLOATS) else c.isNull()


def _compare(op: Callable[[Column], Column], bool_too: bool = True):
    def build(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.BooleanType) and bool_too:
            c = c.cast("int")
        elif not isinstance(t, _NUMBERS):
            return F.lit(False)
        ok = op(c)
        return F.coalesce(ok & ~F.isnan(c), F.lit(False)) if isinstance(t, _FLOATS) else F.coalesce(ok, F.lit(False))

    return build


_NUMERIC = _typed(*_NUMBERS)
#: Column builders, (column, type) to a boolean column that is never null; a missing value counts as number where its column is one.
COLUMNS: dict[str, Callable[[Column, T.DataType], Column]] = {
    "missing": _is_missing,
    "nonMissing": lambda c, t: ~_is_missing(c, t),
    "numeric": _NUMERIC,
    "nonNumeric": lambda c, t: ~_NUMERIC(c, t),
    "zero": _compare(lambda c: c == 0),
    "nonZero": lambda c, t: ~_compare(lambda x: x == 0)(c, t),
    "positive": _compare(lambda c: c > 0),
    "negative": _compare(lambda c: c < 0),
    "infinity": lambda c, t: F.coalesce(F.abs(c) == float("inf"), F.lit(False)) if isinstance(t, _FLOATS) else F.lit(False),
    "boolean": lambda c, t: F.lit(isinstance(t, T.BooleanType)) & c.isNotNull(),
    "integer": _typed(*_INTEGERS, T.BooleanType),
    "floating": _typed(*_FLOATS),
    "true": lambda c, t: c.eqNullSafe(True) if isinstance(t, T.BooleanType) else F.lit(False),
    "false": lambda c, t: c.eqNullSafe(False) if isinstance(t, T.BooleanType) else F.lit(False),
}
_VALUES = {"missing": missing, "nonMissing": nonMissing, "numeric": numeric, "nonNumeric": nonNumeric, "zero": zero, "nonZero": nonZero, "positive": positive, "negative": negative, "infinity": infinity, "boolean": boolean, "integer": integer, "floating": floating, "true": true, "false": false}
NAMES = {f: n for n, f in _VALUES.items()}


def column_match(match, c: Column, t: T.DataType) -> Column | None:
    """The Column that holds where a value of column c matches; None if `match` is a function that only Python can call."""
    from loomframe.plans.predicates import QueryString

    if isinstance(match, QueryString):
        return match.element(c, t)
    if callable(match):
        return COLUMNS[NAMES[match]](c, t) if match in NAMES else None
    if isinstance(match, str):
        try:
            return QueryString(match, elementQuery=True).element(c, t)
        except ValueError:
            pass
    out = F.lit(False)
    for v in match if isinstance(match, (list, tuple, set, frozenset)) else [match]:
        out = out | (_is_missing(c, t) if missing(v) else equal(c, t, v))
    return out


def equal(c: Column, t: T.DataType, v) -> Column:
    """Null-safe equality that is false, not an error, between kinds that cannot be equal."""
    if isinstance(v, str) != isinstance(t, T.StringType) and not isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return F.lit(False)
    if isinstance(t, T.BooleanType) and not isinstance(v, bool):
        c = c.cast("int")
    elif isinstance(v, bool) and not isinstance(t, T.BooleanType):
        v = int(v)
    return F.coalesce(c == F.lit(v), F.lit(False))


def value_match(match) -> Callable[[object], bool]:
    """A Python predicate for any matcher: a function, a query string, a value or a list of values."""
    from loomframe.plans.predicates import QueryString

    if callable(match):
        return match
    if isinstance(match, str):
        try:
            return QueryString(match, elementQuery=True)
        except ValueError:
            pass
    wanted = list(match) if isinstance(match, (list, tuple, set, frozenset)) else [match]
    return lambda v: any((missing(v) and missing(w)) or v == w for w in wanted)


def _quantified(match, every: bool):
    def check(data) -> bool:
        from loomframe.plans.frame import Frame

        if isinstance(data, Frame):
            return data._quantified(match, every)
        found = value_match(match)
        values = (v for row in data for v in (row if isinstance(row, (list, tuple)) else [row]))
        return all(map(found, values)) if every else any(map(found, values))

    return check


def anyValues(match):
    """A function that tells if any value matches."""
    return _quantified(match, False)


def allValues(match):
    """A function that tells if all values match."""
    return _quantified(match, True)


for _name, _match in _VALUES.items():
    _cap = _name[0].upper() + _name[1:]
    globals()[f"any{_cap}"] = anyValues(_match)
    globals()[f"all{_cap}"] = allValues(_match)
    globals()[f"any{_cap}"].__name__, globals()[f"all{_cap}"].__name__ = f"any{_cap}", f"all{_cap}"
