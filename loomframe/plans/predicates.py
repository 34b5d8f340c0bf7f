"""Query strings: parsed once, to a Column over a table, or to a Python predicate for opaque values."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.exceptions import InvalidArgumentValue
from loomframe.functions import match as M

OPERATORS = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}
_WORD = {**{k.lower(): k for k in M.COLUMNS}, "nonmissing": "nonMissing"}


class QueryString:
    """`== 3`, `is missing`, `is not zero` on elements; `name OP value` on an axis, with single spaces around OP.

    A value that reads as a number is one, any other is a string; `is` and `is not` take the name of a matcher,
    True, False or None.
    """

    def __init__(self, string: str, elementQuery: bool | None = None):
        self.string, self.identifier = string, None
        found = re.fullmatch(r"\s*(is not|is|==|!=|>=|<=|>|<)\s*(.+?)\s*", string)
        if elementQuery is not False and found and (found[1] not in ("is", "is not") or re.match(r"\s*is(?: not)? ", string)):
            self.op, value = found[1], found[2]
        elif elementQuery:
            raise InvalidArgumentValue(f"not a query of elements: {string!r}")
        else:
            splits = self.splits(string)
            if not splits:
                raise InvalidArgumentValue(f"not a query: {string!r}")
            if len(splits) > 1:
                raise InvalidArgumentValue(f"several operators, so the query is ambiguous: {string!r}")
            self.identifier, self.op, value = splits[0]
        self._set(value)

    @staticmethod
    def splits(string: str) -> list[tuple[str, str, str]]:
        """Every reading as identifier, operator, value."""
        out = []
        for m in re.finditer(r"(?= (is not|is|==|!=|>=|<=|>|<) )", string):
            name, value = string[: m.start()], string[m.start() + len(m[1]) + 2 :]
            if m[1] == "is" and value.startswith("not "):
                continue
            if name and value:
                out.append((name, m[1], value))
        return out

    @classmethod
    def of(cls, identifier: str, op: str, value: str) -> QueryString:
        q = cls.__new__(cls)
        q.string, q.identifier, q.op = f"{identifier} {op} {value}", identifier, op
        q._set(value)
        return q

    def _set(self, value: str) -> None:
        self.word = None
        if self.op in ("is", "is not"):
            if value in ("True", "False"):
                self.word = value.lower()
            elif value == "None":
                self.word = "missing"
            else:
                self.word = _WORD.get(value.lower().replace(" ", "").replace("-", ""))
            if not self.word:
                raise InvalidArgumentValue(f"no matcher of this name: {value!r}")
            self.value: float | str = value
        else:
            try:
                self.value = float(value)
            except ValueError:
                self.value = value

    def element(self, c: Column, t: T.DataType) -> Column:
        """The predicate on a column of type t; never null."""
        if self.word:
            hit = M.COLUMNS[self.word](c, t)
            return ~hit if self.op == "is not" else hit
        return F.coalesce(self._compared(c, t), F.lit(self.op == "!="))

    def filter(self, c: Column, t: T.DataType) -> Column:
        """The predicate for a filter over a source: a bare comparison, which the scan can take, and NaN as missing."""
        if self.word or self.op == "!=":
            return self.element(c, t)
        hit = self._compared(c, t)
        return hit & ~F.isnan(c) if isinstance(t, (T.FloatType, T.DoubleType)) else hit

    def _compared(self, c: Column, t: T.DataType) -> Column:
        number, v = isinstance(self.value, float), self.value
        if isinstance(t, T.StringType):
            v = f"{v:g}" if number and self.op in ("==", "!=") else v
            if number and self.op not in ("==", "!="):
                return F.lit(False)
            if number:  # a string is never equal to a number
                return F.lit(self.op == "!=")
        elif isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            if number:
                return F.lit(self.op == "!=")
            v = F.to_timestamp(F.lit(v))
        elif not number:
            return F.lit(self.op == "!=")
        elif isinstance(t, T.BooleanType):
            c = c.cast("double")
        elif float(v).is_integer() and abs(v) < 2**53 and not isinstance(t, (T.FloatType, T.DoubleType)):
            v = int(v)  # keeps the comparison in the column's own type, so that it reaches the scan
        return OPERATORS[self.op](c, v if isinstance(v, Column) else F.lit(v))

    def __call__(self, value) -> bool:
        """On an element, or on a point or feature that can be asked for the identifier."""
        if self.identifier is not None and hasattr(value, "__getitem__") and not isinstance(value, str):
            value = value[self.identifier]
        if self.word:
            hit = {"true": M.true, "false": M.false}.get(self.word, getattr(M, self.word))(value)
            return not hit if self.op == "is not" else hit
        if isinstance(value, bool):
            value = float(value)
        try:
            return bool(OPERATORS[self.op](value, self.value))
        except TypeError:
            return False

    def __str__(self) -> str:
        return self.string

    def __repr__(self) -> str:
        return f"QueryString({self.string!r})"
