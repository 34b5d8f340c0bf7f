"""A table of one point or one feature, stretched over another: a broadcast row, or a column joined by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.exceptions import ImproperObjectAction, InvalidArgumentValue


class Stretch:
    def __init__(self, source):
        n, p = source.shape
        if 1 not in (n, p):
            raise ImproperObjectAction("only a table of one point or one feature can be stretched")
        self._source = source

    def _apply(self, op: str, other, swapped: bool):
        """other op self, or self op other where swapped is False."""
        from loomframe.operators import verbs as V
        from loomframe.plans.frame import Frame

        s = self._source
        if isinstance(other, Stretch):  # a point and a feature span a table
            point, feature = (s, other._source) if s.shape[0] == 1 else (other._source, s)
            row = point._rows_list()[0]
            wide = feature._with(feature._df.select(*feature._keys, *[F.col("f0").alias(f"f{i}") for i in range(len(row))]), [None] * len(row), rows=feature._rows)
            wide._names = list(point._names)
            left_is_point = s.shape[0] == 1
            lit = [(F.lit(v), point._types[i]) for i, v in enumerate(row)]
            cells = [(F.col(c), t) for c, t in zip(wide._cols, wide._types, strict=True)]
            a, b = (lit, cells) if left_is_point else (cells, lit)
            cols = self._columns(op, b if swapped else a, a if swapped else b)
            return wide._with(wide._df.select(*wide._keys, *[c.alias(f"f{i}") for i, c in enumerate(cols)]), rows=wide._rows)
        if not isinstance(other, Frame):
            return NotImplemented
        V._numeric_only(s)
        V._numeric_only(other)
        theirs = [(F.col(c), t) for c, t in zip(other._cols, other._types, strict=True)]
        if s.shape[0] == 1 and s.shape[1] == len(other._names):
            row = s._rows_list()[0]
            mine, df = [(F.lit(v), t) for v, t in zip(row, s._types, strict=True)], other._df
            if op in V.DIVIDING and not swapped and other.containsZero() or op in V.DIVIDING and swapped and 0 in row:
                raise ZeroDivisionError("the divisor has a zero")
        elif s.shape[1] == 1 and s.shape[0] == other.shape[0]:
            df, left, right = V._beside(other, s)
            theirs = list(zip(left, other._types, strict=True))
            mine = [(right[0], s._types[0])] * len(theirs)
            if op in V.DIVIDING and (s.containsZero() if swapped else other.containsZero()):
                raise ZeroDivisionError("the divisor has a zero")
        else:
            raise InvalidArgumentValue(f"a table of {s.shape} does not stretch to {other.shape}")
        cols = self._columns(op, theirs if swapped else mine, mine if swapped else theirs)
        return other._with(df.select(*other._keys, *[c.alias(f"f{i}") for i, c in enumerate(cols)]), rows=other._rows)

    @staticmethod
    def _columns(op, left, right):
        from loomframe.operators import verbs as V

        if op in V.LOGICAL:
            return [V.LOGICAL[op](a.cast("boolean"), b.cast("boolean")) for (a, _), (b, _) in zip(left, right, strict=True)]
        return V.apply_columns(op, left, right)


def _install() -> None:
    for op in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "and", "or", "xor"):
        setattr(Stretch, f"__{op}__", lambda self, other, op=op: self._apply(op, other, False))
        setattr(Stretch, f"__r{op}__", lambda self, other, op=op: self._apply(op, other, True))


_install()
