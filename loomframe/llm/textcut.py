"""Parts of texts cut out or replaced, in DataFrame functions whose work is about linear in the text and its spans.

What a function of elements reads is a column or zipped with the elements: an expression named there would be
computed anew for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values whose running sum is taken at once.
LOT = 128
#: Characters of the parts that a text is read in.
CHUNK = 1024


def free_name(df: DataFrame, name: str) -> str:
    """A prefix that no column of df begins with."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What `join` (a sum, or a maximum; from 0) makes of the values before each element, by lots: of what comes before a lot once for each, of
    what comes before an element within its lot. `values` must be a column, not an expression."""
    zero = F.lit(0).cast("long")
    lots = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / LOT).cast("int"))).otherwise(F.array().cast("array<int>"))
    totals = F.transform(lots, lambda b: F.aggregate(F.slice(values, b * LOT + 1, LOT), zero, join))
    start = F.struct(zero.alias("all"), F.array().cast("array<bigint>").alias("heads"))
    heads = F.aggregate(totals, start, lambda a, n: F.struct(join(a["all"], n).alias("all"), F.concat(a["heads"], F.array(a["all"])).alias("heads")), lambda a: a["heads"])
    of_lot = lambda z: F.transform(F.slice(values, z["lot"] * LOT + 1, LOT), lambda n, i: F.aggregate(F.slice(values, z["lot"] * LOT + 1, i), z["head"], join))
    return F.flatten(F.transform(F.arrays_zip(heads.alias("head"), lots.alias("lot")), of_lot))


def replaced(df: DataFrame, text_col: str, spans_col: str, replacement: Callable[[Column], Column]) -> DataFrame:
    """df with each span of the text (structs of start and end in code points, and what `replacement` reads) replaced, without the column of
    spans; a span that begins before the end of an earlier one belongs to it. No spans, or null: the text as it is."""
    text, own = F.col(text_col), free_name(df, "__cut")
    spans, ends, prior, chunks = (f"{own}{x}" for x in ("spans", "ends", "prior", "chunks"))
    some = F.coalesce(F.size(spans_col) > 0, F.lit(False))
    df = df.withColumn(spans, F.array_sort(spans_col)).withColumn(chunks, F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    df = df.withColumn(ends, F.transform(spans, lambda s: s["end"].cast("long"))).withColumn(prior, running(F.col(ends), lambda a, n: F.greatest(a, n)))

    def between(a: Column, b: Column) -> Column:
        """The text from a to b, read from its chunks, so that no place is counted from the text's begin."""
        first, last, of = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int"), lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
        head = F.substring(of(first), (a - first * CHUNK + 1).cast("int"), F.when(first == last, b - a).otherwise(CHUNK).cast("int"))
        return F.when(first == last, head).otherwise(F.concat(head, F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.substring(of(last), F.lit(1), (b - last * CHUNK).cast("int"))))

    whole = F.filter(F.arrays_zip(F.col(spans).alias("s"), F.col(prior).alias("prior")), lambda z: z["s"]["start"] >= z["prior"])
    parts = F.transform(whole, lambda z: F.concat(between(z["prior"], z["s"]["start"].cast("long")), replacement(z["s"])))
    new = F.concat(F.array_join(parts, ""), between(F.array_max(ends), F.length(text).cast("long")))
    return df.withColumn(text_col, F.when(F.coalesce(F.size(spans) > 0, F.lit(False)), new).otherwise(text)).drop(*{spans, ends, prior, chunks, spans_col})
