"""Places of regular-expression matches as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:bigint,e:bigint>>"


def match_spans(text: Column, pattern: Column, group: int = 0, least: int = 0,
                measure: Callable[[Column], Column] = F.length) -> Column:
    """Start and end (exclusive) of the leftmost non-overlapping matches, in units of ``measure``.

    The text between matches comes from a split by the same pattern, so starts are running sums.
    Matches whose ``group`` has under ``least`` characters are left out, but still use up their text.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), lambda m: F.length(m) >= least)
    sizes = F.arrays_zip(F.transform(between, measure).alias("gap"), F.transform(whole, measure).alias("size"),
                         kept.alias("kept"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("found"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + x["size"]
        span = F.array(F.struct(begin.alias("s"), end.alias("e")))
        found = F.when(x["kept"], F.concat(a["found"], span)).otherwise(a["found"])
        ended = F.struct(F.coalesce(end, begin).cast("bigint").alias("at"), found.cast(SPANS).alias("found"))
        return F.when(x["size"].isNull(), a).otherwise(ended)

    return F.aggregate(sizes, start, step, lambda a: a["found"])
