"""Row numbers and running totals without a window over all rows.

Numbers come in two passes: the rows are put in order by ranges and numbered
inside each range, then the range counts are added up.  Each pass reads every
row once; no task sees more than a range or the counts of ``FAN`` ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.sources.materialize import materialize

FAN = 1024  # ranges whose counts one window call adds up


def totals_before(counts: DataFrame, index: str, value: str, out: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` with ``out``: the sum of ``value`` over smaller ``index`` (whole numbers from 0), inside ``by``.

    Sums are formed in groups of ``FAN`` neighbouring indexes first, so only the
    group sums, a thousandth of the rows, have to be put in one order: by a
    window inside each ``by``, or without ``by`` on the driver.
    """
    group = F.floor(F.col(index) / FAN).alias("_group")
    rows = counts.select("*", group)
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_group").orderBy(index).rowsBetween(*earlier)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = rows.groupBy(*by, "_group").agg(F.sum(value).cast("long").alias("_sum"))
    if by:
        above = Window.partitionBy(*by).orderBy("_group").rowsBetween(*earlier)
        tops = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_group").alias("_top"),
                           zero(F.sum("_sum").over(above)).alias("_before"))
    else:
        before, listed = 0, []
        for group, total in sorted(tuple(r) for r in sums.collect()):
            listed.append((group, before))
            before += total
        tops = counts.sparkSession.createDataFrame(listed, "_top long, _before long")
    same = F.col("_group") == F.col("_top")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inner = rows.withColumn("_inside", zero(F.sum(value).over(inside)))
    return inner.join(tops, same).select(*counts.columns, (F.col("_inside") + F.col("_before")).cast("long").alias(out))


def number_rows(df: DataFrame, order: list[Column | str], out: str, *, by: tuple[str, ...] = (), first: int = 0,
                ranges: int | None = None, name: str = "numbered") -> DataFrame:
    """``df`` with ``out``: the place of each row in ``order`` inside ``by``, from ``first``.

    ``order`` has to tell all rows apart that differ.  The rows are sorted into
    ``ranges`` (default: the session's shuffle partitions) by ``by`` and
    ``order``, so a ``by`` value that holds most rows is spread over many ranges.
    """
    spark = df.sparkSession
    keys = [*[F.col(c) for c in by], *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    place = F.monotonically_increasing_id()
    rows = materialize(spark, dealt.sortWithinPartitions(*keys).select(
        "*", F.shiftright(place, 33).cast("long").alias("_range"),
        place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), name)
    counts = rows.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_from"))
    starts = totals_before(counts, "_range", "_n", "_start", by=by).select(
        F.col("_range").alias("_r"), *[F.col(c).alias(f"_by_{c}") for c in by], "_from", "_start")
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(starts, same).select(
        *df.columns, (F.col("_start") + F.col("_place") - F.col("_from") + first).cast("long").alias(out))
