"""As-of and interval joins, calendar grids and blocks of time.

As-of joins are one union and one window: probes and facts of a key are sorted together by date, and the last fact
so far is carried to each probe. One shuffle on the key and O(n log n) in it, where a join on the inequality would
compare all pairs of a key. Facts and probes on one day: a strict join sorts the probe first, an inclusive one last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    probes: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    value: str,
    date: str = "date",
    strict: bool = True,
    tolerance_days: int | None = None,
    output: str | None = None,
) -> DataFrame:
    """Left as-of join: each probe gets the latest non-null ``value`` of its keys before its date, as ``output``.

    ``strict`` excludes facts of the probe's own day; ``tolerance_days`` is inclusive; of several facts on one day
    the largest value counts.
    """
    output = output or value
    on = [*keys, date]
    points = facts.where(F.col(value).isNotNull()).groupBy(*on).agg(F.max(value).alias("_v"))
    rest = [c for c in probes.columns if c not in on and c != output]
    left = probes.select(*on, F.struct(*rest).alias("_row") if rest else F.lit(1).alias("_row"), F.lit(None).cast(dict(points.dtypes)["_v"]).alias("_v"))
    right = points.select(*on, F.lit(None).cast(dict(left.dtypes)["_row"]).alias("_row"), "_v")
    both = left.withColumn("_side", F.lit(0 if strict else 1)).unionByName(right.withColumn("_side", F.lit(1 if strict else 0)))
    fact = F.when(F.col("_v").isNotNull(), F.struct(F.col(date).alias("at"), F.col("_v").alias("v")))
    so_far = Window.partitionBy(*keys).orderBy(date, "_side").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_last", F.last(fact, ignorenulls=True).over(so_far)).where(F.col("_side") == (0 if strict else 1))
    fresh = F.lit(True) if tolerance_days is None else F.datediff(date, F.col("_last.at")) <= tolerance_days
    return seen.select(*on, *(["_row.*"] if rest else []), F.when(fresh, F.col("_last.v")).alias(output))


def interval_join(left: DataFrame, spans: DataFrame, on: Column, date: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Join on an equality and ``start <= date <= end``, both ends inclusive."""
    return left.join(spans, on & F.col(date).between(F.col(start), F.col(end)), how)


def outside_intervals(rows: DataFrame, spans: DataFrame, key: str, date: str, start: str, end: str) -> DataFrame:
    """Rows whose date no span of their key covers, ends included."""
    s = spans.select(F.col(key).alias("_k"), F.col(start).alias("_from"), F.col(end).alias("_to"))
    return rows.join(s, (F.col(key) == F.col("_k")) & F.col(date).between(F.col("_from"), F.col("_to")), "left_anti")


def month_grid(dates: DataFrame, column: str = "date") -> DataFrame:
    """First days of the months from the earliest date to the latest, none before the earliest."""
    span = dates.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    first = F.trunc("a", "month")
    first = F.when(first < F.col("a"), F.add_months(first, 1)).otherwise(first)
    return span.select(first.alias("a"), "b").where("a <= b").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(column))


def rename_teams(matches: DataFrame, former: DataFrame, rounds: int = 1) -> tuple[DataFrame, Column]:
    """Former names to current ones where the match lies in the rename's window; and a column that counts them.

    ``former`` is a short table of names and is joined by broadcast under Spark's own size threshold. Chains of
    renames need as many ``rounds`` as they have links.
    """
    out = matches.withColumn("renamed", F.lit(0))
    for _ in range(rounds):
        for side in ("home_team", "away_team"):
            names = former.select(F.col("former").alias("_former"), F.col("current").alias("_current"), F.col("start_date").alias("_a"), F.col("end_date").alias("_b"))
            names = names.groupBy("_former", "_a", "_b").agg(F.min("_current").alias("_current"))
            hit = (F.col(side) == F.col("_former")) & F.col("date").between(F.col("_a"), F.col("_b"))
            out = out.join(names, hit, "left").withColumn(side, F.coalesce("_current", side))
            out = out.withColumn("renamed", F.col("renamed") + F.col("_current").isNotNull().cast("int")).drop("_former", "_current", "_a", "_b")
    return out, F.sum("renamed")


def month_blocks(first, last, months: int = 6, years: int = 8) -> list[tuple]:
    """(start, end) of test blocks: each boundary is the one before plus ``months``, clipped to the month's end, from
    ``years`` before the last date. Boundaries chain, so a day once clipped stays; the last end may lie past the data."""
    import calendar
    import datetime

    def plus(day: datetime.date, n: int) -> datetime.date:
        y, m = divmod(day.year * 12 + day.month - 1 + n, 12)
        return datetime.date(y, m + 1, min(day.day, calendar.monthrange(y, m + 1)[1]))

    blocks, at = [], plus(last, -12 * years)
    while at < last:
        blocks.append((at, plus(at, months)))
        at = plus(at, months)
    return [b for b in blocks if b[1] > first]
