"""Exact medians without a buffer of values: count, narrow, count again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEW = 10_000  # distinct values whose counts may come to the driver
ACCURACY = 10_000  # of the sketch that proposes where to narrow


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a numeric column; null and NaN have no part in it, and without numbers it is None.

    Values are counted per distinct one. If these are more than ``FEW``, a quantile sketch
    proposes a range around the middle, the rows below and inside are counted exactly, and the
    rows inside are looked at again; a range that misses the middle is widened. Each turn
    leaves about four in ``ACCURACY`` of the rows, so a few passes serve any number of them.
    """
    x = F.col(column).cast("double")
    inside = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    rows = ranks = None
    below = 0
    while True:
        counts = inside.groupBy("x").agg(F.count("*").alias("n")).limit(FEW + 1).collect()
        if len(counts) <= FEW:
            return _middle(sorted((r["x"], r["n"]) for r in counts), ranks, below)
        if rows is None:
            rows = inside.count()
            ranks = ((rows - 1) // 2, rows // 2)
        share, wider = [(r - below) / rows for r in ranks], 2 / ACCURACY
        while True:
            at = [max(share[0] - wider, 0.0), min(share[1] + wider, 1.0)]
            low, high = inside.agg(F.percentile_approx("x", at, ACCURACY).alias("q")).first()["q"]
            less, held = inside.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x").between(low, high))).first()
            if below + less <= ranks[0] and ranks[1] < below + less + held:
                break
            wider *= 4
        if low == high:
            return low
        if held == rows:  # the range holds all rows: cut it by its middle instead
            low, high, less, held = _halved(inside, low, high, ranks[0] - below, ranks[1] - below)
            if low == high:
                return low
        inside, below, rows = inside.where(F.col("x").between(low, high)), below + less, held


def _halved(inside: DataFrame, low: float, high: float, first: int, last: int) -> tuple[float, float, int, int]:
    """The side of the range's middle where the ranks are, as (low, high, rows below, rows inside)."""
    middle = low / 2 + high / 2
    left = F.col("x") <= middle
    n, most, total, least = inside.agg(
        F.count_if(left), F.max(F.when(left, F.col("x"))), F.count("*"), F.min(F.when(~left, F.col("x")))).first()
    if last < n:
        return low, most, 0, n
    if first >= n:
        return least, high, n, total - n
    half = most / 2 + least / 2  # one rank on either side
    return half, half, 0, total


def _middle(counts: list[tuple[float, int]], ranks: tuple[int, int] | None, below: int) -> float | None:
    """The mean of the values at the two ranks, among sorted (value, rows) with ``below`` rows before them."""
    if not counts:
        return None
    if ranks is None:
        n = sum(k for _, k in counts)
        ranks = ((n - 1) // 2, n // 2)
    found = []
    for rank in ranks:
        upto = below
        for value, n in counts:
            upto += n
            if rank < upto:
                found.append(value)
                break
    return sum(found) / 2


def median_by(df: DataFrame, by: str, column: str) -> DataFrame:
    """``by`` and ``median`` per value of ``by`` (a null one too), from counts per distinct number."""
    per_value = (df.select(by, F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
                 .groupBy(by, "x").agg(F.count("*").alias("n")))
    group = Window.partitionBy(by)
    ranked = per_value.withColumns({"upto": F.sum("n").over(group.orderBy("x")), "rows": F.sum("n").over(group)})

    def holds(rank):
        return ((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))).cast("int")

    times = holds(F.floor((F.col("rows") - 1) / 2)) + holds(F.floor(F.col("rows") / 2))
    return ranked.groupBy(by).agg((F.sum(F.col("x") * times) / 2).alias("median"))
