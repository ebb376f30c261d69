"""Window building blocks. All share one (partition, order) spec, so Spark sorts once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


class PriorRows:
    """Statistics of a value over rows before the current one, per segment in week order."""

    def __init__(self, keys: Sequence[str], order: str, value: str):
        self.spec: WindowSpec = Window.partitionBy(*keys).orderBy(order)
        self.value = F.col(value)

    def _frame(self, n: int | None) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)

    def lag(self, n: int) -> Column:
        return F.lag(self.value, n).over(self.spec)

    def mean(self, n: int | None = None) -> Column:
        return F.avg(self.value).over(self._frame(n))

    def total(self, n: int | None = None) -> Column:
        return F.sum(self.value).over(self._frame(n))

    def count(self, n: int | None = None) -> Column:
        return F.count(self.value).over(self._frame(n))

    def nonzero(self, n: int) -> Column:
        return F.count(F.when(self.value > 0, 1)).over(self._frame(n))

    def std(self, n: int) -> Column:
        return F.stddev_pop(self.value).over(self._frame(n))

    def std_sample(self, n: int) -> Column:
        return F.stddev_samp(self.value).over(self._frame(n))

    def low(self, n: int) -> Column:
        return F.min(self.value).over(self._frame(n))

    def high(self, n: int) -> Column:
        return F.max(self.value).over(self._frame(n))

    def recent_values(self, n: int) -> Column:
        """The last ``n`` prior values as an array; never longer than ``n``."""
        return F.collect_list(self.value).over(self._frame(n))

    def moving_mean(self, n: int, min_periods: int) -> Column:
        """Mean of the current and the n-1 previous rows, NULL below ``min_periods`` rows."""
        frame = self.spec.rowsBetween(-(n - 1), 0)
        return F.when(F.count(self.value).over(frame) >= min_periods, F.avg(self.value).over(frame))


def array_median(values: Column) -> Column:
    """Median of a short numeric array (mean of the two middle values), NULL when empty."""
    ordered = F.array_sort(values)
    size = F.size(ordered)
    low = F.get(ordered, F.floor((size - 1) / 2.0).cast("int"))
    high = F.get(ordered, F.floor(size / 2.0).cast("int"))
    return (low + high) / 2.0


def array_mad(values: Column, centre: Column) -> Column:
    """Median absolute deviation of a short array from a given centre."""
    return array_median(F.transform(values, lambda v: F.abs(v - centre)))
