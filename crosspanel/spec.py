"""Names of a panel's columns and the conventions that operators share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelSpec:
    """A long panel: one row per date and entity."""

    entity: str = "id"
    date: str = "d"

    def series(self, rows: int | None = None, until: int = 0) -> WindowSpec:
        """One entity's rows in order of date; the last ``rows`` up to ``until`` if given."""
        w = Window.partitionBy(self.entity).orderBy(self.date)
        return w if rows is None else w.rowsBetween(until - rows + 1, until)

    def past(self, until: int = 0) -> WindowSpec:
        """All rows of an entity up to now, or up to ``until`` rows from now."""
        return Window.partitionBy(self.entity).orderBy(self.date).rowsBetween(Window.unboundedPreceding, until)

    def day(self, *more: str) -> WindowSpec:
        """All rows of a date."""
        return Window.partitionBy(self.date, *more)


PANEL = PanelSpec()


def at_least(value: Column, counted: Column, k: int, w: WindowSpec) -> Column:
    """The value where the frame holds k values or more, else null."""
    return F.when(F.count(counted).over(w) >= k, value)
