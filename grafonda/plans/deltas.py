"""Values that only ever fall, kept as a base table and the tables of what changed since.

The current value of an id is the least over all rows that name it, so a round adds a
table of the changed rows and rewrites nothing.  When the added rows outgrow the base
they are merged into a new one, which costs a constant number of writes per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafonda.plans.scratch import cut, drop


class Falling:
    """base(id, value) with a row for each id; a value may be a struct, null means none yet; other columns, if named, go with the id."""

    #: Tables that are read side by side before a merge.
    MOST = 16

    def __init__(self, base: DataFrame, *others: str) -> None:
        self.keys = ("id", *others)
        self.base = cut(base.select(*self.keys, "value"))
        self.size = self.base.count()
        self.added: list[DataFrame] = []
        self.late: list[DataFrame] = []  # merged, but the last change may still be read as what is pending
        self.rows = 0

    def _all(self) -> DataFrame:
        return reduce(DataFrame.union, [x.select(*self.keys, "value") for x in self.added], self.base)

    def table(self) -> DataFrame:
        """(id, value) of every id."""
        return self._all().groupBy(*self.keys).agg(F.min("value").alias("value")) if self.added else self.base

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, value) of those ids alone; `ids` should be a written table, so that a small one is sent to the values."""
        return self._all().join(ids.select("id"), "id", "left_semi").groupBy("id").agg(F.min("value").alias("value"))

    def add(self, changed: DataFrame, rows: int) -> None:
        """Take over a written table of lower values; it stays until the next one is added."""
        self.added.append(changed)
        self.rows += rows
        if len(self.added) >= self.MOST or self.rows > self.size:
            self._merge()

    def _merge(self) -> None:
        fresh = cut(self.table())
        self._drop_late()
        self.late = [self.base, *self.added]
        self.base, self.added, self.rows = fresh, [], 0

    def _drop_late(self) -> None:
        for table in self.late:
            drop(table)
        self.late = []

    def finish(self) -> DataFrame:
        """The last values as one table; all others go."""
        if self.added:
            self._merge()
        self._drop_late()
        return self.base
