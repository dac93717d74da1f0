"""What all handles share: version, freezing, fail-fast iteration, lineage cuts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ...errors import ConcurrentModificationException, UnsupportedOperationException
from ...plans.order import checkpointed

#: After so many mutations the lineage is cut.
CUT_EVERY = 20


class Handle:
    def __init__(self, df: DataFrame):
        self._df, self.version, self._frozen = df, 0, False

    @property
    def df(self) -> DataFrame:
        return self._df

    def _set(self, df: DataFrame) -> None:
        if self._frozen:
            raise UnsupportedOperationException("the collection is frozen")
        self.version += 1
        self._df = checkpointed(df) if self.version % CUT_EVERY == 0 else df

    def freeze(self):
        self._frozen = True
        return self

    def is_frozen(self) -> bool:
        return self._frozen

    def size(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def clear(self) -> None:
        self._set(self.df.limit(0))

    def _rows(self) -> DataFrame:
        return self.df

    def iterator(self) -> Iterator:
        """Rows in order; fails if the handle changes meanwhile."""
        version = self.version
        for row in self._rows().toLocalIterator():
            if self.version != version:
                raise ConcurrentModificationException("changed during iteration")
            yield row

    __iter__ = iterator
