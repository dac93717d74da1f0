"""Queues and deques on lists: both ends, first-in-first-out and last-in-first-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...errors import NoSuchElementException
from . import lists
from .lists import FrameList, ListView, reversed_list


def poll(df: DataFrame, n: int, last: bool = False) -> DataFrame:
    """The first (or last) n rows, in the order in which they leave."""
    return df.orderBy(F.desc("pos") if last else F.asc("pos")).limit(n)


def rest(df: DataFrame, n: int) -> DataFrame:
    """What stays when n rows have left at the front."""
    return df.where(F.col("pos") >= n).select((F.col("pos") - n).alias("pos"), "value")


class FrameDeque(FrameList):
    def offer_first(self, value) -> bool:
        self.add_first(value)
        return True

    def offer_last(self, value) -> bool:
        self.add(value)
        return True

    offer, push = offer_last, FrameList.add_first

    def peek_first(self):
        row = self.df.orderBy("pos").select("value").first()
        return None if row is None else row[0]

    def peek_last(self):
        row = self.df.orderBy(F.desc("pos")).select("value").first()
        return None if row is None else row[0]

    peek = peek_first

    def poll_first(self):
        return None if self.is_empty() else self.remove_first()

    def poll_last(self):
        return None if self.is_empty() else self.remove_last()

    poll = poll_first

    def pop(self):
        return self.remove_first()

    def element(self):
        if self.is_empty():
            raise NoSuchElementException("the queue is empty")
        return self.peek_first()

    def remove_first_occurrence(self, value) -> bool:
        return self.remove(value)

    def remove_last_occurrence(self, value) -> bool:
        there = self.contains(value)
        if there:
            self._set(lists.remove_first(self.df, value, last=True))
        return there

    def descending_iterator(self):
        for row in self.df.orderBy(F.desc("pos")).select("value").toLocalIterator():
            yield row[0]

    def reversed(self) -> DequeView:
        return DequeView(self)


class DequeView(ListView, FrameDeque):
    """A deque from its other end, as it is now; what is done to one end of the view is done to the other end of the deque."""

    def __init__(self, backing: FrameDeque):
        super().__init__(backing, reversed_list, lambda i: self.size() - 1 - i)

    def add(self, value, place: int | None = None) -> None:
        size = self.size()
        place = size if place is None else place
        self._check(place, size + 1)
        self._backing.add(value, size - place)

    add_last = add

    def add_first(self, value) -> None:
        self.add(value, 0)

    push = add_first

    def offer_last(self, value) -> bool:
        self.add(value)
        return True

    offer = offer_last

    def remove_at(self, place: int):
        size = self.size()
        self._check(place, size)
        return self._backing.remove_at(size - 1 - place)

    def remove_first(self):
        return self._backing.remove_last()

    def remove_last(self):
        return self._backing.remove_first()

    def remove(self, value) -> bool:
        return self._backing.remove_last_occurrence(value)

    remove_first_occurrence = remove

    def remove_last_occurrence(self, value) -> bool:
        return self._backing.remove_first_occurrence(value)

    def remove_if(self, condition) -> None:
        self._backing.remove_if(condition)

    def clear(self) -> None:
        self._backing.clear()

    def reversed(self) -> FrameDeque:
        return self._backing
