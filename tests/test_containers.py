"""Container handles: mutators, views, fences, fail-fast iteration, freezing."""

from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tidewell import errors
from tidewell.operators.containers import navigable
from tidewell.operators.containers.deques import FrameDeque
from tidewell.operators.containers.lists import FrameList
from tidewell.operators.containers.maps import FrameMap
from tidewell.operators.containers.navigable import NavigableMap, NavigableSet
from tidewell.operators.containers.sets import FrameSet
from tidewell.plans.catalog import QUERIES


def test_list(spark):
    a = FrameList.of(spark, 3, 1, 3, 2)
    assert (a.get(1), a.index_of(3), a.last_index_of(3), a.contains(9)) == (1, 0, 2, False)
    a.add(7)
    a.add_first(0)
    assert a.to_list() == [0, 3, 1, 3, 2, 7]
    assert a.remove(3) and a.to_list() == [0, 1, 3, 2, 7]
    assert a.remove_at(0) == 0 and a.set(0, 9) == 1
    a.sort()
    assert a.to_list() == [2, 3, 7, 9]
    view = a.sub_list(1, 3)
    assert view.to_list() == [3, 7]
    view.set(0, 4)
    assert a.to_list() == [2, 4, 7, 9] and a.reversed().to_list() == [9, 7, 4, 2]
    with pytest.raises(errors.IndexOutOfBoundsException):
        a.get(4)
    cursor = a.list_iterator()
    assert cursor.next() == 2
    cursor.remove()
    assert a.to_list() == [4, 7, 9]
    a.freeze()
    with pytest.raises(errors.UnsupportedOperationException):
        a.sort()


def test_fail_fast(spark):
    a = FrameList.of(spark, 1, 2, 3)
    with pytest.raises(errors.ConcurrentModificationException):
        for _ in a:
            a.add(4)


def test_sets(spark):
    a, b = FrameSet.of(spark, 1, 2, 2, 3), FrameSet.of(spark, 3, 4)
    assert a.size() == 3 and not a.add(1) and a.add(9)
    a.retain_all(FrameSet.of(spark, 1, 2, 3))
    a.remove_all(b)
    assert a.equals(FrameSet.of(spark, 2, 1))


def test_deque(spark):
    d = FrameDeque.of(spark, 1, 2, 3)
    d.push(0)
    assert (d.peek_first(), d.peek_last(), d.poll_last(), d.pop()) == (0, 3, 3, 0)
    d.offer(1)
    assert d.remove_last_occurrence(1) and d.to_list() == [1, 2]
    assert list(d.descending_iterator()) == [2, 1]
    d.clear()
    assert d.poll() is None
    with pytest.raises(errors.NoSuchElementException):
        d.element()


def test_map(spark):
    m = FrameMap.of(spark, {"ada": 36, "alan": 41, "grace": 45})
    assert m.put("ada", 37) == 36 and m.put_if_absent("ada", 1) == 37
    assert m.get_or_default("x", 5) == 5 and m.contains_value(41)
    assert m.compute("alan", F.lit(None).cast("int")) is None and not m.contains_key("alan")
    assert m.merge("ada", 3, lambda a, b: a + b) == 40
    assert m.replace("grace", 1, 45) is True and m.replace("grace", 2, 45) is False
    keys = m.key_set()
    assert keys.remove("ada") and m.size() == 1
    with pytest.raises(errors.UnsupportedOperationException):
        keys.add("x")
    with pytest.raises(errors.NullPointerException):
        m.put(None, 1)


def test_fences(spark):
    s = NavigableSet.of(spark, 10, 20, 30, 40, 50)
    w = s.sub_set(20, 40)
    assert (w.floor(10), w.floor(100), w.lower(20), w.ceiling(10), w.higher(35)) == (None, 30, None, 20, None)
    d = w.descending_set()
    assert (d.floor(25), d.ceiling(25), d.floor(5), d.ceiling(100)) == (30, 20, 20, 30)
    assert d.to_sorted_list() == [30, 20] and d.first() == 30
    with pytest.raises(errors.IllegalArgumentException, match="key out of range"):
        w.add(40)
    with pytest.raises(errors.IllegalArgumentException, match="key out of range"):
        w.sub_set(10, 30)
    with pytest.raises(errors.IllegalArgumentException, match="fromKey > toKey"):
        s.sub_set(40, 20)
    assert w.add(25) and s.to_sorted_list() == [10, 20, 25, 30, 40, 50]


def test_navigable_map(spark):
    m = NavigableMap.of(spark, {10: "ten", 20: "twenty", 30: "thirty"})
    assert m.first_key() == 10 and m.poll_first_entry()["value"] == "ten" and m.size() == 2
    assert m.head_map(30).to_sorted_list() == [20] and m.tail_map(30).to_sorted_list() == [30]
    with pytest.raises(errors.NoSuchElementException):
        m.head_map(5).first_key()


@pytest.mark.parametrize("kind", ["floor", "lower", "ceiling", "higher"])
def test_nearest_by_ranges(spark, kind):
    probes, base = spark.range(0, 400).select(F.col("id").alias("p")), spark.range(20, 300, 7).select(F.col("id").alias("b"))
    one, two = (sorted(map(tuple, navigable.nearest(probes, "p", base, "b", kind, by_ranges=r).collect())) for r in (False, True))
    keys = range(20, 300, 7)
    pick = {"floor": lambda p: max((k for k in keys if k <= p), default=None), "lower": lambda p: max((k for k in keys if k < p), default=None), "ceiling": lambda p: min((k for k in keys if k >= p), default=None), "higher": lambda p: min((k for k in keys if k > p), default=None)}[kind]
    assert one == two == [(p, pick(p)) for p in range(400)]


@pytest.mark.parametrize("name", ["nav_floor_all", "nav_lower_all", "nav_ceiling_all", "nav_higher_all", "nav_descending_floor_all", "nav_floor_clamped_all"])
def test_nearest_of_whole_tables(spark, name):
    """Every order has a row and all events are probed, beyond the 5,000 keys that nav_floor and its like take."""
    d = "/root/testdata/sf0.01"
    orders, events = ([r[0] for r in spark.read.parquet(f"{d}/{t}.parquet").select(c).collect()] for t, c in (("orders", "o_orderkey"), ("events", "event_id")))
    keys = sorted({4 * e for e in events if "clamped" not in name or 100 <= 4 * e < 300})
    at = {"floor": bisect_right, "lower": bisect_left, "ceiling": bisect_left, "higher": bisect_right}["ceiling" if "descending" in name else name.split("_")[1]]
    back = name.split("_")[1] in ("floor", "lower")  # the key before, else the key behind
    place = lambda p: at(keys, p) - back
    got = sorted(map(tuple, QUERIES[name](spark, d).select("o_orderkey", "found").collect()))
    assert len(orders) > 5000 and got == [(o, keys[place(3 * o)] if 0 <= place(3 * o) < len(keys) else None) for o in sorted(orders)]


def test_hash_codes(spark):
    from tidewell.functions.hashes import plain_hash
    from tidewell.operators.containers.lists import FrameList
    from tidewell.operators.containers.maps import Entry, FrameMap
    from tidewell.operators.containers.sets import FrameSet

    def fold(values):
        h = 1
        for v in values:
            h = (31 * h + plain_hash(v)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    for values in ([], [5], [1, 2, 3, 2**31 - 1, -7] * 9):
        assert FrameList.of(spark, *values).hash_code() == fold(values)
    assert FrameList.of(spark, "a", "bb", schema="string").hash_code() == fold(["a", "bb"])
    assert FrameSet.of(spark, 3, 1, 3).hash_code() == 4
    maps = FrameMap.of(spark, {"a": 1, "b": 2})
    entries = list(maps.entries())
    assert [(e.get_key(), e.get_value()) for e in entries] == [("a", 1), ("b", 2)]
    total = sum(e.hash_code() for e in entries) & 0xFFFFFFFF
    assert maps.hash_code() == (total - (1 << 32) if total >= 1 << 31 else total)
    assert entries[0].set_value(9) == 1 and entries[0].get_value() == 9 and maps.get("a") == 1
    assert entries[1].equals(Entry("b", 2)) and not entries[0].equals(Entry("a", 1))


def test_deque_from_its_other_end(spark):
    from tidewell.operators.containers.deques import FrameDeque

    deque = FrameDeque.of(spark, 1, 2, 3, 2)
    view = deque.reversed()
    assert view.to_list() == [2, 3, 2, 1] and view.peek_first() == 2 and view.peek_last() == 1
    view.add_first(9)
    view.add(8)
    assert deque.to_list() == [8, 1, 2, 3, 2, 9]
    assert view.poll_first() == 9 and view.poll_last() == 8
    assert view.remove(2) and deque.to_list() == [1, 2, 3]
    deque.add(4)
    assert view.to_list() == [4, 3, 2, 1] and view.reversed() is deque
    assert view.offer_last(0) and view.remove_at(0) == 4 and deque.to_list() == [0, 1, 2, 3]
