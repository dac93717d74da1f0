"""Sequences: laziness, single use, order, bounds, numbering by ranges, Python forms."""

import pytest
from pyspark.sql import functions as F

from tidewell import errors, sources
from tidewell.functions import collectors as C
from tidewell.functions import comparators as O
from tidewell.functions.optional import Optional
from tidewell.operators import gatherers as G
from tidewell.operators.seq import Seq
from tidewell.plans.order import Key, numbered


def test_single_use(spark):
    s = sources.of(spark, 1, 2, 3)
    s.filter("value > 1")
    with pytest.raises(errors.IllegalStateException, match="already been operated upon"):
        s.to_list()


def test_order_is_kept(spark):
    s = sources.of(spark, 3, 1, 3, 2, 1, 4)
    assert s.distinct().to_list() == (3, 1, 2, 4)
    assert sources.of(spark, 3, 1, 2).reversed().to_list() == (2, 1, 3)
    assert sources.of(spark, 3, 1, 2).sorted().reversed().limit(2).to_list() == (3, 2)


def test_sort_is_stable(spark):
    s = sources.of_values(spark, [(1, "a"), (0, "b"), (1, "c"), (0, "d")], "k int, v string")
    assert [r.v for r in s.sorted(O.reverse_order("k")).to_list()] == ["a", "c", "b", "d"]


def test_take_and_drop_while(spark):
    values = (1, 2, 5, 1, 2)
    assert sources.of(spark, *values).take_while("value < 3").to_list() == (1, 2)
    assert sources.of(spark, *values).drop_while("value < 3").to_list() == (5, 1, 2)
    assert sources.of(spark, *values).take_while("value < 9").to_list() == values
    assert sources.of(spark, *values).drop_while("value < 9").to_list() == ()
    assert sources.of(spark, *values).reversed().take_while("value < 3").to_list() == (2, 1)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_numbering_by_ranges_is_the_same(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % 1009).alias("k"))
    one, two = (sorted(map(tuple, numbered(df, [Key("k", True)], "p", r).select("k", "p").collect())) for r in (False, True))
    assert one == two
    assert sorted(p for _, p in one) == list(range(n))


def test_negative_counts(spark):
    for call in (lambda: sources.of(spark, 1).limit(-1), lambda: sources.of(spark, 1).skip(-1), lambda: G.window_fixed(0), lambda: G.map_concurrent(0, None, [], "")):
        with pytest.raises(errors.IllegalArgumentException):
            call()


def test_bounds(spark):
    assert sources.int_range(spark, 0, 10).skip(3).budget() == 7
    assert sources.int_range(spark, 0, 10).filter("value > 1").size_hint() is None
    assert sources.int_range(spark, 0, 10).filter("value > 1").budget() == 10
    assert sources.int_range(spark, 0, 10).flat_map("array(value)").budget() is None
    assert sources.int_range_closed(spark, 5, 4).count() == 0


def test_unbounded(spark):
    with pytest.raises(errors.IllegalStateException):
        sources.iterate(spark, "1", "x + 1").count()
    assert sources.iterate(spark, "1", "x * 2").limit(5).to_list() == (1, 2, 4, 8, 16)
    assert sources.iterate(spark, "9", "x + 1", "x < 5").to_list() == ()
    assert sources.generate(spark, lambda i: i * i).take_while("value < 50").count() == 8
    assert sources.generate(spark, lambda i: i * i).find_first("value > 5000").first()["value"] == 71 * 71


def test_concat_and_close(spark):
    said = []
    a = sources.of(spark, 1, 2).on_close(lambda: said.append("a")).parallel()
    c = sources.concat(a, sources.of(spark, 3).on_close(lambda: said.append("b")))
    assert not c.is_parallel() and c.budget() == 3
    c.close()
    c.close()
    assert said == ["a", "b"]


def test_builder(spark):
    b = sources.Builder(spark).add(1)
    b.build()
    with pytest.raises(errors.IllegalStateException):
        b.add(2)


def test_windows(spark):
    windows = lambda g, n: [list(r) for r in sources.int_range_closed(spark, 1, n).gather(g).to_list()]
    assert windows(G.window_fixed(3), 7) == [[1, 2, 3], [4, 5, 6], [7]]
    assert windows(G.window_sliding(3), 5) == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert windows(G.window_sliding(3), 2) == []


def test_stretches_join_up(spark, monkeypatch):
    monkeypatch.setattr(G, "STRETCH", 4)
    got = [list(r) for r in sources.int_range(spark, 0, 11).gather(G.window_sliding(3)).to_list()]
    assert got == [[i, i + 1, i + 2] for i in range(9)]
    assert sources.int_range_closed(spark, 1, 10).gather(G.scan_sum(0)).to_list() == tuple(i * (i + 1) // 2 for i in range(11))


def test_windows_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(G, "STRETCH", 4)
    got = [list(r) for r in sources.int_range(spark, 0, 30).gather(G.window_sliding(9)).to_list()]
    assert got == [list(range(i, i + 9)) for i in range(22)]


def test_unbounded_sources_are_tried_without_end(spark):
    n = (1 << 20) + 5
    assert sources.generate(spark, lambda i: i).find_first(f"value = {n}").first()["value"] == n
    assert sources.generate(spark, lambda i: i).take_while(f"value < {n}").count() == n


def test_fold_and_scan(spark):
    step = lambda a, x: a * 2 + x
    assert sources.of(spark, 1, 2, 3).gather(G.fold(F.lit(0), step)).to_list() == (11,)
    assert sources.of(spark, 1, 2, 3).gather(G.scan(F.lit(0), step)).to_list() == (0, 1, 4, 11)
    assert sources.empty(spark).gather(G.fold(F.lit(5), step)).to_list() == (5,)
    assert sources.empty(spark).gather(G.scan(F.lit(5), step)).to_list() == (5,)
    assert sources.empty(spark).reduce("value", step).first()[0] is None
    assert sources.of(spark, 4).reduce("value", step).first()[0] == 4


def test_python_gatherers(spark):
    def pairs(state, row):
        state.append(row[0])
        if len(state) == 2:
            yield (sum(state),)
            state.clear()
        return sum(state) < 7

    def last(state):
        if state:
            yield (-sum(state),)

    g = G.of_sequential(list, pairs, "value long", last)
    assert sources.of(spark, 1, 2, 3, 4, 5).gather(g).to_list() == (3, 7, -5)
    assert sources.of(spark, 1, 9, 3, 7, 5).gather(g).to_list() == (10, 10, -5)
    joined = G.of_sequential(list, pairs, "value long").and_then(G.of_sequential(list, pairs, "value long", last))
    assert sources.of(spark, 1, 0, 2, 0, 9).gather(joined).to_list() == (3,)
    with pytest.raises(errors.UnsupportedOperationException):
        g.combine(1, 2)


def test_collectors(spark):
    words = lambda: sources.of_values(spark, ["alpha", "bb", "ccc", "dd", "e"], "value string")
    assert words().collect(r=C.joining(", ", "[", "]")).first()[0] == "[alpha, bb, ccc, dd, e]"
    assert sources.empty(spark, "value string").collect(r=C.joining(", ", "[", "]")).first()[0] == "[]"
    got = {r.key: list(r.v) for r in words().grouping_by({"key": "length(value)"}, v=C.to_list()).collect()}
    assert got == {5: ["alpha"], 2: ["bb", "dd"], 3: ["ccc"], 1: ["e"]}
    parted = words().partitioning_by("length(value) > 9", n=C.counting()).collect()
    assert [(r.key, r.n) for r in parted] == [(False, 5), (True, 0)]
    tenths = sources.of_values(spark, [0.1] * 10, "value double")
    assert tenths.collect(r=C.summing_double("value", 1)).first()[0] == 1.0
    with pytest.raises(Exception, match="Duplicate key"):
        words().grouping_by({"key": "length(value)"}, v=C.to_map("value")).collect()
    assert sources.empty(spark).collect(s=C.summarizing("value", "int")).select("s.*").first()[:] == (0, 0, 2**31 - 1, -(2**31), 0.0)
    assert sources.of(spark, 2**31 - 1, 1).collect(r=C.summing_int("value")).first()[0] == -(2**31)


def test_first_of_ties(spark):
    rows = [(1, 5), (1, 9), (0, 7)]
    s = lambda: sources.of_values(spark, rows, "a int, b int")
    assert s().max("a").first()[:] == (1, 5)
    assert s().collect(r=C.max_by("a", "b")).first()[0] == 5
    assert Seq(spark.createDataFrame([("x", 1, 5), ("y", 1, 9)], "o string, a int, b int"), ["o"]).collect(r=C.max_by("a", "b")).first()[0] == 5


def test_collect_python(spark):
    got = sources.int_range(spark, 0, 100).collect_python(list, lambda a, r: [*a, r[0]], lambda a, b: a + b)
    assert got == list(range(100))


def test_iterator_ends(spark):
    it = sources.of(spark, 1).iterator()
    assert next(it)[0] == 1
    with pytest.raises((errors.NoSuchElementException, RuntimeError)):
        next(it)


def test_comparator_values():
    assert O.natural_order().compare(1, 2) == -1
    assert O.nulls_first(O.natural_order()).compare(None, 2) == -1
    assert O.nulls_first(O.natural_order()).reversed().compare(None, 2) == 1


def test_optional():
    assert Optional.of(3).map(lambda x: x + 1).filter(lambda x: x > 3).or_else(0) == 4
    assert Optional.empty().or_else_get(lambda: 9) == 9
    assert str(Optional.of_nullable(None)) == "Optional.empty"
    with pytest.raises(errors.NoSuchElementException, match="No value present"):
        Optional.empty().get()
    with pytest.raises(errors.NullPointerException):
        Optional.of(None)


def test_sums_of_any_doubles(spark):
    import math
    import random

    def total(values):
        return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3).agg(C.exact_double_sum(F.col("v"))).first()[0]

    assert total([0.001] * 1000) == 1.0 and total([0.1] * 10000) == 1000.0
    assert total([1e20, 1, -1e20]) == 1.0 and total([]) is None
    assert math.isnan(total([math.nan, 1])) and total([math.inf, 1]) == math.inf and total([1e300, 1e300]) == 2e300
    rng = random.Random(1)
    for scale in (1e-8, 1, 1e15, 1e25):
        values = [(rng.random() - 0.5) * scale for _ in range(500)]
        assert math.isclose(total(values), math.fsum(values), rel_tol=1e-15)


def test_collectors_side_by_side(spark):
    df = spark.createDataFrame([(1, 1, [1, 2, 3], ["a"]), (2, 1, [], ["b", None]), (3, 2, None, None)], "id int, k int, a array<int>, b array<string>")
    seq = lambda: sources.of_frame(df, "id")
    both = C.teeing(C.counting(), C.flat_mapping("a", C.to_list), lambda n, x: F.struct(n, x))
    got = seq().grouping_by("k", n=C.counting(), items=C.flat_mapping("a", lambda x: C.counting()), strings=C.flat_mapping("b", lambda x: C.counting()), both=both).orderBy("k").collect()
    assert [(r.n, r.items, r.strings, tuple(r.both)) for r in got] == [(2, 3, 3, (2, [1, 2, 3])), (1, 0, 0, (1, []))]
    sides = seq().partitioning_by("id > 9", ids=C.to_list("id"), users=C.to_set("id"), s=C.summarizing("id", "int"), items=C.flat_mapping("a", C.to_list)).collect()
    assert [(r.ids, r.users, r["items"]) for r in sides] == [([1, 2, 3], [1, 2, 3], [1, 2, 3]), ([], [], [])]
    assert tuple(sides[1].s) == (0, 0, 2**31 - 1, -(2**31), 0.0)
    nested = seq().collect(x=C.flat_mapping("b", lambda b: C.filtering(b.isNotNull(), C.to_list(b))), y=C.flat_mapping("a", lambda a: C.flat_mapping(F.sequence(F.lit(1), a), C.to_list))).first()
    assert nested.x == ["a", "b"] and nested.y == [1, 1, 2, 1, 2, 3]
    assert [(r.k, r.x) for r in seq().grouping_by("k", x=C.filtering("id = 2", C.to_map("id"))).collect()] == [(1, 2)]


def test_cuts_with_a_null_key(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (2, 9), (3, 1)], "k int, value int")
    assert [r.value for r in sources.of_frame(df, "k").take_while("value < 5").frame().collect()] == [1, 2]
    assert sorted(r.value for r in sources.of_frame(df, "k").drop_while("value < 5").frame().collect()) == [1, 9]
    assert sources.of_frame(df, "k").skip(1).map(value="value").to_list() == (2, 9, 1)
    assert sources.of_frame(df, "k").reversed().skip(1).map(value="value").to_list() == (9, 2, 1)
    assert sources.of_frame(df, "k").skip(9).map(value="value").to_list() == ()
