"""Queries for the container layer: sets, lists, deques, maps, ordered maps, factories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes
from ..operators.containers import deques, lists, maps, navigable, sets
from .registry import query

# Sets


def customers(t):
    return t.df("customer").select(F.col("c_custkey").alias("value"))


def buyers(t):
    """Customers with orders over 300000, and some keys that are no customers."""
    return t.df("orders").where("o_totalprice > 300000").select((F.col("o_custkey") * 2).alias("value"))


A, B = "(SELECT c_custkey AS value FROM customer)", "(SELECT o_custkey * 2 AS value FROM orders WHERE o_totalprice > 300000)"


@query("set_union", f"SELECT value FROM {A} UNION SELECT value FROM {B}")
def _(t):
    return sets.union(customers(t), buyers(t))


@query("set_intersect", f"SELECT value FROM {A} INTERSECT SELECT value FROM {B}")
def _(t):
    return sets.intersect(customers(t), buyers(t))


@query("set_except", f"SELECT value FROM {A} EXCEPT SELECT value FROM {B}")
def _(t):
    return sets.subtract(customers(t), buyers(t))


@query("set_contains_all", f"SELECT NOT EXISTS (SELECT 1 FROM {B} b WHERE b.value NOT IN (SELECT value FROM {A})) AS result")
def _(t):
    return sets.contains_all(customers(t), buyers(t))


@query("set_equals", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) + (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS result")
def _(t):
    return sets.equal(customers(t), t.df("orders").select(F.col("o_custkey").alias("value")))


# Lists: event types and users in the order of events


def users(t):
    return t.seq("events", "user_id").map(value="user_id").with_position()


def few(t):
    return t.df("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("value"))


USERS = "(SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, user_id AS value FROM events)"
RENUMBER = "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, value FROM {} WHERE {}"


@query("list_add_all", f"SELECT pos, value FROM {USERS} UNION ALL SELECT (SELECT count(*) FROM events) + row_number() OVER (ORDER BY s_suppkey) - 1, s_suppkey FROM supplier")
def _(t):
    return lists.add_all(users(t), t.seq("supplier", "s_suppkey").map(value="s_suppkey").with_position())


@query("list_retain_all", RENUMBER.format(USERS, "value IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)"))
def _(t):
    return lists.retain_all(users(t), few(t))


@query("list_remove_all", RENUMBER.format(USERS, "value NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)"))
def _(t):
    return lists.remove_all(users(t), few(t))


@query("coll_remove_if", "SELECT event_id, value FROM events WHERE NOT value > 20")
def _(t):
    rows = sets.FrameSet(t.df("events").select("event_id", "value"))
    rows.remove_if("value > 20")
    return rows.df


@query("list_remove_first", RENUMBER.format(USERS, f"pos <> (SELECT min(pos) FROM {USERS} WHERE value = 7)"))
def _(t):
    return lists.remove_first(users(t), 7)


@query("list_equals", f"SELECT NOT EXISTS (SELECT 1 FROM {USERS} a JOIN (SELECT row_number() OVER (ORDER BY value, pos) - 1 AS pos, value FROM {USERS}) b ON a.pos = b.pos WHERE a.value IS DISTINCT FROM b.value) AS result")
def _(t):
    return lists.equal(users(t), lists.sorted_list(users(t)))


@query("list_get", f"SELECT value FROM {USERS} WHERE pos = 41")
def _(t):
    return t.spark.createDataFrame([(lists.FrameList(users(t)).get(41),)], "value long")


@query("list_index_of", f"SELECT coalesce(min(pos), -1) AS result FROM {USERS} WHERE value = 11")
def _(t):
    return lists.index_of(users(t), 11)


@query("list_last_index_of", f"SELECT coalesce(max(pos), -1) AS result FROM {USERS} WHERE value = 11")
def _(t):
    return lists.last_index_of(users(t), 11)


@query("list_insert_at", f"SELECT pos + CASE WHEN pos >= 5 THEN 1 ELSE 0 END AS pos, value FROM {USERS} UNION ALL SELECT 5, -1")
def _(t):
    return lists.insert_at(users(t), 5, -1)


@query("list_remove_at", f"SELECT pos - CASE WHEN pos > 5 THEN 1 ELSE 0 END AS pos, value FROM {USERS} WHERE pos <> 5")
def _(t):
    return lists.remove_at(users(t), 5)


@query("list_set", f"SELECT pos, CASE WHEN pos = 5 THEN -9 ELSE value END AS value FROM {USERS}")
def _(t):
    return lists.set_at(users(t), 5, F.lit(-9).cast("long"))


@query("list_sort", f"SELECT row_number() OVER (ORDER BY value, pos) - 1 AS pos, value FROM {USERS}")
def _(t):
    return lists.sorted_list(users(t))


@query("list_replace_all", f"SELECT pos, value * 10 AS value FROM {USERS}")
def _(t):
    return users(t).withColumn("value", F.col("value") * 10)


@query("list_sub_list", f"SELECT pos - 100 AS pos, value FROM {USERS} WHERE pos >= 100 AND pos < 200")
def _(t):
    return lists.sub_list(users(t), 100, 200)


@query("list_reversed", f"SELECT (SELECT count(*) FROM events) - 1 - pos AS pos, value FROM {USERS}")
def _(t):
    return lists.reversed_list(users(t))


@query("list_first_last", f"SELECT arg_min(value, pos) AS first, arg_max(value, pos) AS last FROM {USERS}")
def _(t):
    return users(t).agg(F.min_by("value", "pos").alias("first"), F.max_by("value", "pos").alias("last"))


@query("queue_poll_n", f"SELECT pos, value FROM {USERS} WHERE pos < 10")
def _(t):
    return deques.poll(users(t), 10)


@query("deque_both_ends", f"SELECT pos, value FROM {USERS} WHERE pos < 5 OR pos >= (SELECT count(*) FROM events) - 5")
def _(t):
    rows = users(t)
    return deques.poll(rows, 5).unionByName(deques.poll(rows, 5, last=True))


@query("deque_remove_last_occurrence", RENUMBER.format(USERS, f"pos <> (SELECT max(pos) FROM {USERS} WHERE value = 7)"))
def _(t):
    return lists.remove_first(users(t), 7, last=True)


# Maps: customers' balances, and orders per customer


def balances(t):
    return t.df("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))


def spent(t):
    """Twice the customer's key -> their largest price, for customers with orders over 200000."""
    return t.df("orders").where("o_totalprice > 200000").groupBy((F.col("o_custkey") * 2).alias("key")).agg(F.max("o_totalprice").alias("value"))


M, N = "(SELECT c_custkey AS key, c_acctbal AS value FROM customer)", "(SELECT o_custkey * 2 AS key, max(o_totalprice) AS value FROM orders WHERE o_totalprice > 200000 GROUP BY 1)"
BOTH = f"FROM {M} a FULL OUTER JOIN {N} b ON a.key = b.key"
KEY = "coalesce(a.key, b.key) AS key"


@query("map_lookup_join", f"SELECT o_orderkey, o_custkey AS key, a.value AS found FROM orders LEFT JOIN {M} a ON a.key = o_custkey")
def _(t):
    return maps.lookup(t.df("orders").select("o_orderkey", F.col("o_custkey").alias("key")), balances(t))


@query("map_get_or_default", f"SELECT o_orderkey, o_custkey AS key, CASE WHEN b.key IS NULL THEN -1.0 ELSE b.value END AS found FROM orders LEFT JOIN {N} b ON b.key = o_custkey")
def _(t):
    return maps.lookup(t.df("orders").select("o_orderkey", F.col("o_custkey").alias("key")), spent(t), -1.0)


@query("map_contains_value", "SELECT count(*) > 0 AS result FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)")
def _(t):
    top = balances(t).agg(F.max("value").alias("m")).scalar()
    return balances(t).agg(F.coalesce(F.bool_or(F.col("value") == top), F.lit(False)).alias("result"))


@query("map_put_all", f"SELECT {KEY}, CASE WHEN b.key IS NULL THEN a.value ELSE b.value END AS value {BOTH}")
def _(t):
    return maps.put_all(balances(t), spent(t))


@query("map_put_if_absent", f"SELECT {KEY}, CASE WHEN a.key IS NULL THEN b.value ELSE a.value END AS value {BOTH}")
def _(t):
    return maps.put_if_absent(balances(t), spent(t))


@query("map_remove", f"SELECT key, value FROM {M} WHERE key NOT IN (SELECT key FROM {N})")
def _(t):
    return maps.remove_keys(balances(t), spent(t))


@query("map_remove_kv", f"SELECT key, value FROM {M} WHERE NOT (key % 4 = 0)")
def _(t):
    entries = balances(t).select("key", F.when(F.col("key") % 4 == 0, F.col("value")).otherwise(F.col("value") + 1).alias("value"))
    return maps.remove_entries(balances(t), entries)


@query("map_compute_if_absent", f"SELECT key, value FROM {M} UNION ALL SELECT key, CAST(key AS DOUBLE) FROM {N} WHERE key NOT IN (SELECT key FROM {M}) AND key % 3 <> 0")
def _(t):
    return maps.compute_if_absent(balances(t), spent(t), "CASE WHEN key % 3 <> 0 THEN CAST(key AS DOUBLE) END")


@query("map_compute_if_present", f"SELECT a.key, CASE WHEN b.key IS NULL THEN a.value ELSE a.value * 2 END AS value FROM {M} a LEFT JOIN {N} b ON a.key = b.key WHERE b.key IS NULL OR a.value > 0")
def _(t):
    return maps.compute_if_present(balances(t), spent(t), "CASE WHEN value > 0 THEN value * 2 END")


@query("map_compute", f"SELECT {KEY}, CASE WHEN b.key IS NULL THEN a.value ELSE coalesce(a.value, 0) + 1 END AS value {BOTH} WHERE b.key IS NULL OR coalesce(a.key, b.key) % 4 <> 0")
def _(t):
    return maps.compute(balances(t), spent(t), "CASE WHEN key % 4 <> 0 THEN coalesce(value, 0D) + 1 END")


@query("map_merge", f"SELECT {KEY}, CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN a.value + b.value ELSE coalesce(a.value, b.value) END AS value {BOTH} WHERE NOT (a.key IS NOT NULL AND b.key IS NOT NULL AND a.value < 0)")
def _(t):
    return maps.merge(balances(t), spent(t), lambda old, new: F.when(old >= 0, old + new))


@query("map_replace", f"SELECT a.key, CASE WHEN b.key IS NULL THEN a.value ELSE b.value END AS value FROM {M} a LEFT JOIN {N} b ON a.key = b.key")
def _(t):
    return maps.replace(balances(t), spent(t))


@query("map_replace_kov", f"SELECT key, CASE WHEN key % 5 = 0 THEN 0.0 ELSE value END AS value FROM {M}")
def _(t):
    new = balances(t).select("key", F.lit(0.0).alias("value"), F.when(F.col("key") % 5 == 0, F.col("value")).otherwise(F.col("value") - 1).alias("expected"))
    return maps.replace(balances(t), new, "expected")


@query("map_replace_all", f"SELECT key, value * 2 AS value FROM {M}")
def _(t):
    return balances(t).select("key", (F.col("value") * 2).alias("value"))


@query("map_equals", f"SELECT (SELECT count(*) FROM (SELECT * FROM {M} EXCEPT SELECT * FROM {N})) + (SELECT count(*) FROM (SELECT * FROM {N} EXCEPT SELECT * FROM {M})) = 0 AS result")
def _(t):
    return maps.equal(balances(t), spent(t))


@query("map_key_set", f"SELECT key FROM {N}")
def _(t):
    return maps.FrameMap(spent(t)).key_set().df


@query("map_values", f"SELECT value FROM {N}")
def _(t):
    return maps.FrameMap(spent(t)).values().df


@query("map_entry_set", f"SELECT key, value FROM {N}")
def _(t):
    return maps.FrameMap(spent(t)).entry_set().df


# Ordered maps: parts by key; probes are orders against events


def parts(t):
    return navigable.NavigableMap(t.df("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")))


P = "(SELECT p_partkey AS key, p_name AS value FROM part)"


@query("nav_first_last", f"SELECT min(key) AS first, max(key) AS last, arg_min(value, key) AS first_value, arg_max(value, key) AS last_value FROM {P}")
def _(t):
    first, last = parts(t).first_entry(), parts(t).last_entry()
    return t.spark.createDataFrame([(first["key"], last["key"], first["value"], last["value"])], "first long, last long, first_value string, last_value string")


@query("nav_poll_first", f"SELECT key, value FROM {P} WHERE key <> (SELECT min(key) FROM {P})")
def _(t):
    left = parts(t)
    left.poll_first_entry()
    return left.df


@query("nav_sub", f"SELECT key, value FROM {P} WHERE key >= 100 AND key < 200")
def _(t):
    return parts(t).sub_map(100, 200).df


@query("nav_head", f"SELECT key, value FROM {P} WHERE key <= 50")
def _(t):
    return parts(t).head_map(50, True).df


@query("nav_tail", f"SELECT key, value FROM {P} WHERE key > 150")
def _(t):
    return parts(t).tail_map(150, False).df


@query("nav_sub_of_sub", f"SELECT key, value FROM {P} WHERE key > 120 AND key <= 150")
def _(t):
    return parts(t).sub_map(100, 200).sub_map(120, 150, False, True).df


@query("nav_descending", f"SELECT key, row_number() OVER (ORDER BY key DESC) - 1 AS pos FROM {P} WHERE key <= 100")
def _(t):
    from ..operators.seq import Seq
    from .order import Key

    return Seq(parts(t).head_map(100, True).descending_map().df.select("key"), [Key("key", True)]).with_position()


@query("nav_descending_head", f"SELECT key, value FROM {P} WHERE key >= 150")
def _(t):
    return parts(t).descending_map().head_map(150, True).df


# Nearest keys: every order probes all events. Keys are spread (times 3, times 4) so that some are met, some
# lie between two and the last lie behind all.


def probes(t):
    return t.df("orders").select("o_orderkey", (F.col("o_orderkey") * 3).alias("probe"))


def spread(t):
    return navigable.NavigableMap(t.df("events").select((F.col("event_id") * 4).alias("key"), F.col("user_id").alias("value")))


def asof(sign, within="TRUE"):
    return f"SELECT o.o_orderkey, o.probe, e.key AS found FROM (SELECT o_orderkey, o_orderkey * 3 AS probe FROM orders) o ASOF LEFT JOIN (SELECT key FROM (SELECT event_id * 4 AS key FROM events) WHERE {within}) e ON o.probe {sign} e.key"


for _kind, _sign in (("floor", ">="), ("lower", ">"), ("ceiling", "<="), ("higher", "<")):
    for _name in (f"nav_{_kind}", f"nav_{_kind}_all"):
        query(_name, asof(_sign))(lambda t, k=_kind: spread(t).nearest(probes(t), "probe", k))


@query("nav_descending_floor", asof("<="))
@query("nav_descending_floor_all", asof("<="))
def _(t):
    return spread(t).descending_map().nearest(probes(t), "probe", "floor")


@query("nav_floor_clamped", asof(">=", "key >= 100 AND key < 300"))
@query("nav_floor_clamped_all", asof(">=", "key >= 100 AND key < 300"))
def _(t):
    return spread(t).sub_map(100, 300).nearest(probes(t), "probe", "floor")


@query("nav_key_set", f"SELECT key FROM {P} WHERE key < 100")
def _(t):
    return parts(t).head_map(100).navigable_key_set()


# Factories


@query("fac_lists_of", "SELECT CAST(unnest(range(3)) AS BIGINT) AS pos, CAST(unnest([3, 1, 3]) AS INTEGER) AS value")
def _(t):
    return lists.FrameList.of(t.spark, 3, 1, 3).freeze().df


@query("fac_sets_of", "SELECT CAST(unnest([1, 3]) AS INTEGER) AS value")
def _(t):
    return sets.FrameSet.of(t.spark, 3, 1, 3).freeze().df


@query("fac_maps_of", "SELECT unnest(['ada', 'alan', 'grace']) AS key, CAST(unnest([36, 41, 45]) AS INTEGER) AS value")
def _(t):
    return maps.FrameMap.of(t.spark, {"ada": 36, "alan": 41, "grace": 45}).freeze().df


@query("list_hash_code", "SELECT CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS result FROM (SELECT list_reduce(list_prepend(CAST(1 AS BIGINT), list(r_regionkey ORDER BY r_regionkey)::BIGINT[]), lambda h, x: (31 * h + x) % 4294967296) AS h FROM region)")
def _(t):
    return hashes.list_hash(t.seq("region", "r_regionkey").map(value="r_regionkey").with_position())


@query("set_hash_code", "SELECT CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS result FROM (SELECT CAST(sum(c_custkey) % 4294967296 AS BIGINT) AS h FROM customer)")
def _(t):
    return hashes.set_hash(customers(t))


@query("map_hash_code", "SELECT CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS result FROM (SELECT CAST(sum(xor(o_orderkey, o_custkey)) % 4294967296 AS BIGINT) AS h FROM orders)")
def _(t):
    return hashes.map_hash(t.df("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")))
