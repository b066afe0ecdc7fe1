"""Writing lists, reading hashes and sets, and the keyspace, on the long-form tables of ``keyed``.

Lists are rows (key, pos, value); pos orders a list and need not be dense, so a push or a pop touches only its own rows
and no list is gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import _unless, live

# ---- lists


def push(lists: DataFrame, items: DataFrame, *, left: bool = False, only_existing: bool = False) -> DataFrame:
    """LPUSH/RPUSH, LPUSHX/RPUSHX with only_existing: items (key, ord, value) enter one after another."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    ends = lists.groupBy("key").agg(F.min("pos").alias("_low"), F.max("pos").alias("_high"))
    new = items.withColumn("_n", n).join(ends, "key", "inner" if only_existing else "left")
    pos = F.coalesce("_low", F.lit(0)) - F.col("_n") if left else F.coalesce("_high", F.lit(-1)) + F.col("_n")
    return lists.unionByName(new.select("key", pos.cast(lists.schema["pos"].dataType).alias("pos"), "value"))


def placed(lists: DataFrame, left: bool = True) -> DataFrame:
    """lists with n, the place from the head (or the tail), from 0."""
    return lists.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("pos") if left else F.col("pos").desc())) - 1)


def pop(lists: DataFrame, count: int = 1, *, left: bool = True, keys: list | None = None) -> tuple[DataFrame, DataFrame]:
    """LPOP/RPOP: what is taken from each key (of keys), and what stays."""
    mine = lists if keys is None else lists.where(F.col("key").isin(keys))
    gone = placed(mine, left).where(F.col("n") < count)
    return gone, lists.join(gone.select("key", "pos"), ["key", "pos"], "left_anti")


def multi_pop(lists: DataFrame, keys: list, count: int = 1, *, left: bool = True, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """LMPOP/ZMPOP: count elements of the first of keys that has any (order score for sorted sets), and what stays."""
    rank = reduce(lambda c, kv: F.when(F.col("key") == kv[1], kv[0]).otherwise(c), reversed(list(enumerate(keys))), F.lit(None).cast("int"))
    mine = lists.withColumn("_rank", rank).where("_rank is not null")
    first = mine.agg(F.min("_rank").alias("_first"))  # one row
    mine = mine.crossJoin(F.broadcast(first)).where("_rank = _first").drop("_rank", "_first")
    rest = [c for c in lists.columns if c not in ("key", order)]
    by = [F.col(c) if left else F.col(c).desc() for c in (order, *(rest if order != "pos" else ()))]
    gone = mine.orderBy(*by).limit(count)
    same = ["key", "pos"] if order == "pos" else ["key", "member"]
    return gone, lists.join(gone.select(*same), same, "left_anti")


def set_at(lists: DataFrame, key, index: int, value) -> DataFrame:
    """LSET: the element at a place, from the tail if negative; nothing changes where there is none."""
    it = placed(lists.where(F.col("key") == key), index >= 0).where(F.col("n") == (index if index >= 0 else -index - 1)).select("key", "pos", F.lit(value).alias("_new"))
    return lists.join(F.broadcast(it), ["key", "pos"], "left").select("key", "pos", F.coalesce("_new", "value").alias("value"))


def move(lists: DataFrame, source, target, *, from_left: bool = False, to_left: bool = True) -> DataFrame:
    """LMOVE, RPOPLPUSH by default: an end of source becomes an end of target; without source nothing changes."""
    gone, rest = pop(lists, 1, left=from_left, keys=[source])
    return push(rest, gone.select(F.lit(target).cast(lists.schema["key"].dataType).alias("key"), F.lit(0).alias("ord"), "value"), left=to_left)


def serve(items: DataFrame, waiters: DataFrame, *, highest: bool = False, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """BLPOP/BRPOP/BZPOPMIN/BZPOPMAX: waiters (key, ord, waiter) get elements in order of their waiting.

    Returns (served, still waiting); a stream calls it for each batch and keeps both rests.
    """
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.col(order).desc() if highest else F.col(order)))
    w = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    waiting = waiters.withColumn("_n", w)
    served = waiting.join(items.withColumn("_n", n), ["key", "_n"]).drop("_n")
    return served, waiters.join(served.select("key", "ord"), ["key", "ord"], "left_anti")


# ---- hashes, sets, sorted sets


def get_all(hashes: DataFrame) -> DataFrame:
    """HGETALL/HKEYS/HVALS: each key's map, its fields in order and their values. A hash is one row, as its reply is."""
    pairs = F.sort_array(F.collect_list(F.struct("field", "value")))
    made = hashes.groupBy("key").agg(pairs.alias("_p"))
    return made.select("key", F.map_from_entries("_p").alias("map"), F.col("_p.field").alias("fields"), F.col("_p.value").alias("values"))


def lengths(rows: DataFrame) -> DataFrame:
    """HLEN/SCARD/ZCARD/LLEN: rows of each key."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def has(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """HEXISTS/SISMEMBER/SMISMEMBER: wanted with found."""
    return wanted.join(rows.select(*on).distinct().withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def draws(rows: DataFrame, count: int, seed: int = 0, member: str = "member") -> DataFrame:
    """SRANDMEMBER/HRANDFIELD/ZRANDMEMBER with a negative count: count seeded draws from each key, with repeats."""
    w = Window.partitionBy("key").orderBy(member)
    numbered = rows.withColumn("_i", F.row_number().over(w) - 1)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    picks = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "key", "draw"), "_n"))
    return picks.join(numbered, ["key", "_i"]).select("key", "draw", member)


def taken(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """GETDEL/HGETDEL/SPOP: the rows of keys, and what stays."""
    return rows.join(keys.select(*on), on, "left_semi"), rows.join(keys.select(*on), on, "left_anti")


def get_expire(rows: DataFrame, keys: DataFrame, on: list[str], at: Column, column: str = "expire_at") -> tuple[DataFrame, DataFrame]:
    """GETEX/HGETEX: the values of keys, and the table with their new expiry (null: none, as PERSIST/HPERSIST)."""
    hit = rows.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return rows.join(keys.select(*on), on, "left_semi"), hit.withColumn(column, F.when(F.col("_hit"), at).otherwise(F.col(column))).drop("_hit")


# ---- keyspace: tables by type, each with db and key


def keyspace(tables: dict[str, DataFrame]) -> DataFrame:
    """TYPE: (db, key, type) of every key."""
    return reduce(DataFrame.unionByName, [t.select("db", "key").distinct().withColumn("type", F.lit(name)) for name, t in tables.items()])


def db_size(strings: DataFrame, now: Column) -> DataFrame:
    """DBSIZE: live keys of each db."""
    return live(strings, now).groupBy("db").agg(F.count_distinct("key").alias("n"))


def random_key(keys: DataFrame, seed: int = 0) -> DataFrame:
    """RANDOMKEY: one seeded key."""
    return keys.select("key").orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(1)


def move_db(table: DataFrame, key, source: int, target: int) -> DataFrame:
    """MOVE: a key changes its db unless the other has it."""
    mine = (F.col("db") == source) & (F.col("key") == key)
    there = table.where((F.col("db") == target) & (F.col("key") == key))
    from .keyed import _when

    moved = table.where(mine)
    return table.where(~mine).unionByName(_unless(moved.withColumn("db", F.lit(target)), there)).unionByName(_when(moved, there))


def swap_db(table: DataFrame, a: int, b: int) -> DataFrame:
    """SWAPDB."""
    return table.withColumn("db", F.when(F.col("db") == a, b).when(F.col("db") == b, a).otherwise(F.col("db")))


def flush(table: DataFrame, db: int | None = None) -> DataFrame:
    """FLUSHDB, FLUSHALL without a db."""
    return table.where("false") if db is None else table.where(F.col("db") != db)


def notifications(log: DataFrame, keys: list[str], order: str, value: str, events: tuple[str, str] = ("set", "del")) -> DataFrame:
    """Keyspace notifications of a log of writes (null: deleted): channel and event, in the log's order."""
    at = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return log.select(order, F.concat(F.lit("__keyspace@0__:"), at).alias("channel"), F.when(F.col(value).isNull(), events[1]).otherwise(events[0]).alias("event"))


def invalidate_range(docs: DataFrame, tag: str, value: str, number: str, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """FT.INVALIDATE_RANGE: how many documents go, and those that stay."""
    gone = F.coalesce((F.col(tag) == value) & F.col(number).between(low, high), F.lit(False))
    return docs.agg(F.count_if(gone).alias("n")), docs.where(~gone)
