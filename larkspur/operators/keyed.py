"""Keyed collections in long form: strings, hashes, lists, sets and sorted sets, with expiry.

Tables: strings (key, value, expire_at), hashes (key, field, value, field_expire_at), lists (key, pos, value),
sets (key, member), sorted sets (key, member, score). Operators are set-oriented: they act on all keys at once, and
shuffle on key (or key and member) only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# ---- strings -------------------------------------------------------------------------------------------------


def live(df: DataFrame, now: Column | str, expire: str = "expire_at") -> DataFrame:
    """Rows that have not expired."""
    return df.where(F.col(expire).isNull() | (F.col(expire) > now))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], *, mode: str | None = None) -> DataFrame:
    """SET/MSET/HSET: changes win; mode NX only adds, XX only replaces. changes: one row a key."""
    if mode == "NX":
        return table.unionByName(changes.join(table.select(*keys), keys, "left_anti"))
    if mode == "XX":
        changes = changes.join(table.select(*keys), keys, "left_semi")
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def last_write(log: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """The state after a log of writes: the last value of each key."""
    return log.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def running(log: DataFrame, keys: list[str], order: str, delta: str) -> DataFrame:
    """INCRBY/HINCRBY: the value after each increment of a log, null where it leaves 64 bits; increments that are no integers count 0.

    Whole decimals are integers too, so increments may be wider than 64 bits.
    """
    kind = log.schema[delta].dataType
    whole = isinstance(kind, DecimalType) and kind.scale == 0
    by = F.coalesce(F.col(delta) if whole else F.col(delta).try_cast("bigint"), F.lit(0)).cast("decimal(38,0)")
    return log.withColumn("value", F.sum(by).over(Window.partitionBy(*keys).orderBy(order)).try_cast("bigint"))


def running_float(log: DataFrame, keys: list[str], order: str, delta: str) -> DataFrame:
    """INCRBYFLOAT/HINCRBYFLOAT: the value after each increment; increments that are no finite numbers are refused and count 0."""
    by = F.col(delta).try_cast("double")
    by = F.when(by.isNull() | F.isnan(by) | (F.abs(by) == float("inf")), 0.0).otherwise(by)
    return log.withColumn("value", F.sum(by).over(Window.partitionBy(*keys).orderBy(order)))


def appended(log: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """APPEND: each key's pieces of a log joined in order."""
    pieces = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return log.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x["v"]), "").alias(value))


def get_set(log: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """GETSET: each write and the value before it."""
    return log.withColumn("old", F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def multi_get(table: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """MGET/HMGET/ZMSCORE: wanted (ord, key) with the value, null where it is missing."""
    return wanted.join(table, key, "left")


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DEL/UNLINK/HDEL/SREM/ZREM/XDEL/GETDEL: table without the keys of gone."""
    return table.join(gone.select(*keys), keys, "left_anti")


def exists(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """EXISTS/TOUCH: how many of keys (repeats count) exist."""
    return keys.join(table.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def rename(table: DataFrame, old: str, new: str, key: str = "key") -> DataFrame:
    """RENAME: rows of old take new's place; the same name or a missing source changes nothing."""
    if old == new:
        return table
    moved = table.where(F.col(key) == old).withColumn(key, F.lit(new).cast(table.schema[key].dataType))
    return table.where(~F.col(key).isin(old, new)).unionByName(moved).unionByName(_unless(table.where(F.col(key) == new), moved))


def rename_nx(table: DataFrame, old: str, new: str, key: str = "key") -> DataFrame:
    """RENAMENX: as RENAME if new is free."""
    taken = table.where(F.col(key) == new)
    moved = table.where(F.col(key) == old)
    return table.where(F.col(key) != old).unionByName(_unless(moved.withColumn(key, F.lit(new).cast(table.schema[key].dataType)), taken)).unionByName(_when(moved, taken))


def expire(table: DataFrame, keys: Column, at: Column, condition: str | None = None, column: str = "expire_at") -> DataFrame:
    """EXPIRE and its kin, HEXPIRE on field_expire_at: a new time for rows where keys holds; condition NX, XX, GT or LT.

    No expiry counts as infinitely late for GT and LT.
    """
    old = F.col(column)
    ok = {None: F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (at > old), "LT": old.isNull() | (at < old)}[condition]
    return table.withColumn(column, F.when(keys & ok, at).otherwise(old))


def field_ttl(expire_ms: Column, now_ms: Column, milliseconds: bool = False, found: Column | None = None) -> Column:
    """HTTL/HPTTL: what remains in whole seconds, 0 once it is over, -1 without expiry, -2 for missing fields."""
    left = F.greatest(expire_ms - now_ms, F.lit(0))
    out = F.when(expire_ms.isNull(), -1).otherwise(left if milliseconds else F.floor(left / 1000))
    return out if found is None else F.when(found, out).otherwise(-2)


def expire_time(expire_ms: Column, found: Column, milliseconds: bool = False) -> Column:
    """EXPIRETIME/PEXPIRETIME/HEXPIRETIME/HPEXPIRETIME: when it ends, -1 without expiry, -2 where it is missing."""
    return F.when(~found, -2).when(expire_ms.isNull(), -1).otherwise(expire_ms if milliseconds else F.floor(expire_ms / 1000))


def ttl(expire_ms: Column, now_ms: Column, milliseconds: bool = False) -> Column:
    """TTL/PTTL: what remains, rounded to seconds, -1 without expiry; rows that are missing or expired give -2."""
    left = expire_ms - now_ms
    return F.when(expire_ms.isNull(), -1).when(left <= 0, -2).otherwise(left if milliseconds else F.floor((left + 500) / 1000))


def scan(table: DataFrame, after: str | None, count: int, pattern: str | None = None, key: str = "key") -> DataFrame:
    """SCAN/HSCAN/SSCAN/ZSCAN as keyset pages: the next count keys after a key, filtered by a glob."""
    from ..functions.strings import matches

    page = table.select(key).distinct() if after is None else table.where(F.col(key) > after).select(key).distinct()
    page = page.orderBy(key).limit(count)
    return page.where(matches(F.col(key), pattern)) if pattern else page


def sort(elements: DataFrame, *, by: DataFrame | None = None, get: DataFrame | None = None, alpha: bool = False, desc: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """SORT: elements (value) by themselves or by weights (value, weight), with values looked up in get (value, got)."""
    out = elements.join(by, "value", "left") if by is not None else elements.withColumn("weight", F.col("value"))
    weight = F.col("weight") if alpha else F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0))
    order = [weight.desc() if desc else weight.asc(), F.col("value").desc() if desc else F.col("value").asc()]
    out = out.orderBy(*order).offset(offset)
    out = out.limit(count) if count is not None else out
    return out.join(get, "value", "left") if get is not None else out


# ---- lists ---------------------------------------------------------------------------------------------------


def as_list(items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, items): each key's values in order, for the array operators below."""
    return items.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))


def list_range(items: Column, start: int, stop: int) -> Column:
    """LRANGE/LTRIM: an inclusive slice, negative places from the end."""
    n = F.size(items)
    a = F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(start)
    b = n + stop if stop < 0 else F.least(F.lit(stop), n - 1)
    return F.when((a > b) | (a >= n), F.slice(items, 1, 0)).otherwise(F.slice(items, a + 1, F.greatest(b - a + 1, F.lit(0))))


def list_index(items: Column, at: int) -> Column:
    """LINDEX."""
    return F.get(items, F.size(items) + at if at < 0 else F.lit(at))


def list_remove(items: Column, value: Column, count: int) -> Column:
    """LREM: remove count matches from the head, from the tail if negative, all if 0."""
    if count < 0:
        return F.reverse(list_remove(F.reverse(items), value, -count))
    if not count:
        return F.filter(items, lambda x: x != value)
    places = F.filter(F.transform(items, lambda x, i: F.when(x == value, i)), lambda i: i.isNotNull())
    last = F.coalesce(F.get(places, F.least(F.lit(count), F.size(places)) - 1), F.lit(-1))  # the last match that goes
    return F.filter(items, lambda x, i: (x != value) | (i > last))


def list_positions(items: Column, value: Column, rank: int = 1, count: int = 1) -> Column:
    """LPOS: places of a value, the rank-th match first (from the tail if negative), count of them (0: all)."""
    places = F.filter(F.transform(items, lambda x, i: F.when(x == value, i)), lambda i: i.isNotNull())
    places = F.reverse(places) if rank < 0 else places
    return F.slice(places, abs(rank), F.greatest(F.size(places), F.lit(1)) if not count else F.lit(count))


def list_insert(items: Column, pivot: Column, value: Column, before: bool = True) -> Column:
    """LINSERT next to the first pivot; unchanged without one."""
    at = F.array_position(items, pivot).cast("int")
    return F.when(at == 0, items).otherwise(F.concat(F.slice(items, F.lit(1), at - (1 if before else 0)), F.array(value), F.slice(items, at + (0 if before else 1), F.size(items))))


# ---- sets ----------------------------------------------------------------------------------------------------


def members(sets: DataFrame, *keys: str) -> list[DataFrame]:
    return [sets.where(F.col("key") == k).select("member") for k in keys]


def set_inter(sets: DataFrame, keys: list[str]) -> DataFrame:
    """SINTER: one aggregation over the rows of all keys instead of a chain of joins."""
    return sets.where(F.col("key").isin(keys)).groupBy("member").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(set(keys))).select("member")


def set_union(sets: DataFrame, keys: list[str]) -> DataFrame:
    """SUNION."""
    return sets.where(F.col("key").isin(keys)).select("member").distinct()


def set_diff(sets: DataFrame, keys: list[str]) -> DataFrame:
    """SDIFF: the first key's members that no other has."""
    first = F.max((F.col("key") == keys[0]).cast("int"))
    rest = F.max(F.col("key").isin(keys[1:]).cast("int")) if len(keys) > 1 else F.lit(0)
    return sets.where(F.col("key").isin(keys)).groupBy("member").agg(first.alias("a"), rest.alias("b")).where("a = 1 and b = 0").select("member")


def inter_card(sets: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    """SINTERCARD/ZINTERCARD, up to a limit."""
    found = set_inter(sets, keys)
    return (found.limit(limit) if limit else found).agg(F.count(F.lit(1)).alias("n"))


def random_members(df: DataFrame, count: int, seed: int = 0, key: str = "key", member: str = "member") -> DataFrame:
    """SRANDMEMBER/SPOP/HRANDFIELD/ZRANDMEMBER: count seeded draws without repeats for each key."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), member), member)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count).drop("_n")


# ---- sorted sets ---------------------------------------------------------------------------------------------


def zadd(table: DataFrame, changes: DataFrame, *, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False, incr: bool = False) -> DataFrame:
    """ZADD/ZINCRBY: merge (key, member, score) by the flags."""
    c = changes.select("key", "member", F.col("score").alias("new"))
    both = table.join(c, ["key", "member"], "full_outer")
    old, new = F.col("score"), F.col("new")
    score = F.coalesce(old + new, new, old) if incr else F.coalesce(new, old)
    score = F.when(old.isNotNull() & new.isNotNull() & ((F.lit(nx)) | (F.lit(gt) & (score <= old)) | (F.lit(lt) & (score >= old))), old).otherwise(score)
    return both.where(~(F.lit(xx) & old.isNull())).select("key", "member", score.alias("score"))


def ranked(table: DataFrame, desc: bool = False) -> DataFrame:
    """ZRANK/ZREVRANK: rows with rank from 0, by score, then member."""
    order = [F.col("score").desc(), F.col("member").desc()] if desc else ["score", "member"]
    return table.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1)


def zrange(table: DataFrame, start: int, stop: int, desc: bool = False) -> DataFrame:
    """ZRANGE/ZREVRANGE by index, negative places from the end."""
    r = ranked(table, desc)
    if start < 0 or stop < 0:
        r = r.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key")))
        a, b = (F.col("_n") + x if x < 0 else F.lit(x) for x in (start, stop))
        return r.where(F.col("rank").between(a, b)).drop("_n")
    return r.where(F.col("rank").between(start, stop))


def score_between(low: str, high: str, column: str = "score") -> Column:
    """ZRANGEBYSCORE/ZCOUNT bounds: numbers, ( for exclusive, -inf and +inf."""
    c = F.col(column)
    a = c > float(low[1:]) if low.startswith("(") else c >= float(low)
    b = c < float(high[1:]) if high.startswith("(") else c <= float(high)
    return a & b


def lex_between(low: str, high: str, column: str = "member") -> Column:
    """ZLEXCOUNT/ZRANGE BYLEX bounds: [a, (a, - and +."""
    c = F.col(column)
    a = F.lit(True) if low == "-" else (F.lit(False) if low == "+" else (c > low[1:] if low[0] == "(" else c >= low[1:]))
    b = F.lit(True) if high == "+" else (F.lit(False) if high == "-" else (c < high[1:] if high[0] == "(" else c <= high[1:]))
    return a & b


def zcombine(tables: list[DataFrame], *, weights: list[float] | None = None, aggregate: str = "sum", inter: bool = False) -> DataFrame:
    """ZUNION/ZINTER over tables of (member, score), with WEIGHTS and AGGREGATE sum, min or max."""
    weights = weights or [1.0] * len(tables)
    parts = [t.select("member", (F.col("score") * w).alias("score"), F.lit(i).alias("_t")) for i, (t, w) in enumerate(zip(tables, weights, strict=True))]
    got = reduce(DataFrame.unionByName, parts).groupBy("member").agg(getattr(F, aggregate)("score").alias("score"), F.count(F.lit(1)).alias("_n"))
    return (got.where(F.col("_n") == len(tables)) if inter else got).drop("_n")


def zdiff(first: DataFrame, *rest: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select("member"), "member", "left_anti"), rest, first)


def zpop(table: DataFrame, count: int, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """ZPOPMIN/ZPOPMAX: what is taken from each key, and what stays."""
    r = ranked(table, highest)
    return r.where(F.col("rank") < count).drop("rank"), r.where(F.col("rank") >= count).drop("rank")


# ---- all or nothing


def _unless(changes: DataFrame, conflicts: DataFrame) -> DataFrame:
    n = conflicts.agg(F.count(F.lit(1)).alias("_conflicts"))  # one row
    return changes.crossJoin(F.broadcast(n)).where("_conflicts = 0").drop("_conflicts")


def _when(changes: DataFrame, needed: DataFrame) -> DataFrame:
    n = needed.agg(F.count(F.lit(1)).alias("_needed"))  # one row
    return changes.crossJoin(F.broadcast(n)).where("_needed > 0").drop("_needed")


def set_all_or_none(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """MSETNX: changes are added if none of their keys exists."""
    return table.unionByName(_unless(changes, table.join(changes.select(*keys), keys, "left_semi")))


def commit(table: DataFrame, changes: DataFrame, watched: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """WATCH and EXEC: changes are made if each watched key (with the version seen, null: missing) is still as it was."""
    now = table.select(*keys, F.col(version).alias("_now"))
    moved = watched.join(now, keys, "left").where(~F.col(version).eqNullSafe(F.col("_now")))
    return upsert(table, _unless(changes, moved), keys)


def move_member(sets: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """SMOVE: a member changes its set; nothing happens where the source lacks it."""
    it = (F.col("key") == source) & (F.col("member") == member)
    return sets.withColumn("key", F.when(it, F.lit(target)).otherwise(F.col("key"))).distinct()


def copy(table: DataFrame, source: str, target: str, replace: bool = False, key: str = "key") -> DataFrame:
    """COPY: the rows of source again under target, if it is free or replaced; a missing source changes nothing."""
    rows = table.where(F.col(key) == source).withColumn(key, F.lit(target))
    if not replace:
        return table.unionByName(_unless(rows, table.where(F.col(key) == target)))
    return rows.unionByName(table.where(F.col(key) != target)).unionByName(_unless(table.where(F.col(key) == target), rows))
