"""Temporal tables: snapshots, as-of reads, invalidation, event streams, consumer groups, queues and change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(versions: DataFrame, at: Column | int, keys: list[str], time: str = "valid_from", value: str = "value") -> DataFrame:
    """Each key's last version at or before a time."""
    return versions.where(F.col(time) <= at).groupBy(*keys).agg(F.max_by(value, time).alias(value))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the last right value of its keys up to its time, by one sort of both sides together."""
    both = left.withColumn("_r", F.lit(1)).withColumn("_t", F.col(left_time)).withColumn(value, F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), value, F.lit(0).alias("_r")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_r").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_r = 1").drop("_r", "_t")


def validity(versions: DataFrame, keys: list[str], time: str = "valid_from") -> DataFrame:
    """valid_to of each version: where the next begins, null for the last."""
    return versions.withColumn("valid_to", F.lead(time).over(Window.partitionBy(*keys).orderBy(time)))


def invalidate(df: DataFrame, which: Column, at: Column | int) -> DataFrame:
    """TEMPORAL.INVALIDATE: close the open rows that match."""
    return df.withColumn("valid_to", F.when(which & F.col("valid_to").isNull(), F.lit(at) if isinstance(at, int) else at).otherwise(F.col("valid_to")))


def stream_range(stream: DataFrame, low: tuple[int, int] | None, high: tuple[int, int] | None, count: int | None = None, desc: bool = False) -> DataFrame:
    """XRANGE/XREVRANGE/XREAD on (id_ms, id_seq), bounds inclusive."""
    at = F.struct("id_ms", "id_seq")
    pair = lambda p: F.struct(F.lit(p[0]).cast("bigint"), F.lit(p[1]).cast("bigint"))
    out = stream if low is None else stream.where((F.col("id_ms") >= low[0]) & (at >= pair(low)))
    out = out if high is None else out.where((F.col("id_ms") <= high[0]) & (at <= pair(high)))
    out = out.orderBy(F.col("id_ms").desc(), F.col("id_seq").desc()) if desc else out.orderBy("id_ms", "id_seq")
    return out.limit(count) if count is not None else out


def trim(stream: DataFrame, maxlen: int, key: str = "key") -> DataFrame:
    """XTRIM MAXLEN: the last entries of each stream."""
    w = Window.partitionBy(key).orderBy(F.col("id_ms").desc(), F.col("id_seq").desc())
    return stream.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= maxlen).drop("_n")


def pending_summary(pel: DataFrame) -> DataFrame:
    """XPENDING: per group the count, least and greatest id, and per consumer counts."""
    return pel.groupBy("group", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min("id_ms").alias("low"), F.max("id_ms").alias("high"))


def claim(pel: DataFrame, consumer: str, min_idle: int, now: int) -> DataFrame:
    """XCLAIM/XAUTOCLAIM: idle entries change hands and count one delivery more."""
    idle = (F.lit(now) - F.col("delivered_ms")) >= min_idle
    return pel.withColumns({"consumer": F.when(idle, F.lit(consumer)).otherwise(F.col("consumer")), "deliveries": F.col("deliveries") + idle.cast("int"), "delivered_ms": F.when(idle, F.lit(now)).otherwise(F.col("delivered_ms"))})


def queue_state(pushed: DataFrame, popped: DataFrame, acked: DataFrame, max_delivery: int) -> DataFrame:
    """MQ: state of each message: acked, dead (delivered too often), pending or ready."""
    n = popped.groupBy("id").agg(F.count(F.lit(1)).alias("deliveries"))
    got = pushed.join(n, "id", "left").join(acked.select("id", F.lit(True).alias("acked")).distinct(), "id", "left")
    d = F.coalesce("deliveries", F.lit(0))
    return got.withColumn("state", F.when(F.col("acked"), "acked").when(d >= max_delivery, "dead").when(d > 0, "pending").otherwise("ready")).drop("acked")


def envelopes(log: DataFrame, keys: list[str], order: str, value: str, time: str, source: str) -> DataFrame:
    """CDC: change events with before, after, op (c, u or d), source and ts_ms, as JSON."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    e = log.withColumn("before", before)
    op = F.when(F.col(value).isNull(), "d").when(F.col("before").isNull(), "c").otherwise("u")
    return e.select(*keys, order, F.to_json(F.struct(F.col("before"), F.col(value).alias("after"), op.alias("op"), F.lit(source).alias("source"), F.col(time).alias("ts_ms"))).alias("event"))


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """PUBLISH: messages (channel, message) to subscriptions (subscriber, pattern, is_glob); a channel that fits two of a subscriber's patterns comes twice.

    Globs, of any number, are joined by their plain beginnings to each different channel, which is then held against the
    whole of them once, however many messages it has.
    """
    out = messages.join(subscriptions.where("not is_glob"), F.col("channel") == F.col("pattern")).select("subscriber", "channel", "message")
    plain = F.regexp_extract("pattern", r"^[^*?\[\\]*", 0)
    escaped = F.regexp_replace("pattern", r"([.+$(){}|]|(?<!\[)\^)", r"\\$1")
    escaped = F.regexp_replace(F.regexp_replace(escaped, r"(?<!\\)\*", r"[\\s\\S]*"), r"(?<!\\)\?", r"[\\s\\S]")
    globs = subscriptions.where("is_glob").select("subscriber", plain.alias("_begin"), F.concat(F.lit("^"), escaped, F.lit("$")).alias("_whole"))
    begins = F.transform(F.sequence(F.lit(0), F.length("channel")), lambda n: F.substr("channel", F.lit(1), n))
    channels = messages.select("channel").where(F.col("channel").isNotNull()).distinct().withColumn("_begin", F.explode(begins))
    hit = channels.join(globs, "_begin").where("channel rlike _whole").select("channel", "subscriber")
    return out.unionByName(messages.join(hit, "channel").select("subscriber", "channel", "message"))


def read_changes(events: DataFrame, from_lsn: int, count: int = 256, order: str = "lsn") -> DataFrame:
    """CDC.READ: the next events from a place in the log on."""
    return events.where(F.col(order) >= from_lsn).orderBy(order).limit(min(count, 10_000))


def trim_before(stream: DataFrame, low: tuple[int, int]) -> DataFrame:
    """XTRIM MINID: entries from an id on."""
    return stream.where((F.col("id_ms") > low[0]) | ((F.col("id_ms") == low[0]) & (F.col("id_seq") >= low[1])))


def pending_range(pel: DataFrame, low: int, high: int, count: int, *, idle: int = 0, now: int = 0, consumer: str | None = None) -> DataFrame:
    """XPENDING with a range: entries by id, with their idle time and deliveries."""
    rows = pel.withColumn("idle", F.lit(now) - F.col("delivered_ms")).where(F.col("id_ms").between(low, high) & (F.col("idle") >= idle))
    rows = rows if consumer is None else rows.where(F.col("consumer") == consumer)
    return rows.select("id_ms", "consumer", "idle", "deliveries").orderBy("id_ms").limit(count)


def deliver(stream: DataFrame, groups: DataFrame, pel: DataFrame, consumer: str, now: int, count: int | None = None, key: str = "key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """XREADGROUP with >: (entries given out, pending entries after it, groups after it). groups: key, group, last_ms, last_seq."""
    new = read_group(stream, groups, key)
    if count is not None:
        w = Window.partitionBy(key, "group").orderBy("id_ms", "id_seq")
        new = new.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count).drop("_n")
    added = new.select(key, "group", "id_ms", "id_seq", F.lit(consumer).alias("consumer"), F.lit(now).cast("long").alias("delivered_ms"), F.lit(1).alias("deliveries"))
    last = new.groupBy(key, "group").agg(F.max(F.struct("id_ms", "id_seq")).alias("_last"))
    moved = groups.join(last, [key, "group"], "left").select(key, "group", F.coalesce("_last.id_ms", "last_ms").alias("last_ms"), F.coalesce("_last.id_seq", "last_seq").alias("last_seq"))
    return new, pel.unionByName(added), moved


def history(stream: DataFrame, pel: DataFrame, consumer: str, after: int, key: str = "key") -> DataFrame:
    """XREADGROUP with an id: the consumer's own pending entries after it."""
    mine = pel.where((F.col("consumer") == consumer) & (F.col("id_ms") > after)).select(key, "group", "id_ms", "id_seq")
    return stream.join(mine, [key, "id_ms", "id_seq"])


def group_info(groups: DataFrame, pel: DataFrame, key: str = "key") -> DataFrame:
    """XINFO GROUPS: each group's consumers, pending entries and last id."""
    n = pel.groupBy(key, "group").agg(F.count_distinct("consumer").alias("consumers"), F.count(F.lit(1)).alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return groups.join(n, [key, "group"], "left").select(key, "group", zero("consumers"), zero("pending"), "last_ms", "last_seq")


def queue_pop(queue: DataFrame, count: int, max_delivery: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MQ POP: (messages given out, dead letters, queue after it). queue: id, deliveries, claimed.

    The first count messages that nobody holds are claimed; those delivered max_delivery times already go to the dead letters.
    """
    first = queue.where("not claimed").orderBy("id").limit(count)
    dead = first.where((F.lit(max_delivery) > 0) & (F.col("deliveries") >= max_delivery))
    given = first.join(dead.select("id"), "id", "left_anti").select("id", (F.col("deliveries") + 1).alias("deliveries"))
    held = queue.join(dead.select("id"), "id", "left_anti").join(given.select("id", F.col("deliveries").alias("_now")), "id", "left")
    return given, dead.select("id", "deliveries"), held.select("id", F.coalesce("_now", "deliveries").alias("deliveries"), (F.col("claimed") | F.col("_now").isNotNull()).alias("claimed"))


def debounced(events: DataFrame, window_ms: int, key: str = "key", at: str = "at_ms") -> DataFrame:
    """MQ TRIGGER: the first event of each burst, a run of events of which none comes later than window_ms after the one before."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    return events.withColumn("_gap", F.col(at) - before).where(F.col("_gap").isNull() | (F.col("_gap") > window_ms)).drop("_gap")


def visible(versions: DataFrame, snapshot: int, txn: int | None = None, committed: DataFrame | None = None) -> DataFrame:
    """Rows (insert_lsn, delete_lsn, txn_id) that a snapshot sees: inserted by then by a committed transaction, or by its own, and not deleted."""
    rows = versions if committed is None else versions.join(F.broadcast(committed.select("txn_id", F.lit(True).alias("_done"))), "txn_id", "left")
    done = F.lit(True) if committed is None else F.col("_done").isNotNull() | (F.col("txn_id") == 0)
    own = F.lit(False) if txn is None else F.col("txn_id") == txn
    seen = (own | (done & (F.col("insert_lsn") <= snapshot))) & ((F.col("delete_lsn") == 0) | (F.col("delete_lsn") > snapshot))
    return rows.where(seen).select(*versions.columns)


def undo(table: DataFrame, log: DataFrame, txn: int, keys: list[str], value: str = "value") -> DataFrame:
    """TXN ABORT: keys that a transaction wrote get back what they held before its first write; log: keys, order, txn_id, before (null: missing)."""
    first = log.where(F.col("txn_id") == txn).groupBy(*keys).agg(F.min_by(F.struct("before"), "order")["before"].alias(value))
    return table.join(first.select(*keys), keys, "left_anti").unionByName(first.where(F.col(value).isNotNull()))


def append(stream: DataFrame, entries: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """XADD with automatic ids: entries (key, id_ms, order) get the next id_seq of their millisecond."""
    last = stream.groupBy(key, "id_ms").agg(F.max("id_seq").alias("_last"))
    n = F.row_number().over(Window.partitionBy(key, "id_ms").orderBy(order)).cast("long")
    new = entries.withColumn("id_seq", n - 1).join(last, [key, "id_ms"], "left")
    return stream.unionByName(new.withColumn("id_seq", F.col("id_seq") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last", order))


def read_group(stream: DataFrame, groups: DataFrame, key: str = "key") -> DataFrame:
    """XREADGROUP with >: entries after the last id (last_ms, last_seq) a group was given. groups: key, group, last id."""
    got = stream.join(groups, key)
    return got.where(F.struct("id_ms", "id_seq") > F.struct("last_ms", "last_seq")).drop("last_ms", "last_seq")


def stream_info(stream: DataFrame, key: str = "key") -> DataFrame:
    """XLEN and XINFO STREAM: the number of entries, first and last id."""
    at = F.struct("id_ms", "id_seq")
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("length"), F.min(at).alias("first"), F.max(at).alias("last"))
