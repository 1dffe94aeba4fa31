"""Streams of job messages: deduplication, progress, leases, pacing, batches, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grouped import per_group


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", ts: str = "ts") -> DataFrame:
    """A table's files as a stream, with ``ts`` as an instant."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn(ts, F.col(ts).cast("timestamp"))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into the shared folder, and gives the rows written.

    Results of ``complete`` and ``update`` mode are written batch by batch under the batch's
    number, so a batch that is run again after a fault replaces its own rows.
    """
    import uuid

    from ..session import work_dir

    spark = stream.sparkSession
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    # the keys of all tests and tables fit a few state partitions
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{base}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    query = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    last = rows.agg(F.max("batch").alias("b"))
    return rows.where(F.col("batch") == last.scalar()).drop("batch") if mode == "complete" else rows


def first_messages(stream: DataFrame, keys: list[str], ts: str, delay: str = "30 days") -> DataFrame:
    """The first message of each key; replays within ``delay`` are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def latest_progress(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the highest progress so far and the number of messages (X5, W13); complete or update mode."""
    return stream.groupBy(key).agg(F.max(value).alias("progress"), F.count("*").alias("messages"))


def tumbling_counts(stream: DataFrame, ts: str, width: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and keys, late rows behind the watermark dropped."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events closer than ``gap``."""
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), *keys, "n")


def leases(df: DataFrame, job: str, owner: str, ts: str, seconds: float, ident: str) -> DataFrame:
    """Rows ``(job, ident, granted)``: a request gets the lease if it is free, run out, or its owner's own."""

    def run(rows: list[dict]) -> list[tuple]:
        holder, until, out = None, None, []
        for r in rows:
            free = holder is None or r["_t"] >= until or r[owner] == holder
            if free:
                holder, until = r[owner], r["_t"] + seconds
            out.append((r[ident], free))
        return out

    kind = df.schema[ident].dataType.simpleString()
    return per_group(df.select(job, F.col(ts).cast("timestamp").cast("double").alias("_t"), ident, owner), [job], ["_t", ident], run, f"`{ident}` {kind}, granted boolean")


def deadlines(df: DataFrame, job: str, ts: str, now: str, seconds: float = 5400) -> DataFrame:
    """Per job its first and last message and whether it outran its time."""
    sec = lambda c: F.col(c).cast("timestamp").cast("double")
    per = df.groupBy(job).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    return per.withColumn("expired", F.lit(now).cast("timestamp").cast("double") - sec("first") > seconds)


def in_order(df: DataFrame, key: str, ts: str, ident: str, interval: float, width: float = 3600.0) -> DataFrame:
    """``key, ident, _t`` with ``_n``, a request's place among its key's, and ``_m``, the greatest ``_t - _n * interval`` up to it.

    Both run at two levels: over slices of ``width`` seconds, and inside each, so that no key, however hot, stands in one task.
    """
    rows = df.select(key, ident, F.col(ts).cast("timestamp").cast("double").alias("_t")).withColumn("_s", F.floor(F.col("_t") / width))
    inside = Window.partitionBy(key, "_s").orderBy("_t", ident)
    numbered = rows.withColumn("_i", F.row_number().over(inside)).withColumn("_x", F.max(F.col("_t") - F.col("_i") * interval).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    slices = numbered.groupBy(key, "_s").agg(F.count("*").alias("_k"), F.max(F.col("_t") - F.col("_i") * interval).alias("_y"))
    w = Window.partitionBy(key).orderBy("_s")
    base = slices.withColumn("_b", F.sum("_k").over(w) - F.col("_k")).withColumn("_z", F.max(F.col("_y") - F.col("_b") * interval).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select(F.col(key).alias("_key"), F.col("_s").alias("_slice"), "_b", "_z")
    both = numbered.join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_s") == F.col("_slice")))
    return both.select(key, ident, "_t", (F.col("_b") + F.col("_i")).alias("_n"), F.greatest(F.col("_x") - F.col("_b") * interval, F.col("_z")).alias("_m"))


def token_bucket(df: DataFrame, key: str, ts: str, ident: str, per_minute: float, burst: float) -> DataFrame:
    """Rows ``(key, ident, wait)``: the seconds each request waits for a token, refilled at a steady rate up to ``burst``.

    The bucket is full again at ``V``, each request putting that off by the time T of one token from ``max(V, now)``: a running maximum. A request leaves at ``V - burst * T``, or at once.
    """
    step = 60.0 / per_minute
    full = F.col("_m") + step + F.col("_n") * step
    return in_order(df, key, ts, ident, step).select(key, ident, F.bround(F.greatest(full - burst * step - F.col("_t"), F.lit(0.0)), 3).alias("wait"))


def paced(df: DataFrame, key: str, ts: str, ident: str, interval: float) -> DataFrame:
    """Rows ``(key, ident, slot)``: each request's reserved time, ``interval`` behind the last one's or later.

    The n-th request's time is the latest of all earlier arrivals plus what stands between: a running maximum of ``t - n * interval``.
    """
    return in_order(df, key, ts, ident, interval).select(key, ident, F.bround(F.col("_m") + F.col("_n") * interval, 3).alias("slot"))


def cooldowns(df: DataFrame, key: str, ts: str, failed: str, ident: str, base: float = 30, most: float = 300, reset: float = 300, retry_after: str | None = None) -> DataFrame:
    """Rows ``(key, ident, cooldown)``: the pause after each failure, doubled up to ``most``; a quiet time starts anew.

    With ``retry_after`` a failure that names its own pause (in seconds, more than 0) is given it, up to ``most``.
    """
    rows = df.select(key, ident, F.col(ts).cast("timestamp").cast("double").alias("_t"), F.coalesce(failed, F.lit(False)).alias("_f"), (F.lit(None).cast("double") if retry_after is None else F.col(retry_after).cast("double")).alias("_own"))
    w = Window.partitionBy(key).orderBy("_t", ident)
    failures = rows.where("_f").withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(w) > reset).cast("int"), F.lit(1)))
    runs = failures.withColumn("_run", F.sum("_new").over(w))
    n = F.row_number().over(Window.partitionBy(key, "_run").orderBy("_t", ident))
    pause = F.least(F.lit(float(most)), F.coalesce(F.when(F.col("_own") > 0, F.col("_own")), base * F.pow(F.lit(2.0), F.least(n - 1, F.lit(60)))))
    return runs.select(key, ident, pause.alias("cooldown")).unionByName(rows.where("not _f").select(key, ident, F.lit(0.0).alias("cooldown")))


def micro_batches(df: DataFrame, key: str, ts: str, ident: str, chars: str, count: int = 3, window: float = 0.075, budget: int = 90_000) -> DataFrame:
    """Rows ``(key, ident, batch)``: requests of a key run together until ``count``, the ``window`` in seconds or the ``budget`` of characters is full."""

    def run(rows: list[dict]) -> list[tuple]:
        n, size, used, start, out = -1, 0, 0, None, []
        for r in rows:
            c = r[chars] or 0
            if start is None or size >= count or r["_t"] - start > window or used + c > budget:
                n, size, used, start = n + 1, 0, 0, r["_t"]
            size, used = size + 1, used + c
            out.append((r[ident], n))
        return out

    kind = df.schema[ident].dataType.simpleString()
    return per_group(df.select(key, F.col(ts).cast("timestamp").cast("double").alias("_t"), ident, chars), [key], ["_t", ident], run, f"`{ident}` {kind}, batch int")


def queue_state(messages: DataFrame, actions: DataFrame, now: str, visible_after: float = 30.0) -> DataFrame:
    """Rows ``(message_id, sent_at, hidden_until, visible)``: a queue's messages after all its actions.

    ``messages`` has ``message_id, sent_at`` (a message sent twice counts from the first time); ``actions`` ``message_id, at, action, seconds``: ``receive`` and ``extend``
    hide a message for ``seconds`` (``visible_after`` if null) from their time on, ``delete`` takes it away for good. Actions on messages that
    weren't sent, or before that, change nothing. One aggregation a side, by id.
    """
    at = lambda c: F.col(c).cast("timestamp").cast("double")
    sent = messages.where("message_id is not null").groupBy("message_id").agg(F.min(at("sent_at")).alias("_sent"))
    did = actions.select("message_id", at("at").alias("_at"), "action", F.coalesce(F.col("seconds").cast("double"), F.lit(visible_after)).alias("_for"))
    after = did.join(sent, "message_id").where("_at >= _sent")
    # the last word on its visibility is that of the latest action, not the longest pause
    state = after.groupBy("message_id").agg(F.bool_or(F.col("action") == "delete").alias("_gone"), F.max(F.when(F.col("action").isin("receive", "extend"), F.struct("_at", (F.col("_at") + F.col("_for")).alias("until"))))["until"].alias("_until"))
    left = sent.join(state, "message_id", "left").where("not coalesce(_gone, false)")
    return left.select("message_id", F.col("_sent").alias("sent_at"), F.col("_until").alias("hidden_until"), F.coalesce(F.col("_until") <= F.lit(now).cast("timestamp").cast("double"), F.lit(True)).alias("visible"))


def stateful_progress(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per key and batch the monotone progress, kept in state (X5); for streams in update mode."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, n = state.get if state.exists else (float("-inf"), 0)
        for f in frames:
            best, n = max(best, float(f[value].max())), n + len(f)
        state.update((best, n))
        yield pd.DataFrame({key: [k[0]], "progress": [best], "messages": [n]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, progress double, messages bigint", "best double, n bigint", "update", "NoTimeout")
