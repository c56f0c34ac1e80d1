"""Structured streaming forms of the watcher, its progress figures and timers.

Watermarks bound the state: rows later than the watermark are dropped. All
functions take batch tables too, where they give the final answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def debounce_changes(changes: DataFrame, gap: str = "2 seconds", key: str = "root", late: str = LATE) -> DataFrame:
    """T1. ``changes(ts, <key>, path)``: bursts without a pause of ``gap`` as one change set a key."""
    w = F.session_window("ts", gap)
    out = changes.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.collect_set("path").alias("paths"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), F.array_sort("paths").alias("paths"), "n")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path of a batch; unreachable sources say nothing."""
    return changes.where("kind <> 'unreachable'").groupBy("path").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("ts"))


def sync_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """T2. Each micro-batch cut down to the last change of a path and handed to ``apply(batch, epoch)``."""
    return changes.writeStream.foreachBatch(lambda df, epoch: apply(latest_changes(df), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def catalog_state(changes: DataFrame) -> DataFrame:
    """T3. The present state of each path as changes come in, late ones in their place; update mode.

    A running maximum: two values a path are kept in Spark's own state, one row for
    each path that was ever seen, as the catalogue itself has.
    """
    last = F.struct(F.col("ts").cast("double").alias("at"), "event_id")
    said = F.when(F.col("kind") != "unreachable", last)
    rows = changes.select("path", "kind", said.alias("o"))
    return rows.groupBy("path").agg(F.coalesce(F.max_by("kind", "o"), F.lit("")).alias("kind"), F.coalesce(F.max("o")["at"], F.lit(0.0)).alias("at"))


def rate_eta(progress: DataFrame, total: int, window: str = "60 seconds", slide: str = "1 second", late: str = LATE) -> DataFrame:
    """T4. ``progress(ts, done)``: items a second in each sliding window and the seconds left; a fallen counter gives neither."""
    w = F.window("ts", window, slide)
    out = progress.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.min_by("done", "ts").alias("d0"), F.max_by("done", "ts").alias("d1"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    seconds = F.col("t1").cast("double") - F.col("t0").cast("double")
    rate = F.when((seconds > 0) & (F.col("d1") > F.col("d0")), (F.col("d1") - F.col("d0")) / seconds)
    return out.select(F.col("w.end").alias("at"), rate.alias("rate"), ((F.lit(total) - F.col("d1")) / rate).alias("eta_s"))


def throttled_progress(events: DataFrame, payload: str, every: str = "1200 milliseconds", late: str = LATE) -> DataFrame:
    """T5. The last payload of each interval."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.max_by(payload, F.struct("ts", payload)).alias(payload), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("began"), payload, "n")


def expire_after(deleted: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, waiting: str, ttl_s: int = 600, late: str = LATE):
    """T6. ``deleted(id, ts)``: each row handed to ``sink(expired, epoch)`` once its time has run out by the watermark; deleted again, it starts anew.

    The folder ``waiting`` holds by epoch the latest deletion of each id whose time
    still runs, and the latest time seen, ``late`` before which the watermark lies.
    A micro-batch joins what waited before by a running maximum. A batch
    that is repeated reads the epoch before its own and gives the same.
    """
    schema = deleted.select("id", "ts", F.lit(False).alias("over")).schema

    def one(df: DataFrame, epoch: int) -> None:
        read = df.sparkSession.read
        mark = (F.col("seen") - F.expr(f"INTERVAL {late}")).alias("mark")
        rows = df.select("id", "ts").where("ts is not null")
        seen = rows.agg(F.max("ts").alias("seen"))
        if epoch:
            old = read.schema("seen timestamp").parquet(f"{waiting}/seen/epoch={epoch - 1}")
            rows = rows.join(F.broadcast(old.select(mark)), F.coalesce(F.col("ts") > F.col("mark"), F.lit(True))).select("id", "ts")
            rows = rows.unionByName(read.schema(schema).parquet(f"{waiting}/ids/epoch={epoch - 1}").where("not over").select("id", "ts"))
            seen = seen.unionByName(old.select("seen")).agg(F.max("seen").alias("seen"))
        seen.write.mode("overwrite").parquet(f"{waiting}/seen/epoch={epoch}")
        now = read.schema("seen timestamp").parquet(f"{waiting}/seen/epoch={epoch}").select(mark)
        over = F.coalesce(F.col("ts") + F.expr(f"INTERVAL {ttl_s} SECONDS") < F.col("mark"), F.lit(False))
        last = rows.groupBy("id").agg(F.max("ts").alias("ts")).join(F.broadcast(now)).withColumn("over", over)
        last.select("id", "ts", "over").write.mode("overwrite").parquet(f"{waiting}/ids/epoch={epoch}")
        sink(read.schema(schema).parquet(f"{waiting}/ids/epoch={epoch}").where("over").select("id", "ts"), epoch)

    return deleted.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def match_arrivals(arrivals: DataFrame, pool: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, met: str, max_dist: int = 13):
    """T7. Each micro-batch of ``arrivals(id, words)`` against a pool of signatures and all that arrived before; ``sink(matches, epoch)`` takes the hits.

    The folder ``met`` is an index that grows by epoch: packed blocks of
    signatures, the pool's written once at the start, a batch's own written
    before it is matched. What was packed is only read later. A batch that is
    repeated writes over its own epoch and looks at none behind it, so it gives the
    same.
    """
    from ..operators.joins import first_match_packed, pack_signatures

    spark = arrivals.sparkSession
    schema = pack_signatures(pool.select("id", "words"), 0.0).schema
    before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{met}/epoch=-1/_SUCCESS")
    if not before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(before):
        pack_signatures(pool.select("id", "words"), -1.0).write.mode("overwrite").parquet(f"{met}/epoch=-1")

    def one(df: DataFrame, epoch: int) -> None:
        pack_signatures(df.select("id", "words"), float(epoch)).write.mode("overwrite").parquet(f"{met}/epoch={epoch}")
        read = df.sparkSession.read.schema(schema)
        known = read.parquet(*[f"{met}/epoch={e}" for e in range(-1, epoch + 1)])
        sink(first_match_packed(read.parquet(f"{met}/epoch={epoch}"), known, max_dist), epoch)

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def event_feed(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """T8. An append-only feed of (seq, kind, payload), the payload in JSON."""
    return events.select(F.col("event_id").alias("seq"), F.col(kind).alias("kind"), F.to_json(F.struct("user_id", "value")).alias("payload"))


def _retry(n: int, ttl_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, worst, last = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        ok = rows["ok"].to_numpy(bool)
        failed = np.cumsum(~ok)
        runs = failed - np.maximum.accumulate(np.where(ok, failed, -before))  # failures since the last success, or since the batches before
        now, worst = int(runs[-1]), max(worst, int(runs.max()))
        last = max(last, float(rows["at"].iloc[-1]))
        state.update((now, worst, last))
        state.setTimeoutTimestamp(int(last * 1000) + ttl_ms)
        yield pd.DataFrame([(key[0], now, worst >= n)], columns=["key", "failures", "set_aside"])

    return run


def retry_state(attempts: DataFrame, n: int = 3, ttl_s: int = 30 * 86400) -> DataFrame:
    """T9. ``attempts(key, at, seq, ok)``: present failures in a row of each key, and whether ``n`` were ever reached; update mode.

    Three numbers a key are kept, and forgotten once the watermark, ``ttl_s``
    behind the latest attempt of all, has passed the key's own last one by as much again.
    Attempts later than the watermark are dropped.
    """
    rows = attempts.where("ok is not null").withWatermark("at", f"{ttl_s} seconds").select("key", F.col("at").alias("ts"), F.col("at").cast("double").alias("at"), "seq", "ok")
    return rows.groupBy("key").applyInPandasWithState(_retry(n, 1000 * ttl_s), "key long, failures int, set_aside boolean", "run int, worst int, last double", "update", GroupStateTimeout.EventTimeTimeout)
