"""Stateful admission: fixed-window limits, spend, leases and expiring caches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """STA-01: which requests of an identifier exceed ``limit`` in their fixed window; batch or, without ranks, streaming."""
    bucket = F.floor(F.unix_timestamp("ts") / seconds)
    place = F.row_number().over(Window.partitionBy("identifier", "operation", "bucket").orderBy("ts", "event_id"))
    return events.withColumn("bucket", bucket).withColumn("place", place).select("event_id", "bucket", "place", (F.col("place") <= limit).alias("allowed"))


def streaming_counts(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """STA-01 on a stream: requests of each identifier, operation and window, with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "identifier", "operation").agg(F.count("*").alias("n")).select("identifier", "operation", F.col("window.start").alias("start"), "n")


def running_spend(events: DataFrame) -> DataFrame:
    """STA-03: spend so far in the day and, by daily sums first, over all days."""
    day = events.withColumn("day", F.to_date("ts"))
    so_far = Window.partitionBy("day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    days = day.groupBy("day").agg(F.sum("cost").alias("spent"))
    before = days.withColumn("before", F.coalesce(F.sum("spent").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("day", "before")  # one row a day
    inner = day.withColumn("day_spend", F.sum("cost").over(so_far))
    return inner.join(before, "day").select("event_id", "day_spend", (F.col("before") + F.col("day_spend")).alias("total_spend"))


def admit(events: DataFrame, seconds: int, limit: int, lease: int, slots: int, budget: int, daily: int | None = None) -> DataFrame:
    """STA-04: RATE, then BUSY, then BUDGET, else OK, for each ``identifier``; a rejected request consumes nothing.

    ``events``: ``(identifier, event_id, ts, cost)``; with ``operation`` rates count by it as well, with ``weight`` a request
    takes that many slots (else one). Spend is held against ``budget`` over all days and ``daily`` within one. Null
    identifiers are one; null costs are 0; null times come first, as second 0.

    Each decision needs all before it, so an identifier's rows pass through one task in order, a batch at a time; a task
    holds the state of one identifier: counts of the present window, at most ``slots`` leases and two sums.
    """
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in events.columns else F.lit(default)
    key = F.coalesce(F.concat(F.lit("="), F.col("identifier").cast("string")), F.lit(""))
    rows = events.select(key.alias("key"), "event_id", F.coalesce(F.unix_timestamp("ts"), F.lit(0)).alias("second"), F.coalesce("cost", F.lit(0)).alias("cost"), given("operation", "").alias("operation"), given("weight", 1).cast("long").alias("weight"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "second", "event_id")

    def run(frames):
        key = None
        for pdf in frames:
            out = []
            for k, ts, cost, operation, weight in zip(pdf.key, pdf.second, pdf.cost, pdf.operation, pdf.weight, strict=True):
                if k != key:
                    key, counts, leases, spent, today, window, day = k, {}, [], 0, 0, None, None
                if ts // seconds != window:
                    counts, window = {}, ts // seconds
                if ts // 86_400 != day:
                    today, day = 0, ts // 86_400
                leases = [x for x in leases if x[0] > ts]
                if counts.get(operation, 0) >= limit:
                    out.append("RATE")
                elif sum(w for _, w in leases) + weight > slots:
                    out.append("BUSY")
                elif spent + cost > budget or (daily is not None and today + cost > daily):
                    out.append("BUDGET")
                else:
                    counts[operation] = counts.get(operation, 0) + 1
                    leases.append((ts + lease, weight))
                    spent, today = spent + cost, today + cost
                    out.append("OK")
            yield pd.DataFrame({"event_id": pdf.event_id, "decision": out})

    return ordered.mapInPandas(run, "event_id long, decision string")


def concurrent(events: DataFrame, lease: int) -> DataFrame:
    """STA-02: the slots that leases hold when each request arrives, its own not counted, if all were admitted; ``events``: ``(event_id, second, weight)``.

    One set of leases serves everybody, so this is a running sum over all starts and ends; seconds are summed first, so the
    running sum has a row a second. Which requests a full set turns away depends on all before, in turn, and is the service's.
    """
    moves = events.select(F.col("second").alias("at"), "weight").unionByName(events.select((F.col("second") + lease).alias("at"), (-F.col("weight")).alias("weight")))
    seconds = moves.groupBy("at").agg(F.sum(F.when(F.col("weight") < 0, F.col("weight")).otherwise(0)).alias("ended"), F.sum("weight").alias("net"))
    before = F.coalesce(F.sum("net").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a second
    held = seconds.withColumn("held", before + F.col("ended")).select(F.col("at").alias("second"), "held")
    earlier = F.coalesce(F.sum("weight").over(Window.partitionBy("second").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("earlier", earlier).join(held, "second").select("event_id", (F.col("held") + F.col("earlier")).alias("held"))


def latest_valid(entries: DataFrame, probes: DataFrame, ttl_days: int = 14) -> DataFrame:
    """STA-05: each probe's newest entry of its key that was written before and hasn't expired: a union and one window."""
    both = entries.select("key", "ts", F.col("entry_id"), F.lit(None).cast("long").alias("probe_id")).unionByName(probes.select("key", "ts", F.lit(None).cast("long").alias("entry_id"), "probe_id"))
    seen = Window.partitionBy("key").orderBy("ts", F.col("probe_id").isNotNull(), "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("found", F.last(F.when(F.col("entry_id").isNotNull(), F.struct("entry_id", "ts")), ignorenulls=True).over(seen))
    fresh = F.when(F.col("found.ts") + F.make_dt_interval(F.lit(ttl_days)) > F.col("ts"), F.col("found.entry_id"))
    return last.filter("probe_id IS NOT NULL").select("probe_id", fresh.alias("entry_id"))
