"""Lifetimes of file descriptors, and what was written through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spoor.scratch import materialize

#: A descriptor is a process's own.
BY_FD = ["recording_id", "pid", "fd"]


def fd_epochs(activity: DataFrame) -> DataFrame:
    """Activity with the number of the descriptor's lifetime. Opening another path or closing ends one;
    opening the same path again goes on with it."""
    order = Window.partitionBy(*BY_FD).orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = activity.where(F.col("act") != "other")
    rows = rows.withColumn("last_act", F.lag("act").over(order)).withColumn("last_path", F.last("path", ignorenulls=True).over(before))
    # A close ends the lifetime for the rows behind it; an open starts one if it is after a close or for another path.
    changes = (F.col("act") == "open") & ~F.col("path").eqNullSafe(F.col("last_path"))
    starts = F.coalesce(F.col("last_act") == "close", F.lit(True)) | changes
    return rows.withColumn("epoch", F.sum(starts.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def fd_as_of(activity: DataFrame) -> DataFrame:
    """Writes with the path that their descriptor was last opened for in its lifetime, null if it was not."""
    rows = fd_epochs(activity)
    order = Window.partitionBy(*BY_FD, "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("target", F.last("path", ignorenulls=True).over(order)).where("act = 'write'")


def write_volume(activity: DataFrame) -> DataFrame:
    """Per descriptor lifetime and path the bytes written and the time of the last write."""
    return fd_as_of(activity).groupBy(*BY_FD, "epoch", F.col("target").alias("path")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("writes"), F.max("us").alias("last_us"))


def late_events(arrivals: DataFrame, window_us: int) -> DataFrame:
    """Arrivals in order of ``arrival`` per recording with ``late``: older than one that was released before. An event is
    released when the newest so far is ``window_us`` ahead of it. Late ones stay; they are marked.

    When an event is released is looked up among the steps of the newest time, in order of time; then what
    is released is carried along in order of arrival.
    """
    c, here = F.col, ["recording_id"]
    newest = F.max("us").over(Window.partitionBy(*here).orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = arrivals.withColumn("newest", newest)
    steps = rows.select(*here, c("newest").alias("at"), F.lit(0).alias("asks"), c("arrival").alias("step"), F.lit(None).cast("long").alias("arrival"), F.lit(None).cast("long").alias("us"))
    asks = rows.select(*here, (c("us") + window_us).alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("step"), "arrival", "us")
    reached = F.min("step").over(Window.partitionBy(*here).orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    released = steps.unionByName(asks).withColumn("reached", reached).where("asks = 1 and reached is not null").select(*here, F.greatest("reached", "arrival").alias("at"), c("us").alias("released"))
    marks = released.select(*here, "at", F.lit(1).alias("order"), "released", F.lit(None).cast("long").alias("arrival"), F.lit(None).cast("long").alias("us"))
    events = arrivals.select(*here, c("arrival").alias("at"), F.lit(0).alias("order"), F.lit(None).cast("long").alias("released"), "arrival", "us")
    last = F.max("released").over(Window.partitionBy(*here).orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = marks.unionByName(events).withColumn("last", last).where("arrival is not null")
    return told.select(*here, "arrival", "us", F.coalesce(c("us") < c("last"), F.lit(False)).alias("late"))


def liveness(beats: DataFrame, limit_us: int) -> DataFrame:
    """Per recording the longest silence between two events, and whether it exceeds the limit."""
    order = Window.partitionBy("recording_id").orderBy("us", "arrival")
    rows = beats.withColumn("gap", F.col("us") - F.lag("us").over(order))
    return rows.groupBy("recording_id").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap_us"), F.count(F.lit(1)).alias("events")).withColumn("dead", F.col("longest_gap_us") > limit_us)


def event_cap(events: DataFrame, cap: int) -> DataFrame:
    """Per recording how many events lie within the cap, and whether some lie beyond it."""
    n = F.count(F.lit(1))
    return events.groupBy("recording_id").agg(F.least(n, F.lit(cap)).alias("kept"), (n > cap).alias("capped"))


#: Parts that an interval is cut into each round.
BINS = 256


def _narrowed(rows: DataFrame, open_: DataFrame, column: str) -> DataFrame:
    """``recording_id, value, need, n``: of each recording of ``open_`` (recording_id, low, high, need) the ``need``-th smallest value of the
    column between low and high, how many rows of that value still fit, and how many there are. Every round counts the rows in
    ``BINS`` parts of the interval and goes on with one of them; a recording is never sorted."""
    c, done = F.col, None
    while True:
        width = F.floor((c("high") - c("low")) / BINS).cast("long") + 1
        held = rows.join(open_.withColumn("width", width), "recording_id").where(c(column).between(c("low"), c("high")))
        counted = held.groupBy("recording_id", "low", "high", "width", "need", F.floor((c(column) - c("low")) / c("width")).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("recording_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        chosen = counted.withColumn("upto", upto).where((c("upto") >= c("need")) & (c("upto") - c("n") < c("need")))
        low = c("low") + c("bin") * c("width")
        chosen = materialize(chosen.select("recording_id", low.alias("low"), F.least("high", low + c("width") - 1).alias("high"), (c("need") - c("upto") + c("n")).alias("need"), "n"), "cap-intervals")
        found = chosen.where("low = high").select("recording_id", c("low").alias("value"), "need", "n")
        done = found if done is None else done.unionByName(found)
        open_ = chosen.where("low < high").drop("n")
        if open_.isEmpty():
            return done


def cap_places(events: DataFrame, cap: int) -> DataFrame:
    """``recording_id, last_us, last_arrival`` of the recordings that exceed the cap: the last event within it, by time and then arrival."""
    c = F.col
    least = F.coalesce(F.min("us"), F.lit(0)) - 1  # where events without a time go, first as in any order
    sizes = materialize(events.groupBy("recording_id").agg(F.count(F.lit(1)).alias("size"), least.alias("low"), F.coalesce(F.max("us"), F.lit(0)).alias("high"), F.min("arrival").alias("first"), F.max("arrival").alias("last")).where(c("size") > cap), "cap-sizes")
    rows = events.join(sizes.select("recording_id", c("low").alias("none")), "recording_id").select("recording_id", F.coalesce("us", "none").alias("us"), "arrival")
    rows = materialize(rows, "cap-events")
    times = materialize(_narrowed(rows, sizes.select("recording_id", "low", "high", F.lit(cap).cast("long").alias("need")), "us"), "cap-times")
    ties = rows.join(times.select("recording_id", c("value").alias("us")), ["recording_id", "us"])
    arrivals = _narrowed(ties, times.join(sizes, "recording_id").select("recording_id", c("first").alias("low"), c("last").alias("high"), "need"), "arrival")
    return times.join(arrivals.select("recording_id", c("value").alias("last_arrival")), "recording_id").join(sizes.select("recording_id", "low"), "recording_id").select("recording_id", c("value").alias("last_us"), "last_arrival", "low")


def capped_events(events: DataFrame, cap: int) -> DataFrame:
    """The events within the cap of their recording, in order of time and arrival, with ``is_partial`` where some were cut. Only
    recordings over the cap are looked at closely, and the cut is found by counting."""
    c = F.col
    rows = events.join(cap_places(events, cap), "recording_id", "left").withColumn("at", F.coalesce("us", "low"))
    within = c("last_us").isNull() | (c("at") < c("last_us")) | ((c("at") == c("last_us")) & (c("arrival") <= c("last_arrival")))
    return rows.where(within).select(*[c(x) for x in events.columns], c("last_us").isNotNull().alias("is_partial"))
