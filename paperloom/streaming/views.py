"""Notes and views of use kept up to date as pages and events arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import notes
from paperloom.operators.routing import Template


def arriving(spark: SparkSession, folder: str, schema, per_trigger: int = 1000) -> DataFrame:
    """Rows of files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def notes_of(pages: DataFrame, template: Template, facts, at) -> DataFrame:
    """Pages to notes, row by row: nothing is kept between batches."""
    return notes.clip(pages, template, facts, at)


def daily(events: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """Counts per day; days are closed when events later than ``late`` can be left out."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", "1 day")).agg(F.count("*").alias("n_events")).select(F.to_date("window.start").alias("period"), "n_events")


def sessions(events: DataFrame, by: str, time: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of one user without a gap, as sessions."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.session_window("_t", gap)
    return t.groupBy(by, w).agg(F.count("*").alias("n_events")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def played(events: DataFrame, by: str, time: str, action: str, start: str = "play", stop: str = "pause") -> DataFrame:
    """Seconds played per recording so far: the time from each start to the next
    stop. State is the open start and the sum, however many events there were;
    events of a batch are taken in their order, of equal times stops first."""

    def advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since, total = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(frames)).sort_values([time, action], ascending=[True, True])
        for t, a in zip(rows[time], rows[action]):
            at = t.timestamp()
            if a == start and since is None:
                since = at
            elif a == stop and since is not None:
                total, since = total + max(0.0, at - since), None
        state.update((since, total))
        yield pd.DataFrame({by: [key[0]], "seconds": [total], "is_playing": [since is not None]})

    kind = dict(events.dtypes)[by]
    return events.select(by, time, action).groupBy(by).applyInPandasWithState(advance, f"{by} {kind}, seconds double, is_playing boolean", "since double, total double", "update", "NoTimeout")


def refreshed(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``refresh`` with what is new, to the end of what there is."""
    q = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drained(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a stream gives over what there is now, as a table in memory (for tests and views of bounded size)."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
