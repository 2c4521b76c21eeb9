"""Streaming ingest of observations into a table of series (an extension: the batch engine needs no stream).

Events are summed by series and calendar day under a watermark, so late data up to the delay correct a day before it is final. The table
keeps days: each micro-batch writes its final days to a folder of its own, which makes a replayed batch harmless. Longer periods are
summed from the days when the table is read, as the days of a month become final in different batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import periods
from ..operators.frame import S, T, V

DAILY = 366


def day_sums(events: DataFrame, *, time: str, series: str, value: str, delay: str = "1 day") -> DataFrame:
    """(__series, __t, value) of a stream (or a batch) of events, summed by calendar day; __t is the daily ordinal."""
    keyed = events.withWatermark(time, delay) if events.isStreaming else events
    sums = keyed.groupBy(F.col(series).cast("string").alias(S), F.window(time, "1 day").alias("w")).agg(F.sum(F.col(value).cast("double")).alias(V))
    return sums.select(S, periods.date_to_t(F.col("w.start"), DAILY).alias(T), V)


def upsert(table: str):
    """foreachBatch function that writes a batch's days; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return write


def start(events: DataFrame, table: str, checkpoint: str, **how) -> StreamingQuery:
    return day_sums(events, **how).writeStream.outputMode("append").foreachBatch(upsert(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, table: str, freq: int = DAILY) -> DataFrame:
    """(__series, __t, value) by periods of freq: the newest batch's sum of each day, days summed to periods."""
    days = spark.read.parquet(table).groupBy(S, T).agg(F.max_by(V, "batch").alias(V))
    if freq == DAILY:
        return days
    period = periods.date_to_t(periods.t_to_date(F.col(T), DAILY), freq)
    return days.groupBy(S, period.alias(T)).agg(F.sum(V).alias(V))
