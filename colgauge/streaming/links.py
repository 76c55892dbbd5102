"""Event streams linked to model rows and summed to closed periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from colgauge.functions.scalars import col
from colgauge.operators.aggregate import PERIOD_END, period_end
from colgauge.operators.linkage import before_as_of
from colgauge.session import scratch_path


def read_event_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a stream of events, be it a folder of files or a single one.

    The path is given as a pattern: a plain path has to be a folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    whole = path.rstrip("/")
    return reader.parquet(f"{whole[:-1]}[{whole[-1]}]")


def stream_link(
    events: DataFrame, ids: DataFrame, *, key: str, time: str, id_col: str = "id", as_of: str = "as_of", rule: str = "strict"
) -> DataFrame:
    """Events as they arrive, joined to a static table of ids before their as-of dates.

    A link looks at one event at a time, so the rows of all batches together are the
    rows of the batch link.
    """
    base = ids.select(col(id_col), col(as_of), col(key))
    return events.join(base, key, "inner").filter(before_as_of(time, as_of, rule))


def stream_period_agg(
    events: DataFrame, key: str | Sequence[str], time: str, period: str, aggregates: Sequence[Column], delay: str = "1 day"
) -> DataFrame:
    """One row per key and period, given out once the period is closed.

    The watermark follows period_end itself: a period is final when an event of a
    period more than ``delay`` later has been seen, and what comes for it after that
    is dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    dated = events.filter(col(time).isNotNull()).withColumn(PERIOD_END, period_end(time, period).cast("timestamp"))
    return dated.withWatermark(PERIOD_END, delay).groupBy(*keys, PERIOD_END).agg(*aggregates)


def run_to_folder(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all there is now, into the shared folder, and reads what it wrote."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    running = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
