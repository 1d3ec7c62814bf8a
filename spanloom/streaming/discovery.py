"""Documents that arrive as a stream, decided against a fixed upstream; and running counts of relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators import discovery
from spanloom.options import DiscoveryOptions


def decide_stream(units: DataFrame, up: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, o: DiscoveryOptions = DiscoveryOptions(), latin: bool = True, encoder: discovery.Encoder = discovery.hashed_grams, dimensions: int = 256) -> StreamingQuery:
    """Each micro-batch of units is profiled and decided; ``sink`` gets the decisions and the batch's number.

    ``up`` is profiled already. A batch that is tried again has the same number, so a sink that
    writes by number writes each batch once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sink(discovery.discover(discovery.profiled(rows, latin), up, o, encoder, dimensions), number)

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events of each key by tumbling window; later ones than the watermark are left out."""
    at = F.col(time).cast("timestamp")
    return events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", window), key).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), key, "events")
