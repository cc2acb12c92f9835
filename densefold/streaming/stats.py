"""Running totals per label over a stream of tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from densefold.plans import stats
from densefold.plans.compress import compress


def running_totals(blobs: DataFrame) -> DataFrame:
    """(label, calls, input_bytes, output_bytes, saved, pct) of a streaming DataFrame of blobs; state is one row per label."""
    return stats.by_label(compress(blobs))


def start(blobs: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Totals into a memory table, all input at hand first, then the query ends; a restart goes on from the checkpoint."""
    out = running_totals(blobs).writeStream.outputMode("complete").format("memory").queryName(name)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
