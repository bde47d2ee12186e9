"""A streaming sink for turns: each batch is checked, split into the trace tables and appended under its own batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators.trace import trace_tables, violations


def write_turns(turns: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", event_time: str = "created_at") -> StreamingQuery:
    """Start writing a stream of turns; a request id within ``delay`` is written once, and a replayed batch overwrites only itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = trace_tables(batch.drop(event_time))
        if broken := violations(tables).take(1):
            raise ValueError(f"{broken[0]['constraint']} is broken by {broken[0]['request_id']}")
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    once = turns.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["request_id"])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
