"""Row-wise operators on unbounded tables.

Scoring, range flags and intent rules are narrow transformations, so they run
unchanged on a stream; nothing here keeps state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_rowwise(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                fmt: str = "parquet") -> StreamingQuery:
    """Apply ``transform`` to a streaming table and append to files until the input is exhausted.

    The checkpoint folder makes the append exactly-once across restarts.
    """
    if not stream.isStreaming:
        raise ValueError("a streaming table is needed")
    return (transform(stream).writeStream.format(fmt).option("path", out)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
