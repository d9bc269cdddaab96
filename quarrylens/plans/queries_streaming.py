"""Row-wise operators on streams: the table arrives in two parts, and the second run goes on from the checkpoint of the first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.classify import classify_intent
from quarrylens.operators.health import clinical_flags
from quarrylens.plans.registry import ORACLES, query
from quarrylens.session import checkpoint_dir
from quarrylens.streaming.rowwise import run_rowwise


def streamed(t, rows: DataFrame, transform) -> DataFrame:
    """What two runs over one checkpoint have written; ``rows`` arrive in two parts, the second after the first run."""
    spark = t.spark
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64(*rows.columns), F.lit(2))
    for part in range(2):
        rows.where(half == part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        run_rowwise(stream, transform, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("stream_classify_intent", ORACLES["classify_intent"])
def _(t):
    return streamed(t, t.conversations, lambda s: classify_intent(s, "text").select("conv_id", "turn", "intent"))


@query("stream_clinical_flags", ORACLES["clinical_flags"])
def _(t):
    rows = t.events.select("event_id", "value", F.when(F.col("event_id") % 9 == 0, "high").otherwise(
        F.col("user_id").cast("string")).alias("reading"))
    return streamed(t, rows, lambda s: clinical_flags(s, {"value": {"low": 5, "high": 150}, "reading": {"high": 100}}).select(
        "event_id", "value_abnormal", "reading_abnormal"))
