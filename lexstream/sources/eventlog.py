"""Event logs as JSON Lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "event_id long, type string, session_id string, message string, emitted_at timestamp, metrics map<string,double>"


def _without_samples(name: str, dtype: T.DataType, value: Column) -> tuple[str, Column]:
    """Sample arrays become their count; structs are handled field by field."""
    if name == "samples" and isinstance(dtype, T.ArrayType):
        return "sample_count", F.size(value)
    if isinstance(dtype, T.StructType):
        fields = [_without_samples(f.name, f.dataType, value[f.name]) for f in dtype.fields]
        return name, F.when(value.isNotNull(), F.struct(*[c.alias(n) for n, c in fields]))
    return name, value


def to_event_json(events: DataFrame) -> DataFrame:
    """One JSON text per event, audio replaced by ``sample_count``."""
    fields = [_without_samples(f.name, f.dataType, F.col(f.name)) for f in events.schema.fields]
    return events.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields])).alias("value"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    to_event_json(events).write.mode(mode).text(path)


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int | None = None) -> DataFrame:
    """The same log as a stream, at most ``files_per_trigger`` files at a time."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)
