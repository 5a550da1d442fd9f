"""Frames as a stream: one plan, made once, for every image that arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.rows import resample_images
from ..plans.plan import Scaler
from ..sources.images import IMAGE


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder that image rows are written to as Parquet."""
    return spark.readStream.schema(IMAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def resampled(frames: DataFrame, scaler: Scaler, target: tuple[int, int], layout: str, premultiply: bool = False) -> DataFrame:
    """Stateless, so any trigger and the append mode do; rows keep their order within a batch."""
    return resample_images(frames, scaler, target, layout, premultiply)


def write_frames(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every frame once, in the append mode."""
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
