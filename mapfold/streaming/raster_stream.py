"""Rasters of streams: weights add up, so each micro-batch adds its raster to the sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import raster


def stream_points(stream: DataFrame, view: raster.Viewport) -> DataFrame:
    """A streaming raster (px, py, weight) of a stream of points (x, y); use the complete or update output mode."""
    return raster.points_exact(stream, view)


def keep_raster(stream: DataFrame, view: raster.Viewport, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's raster under `path`, a folder per batch, so that a batch that runs again replaces its own; total_raster() sums them."""

    def add(batch: DataFrame, number: int) -> None:
        raster.points_exact(batch, view).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_raster(spark, path: str) -> DataFrame:
    return raster.merge(spark.read.parquet(path).drop("batch"))
