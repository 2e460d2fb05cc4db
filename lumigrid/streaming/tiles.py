"""Streams of tiles: detection per micro-batch once the scene statistics are fixed.

The batch pipeline is bounded; as an extension, tiles that arrive as files can be processed as they
come, because a tile's result needs no other tile. ``detect_stream`` takes every micro-batch's tiles
as they are; ``whole_tiles`` before it holds back tiles that arrive in pieces, over files and
micro-batches, until they are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.operators.modes import BandMode
from lumigrid.plans.detect import DetectConfig, detect_frame, points_of
from lumigrid.sources.raster import Scene


def read_tiles(spark: SparkSession, path: str, schema) -> DataFrame:
    """Tiled pixel files as a stream, one file per trigger at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def tile_pixels(tile_id: int, scene: Scene, config: DetectConfig) -> int:
    """Pixels of a tile's window, by the arithmetic of the tile grid."""
    step = config.tile - config.overlap
    across = len(range(0, max(scene.width - config.overlap, 1), step))
    return min(config.tile, scene.height - tile_id // across * step) * min(config.tile, scene.width - tile_id % across * step)


def whole_tiles(stream: DataFrame, scene: Scene, config: DetectConfig, patience_ms: int = 3_600_000) -> DataFrame:
    """The stream's pixels, a tile at a time, each once all pixels of its window have come.

    A state per tile holds what has come so far, as Arrow bytes, which the tile's size bounds; pixels
    that come twice count once. A tile that nothing was added to for ``patience_ms`` is given out as
    it is, its other pixels missing, with the next batch (a query of trigger availableNow ends only with
    spark.sql.streaming.noDataMicroBatches.enabled off). What comes for a tile that was given out is dropped. The state
    survives restarts with the query's checkpoint."""
    names = stream.columns

    def frozen(frame: pd.DataFrame) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(frame[names], preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def collect(key: tuple, pieces: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        given, held = state.get if state.exists else (False, b"")
        before = [pa.ipc.open_stream(held).read_pandas()] if held else []
        if state.hasTimedOut:
            state.update((True, b""))
            yield from before
            return
        frame = pd.concat([*before, *pieces], ignore_index=True)
        if given:
            return
        frame = frame.drop_duplicates(["tr", "tc"])
        if len(frame) >= tile_pixels(int(key[0]), scene, config):
            state.update((True, b""))
            yield frame[names]
        else:
            state.update((False, frozen(frame)))
            state.setTimeoutDuration(patience_ms)

    return stream.groupBy("tile_id").applyInPandasWithState(collect, stream.schema, "given boolean, held binary", "append", "ProcessingTimeTimeout")


def detect_stream(stream: DataFrame, scene: Scene, mode: BandMode, model, threshold: float, out: str, checkpoint: str, config: DetectConfig | None = None):
    """Start a query that appends the points of every micro-batch to ``out``. Ids run on from the
    earlier batches; a batch that is run again after a failure gets the same ones."""
    cfg = config or DetectConfig()

    def batch(frame: DataFrame, number: int) -> None:
        if frame.isEmpty():
            return
        spark = frame.sparkSession
        found = detect_frame(frame, mode, model, threshold, scene, cfg)
        points = points_of(found, scene, mode, cfg)
        # every batch that held rows has left a folder, so an absent table means the first one
        try:
            earlier = spark.read.parquet(out).where(F.col("batch") < number).count()
        except AnalysisException as why:
            if why.getCondition() != "PATH_NOT_FOUND":
                raise
            earlier = 0
        points.withColumn("id", (F.col("id") + earlier).cast("int")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
