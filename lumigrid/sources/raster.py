"""Sources and sinks: scenes as pixel tables, points, stands, heights, models, and results."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.functions.pixel import Affine, is_valid
from lumigrid.operators.modes import GSD, Manifest

POINT_COLUMNS = ("id", "x", "y", "p", "p_mean", "p_object", "area_m2", "n_adaptels", "in_stands", "height_m", "edge_px", "tile", "mode", "model")


@dataclass(frozen=True)
class Scene:
    """What a raster file's header holds. bands are the names of the pixel table's band columns."""

    height: int
    width: int
    bands: tuple[str, ...]
    a: float = GSD
    c: float = 0.0
    e: float = -GSD
    f: float = 0.0
    nodata: float | None = 0.0
    crs: str = ""
    striped: bool = False

    @property
    def affine(self) -> Affine:
        return Affine(self.a, self.c, self.e, self.f)


def scene_from_array(spark: SparkSession, array: np.ndarray, **header) -> tuple[Scene, DataFrame]:
    """A scene from (bands, rows, cols); for tests and small rasters."""
    import pandas as pd

    n, h, w = array.shape
    scene = Scene(h, w, tuple(f"b{k + 1}" for k in range(n)), **header)
    rr, cc = np.mgrid[0:h, 0:w]
    frame = pd.DataFrame({"r": rr.ravel().astype("int32"), "c": cc.ravel().astype("int32")} | {b: array[k].ravel().astype("float64") for k, b in enumerate(scene.bands)})
    return scene, spark.createDataFrame(frame)


def write_scene(scene: Scene, pixels: DataFrame, path: str, stripe: int = 256) -> None:
    """Pixels as Parquet sorted by (row, column) in row stripes, so that windows prune row groups,
    and the header beside them."""
    spark = pixels.sparkSession
    pixels.repartitionByRange(max(1, -(-scene.height // stripe)), "r").sortWithinPartitions("r", "c").write.mode("overwrite").parquet(f"{path}/pixels")
    spark.createDataFrame([(json.dumps(asdict(scene)),)], "header string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_scene(spark: SparkSession, path: str) -> tuple[Scene, DataFrame]:
    header = json.loads(spark.read.text(f"{path}/header").first()[0])
    return Scene(**(header | {"bands": tuple(header["bands"])})), spark.read.parquet(f"{path}/pixels")


def geotiff_scene(spark: SparkSession, path: str) -> tuple[Scene, DataFrame]:
    """A GeoTIFF as a pixel table, through the ``geotiff`` data source; through rasterio, where that
    is installed, if the file is of a kind that the source doesn't cover. Tasks read the blocks."""
    from lumigrid.sources.geotiff import read_geotiff

    try:
        return read_geotiff(spark, path)
    except ValueError as unread:
        try:
            import rasterio
        except ImportError as why:
            raise RuntimeError(f"{unread}; reading it takes rasterio") from why
    with rasterio.open(path) as src:
        scene = Scene(src.height, src.width, tuple(f"b{k + 1}" for k in range(src.count)), src.transform.a, src.transform.c, src.transform.e, src.transform.f, 0.0 if src.nodata is None else src.nodata, str(src.crs), src.block_shapes[0][1] == src.width)
        windows = [(w.row_off, w.col_off, w.height, w.width) for _, w in src.block_windows(1)]

    def run(frames):
        import pandas as pd
        import rasterio
        from rasterio.windows import Window

        with rasterio.open(path) as src:
            for frame in frames:
                for r0, c0, h, w in frame.itertuples(index=False):
                    data = src.read(window=Window(c0, r0, w, h)).astype("float64")
                    rr, cc = np.mgrid[r0 : r0 + h, c0 : c0 + w]
                    yield pd.DataFrame({"r": rr.ravel().astype("int32"), "c": cc.ravel().astype("int32")} | {b: data[k].ravel() for k, b in enumerate(scene.bands)})

    table = spark.createDataFrame(windows, "r0 int, c0 int, h int, w int").repartition(max(1, len(windows) // 4))
    return scene, table.mapInPandas(run, "r int, c int, " + ", ".join(f"{b} double" for b in scene.bands))


def window(pixels: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Half-open window of rows and columns; the bounds reach the Parquet scan."""
    return pixels.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))


def resample(scene: Scene, pixels: DataFrame, gsd: float = GSD, tolerance: float = 0.1) -> tuple[Scene, DataFrame]:
    """The scene on pixels of ``gsd``, bilinear, if its own differ by more than the tolerance on
    either axis. Each source pixel is sent to the target pixels that it weighs on; there they are
    summed, so no join is needed."""
    sx, sy = abs(scene.a), abs(scene.e)
    if abs(sx - gsd) <= tolerance * gsd and abs(sy - gsd) <= tolerance * gsd:
        return scene, pixels
    h, w = round(scene.height * sy / gsd), round(scene.width * sx / gsd)
    ky, kx = scene.height / h, scene.width / w

    def targets(at: str, k: float, n: int) -> F.Column:
        low, high = F.ceil((F.col(at) - 0.5) / k - 0.5), F.floor((F.col(at) + 1.5) / k - 0.5)
        low, high = F.greatest(F.lit(0), low - 1).cast("int"), F.least(F.lit(n - 1), high + 1).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def weight(at: str, to: str, k: float, n: int) -> F.Column:
        place = F.least(F.greatest((F.col(to) + 0.5) * k - 0.5, F.lit(0.0)), F.lit(n - 1.0))
        return F.greatest(F.lit(0.0), 1.0 - F.abs(place - F.col(at)))

    spread = pixels.withColumn("__r", F.explode(targets("r", ky, h))).withColumn("__c", F.explode(targets("c", kx, w)))
    spread = spread.withColumn("__w", weight("r", "__r", ky, scene.height) * weight("c", "__c", kx, scene.width)).where("__w > 0")
    missing = ~is_valid([F.col(b) for b in scene.bands], scene.nodata)
    out = spread.groupBy(F.col("__r").alias("r"), F.col("__c").alias("c")).agg(F.max(missing).alias("__bad"), *((F.sum(F.col(b) * F.col("__w")) / F.sum("__w")).alias(b) for b in scene.bands))
    hole = F.lit(float("nan") if scene.nodata is None else scene.nodata)
    out = out.select("r", "c", *(F.when(F.col("__bad"), hole).otherwise(F.col(b)).alias(b) for b in scene.bands))
    return Scene(**(asdict(scene) | {"height": h, "width": w, "a": scene.a * kx, "e": scene.e * ky, "bands": scene.bands})), out


def with_roles(pixels: DataFrame, scene: Scene, index: dict[str, int]) -> DataFrame:
    """(r, c, one column per role, valid): validity is judged on all bands, used or not."""
    return pixels.select("r", "c", *(F.col(scene.bands[k]).cast("double").alias(role) for role, k in index.items()), is_valid([F.col(b) for b in scene.bands], scene.nodata).alias("valid"))


def split_layer(path: str) -> tuple[str, str | None]:
    """Path and layer of ``path|layername=x``."""
    head, _, tail = path.partition("|")
    return head, tail.split("=", 1)[1] if tail.startswith("layername=") else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A point, stand or height table: Parquet, JSON or CSV by the path's ending; with a layer, the
    folder of that name inside."""
    head, layer = split_layer(path)
    full = f"{head}/{layer}" if layer else head
    if full.endswith(".json"):
        return spark.read.json(full)
    if full.endswith(".csv"):
        return spark.read.csv(full, header=True, inferSchema=True)
    return spark.read.parquet(full)


def write_points(points: DataFrame, path: str, layer: str = "dead_trees") -> int:
    """The point layer, replacing an earlier one; returns the number of points."""
    points.select(*POINT_COLUMNS).write.mode("overwrite").parquet(f"{path}/{layer}")
    return points.sparkSession.read.parquet(f"{path}/{layer}").count()


def write_crowns(crowns: DataFrame, path: str, layer: str = "crowns") -> int:
    """Regions in the order of their ids."""
    crowns.orderBy("adaptel_id").write.mode("overwrite").parquet(f"{path}/{layer}")
    return crowns.sparkSession.read.parquet(f"{path}/{layer}").count()


def write_raster(values: DataFrame, path: str, stripe: int = 256) -> None:
    """(r, c, value) tables such as probabilities or labels, in row stripes."""
    values.withColumn("stripe", F.floor(F.col("r") / stripe).cast("int")).repartition("stripe").sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("stripe").parquet(path)


def lab_raster(scene: Scene, pixels: DataFrame, trio: Sequence[str], index: dict[str, int]) -> DataFrame:
    """(r, c, L, a, b) of the mode's trio, null where invalid."""
    from lumigrid.functions.color import lab

    px = with_roles(pixels, scene, index)
    parts = lab(*(F.col(b) for b in trio))
    return px.select("r", "c", *(F.when(F.col("valid"), v).alias(n) for n, v in zip(("L", "a", "b"), parts, strict=True)))


class ModelStore:
    """Models and their manifest in a folder, with checksums. Nothing is downloaded."""

    def __init__(self, folder: str | None = None):
        self.folder = folder or os.environ.get("LUMIGRID_MODELS") or os.path.join(os.path.expanduser("~"), ".cache", "lumigrid")

    def manifest(self) -> Manifest:
        try:
            with open(os.path.join(self.folder, "manifest.json"), encoding="utf-8") as f:
                return Manifest(json.load(f))
        except (OSError, ValueError):
            return Manifest({})

    def path(self, key: str) -> str:
        """Path of a model file whose checksum agrees with the manifest's."""
        entry = self.manifest().entry(key)
        if not entry:
            raise KeyError(f"no model {key!r} in {self.folder}")
        full = os.path.join(self.folder, entry["path"])
        with open(full, "rb") as f:
            if entry.get("sha256") and hashlib.sha256(f.read()).hexdigest() != entry["sha256"]:
                raise OSError(f"{full} does not have the checksum of the manifest")
        return full

    def load(self, key: str) -> list[dict]:
        """A forest saved as JSON lines of nodes."""
        with open(self.path(key), encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.strip()]

    def save(self, key: str, nodes: Sequence[dict], **entry) -> None:
        """Write a forest and its manifest entry; files appear whole or not at all."""
        os.makedirs(self.folder, exist_ok=True)
        data = "".join(json.dumps(n) + "\n" for n in nodes).encode()
        content = dict(self.manifest().content)
        content.setdefault("files", {})[key] = {"path": f"{key}.json", "sha256": hashlib.sha256(data).hexdigest(), "kind": "forest"} | entry
        for name, body in ((f"{key}.json", data), ("manifest.json", json.dumps(content, indent=1).encode())):
            with open(os.path.join(self.folder, name + ".part"), "wb") as f:
                f.write(body)
            os.replace(os.path.join(self.folder, name + ".part"), os.path.join(self.folder, name))


def training_table(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """(features, y, site)."""
    return spark.read.parquet(path).select(*features, F.col("y").cast("boolean").alias("y"), F.col("site").cast("tinyint").alias("site"))
