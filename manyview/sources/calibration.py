"""Camera files: intrinsics, projection matrices, and their pairing with images by file stem."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyview.functions.text import distortion, intrinsics, projection, stem, valid_intrinsics


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(stem, body): whole text files; of files with one stem, the last by path."""
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return rows.groupBy(stem(F.col("path")).alias("stem")).agg(F.max_by("body", "path").alias("body"))


def read_intrinsics(files: DataFrame) -> DataFrame:
    """(stem, k, dist, valid) of (stem, body)."""
    k = intrinsics(F.col("body"))
    return files.select("stem", k.alias("k"), distortion(F.col("body")).alias("dist")).withColumn("valid", valid_intrinsics(F.col("k")))


def read_projections(files: DataFrame) -> DataFrame:
    """(stem, p): twelve numbers, row by row; NULL if the file has none."""
    return files.select("stem", projection(F.col("body")).alias("p"))


def decompose(projections: DataFrame) -> DataFrame:
    """(stem, fx, fy, cx, cy, skew, r00..r22, tx, ty, tz, cx_w, cy_w, cz_w) of (stem, p): K with a positive diagonal and K22 = 1,
    a rotation, and the centre; by RQ decomposition, in Arrow batches."""
    names = ["fx", "fy", "cx", "cy", "skew", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz", "cx_w", "cy_w", "cz_w"]

    def one(p: np.ndarray) -> list[float]:
        flip = np.eye(3)[::-1]
        q, r = np.linalg.qr((flip @ p[:, :3]).T)
        k, turned = flip @ r.T @ flip, flip @ q.T
        signs = np.diag(np.where(np.diag(k) < 0, -1.0, 1.0))
        k, turned = k @ signs, signs @ turned
        centre = -np.linalg.solve(p[:, :3], p[:, 3])
        if np.linalg.det(turned) < 0:
            turned = -turned
        k = k / k[2, 2]
        return [k[0, 0], k[1, 1], k[0, 2], k[1, 2], k[0, 1], *turned.ravel(), *(-turned @ centre), *centre]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[s, *one(np.array(p, float).reshape(3, 4))] for s, p in zip(batch["stem"], batch["p"])]
            yield pd.DataFrame(rows, columns=["stem", *names])

    return projections.where(F.size("p") == 12).select("stem", "p").mapInPandas(run, "stem string, " + ", ".join(f"{n} double" for n in names))


def stem_index(paths: DataFrame) -> DataFrame:
    """(stem, path) of (path): files by stem; of those with one stem, the last by path."""
    return paths.groupBy(stem(F.col("path")).alias("stem")).agg(F.max("path").alias("path"))


def read_npy(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """(stem, k, valid): 3 x 3 or 3 x 4 matrices of .npy files, the left three columns row by row, or arrays of nine numbers as they
    are; NULL for other shapes."""

    def nine(a: np.ndarray) -> list[float] | None:
        if a.size == 9:
            return a.astype(float).ravel().tolist()
        return a[:, :3].astype(float).ravel().tolist() if a.ndim == 2 and a.shape[0] == 3 and a.shape[1] >= 3 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = [np.load(io.BytesIO(x), allow_pickle=False) for x in batch["content"]]
            yield pd.DataFrame({"stem": batch["stem"], "k": pd.Series([nine(a) for a in arrays], dtype=object)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(stem(F.col("path")).alias("stem"), "content")
    return files.mapInPandas(run, "stem string, k array<double>").withColumn("valid", valid_intrinsics(F.col("k")))


def pair_with_images(images: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(both, images without a camera, cameras without an image), paired by stem; both are numbered by stem as img_id, which one
    task does, as there is a row for each image. Stems are to be unique on either side: see stem_index."""
    both = images.join(cameras, "stem").withColumn("img_id", (F.row_number().over(Window.orderBy("stem")) - 1).cast("int"))
    return both, images.join(cameras, "stem", "left_anti"), cameras.join(images, "stem", "left_anti")


def scaled(cameras: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Intrinsics after images of (width, height) old were resized to new."""
    sx, sy = new[0] / old[0], new[1] / old[1]
    return cameras.withColumns({"fx": F.col("fx") * sx, "cx": F.col("cx") * sx, "fy": F.col("fy") * sy, "cy": F.col("cy") * sy})


def guessed(images: DataFrame, degrees: float = 60.0) -> DataFrame:
    """images (img_id, height, width) with fx, fy, cx, cy for a horizontal field of view."""
    f = F.col("width") / (2 * F.tan(F.radians(F.lit(degrees)) / 2))
    return images.withColumns({"fx": f, "fy": f, "cx": F.col("width") / 2, "cy": F.col("height") / 2})
