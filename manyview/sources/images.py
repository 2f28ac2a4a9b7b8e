"""Image files: listing, PPM and PGM pixels, masks as runs, contours and simple features. Each image is one row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyview.functions.text import stem

#: Fixed value: the suffixes that count as images.
SUFFIXES = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "ppm"]


def list_images(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """(img_id, path, stem, content), numbered by file name."""
    kinds = "|".join(suffixes or SUFFIXES)
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(rf"\.({kinds})$"))
    name = F.substring_index("path", "/", -1)
    number = F.row_number().over(Window.orderBy(name)) - 1
    ids = files.select("path").select("path", number.cast("int").alias("img_id"))  # names only: the pixels aren't sorted
    return files.select("path", "content").join(ids, "path").select("img_id", "path", stem(F.col("path")).alias("stem"), "content")


def pixels(content: bytes) -> np.ndarray:
    """Height x width x channels of a binary PPM (P6) or PGM (P5)."""
    head = re.match(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", content)
    if not head or int(head[4]) > 255:
        raise ValueError("neither a P5 nor a P6 file of 8 bits")
    width, height, channels = int(head[2]), int(head[3]), 3 if head[1] == b"P6" else 1
    return np.frombuffer(content, np.uint8, width * height * channels, head.end()).reshape(height, width, channels)


def shrunk(image: np.ndarray, most: int) -> np.ndarray:
    """At most `most` on the longer side, by area averages; never enlarged."""
    height, width = image.shape[:2]
    scale = most / max(height, width)
    if scale >= 1:
        return image
    size = (int(np.rint(height * scale)), int(np.rint(width * scale)))

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        low, high = np.maximum(edges[:-1, None], np.arange(old)), np.minimum(edges[1:, None], np.arange(old) + 1)
        w = np.maximum(high - low, 0)
        return w / w.sum(axis=1, keepdims=True)

    out = np.einsum("ih,hwc,jw->ijc", weights(height, size[0]), image.astype(float), weights(width, size[1]), optimize=True)
    return np.rint(out).astype(np.uint8)


def _per_image(files: DataFrame, make, schema: str, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for img, content in zip(batch["img_id"], batch["content"]):
                yield pd.DataFrame([(img, *row) for row in make(pixels(bytes(content)))], columns=columns)

    return files.select("img_id", "content").mapInPandas(run, schema)


def gray(image: np.ndarray) -> np.ndarray:
    return image[..., 0].astype(float) if image.shape[2] == 1 else image @ np.array([0.299, 0.587, 0.114])


def sizes(files: DataFrame) -> DataFrame:
    return _per_image(files, lambda p: [p.shape[:2]], "img_id int, height int, width int", ["img_id", "height", "width"])


def mask_runs(files: DataFrame, object_is_dark: bool = True, grow: int = 7) -> DataFrame:
    """(img_id, v, u0, u1): runs of object pixels, widened by `grow` in each direction."""

    def make(image: np.ndarray) -> list[tuple[int, int, int]]:
        on = (image[..., 0] < 128) if object_is_dark else (image[..., 0] > 127)
        for axis in (0, 1):
            padded = np.pad(on, [(grow, grow) if a == axis else (0, 0) for a in (0, 1)])
            on = np.lib.stride_tricks.sliding_window_view(padded, 2 * grow + 1, axis=axis).any(axis=-1)
        edges = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        rows, starts = np.nonzero(edges == 1)
        ends = np.nonzero(edges == -1)[1] - 1
        return list(zip(rows.tolist(), starts.tolist(), ends.tolist()))

    return _per_image(files, make, "img_id int, v int, u0 int, u1 int", ["img_id", "v", "u0", "u1"])


def border(on: np.ndarray) -> list[tuple[int, int]]:
    """(x, y) along the outer border of the first object in reading order, by Moore tracing."""
    ys, xs = np.nonzero(on)
    if not len(ys):
        return []
    on = np.pad(on, 1)
    start = (int(ys[0]) + 1, int(xs[0]) + 1)
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    at, back, out, first = start, 0, [], None
    while True:
        out.append((at[1] - 1, at[0] - 1))
        for k in range(1, 9):
            way = (back + k) % 8
            nxt = (at[0] + around[way][0], at[1] + around[way][1])
            if on[nxt]:
                break
        else:
            return out
        if first is None:
            first = (at, nxt)
        elif (at, nxt) == first:
            return out[:-1]
        at, back = nxt, (way + 5) % 8


def objects(on: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """The 8-connected objects of a mask, each as a mask of its bounding box and the box's first row and column; by runs of rows."""
    edges = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]  # past the last
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = np.searchsorted(rows, np.arange(on.shape[0] + 1))
    for y in range(1, on.shape[0]):
        above, here = first[y - 1], first[y]
        while above < first[y] and here < first[y + 1]:
            if starts[above] <= ends[here] and starts[here] <= ends[above]:
                parent[root(int(above))] = root(int(here))
            if ends[above] < ends[here]:
                above += 1
            else:
                here += 1
    label = np.array([root(k) for k in range(len(rows))], int)
    out = []
    for one in np.unique(label):
        runs = np.flatnonzero(label == one)
        top, left = int(rows[runs].min()), int(starts[runs].min())
        mask = np.zeros((int(rows[runs].max()) - top + 1, int(ends[runs].max()) - left), bool)
        for k in runs.tolist():
            mask[rows[k] - top, starts[k] - left : ends[k] - left] = True
        out.append((mask, top, left))
    return out


def largest_border(on: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The outer border of the object whose border encloses the most, if it has `least` points; else nothing."""

    def enclosed(line: list[tuple[int, int]]) -> float:
        x, y = np.array(line, float).T
        return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2

    found = [[(x + left, y + top) for x, y in border(mask)] for mask, top, left in objects(on) if 2 * sum(mask.shape) >= least / 2]
    line = max(found, key=lambda b: (enclosed(b), len(b)), default=[])
    return line if len(line) >= least else []


def contours(files: DataFrame, samples: int = 150, least: int = 50, polarity: str = "shorter") -> DataFrame:
    """(img_id, idx, x, y): up to `samples` points along the border of the largest dark or bright object with `least` border points;
    polarity: dark, bright, or the one with the shorter border."""
    kinds = {"dark": [True], "bright": [False], "shorter": [True, False]}[polarity]

    def make(image: np.ndarray) -> list[tuple[int, float, float]]:
        dark = image[..., 0] < 128
        found = [b for kind in kinds if (b := largest_border(dark if kind else ~dark, least))]
        if not found:
            return []
        line = min(found, key=len)
        picks = np.linspace(0, len(line) - 1, min(samples, len(line))).astype(int)
        return [(k, float(line[i][0]), float(line[i][1])) for k, i in enumerate(picks)]

    return _per_image(files, make, "img_id int, idx int, x double, y double", ["img_id", "idx", "x", "y"])


def contour_features(contours_: DataFrame) -> DataFrame:
    """(img_id, kp_id, x, y, desc): contour points as keypoints, without descriptors."""
    return contours_.select("img_id", F.col("idx").alias("kp_id"), "x", "y", F.lit(None).cast("array<double>").alias("desc"))


def _blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], "edge")
        image = np.lib.stride_tricks.sliding_window_view(padded, len(kernel), axis=axis) @ kernel
    return image


def _described(base: np.ndarray, contrast: float, sigma: float) -> list[tuple[float, float, float, list[float]]]:
    """(strength, x, y, descriptor) of the extrema of one octave. The 4 x 4 cells of 8 gradient directions are turned to the
    strongest direction around the point."""
    stack = np.stack([_blurred(base, sigma * 2 ** (k / 3)) for k in range(5)])
    dog = np.diff(stack, axis=0)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(dog, 1, "edge"), (3, 3, 3))
    strong = (np.abs(dog) > contrast / 3) & ((dog >= around.max(axis=(-3, -2, -1))) | (dog <= around.min(axis=(-3, -2, -1))))
    layers, ys, xs = np.nonzero(strong[1:3])
    inside = (ys >= 8) & (ys < base.shape[0] - 8) & (xs >= 8) & (xs < base.shape[1] - 8)
    layers, ys, xs = layers[inside], ys[inside], xs[inside]
    strength = np.abs(dog[layers + 1, ys, xs])
    order = np.argsort(-strength, kind="stable")
    _, once = np.unique(ys[order] * base.shape[1] + xs[order], return_index=True)
    order = order[np.sort(once)]
    gy, gx = np.gradient(stack[1])
    size, turn = np.hypot(gx, gy), np.arctan2(gy, gx) / (2 * np.pi)
    offset = np.arange(-8, 8)
    out = []
    for low in range(0, len(order), 2_000):
        at = order[low : low + 2_000]
        y, x = ys[at][:, None, None] + offset[:, None], xs[at][:, None, None] + offset[None, :]
        near, way = size[y, x], turn[y, x]
        n = np.arange(len(at))[:, None, None]
        peaks = np.bincount((n * 36 + (way * 36).astype(int) % 36).ravel(), near.ravel(), 36 * len(at)).reshape(-1, 36).argmax(axis=1) / 36
        dy, dx = np.meshgrid(offset + 0.5, offset + 0.5, indexing="ij")
        c, s = np.cos(2 * np.pi * peaks)[:, None, None], np.sin(2 * np.pi * peaks)[:, None, None]
        cell_x, cell_y = (np.clip(((v + 8) // 4).astype(int), 0, 3) for v in (c * dx + s * dy, c * dy - s * dx))
        cell = (n * 16 + cell_y * 4 + cell_x) * 8 + (((way - peaks[:, None, None]) % 1) * 8).astype(int) % 8
        desc = np.bincount(cell.ravel(), near.ravel(), 128 * len(at)).reshape(-1, 128)
        desc = np.minimum(desc / (np.linalg.norm(desc, axis=1, keepdims=True) + 1e-12), 0.2)
        desc /= np.linalg.norm(desc, axis=1, keepdims=True) + 1e-12
        out += list(zip(strength[at].tolist(), xs[at].astype(float).tolist(), ys[at].astype(float).tolist(), desc.tolist()))
    return out


def features(files: DataFrame, contrast: float = 0.04, sigma: float = 1.6, most: int = 0, octaves: int = 4) -> DataFrame:
    """(img_id, kp_id, x, y, desc): extrema of differences of Gaussians over octaves, each of half the size of the one before, the
    strongest first; all of them, or the `most` strongest where that is given."""

    def make(image: np.ndarray) -> list[tuple[int, float, float, list[float]]]:
        base, found = gray(image) / 255, []
        for octave in range(octaves):
            if min(base.shape) < 20:
                break
            found += [(w, x * 2**octave, y * 2**octave, d) for w, x, y, d in _described(base, contrast, sigma)]
            base = _blurred(base, 2 * sigma)[::2, ::2]
        found.sort(key=lambda f: -f[0])
        return [(k, x, y, d) for k, (_, x, y, d) in enumerate(found[:most] if most else found)]

    return _per_image(files, make, "img_id int, kp_id int, x double, y double, desc array<double>", ["img_id", "kp_id", "x", "y", "desc"])
