"""New points of a growing reconstruction. A track is a row with its views as arrays, so that the tasks of a round make, test and pass on
tracks without a shuffle; only counts come to the driver, a row for each image.

The numbers are those of `triangulate`: same sums, same null vector, same tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.functions.linalg import UPPER, adjugate4
from manyview.functions.projection import DEPTH_MULTIVIEW, DEPTH_PROJECT
from manyview.operators.triangulate import STEPS
from manyview.session import cut

TRACK = "track_id long, img array<int>, u array<double>, v array<double>"
NAMES = ["fx", "fy", "cx", "cy", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz", "cx_w", "cy_w", "cz_w"]


def listed(spots: DataFrame) -> DataFrame:
    """(track_id, img, u, v): each track with its views, in the order of the images."""
    seen = F.sort_array(F.collect_list(F.struct("img_id", "u", "v")))
    return spots.groupBy("track_id").agg(seen.alias("seen")).select("track_id", F.col("seen.img_id").alias("img"), "seen.u", "seen.v")


class Rig:
    """Cameras {image: (fx, fy, cx, cy, r00..r22, tx, ty, tz, centre)} as stacked arrays, a row for each image."""

    def __init__(self, table: dict[int, tuple[float, ...]]):
        self.images = np.array(sorted(table), np.int64)
        values = np.array([table[i] for i in self.images.tolist()], float).reshape(-1, len(NAMES))
        self.k, self.r, self.t, self.place = values[:, :4], values[:, 4:13].reshape(-1, 3, 3), values[:, 13:16], values[:, 16:]
        rows = np.concatenate([self.r, self.t[:, :, None]], 2)
        fx, fy, cx, cy = (c[:, None] for c in self.k.T)
        self.p = np.stack([fx * rows[:, 0] + cx * rows[:, 2], fy * rows[:, 1] + cy * rows[:, 2], rows[:, 2]], 1)
        r = self.r
        self.centre = np.stack([-(r[:, 0, k] * self.t[:, 0] + r[:, 1, k] * self.t[:, 1] + r[:, 2, k] * self.t[:, 2]) for k in range(3)], 1)

    def known(self, images: list[int]) -> np.ndarray:
        return np.isin(self.images, images)

    def at(self, image: int) -> int:
        return int(np.searchsorted(self.images, image))

    def distances(self, image: int) -> np.ndarray:
        """Of all cameras to one."""
        gap = self.place - self.place[self.at(image)]
        return np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2])


def rig_of(cameras: DataFrame) -> Rig:
    return Rig({r["img_id"]: tuple(r[n] for n in NAMES) for r in cameras.select("img_id", *NAMES).collect()})  # a row for each image


class Views:
    """The views of n tracks in cameras of a rig, one after another: owner (the track), camera, u, v."""

    def __init__(self, n: int, owner: np.ndarray, camera: np.ndarray, u: np.ndarray, v: np.ndarray):
        self.n, self.owner, self.camera, self.u, self.v = n, owner, camera, u, v

    @classmethod
    def of(cls, batch: pa.RecordBatch, rig: Rig) -> Views:
        lists = batch.column(1)
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        images = lists.flatten().to_numpy(zero_copy_only=False)
        camera = np.minimum(np.searchsorted(rig.images, images), len(rig.images) - 1)
        u, v = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
        there = rig.images[camera] == images
        return cls(batch.num_rows, owner[there], camera[there], u[there], v[there])

    def only(self, some: np.ndarray) -> Views:
        return Views(self.n, self.owner[some], self.camera[some], self.u[some], self.v[some])

    def of_tracks(self, some: np.ndarray) -> tuple[np.ndarray, Views]:
        """The numbers of the chosen tracks, and their views with tracks numbered anew."""
        number = np.cumsum(some) - 1
        mine = self.only(some[self.owner])
        return np.flatnonzero(some), Views(int(some.sum()), number[mine.owner], mine.camera, mine.u, mine.v)

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, values, self.n)

    def sizes(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.n)

    def medians(self, values: np.ndarray) -> np.ndarray:
        """Of each track's values; NaN where it has none."""
        ordered = values[np.lexsort((values, self.owner))]
        sizes = self.sizes()
        starts = np.cumsum(sizes) - sizes
        out, some = np.full(self.n, np.nan), sizes > 0
        low, high = (ordered[(starts + k)[some]] for k in ((sizes - 1) // 2, sizes // 2))
        out[some] = 0.5 * low + 0.5 * high
        return out


def normal_entries(rig: Rig, camera: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """The ten entries that each view adds; nothing for a view without pixels."""
    p = rig.p[camera]
    a, b = u[:, None] * p[:, 2] - p[:, 0], v[:, None] * p[:, 2] - p[:, 1]
    none = np.isnan(u) | np.isnan(v)
    return [np.where(none, 0.0, a[:, i] * a[:, j] + b[:, i] * b[:, j]) for i, j in UPPER]


def points_of(entries: list[np.ndarray]) -> np.ndarray:
    """(n, 3): the points that the null vectors of sums of `normal_entries` stand for; NaN for those at infinity."""
    with np.errstate(all="ignore"):
        trace = entries[0] + entries[1] + entries[2] + entries[3]
        m = {spot: e / trace for spot, e in zip(UPPER, entries)}
        adjugate = adjugate4([[m[min(i, j), max(i, j)] for j in range(4)] for i in range(4)])
        now = [np.full(len(trace), float(k == 3)) for k in range(4)]
        for _ in range(STEPS):
            w = [row[0] * now[0] + row[1] * now[1] + row[2] * now[2] + row[3] * now[3] for row in adjugate]
            size = np.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2] + w[3] * w[3])
            now = [x / size for x in w]
        out = np.stack([now[k] / now[3] for k in range(3)], 1)
        return np.where((np.abs(now[3]) > 1e-12)[:, None], out, np.nan)


def seen_at(x: np.ndarray, rig: Rig, camera: np.ndarray, u: np.ndarray, v: np.ndarray, least_depth: float) -> tuple[np.ndarray, np.ndarray]:
    """(depth, error) of points (n, 3) in cameras; the error is NaN for points that are not finite or not before the camera."""
    with np.errstate(all="ignore"):
        r, t, k = rig.r[camera], rig.t[camera], rig.k[camera]
        px, py, pz = (r[:, i, 0] * x[:, 0] + r[:, i, 1] * x[:, 1] + r[:, i, 2] * x[:, 2] + t[:, i] for i in range(3))
        du, dv = px / pz * k[:, 0] + k[:, 2] - u, py / pz * k[:, 1] + k[:, 3] - v
        return pz, np.where(np.isfinite(x).all(1) & (pz > least_depth), np.sqrt(du * du + dv * dv), np.nan)


def checked(views: Views, rig: Rig, most_error: float, least_views: int, slack: float = 2.0) -> np.ndarray:
    """As triangulate_checked: (n, 3), NaN for tracks without a point."""
    x = points_of([views.summed(e) for e in normal_entries(rig, views.camera, views.u, views.v)])
    depth, error = seen_at(x[views.owner], rig, views.camera, views.u, views.v, DEPTH_MULTIVIEW)
    behind = views.summed(~(depth > DEPTH_MULTIVIEW)) > 0
    some = ~np.isnan(error)
    median = views.only(some).medians(error[some])
    good = (views.sizes() >= least_views) & np.isfinite(x).all(1) & ~behind & (median <= slack * most_error)
    return np.where(good[:, None], x, np.nan)


def valid(x: np.ndarray, views: Views, rig: Rig, most_error: float, least_views: int, good_ratio: float = 0.6, mad_k: float = 3.5, cap: float = 4.0, depth_cov: float = 1.0) -> np.ndarray:
    """As validate: which points pass, over all views that they lie before."""
    depth, error = seen_at(x[views.owner], rig, views.camera, views.u, views.v, DEPTH_MULTIVIEW)
    some = (depth > DEPTH_MULTIVIEW) & ~np.isnan(error)
    views, depth, error = views.only(some), depth[some], error[some]
    n, median = views.sizes(), views.medians(error)
    mad = views.medians(np.abs(error - median[views.owner]))
    with np.errstate(all="ignore"):
        follows = np.maximum(0.75 * most_error, np.minimum(median + mad_k * 1.4826 * mad, cap * most_error))
        good = error <= np.where(n >= 3, follows, most_error)[views.owner]
        n_good = views.summed(good)
        mean = views.summed(np.where(good, depth, 0.0)) / n_good
        cov = np.sqrt(views.summed(np.where(good, (depth - mean[views.owner]) ** 2, 0.0)) / n_good) / mean
    return (n >= least_views) & (n_good >= np.maximum(np.ceil(good_ratio * n), least_views)) & ((n_good < 3) | (cov <= depth_cov))


def of_two_views(views: Views, rig: Rig, image: int, known: np.ndarray, most_error: float, least_angle: float, most_depth: float = 1e6, most_abs: float = 1e6) -> np.ndarray:
    """(n, 3): points of tracks, each of which shows `image`, from that view and the known one farthest from it, the first of equals;
    NaN where there is none or it fails a test of two_view_reasons."""
    new, out = rig.at(image), np.full((views.n, 3), np.nan)
    rank = np.empty(len(rig.images), np.int64)
    rank[np.lexsort((rig.images, -np.round(rig.distances(image), 9)))] = np.arange(len(rig.images))
    others = views.only(known[views.camera] & (views.camera != new))
    first = others.only(np.lexsort((rank[others.camera], others.owner)))
    first = first.only(np.flatnonzero(np.diff(first.owner, prepend=-1)))
    mine = views.only(views.camera == new)
    both = np.intersect1d(first.owner, mine.owner)
    i, j = (s.only(np.searchsorted(s.owner, both)) for s in (first, mine))
    x = points_of([a + b for a, b in zip(*(normal_entries(rig, s.camera, s.u, s.v) for s in (i, j)))])
    fine = np.isfinite(x).all(1) & ~(np.sqrt((x * x).sum(1)) > most_abs)
    depths, rays = [], []
    for s in (i, j):
        depth, error = seen_at(x, rig, s.camera, s.u, s.v, DEPTH_PROJECT)
        fine &= (depth > DEPTH_PROJECT) & (error <= most_error)
        depths.append(depth)
        rays.append(x - rig.centre[s.camera])
    with np.errstate(all="ignore"):
        cosine = (rays[0] * rays[1]).sum(1) / ((np.sqrt((rays[0] ** 2).sum(1)) + 1e-12) * (np.sqrt((rays[1] ** 2).sum(1)) + 1e-12))
        fine &= (np.maximum(*depths) < most_depth) & ~(np.degrees(np.arccos(np.clip(cosine, -1, 1))) < least_angle)
    out[both[fine]] = x[fine]
    return out


Made = Callable[[Views], np.ndarray]


def tried(open_: DataFrame, rig: Rig, image: int, made: Made) -> tuple[DataFrame, DataFrame, int, dict[int, int]]:
    """(new, still open, number of new ones, their views by image): the tracks that show the image, with the points (n, 3) that `made`
    gives for their views; where these are NaN, and for all other tracks, they stay open."""
    shared, new = open_.sparkSession.sparkContext.broadcast(rig), rig.at(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.full((batch.num_rows, 3), np.nan)
            if batch.num_rows:
                views = Views.of(batch, shared.value)
                wanted = np.zeros(batch.num_rows, bool)
                wanted[views.owner[views.camera == new]] = True
                if wanted.any():
                    at, some = views.of_tracks(wanted)
                    x[at] = made(some)
            points = [pa.array(x[:, k], mask=np.isnan(x[:, 0])) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *points], ["track_id", "img", "u", "v", *"xyz"])

    done = cut(open_.select("track_id", "img", "u", "v").mapInArrow(run, f"{TRACK}, x double, y double, z double"))
    fresh = cut(done.where("x is not null"))
    counts = views_by_image(fresh)
    return fresh, done.where("x is null"), counts.pop(None, 0), counts


def views_by_image(tracks: DataFrame) -> dict[int | None, int]:
    """{image: views}, and {None: tracks}."""
    rows = tracks.select(F.explode(F.concat(F.array(F.lit(None).cast("int")), "img")).alias("img_id")).groupBy("img_id").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each image
    return {r["img_id"]: r["n"] for r in rows}


def shown(tracks: DataFrame, image: int) -> DataFrame:
    """(img_id, track_id, u, v, x, y, z) of the tracks with points that show an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = np.flatnonzero(lists.flatten().to_numpy(zero_copy_only=False) == image)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[at])
            u, v = (batch.column(k).flatten().take(pa.array(at)) for k in (2, 3))
            columns = [pa.array(np.full(len(at), image, np.int32)), batch.column(0).take(owner), u, v, *(batch.column(k).take(owner) for k in (4, 5, 6))]
            yield pa.RecordBatch.from_arrays(columns, ["img_id", "track_id", "u", "v", *"xyz"])

    return tracks.select("track_id", "img", "u", "v", *"xyz").mapInArrow(run, "img_id int, track_id long, u double, v double, x double, y double, z double")
