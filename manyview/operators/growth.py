"""A reconstruction that grows by one image a round and is adjusted on the way.

Some thousand tracks are a row, their views and points as bytes of arrays, which jobs read as fast as they lie there. What a round does is a
function of a block and of values as long as there are images (which image, cameras, steps of an adjustment); jobs run the functions since the
last written state over again, so that the tracks are neither shuffled nor written in each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.functions.projection import DEPTH_MEDIAN
from manyview.operators import adjust, growing
from manyview.session import cut

#: Tracks of a block, about.
TRACKS = 2_000
#: Functions, and steps of an adjustment of all images, that are run over again before a state is written.
REPLAYED, STEPS = 4, 2
COLUMNS = {"ids": np.int64, "sizes": np.int32, "img": np.int32, "u": np.float64, "v": np.float64, "x": np.float64, "peak": np.float64}
SCHEMA = ", ".join(f"{c} binary" for c in COLUMNS)


@dataclass
class Block:
    """Tracks: ids, how many views each has; img, u, v of the views, track after track; x (n, 3), NaN for a track without a point; peak (n, 3)
    within an adjustment."""

    ids: np.ndarray
    sizes: np.ndarray
    img: np.ndarray
    u: np.ndarray
    v: np.ndarray
    x: np.ndarray
    peak: np.ndarray | tuple = ()

    def __post_init__(self) -> None:
        self.x, self.peak = (np.array(c, float).reshape(-1, 3) for c in (self.x, self.peak))
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)

    def row(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, c), kind).tobytes() for c, kind in COLUMNS.items()]

    def only(self, tracks: np.ndarray, views: np.ndarray) -> Block:
        """The chosen tracks with the chosen of their views."""
        views = views & tracks[self.owner]
        return Block(self.ids[tracks], np.bincount(self.owner[views], minlength=len(tracks))[tracks], self.img[views], self.u[views], self.v[views], self.x[tracks])

    def made(self) -> np.ndarray:
        return ~np.isnan(self.x[:, 0])

    def views(self, rig: growing.Rig, some: np.ndarray) -> tuple[np.ndarray, growing.Views]:
        """The chosen tracks, and their views in the cameras of a rig, with tracks numbered anew."""
        mine = some[self.owner]
        img, number = self.img[mine], np.cumsum(some) - 1
        camera = np.minimum(np.searchsorted(rig.images, img), len(rig.images) - 1)
        there = rig.images[camera] == img
        return np.flatnonzero(some), growing.Views(int(some.sum()), number[self.owner[mine]][there], camera[there], self.u[mine][there], self.v[mine][there])

    def showing(self, image: int) -> np.ndarray:
        out = np.zeros(len(self.ids), bool)
        out[self.owner[self.img == image]] = True
        return out


@dataclass(frozen=True)
class New:
    """Points for tracks that show an image and have none, from its view and the farthest known one; with least_views, only those that pass
    `valid`."""

    rig: growing.Rig
    image: int
    most_error: float
    least_angle: float
    least_views: int | None = None

    def __call__(self, block: Block) -> None:
        wanted = block.showing(self.image) & ~block.made()
        if wanted.any():
            at, views = block.views(self.rig, wanted)
            x = growing.of_two_views(views, self.rig, self.image, self.rig.known(self.rig.images), self.most_error, self.least_angle)
            if self.least_views is not None:
                x = np.where(growing.valid(x, views, self.rig, 1.5 * self.most_error, self.least_views)[:, None], x, np.nan)
            block.x[at] = x


@dataclass(frozen=True)
class Most:
    """Which tracks are among the `points_cap` with the most views: those of more than `hits`, and of as many up to an id."""

    hits: int
    last: int


@dataclass(frozen=True)
class Moved:
    """An adjustment of all points with two views or more in some images (or of the `most`): the steps (cameras, damping, delta) taken so far."""

    images: tuple[int, ...]
    place: np.ndarray
    scale: float
    loss: str
    most: Most | None = None
    steps: tuple[tuple[dict, float, np.ndarray], ...] = ()

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Which views count, and how many of them each track has."""
        mine = np.isin(block.img, self.images) & block.made()[block.owner]
        return mine, np.bincount(block.owner[mine], minlength=len(block.ids))

    def chosen(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tracks are adjusted, which views count, and how many of them each track has."""
        mine, hits = self.hits(block)
        some = hits >= 2
        if self.most is not None:
            some &= (hits > self.most.hits) | ((hits == self.most.hits) & (block.ids <= self.most.last))
        return some, mine, hits

    def reduced(self, block: Block, table: dict, damping: float) -> tuple[np.ndarray, adjust.Reduced | None]:
        """The chosen tracks and their part of the reduced system after the steps."""
        some, mine, hits = self.chosen(block)
        at = np.flatnonzero(some)
        if not len(at):
            return at, None
        mine &= some[block.owner]
        cams = adjust.Cameras(table)
        batch = adjust.Batch.of(hits[some], np.searchsorted(cams.images, block.img[mine]), np.stack([block.u[mine], block.v[mine]], 1))
        x, peak = block.x[at], block.peak[at] if len(block.peak) else np.zeros((len(at), 3))
        start = x

        def part(table_: dict, damping_: float) -> adjust.Reduced:
            return adjust.Reduced(x, batch, adjust.Cameras(table_), self.place, damping_, self.scale, self.loss, peak, start, adjust.Bounds())

        for cameras, lam, delta in self.steps:
            made = part(cameras, lam)
            x, peak = made.moved(x, delta), made.peak
        block.x[at] = x
        return at, part(table, damping)

    def __call__(self, block: Block) -> None:
        if self.steps:
            *before, (cameras, lam, delta) = self.steps
            at, made = replace(self, steps=tuple(before)).reduced(block, cameras, lam)
            block.peak = np.zeros_like(block.x)
            if made is not None:
                block.x[at], block.peak[at] = made.moved(block.x[at], delta), made.peak


def packed(spots: DataFrame) -> DataFrame:
    """Blocks of (track_id, img_id, u, v): tracks in the order of their ids, their views in that of the images, none with a point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False).astype(kind) for k, kind in enumerate((np.int64, np.int32, float, float))]
            rest = now if rest is None else [np.concatenate(two) for two in zip(rest, now)]
            starts = np.flatnonzero(np.diff(rest[0], prepend=rest[0][:1] - 1))
            if len(starts) > TRACKS:  # the last track may go on in the next batch
                yield from blocks([c[: starts[-1]] for c in rest], starts[:-1])
                rest = [c[starts[-1] :] for c in rest]
        if rest is not None and len(rest[0]):
            yield from blocks(rest, np.flatnonzero(np.diff(rest[0], prepend=rest[0][:1] - 1)))

    def blocks(columns: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts, len(columns[0]))
        for low in range(0, len(starts), TRACKS):
            mine = ends[low : low + TRACKS + 1]
            ids, img, u, v = (c[mine[0] : mine[-1]] for c in columns)
            yield _rows([Block(ids[mine[:-1] - mine[0]], np.diff(mine), img, u, v, np.full((len(mine) - 1, 3), np.nan))])

    flat = spots.select("track_id", F.col("img_id").cast("int").alias("img_id"), "u", "v")
    return flat.repartition("track_id").sortWithinPartitions("track_id", "img_id").mapInArrow(run, SCHEMA)


def _rows(blocks: list[Block]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*(b.row() for b in blocks))], list(COLUMNS))


def _blocks(batches: Iterator[pa.RecordBatch], steps: tuple[Callable[[Block], None], ...]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            block = Block(*(np.frombuffer(batch.column(k)[row].as_buffer(), kind) for k, kind in enumerate(COLUMNS.values())))
            for step in steps:
                step(block)
            yield block


class Growth:
    """Tracks as blocks: the written state, and the steps since."""

    def __init__(self, spots: DataFrame | None, base: DataFrame | None = None):
        self.base, self.steps = cut(packed(spots)) if base is None else base, ()

    def then(self, step: Callable[[Block], None]) -> None:
        self.steps += (step,)
        if len(self.steps) >= REPLAYED:
            self.write()

    def write(self, peaks: bool = False) -> None:
        def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for b in blocks:
                yield _rows([b if peaks else replace(b, peak=())])

        if self.steps:
            self.base, self.steps = cut(self.mapped(run, SCHEMA)), ()

    def taken(self, work: Moved) -> Growth:
        """The tracks that an adjustment moves, with the views that it counts."""

        def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for b in blocks:
                some, mine, _ = work.chosen(b)
                if some.any():
                    yield _rows([b.only(some, mine)])

        return Growth(None, cut(self.mapped(run, SCHEMA)))

    def mapped(self, function: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        steps = self.steps
        return self.base.mapInArrow(lambda batches: function(_blocks(batches, steps)), schema)

    def counts(self) -> tuple[int, dict[int, int]]:
        """How many tracks have points, and their views by image."""

        def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            n, views = 0, {}
            for block in blocks:
                made = block.made()
                n += int(made.sum())
                for img, k in zip(*(c.tolist() for c in np.unique(block.img[made[block.owner]], return_counts=True))):
                    views[img] = views.get(img, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([None, *views], pa.int32()), pa.array([n, *views.values()], pa.int64())], ["img_id", "n"])

        rows = self.mapped(run, "img_id int, n long").groupBy("img_id").agg(F.sum("n").alias("n")).collect()  # a row for each image
        found = {r["img_id"]: r["n"] for r in rows}
        return found.pop(None, 0), found

    def shown(self, image: int) -> DataFrame:
        """(img_id, track_id, u, v, x, y, z) of the tracks with points that show an image."""

        def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                at = np.flatnonzero((block.img == image) & block.made()[block.owner])
                if len(at):
                    track = block.owner[at]
                    columns = [np.full(len(at), image, np.int32), block.ids[track], block.u[at], block.v[at], *block.x[track].T]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["img_id", "track_id", "u", "v", *"xyz"])

        return self.mapped(run, "img_id int, track_id long, u double, v double, x double, y double, z double")

    def points(self) -> DataFrame:
        """(track_id, x, y, z) of the tracks with points."""

        def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                made = block.made()
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[made]), *(pa.array(c) for c in block.x[made].T)], ["track_id", *"xyz"])

        return self.mapped(run, "track_id long, x double, y double, z double")

    def errors(self, rig: growing.Rig, least_depth: float = DEPTH_MEDIAN) -> DataFrame:
        """(track_id, depth, err, views) of the views in a rig's cameras that points lie before; views: how many a track has of them."""

        def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                at, views = block.views(rig, block.made())
                depth, err = growing.seen_at(block.x[at][views.owner], rig, views.camera, views.u, views.v, least_depth)
                fine = (depth > least_depth) & ~np.isnan(err)
                track = views.owner[fine]
                columns = block.ids[at][track], depth[fine], err[fine], np.bincount(track, minlength=len(at))[track]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["track_id", "depth", "err", "views"])

        return self.mapped(run, "track_id long, depth double, err double, views long")

    def most(self, work: Moved, points_cap: int) -> Most | None:
        """Of the points with two views or more in the images, the points_cap with the most; ties go to the smaller id. None where all are."""

        def sizes(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                hits, n = np.unique(work.hits(block)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64()), pa.array(n, pa.int64())], ["hits", "n"])

        left = points_cap
        for r in self.mapped(sizes, "hits long, n long").where("hits >= 2").groupBy("hits").agg(F.sum("n").alias("n")).orderBy(F.desc("hits")).collect():  # a row for each number of views
            if r["n"] > left:
                level = r["hits"]

                def ids(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
                    for block in blocks:
                        yield pa.RecordBatch.from_arrays([pa.array(block.ids[work.hits(block)[1] == level])], ["track_id"])

                last = self.mapped(ids, "track_id long").orderBy("track_id").limit(left).agg(F.max("track_id")).first()[0]
                return Most(level, -1 if last is None else last)
            left -= r["n"]
        return None

    def adjust(self, cameras: dict[int, tuple[float, ...]], images: list[int], points_cap: int | None, least_points: int, least_obs: int, scale: float, loss: str, rounds: int = 5, few: int = adjust.FEW_BLOCKS) -> dict[int, tuple[float, ...]]:
        """Moves the images' cameras, all but the first two, and all points with two views or more in the images (at most points_cap, if given) to
        the least error; gives the cameras. Nothing moves if there is too little to adjust."""
        if len(images) < 2:
            return cameras
        table = {i: {"k": np.array(cameras[i][:4]), "r": np.array(cameras[i][4:13]).reshape(3, 3), "t": np.array(cameras[i][13:16])} for i in images}
        free, place = adjust.places(table, images[:2])
        n, work = len(free), Moved(tuple(images), place, scale, loss)
        if points_cap is not None:
            work = replace(work, most=self.most(work, points_cap))
        everyone = len(images) == len(cameras)
        if everyone:
            self.write()

        def reduced(state: tuple[Growth, Moved], cams: dict, lam: float) -> adjust.System:
            tracks, done = state

            def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
                return adjust.added((made for _, made in (done.reduced(b, cams, lam) for b in blocks) if made is not None), n)

            return adjust.System(tracks.mapped(run, "i int, j int, v array<double>"), n, few)

        def moved(state: tuple[Growth, Moved], cams: dict, lam: float, delta: np.ndarray) -> tuple[Growth, Moved]:
            tracks, done = state
            if everyone and len(done.steps) >= STEPS:
                tracks, done = Growth(None, tracks.base), replace(done, steps=())
                tracks.steps = (state[1],)
                tracks.write(peaks=True)
            return tracks, replace(done, steps=(*done.steps, (cams, lam, delta)))

        state = self if everyone else self.taken(work), replace(work, most=None) if not everyone else work
        first = reduced(state, table, adjust.DAMPING)
        if first.points < least_points or first.obs < least_obs:
            return cameras
        (tracks, done), table, _ = adjust.descended(state, table, free, rounds, adjust.Bounds(), reduced, moved, first)
        if everyone:
            self.base = tracks.base
        if done.steps:
            self.steps += (replace(done, most=work.most),)
            self.write()
        placed = ((i, table[i]) for i in free)
        return cameras | {i: tuple(map(float, (*c["k"], *c["r"].ravel(), *c["t"], *(-c["r"].T @ c["t"])))) for i, c in placed}
