"""Interchange formats: sparse-model text and binary files, and transforms.json. Rows are made by joins; writers put them in files."""

from __future__ import annotations

import json
import os
import shutil
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.functions.linalg import rotation, transposed
from manyview.functions.projection import centre, quaternion

#: Fixed value: the number of the pinhole model in binary files.
PINHOLE = 1
GREY = 128


def cameras_table(cameras: DataFrame, shared: bool = False) -> DataFrame:
    """(camera_id, width, height, fx, fy, cx, cy): ids from 1; one camera for each image or one for all."""
    one = cameras.orderBy("img_id").limit(1).withColumn("img_id", F.lit(0)) if shared else cameras
    return one.select((F.col("img_id") + 1).cast("int").alias("camera_id"), "width", "height", "fx", "fy", "cx", "cy")


def poses_table(cameras: DataFrame, shared: bool = False) -> DataFrame:
    """(image_id, qw, qx, qy, qz, tx, ty, tz, camera_id, name)."""
    q = [x.alias(n) for x, n in zip(quaternion(), ("qw", "qx", "qy", "qz"))]
    camera = F.lit(1) if shared else (F.col("img_id") + 1).cast("int")
    return cameras.select((F.col("img_id") + 1).cast("int").alias("image_id"), *q, "tx", "ty", "tz", camera.alias("camera_id"), F.format_string("image_%04d", "img_id").alias("name"))


def points2d(kps: DataFrame, track_obs: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, kp_id, x, y, point_id): every keypoint; -1 where its track has no point. Of several points the last counts."""
    owned = track_obs.join(points.select("track_id", "pid"), "track_id").groupBy("img_id", "kp_id").agg(F.max(F.col("pid") + 1).alias("point_id"))
    return kps.join(owned, ["img_id", "kp_id"], "left").select((F.col("img_id") + 1).cast("int").alias("image_id"), "kp_id", "x", "y", F.coalesce("point_id", F.lit(-1)).cast("long").alias("point_id"))


def points3d(points: DataFrame, track_obs: DataFrame, errors: DataFrame) -> DataFrame:
    """(point_id, x, y, z, error, track): track holds (image_id, kp_id) in order; a missing error is 0."""
    tracks = track_obs.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct((F.col("img_id") + 1).cast("int").alias("image_id"), F.col("kp_id").cast("int").alias("kp_id")))).alias("track"))
    joined = points.join(tracks, "track_id", "left").join(errors.select("track_id", "median_err"), "track_id", "left")
    return joined.select((F.col("pid") + 1).cast("long").alias("point_id"), "x", "y", "z", F.coalesce("median_err", F.lit(0.0)).alias("error"), "track")


def _lines(df: DataFrame, key: str, line) -> DataFrame:
    return df.select(F.col(key).alias("nth"), line.alias("line")).sort("nth").select("line")


def write_text(cameras: DataFrame, poses: DataFrame, spots: DataFrame, points: DataFrame, folder: str) -> None:
    """Folders cameras, images and points3D of text parts; six decimals."""
    six = lambda *names: [F.format_string("%.6f", n) for n in names]
    word = lambda *names: [F.col(n).cast("string") for n in names]
    _lines(cameras, "camera_id", F.concat_ws(" ", *word("camera_id"), F.lit("PINHOLE"), *word("width", "height"), *six("fx", "fy", "cx", "cy"))).write.mode("overwrite").text(f"{folder}/cameras")
    seen = spots.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("kp_id", F.concat_ws(" ", *six("x", "y"), *word("point_id")).alias("s")))).alias("s"))
    image = F.concat(F.concat_ws(" ", *word("image_id"), *six("qw", "qx", "qy", "qz", "tx", "ty", "tz"), *word("camera_id", "name")), F.lit("\n"), F.array_join(F.col("s.s"), " "))
    _lines(poses.join(seen, "image_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<kp_id:int,s:string>>"))), "image_id", image).write.mode("overwrite").text(f"{folder}/images")
    track = F.array_join(F.transform("track", lambda t: F.concat_ws(" ", t["image_id"].cast("string"), t["kp_id"].cast("string"))), " ")
    _lines(points, "point_id", F.concat_ws(" ", *word("point_id"), *six("x", "y", "z"), *[F.lit(str(GREY))] * 3, *six("error"), track)).write.mode("overwrite").text(f"{folder}/points3D")


def write_binary(cameras: DataFrame, poses: DataFrame, spots: DataFrame, points: DataFrame, folder: str) -> None:
    """cameras.bin, images.bin and points3D.bin, written by the driver row by row; the format wants single local files."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/cameras.bin", "wb") as out:
        out.write(struct.pack("<Q", cameras.count()))
        for r in cameras.orderBy("camera_id").toLocalIterator():
            out.write(struct.pack("<iiQQ4d", r["camera_id"], PINHOLE, r["width"], r["height"], r["fx"], r["fy"], r["cx"], r["cy"]))
    seen = spots.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("kp_id", "x", "y", "point_id"))).alias("spots"))
    with open(f"{folder}/images.bin", "wb") as out:
        out.write(struct.pack("<Q", poses.count()))
        for r in poses.join(seen, "image_id", "left").orderBy("image_id").toLocalIterator():
            out.write(struct.pack("<i7di", r["image_id"], *[r[k] for k in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], r["camera_id"]) + r["name"].encode() + b"\0")
            out.write(struct.pack("<Q", len(r["spots"] or [])))
            for s in r["spots"] or []:
                out.write(struct.pack("<ddq", s["x"], s["y"], s["point_id"]))
    with open(f"{folder}/points3D.bin", "wb") as out:
        out.write(struct.pack("<Q", points.count()))
        for r in points.orderBy("point_id").toLocalIterator():
            out.write(struct.pack("<Q3d3Bd", r["point_id"], r["x"], r["y"], r["z"], GREY, GREY, GREY, r["error"]))
            out.write(struct.pack("<Q", len(r["track"] or [])) + b"".join(struct.pack("<ii", t["image_id"], t["kp_id"]) for t in r["track"] or []))


def camera_to_world(cameras: DataFrame, flip: bool = True) -> DataFrame:
    """(img_id, m00..m23): [R' | C]; with flip, the Y and Z axes of the camera are turned."""
    turned, c = transposed(rotation()), centre()
    sign = [1.0, -1.0, -1.0] if flip else [1.0, 1.0, 1.0]
    return cameras.select("img_id", *[(turned[i][j] * sign[j] + 0.0).alias(f"m{i}{j}") for i in range(3) for j in range(3)], *[(c[i] + 0.0).alias(f"m{i}3") for i in range(3)])


def frames(cameras: DataFrame, shared: bool = False) -> DataFrame:
    """(img_id, frame): a JSON object for each image."""
    rows = cameras.join(camera_to_world(cameras), "img_id")
    matrix = F.array(*[F.array(*[F.round(f"m{i}{j}", 6) + 0.0 for j in range(4)]) for i in range(3)], F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))
    own = [] if shared else [F.col("fx").alias("fl_x"), F.col("fy").alias("fl_y"), "cx", "cy", F.col("width").alias("w"), F.col("height").alias("h"), *[F.lit(0.0).alias(k) for k in ("k1", "k2", "p1", "p2")]]
    return rows.select("img_id", F.to_json(F.struct(F.format_string("images/image_%04d", "img_id").alias("file_path"), matrix.alias("transform_matrix"), *own)).alias("frame"))


def write_transforms(cameras: DataFrame, path: str, shared: bool = False) -> None:
    """transforms.json, from a row for each image."""
    listed = [json.loads(r["frame"]) for r in frames(cameras, shared).orderBy("img_id").collect()]
    out: dict = {"camera_model": "OPENCV"}
    if shared:
        r = cameras.orderBy("img_id").first()
        out |= {"fl_x": r["fx"], "fl_y": r["fy"], "cx": r["cx"], "cy": r["cy"], "w": r["width"], "h": r["height"], "k1": 0.0, "k2": 0.0, "p1": 0.0, "p2": 0.0}
    with open(path, "w") as file:
        json.dump(out | {"frames": listed}, file, indent=2)


def export(kind: str, bundle: dict[str, DataFrame], target: str, shared: bool = False, images: list[str] | None = None) -> None:
    """Writes a reconstruction (cameras, keypoints, track_obs, points with pid, errors) in a named format.

    colmap_text, colmap (binary), gaussian (binary as well), nerfstudio, instant_ngp; `-` and spaces count as `_`. images:
    files to copy beside the model.
    """
    name = kind.lower().replace("-", "_").replace(" ", "_")
    if name in ("nerfstudio", "instant_ngp"):
        os.makedirs(target, exist_ok=True)
        write_transforms(bundle["cameras"], f"{target}/transforms.json", shared)
    elif name in ("colmap", "colmap_binary", "gaussian", "3dgs", "colmap_text"):
        parts = (cameras_table(bundle["cameras"], shared), poses_table(bundle["cameras"], shared), points2d(bundle["keypoints"], bundle["track_obs"], bundle["points"]), points3d(bundle["points"], bundle["track_obs"], bundle["errors"]))
        (write_text if name == "colmap_text" else write_binary)(*parts, target)
    else:
        raise ValueError(f"unknown format {kind!r}; there are colmap, colmap_text, gaussian, nerfstudio, instant_ngp")
    for path in images or []:
        os.makedirs(f"{target}/images", exist_ok=True)
        shutil.copy(path, f"{target}/images")
