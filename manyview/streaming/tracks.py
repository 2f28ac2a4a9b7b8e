"""Tracks kept up to date by a stream of matches.

State is three tables of files, a folder for each batch of the stream in each: `edges` (the matches that were new), `nodes` (a keypoint
and the label it got when it first came) and `roots` (a label that was the smallest node of its component, and the smallest of
the component it went into). All are partitioned by image: matches come by pairs of images, so a batch reads the partitions of
its own images only, and of those whose labels it meets. It joins the components that its matches touch, over their
labels alone, and writes what changed; no label is written again for the keypoints that carry it. A batch that is run again, after a
loss or a restart, writes its folders anew, and batches read only what is of earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.operators.graph import components
from manyview.operators.tracks import SHIFT, build, degrees
from manyview.session import cut
from manyview.streaming import MATCHES

SHAPES = {"edges": f"{MATCHES}, batch long, img_id int", "nodes": "node long, label long, batch long, img_id int", "roots": "label long, root long, batch long, img_id int"}
MOST_STEPS = 200


class TrackState:
    """The tables under one folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str, before: int | None = None, images: Iterable[int] | None = None) -> DataFrame:
        """A table's rows of batches before one, and of some images; partitions that are not wanted are not opened."""
        try:
            rows = self.spark.read.schema(SHAPES[name]).parquet(f"{self.folder}/{name}")
        except Exception as error:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], SHAPES[name])
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return rows if images is None else rows.where(F.col("img_id").isin([*images]))

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy("img_id").parquet(f"{self.folder}/{name}/batch={batch}")

    @staticmethod
    def image(node: str):
        return F.floor(F.col(node) / SHIFT).cast("int")

    def images_of(self, df: DataFrame, node: str) -> list[int]:
        return [r[0] for r in df.select(self.image(node)).distinct().collect()]  # a row for each image

    def rooted(self, labels: DataFrame, before: int | None, all_images: bool = False) -> DataFrame:
        """(label, root): each label followed to the end of its chain, which a merge makes longer by one."""
        now = cut(labels.select("label", F.col("label").alias("root")))
        for _ in range(MOST_STEPS):
            images = None if all_images else self.images_of(now, "root")
            steps = self.read("roots", before, images).groupBy("label").agg(F.min("root").alias("next")).withColumnRenamed("label", "at")
            further = cut(now.join(steps, F.col("root") == F.col("at"), "left").select("label", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
            now = further.select("label", "root")
            if further.where("went").isEmpty():
                return now
        raise RuntimeError(f"chains of labels have more than {MOST_STEPS} steps")

    def add(self, matches: DataFrame, batch: int) -> None:
        """Takes in a batch of matches (i, j, a, b)."""
        came = cut(matches.select("i", "j", "a", "b").distinct())
        images = [r[0] for r in came.select(F.explode(F.array("i", "j"))).distinct().collect()]  # a row for each image
        fresh = cut(came.join(self.read("edges", batch, images).select("i", "j", "a", "b"), ["i", "j", "a", "b"], "left_anti"))
        self.write("edges", fresh.withColumn("img_id", F.col("i")), batch)
        links = fresh.select(*[(F.col(i).cast("long") * SHIFT + F.col(a).cast("long")).alias(x) for x, i, a in (("u", "i", "a"), ("v", "j", "b"))])
        ends = cut(links.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        labels = ends.join(self.read("nodes", batch, images).select("node", "label"), "node", "left")
        known = cut(labels.where("label is not null"))
        roots = self.rooted(known.select("label").distinct(), batch)
        placed = cut(labels.join(roots, "label", "left").select("node", F.coalesce("root", "node").alias("at"), F.col("root").isNull().alias("new")))
        of = {x: placed.select(F.col("node").alias(x), F.col("at").alias(f"{x}_at")) for x in "uv"}
        met = links.join(of["u"], "u").join(of["v"], "v").select(F.col("u_at").alias("a"), F.col("v_at").alias("b")).where("a <> b")
        joined = components(met).withColumnRenamed("node", "at")
        told = placed.join(joined, "at", "left").select("node", "at", "new", F.coalesce("label", "at").alias("label"))
        self.write("nodes", told.where("new").select("node", "label", self.image("node").alias("img_id")), batch)
        changed = joined.where(F.col("at") != F.col("label")).join(placed.where("not new").select("at").distinct(), "at", "left_semi")
        self.write("roots", changed.select(F.col("at").alias("label"), F.col("label").alias("root"), self.image("at").alias("img_id")), batch)

    def labelled(self) -> DataFrame:
        """(img_id, kp_id, degree, label) of all keypoints so far, as tracks.labelled has them for all matches at once."""
        nodes = self.read("nodes").select("node", "label")
        whole = nodes.join(self.rooted(nodes.select("label").distinct(), None, True), "label").select(F.floor(F.col("node") / SHIFT).cast("int").alias("img_id"), (F.col("node") % SHIFT).cast("int").alias("kp_id"), F.col("root").alias("label"))
        return degrees(self.read("edges").select("i", "j", "a", "b")).join(whole, ["img_id", "kp_id"]).select("img_id", "kp_id", "degree", "label")

    def tracks(self, policy: str = "degree", least: int = 2) -> DataFrame:
        return build(self.labelled(), policy, least)


def keep_tracks(spark: SparkSession, folder: str, state: str, checkpoint: str, files_at_once: int = 100):
    """A finite stream over the Parquet files of matches in a folder, into the state; returns the query, which ends when it has read
    all files that are there. The next call with the same checkpoint goes on from there."""
    kept = TrackState(spark, state)
    stream = spark.readStream.schema(MATCHES).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return stream.writeStream.foreachBatch(lambda rows, batch: kept.add(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
