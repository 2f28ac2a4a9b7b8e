"""Point clouds as ASCII PLY, and checkpoints of a reconstruction as a folder of Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ply_lines(cloud: DataFrame, colours: bool = False) -> DataFrame:
    """(nth, line): the vertex lines of (pid, x, y, z[, r, g, b]) in the order of pid."""
    fields = [F.format_string("%.6f", c) for c in "xyz"] + ([F.col(c).cast("string") for c in "rgb"] if colours else [])
    return cloud.select(F.col("pid").alias("nth"), F.concat_ws(" ", *fields).alias("line"))


def write_ply(cloud: DataFrame, path: str, colours: bool = False) -> None:
    """A folder of text parts that make one PLY file in the order of their names; the first begins with the header."""
    n = cloud.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"], *([f"property uchar {c}" for c in ("red", "green", "blue")] if colours else []), "end_header"]
    header = cloud.sparkSession.createDataFrame([(-len(head) + i, x) for i, x in enumerate(head)], "nth long, line string")
    ply_lines(cloud, colours).unionByName(header).sort("nth").select("line").write.text(path)


def parse_ply(lines: DataFrame) -> DataFrame:
    """(file, pid, x, y, z, r, g, b) of (file, nth, line): vertices by the names in the header; colours NULL if there are none.
    A file with fewer vertex lines than its header says, or without x, y, z, raises an error."""
    head = lines.groupBy("file").agg(F.min(F.when(F.col("line") == "end_header", F.col("nth"))).alias("ends"))
    props = lines.join(head, "file").where(F.col("nth") < F.col("ends"))
    vertex = F.regexp_extract("line", r"^element vertex (\d+)", 1)
    about = props.groupBy("file", "ends").agg(
        F.max(F.when(F.col("line").startswith("element vertex"), vertex.cast("long"))).alias("n"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("line").startswith("property"), F.struct("nth", F.substring_index("line", " ", -1).alias("name"))))), lambda p: p["name"]).alias("names"),
    )
    body = lines.join(about, "file").where((F.col("nth") > F.col("ends")) & (F.col("nth") <= F.col("ends") + F.col("n")))
    parts = F.split(F.trim("line"), r"\s+")

    def named(*names: str) -> Column:
        at = F.greatest(*[F.array_position("names", n) for n in names], F.lit(0))
        return F.when(at > 0, F.get(parts, (at - 1).cast("int")).cast("double"))

    out = body.select("file", (F.col("nth") - F.col("ends") - 1).alias("pid"), "n", *[named(c).alias(c) for c in "xyz"], *[named(c, s).cast("int").alias(s) for c, s in (("red", "r"), ("green", "g"), ("blue", "b"))])
    return out


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(pid, x, y, z, r, g, b) of one ASCII PLY file or a folder of parts."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("part"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where("line <> ''")
    sizes = raw.groupBy("part").agg((F.max("at") + 1).alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    lines = raw.join(starts, "part").select(F.lit(path).alias("file"), (F.col("start") + F.col("at")).alias("nth"), "line")
    dense = lines if sizes.count() == 1 else lines.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("nth")).cast("long") - 1)
    out = parse_ply(dense)
    found = out.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("bad")).first()
    if found["k"] and (found["k"] != found["n"] or found["bad"]):
        raise ValueError(f"{path}: {found['k']} of {found['n']} vertices, {found['bad']} without x, y, z")
    return out.drop("file", "n")


def save(tables: dict[str, DataFrame], folder: str, about: dict | None = None) -> None:
    """Each table as Parquet, and a manifest with the names."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"tables": sorted(tables), "about": about or {}}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}
