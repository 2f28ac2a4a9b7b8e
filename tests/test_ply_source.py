"""PLY as a data source: ranges of bytes, parts, truncated files, writes that fail."""

import random
from pathlib import Path

import pytest

from manyview.sources import clouds
from manyview.sources.ply import PlySource


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_ranges_of_a_file(spark, tmp_path):
    spark.dataSource.register(PlySource)
    draw = random.Random(1)
    points = [(round(draw.uniform(-99, 99), draw.randint(0, 6)), draw.random(), -draw.random(), k % 256, 7, 255) for k in range(997)]
    head = f"ply\nformat ascii 1.0\ncomment x\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    file = tmp_path / "cloud.ply"
    file.write_text(head + "".join(" ".join(map(str, p)) + "\n" for p in points) + "3 0 1 2\n")
    expected = [(k, *p) for k, p in enumerate(points)]
    for size in (37, 1000, 1 << 20):
        df = spark.read.format("ply").option("range_bytes", size).load(str(file))
        assert rows_of(df) == expected
        assert (df.rdd.getNumPartitions() > 20) == (size <= 1000)
    assert [r.pid for r in spark.read.format("ply").load(str(file)).where("pid > 994 and r is not null").collect()] == [995, 996]
    file.write_text(head + "1 2 3 4 5 6\n")
    with pytest.raises(Exception, match="of 997 vertices"):
        spark.read.format("ply").load(str(file)).collect()
    file.write_text(head.replace("property float z\n", ""))
    with pytest.raises(Exception, match="no vertices with x, y and z"):
        spark.read.format("ply").load(str(file)).collect()


def test_written_parts_are_read(spark, tmp_path):
    spark.dataSource.register(PlySource)
    cloud = spark.range(500).selectExpr("id as pid", "id / 7 as x", "-id / 3 as y", "1e-3 * id as z", "cast(id % 256 as int) as r", "1 as g", "2 as b")
    for df in (cloud, cloud.drop("r", "g", "b")):
        path = str(tmp_path / f"cloud{len(df.columns)}")
        df.repartitionByRange(5, "pid").sortWithinPartitions("pid").write.format("ply").mode("append").save(path)
        back = spark.read.format("ply").option("range_bytes", 700).load(path)
        names = df.columns
        assert [tuple(round(v, 4) for v in r) for r in rows_of(back.select(names))] == [tuple(round(v, 4) for v in r) for r in rows_of(df)]
        assert len(list(Path(path).glob("part-*"))) == 6 and not [p for p in Path(path).iterdir() if p.is_dir()]
        assert rows_of(clouds.read_ply(spark, path).select("pid", "r")) == rows_of(back.select("pid", "r"))
    with pytest.raises(Exception, match="overwrite"):
        cloud.write.format("ply").mode("append").save(path)
    assert not [p for p in Path(path).iterdir() if p.is_dir()] and spark.read.format("ply").load(path).count() == 500
    cloud.limit(3).coalesce(1).write.format("ply").mode("overwrite").save(path)
    assert spark.read.format("ply").load(path).count() == 3


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(PlySource)
    bad = spark.range(40).selectExpr("id as pid", "cast(if(id = 31, null, id) as double) as x", "1d as y", "2d as z").repartition(4)
    with pytest.raises(Exception):
        bad.write.format("ply").mode("append").save(str(tmp_path / "cloud"))
    assert not (tmp_path / "cloud").exists() or not list((tmp_path / "cloud").iterdir())
