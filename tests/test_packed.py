"""Files in archives, and images made of streamed pixels."""

import os
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.plans import file_queries
from foliospark.sources import images, named_files
from foliospark.sources.codec import png_decode


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def packed(spark, names, out, content="text", **more):
    rows = spark.createDataFrame([(n, content) for n in names], "name string, content string").repartition(3)
    named_files.write_named_files(rows, out, packed=True, **more)


def test_archives_hold_every_file(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    names = [f"d{i % 3}/{'long' * 40}/ü{i}.{'xml' if i % 2 else 'png'}" for i in range(200)]
    packed(spark, names, out)
    got = {r["name"]: bytes(r["content"]) for r in named_files.read_named_files(spark, out, packed=True).collect()}
    assert got == dict.fromkeys(names, b"text")
    assert {r["name"] for r in named_files.read_named_files(spark, out, "*.xml", packed=True).collect()} == {n for n in names if n.endswith("xml")}
    archives = [f for f in listed(out) if f.endswith(".tar.gz")]
    assert len(archives) <= 3 and len(listed(out)) == 2 * len(archives)  # and their indexes
    assert sorted(n for a in archives for n in tarfile.open(f"{out}/{a}").getnames()) == sorted(names)
    packed(spark, ["more"], out)
    assert named_files.read_named_files(spark, out, packed=True).count() == 201
    packed(spark, ["other"], out, mode="overwrite")
    assert [r["name"] for r in named_files.read_named_files(spark, out, packed=True).collect()] == ["other"]


def test_archives_are_cut(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(named_files, "_ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(named_files, "_BATCH_BYTES", 3000)
    w = named_files.Writer(str(tmp_path), overwrite=False, packed=True)
    message = w.write(iter([pa.RecordBatch.from_pydict({"name": [f"f{i}" for i in range(20)], "content": [bytes([i]) * 900 if i else None for i in range(20)]})]))
    assert message.count == 19 and message.archives == 7
    w.commit([None, message])
    archives = named_files._held(str(tmp_path), ".tar.gz")
    assert len(archives) == 7
    assert {n: c for a in archives for b in named_files._unpacked(a, "*") for n, c in zip(*b.to_pydict().values(), strict=True)} == {f"f{i}": bytes([i]) * 900 for i in range(1, 20)}


@pytest.mark.parametrize("names", [["b", "b", "c"], ["c", "a"]])
def test_packed_names_that_come_twice(spark, tmp_path, names):
    """Among themselves, or in an archive that was there: what was there stays, nothing new does."""
    out = str(tmp_path / "out")
    packed(spark, ["a"], out)
    before = listed(out)
    with pytest.raises(ValueError, match="more than once"):
        packed(spark, names, out, "new")
    assert listed(out) == before
    packed(spark, ["z"], str(tmp_path / "other"))
    empty = spark.createDataFrame([], "name string, content string")
    named_files.write_named_files(empty, str(tmp_path / "none"), packed=True)
    assert named_files.read_named_files(spark, str(tmp_path / "none"), packed=True).count() == 0


@pytest.mark.parametrize("colours", [[], ["r", "g", "b"]])
def test_images_of_streamed_pixels(spark, colours):
    """Images over several batches, with nulls, places outside and a null key, against arrays."""
    rng = random.Random(1)
    sizes = {(k, n): (rng.randrange(1, 9), rng.randrange(1, 9)) for k in (1, 2, 3, None) for n in ("a", None)}
    rows, want = [], {}
    for key, (h, w) in sizes.items():
        a = want[key] = np.zeros((h, w, 3 if colours else 1), np.uint8)
        rows.append((*key, h, w, None, None, None, None, None))
        places = [(y, x) for y in range(-1, h + 1) for x in range(w + 1)]
        for y, x in rng.sample(places, len(places) // 2):
            rgb = [rng.randrange(256) for _ in range(3)]
            rows.append((*key, h, w, y, x, *rgb))
            if 0 <= y < h and x < w:
                a[y, x] = rgb if colours else 255
    df = spark.createDataFrame(rows, "k long, n string, height int, width int, y int, x int, r int, g int, b int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = images.encode_images(df, ["k", "n"], colours).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want)
    for r in got:
        assert np.array_equal(png_decode(bytes(r["png"])), want[r["k"], r["n"]])


def test_images_of_joined_pixels(spark):
    """Unions of joins by the same key: partitions that Spark coalesces or splits each for itself still give an image once."""
    at = spark.range(400).selectExpr("id as k", "explode(sequence(0, 7)) as y")
    sizes = spark.range(400).selectExpr("id as k", "8 as height", "1 as width").repartition("k")
    joined = at.repartition("k").hint("merge").join(sizes, "k").select("k", "height", "width", "y", F.lit(0).alias("x"))
    pixels = joined.unionByName(sizes.select("k", "height", "width", *[F.lit(None).cast("int").alias(c) for c in "yx"]))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        got = images.encode_images(pixels, ["k"], []).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(got) == 400 and all((png_decode(bytes(r["png"])) == 255).all() for r in got)


@pytest.mark.parametrize("name", ["page_files", "mask_files", "training_set_files"])
def test_queries_leave_few_files(spark, name, monkeypatch, tmp_path):
    """No file for each document or image, and rows of a document are shuffled once."""
    monkeypatch.setattr(file_queries, "_folder", lambda spark, kind: str(tmp_path / kind))
    n = file_queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert n > 400 and len(listed(tmp_path)) <= 40
    if name == "page_files":
        assert file_queries._rectangle_pages(spark, "/root/testdata/sf0.001").select(F.explode("text_regions"))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
