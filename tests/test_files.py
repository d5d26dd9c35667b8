"""The writer of named files: its commit protocol, what a failure leaves behind, and the sets written with it."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark import annotations as an
from foliospark.plans import file_queries
from foliospark.sources import named_files, tables
from foliospark.sources.codec import png_decode


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def files(spark, n, parts=4):
    return spark.range(n).repartition(parts).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("content"))


def test_written_once_and_read_back(spark, tmp_path):
    out = str(tmp_path / "out")
    named_files.write_named_files(files(spark, 200), out)
    assert listed(out) == sorted(f"d{i % 3}/f{i}" for i in range(200))
    got = {r["name"]: bytes(r["content"]).decode() for r in named_files.read_named_files(spark, out).collect()}
    assert got == {f"d{i % 3}/f{i}": f"text of {i}" for i in range(200)}


def test_append_replaces_and_overwrite_empties(spark, tmp_path):
    out = str(tmp_path / "out")
    named_files.write_named_files(files(spark, 3), out)
    named_files.write_named_files(files(spark, 5).withColumn("content", F.lit("new")), "file://" + out)
    assert listed(out) == ["d0/f0", "d0/f3", "d1/f1", "d1/f4", "d2/f2"]
    assert open(f"{out}/d0/f0").read() == "new"
    named_files.write_named_files(files(spark, 1), out, mode="overwrite")
    assert listed(out) == ["d0/f0"]


def test_failed_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    broken = files(spark, 100).withColumn("content", F.when(F.col("name") == "d0/f99", F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    spark.dataSource.register(named_files.NamedFiles)
    with pytest.raises(Exception, match="broken"):
        broken.write.format("named_files").mode("append").save(str(out))
    assert not out.exists() or listed(out) == []


@pytest.mark.parametrize("name", ["/a", "a/../b", "", None, "a//b", "_temporary/x"])
def test_names_that_leave_the_folder(spark, tmp_path, name):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("fine", "x"), (name, "y")], "name string, content string").coalesce(1)
    with pytest.raises(Exception, match="not a relative file name"):
        named_files.write_named_files(rows, str(out))
    assert listed(out) == []


def test_names_that_come_twice(spark, tmp_path):
    with pytest.raises(ValueError, match="more than once"):
        named_files.write_named_files(spark.createDataFrame([("a", "x"), ("a", "y")], "name string, content string"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_repeated_attempts_count_once(tmp_path):
    """A task that ran twice, and one that broke off, as a cluster has them: only the attempts in the messages give files."""
    w = named_files.Writer(str(tmp_path), overwrite=False)
    batch = pa.RecordBatch.from_pydict({"name": ["a/x", "y", "z"], "content": [b"1", b"2", None]}, pa.schema([("name", pa.string()), ("content", pa.binary())]))

    def breaks():
        yield batch
        raise RuntimeError("lost")

    w.write(iter([batch]))
    with pytest.raises(RuntimeError):
        w.write(breaks())
    message = w.write(iter([batch]))
    assert message.count == 2 and not (tmp_path / "y").exists()
    w.commit([message, None])
    assert listed(tmp_path) == ["a/x", "y"]
    other = named_files.Writer(str(tmp_path), overwrite=False)
    other.write(iter([batch]))
    other.abort([])
    assert listed(tmp_path) == ["a/x", "y"] and not (tmp_path / "_temporary").exists()


def test_empty_frames(spark, tmp_path):
    named_files.write_named_files(files(spark, 0), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or listed(tmp_path / "out") == []


def test_mask_names(spark):
    rows = spark.createDataFrame([("p1", " Some Label \n"), ("p1", None)], "i string, l string")
    assert [r[0] for r in rows.select(named_files.mask_name(F.col("i"), F.col("l"))).collect()] == ["p1/p1-mask-some_label.png", "p1/p1-mask-nolabel.png"]


@pytest.mark.parametrize("form", ["xml", "json"])
def test_pages_keep_what_they_know(spark, tmp_path, form):
    """Written, read, written again: the date stays, the last change and the comments follow."""
    pages = file_queries._rectangle_pages(spark, "/root/testdata/sf0.001").where("image_filename % 10 = 3").withColumn("image_filename", F.concat(F.lit("scans/p"), "image_filename", F.lit(".jpg"))).cache()
    first, second = str(tmp_path / "1"), str(tmp_path / "2")
    named_files.write_pages(pages, first, "me", "2020", comments="one", form=form)
    read = lambda p: an.read_page_xml(spark, p) if form == "xml" else an.read_page_json(spark, p)
    named_files.write_pages(read(first), second, "you", "2021", comments=", two", form=form)
    assert listed(first) == listed(second) == sorted(f"p{r[0][7:-4]}.{form}" for r in pages.select("image_filename").collect())
    got = {r["image_filename"]: r["metadata"] for r in read(second).collect()}
    for r in pages.collect():
        was = r["metadata"]
        assert tuple(got[r["image_filename"]]) == ("you", was["created"] or "2020", "2021", (was["comments"] or "") + "one, two")
    assert {r["image_filename"]: len(r["text_regions"]) for r in read(second).collect()} == {r["image_filename"]: len(r["text_regions"]) for r in pages.collect()}


def test_training_set_as_a_whole(spark, tmp_path):
    pages = file_queries._line_pages(spark, "/root/testdata/sf0.001").where("image_id < 20")
    at = pages.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39))))
    images = at.where("image_id < 18").select("image_id", "y", "x", F.col("y").alias("r"), F.col("x").alias("g"), F.lit(7).alias("b"))
    out = str(tmp_path / "set")
    named_files.write_training_set(images, pages, out, 10_000, channels="rgb", multilabel=True, share=0.2, now="2020")
    names = [n for n in listed(out) if ".csv" not in n]
    assert names == sorted(["classes.txt", *[f"{a}/{i}.{e}" for i in range(18) for a, e in (("images", "png"), ("labels", "png"), ("gt", "xml"))]])
    pairs = {name: {tuple(r) for r in tables.read_pairs(spark, f"{out}/{name}.csv").collect()} for name in ("set_data", "train_data", "eval_data")}
    assert pairs["set_data"] == {(f"images/{i}.png", f"labels/{i}.png") for i in range(18)}
    assert len(pairs["eval_data"]) == 4 and pairs["train_data"] == pairs["set_data"] - pairs["eval_data"]
    assert png_decode(open(f"{out}/images/3.png", "rb").read())[5, 6].tolist() == [5, 6, 7]
    palette = tables.read_palette(spark, f"{out}/classes.txt", multilabel=True).collect()
    assert [(r.r, r.g, r.b, r.codes) for r in palette] == [(*c[:3], list(c[3:])) for c in named_files.set_classes("rgb", True)]
    colours = {tuple(c) for i in range(18) for c in png_decode(open(f"{out}/labels/{i}.png", "rb").read()).reshape(-1, 3).tolist()}
    assert colours <= {c[:3] for c in named_files.set_classes("rgb")} and len(colours) > 4
    assert an.read_page_xml(spark, f"{out}/gt").count() == 18


def test_set_classes():
    assert named_files.set_classes("rb") == [(0, 0, 0), (255, 0, 0), (0, 0, 255), (255, 0, 255)]
    assert named_files.set_classes("r", True) == [(0, 0, 0, 0, 0, 0), (255, 0, 0, 1, 0, 0)]
