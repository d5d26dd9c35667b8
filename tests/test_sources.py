import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark import annotations as an
from foliospark.operators import pairing
from foliospark.sources import codec, images, tables


def test_codecs_round_trip():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert (codec.png_decode(codec.png_encode(a)) == a).all()
    assert codec.image_size(codec.png_encode(a)) == (5, 7)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xd9"
    assert codec.image_size(jpeg) == (5, 7) and codec.image_size(b"GIF89a") is None
    b = rng.random((3, 4, 2))
    assert (codec.npy_decode(codec.npy_encode(b)) == b).all()


def test_image_files(spark, tmp_path):
    a = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/p.png").write_bytes(codec.png_encode(a))
    (tmp_path / "note.txt").write_text("x")
    np_map = np.full((2, 2, 2), 51, np.uint8)
    (tmp_path / "m.npy").write_bytes(codec.npy_encode(np_map))
    assert [r.path.rsplit("/", 1)[1] for r in images.list_files(spark, str(tmp_path)).collect()] == ["p.png"]
    assert [(r.height, r.width) for r in images.read_sizes(spark, str(tmp_path)).collect()] == [(2, 3)]
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in images.read_pixels(spark, str(tmp_path / "sub")).collect()}
    assert got == {(y, x): tuple(int(v) for v in a[y, x]) for y in range(2) for x in range(3)}
    assert {tuple(r.p) for r in images.read_probabilities(spark, str(tmp_path)).collect()} == {(0.2, 0.2)}
    mask = spark.createDataFrame([("i", 1, 2, 2, 3), ("e", None, None, 2, 3)], "name string, y int, x int, height int, width int")
    pngs = {r.name: codec.png_decode(bytes(r.png)) for r in images.encode_masks(mask, ["name"]).collect()}
    assert pngs["i"][1, 2, 0] == 255 and pngs["i"].sum() == 255 and pngs["e"].sum() == 0


def test_small_tables(spark, tmp_path):
    (tmp_path / "classes.txt").write_text("0 0 0\n255 0 0\n\n")
    assert [(r.class_id, r.r) for r in tables.read_palette(spark, str(tmp_path / "classes.txt")).collect()] == [(0, 0), (1, 255)]
    (tmp_path / "multi.txt").write_text("0 0 0 0 0\n0 255 0 1 0\n")
    multi = tables.read_palette(spark, str(tmp_path / "multi.txt"), multilabel=True)
    assert tables.class_count(multi, True) == 2 and multi.collect()[1].codes == [1, 0]
    with pytest.raises(Exception, match="columns"):
        tables.read_palette(spark, str(tmp_path / "multi.txt")).collect()
    (tmp_path / "quads.txt").write_text("a.jpg,1,2,3,4,5,6,7,8\nb.jpg,9,9,1,2,3,4,5,6,7,8,SINGLE\n")
    assert [(r.file, r.quad[0].x, r.tag) for r in tables.read_quads(spark, str(tmp_path / "quads.txt")).collect()] == [("a.jpg", 1, None), ("b.jpg", 1, "SINGLE")]
    (tmp_path / "scores.txt").write_text("intro\n#P value, #R value, #F_1 value, #T, #H\n0.5, 0.6, 0.55, t, x/y/b.xml\n0.1, 0.2, 0.15, t, a.xml\n\nrest")
    assert [tuple(r) for r in tables.read_scores(spark, str(tmp_path / "scores.txt")).collect()] == [("a.xml", 0.15, 0.1, 0.2), ("b.xml", 0.55, 0.5, 0.6)]


def test_page_xml_round_trip(spark, tmp_path):
    none = F.array().cast(an.POINTS)
    line = F.struct(F.lit("l1").alias("id"), none.alias("coords"), F.lit("structure {type:heading;}").alias("custom_attribute"), an.parse_points(F.lit("0,5 9,5")).alias("baseline"), F.lit('a <b> & "c"').alias("text"))
    region = F.struct(F.lit("r1").alias("id"), an.parse_points(F.lit("0,0 9,0 9,9")).alias("coords"), F.lit("").alias("custom_attribute"), F.array(line).alias("text_lines"))
    page = spark.range(1).select(F.lit("p.jpg").alias("image_filename"), F.lit(10).alias("image_width"), F.lit(20).alias("image_height"), F.array(region).alias("text_regions"))
    xml = page.select(an.page_xml("me", "2020-01-01")).first()[0]
    for name, text in (("a.xml", xml), ("b.xml", xml.replace("http://schema", "https://schema"))):
        (tmp_path / name).write_text(text)
    rows = an.read_page_xml(spark, str(tmp_path)).collect()
    assert len(rows) == 2
    for r in rows:
        t = r.text_regions[0].text_lines[0]
        assert (r.image_filename, r.image_width, t.id, t.text, [(p.x, p.y) for p in t.baseline]) == ("p.jpg", 10, "l1", 'a <b> & "c"', [(0, 5), (9, 5)])
        assert r.metadata.creator == "me" and r.graphic_regions == []
    assert an.text_lines(an.read_page_xml(spark, str(tmp_path)), ["image_filename"]).count() == 2


def test_whole_page_round_trip(spark, tmp_path):
    from foliospark.plans import document_queries

    pages = document_queries._pages(spark, "/root/testdata/sf0.001").where("size(table_regions) > 0 and size(graphic_regions) > 0 and size(separator_regions) > 0")
    kinds = ["text_regions", "graphic_regions", "separator_regions", "table_regions", "page_border"]
    want = pages.orderBy("image_id").limit(20)
    an.write_documents(want.select("image_filename", an.page_xml("me", "2020", pages.schema).alias("xml")), str(tmp_path / "pages"))
    back = {r.image_filename: r for r in an.read_page_xml(spark, str(tmp_path / "pages/*")).collect()}
    rows = want.collect()
    assert len(back) == len(rows) == 20
    plain = lambda v: {k: plain(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else "" if v is None else v
    for r in rows:
        for kind in kinds:
            own, read = plain(r[kind]), plain(back[r.image_filename][kind])
            for a, b in zip(own, read, strict=True):
                assert a == {k: b[k] for k in a}


def test_via(spark, tmp_path):
    body = """{"_via_img_metadata": {"a.jpg12": {"filename": "a.jpg", "size": 12, "file_attributes": {}, "regions": [
      {"region_attributes": {"kind": "text", "box": {"x": true, "y": false}}, "shape_attributes": {"name": "rect", "x": 1, "y": 2, "width": 3, "height": 4}},
      {"region_attributes": {"kind": "image"}, "shape_attributes": {"name": "polygon", "all_points_x": [1, 2, 3], "all_points_y": [4, 5, 6]}}]}}}"""
    (tmp_path / "p.json").write_text(body)
    r = an.via_regions(an.read_via(spark, str(tmp_path / "p.json")))
    assert {tuple((p.x, p.y) for p in x.points) for x in r.collect()} == {((1, 2), (4, 2), (4, 6), (1, 6)), ((1, 4), (2, 5), (3, 6))}
    assert {x.name: x.options for x in an.attribute_options(r).collect()} == {"kind": ["image", "text"], "box": ["x", "y"]}
    assert an.with_option(r, "kind", "text").count() == 1 and an.with_option(r, "box", "x").count() == 1 and an.with_option(r, "box", "y").count() == 0


def test_pairing(spark):
    i = spark.createDataFrame([("i/a.jpg",), ("i/b.png",), ("i/c.jpg",)], "path string")
    k = spark.createDataFrame([("l/a.png",), ("l/a.jpg",), ("l/b.jpg",)], "path string")
    assert {tuple(r) for r in pairing.pair_labels(i, k).collect()} == {("i/a.jpg", "l/a.jpg"), ("i/b.png", "l/b.jpg"), ("i/c.jpg", None)}
    with pytest.raises(FileNotFoundError):
        pairing.require(i, k)
    rows = spark.range(100).toDF("key")
    a, b = pairing.split_sample(rows, "key")
    assert a.count() == 15 and b.count() == 85 and a.intersect(b).count() == 0
