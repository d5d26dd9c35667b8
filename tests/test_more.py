import colorsys
import random

import pytest
from pyspark.sql import functions as F

from foliospark import annotations as an
from foliospark.config import TrainingSettings
from foliospark.operators import augment
from foliospark.sources.tables import config_digest


def test_hue_and_saturation_match_hsv(spark):
    colours = [(255, 0, 0), (10, 200, 30), (0, 0, 0), (90, 90, 90), (12, 13, 250), (250, 240, 3)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(colours)], "i int, r int, g int, b int")
    for r in augment.hue_saturation(df, F.lit(0.3), F.lit(0.5)).collect():
        h, s, v = colorsys.rgb_to_hsv(*[c / 255 for c in colours[r.i]])
        want = colorsys.hsv_to_rgb((h + 0.3) % 1, min(1, s * 0.5), v)
        assert all(abs(a - b * 255) < 1e-6 for a, b in zip((r.r, r.g, r.b), want, strict=True))


def test_training_table(spark):
    rows = [(i, y, x, 200, 10 * x, 0) for i in (1, 2) for y in range(8) for x in range(8)]
    images = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    marks = images.withColumns({"r": F.when(F.col("x") < 4, 255).otherwise(0), "g": F.lit(0)})
    palette = spark.createDataFrame([(0, 0, 0, 0), (1, 255, 0, 0)], "class_id int, r int, g int, b int")
    out = augment.training_table(images, marks, palette, TrainingSettings(n_epochs=2, patch_height=4, patch_width=4))
    got = out.collect()
    assert len(got) == 2 * 2 * 9 * 16 and {r.batch for r in got} == {0, 1}
    assert all((r.class_id == 1) == (r.g < 40) for r in got)
    again = augment.training_table(images, marks, palette, TrainingSettings(n_epochs=2, patch_height=4, patch_width=4)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_training_table_with_geometry(spark):
    rows = [(i, y, x, 200, 10 * x, 0) for i in (1, 2) for y in range(8) for x in range(8)]
    images = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    marks = images.withColumns({"r": F.when(F.col("x") < 4, 255).otherwise(0), "g": F.lit(0)})
    palette = spark.createDataFrame([(0, 0, 0, 0), (1, 255, 0, 0)], "class_id int, r int, g int, b int")
    plain = TrainingSettings(n_epochs=2, make_patches=False, augment_flip=False, input_pixels=256, augment_scale=0.0, augment_rotation=0.0)
    got = augment.training_table(images, marks, palette, plain, geometry=True).collect()
    assert len(got) == 2 * 2 * 256 and all(r.g == 10 * (r.x // 2) and (r.class_id == 1) == (r.x < 8) for r in got)
    turned = TrainingSettings(n_epochs=2, make_patches=False, augment_flip=False, input_pixels=256, augment_scale=0.3, augment_rotation=0.4)
    again = augment.training_table(images, marks, palette, turned, geometry=True).collect()
    sizes = {(r.epoch, r.image_id): 0 for r in again}
    for r in again:
        sizes[r.epoch, r.image_id] += 1
        assert (r.class_id == 1) == (r.g < 40)
    assert len(set(sizes.values())) > 1 and max(sizes.values()) <= 256 * 1.3


def test_via_masks_export_and_page(spark, tmp_path):
    body = """{"a.jpg9": {"filename": "a.jpg", "size": 9, "file_attributes": {}, "regions": [
      {"region_attributes": {"kind": "Text"}, "shape_attributes": {"name": "rect", "x": 1, "y": 1, "width": 3, "height": 2}},
      {"region_attributes": {"kind": "Text"}, "shape_attributes": {"name": "circle", "cx": 9, "cy": 9, "r": 1}}]},
      "b.jpg9": {"filename": "b.jpg", "size": 9, "file_attributes": {}, "regions": []}}"""
    (tmp_path / "v.json").write_text(body)
    regions = an.via_regions(an.read_via(spark, str(tmp_path / "v.json")))
    sizes = spark.createDataFrame([("a.jpg", 10, 10), ("b.jpg", 5, 5)], "filename string, height int, width int")
    got = {tuple(r) for r in an.via_masks(regions, sizes, "kind").collect()}
    assert ("b.jpg", "nolabel", None, None) in got
    assert {(y, x) for f, _, y, x in got if f == "a.jpg"} == {(y, x) for y in (1, 2) for x in (1, 2, 3)} | {(9, 9), (8, 9), (9, 8)}
    shapes = regions.where("points is not null").select("filename", "attributes", F.lit(9).alias("size"), an.region_from_points(F.col("points"), "rect").alias("shape"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out/e.json").write_text(an.via_export(shapes).first().json)
    back = an.via_regions(an.read_via(spark, str(tmp_path / "out"))).first()
    assert (back.key, back.shape.x, back.shape.width, back.attributes) == ("a.jpg9", 1, 3, {"kind": "Text"})
    page = an.via_page(regions, sizes, "kind").first()
    assert page.text_regions[0].custom_attribute == "structure {type:Text;}" and page.image_width == 10
    xml = an.via_page(regions, sizes, "kind").select("image_filename", an.page_xml("me", "2020").alias("xml"))
    an.write_documents(xml, str(tmp_path / "pages"))
    assert an.read_page_xml(spark, str(tmp_path / "pages/*")).first().text_regions[0].id == "region_0"
    assert an.draw(an.via_page(regions, sizes, "kind"), "text_regions", fill=True).count() == 6


def test_config_digest_ignores_order():
    assert config_digest({"a": 1, "b": [2]}) == config_digest({"b": [2], "a": 1})


def test_small_parts(spark, tmp_path):
    from foliospark.operators import labels, tiling

    assert labels.class_table([(255, 0, 0), (0, 255, 0)]) == [(0, 0, 0, 0, 0, 0), (0, 255, 0, 0, 1, 0), (255, 0, 0, 1, 0, 0), (255, 255, 0, 1, 1, 0)]
    rows = spark.createDataFrame([(1, y, x, float(x)) for y in range(2) for x in range(3)], "image_id long, y int, x int, v double")
    assert {(r.x, r.v) for r in tiling.score_images(rows, lambda a: a + a.mean()).collect()} == {(0, 1.0), (1, 2.0), (2, 3.0)}
    body = """{"_via_attributes": {"region": {"note": {"type": "text"}, "kind": {"type": "dropdown", "options": {"a": "", "b": ""}}}}, "_via_img_metadata":
      {"p.jpg1": {"filename": "p.jpg", "size": 1, "file_attributes": {}, "regions": [{"region_attributes": {}, "shape_attributes": {"name": "rect", "x": 1, "y": 1, "width": 1, "height": 1}}]},
       "http://x/q.jpg-1": {"filename": "http://x/q.jpg", "size": -1, "file_attributes": {}, "regions": []}}}"""
    (tmp_path / "p.json").write_text(body)
    path = str(tmp_path / "p.json")
    assert {(r.name, r.type, tuple(r.options or ["-"])) for r in an.read_via_attributes(spark, path).collect()} == {("note", "text", ("-",)), ("kind", "dropdown", ("a", "b"))}
    sizes = spark.createDataFrame([("p.jpg", 100, 50), ("http://x/q.jpg", 10, 20)], "filename string, height int, width int")
    via = an.read_via(spark, path)
    assert [(r.image_name, r.reduced_x, r.reduced_y, r.iiif) for r in an.working_items(via, sizes, "c", 40).collect()] == [("p.jpg", 20, 40, None)]
    assert an.working_items(via, sizes, "c", keep_empty=True).where("iiif is not null").count() == 1
    assert an.regions_of(via, "p.jpg").count() == 1 and an.regions_of(via, "none").count() == 0


def test_annotated_page_and_json(spark):
    none = F.array().cast(an.POINTS)
    line = F.struct(F.lit("l").alias("id"), an.parse_points(F.lit("0,0 4,0 4,4 0,4")).alias("coords"), F.lit("").alias("custom_attribute"), an.parse_points(F.lit("0,5 9,5")).alias("baseline"), F.lit("t").alias("text"))
    region = F.struct(F.lit("r").alias("id"), none.alias("coords"), F.lit("").alias("custom_attribute"), F.array(line).alias("text_lines"))
    page = spark.range(1).select(F.lit("p").alias("image_filename"), F.array(region).alias("text_regions"))
    got = an.annotate_page(page, 1, endpoint_radius=0).groupBy("channel").count().collect()
    assert {r.channel: r["count"] for r in got} == {"r": 10, "g": 16, "b": 2}
    assert '"text":"t"' in page.select(an.page_json(["image_filename", "text_regions"])).first()[0]


def test_shapes_by_component_are_those_by_image(spark):
    from foliospark.operators import components, vectorize

    rng = random.Random(3)
    rows = [(i, y, x) for i in range(3) for y in range(40) for x in range(50) if rng.random() < 0.45]
    mask = spark.createDataFrame(rows, "image_id long, y int, x int")
    from foliospark.checkpoints import ensure

    ensure(spark)
    tiled = components.label_tiled(mask, tile=16)
    for f in (lambda m: vectorize.find_polygons(m, 0.0005), lambda m: vectorize.find_boxes(m, "min_rectangle", 0.001), lambda m: vectorize.find_boxes(m, "rectangle", 0.001, n_max=2)):
        assert sorted(map(str, f(mask).collect())) == sorted(map(str, f(tiled).collect()))
    assert sorted(map(str, vectorize.find_lines(mask).collect())) == sorted(map(str, vectorize.find_lines(tiled).collect()))


def test_a_line_over_many_tiles_is_one_component(spark):
    from foliospark.checkpoints import ensure
    from foliospark.operators import components

    ensure(spark)
    mask = spark.createDataFrame([(1, 3, x) for x in range(200)], "image_id long, y int, x int")
    assert components.label_tiled(mask, tile=8).select("component").distinct().count() == 1


def test_palettes_have_no_limit(spark):
    from foliospark.operators import labels

    palette = spark.range(5000).selectExpr("int(id) as class_id", "int(id % 256) as r", "7 as g", "int(id / 256) as b", "array(int(id)) as codes")
    pixels = spark.createDataFrame([(4999,), (5000,)], "class_id int")
    assert {r.class_id: (r.r, r.g, r.b) for r in labels.class_colour(pixels, palette).collect()} == {4999: (135, 7, 19), 5000: (None, None, None)}
    coded = labels.codes_colour(pixels.selectExpr("array(class_id) as codes"), palette).collect()
    assert {r.codes[0]: (r.r, r.g, r.b) for r in coded} == {4999: (135, 7, 19), 5000: (0, 0, 0)}
