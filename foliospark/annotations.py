"""Annotation documents: page layouts (XML, JSON) and region annotations (JSON), as nested structs and flat frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.geometry import format_points, from_xy, parse_points, rectangle, scale_points
from .functions.page_text import NAMESPACE as NAMESPACE
from .functions.page_text import page_text

POINTS = "array<struct<x:int,y:int>>"
_SHAPE = "_id string, _custom string, Coords struct<_points:string>"
_LINE = f"struct<{_SHAPE.replace(' ', ':').replace(',:', ',')},Baseline:struct<_points:string>,TextEquiv:struct<Unicode:string>>"
_REGION = _SHAPE.replace(" ", ":").replace(",:", ",")
#: Schema of a layout document for Spark's XML reader; namespaces and prefixes are ignored.
XML_SCHEMA = (
    "Metadata struct<Creator:string,Created:string,LastChange:string,Comments:string>, "
    f"Page struct<_imageFilename:string,_imageWidth:int,_imageHeight:int,Border:struct<Coords:struct<_points:string>>,"
    f"TextRegion:array<struct<{_REGION},_type:string,TextEquiv:struct<Unicode:string>,TextLine:array<{_LINE}>>>,"
    f"GraphicRegion:array<struct<{_REGION}>>,SeparatorRegion:array<struct<{_REGION}>>,"
    f"TableRegion:array<struct<{_REGION},_rows:int,_columns:int,TableCell:array<struct<{_REGION},_rowIndex:int,_columnIndex:int,_rowSpan:int,_colSpan:int,_header:string,_embText:string>>>>>"
)


def _shape(r: Column) -> list[Column]:
    return [r["_id"].alias("id"), parse_points(r["Coords"]["_points"]).alias("coords"), r["_custom"].alias("custom_attribute")]


def _list(column: str, build) -> Column:
    """An empty list where the document has no such element."""
    return _or_empty(F.transform(F.col(column), lambda r: F.struct(*build(r))))


def _or_empty(built: Column) -> Column:
    return F.coalesce(built, F.filter(F.array(F.get(built, F.lit(0))), lambda _: F.lit(False)))


def read_page_xml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each layout document: image_filename, image_width, image_height, text_regions, graphic_regions, separator_regions, table_regions, page_border, metadata."""
    rows = spark.read.format("xml").option("rowTag", "PcGts").option("ignoreNamespace", "true").schema(XML_SCHEMA).load(path)

    def line(t: Column) -> list[Column]:
        return [*_shape(t), parse_points(t["Baseline"]["_points"]).alias("baseline"), F.coalesce(t["TextEquiv"]["Unicode"], F.lit("")).alias("text")]

    def region(r: Column) -> list[Column]:
        return [*_shape(r), r["_type"].alias("type"), F.coalesce(r["TextEquiv"]["Unicode"], F.lit("")).alias("text_equiv"), _or_empty(F.transform(r["TextLine"], lambda t: F.struct(*line(t)))).alias("text_lines")]

    def cell(c: Column) -> list[Column]:
        flag = lambda x: F.lower(c[x]) == "true"
        return [*_shape(c), c["_rowIndex"].alias("row_index"), c["_columnIndex"].alias("col_index"), c["_rowSpan"].alias("row_span"), c["_colSpan"].alias("col_span"), flag("_header").alias("header"), flag("_embText").alias("embedded_text")]

    def grid(t: Column) -> list[Column]:
        return [*_shape(t), t["_rows"].alias("rows"), t["_columns"].alias("columns"), _or_empty(F.transform(t["TableCell"], lambda c: F.struct(*cell(c)))).alias("cells")]

    meta = F.struct(*[F.col(f"Metadata.{a}").alias(b) for a, b in (("Creator", "creator"), ("Created", "created"), ("LastChange", "last_change"), ("Comments", "comments"))])
    return rows.select(
        F.col("Page._imageFilename").alias("image_filename"), F.col("Page._imageWidth").alias("image_width"), F.col("Page._imageHeight").alias("image_height"),
        _list("Page.TextRegion", region).alias("text_regions"), _list("Page.GraphicRegion", _shape).alias("graphic_regions"), _list("Page.SeparatorRegion", _shape).alias("separator_regions"), _list("Page.TableRegion", grid).alias("table_regions"),
        parse_points(F.col("Page.Border.Coords._points")).alias("page_border"), meta.alias("metadata"),
    )


_S = f"id:string,coords:{POINTS},custom_attribute:string"
#: Schema of a layout document as JSON: what ``read_page_xml`` gives.
JSON_SCHEMA = (
    "image_filename string, image_width int, image_height int, "
    f"text_regions array<struct<{_S},type:string,text_equiv:string,text_lines:array<struct<{_S},baseline:{POINTS},text:string>>>>, "
    f"graphic_regions array<struct<{_S}>>, separator_regions array<struct<{_S}>>, "
    f"table_regions array<struct<{_S},rows:int,columns:int,cells:array<struct<{_S},row_index:int,col_index:int,row_span:int,col_span:int,header:boolean,embedded_text:boolean>>>>, "
    f"page_border {POINTS}, metadata struct<creator:string,created:string,last_change:string,comments:string>"
)


def read_page_json(spark: SparkSession, path: str, schema: str = JSON_SCHEMA) -> DataFrame:
    """Layout documents as ``page_json`` writes them, one file each; what a document lacks is null."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def text_lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and each text line's fields, a row for each line."""
    regions = pages.select(*keys, F.explode("text_regions").alias("r"))
    return regions.select(*keys, F.col("r.id").alias("region_id"), F.explode("r.text_lines").alias("t")).select(*keys, "region_id", "t.*")


def sort_lines(lines: Column) -> Column:
    """By the mean height of the baseline, of equals by id."""
    mean = lambda p: F.coalesce(F.aggregate(p, F.lit(0).cast("long"), lambda a, q: a + q["y"]) / F.nullif(F.size(p), F.lit(0)), F.lit(0.0))
    keyed = F.transform(lines, lambda t: F.struct(mean(t["baseline"]).alias("k"), t["id"].alias("id"), t.alias("t")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)), lambda k: k["t"])


def scale_lines(lines: Column, ratio_y: Column, ratio_x: Column) -> Column:
    return F.transform(lines, lambda t: t.withField("coords", scale_points(t["coords"], ratio_y, ratio_x)).withField("baseline", scale_points(t["baseline"], ratio_y, ratio_x)))


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _attribute(name: str, v: Column) -> Column:
    v = v.cast("string")
    return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f' {name}="'), escape(v), F.lit('"'))).otherwise("")


def _points(tag: str, p: Column) -> Column:
    return F.when(F.size(p) > 0, F.concat(F.lit(f'<{tag} points="'), format_points(p), F.lit('"/>'))).otherwise("")


def _text(text: Column) -> Column:
    return F.concat(F.lit("<TextEquiv><Unicode>"), escape(F.coalesce(text, F.lit(""))), F.lit("</Unicode></TextEquiv>"))


def line_xml(t: Column) -> Column:
    """A text line element: id, custom, coordinates and baseline if there are any, always its text."""
    return F.concat(F.lit("<TextLine"), _attribute("id", t["id"]), _attribute("custom", t["custom_attribute"]), F.lit(">"), _points("Coords", t["coords"]), _points("Baseline", t["baseline"]), _text(t["text"]), F.lit("</TextLine>"))


def updated_metadata(creator: str, now: str, comments: str = "", schema: StructType | None = None) -> Column:
    """creator, created, last_change, comments of a document written ``now``: what it knows of itself is kept, ``comments`` follow."""
    was = F.col("metadata") if schema is not None and "metadata" in schema.names else F.struct(*[F.lit(None).cast("string").alias(c) for c in ("created", "comments")])
    created = F.nullif(was["created"], F.lit(""))
    said = F.concat(F.coalesce(was["comments"], F.lit("")), F.lit(comments))
    return F.struct(F.lit(creator).alias("creator"), F.coalesce(created, F.lit(now)).alias("created"), F.when(created.isNotNull(), F.lit(now)).alias("last_change"), said.alias("comments"))


def page_xml(creator: str, created: str, schema: StructType | None = None, comments: str = "") -> Column:
    """The document of a row with image_filename, image_width, image_height and text_regions (id, coords, custom_attribute, text_lines).

    With the frame's ``schema`` also all else that it has of what ``read_page_xml`` gives: the border, types and texts
    of text regions, graphic, separator and table regions with their cells, and its metadata: a document that has a date
    keeps it and gets ``created`` as its last change, and ``comments`` follow its own. Null and empty lists are left out.
    """
    names = {f.name for f in schema.fields} if schema else set()
    more = [c for c in ("graphic_regions", "separator_regions", "table_regions", "page_border") if c in names]
    columns = [F.col(c) for c in ("image_filename", "image_width", "image_height", "text_regions", *more)]
    return page_text(columns, updated_metadata(creator, created, comments, schema), "text_regions" in names)


def baselines_page(lines: DataFrame, key: str, ratio: float) -> DataFrame:
    """Found lines (key, points, height, width) to documents: lines line_i in one region, coordinates and sizes times ``ratio``."""
    none = F.array().cast(POINTS)
    scaled = lines.withColumn("p", scale_points(F.col("points"), F.lit(ratio), F.lit(ratio)))
    grouped = scaled.groupBy(key).agg(F.max("height").alias("h"), F.max("width").alias("w"), F.array_sort(F.collect_list("p")).alias("ps"))
    line = F.transform("ps", lambda p, i: F.struct(F.concat(F.lit("line_"), i.cast("string")).alias("id"), none.alias("coords"), F.lit("").alias("custom_attribute"), p.alias("baseline"), F.lit("").alias("text")))
    region = F.array(F.struct(F.lit("region_0").alias("id"), none.alias("coords"), F.lit("").alias("custom_attribute"), line.alias("text_lines")))
    size = lambda c: (F.col(c) * ratio).cast("int")
    return grouped.select(F.col(key).alias("image_filename"), size("w").alias("image_width"), size("h").alias("image_height"), region.alias("text_regions"))


# Region annotations: key -> {filename, size, regions, file_attributes}

VIA_SCHEMA = "map<string, struct<filename:string,size:bigint,regions:string,file_attributes:map<string,string>>>"
_VIA_REGION = "array<struct<region_attributes:map<string,string>,shape_attributes:struct<name:string,x:int,y:int,width:int,height:int,cx:int,cy:int,r:int,all_points_x:array<int>,all_points_y:array<int>>>>"


def read_via(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """key, filename, size, regions of region annotations; of a project file its image metadata. Version 1 has regions as a map."""
    text = spark.read.text(path, wholetext=True)
    body = F.coalesce(F.get_json_object("value", "$._via_img_metadata"), F.col("value"))
    rows = text.select(F.explode(F.from_json(body, VIA_SCHEMA)).alias("key", "a"))
    regions = F.from_json("a.regions", _VIA_REGION) if version == 2 else F.map_values(F.from_json("a.regions", _VIA_REGION.replace("array<struct", "map<string,struct", 1)))
    return rows.select("key", F.col("a.filename").alias("filename"), F.col("a.size").alias("size"), F.coalesce(regions, F.array().cast(_VIA_REGION)).alias("regions"))


def via_regions(annotations: DataFrame) -> DataFrame:
    """A row for each region: key, filename, attributes, shape, points (rectangles as corners; a circle has none)."""
    rows = annotations.select("key", "filename", F.explode("regions").alias("g"))
    s = F.col("g.shape_attributes")
    points = F.when(s["name"] == "rect", rectangle(s["x"], s["y"], s["width"], s["height"])).when(s["name"].isin("polygon", "polyline"), from_xy(s["all_points_x"], s["all_points_y"]))
    return rows.select("key", "filename", F.col("g.region_attributes").alias("attributes"), s.alias("shape"), points.alias("points"))


def attribute_options(regions: DataFrame) -> DataFrame:
    """name, options (sorted, distinct values) of each attribute; a checkbox value (JSON object) gives its keys."""
    rows = regions.select(F.explode("attributes").alias("name", "value"))
    boxes = F.map_keys(F.from_json("value", "map<string,boolean>"))
    rows = rows.select("name", F.explode(F.when(F.col("value").startswith("{"), boxes).otherwise(F.array("value"))).alias("option"))
    return rows.groupBy("name").agg(F.sort_array(F.collect_set("option")).alias("options"))


def with_option(regions: DataFrame, attribute: str, option: str) -> DataFrame:
    """Regions whose attribute has the option: as its value, or checked in a checkbox."""
    value = F.get(F.filter(F.map_entries("attributes"), lambda e: e["key"] == attribute), F.lit(0))["value"]
    checked = F.from_json(value, "map<string,boolean>")
    return regions.where(F.coalesce((value == option) | F.coalesce(F.when(value.startswith("{"), F.get(F.filter(F.map_entries(checked), lambda e: e["key"] == option), F.lit(0))["value"]), F.lit(False)), F.lit(False)))


def is_url(key: Column) -> Column:
    return key.contains("http")


def region_from_points(points: Column, name: str) -> Column:
    """shape of a region: rect (the bounding box) or polygon."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    if name == "rect":
        return F.struct(F.lit("rect").alias("name"), F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))
    if name == "polygon":
        return F.struct(F.lit("polygon").alias("name"), xs.alias("all_points_x"), ys.alias("all_points_y"))
    raise ValueError(f"no such region: {name}")


def via_key(filename: Column, size: Column) -> Column:
    """An image's key: its name and size, or its address and -1."""
    return F.concat(filename, F.when(is_url(filename), F.lit("-1")).otherwise(size.cast("string")))


def labels_per_image(regions: DataFrame, key: str, label: str) -> DataFrame:
    return regions.groupBy(key).agg(F.array_sort(F.collect_list(label)).alias("labels"))


def via_masks(regions: DataFrame, sizes: DataFrame, attribute: str, contours_only: bool = False, thickness: int = 15) -> DataFrame:
    """filename, label (attribute-option), y, x: the pixels of each option's shapes, filled or (``contours_only``) stroked.

    sizes: filename, height, width; images without such regions have one row with label nolabel and null pixels.
    Shapes that overlap give their pixels once; what lies outside the image is cut off.
    """
    from .functions.text import option_label
    from .operators import raster

    option = F.explode(F.when(F.col("_v").startswith("{"), F.map_keys(F.map_filter(F.from_json("_v", "map<string,boolean>"), lambda k, v: v))).otherwise(F.array("_v")))
    value = F.get(F.filter(F.map_entries("attributes"), lambda e: e["key"] == attribute), F.lit(0))["value"]
    rows = regions.withColumn("_v", value).where(F.col("_v").isNotNull()).withColumn("_o", option)
    rows = rows.withColumn("label", option_label(F.lit(attribute), F.col("_o")))
    keep = ["filename", "label"]
    shapes = rows.where(F.col("points").isNotNull()).select(*keep, "points")
    circles = rows.where(F.col("shape.name") == "circle").select(*keep, F.col("shape.cx").alias("cx"), F.col("shape.cy").alias("cy"), F.col("shape.r").alias("r"))
    area = raster.stroke(shapes, keep, thickness, close=True) if contours_only else raster.fill_polygons(shapes, keep)
    found = area.unionByName(raster.fill_circles(circles, keep)).distinct().join(sizes, "filename").where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width")))
    bare = sizes.join(rows.select("filename"), "filename", "left_anti").select("filename", F.lit("nolabel").alias("label"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x"))
    return found.select("filename", "label", "y", "x").unionByName(bare)


def via_export(shapes: DataFrame, filename: str = "filename", size: str = "size") -> DataFrame:
    """filename, json: one annotation entry {key: {filename, size, regions, file_attributes}} for each image of shapes (``region_from_points`` in column shape, a map in attributes)."""
    region = F.struct(F.col("shape").alias("shape_attributes"), F.col("attributes").alias("region_attributes"))
    grouped = shapes.groupBy(filename, size).agg(F.array_sort(F.collect_list(F.to_json(region))).alias("regions"))
    body = F.concat(F.lit('{"filename":'), F.to_json(F.array(F.col(filename))), F.lit(',"size":'), F.col(size).cast("string"), F.lit(',"regions":['), F.array_join("regions", ","), F.lit('],"file_attributes":{}}'))
    quoted = F.regexp_extract(F.to_json(F.array(via_key(F.col(filename), F.col(size)))), r"^\[(.*)\]$", 1)
    body = F.regexp_replace(body, r'^\{"filename":\[(.*?)\],"size"', r'{"filename":$1,"size"')
    return grouped.select(F.col(filename).alias("filename"), F.concat(F.lit("{"), quoted, F.lit(":"), body, F.lit("}")).alias("json"))


def via_page(regions: DataFrame, sizes: DataFrame, attribute: str) -> DataFrame:
    """Regions to layout documents: a text region for each, its tag from the attribute; sizes: filename, height, width."""
    tag = F.get(F.filter(F.map_entries("attributes"), lambda e: e["key"] == attribute), F.lit(0))["value"]
    custom = F.when(tag.isNotNull(), F.concat(F.lit("structure {type:"), tag, F.lit(";}"))).otherwise("")
    none = F.array().cast("array<struct<id:string,coords:array<struct<x:int,y:int>>,custom_attribute:string,baseline:array<struct<x:int,y:int>>,text:string>>")
    one = F.struct(F.col("points").alias("coords"), custom.alias("custom_attribute"))
    grouped = regions.where(F.col("points").isNotNull()).groupBy("filename").agg(F.array_sort(F.collect_list(one)).alias("rs"))
    built = F.transform("rs", lambda r, i: F.struct(F.concat(F.lit("region_"), i.cast("string")).alias("id"), r["coords"].alias("coords"), r["custom_attribute"].alias("custom_attribute"), none.alias("text_lines")))
    return grouped.join(sizes, "filename").select(F.col("filename").alias("image_filename"), F.col("width").alias("image_width"), F.col("height").alias("image_height"), built.alias("text_regions"))


def canvas_ratio(pages: DataFrame, canvas: tuple[int, int]) -> tuple[Column, Column]:
    """By what a page's places are multiplied to fit a canvas of this height and width: (y, x)."""
    return canvas[0] / F.col("image_height"), canvas[1] / F.col("image_width")


def draw(pages: DataFrame, kind: str, key: str = "image_filename", thickness: int = 1, fill: bool = False, id_has: str = "", canvas: tuple[int, int] | None = None) -> DataFrame:
    """key, y, x: the pixels of a page's lines or regions drawn: kind is baselines, lines, text_regions, graphic_regions, separator_regions or page_border.

    ``id_has``: only lines or regions with that in their ids. ``canvas`` (height, width): places are scaled from the
    page's size to it.
    """
    from .operators import raster

    id_filter = lambda c: F.coalesce(c.contains(id_has), F.lit(not id_has))
    if canvas is not None:
        ratio = F.struct(*[r.alias(a) for r, a in zip(canvas_ratio(pages, canvas), "yx", strict=True)])
        pages = pages.withColumn("_ratio", ratio)
    else:
        pages = pages.withColumn("_ratio", F.struct(F.lit(1.0).alias("y"), F.lit(1.0).alias("x")))
    if kind in ("baselines", "lines"):
        column = "baseline" if kind == "baselines" else "coords"
        shapes = text_lines(pages, [key, "_ratio"]).where(id_filter(F.col("id"))).select(key, "_ratio", F.col(column).alias("points"))
    elif kind == "page_border":
        shapes = pages.select(key, "_ratio", F.col("page_border").alias("points"))
    elif kind in ("text_regions", "graphic_regions", "separator_regions"):
        shapes = pages.select(key, "_ratio", F.explode(kind).alias("r")).where(id_filter(F.col("r.id"))).select(key, "_ratio", F.col("r.coords").alias("points"))
    else:
        raise ValueError(f"can't draw {kind}")
    shapes = shapes.where(F.size("points") > 0)
    shapes = shapes.select(key, scale_points(F.col("points"), F.col("_ratio.y"), F.col("_ratio.x")).alias("points") if canvas else "points")
    if fill and kind != "baselines":
        return raster.fill_polygons(shapes, [key])
    return raster.stroke(shapes, [key], thickness, close=kind != "baselines")


def write_documents(documents: DataFrame, path: str, name: str = "image_filename", body: str = "xml") -> None:
    """A folder for each document under ``path`` with its text in one file; Spark writes them, wherever ``path`` is."""
    documents.select(F.col(name), F.col(body).alias("value")).repartition(name).write.mode("append").partitionBy(name).text(path)


def page_json(columns: list[str]) -> Column:
    """The row's document as JSON, null fields included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def has_keys(attributes: Column, names: list[str]) -> Column:
    """Does the map have all these keys?"""
    return F.size(F.array_except(F.array(*map(F.lit, names)), F.map_keys(attributes))) == 0


def read_via_attributes(spark: SparkSession, path: str) -> DataFrame:
    """name, type, options of the region attributes that a project file defines; options are null for free text."""
    text = spark.read.text(path, wholetext=True)
    found = F.from_json(F.get_json_object("value", "$._via_attributes.region"), "map<string,struct<type:string,options:map<string,string>>>")
    rows = text.select(F.explode(found).alias("name", "a"))
    return rows.select("name", F.col("a.type").alias("type"), F.when(F.col("a.type") != "text", F.map_keys("a.options")).alias("options"))


def working_items(annotations: DataFrame, sizes: DataFrame, collection: str, height: int | None = None, keep_empty: bool = False) -> DataFrame:
    """collection, image_name, original_x, original_y, reduced_x, reduced_y, iiif, regions of annotated images.

    sizes: filename, height, width. Reduced sizes keep the shape at ``height`` pixels; null without it. Images
    without regions are left out unless ``keep_empty``.
    """
    from .operators.resample import reduced_dims

    rows = annotations.join(sizes, "filename")
    rows = rows if keep_empty else rows.where(F.size("regions") > 0)
    small = reduced_dims(F.col("height"), F.col("width"), height) if height else F.lit(None).cast("struct<height:int,width:int>")
    return rows.withColumn("_s", small).select(F.lit(collection).alias("collection"), F.col("filename").alias("image_name"), F.col("width").alias("original_x"), F.col("height").alias("original_y"), F.col("_s.width").alias("reduced_x"), F.col("_s.height").alias("reduced_y"), F.when(is_url(F.col("key")), F.col("filename")).alias("iiif"), "regions")


def regions_of(annotations: DataFrame, filename: str) -> DataFrame:
    """Regions of one image; several entries for it are an error."""
    rows = annotations.where(F.col("filename") == filename)
    alone = F.when(F.count("*").over(W.partitionBy("filename")) <= 1, F.col("regions")).otherwise(F.raise_error(F.lit(f"several entries for {filename}")).cast(_VIA_REGION))
    return via_regions(rows.withColumn("regions", alone))


def annotate_page(pages: DataFrame, thickness: int, key: str = "image_filename", endpoint_radius: int = 3) -> DataFrame:
    """key, y, x, channel: training colours of text lines: baselines (r), line shapes filled (g) and ends of baselines (b)."""
    from .operators import raster

    lines = text_lines(pages, [key])
    base = lines.where(F.size("baseline") > 0)
    red = raster.stroke(base.select(key, F.col("baseline").alias("points")), [key], thickness).withColumn("channel", F.lit("r"))
    green = raster.fill_polygons(lines.select(key, F.col("coords").alias("points")), [key]).withColumn("channel", F.lit("g"))
    ends = base.select(key, F.explode(F.array(F.get("baseline", F.lit(0)), F.element_at("baseline", -1))).alias("p"))
    blue = raster.fill_circles(ends.select(key, F.col("p.x").alias("cx"), F.col("p.y").alias("cy"), F.lit(endpoint_radius).alias("r")), [key]).distinct().withColumn("channel", F.lit("b"))
    return red.unionByName(green).unionByName(blue)
