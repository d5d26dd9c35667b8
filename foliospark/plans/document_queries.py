"""More queries on documents, drawings and sizes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import annotations as an
from .. import views
from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import labels, losses, pairing, pixels, raster, resample
from ..views import r6, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
_R6 = "floor(({}) * 1000000 + 0.5) / 1000000".format
_P = "p AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 50 AS x1, l_suppkey % 40 AS y1, l_partkey % 50 + l_linenumber + 3 AS x2, l_suppkey % 40 + 2 AS y2, l_partkey % 50 + 1 AS x3, l_suppkey % 40 + l_linenumber + 5 AS y3 FROM lineitem)"


def query(sql: str | None = None, *used: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *used)
        return f

    return register


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    return views.points(spark, d).withColumn("p", geo.parse_points(F.col("points")))


def _pages(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    """Documents with all kinds of regions, of an image's rectangles: text regions for all, separators, graphics and tables for some.

    ``plain``: corners and tags are made in plain columns, which Spark compiles, before the lists; pays where all kinds are read.
    """
    order = ["x", "y", "w", "h", "flag", "status"]
    corners = lambda x, y, w, h: geo.rectangle(x, y, w, h).alias("coords")
    tag = lambda flag: F.concat(F.lit("structure {type:"), flag, F.lit(";}")).alias("custom_attribute")
    flat, made = views.regions(spark, d), []
    if plain:
        flat, made = flat.repartition("image_id"), [corners(*map(F.col, "xywh")), tag(F.col("flag"))]
    rows = flat.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*order, *made))).alias("rs"))
    none = F.array().cast("array<struct<id:string,coords:array<struct<x:int,y:int>>,custom_attribute:string,baseline:array<struct<x:int,y:int>>,text:string>>")

    def shape(r: Column, i: Column, name: str) -> list[Column]:
        return [F.concat(F.lit(f"{name}_"), i.cast("string")).alias("id"), *([r["coords"].alias("coords"), r["custom_attribute"].alias("custom_attribute")] if plain else [corners(r["x"], r["y"], r["w"], r["h"]), tag(r["flag"])])]

    def cell(r: Column) -> Column:
        values = {"row_index": F.lit(0), "col_index": r["h"], "row_span": F.lit(1), "col_span": F.lit(2), "header": r["flag"] == "R", "embedded_text": F.lit(False)}
        return F.struct(F.lit("cell").alias("id"), geo.rectangle(r["x"], r["y"], F.lit(1), F.lit(1)).alias("coords"), F.lit("").alias("custom_attribute"), *[v.alias(k) for k, v in values.items()])

    text = F.transform("rs", lambda r, i: F.struct(*shape(r, i, "text"), F.lit("paragraph").alias("type"), F.concat(r["flag"], F.lit(" & "), r["status"]).alias("text_equiv"), none.alias("text_lines")))
    some = lambda test, build: F.transform(F.filter("rs", test), build)
    return rows.select(
        "image_id", F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("image_filename"), F.lit(250).alias("image_width"), F.lit(300).alias("image_height"), text.alias("text_regions"),
        some(lambda r: r["flag"] == "A", lambda r, i: F.struct(*shape(r, i, "graphic"))).alias("graphic_regions"),
        some(lambda r: r["status"] == "O", lambda r, i: F.struct(*shape(r, i, "separator"))).alias("separator_regions"),
        some(lambda r: r["h"] >= 15, lambda r, i: F.struct(*shape(r, i, "table"), r["h"].alias("rows"), F.lit(2).alias("columns"), F.array(cell(r)).alias("cells"))).alias("table_regions"),
        geo.rectangle(F.lit(0), F.lit(0), F.lit(250), F.col("rs")[0]["y"]).alias("page_border"),
    )


_CORNERS = "x || ',' || y || ' ' || (x + w) || ',' || y || ' ' || (x + w) || ',' || (y + h) || ' ' || x || ',' || (y + h)"


def _region_sql(tag: str, name: str, more: str = "''", inside: str = "''", test: str = "true") -> str:
    body = f"""'<{tag} id="{name}_' || (row_number() OVER (PARTITION BY image_id ORDER BY x, y, w, h, flag, status) - 1) || '" custom="structure {{type:' || flag || ';}}"' || {more} || '><Coords points="' || {_CORNERS} || '"/>' || {inside} || '</{tag}>'"""
    return f"(SELECT image_id, string_agg(t, '' ORDER BY x, y, w, h, flag, status, t) AS t FROM (SELECT *, {body} AS t FROM regions WHERE {test}) GROUP BY image_id)"


_CELL = """'<TableCell id="cell" rowIndex="0" columnIndex="' || h || '" rowSpan="1" colSpan="2" header="' || CASE WHEN flag = 'R' THEN 'true' ELSE 'false' END || '" embText="false"><Coords points="' || x || ',' || y || ' ' || (x + 1) || ',' || y || ' ' || (x + 1) || ',' || (y + 1) || ' ' || x || ',' || (y + 1) || '"/></TableCell>'"""
_SAID = """'<TextEquiv><Unicode>' || flag || ' &amp; ' || status || '</Unicode></TextEquiv>'"""
_PAGE_FROM = f"""FROM (SELECT image_id, arg_min(y, (x, y)) AS first_y FROM regions GROUP BY image_id) b
 JOIN {_region_sql('TextRegion', 'text', "' type=\"paragraph\"'", _SAID)} t ON t.image_id = b.image_id
 LEFT JOIN {_region_sql('GraphicRegion', 'graphic', test="flag = 'A'")} g ON g.image_id = b.image_id
 LEFT JOIN {_region_sql('SeparatorRegion', 'separator', test="status = 'O'")} s ON s.image_id = b.image_id
 LEFT JOIN {_region_sql('TableRegion', 'table', "' rows=\"' || h || '\" columns=\"2\"'", _CELL, 'h >= 15')} k ON k.image_id = b.image_id"""


@query(f"""SELECT b.image_id, '<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{an.NAMESPACE}"><Metadata><Creator>foliospark</Creator><Created>2020-01-01T00:00:00</Created></Metadata><Page imageFilename="' || b.image_id || '.jpg" imageWidth="250" imageHeight="300"><Border><Coords points="0,0 250,0 250,' || first_y || ' 0,' || first_y || '"/></Border>' || t.t || coalesce(g.t, '') || coalesce(s.t, '') || coalesce(k.t, '') || '</Page></PcGts>' AS xml {_PAGE_FROM}""", "regions")
def page_xml_regions(spark: SparkSession, d: str) -> DataFrame:
    """Documents with borders, tagged text regions, graphics, separators and tables."""
    pages = _pages(spark, d, plain=True)
    return pages.select("image_id", an.page_xml("foliospark", "2020-01-01T00:00:00", pages.schema).alias("xml"))


_XY = """'{"x":' || x || ',"y":' || y || '},{"x":' || (x + w) || ',"y":' || y || '},{"x":' || (x + w) || ',"y":' || (y + h) || '},{"x":' || x || ',"y":' || (y + h) || '}'"""


@query(f"""SELECT image_id, '{{"image_filename":"' || image_id || '.jpg","image_width":250,"image_height":300,"separator_regions":[' || coalesce(string_agg(t, ',' ORDER BY x, y, w, h, flag, t) FILTER (WHERE t IS NOT NULL), '') || ']}}' AS json
 FROM (SELECT *, CASE WHEN status = 'O' THEN '{{"id":"separator_' || (row_number() OVER (PARTITION BY image_id, status ORDER BY x, y, w, h, flag) - 1) || '","coords":[' || {_XY} || '],"custom_attribute":"structure {{type:' || flag || ';}}"}}' END AS t FROM regions) GROUP BY image_id""", "regions")
def page_json_string(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("image_id", an.page_json(["image_filename", "image_width", "image_height", "separator_regions"]).alias("json"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY image_id, status ORDER BY x, y, w, h, flag) - 1 AS i FROM regions)
 SELECT DISTINCT image_id, y::INT AS y, q.x::INT AS x FROM (SELECT image_id, (x * 0.5)::DOUBLE AS x, unnest(range(trunc(y * 0.5)::INT, trunc((y + h) * 0.5)::INT)) AS y, trunc(x * 0.5)::INT AS a, trunc((x + w) * 0.5)::INT AS b FROM r WHERE status = 'O' AND i::VARCHAR LIKE '%1%') t, range(200) q(x) WHERE q.x >= a AND q.x < b""", "regions")
def draw_separators(spark: SparkSession, d: str) -> DataFrame:
    """Separators whose ids have a 1, filled, on a canvas of half the page's size."""
    return an.draw(_pages(spark, d), "separator_regions", "image_id", fill=True, id_has="1", canvas=(150, 125))


@query(f"""WITH {_P}, e AS (SELECT id, unnest([x1, x2, x3])::INT AS ax, unnest([y1, y2, y3])::INT AS ay, unnest([x2, x3, x1])::INT AS bx, unnest([y2, y3, y1])::INT AS b_y FROM p),
 c AS (SELECT *, unnest(range(least(ay, b_y) - 2, greatest(ay, b_y) + 3)) AS y FROM e), g AS (SELECT *, unnest(range(least(ax, bx) - 2, greatest(ax, bx) + 3)) AS x FROM c),
 t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(((x - ax) * (bx - ax) + (y - ay) * (b_y - ay))::DOUBLE / nullif((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay), 0), 0.0::DOUBLE))) AS u FROM g)
 SELECT id, count(*) AS n, sum(y)::BIGINT AS sum_y, sum(x)::BIGINT AS sum_x FROM (SELECT DISTINCT id, y, x FROM t WHERE (x - (ax + u * (bx - ax))) * (x - (ax + u * (bx - ax))) + (y - (ay + u * (b_y - ay))) * (y - (ay + u * (b_y - ay))) <= 1.5::DOUBLE * 1.5::DOUBLE) GROUP BY id""")
def stroke_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Closed outlines, three pixels thick: pixels of all of an id's together, and sums of their places."""
    return raster.run_sums(raster.stroke_runs(_triangles(spark, d).select("id", F.col("p").alias("points")), ["id"], 3, close=True), ["id"])


@query("SELECT image_id, sum((a AND b)::INT)::DOUBLE / sum((a OR b)::INT)::DOUBLE AS iou FROM (SELECT prob.image_id, prob.v > 0.4 AS a, (prob.y + prob.x) % 3 > 0 AS b FROM prob) GROUP BY image_id", "prob")
def pixel_iou(spark: SparkSession, d: str) -> DataFrame:
    p = views.prob(spark, d)
    return raster.pixel_iou(pixels.threshold(p, 0.4), p.where("(y + x) % 3 > 0"))


@query("SELECT DISTINCT image_id, y, x FROM (SELECT image_id, y, x FROM prob WHERE v > 0.8 UNION ALL SELECT image_id, y, x FROM prob WHERE y = 3)", "prob")
def mask_union(spark: SparkSession, d: str) -> DataFrame:
    p = views.prob(spark, d)
    return pixels.threshold(p, 0.8).select("image_id", "y", "x").unionByName(p.where("y = 3").select("image_id", "y", "x")).distinct()


@query("SELECT image_id, y // 64 AS band, count(*) AS n, sum(x)::BIGINT AS sum_x FROM (SELECT DISTINCT image_id, y, unnest(range(x, x + w + 1))::INT AS x FROM (SELECT image_id, unnest(range(y, y + h + 1))::INT AS y, x, w FROM regions)) GROUP BY image_id, y // 64", "regions")
def rect_fill_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of pages' rectangles, counted by bands of 64 rows."""
    filled = raster.rectangle_runs(views.regions(spark, d), ["image_id"]).withColumn("band", F.floor(F.col("y") / 64).cast("int"))
    return raster.run_sums(filled, ["image_id", "band"]).select("image_id", "band", "n", "sum_x")


def _sizes(rows: DataFrame) -> DataFrame:
    every = rows.select("image_id").distinct().where("image_id % 4 > 0")
    return every.select("image_id", (F.col("image_id") % 5 + 6).cast("int").alias("height"), (F.col("image_id") % 7 + 5).cast("int").alias("width"))


_TARGETS = "t AS (SELECT DISTINCT image_id, CASE WHEN image_id % 4 > 0 THEN (image_id % 5 + 6)::INT ELSE 8 END AS th, CASE WHEN image_id % 4 > 0 THEN (image_id % 7 + 5)::INT ELSE 8 END AS tw FROM px), g AS (SELECT image_id, th, tw, i::INT AS y, j::INT AS x FROM t, range(12) a(i), range(12) b(j) WHERE i < th AND j < tw)"


@query(f"WITH {_TARGETS} SELECT g.image_id, g.y, g.x, p.v FROM g JOIN px p ON p.image_id = g.image_id AND p.y = g.y * 8 // th AND p.x = g.x * 8 // tw", "px")
def resize_masks_to_originals(spark: SparkSession, d: str) -> DataFrame:
    """Each image to its own size by nearest pixels; those without a size stay as they are."""
    rows = views.px(spark, d)
    return resample.nearest(rows, _sizes(rows))


@query(f"""WITH {_TARGETS}, f AS (SELECT *, y * 8 / th::DOUBLE AS fy, x * 8 / tw::DOUBLE AS fx FROM g),
 c AS (SELECT image_id, y, x, least(floor(fy)::INT + dy, 7) AS sy, least(floor(fx)::INT + dx, 7) AS sx, (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM f, range(2) e(dy), range(2) h(dx))
 SELECT c.image_id, c.y, c.x, {_R6('sum(c.w * p.v)')} AS v FROM c JOIN px p ON p.image_id = c.image_id AND p.y = c.sy AND p.x = c.sx GROUP BY c.image_id, c.y, c.x""", "px")
def resize_predictions_to_originals(spark: SparkSession, d: str) -> DataFrame:
    rows = views.px(spark, d)
    return resample.bilinear(rows, _sizes(rows)).withColumn("v", r6(F.col("v")))


@query(f"WITH {_P} SELECT id, n, trunc(x1 * (300 / 60.0::DOUBLE))::INT AS x, trunc(y2 * (90 / 50.0::DOUBLE))::INT AS y FROM p")
def canvas_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = _triangles(spark, d).withColumns({"image_height": F.lit(50), "image_width": F.lit(60)})
    scaled = geo.scale_points(F.col("p"), *an.canvas_ratio(t, (90, 300)))
    return t.select("id", "n", scaled[0]["x"].alias("x"), scaled[1]["y"].alias("y"))


@query(f"WITH {_P} SELECT id, n, x1 || ',' || y1 || ',' || x2 || ',' || y2 || ',' || x3 || ',' || y3 AS flat, x1::INT AS x, y3::INT AS y FROM p")
def points_as_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = _triangles(spark, d).withColumn("xy", geo.to_xy(F.col("p")))
    back = geo.from_xy(F.transform("xy", lambda a: a[0]), F.transform("xy", lambda a: a[1]))
    return t.select("id", "n", F.array_join(F.transform(F.flatten("xy"), lambda v: v.cast("string")), ",").alias("flat"), back[0]["x"].alias("x"), back[2]["y"].alias("y"))


@query("SELECT image_id, y, x, len(z) + greatest(0, (image_id % 7)::INT - 4) AS size, z[1] AS first FROM logits", "logits")
def pad_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of 4 padded with zeros to between 0 and 6."""
    padded = geo.pad(F.col("z"), (F.col("image_id") % 7).cast("int"))
    return views.logits(spark, d).withColumn("p", padded).select("image_id", "y", "x", F.size("p").alias("size"), F.col("p")[0].alias("first"))


@query("SELECT image_id, y, x, z[1] AS first, z[4] AS last FROM logits", "logits")
def regression_values(spark: SparkSession, d: str) -> DataFrame:
    out = views.logits(spark, d).withColumn("z", labels.decide(F.col("z"), "regression"))
    return out.select("image_id", "y", "x", F.col("z")[0].alias("first"), F.col("z")[3].alias("last"))


@query("""WITH c AS (SELECT r_regionkey AS k, (40 * r_regionkey % 256)::INT AS r, (length(r_name) * 17 % 256)::INT AS g, (90 * (4 - r_regionkey) % 256)::INT AS b FROM region),
 s AS (SELECT m, least(coalesce(sum(r), 0), 255)::INT AS r, least(coalesce(sum(g), 0), 255)::INT AS g, least(coalesce(sum(b), 0), 255)::INT AS b FROM range(32) t(m) LEFT JOIN c ON (m >> c.k::BIGINT) % 2 = 1 GROUP BY m)
 SELECT DISTINCT r, g, b, (r > 0)::INT AS c1, (g > 0)::INT AS c2, (b > 0)::INT AS c3 FROM s""")
def class_table(spark: SparkSession, d: str) -> DataFrame:
    """The palette of all sums of five regions' colours."""
    t = views.table(spark, d, "region")
    colours = t.select((40 * F.col("r_regionkey") % 256).cast("int").alias("r"), (F.length("r_name") * 17 % 256).cast("int").alias("g"), (90 * (4 - F.col("r_regionkey")) % 256).cast("int").alias("b"))
    return spark.createDataFrame(labels.class_table([tuple(c) for c in colours.collect()]), "r int, g int, b int, c1 int, c2 int, c3 int")


@query("SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS text, l_returnflag = 'R' AS flag FROM lineitem")
def boolean_text(spark: SparkSession, d: str) -> DataFrame:
    text = tx.from_boolean(F.col("l_returnflag") == "R")
    return views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), text.alias("text"), tx.to_boolean(F.upper(text)).alias("flag"))


@query("SELECT p_partkey, p_type AS tag, p_partkey || '.jpg' AS image, 'SET_' || p_partkey AS name FROM part")
def names_and_tags(spark: SparkSession, d: str) -> DataFrame:
    """The one tag of an attribute, image names without what follows .jpg, names of sets."""
    key = F.col("p_partkey").cast("string")
    custom = F.concat(F.lit("structure {type:"), "p_type", F.lit(";}"))
    return views.table(spark, d, "part").select("p_partkey", tx.one_tag(custom).alias("tag"), tx.image_name(F.concat(key, F.lit(".jpg"), key)).alias("image"), tx.set_name(F.concat(F.lit("data/set/"), key, F.lit(".xml"))).alias("name"))


@query("SELECT o_custkey, max('exports/' || o_custkey || '/' || o_orderdate::VARCHAR) AS path FROM orders GROUP BY o_custkey")
def latest_export(spark: SparkSession, d: str) -> DataFrame:
    paths = views.table(spark, d, "orders").select("o_custkey", F.concat(F.lit("exports/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderdate").cast("string")).alias("path"))
    return pairing.latest(paths, ["o_custkey"])


@query("SELECT image_id, x, y, status = 'O' AS has FROM regions", "regions")
def key_subset(spark: SparkSession, d: str) -> DataFrame:
    """Do attributes have the keys file and region?"""
    keys = F.when(F.col("status") == "O", F.create_map(F.lit("file"), "flag", F.lit("region"), "status", F.lit("more"), "flag")).otherwise(F.create_map(F.lit("file"), "flag"))
    return views.regions(spark, d).select("image_id", "x", "y", an.has_keys(keys, ["file", "region"]).alias("has"))


@query("SELECT 'out/' || o.o_orderkey || '.npy' AS image, CASE WHEN c.c_custkey IS NOT NULL THEN 'truth/page/' || c.c_custkey || '.xml' END AS label FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_orderkey")
def pair_truth(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with the truth of the same name; null where it is missing."""
    of = lambda c, a, b: F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b)).alias("path")
    truth = views.table(spark, d, "customer").select(of("c_custkey", "truth/page/", ".xml"))
    return pairing.pair_labels(views.table(spark, d, "orders").select(of("o_orderkey", "out/", ".npy")), truth)


@query(f"""WITH {_P}, s AS (SELECT id, trunc(x1 * 0.5::DOUBLE)::INT AS x1, trunc(y1 * 0.5::DOUBLE)::INT AS y1, trunc(x2 * 0.5::DOUBLE)::INT AS x2, trunc(y2 * 0.5::DOUBLE)::INT AS y2, trunc(x3 * 0.5::DOUBLE)::INT AS x3, trunc(y3 * 0.5::DOUBLE)::INT AS y3 FROM p),
 l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x1, y1, x2, y2, x3, y3) - 1 AS i FROM s)
 SELECT id AS image_filename, 40 AS image_width, 50 AS image_height, string_agg('line_' || i || ':' || x1 || ',' || y1 || ' ' || x2 || ',' || y2 || ' ' || x3 || ',' || y3, ';' ORDER BY i) AS lines FROM l GROUP BY id""")
def baselines_page(spark: SparkSession, d: str) -> DataFrame:
    """Found lines as documents, at half their size."""
    lines = _triangles(spark, d).select(F.col("id").cast("string").alias("id"), F.col("p").alias("points"), F.lit(100).alias("height"), F.lit(80).alias("width"))
    pages = an.baselines_page(lines, "id", 0.5)
    found = F.transform(F.col("text_regions")[0]["text_lines"], lambda t: F.concat(t["id"], F.lit(":"), geo.format_points(t["baseline"])))
    return pages.select(F.col("image_filename").cast("long").alias("image_filename"), "image_width", "image_height", F.array_join(found, ";").alias("lines"))


@query(f"""WITH {_P}, s AS (SELECT id, '{{"shape_attributes":{{"name":"rect","x":' || least(x1, x2, x3) || ',"y":' || least(y1, y2, y3) || ',"width":' || (greatest(x1, x2, x3) - least(x1, x2, x3)) || ',"height":' || (greatest(y1, y2, y3) - least(y1, y2, y3)) || '}},"region_attributes":{{"n":"' || n || '"}}}}' AS t FROM p)
 SELECT id || '.jpg' AS filename, '{{"' || id || '.jpg' || (id * 10) || '":{{"filename":"' || id || '.jpg","size":' || (id * 10) || ',"regions":[' || string_agg(t, ',' ORDER BY t) || '],"file_attributes":{{}}}}}}' AS json FROM s GROUP BY id""")
def via_export(spark: SparkSession, d: str) -> DataFrame:
    t = _triangles(spark, d)
    shapes = t.select(F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("filename"), (F.col("id") * 10).alias("size"), an.region_from_points(F.col("p"), "rect").alias("shape"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("attributes"))
    return an.via_export(shapes)


@query("SELECT 'all' AS collection, image_id || '.jpg' AS image_name, 1000 AS original_x, 2000 AS original_y, 250 AS reduced_x, 500 AS reduced_y, count(*) AS regions FROM regions WHERE flag = 'R' GROUP BY image_id", "regions")
def working_items(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("filename")
    rows = views.regions(spark, d).groupBy("image_id").agg(F.collect_list(F.when(F.col("flag") == "R", F.struct("x", "y"))).alias("regions")).select(name, name.alias("key"), "regions")
    out = an.working_items(rows, rows.select("filename", F.lit(2000).alias("height"), F.lit(1000).alias("width")), "all", 500)
    return out.select("collection", "image_name", "original_x", "original_y", "reduced_x", "reduced_y", F.size("regions").cast("long").alias("regions"))


_FILLED = f"""{_P}, s AS (SELECT DISTINCT id, x1, y1, x2, y2, x3, y3 FROM p), e AS (SELECT id, x1 AS k1, y1 AS k2, x2 AS k3, y2 AS k4, x3 AS k5, y3 AS k6, unnest([x1, x2, x3]) AS xa, unnest([y1, y2, y3]) AS ya, unnest([x2, x3, x1]) AS xb, unnest([y2, y3, y1]) AS yb FROM s),
 c AS (SELECT id, k1, k2, k3, k4, k5, k6, r.y, xa + (r.y - ya) * (xb - xa)::DOUBLE / (yb - ya) AS x FROM e, range(80) r(y) WHERE (ya <= r.y AND yb > r.y) OR (yb <= r.y AND ya > r.y)),
 l AS (SELECT id, y, min(x) AS a, max(x) AS b FROM c GROUP BY id, k1, k2, k3, k4, k5, k6, y),
 f AS (SELECT DISTINCT id, y::INT AS y, q.x::INT AS x FROM l, range(80) q(x) WHERE q.x >= ceil(a) AND q.x < ceil(b))"""


@query(f"WITH {_FILLED}, g AS (SELECT id, y, x + 2 AS x FROM f) SELECT coalesce(f.id, g.id) AS id, count(f.id + g.id)::DOUBLE / count(*) AS iou FROM f FULL JOIN g ON g.id = f.id AND g.y = f.y AND g.x = f.x GROUP BY coalesce(f.id, g.id)")
def polygon_iou(spark: SparkSession, d: str) -> DataFrame:
    """Polygons as pixels against the same ones two pixels to the right."""
    t = _triangles(spark, d).select("id", F.col("p").alias("points"))
    moved = t.select("id", F.transform("points", lambda q: F.struct((q["x"] + 2).alias("x"), q["y"].alias("y"))).alias("points"))
    return raster.polygon_set_iou(t, moved, "id")


@query(f"SELECT image_id % 16 AS batch, {_R6('avg(v)')} AS loss FROM (SELECT image_id, avg(v) AS v FROM prob WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY image_id) GROUP BY image_id % 16", "prob")
def batch_loss(spark: SparkSession, d: str) -> DataFrame:
    """Means over images without their margins, then over batches."""
    images = losses.masked_mean(views.prob(spark, d).withColumnRenamed("v", "loss"), 2)
    return losses.batch_mean(images.withColumn("batch", F.col("image_id") % 16)).withColumn("loss", r6(F.col("loss")))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x, y, w, h, flag) - 1 AS i FROM (SELECT DISTINCT image_id, x, y, w, h, flag FROM regions))
 SELECT image_id, '<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{an.NAMESPACE}"><Metadata><Creator>foliospark</Creator><Created>2020</Created></Metadata><Page imageFilename="' || image_id || '" imageWidth="250" imageHeight="300">' || string_agg('<TextRegion id="region_' || i || '" custom="structure {{type:' || flag || ';}}"><Coords points="' || {_CORNERS} || '"/></TextRegion>', '' ORDER BY i) || '</Page></PcGts>' AS xml FROM r GROUP BY image_id""", "regions")
def via_page(spark: SparkSession, d: str) -> DataFrame:
    """Annotated rectangles as documents, tags and all."""
    rows = views.regions(spark, d).select("image_id", "x", "y", "w", "h", "flag").distinct()
    regions = rows.select(F.col("image_id").cast("string").alias("filename"), geo.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("points"), F.create_map(F.lit("kind"), F.col("flag")).alias("attributes"))
    sizes = rows.select(F.col("image_id").cast("string").alias("filename"), F.lit(300).alias("height"), F.lit(250).alias("width")).distinct()
    pages = an.via_page(regions, sizes, "kind")
    return pages.select(F.col("image_filename").cast("long").alias("image_id"), an.page_xml("foliospark", "2020", pages.schema).alias("xml"))
