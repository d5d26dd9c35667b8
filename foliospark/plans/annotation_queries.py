"""Queries on annotations, shapes, strings and documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import annotations as an
from .. import views
from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import raster
from ..operators.components import largest
from ..sources.tables import parse_scores
from ..views import r6, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
_R6 = "floor(({}) * 1000000 + 0.5) / 1000000".format


def query(sql: str | None = None, *used: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *used)
        return f

    return register


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    r = views.regions(spark, d)
    return r.withColumn("attributes", F.create_map(F.lit("flag"), F.col("flag"), F.lit("status"), F.col("status")))


@query("SELECT image_id, x, y, w, h, x || ',' || y || ' ' || (x + w) || ',' || y || ' ' || (x + w) || ',' || (y + h) || ' ' || x || ',' || (y + h) AS points FROM regions", "regions")
def via_regions(spark: SparkSession, d: str) -> DataFrame:
    corners = geo.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return views.regions(spark, d).select("image_id", "x", "y", "w", "h", geo.format_points(corners).alias("points"))


@query("SELECT 'flag' AS name, string_agg(DISTINCT flag, ',' ORDER BY flag) AS options FROM regions UNION ALL SELECT 'status', string_agg(DISTINCT status, ',' ORDER BY status) FROM regions", "regions")
def via_attribute_options(spark: SparkSession, d: str) -> DataFrame:
    return an.attribute_options(_attributed(spark, d)).withColumn("options", F.array_join("options", ","))


@query("SELECT image_id, x, y, w, h FROM regions WHERE flag = 'R'", "regions")
def via_filter_option(spark: SparkSession, d: str) -> DataFrame:
    return an.with_option(_attributed(spark, d), "flag", "R").select("image_id", "x", "y", "w", "h")


@query("SELECT image_id, string_agg(lower('flag-' || flag), ',' ORDER BY flag) AS labels FROM regions GROUP BY image_id", "regions")
def via_labels_per_image(spark: SparkSession, d: str) -> DataFrame:
    labelled = views.regions(spark, d).withColumn("label", tx.option_label(F.lit("flag"), F.col("flag")))
    return an.labels_per_image(labelled, "image_id", "label").withColumn("labels", F.array_join("labels", ","))


_P = "p AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 50 AS x1, l_suppkey % 40 AS y1, l_partkey % 50 + l_linenumber + 3 AS x2, l_suppkey % 40 + 2 AS y2, l_partkey % 50 + 1 AS x3, l_suppkey % 40 + l_linenumber + 5 AS y3 FROM lineitem)"


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    return views.points(spark, d).withColumn("p", geo.parse_points(F.col("points")))


@query(f"WITH {_P} SELECT id, n, 3 AS size, x2::INT AS x2, y3::INT AS y3, x1 || ',' || y1 || ' ' || x2 || ',' || y2 || ' ' || x3 || ',' || y3 AS points FROM p")
def points_parse(spark: SparkSession, d: str) -> DataFrame:
    t = _triangles(spark, d)
    return t.select("id", "n", F.size("p").alias("size"), F.col("p")[1]["x"].alias("x2"), F.col("p")[2]["y"].alias("y3"), geo.format_points(F.col("p")).alias("points"))


@query(f"WITH {_P} SELECT id, n, trunc(x1 * 0.3::DOUBLE)::INT || ',' || trunc(y1 * 1.7::DOUBLE)::INT || ' ' || trunc(x2 * 0.3::DOUBLE)::INT || ',' || trunc(y2 * 1.7::DOUBLE)::INT || ' ' || trunc(x3 * 0.3::DOUBLE)::INT || ',' || trunc(y3 * 1.7::DOUBLE)::INT AS points FROM p")
def points_scale(spark: SparkSession, d: str) -> DataFrame:
    return _triangles(spark, d).select("id", "n", geo.format_points(geo.scale_points(F.col("p"), F.lit(1.7), F.lit(0.3))).alias("points"))


_AREA = "abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y1 - x1 * y3) / 2.0::DOUBLE"


@query(f"WITH {_P} SELECT id, n, {_AREA} AS area FROM p")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    return _triangles(spark, d).select("id", "n", geo.area(F.col("p")).alias("area"))


@query(f"WITH {_P} SELECT id, n, least(x1, 30) || ',' || least(y1, 25) || ' ' || least(x2, 30) || ',' || least(y2, 25) || ' ' || least(x3, 30) || ',' || least(y3, 25) AS points FROM p")
def clip_box(spark: SparkSession, d: str) -> DataFrame:
    return _triangles(spark, d).select("id", "n", geo.format_points(geo.clip(F.col("p"), F.lit(30), F.lit(25))).alias("points"))


@query(f"WITH {_P} SELECT id, n, least(x1, x2, x3)::INT AS x1, greatest(0, least(y1, y2, y3) - 20)::INT AS y1, greatest(x1, x2, x3)::INT AS x2, greatest(y1, y2, y3)::INT AS y2 FROM p")
def polygon_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _triangles(spark, d).select("id", "n", geo.bounds(F.col("p"), 20).alias("b")).select("id", "n", "b.*")


@query(f"WITH {_P} SELECT id, n, {_R6('(x1 + x2 + x3) / 3.0::DOUBLE')} AS cx FROM p WHERE (x1 + x2 + x3) / 3.0::DOUBLE BETWEEN 0.2 * 60 AND 0.8 * 60")
def centroid_filter(spark: SparkSession, d: str) -> DataFrame:
    t = _triangles(spark, d).withColumn("cx", geo.centroid_x(F.col("p")))
    return t.where(F.col("cx").between(0.2 * 60, 0.8 * 60)).select("id", "n", r6(F.col("cx")).alias("cx"))


@query(f"WITH {_P}, r AS (SELECT id, n, {_AREA} AS area, row_number() OVER (PARTITION BY id ORDER BY {_AREA} DESC, n, x1, y1) AS k FROM p) SELECT id, n, area FROM r WHERE k <= 2")
def topk_boxes(spark: SparkSession, d: str) -> DataFrame:
    t = _triangles(spark, d).select("id", "n", geo.area(F.col("p")).alias("area"), F.col("p")[0]["x"].alias("x"), F.col("p")[0]["y"].alias("y"))
    return largest(t, 2, "area", "id", ("n", "x", "y")).select("id", "n", "area")


@query(f"WITH {_P} SELECT id, n, x1 || ',' || y1 || ' ' || x2 || ',' || y2 || ' ' || x3 || ',' || y3 || ' ' || x1 || ',' || y1 AS ring, x1 || ',' || y1 || ' ' || x3 || ',' || y3 AS every_second FROM p")
def ring_and_subsample(spark: SparkSession, d: str) -> DataFrame:
    t = _triangles(spark, d)
    return t.select("id", "n", geo.format_points(geo.close_ring(F.col("p"))).alias("ring"), geo.format_points(geo.every(F.col("p"), 2)).alias("every_second"))


@query(f"WITH {_P} SELECT id, n, least(x1, x2, x3)::INT AS x, least(y1, y2, y3)::INT AS y, (greatest(x1, x2, x3) - least(x1, x2, x3))::INT AS width, (greatest(y1, y2, y3) - least(y1, y2, y3))::INT AS height FROM p")
def via_rect_from_points(spark: SparkSession, d: str) -> DataFrame:
    return _triangles(spark, d).select("id", "n", an.region_from_points(F.col("p"), "rect").alias("s")).select("id", "n", "s.x", "s.y", "s.width", "s.height")


_FILLED = "SELECT DISTINCT image_id, y, unnest(range(x, x + w + 1)) AS x FROM (SELECT image_id, unnest(range(y, y + h + 1)) AS y, x, w FROM regions)"


def _mask_size(runs: DataFrame) -> DataFrame:
    """image_id, pixels and a sum over their places, of the union of an image's shapes."""
    return raster.run_sums(runs, ["image_id"]).select("image_id", F.col("n").alias("pixels"), (F.col("sum_y") * 1000 + F.col("sum_x")).alias("places"))


@query(f"SELECT image_id, count(*) AS pixels, sum(y * 1000 + x)::BIGINT AS places FROM ({_FILLED}) GROUP BY image_id", "regions")
def rect_fill_mask(spark: SparkSession, d: str) -> DataFrame:
    return _mask_size(raster.rectangle_runs(views.regions(spark, d), ["image_id"]))


@query(f"""WITH {_P}, s AS (SELECT DISTINCT id, n, x1, y1, x2, y2, x3, y3 FROM p), e AS (SELECT id, n, x1 AS k1, y1 AS k2, x2 AS k3, y2 AS k4, x3 AS k5, y3 AS k6, unnest([x1, x2, x3]) AS xa, unnest([y1, y2, y3]) AS ya, unnest([x2, x3, x1]) AS xb, unnest([y2, y3, y1]) AS yb FROM s),
 c AS (SELECT id, n, k1, k2, k3, k4, k5, k6, r.y, xa + (r.y - ya) * (xb - xa)::DOUBLE / (yb - ya) AS x FROM e, range(80) r(y) WHERE (ya <= r.y AND yb > r.y) OR (yb <= r.y AND ya > r.y)),
 l AS (SELECT id, n, y, min(x) AS a, max(x) AS b FROM c GROUP BY id, n, k1, k2, k3, k4, k5, k6, y)
 SELECT DISTINCT id, n, y::INT AS y, q.x::INT AS x FROM l, range(80) q(x) WHERE q.x >= ceil(a) AND q.x < ceil(b)""")
def polygon_fill_mask(spark: SparkSession, d: str) -> DataFrame:
    return raster.fill_polygons(_triangles(spark, d).select("id", "n", F.col("p").alias("points")), ["id", "n"])


@query("SELECT image_id, count(*) AS pixels, sum(y * 1000 + x)::BIGINT AS places FROM (SELECT DISTINCT image_id, cy + i AS y, cx + j AS x FROM (SELECT image_id, x AS cx, y AS cy, h - 8 AS r, i, unnest(range(-12, 13)) AS j FROM (SELECT *, unnest(range(-12, 13)) AS i FROM regions)) WHERE i * i + j * j <= r * r) GROUP BY image_id", "regions")
def circle_fill_mask(spark: SparkSession, d: str) -> DataFrame:
    c = views.regions(spark, d).select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("h") - 8).alias("r"))
    return _mask_size(raster.circle_runs(c, ["image_id"]))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as layout documents: a region for each role, a line for each turn."""
    none = F.array().cast(an.POINTS)
    line = F.struct(F.concat(F.lit("line_"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"), none.alias("coords"), F.lit("").alias("custom_attribute"), F.array(F.struct(F.lit(0).alias("x"), (100 - F.col("turn")).cast("int").alias("y"))).alias("baseline"), F.col("text"))
    lines = views.table(spark, d, "conversations").select("conv_id", "role", line.alias("t"))
    regions = lines.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list("t")).alias("text_lines"))
    pages = regions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("region_"), "role").alias("id"), none.alias("coords"), F.lit("").alias("custom_attribute"), "text_lines"))).alias("text_regions"))
    return pages.select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit(".jpg")).alias("image_filename"), F.lit(100).alias("image_width"), F.lit(200).alias("image_height"), "text_regions")


@query("SELECT conv_id, 'region_' || role AS region_id, 'line_' || lpad(turn::VARCHAR, 6, '0') AS id, text FROM conversations")
def page_flatten_lines(spark: SparkSession, d: str) -> DataFrame:
    return an.text_lines(_pages(spark, d), ["conv_id"]).select("conv_id", "region_id", "id", "text")


@query("SELECT conv_id, 'region_' || role AS region_id, string_agg('line_' || lpad(turn::VARCHAR, 6, '0'), ',' ORDER BY turn DESC) AS ids FROM conversations GROUP BY conv_id, role")
def sort_text_lines(spark: SparkSession, d: str) -> DataFrame:
    regions = _pages(spark, d).select("conv_id", F.explode("text_regions").alias("r"))
    ids = F.transform(an.sort_lines(F.col("r.text_lines")), lambda t: t["id"])
    return regions.select("conv_id", F.col("r.id").alias("region_id"), F.array_join(ids, ",").alias("ids"))


_ESC = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""WITH l AS (SELECT conv_id, role, string_agg('<TextLine id="line_' || lpad(turn::VARCHAR, 6, '0') || '"><Baseline points="0,' || (100 - turn) || '"/><TextEquiv><Unicode>' || {_ESC} || '</Unicode></TextEquiv></TextLine>', '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id, role)
 SELECT conv_id, '<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Metadata><Creator>foliospark</Creator><Created>2020-01-01T00:00:00</Created></Metadata><Page imageFilename="' || conv_id || '.jpg" imageWidth="100" imageHeight="200">' || string_agg('<TextRegion id="region_' || role || '">' || t || '</TextRegion>', '' ORDER BY role) || '</Page></PcGts>' AS xml FROM l GROUP BY conv_id""")
def page_xml_string(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("conv_id", an.page_xml("foliospark", "2020-01-01T00:00:00").alias("xml"))


@query()
def page_nest(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d)


@query("SELECT p_partkey, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS tags FROM part GROUP BY p_partkey")
def tag_extract(spark: SparkSession, d: str) -> DataFrame:
    tagged = views.table(spark, d, "part").select("p_partkey", F.concat(F.lit("structure {type:"), "p_type", F.lit(";}")).alias("custom"))
    return tagged.select("p_partkey", F.array_join(tx.tags(F.col("custom")), "|").alias("tags"))


_QUAD = "l_orderkey || '.jpg,' || l_partkey || ',' || l_suppkey || ',' || (l_partkey + 5) || ',' || l_suppkey || ',' || (l_partkey + 5) || ',' || (l_suppkey + 7) || ',' || l_partkey || ',' || (l_suppkey + 7)"


@query(f"SELECT DISTINCT l_orderkey || '.jpg' AS file, l_partkey::INT AS x1, (l_suppkey + 7)::INT AS y3, CASE WHEN l_linenumber % 2 = 0 THEN 'SINGLE' END AS tag, {_QUAD} AS line FROM lineitem")
def quad_parse(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    line = F.concat_ws(",", F.concat(F.col("l_orderkey").cast("string"), F.lit(".jpg")), *[c.cast("string") for c in (p, s, p + 5, s, p + 5, s + 7, p, s + 7)], F.when(F.col("l_linenumber") % 2 == 0, "SINGLE"))
    q = t.select(tx.parse_quad(line).alias("q")).select("q.*").distinct()
    return q.select("file", F.col("quad")[0]["x"].alias("x1"), F.col("quad")[2]["y"].alias("y3"), "tag", tx.format_quad(F.col("file"), F.col("quad")).alias("line"))


@query(f"SELECT o_orderkey || '.xml' AS basename, {_R6('o_totalprice / 1000000')} AS f1, {_R6('o_totalprice / 2000000')} AS p, {_R6('o_totalprice / 3000000')} AS r FROM orders")
def score_report(spark: SparkSession, d: str) -> DataFrame:
    number = lambda k: r6(F.col("o_totalprice") / k).cast("string")
    o = views.table(spark, d, "orders")
    row = F.concat_ws(",", number(2_000_000), number(3_000_000), number(1_000_000), F.lit("truth"), F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"), F.lit(".xml")))
    lines = F.array(F.lit("intro"), F.lit("#P value, #R value, #F_1 value, #TruthFileName, #HypoFileName"), row, F.lit(""), F.lit("1,2,3,4,after"))
    report = o.select(F.col("o_orderkey").cast("string").alias("path"), F.posexplode(lines).alias("n", "value"))
    return parse_scores(report)


@query("SELECT page_id, lower(replace(trim(url), ' ', '_')) AS slug, regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '') AS stem, url LIKE '%http%' AS is_url, CASE WHEN url LIKE '%http%' THEN url || '-1' ELSE url || page_id END AS key FROM pages")
def url_strings(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return views.table(spark, d, "pages").select("page_id", tx.slug(url).alias("slug"), tx.stem(url).alias("stem"), an.is_url(url).alias("is_url"), an.via_key(url, F.col("page_id")).alias("key"))


@query(f"SELECT image_id, count(*) AS pixels, sum(y * 1000 + x)::BIGINT AS places FROM (SELECT image_id, y, x FROM ({_FILLED}) WHERE y < 100 AND x < 100) GROUP BY image_id", "regions")
def pixel_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Masks intersected with a window of a hundred rows and columns."""
    inside = raster.rectangle_runs(views.regions(spark, d), ["image_id"]).where("y < 100 AND left < 100")
    return _mask_size(inside.withColumn("right", F.least("right", F.lit(99))))


@query("SELECT page_id, split_part(url, '/', 3) AS name, 'https://host/iiif/' || split_part(url, '/', 3) || '/info.json' AS info FROM pages")
def iiif_url(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses' hosts as the identifiers of image addresses."""
    url = F.concat(F.lit("https://host/iiif/"), F.get(F.split("url", "/"), F.lit(2)), F.lit("/full/full/0/default.jpg"))
    return views.table(spark, d, "pages").select("page_id", tx.iiif_parts(url).alias("p")).select("page_id", "p.name", "p.info")


@query("SELECT conv_id || '.jpg' AS image_filename, (100 - turn)::INT AS y, 0::INT AS x FROM conversations WHERE 100 - turn >= 0 GROUP BY ALL")
def draw_baselines(spark: SparkSession, d: str) -> DataFrame:
    return an.draw(_pages(spark, d), "baselines")
