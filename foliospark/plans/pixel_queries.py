"""Queries on pixel relations, each with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions.geometry import format_points
from ..operators import components as cc
from ..operators import pixels as px
from ..operators import resample, tiling, vectorize
from ..operators import windows as win
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


def bins(spark: SparkSession, d: str) -> DataFrame:
    return views.prob(spark, d).select("image_id", "y", "x", px.quantise(F.col("v")).alias("bin"))


_BINS = "SELECT image_id, y, x, floor(v * 255)::INT AS bin FROM prob"


@query("SELECT image_id, y, x, z[2] AS v FROM logits", "logits")
def channel_select(spark: SparkSession, d: str) -> DataFrame:
    return px.channel(views.logits(spark, d), 1).select("image_id", "y", "x", "v")


@query(f"SELECT image_id, y, x, {_R6('v / nullif(max(v) OVER (PARTITION BY image_id), 0)')} AS v FROM px", "px")
def max_normalise(spark: SparkSession, d: str) -> DataFrame:
    return px.max_normalise(views.px(spark, d)).withColumn("v", r6(F.col("v")))


@query(f"SELECT image_id, y, x, floor(v * 255)::INT AS q, {_R6('floor(v * 255) / 255.0::DOUBLE')} AS p FROM prob", "prob")
def quantise(spark: SparkSession, d: str) -> DataFrame:
    out = views.prob(spark, d).withColumn("q", px.quantise(F.col("v")))
    return out.select("image_id", "y", "x", "q", r6(px.dequantise(F.col("q"))).alias("p"))


@query(f"SELECT image_id, y, x, {_R6('r - 123.68::DOUBLE')} AS r, {_R6('g - 116.78::DOUBLE')} AS g, {_R6('b - 103.94::DOUBLE')} AS b FROM rgb", "rgb")
def mean_subtract(spark: SparkSession, d: str) -> DataFrame:
    return px.subtract_means(views.rgb(spark, d)).withColumns({c: r6(F.col(c)) for c in "rgb"})


@query(f"SELECT image_id, y, x, {_R6('r / 255.0::DOUBLE')} AS r, {_R6('g / 255.0::DOUBLE')} AS g, {_R6('b / 255.0::DOUBLE')} AS b FROM rgb", "rgb")
def scale_unit(spark: SparkSession, d: str) -> DataFrame:
    return px.scale_unit(views.rgb(spark, d)).withColumns({c: r6(F.col(c)) for c in "rgb"})


@query("SELECT image_id, y, x FROM prob WHERE v > 0.7", "prob")
def fixed_threshold(spark: SparkSession, d: str) -> DataFrame:
    return px.threshold(views.prob(spark, d), 0.7).select("image_id", "y", "x")


_LEVELS = """c AS (SELECT image_id, bin AS t, count(*) AS n FROM b GROUP BY image_id, bin),
 s AS (SELECT image_id, t, sum(n) OVER w AS n0, sum(n * t) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS n, sum(n * t) OVER (PARTITION BY image_id) AS s FROM c WINDOW w AS (PARTITION BY image_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
 v AS (SELECT image_id, t, CASE WHEN n0 < n THEN (s * n0 - s0 * n)::DOUBLE * (s * n0 - s0 * n)::DOUBLE / (n0 * (n - n0))::DOUBLE ELSE 0.0 END AS bv FROM s),
 o AS (SELECT image_id, t FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY bv DESC, t) AS k FROM v) WHERE k = 1)"""
_OTSU = f"b AS ({_BINS}), {_LEVELS}"


@query(f"WITH {_OTSU} SELECT image_id, t::BIGINT AS t FROM o", "prob")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return px.otsu_thresholds(bins(spark, d))


def page_mask(spark: SparkSession, d: str) -> DataFrame:
    """Quantised, blurred by five weights and rounded, parted by Otsu's level, opened and closed: all pixels with v 0 or 1."""
    b = win.gaussian(bins(spark, d).withColumnRenamed("bin", "v")).select("image_id", "y", "x", F.floor(F.col("v") + 0.5).cast("int").alias("bin"))
    levels = px.otsu_thresholds(b)
    mask = b.join(levels, "image_id").select("image_id", "y", "x", (F.col("bin") > F.col("t")).cast("int").alias("v"))
    return win.open_close(mask, 3)


def _sep(name: str, source: str, agg: str) -> str:
    w = "(PARTITION BY image_id, {} ORDER BY {} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return f"{name}a AS (SELECT image_id, y, x, {agg}(v) OVER {w.format('x', 'y')} AS v FROM {source}), {name} AS (SELECT image_id, y, x, {agg}(v) OVER {w.format('y', 'x')} AS v FROM {name}a)"


def _blur_sql(source: str, weights) -> str:
    r = len(weights) // 2

    def at(axis: str, k: int) -> str:
        return f"CASE WHEN ({axis} + {k}) % 14 < 0 THEN ({axis} + {k}) % 14 + 14 ELSE ({axis} + {k}) % 14 END"

    def step(name: str, src: str, axis: str, other: str) -> str:
        taps = " UNION ALL ".join(f"SELECT image_id, {other}, {axis}, least({at(axis, k)}, 14 - ({at(axis, k)})) AS s, {w!r}::DOUBLE AS w FROM {src}" for k, w in zip(range(-r, r + 1), weights, strict=True))
        return f"{name}t AS ({taps}), {name} AS (SELECT t.image_id, t.{other}, t.{axis}, sum(t.w * p.v) AS v FROM {name}t t JOIN {src} p ON p.image_id = t.image_id AND p.{other} = t.{other} AND p.{axis} = t.s GROUP BY t.image_id, t.{other}, t.{axis})"

    return f"{step('g1', source, 'y', 'x')}, {step('g2', 'g1', 'x', 'y')}"


_MASK = f"b0 AS (SELECT image_id, y, x, floor(v * 255) AS v FROM prob), {_blur_sql('b0', win.GAUSS5)}, b AS (SELECT image_id, y, x, floor(v + 0.5)::INT AS bin FROM g2), {_LEVELS}, m0 AS (SELECT b.image_id, y, x, (bin > t)::INT AS v FROM b JOIN o ON b.image_id = o.image_id), {_sep('m1', 'm0', 'min')}, {_sep('m2', 'm1', 'max')}, {_sep('m3', 'm2', 'max')}, {_sep('m4', 'm3', 'min')}"


@query(f"WITH {_MASK} SELECT image_id, y, x, v FROM m4", "prob")
def open_close(spark: SparkSession, d: str) -> DataFrame:
    return page_mask(spark, d)


@query(f"WITH {_blur_sql('prob', win.GAUSS5)} SELECT image_id, y, x, floor(v * 1000000 + 0.501::DOUBLE) / 1000000 AS v FROM g2", "prob")
def gaussian5(spark: SparkSession, d: str) -> DataFrame:
    """Sums are multiples of 1e-6 / 256, so they are rounded away from where halves would tie."""
    return win.gaussian(views.prob(spark, d)).withColumn("v", F.floor(F.col("v") * 1_000_000 + 0.501) / 1_000_000)


@query(f"WITH {_blur_sql('prob', win.gaussian_weights(1.5))} SELECT image_id, y, x, {_R6('v')} AS v FROM g2", "prob")
def gaussian_sigma(spark: SparkSession, d: str) -> DataFrame:
    return win.gaussian(views.prob(spark, d), 1.5).withColumn("v", r6(F.col("v")))


@query("SELECT image_id, y, x, coalesce((v >= lag(v) OVER w AND v >= lead(v) OVER w)::INT, 0) AS v_max FROM prob WINDOW w AS (PARTITION BY image_id, x ORDER BY y)", "prob")
def vertical_maxima(spark: SparkSession, d: str) -> DataFrame:
    return win.vertical_maxima(views.prob(spark, d)).select("image_id", "y", "x", "v_max")


@query(f"WITH m0 AS (SELECT image_id, y, x, (v > 0.7)::INT AS v FROM prob), {_sep('m1', 'm0', 'sum')} SELECT m0.image_id, m0.y, m0.x FROM m0 JOIN m1 ON m0.image_id = m1.image_id AND m0.y = m1.y AND m0.x = m1.x WHERE m0.v = 1 AND m1.v = 2", "prob")
def box_sum_endpoints(spark: SparkSession, d: str) -> DataFrame:
    mask = views.prob(spark, d).select("image_id", "y", "x", (F.col("v") > 0.7).cast("int").alias("v"))
    return win.line_ends(mask)


def _components(source: str) -> str:
    """Components of a mask relation: each pixel's least reachable place."""
    return f"""n AS (SELECT a.image_id, a.y * 100 + a.x AS a, b.y * 100 + b.x AS b FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 r AS (SELECT image_id, y * 100 + x AS p, y * 100 + x AS q FROM {source} UNION SELECT r.image_id, r.p, n.b FROM r JOIN n ON n.image_id = r.image_id AND n.a = r.q),
 l AS (SELECT image_id, p, min(q) AS c FROM r GROUP BY image_id, p)"""


def _rec(sql: str, *used: str) -> str:
    return with_views(sql, *used).replace("WITH ", "WITH RECURSIVE ", 1)


def _flat(labelled: DataFrame) -> DataFrame:
    return labelled.select("image_id", "y", "x", F.col("component.cy").alias("cy"), F.col("component.cx").alias("cx"))


@query()
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return _flat(cc.label_images(px.threshold(views.prob(spark, d), 0.7)))


SQL["connected_components"] = _rec(f"WITH m AS (SELECT image_id, y, x FROM prob WHERE v > 0.7), {_components('m')} SELECT image_id, (p // 100)::INT AS y, (p % 100)::INT AS x, (c // 100)::INT AS cy, (c % 100)::INT AS cx FROM l", "prob")


@query()
def connected_components_tiled(spark: SparkSession, d: str) -> DataFrame:
    from ..checkpoints import ensure

    ensure(spark)
    return _flat(cc.label_tiled(px.threshold(views.prob(spark, d), 0.7), tile=4))


SQL["connected_components_tiled"] = SQL["connected_components"]


@query()
def hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return cc.hysteresis(views.prob(spark, d), 0.6, 0.9).select("image_id", "y", "x")


SQL["hysteresis"] = _rec(f"WITH m AS (SELECT image_id, y, x, v FROM prob WHERE v > 0.6), {_components('m')}, s AS (SELECT DISTINCT l.image_id, c FROM l JOIN m ON m.image_id = l.image_id AND m.y * 100 + m.x = l.p WHERE m.v > 0.9) SELECT l.image_id, (p // 100)::INT AS y, (p % 100)::INT AS x FROM l JOIN s ON s.image_id = l.image_id AND s.c = l.c", "prob")


@query()
def remove_border_component(spark: SparkSession, d: str) -> DataFrame:
    labelled = cc.label_images(px.threshold(views.prob(spark, d), 0.7))
    sizes = labelled.select("image_id").distinct().select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"))
    return cc.drop_border_components(labelled, sizes, 1).select("image_id", "y", "x")


SQL["remove_border_component"] = _rec(f"WITH m AS (SELECT image_id, y, x FROM prob WHERE v > 0.7), {_components('m')}, g AS (SELECT DISTINCT image_id, c FROM l WHERE p // 100 IN (0, 7) OR p % 100 IN (0, 7)) SELECT l.image_id, (p // 100)::INT AS y, (p % 100)::INT AS x FROM l LEFT JOIN g ON g.image_id = l.image_id AND g.c = l.c WHERE g.c IS NULL", "prob")

_BOXES = f"{_components('m')}, k AS (SELECT image_id, c, min(p % 100) AS x, min(p // 100) AS y, max(p % 100) - min(p % 100) + 1 AS w, max(p // 100) - min(p // 100) + 1 AS h, count(*) AS n FROM l GROUP BY image_id, c)"


@query()
def boxes_rectangle(spark: SparkSession, d: str) -> DataFrame:
    found = cc.boxes(cc.label_images(px.threshold(views.prob(spark, d), 0.7)))
    return found.where(F.col("w") * F.col("h") > 0.05 * 64).select("image_id", "x", "y", "w", "h", "pixels")


SQL["boxes_rectangle"] = _rec(f"WITH m AS (SELECT image_id, y, x FROM prob WHERE v > 0.7), {_BOXES} SELECT image_id, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h, n::BIGINT AS pixels FROM k WHERE w * h > 0.05 * 64", "prob")


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Page extraction end to end: each image's largest box of the cleaned mask, as a document."""
    found = cc.boxes(cc.label_images(page_mask(spark, d).where("v = 1")))
    top = cc.largest(found.withColumn("area", F.col("w") * F.col("h")).where(F.col("area") > 0.1 * 64), 1)
    quad = F.concat_ws(" ", *[F.concat_ws(",", a, b) for a, b in ((F.col("x"), F.col("y")), (F.col("x") + F.col("w"), F.col("y")), (F.col("x") + F.col("w"), F.col("y") + F.col("h")), (F.col("x"), F.col("y") + F.col("h")))])
    return top.select("image_id", quad.alias("border"), F.col("area").cast("int").alias("area"), F.lit(8).alias("image_width"), F.lit(8).alias("image_height"))


@query()
def page_extraction(spark: SparkSession, d: str) -> DataFrame:
    return page_boxes(spark, d)


SQL["page_extraction"] = _rec(f"""WITH {_MASK}, m AS (SELECT image_id, y, x FROM m4 WHERE v = 1), {_BOXES},
 t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, y, x) AS rn FROM k WHERE w * h > 0.1 * 64)
 SELECT image_id, x || ',' || y || ' ' || (x + w) || ',' || y || ' ' || (x + w) || ',' || (y + h) || ' ' || x || ',' || (y + h) AS border, (w * h)::INT AS area, 8::INT AS image_width, 8::INT AS image_height FROM t WHERE rn = 1""", "prob")


def _rectangles(share: float, scale: int = 1) -> str:
    """Of an image ``scale`` times as large as m, with pixels repeated: smallest rectangles of the components of m: each lies on an edge of the hull; of equal ones that of the first edge, from the leftmost point on."""
    return f"""{_components('m')}, e AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM m GROUP BY image_id),
 q AS (SELECT DISTINCT image_id, c, x, y * {scale} + i AS y FROM (SELECT image_id, c, unnest([min(p % 100) * {scale}, max(p % 100) * {scale} + {scale - 1}]) AS x, p // 100 AS y FROM l GROUP BY image_id, c, p // 100), range({scale}) a(i)),
 ab AS (SELECT a.image_id, a.c, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM q a JOIN q b ON a.image_id = b.image_id AND a.c = b.c AND (a.x, a.y) <> (b.x, b.y)),
 ed AS (SELECT ab.*, min(q.x * dx + q.y * dy) AS s0, max(q.x * dx + q.y * dy) AS s1, min(q.y * dx - q.x * dy) AS t0, max(q.y * dx - q.x * dy) AS t1, dx * dx + dy * dy AS n
        FROM ab JOIN q ON q.image_id = ab.image_id AND q.c = ab.c GROUP BY ALL
        HAVING bool_and(dx * (q.y - ay) - dy * (q.x - ax) > 0 OR (dx * (q.y - ay) - dy * (q.x - ax) = 0 AND (q.x - ax) * dx + (q.y - ay) * dy BETWEEN 0 AND dx * dx + dy * dy)) AND max(dx * (q.y - ay) - dy * (q.x - ax)) > 0),
 rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, c ORDER BY round((s1 - s0) * (t1 - t0)::DOUBLE / n, 6), CASE WHEN atan2(dy, dx) <= -1.5707963 THEN atan2(dy, dx) + 6.2831853 ELSE atan2(dy, dx) END) AS k FROM ed),
 cs AS (SELECT image_id, c, floor((dx * s0 - dy * t0)::DOUBLE / n + 1e-9)::INT AS x1, floor((dy * s0 + dx * t0)::DOUBLE / n + 1e-9)::INT AS y1, floor((dx * s1 - dy * t0)::DOUBLE / n + 1e-9)::INT AS x2, floor((dy * s1 + dx * t0)::DOUBLE / n + 1e-9)::INT AS y2,
        floor((dx * s1 - dy * t1)::DOUBLE / n + 1e-9)::INT AS x3, floor((dy * s1 + dx * t1)::DOUBLE / n + 1e-9)::INT AS y3, floor((dx * s0 - dy * t1)::DOUBLE / n + 1e-9)::INT AS x4, floor((dy * s0 + dx * t1)::DOUBLE / n + 1e-9)::INT AS y4 FROM rk WHERE k = 1),
 ar AS (SELECT cs.*, h, w, abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2.0::DOUBLE AS area FROM cs JOIN e ON e.image_id = cs.image_id),
 bx AS (SELECT image_id, area, {" || ' ' || ".join(f"greatest(0, least(w, x{i})) || ',' || greatest(0, least(h, y{i}))" for i in (1, 2, 3, 4))} AS corners FROM ar WHERE area > {share} * h * w)"""


@query()
def boxes_min_rectangle(spark: SparkSession, d: str) -> DataFrame:
    found = vectorize.find_boxes(px.threshold(views.prob(spark, d), 0.7), "min_rectangle", 0.05)
    return found.select("image_id", format_points(F.col("points")).alias("corners"), "area")


SQL["boxes_min_rectangle"] = _rec(f"WITH m AS (SELECT image_id, y, x FROM prob WHERE v > 0.7), {_rectangles(0.05)} SELECT image_id, corners, area FROM bx", "prob")


@query()
def page_quads(spark: SparkSession, d: str) -> DataFrame:
    """Page extraction with rotated boxes: the cleaned mask, back at the page's own size (three times as large), and its largest smallest-area rectangle."""
    mask = page_mask(spark, d)
    sizes = mask.select("image_id").distinct().select("image_id", F.lit(24).alias("height"), F.lit(24).alias("width"))
    whole = resample.nearest(mask, sizes).where("v = 1")
    return vectorize.find_boxes(whole, "min_rectangle", 0.1, sizes, n_max=1).select("image_id", "area")


SQL["page_quads"] = _rec(f"WITH {_MASK}, m AS (SELECT image_id, y, x FROM m4 WHERE v = 1), {_rectangles(0.1, 3).replace('max(y) + 1 AS h, max(x) + 1 AS w', '24 AS h, 24 AS w')} SELECT image_id, max(area) AS area FROM bx GROUP BY image_id", "prob")


@query()
def boxes_quadrilateral(spark: SparkSession, d: str) -> DataFrame:
    return vectorize.find_boxes(px.threshold(views.prob(spark, d), 0.5), "quadrilateral", 0.02)


@query()
def polygons(spark: SparkSession, d: str) -> DataFrame:
    return vectorize.find_polygons(px.threshold(views.prob(spark, d), 0.6), 0.02, n_max=3)


#: Areas of outer contours through pixel centres: of a component with its holes filled, squares of four pixels count 1, of three one half.
_AREAS = f"""m AS (SELECT image_id, y, x FROM prob WHERE v > 0.6), {_components('m')}, e AS (SELECT image_id, (max(y) + 1) * (max(x) + 1) AS size FROM m GROUP BY image_id),
 s AS (SELECT image_id, c, p // 100 AS y, p % 100 AS x FROM l), g AS (SELECT image_id, c, i AS y, j AS x FROM (SELECT DISTINCT image_id, c FROM l), range(-1, 9) a(i), range(-1, 9) b(j)),
 o AS (SELECT g.* FROM g LEFT JOIN s ON s.image_id = g.image_id AND s.c = g.c AND s.y = g.y AND s.x = g.x WHERE s.c IS NULL),
 f AS (SELECT image_id, c, y, x FROM o WHERE y = -1 AND x = -1 UNION SELECT o.image_id, o.c, o.y, o.x FROM f JOIN o ON o.image_id = f.image_id AND o.c = f.c AND abs(o.y - f.y) + abs(o.x - f.x) = 1),
 d AS (SELECT g.* FROM g LEFT JOIN f ON f.image_id = g.image_id AND f.c = g.c AND f.y = g.y AND f.x = g.x WHERE f.c IS NULL),
 k AS (SELECT image_id, c, y - i AS y, x - j AS x, count(*) AS n FROM d, range(2) a(i), range(2) b(j) GROUP BY image_id, c, y - i, x - j),
 t AS (SELECT k.image_id, c, size, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS area FROM k JOIN e ON e.image_id = k.image_id GROUP BY k.image_id, c, size)"""


@query()
def polygon_areas(spark: SparkSession, d: str) -> DataFrame:
    """First corners and areas of all outer contours of more than two hundredths of the image."""
    found = vectorize.find_polygons(px.threshold(views.prob(spark, d), 0.6), 0.02)
    return found.select("image_id", F.col("points")[0]["y"].alias("y"), F.col("points")[0]["x"].alias("x"), "area")


SQL["polygon_areas"] = _rec(f"WITH {_AREAS} SELECT image_id, (c // 100)::INT AS y, (c % 100)::INT AS x, area FROM t WHERE area > 0.02 * size", "prob")


@query()
def polygon_areas_top(spark: SparkSession, d: str) -> DataFrame:
    """Area of the largest polygon of each image, by component."""
    labelled = cc.label_images(px.threshold(views.prob(spark, d), 0.6))
    return vectorize.find_polygons(labelled, 0.02, n_max=1).select("image_id", "area")


SQL["polygon_areas_top"] = _rec(f"WITH {_AREAS} SELECT image_id, area FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC) AS r FROM t WHERE area > 0.02 * size) WHERE r = 1", "prob")


@query()
def skeleton_lines(spark: SparkSession, d: str) -> DataFrame:
    return vectorize.find_lines(px.threshold(views.prob(spark, d), 0.6))


@query()
def line_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Blur, hysteresis among closed vertical maxima, centre lines."""
    blurred = win.gaussian(views.prob(spark, d), 0.7)
    near = win.closed(win.vertical_maxima(blurred).withColumn("v", F.col("v_max")), 5).where("v = 1")
    return vectorize.find_lines(cc.hysteresis(blurred, 0.5, 0.7, candidates=near))


@query()
def hysteresis_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Hysteresis among vertical maxima that are closed by 5 x 5."""
    p = views.prob(spark, d)
    near = win.closed(win.vertical_maxima(p).withColumn("v", F.col("v_max")), 5).where("v = 1")
    return cc.hysteresis(p, 0.5, 0.8, candidates=near).select("image_id", "y", "x")


SQL["hysteresis_candidates"] = _rec(f"""WITH m0 AS (SELECT image_id, y, x, coalesce((v >= lag(v) OVER w AND v >= lead(v) OVER w)::INT, 0) AS v FROM prob WINDOW w AS (PARTITION BY image_id, x ORDER BY y)),
 {_sep('m1', 'm0', 'max')}, {_sep('m2', 'm1', 'max')}, {_sep('m3', 'm2', 'min')}, {_sep('m4', 'm3', 'min')},
 m AS (SELECT p.image_id, p.y, p.x, p.v FROM prob p JOIN m4 ON m4.image_id = p.image_id AND m4.y = p.y AND m4.x = p.x WHERE m4.v = 1 AND p.v > 0.5), {_components('m')},
 s AS (SELECT DISTINCT l.image_id, c FROM l JOIN m ON m.image_id = l.image_id AND m.y * 100 + m.x = l.p WHERE m.v > 0.8) SELECT l.image_id, (p // 100)::INT AS y, (p % 100)::INT AS x FROM l JOIN s ON s.image_id = l.image_id AND s.c = l.c""", "prob")

_MIRROR = "CASE WHEN {0} < 0 THEN -{0} WHEN {0} > 7 THEN 14 - {0} ELSE {0} END".format


@query(f"""WITH pad AS (SELECT p.image_id, i AS y, j AS x, p.v FROM range(-3, 11) a(i), range(-3, 11) b(j), prob p WHERE p.y = {_MIRROR('i')} AND p.x = {_MIRROR('j')}),
 t AS (SELECT image_id, y, x, v, dy, dx FROM pad, range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE y BETWEEN -1 AND 8 AND x BETWEEN -1 AND 8),
 q AS (SELECT t.image_id, t.y, t.x, dy, dx, (t.v - o.v) * (t.v - o.v) AS q FROM t JOIN pad o ON o.image_id = t.image_id AND o.y = t.y + dy AND o.x = t.x + dx),
 c AS (SELECT image_id, y, x, y + py AS ny, x + px AS nx FROM prob, range(-1, 2) a(py), range(-1, 2) b(px)),
 f AS (SELECT c.image_id, c.y, c.x, dy, dx, sum(q) AS far FROM c JOIN q ON q.image_id = c.image_id AND q.y = c.ny AND q.x = c.nx GROUP BY c.image_id, c.y, c.x, dy, dx),
 w AS (SELECT f.image_id, f.y, f.x, exp(-far / (9 * (20 / 255.0::DOUBLE) * (20 / 255.0::DOUBLE))) AS w, o.v FROM f JOIN pad o ON o.image_id = f.image_id AND o.y = f.y + dy AND o.x = f.x + dx)
 SELECT image_id, y, x, {_R6('sum(w * v) / sum(w)')} AS v FROM w GROUP BY image_id, y, x""", "prob")
def nl_means(spark: SparkSession, d: str) -> DataFrame:
    return vectorize.denoise(views.prob(spark, d), search=5).withColumn("v", r6(F.col("v")))


@query()
def local_entropy(spark: SparkSession, d: str) -> DataFrame:
    classes = views.prob(spark, d).withColumn("v", (F.col("v") > 0.5).cast("double"))
    return vectorize.local_entropy(classes, sigma=1.0).withColumn("v", r6(F.col("v")))


SQL["local_entropy"] = _rec(f"""WITH k AS (SELECT image_id, y, x, (v > 0.5)::INT AS k FROM prob),
 n AS (SELECT a.image_id, a.y * 100 + a.x AS a, b.y * 100 + b.x AS b FROM k a JOIN k b ON a.image_id = b.image_id AND a.k = b.k AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 r AS (SELECT image_id, y * 100 + x AS p, y * 100 + x AS q FROM k UNION SELECT r.image_id, r.p, n.b FROM r JOIN n ON n.image_id = r.image_id AND n.a = r.q),
 l AS (SELECT image_id, p, min(q) AS c FROM r GROUP BY image_id, p),
 i AS (SELECT l.image_id, p // 100 AS y, p % 100 AS x, ((c // 100 * 8 + c % 100 + 1)::BIGINT * 2654435761 + k.k * 40503) % 20 AS id FROM l JOIN k ON k.image_id = l.image_id AND k.y * 100 + k.x = l.p),
 b AS (SELECT t.image_id, t.y, t.x, i.id, sum(exp(-((i.y - t.y) * (i.y - t.y))::DOUBLE / 2) * exp(-((i.x - t.x) * (i.x - t.x))::DOUBLE / 2)) AS s FROM k t JOIN i ON i.image_id = t.image_id AND abs(i.y - t.y) <= 3 AND abs(i.x - t.x) <= 3 GROUP BY t.image_id, t.y, t.x, i.id),
 h AS (SELECT image_id, y, x, pow(s, 1 / 1.4::DOUBLE) / sum(pow(s, 1 / 1.4::DOUBLE)) OVER (PARTITION BY image_id, y, x) AS h FROM b)
 SELECT image_id, y, x, {_R6('-sum(h * ln(greatest(h, 1e-12::DOUBLE)))')} AS v FROM h GROUP BY image_id, y, x""", "prob")


@query(f"SELECT image_id, y, x, CASE WHEN z[1] > 0 THEN z[2] ELSE 0.0::DOUBLE END AS v FROM logits", "logits")
def apply_page_mask(spark: SparkSession, d: str) -> DataFrame:
    z = views.logits(spark, d)
    return px.apply_mask(px.channel(z, 1).select("image_id", "y", "x", "v"), px.channel(z, 0).where("v > 0"))


@query(f"SELECT image_id, y, x, {_R6('(v - m) * 1.5::DOUBLE + m')} AS v FROM (SELECT *, avg(v) OVER (PARTITION BY image_id) AS m FROM prob)", "prob")
def contrast(spark: SparkSession, d: str) -> DataFrame:
    return px.contrast(views.prob(spark, d), 1.5).withColumn("v", r6(F.col("v")))


@query("SELECT image_id, y, (7 - x)::INT AS x, v FROM px", "px")
def flip_left_right(spark: SparkSession, d: str) -> DataFrame:
    return px.flip(views.px(spark, d), left_right=True)


@query("SELECT image_id, (7 - y)::INT AS y, x, v FROM px", "px")
def flip_up_down(spark: SparkSession, d: str) -> DataFrame:
    return px.flip(views.px(spark, d), up_down=True)


@query("SELECT t.image_id, t.y, t.x, p.v FROM (SELECT DISTINCT image_id, i::INT AS y, j::INT AS x FROM px, range(12) a(i), range(5) b(j)) t JOIN px p ON p.image_id = t.image_id AND p.y = t.y * 8 // 12 AND p.x = t.x * 8 // 5", "px")
def resize_nearest(spark: SparkSession, d: str) -> DataFrame:
    return resample.nearest(views.px(spark, d), 12, 5)


@query(f"""WITH t AS (SELECT DISTINCT image_id, i::INT AS y, j::INT AS x, i * 8 / 12.0::DOUBLE AS fy, j * 8 / 5.0::DOUBLE AS fx FROM px, range(12) a(i), range(5) b(j)),
 c AS (SELECT image_id, y, x, least(floor(fy)::INT + dy, 7) AS sy, least(floor(fx)::INT + dx, 7) AS sx, (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM t, range(2) e(dy), range(2) f(dx))
 SELECT c.image_id, c.y, c.x, {_R6('sum(c.w * p.v)')} AS v FROM c JOIN px p ON p.image_id = c.image_id AND p.y = c.sy AND p.x = c.sx GROUP BY c.image_id, c.y, c.x""", "px")
def resize_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return resample.bilinear(views.px(spark, d), 12, 5).withColumn("v", r6(F.col("v")))


@query("SELECT image_id, a::INT AS patch_y, b::INT AS patch_x, (y - a * 2)::INT AS y, (x - b * 2)::INT AS x, v FROM px, range(3) q(a), range(3) r(b) WHERE y - a * 2 BETWEEN 0 AND 3 AND x - b * 2 BETWEEN 0 AND 3", "px")
def patches(spark: SparkSession, d: str) -> DataFrame:
    return win.patches(views.px(spark, d), 4, 4)


_PAD = "SELECT image_id, i::INT AS y, j::INT AS x, v FROM range(12) a(i), range(12) b(j), px WHERE y = CASE WHEN i < 2 THEN 1 - i WHEN i > 9 THEN 17 - i ELSE i - 2 END AND x = CASE WHEN j < 2 THEN 1 - j WHEN j > 9 THEN 17 - j ELSE j - 2 END"


@query(_PAD, "px")
def mirror_pad(spark: SparkSession, d: str) -> DataFrame:
    return win.mirror_pad(views.px(spark, d), 2)


@query("SELECT image_id, y, x, v FROM px", "px")
def pad_and_crop(spark: SparkSession, d: str) -> DataFrame:
    return win.crop(win.mirror_pad(views.px(spark, d), 2), 2)


@query("SELECT DISTINCT l_orderkey AS image_id, CASE WHEN s <= 500 THEN 0 ELSE round_even(i * (s - 500) / ceil((s - 500) / 400.0), 0)::INT END AS start FROM (SELECT l_orderkey, 300 + l_partkey AS s FROM lineitem) t, range(100) r(i) WHERE i = 0 OR (s > 500 AND i <= ceil((s - 500) / 400.0))")
def tile_plan(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") + 300).alias("s"))
    return tiling.image_starts(t, "s", 500, 0.2)


_STARTS = "CASE WHEN {0} >= 4 THEN 4 WHEN {0} >= 2 THEN 2 ELSE 0 END".format


@query(f"SELECT p.image_id, p.y, p.x, {_R6('p.v * 2 + t.v')} AS v FROM px p JOIN px t ON t.image_id = p.image_id AND t.y = {_STARTS('p.y')} AND t.x = {_STARTS('p.x')}", "px")
def tile_score_merge(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 4 that overlap, scored one by one by a model that depends on the tile's first pixel, the last one winning."""
    tiles = tiling.cut_tiles(views.px(spark, d), 4, 0.25)
    return tiling.merge_last(tiling.score_tiles(tiles, lambda a: a * 2 + a[0, 0])).withColumn("v", r6(F.col("v")))


#: What is left of s, the tile's start, after fading: tiles begin at 0, 2 and 4, and each next one fades in over two pixels.
_FADED = "(CASE {0} WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 4 END)".format


@query(f"SELECT image_id, y, x, {_R6('v + ' + _FADED('y') + ' + 10 * ' + _FADED('x'))} AS v FROM px", "px")
def tile_cross_fade(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping tiles that disagree by their places: within an overlap, values go over linearly from one tile's to the next's."""
    tiles = tiling.cut_tiles(views.px(spark, d), 4, 0.25).withColumn("v", F.col("v") + F.col("tile_y") + 10 * F.col("tile_x"))
    return tiling.merge_cross_fade(tiles).withColumn("v", r6(F.col("v")))


@query("WITH a AS (SELECT image_id, y, x, v FROM px) SELECT a.image_id, p.y, p.x, a.v FROM px p JOIN a ON a.image_id = p.image_id AND a.y = floor(3.5 + (p.y - 3.5) * 6.123233995736766e-17::DOUBLE - (p.x - 3.5) * 1.0::DOUBLE + 0.5) AND a.x = floor(3.5 + (p.y - 3.5) * 1.0::DOUBLE + (p.x - 3.5) * 6.123233995736766e-17::DOUBLE + 0.5)", "px")
def rotate_quarter(spark: SparkSession, d: str) -> DataFrame:
    return resample.rotate(views.px(spark, d), 3.141592653589793 / 2)


@query("""SELECT h, w, floor(sqrt(720000 / (w::DOUBLE / h)))::INT AS height, floor(720000 / sqrt(720000 / (w::DOUBLE / h)))::INT AS width, floor(h * sqrt(720000 / (h * w)::DOUBLE))::INT AS height2, floor(w * sqrt(720000 / (h * w)::DOUBLE))::INT AS width2, (w * 2000 // h)::INT AS width3
 FROM (SELECT DISTINCT 700 + l_partkey % 300 AS h, 500 + l_suppkey % 400 AS w FROM lineitem)""")
def pixel_budget_dims(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "lineitem").select((F.col("l_partkey") % 300 + 700).alias("h"), (F.col("l_suppkey") % 400 + 500).alias("w")).distinct()
    a, b, c = resample.budget_dims(F.col("h"), F.col("w"), 720_000), resample.scaled_dims(F.col("h"), F.col("w"), 720_000), resample.reduced_dims(F.col("h"), F.col("w"))
    return t.select("h", "w", a["height"].alias("height"), a["width"].alias("width"), b["height"].alias("height2"), b["width"].alias("width2"), c["width"].alias("width3"))


@query(f"""WITH t AS (SELECT DISTINCT 700 + l_partkey % 300 AS h, 500 + l_suppkey % 400 AS w, l_linenumber / 10.0::DOUBLE AS a FROM lineitem),
 s AS (SELECT *, greatest(h, w)::DOUBLE AS lo, least(h, w)::DOUBLE AS sh, abs(sin(a)) AS sn, abs(cos(a)) AS cs FROM t)
 SELECT h, w, a, {_R6("CASE WHEN sh <= 2 * sn * cs * lo OR abs(sn - cs) < 1e-10 THEN (CASE WHEN w >= h THEN 0.5 * sh / cs ELSE 0.5 * sh / sn END) ELSE (h * cs - w * sn) / (cs * cs - sn * sn) END")} AS height,
 {_R6("CASE WHEN sh <= 2 * sn * cs * lo OR abs(sn - cs) < 1e-10 THEN (CASE WHEN w >= h THEN 0.5 * sh / sn ELSE 0.5 * sh / cs END) ELSE (w * cs - h * sn) / (cs * cs - sn * sn) END")} AS width FROM s""")
def rotate_crop_dims(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "lineitem").select((F.col("l_partkey") % 300 + 700).alias("h"), (F.col("l_suppkey") % 400 + 500).alias("w"), (F.col("l_linenumber") / 10).alias("a")).distinct()
    c = resample.inner_crop(F.col("h"), F.col("w"), F.col("a"))
    return t.select("h", "w", "a", r6(c["height"]).alias("height"), r6(c["width"]).alias("width"))
