"""Queries on labels, losses, metrics, pairing and splits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators import labels, losses, metrics, pairing, resample
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


_FAR = "(p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b)"
_CLASS = f"c AS (SELECT image_id, y, x, r, g, b, class_id FROM (SELECT p.*, q.class_id, row_number() OVER (PARTITION BY image_id, y, x ORDER BY {_FAR}, q.class_id) AS k FROM rgb p, palette q) WHERE k = 1)"
_CODES = "(SELECT * FROM (VALUES (0, [0, 0, 0]), (1, [1, 0, 0]), (2, [0, 1, 0]), (3, [0, 0, 1]), (4, [1, 1, 0]), (5, [0, 1, 1])) AS t(class_id, codes))"


@query(f"WITH {_CLASS} SELECT image_id, y, x, class_id FROM c", "rgb", "palette")
def rgb_to_class(spark: SparkSession, d: str) -> DataFrame:
    return labels.nearest_class(views.rgb(spark, d), views.palette(spark)).select("image_id", "y", "x", "class_id")


@query("SELECT l.image_id, l.y, l.x, p.r, p.g, p.b FROM logits l JOIN palette p ON p.class_id = l.label", "logits", "palette")
def class_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    pixels = views.logits(spark, d).select("image_id", "y", "x", F.col("label").alias("class_id"))
    return labels.class_colour(pixels, views.palette(spark)).select("image_id", "y", "x", "r", "g", "b")


@query(f"WITH {_CLASS} SELECT image_id, y, x, codes[1] > 0 AS l0, codes[2] > 0 AS l1, codes[3] > 0 AS l2 FROM c JOIN {_CODES} t ON t.class_id = c.class_id", "rgb", "palette")
def rgb_to_multilabel(spark: SparkSession, d: str) -> DataFrame:
    out = labels.nearest_codes(views.rgb(spark, d), views.palette(spark))
    return out.select("image_id", "y", "x", *[F.get("labels", F.lit(i)).alias(f"l{i}") for i in range(3)])


@query(f"SELECT image_id, y, x, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b FROM logits l LEFT JOIN {_CODES} t ON t.codes = [(z[1] > 0)::INT, (z[2] > 0)::INT, (z[3] > 0)::INT] LEFT JOIN palette p ON p.class_id = t.class_id", "logits", "palette")
def multilabel_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    codes = F.transform(F.slice("z", 1, 3), lambda v: (v > 0).cast("int"))
    return labels.codes_colour(views.logits(spark, d).withColumn("codes", codes), views.palette(spark)).select("image_id", "y", "x", "r", "g", "b")


_SOFT = "exp(z[{0}] - list_max(z)) / (exp(z[1] - list_max(z)) + exp(z[2] - list_max(z)) + exp(z[3] - list_max(z)) + exp(z[4] - list_max(z)))"


@query(f"SELECT image_id, y, x, {', '.join(_R6(_SOFT.format(i + 1)) + f' AS p{i}' for i in range(4))}, (list_position(z, list_max(z)) - 1)::INT AS pred FROM logits", "logits")
def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    out = views.logits(spark, d).withColumn("p", labels.softmax(F.col("z")))
    return out.select("image_id", "y", "x", *[r6(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(4)], labels.decide(F.col("z"), "classification").alias("pred"))


@query(f"SELECT image_id, y, x, {_R6('1 / (1 + exp(-z[1]))')} AS p0, 1 / (1 + exp(-z[1])) >= 0.5 AS l0, 1 / (1 + exp(-z[2])) >= 0.5 AS l1 FROM logits", "logits")
def sigmoid_labels(spark: SparkSession, d: str) -> DataFrame:
    out = views.logits(spark, d).withColumn("l", labels.decide(F.col("z"), "multilabel"))
    return out.select("image_id", "y", "x", r6(labels.sigmoid(F.get("z", F.lit(0)))).alias("p0"), F.get("l", F.lit(0)).alias("l0"), F.get("l", F.lit(1)).alias("l1"))


@query("SELECT image_id, y, x, (label = 0)::INT AS c0, (label = 1)::INT AS c1, (label = 2)::INT AS c2, (label = 3)::INT AS c3 FROM logits", "logits")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    out = views.logits(spark, d).withColumn("o", labels.one_hot(F.col("label"), 4))
    return out.select("image_id", "y", "x", *[F.get("o", F.lit(i)).alias(f"c{i}") for i in range(4)])


_XENT = "ln(exp(z[1] - list_max(z)) + exp(z[2] - list_max(z)) + exp(z[3] - list_max(z)) + exp(z[4] - list_max(z))) + list_max(z) - z[label + 1]"


@query(f"SELECT image_id, y, x, {_R6(_XENT)} AS loss, {_R6(f'({_XENT}) * [1.0, 2.0, 0.5, 1.0][label + 1]::DOUBLE')} AS weighted FROM logits", "logits")
def xent_loss(spark: SparkSession, d: str) -> DataFrame:
    loss = losses.cross_entropy(F.col("z"), F.col("label"))
    return views.logits(spark, d).select("image_id", "y", "x", r6(loss).alias("loss"), r6(losses.class_weighted(loss, F.col("label"), [1.0, 2.0, 0.5, 1.0])).alias("weighted"))


@query(f"SELECT image_id, y, x, {_R6(f'power(1 - exp(-({_XENT})), 2) * ({_XENT})')} AS loss, {_R6(f'power(1 - exp(-min({_XENT}) OVER ()), 2) * ({_XENT})')} AS loss_global FROM logits", "logits")
def focal_loss(spark: SparkSession, d: str) -> DataFrame:
    own = losses.focal(views.logits(spark, d), 2.0).withColumnRenamed("loss", "own")
    return losses.focal(own, 2.0, per_pixel=False).select("image_id", "y", "x", r6(F.col("own")).alias("loss"), r6(F.col("loss")).alias("loss_global"))


@query(f"SELECT image_id, y, x, {_R6('greatest(z[1], 0) - z[1] * (label % 2) + ln(1 + exp(-abs(z[1])))')} AS loss, greatest(list_max([(label % 2) * 3.0, (label // 2) * 0.5]), 1.0)::DOUBLE AS weight FROM logits", "logits")
def sigmoid_xent(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label") % 2
    weight = losses.multilabel_weight(F.array(label.cast("double"), F.floor(F.col("label") / 2).cast("double")), [3.0, 0.5])
    return views.logits(spark, d).select("image_id", "y", "x", r6(losses.sigmoid_cross_entropy(F.get("z", F.lit(0)), label)).alias("loss"), weight.alias("weight"))


@query(f"SELECT image_id, {_R6(f'avg({_XENT})')} AS loss FROM logits WHERE y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2 GROUP BY image_id", "logits")
def masked_loss_mean(spark: SparkSession, d: str) -> DataFrame:
    out = views.logits(spark, d).withColumn("loss", losses.cross_entropy(F.col("z"), F.col("label")))
    return losses.masked_mean(out, 1).withColumn("loss", r6(F.col("loss")))


@query(f"SELECT image_id, y, x, {_R6('(v - 0.5) * (v - 0.5)')} AS loss, {_R6('(v - 0.5) * (v - 0.5) * (0.7::DOUBLE + 0.3::DOUBLE * v)')} AS blended FROM prob", "prob")
def squared_loss(spark: SparkSession, d: str) -> DataFrame:
    loss = losses.squared(F.col("v"), F.lit(0.5))
    return views.prob(spark, d).select("image_id", "y", "x", r6(loss).alias("loss"), r6(losses.blended(loss, F.col("v"), 0.3)).alias("blended"))


@query(f"SELECT DISTINCT o_custkey AS step, {_R6('1000 * power(0.95::DOUBLE, o_custkey / 200.0::DOUBLE)')} AS rate FROM orders")
def lr_decay(spark: SparkSession, d: str) -> DataFrame:
    steps = views.table(spark, d, "orders").select(F.col("o_custkey").alias("step")).distinct()
    return steps.withColumn("rate", r6(losses.learning_rate(F.col("step"), 1000.0)))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return views.logits(spark, d).select("image_id", "label", labels.argmax(F.col("z")).alias("pred"))


_PRED = "g AS (SELECT image_id, label, (list_position(z, list_max(z)) - 1)::INT AS pred FROM logits)"


@query(f"WITH {_PRED}, s AS (SELECT label AS c, label, pred FROM g UNION ALL SELECT pred, label, pred FROM g WHERE label <> pred) SELECT c AS class_id, {_R6('sum((label = pred)::INT)::DOUBLE / count(*)')} AS iou FROM s GROUP BY c", "logits")
def confusion_iou(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_iou(_predicted(spark, d)).withColumn("iou", r6(F.col("iou")))


@query(f"WITH {_PRED}, s AS (SELECT label AS c, label, pred FROM g UNION ALL SELECT pred, label, pred FROM g WHERE label <> pred), i AS (SELECT c, sum((label = pred)::INT)::DOUBLE / count(*) AS iou FROM s GROUP BY c) SELECT {_R6('avg(iou)')} AS miou, count(*) AS classes FROM i", "logits")
def mean_iou(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_iou(_predicted(spark, d)).withColumn("miou", r6(F.col("miou")))


@query(f"WITH {_PRED} SELECT image_id, {_R6('avg((label = pred)::INT)')} AS accuracy FROM g GROUP BY image_id", "logits")
def pixel_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pixel_accuracy(_predicted(spark, d), by=["image_id"]).withColumn("accuracy", r6(F.col("accuracy")))


_COUNTS = "c AS (SELECT d.lang, count(*) AS total, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang)"
_RATIOS = "p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r, CASE WHEN tp + fp + fn > 0 THEN tp::DOUBLE / (tp + fp + fn) ELSE 0 END AS u FROM {})"
_PRF = f"{_R6('p')} AS precision, {_R6('r')} AS recall, {_R6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f, {_R6('u')} AS iu, {_R6('(tp + tn)::DOUBLE / total')} AS accuracy"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = views.table(spark, d, "labels").join(views.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.confusion(pairs.withColumns({"t": F.col("quality") == 1, "p": F.col("toxic") == 1}), "t", "p", ["lang"])


@query(f"WITH {_COUNTS}, {_RATIOS.format('c')} SELECT lang, tp, tn, fp, fn, total, {_PRF} FROM p")
def prf(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.precision_recall(_counts(spark, d))
    return out.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f", "iu", "accuracy")})


@query(f"WITH {_COUNTS}, m AS (SELECT sum(total) AS total, sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn FROM c), {_RATIOS.format('m')} SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, total::BIGINT AS total, {_PRF} FROM p")
def metrics_merge(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.precision_recall(metrics.merge_counts(_counts(spark, d)))
    return out.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f", "iu", "accuracy")})


@query(f"WITH e AS (SELECT image_id, avg((v - 0.5) * (v - 0.5)) AS mse FROM prob GROUP BY image_id) SELECT image_id, {_R6('mse')} AS mse, {_R6('CASE WHEN mse <> 0 THEN 10 * log10(1 / mse) END')} AS psnr FROM e", "prob")
def mse_psnr(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.mse_psnr(views.prob(spark, d).withColumn("half", F.lit(0.5)), "v", "half", ["image_id"])
    return out.withColumns({"mse": r6(F.col("mse")), "psnr": r6(F.col("psnr"))})


_BEST = "(SELECT image_id, {0} AS x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h {1}, y, x, w, h) AS k FROM regions) WHERE k = 1)"
_OVER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _ends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.components import largest

    r = views.regions(spark, d).withColumn("area", F.col("w") * F.col("h"))
    ties = ("y", "x", "w", "h")
    first = largest(r, 1, "area", ties=ties)
    last = largest(r.withColumn("area", -F.col("area")), 1, "area", ties=ties).where("w * h > 200")  # smaller ones count as not found
    return first.select("image_id", "x", "y", "w", "h"), last.select("image_id", "x", "y", "w", "h")


@query(f"WITH a AS {_BEST.format('x', 'DESC')}, b AS (SELECT * FROM {_BEST.format('x', 'ASC')} WHERE w * h > 200) SELECT a.image_id, {_R6(f'({_OVER})::DOUBLE / (a.w * a.h + b.w * b.h - {_OVER})')} AS iou FROM a JOIN b ON a.image_id = b.image_id", "regions")
def iou_rect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ends(spark, d)
    both = a.select("image_id", *[F.col(c).alias(f"{c}1") for c in "xywh"]).join(b.select("image_id", *[F.col(c).alias(f"{c}2") for c in "xywh"]), "image_id")
    return metrics.rectangle_iou(both).select("image_id", r6(F.col("iou")).alias("iou"))


@query(f"WITH a AS {_BEST.format('x', 'DESC')}, b AS (SELECT * FROM {_BEST.format('x', 'ASC')} WHERE w * h > 200) SELECT {_R6(f'avg(coalesce(({_OVER})::DOUBLE / (a.w * a.h + b.w * b.h - {_OVER}), 0))')} AS miou, count(*) FILTER (b.image_id IS NULL) AS missing FROM a LEFT JOIN b ON a.image_id = b.image_id", "regions")
def page_miou(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_page_iou(*_ends(spark, d)).withColumn("miou", r6(F.col("miou")))


@query(f"SELECT l_returnflag AS run, {_R6('avg(l_discount)')} AS mean, {_R6('stddev_pop(l_discount)')} AS std, min(l_discount) AS min, max(l_discount) AS max FROM lineitem GROUP BY l_returnflag")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.summary(views.table(spark, d, "lineitem"), "l_discount", ["l_returnflag"])
    return out.select(F.col("l_returnflag").alias("run"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "min", "max")


_KEPT = """g AS (SELECT l_orderkey AS k, median(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY l_orderkey),
 o AS (SELECT g.k, n, l_quantity AS h, l_linenumber AS i, abs(l_quantity - m) AS off FROM lineitem JOIN g ON g.k = l_orderkey), a AS (SELECT k, median(off) AS mad FROM o GROUP BY k),
 kept AS (SELECT o.k, o.h, o.i FROM o JOIN a ON a.k = o.k WHERE n <= 3 OR 0.6745::DOUBLE * off / greatest(mad, 1e-10) <= 3.5)"""


def _heights(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("height"), F.col("l_linenumber").alias("line"))


@query(f"WITH {_KEPT} SELECT k AS page, h AS height, i AS line FROM kept")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    return metrics.drop_outliers(_heights(spark, d), "height", ["page"])


@query(f"WITH {_KEPT} SELECT k AS page, {_R6('avg(h)')} AS mean, {_R6('stddev_pop(h)')} AS std, {_R6('median(h)')} AS median FROM kept GROUP BY k")
def line_height_stats(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.line_height_stats(_heights(spark, d), ["page"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "median")})


@query("SELECT DISTINCT o_custkey AS height, floor(greatest(0.002::DOUBLE * o_custkey, 0.1::DOUBLE * (o_custkey % 97)))::INT AS thickness FROM orders")
def baseline_thickness(spark: SparkSession, d: str) -> DataFrame:
    h = views.table(spark, d, "orders").select(F.col("o_custkey").alias("height")).distinct()
    return h.withColumn("thickness", resample.baseline_thickness(F.col("height"), F.col("height") % 97, 0.1))


# Files are stood in for by documents (images) and labels.


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ext = F.when(F.col("doc_id") % 2 == 0, ".jpg").otherwise(".png")
    images = views.table(spark, d, "documents").select(F.concat(F.lit("set/images/p"), F.col("doc_id").cast("string"), ext).alias("path"))
    marks = views.table(spark, d, "labels").select(F.concat(F.lit("set/labels/p"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".jpg").otherwise(".png")).alias("path"))
    both = views.table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("set/labels/p"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".jpg")).alias("path"))
    return images, marks.union(both)


_FILES = """i AS (SELECT doc_id, 'set/images/p' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'jpg' ELSE 'png' END AS e FROM documents),
 k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'jpg' ELSE 'png' END AS e FROM labels UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'png' ELSE 'jpg' END FROM labels WHERE toxic = 1)"""


@query(f"WITH {_FILES}, r AS (SELECT i.path AS image, 'set/labels/p' || k.doc_id || '.' || k.e AS label, row_number() OVER (PARTITION BY i.path ORDER BY k.e <> i.e, k.e) AS n FROM i LEFT JOIN k ON k.doc_id = i.doc_id) SELECT image, label FROM r WHERE n = 1")
def pair_images_labels(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_labels(*_files(spark, d))


@query("SELECT 'set/images/p' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS image FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_labels(*_files(spark, d)).where(F.col("label").isNull()).select("image")


@query(f"WITH {_FILES}, x AS (SELECT doc_id, p, 'set/labels/p' || doc_id || '.' || e2 AS path FROM i, (VALUES (0, 'tif'), (1, 'png'), (2, 'jpg')) AS t(p, e2)), h AS (SELECT DISTINCT 'set/labels/p' || doc_id || '.' || e AS path FROM k) SELECT doc_id, path FROM (SELECT x.doc_id, x.path, row_number() OVER (PARTITION BY x.doc_id ORDER BY p) AS n FROM x JOIN h ON h.path = x.path) WHERE n = 1")
def first_existing(spark: SparkSession, d: str) -> DataFrame:
    _, marks = _files(spark, d)
    tries = F.explode(F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(e).alias("e")) for p, e in enumerate(("tif", "png", "jpg"))]))
    c = views.table(spark, d, "documents").select("doc_id", tries.alias("t")).select("doc_id", "t.priority", F.concat(F.lit("set/labels/p"), F.col("doc_id").cast("string"), F.lit("."), F.col("t.e")).alias("path"))
    return pairing.first_existing(c, marks, "doc_id")


_RANK = "SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= round_even((SELECT count(*) FROM documents) * 0.15::DOUBLE, 0) AS chosen FROM documents"


@query(f"SELECT doc_id FROM ({_RANK}) WHERE chosen")
def split_eval(spark: SparkSession, d: str) -> DataFrame:
    return pairing.split_sample(views.table(spark, d, "documents").select("doc_id"), "doc_id")[0]


@query(f"SELECT doc_id FROM ({_RANK}) WHERE NOT chosen")
def split_train(spark: SparkSession, d: str) -> DataFrame:
    return pairing.split_sample(views.table(spark, d, "documents").select("doc_id"), "doc_id")[1]


@query("SELECT doc_id, e::INT AS epoch, md5('0|' || e || '|' || doc_id) AS shuffle_key FROM labels, range(3) r(e)")
def epoch_repeat(spark: SparkSession, d: str) -> DataFrame:
    return pairing.epochs(views.table(spark, d, "labels").select("doc_id"), 3, "doc_id")


@query("SELECT lang, doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16)::BIGINT AS batch FROM documents")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return pairing.batches(views.table(spark, d, "documents").select("lang", "doc_id"), 16, "lang", ["doc_id"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, floor(sum(value) * 1000 + 0.5) / 1000 AS total FROM events GROUP BY ALL")
def event_windows_stream(spark: SparkSession, d: str) -> DataFrame:
    """Structured Streaming over the events' files, all of them in one go."""
    import uuid

    from ..checkpoints import ensure
    from ..streaming import ingest

    schema = views.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    name, out = f"stream_{uuid.uuid4().hex}", ensure(spark)
    path = f"{out}/{name}"
    query = ingest.event_windows(events).writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.floor(F.col("total") * 1000 + 0.5) / 1000)


_MANY = "many AS (SELECT o_orderkey AS class_id, (o_custkey * 37 % 256)::INT AS r, (floor(o_totalprice)::BIGINT % 256)::INT AS g, (o_orderkey % 256)::INT AS b FROM orders)"


@query(f"WITH {_MANY}, d AS (SELECT DISTINCT r, g, b FROM rgb), n AS (SELECT d.r, d.g, d.b, arg_min(m.class_id, ((d.r - m.r) * (d.r - m.r) + (d.g - m.g) * (d.g - m.g) + (d.b - m.b) * (d.b - m.b))::BIGINT * 100000000 + m.class_id) AS class_id FROM d, many m GROUP BY d.r, d.g, d.b) SELECT image_id, y, x, class_id FROM rgb JOIN n ON n.r = rgb.r AND n.g = rgb.g AND n.b = rgb.b", "rgb")
def rgb_to_many_classes(spark: SparkSession, d: str) -> DataFrame:
    """Nearest colour of a palette with a colour for each order."""
    o = views.table(spark, d, "orders")
    palette = o.select(F.col("o_orderkey").alias("class_id"), (F.col("o_custkey") * 37 % 256).cast("int").alias("r"), (F.floor("o_totalprice") % 256).cast("int").alias("g"), (F.col("o_orderkey") % 256).cast("int").alias("b"))
    return labels.nearest_class(views.rgb(spark, d), palette).select("image_id", "y", "x", "class_id")


@query("WITH n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents) SELECT lang, doc_id, (i // 64) * 64 + row_number() OVER (PARTITION BY lang, i // 64 ORDER BY md5('7|' || lang || '|' || doc_id), doc_id) - 1 AS place FROM n")
def buffered_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a language shuffled within each 64 running ones."""
    return pairing.buffered_shuffle(views.table(spark, d, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], "doc_id", 64, 7)


@query("WITH k AS (SELECT image_id, image_id // 4 AS batch, y, x, v FROM px WHERE y < 3 + image_id % 6 AND x < 2 + image_id % 7), s AS (SELECT batch, image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM k GROUP BY batch, image_id), m AS (SELECT batch, max(h) AS h, max(w) AS w FROM s GROUP BY batch) SELECT s.batch, s.image_id, i::INT AS y, j::INT AS x, coalesce(k.v, 0) AS v FROM s JOIN m ON m.batch = s.batch JOIN range(8) a(i) ON i < m.h JOIN range(8) b(j) ON j < m.w LEFT JOIN k ON k.image_id = s.image_id AND k.y = i AND k.x = j", "px")
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Images of various sizes, padded to the largest of their batch of four."""
    cut = views.px(spark, d).where("y < 3 + image_id % 6 and x < 2 + image_id % 7").withColumn("batch", F.floor(F.col("image_id") / 4))
    return pairing.pad_batches(cut, "batch", ["v"])
