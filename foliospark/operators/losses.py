"""Loss terms by pixel, and their means by image and batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .labels import softmax


def cross_entropy(z: Column, label: Column) -> Column:
    top = F.array_max(z)
    return F.ln(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top - F.get(z, label)


def focal(pixels: DataFrame, gamma: float, z: str = "z", label: str = "label", per_pixel: bool = True) -> DataFrame:
    """Adds ``loss``: cross entropy times (1 - p)^gamma. p is the label's probability of the pixel, or (not
    ``per_pixel``) the largest such probability of all pixels of the relation."""
    p = F.get(softmax(F.col(z)), F.col(label))
    if not per_pixel:
        p = pixels.select(F.max(p)).scalar()  # one row, by a subquery
    return pixels.withColumn("loss", F.pow(1 - p, F.lit(gamma)) * cross_entropy(F.col(z), F.col(label)))


def class_weighted(loss: Column, label: Column, weights: list[float]) -> Column:
    return loss * F.get(F.array(*map(F.lit, weights)), label)


def blended(loss: Column, weight: Column, share: float) -> Column:
    """``share`` of the loss follows the weight map, the rest is even."""
    return loss * ((1 - share) + share * weight)


def squared(prediction: Column, label: Column) -> Column:
    return (prediction - label) * (prediction - label)


def sigmoid_cross_entropy(z: Column, label: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * label + F.ln(1 + F.exp(-F.abs(z)))


def multilabel_weight(labels: Column, weights: list[float]) -> Column:
    """The largest weight of the labels that are set, 1 at least."""
    return F.greatest(F.array_max(F.zip_with(labels, F.array(*map(F.lit, weights)), lambda a, b: a * b)), F.lit(1.0))


def masked_mean(pixels: DataFrame, margin: int, loss: str = "loss") -> DataFrame:
    """image_id, loss: mean over pixels at least ``margin`` from each border."""
    image = W.partitionBy("image_id")
    sized = pixels.withColumns({"_h": F.max("y").over(image), "_w": F.max("x").over(image)})
    inner = sized.where((F.col("y") >= margin) & (F.col("x") >= margin) & (F.col("y") <= F.col("_h") - margin) & (F.col("x") <= F.col("_w") - margin))
    return inner.groupBy("image_id").agg(F.avg(loss).alias("loss"))


def batch_mean(losses: DataFrame, batch: str = "batch", loss: str = "loss") -> DataFrame:
    """batch, loss: mean over the images of a batch."""
    return losses.groupBy(batch).agg(F.avg(loss).alias(loss))


def learning_rate(step: Column, rate: float, decay: float = 0.95, every: int = 200) -> Column:
    return F.lit(rate) * F.pow(F.lit(decay), step / every)
