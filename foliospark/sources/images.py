"""Image files as DataFrames: listings, header sizes, pixels; and sinks for masks and probability maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import changes
from .codec import image_size, npy_decode, png_decode, png_encode

IMAGES = r"\.(jpg|png)$"


def list_files(spark: SparkSession, paths: str | list[str], recursive: bool = True, pattern: str = IMAGES) -> DataFrame:
    """path, length of image files (lower-case .jpg and .png) under a folder, or of the files listed; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(paths).where(F.col("path").rlike(pattern)).select("path", "length")


def read_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, height, width from headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [image_size(bytes(x)) or (None, None) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "height": pd.array([s[0] for s in sizes], "Int32"), "width": pd.array([s[1] for s in sizes], "Int32")})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).where(F.col("path").rlike(IMAGES))
    return files.select("path", "content").mapInPandas(run, "path string, height int, width int")


def read_pixels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, y, x, r, g, b of images that Spark's image source can decode; broken files are left out."""
    images = spark.read.format("image").option("dropInvalid", "true").load(paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                a = np.repeat(a, 3, axis=2) if r.channels == 1 else a[:, :, :3][:, :, ::-1]  # the source is BGR
                y, x = np.divmod(np.arange(r.height * r.width), r.width)
                flat = a.reshape(-1, 3).astype(np.int32)
                yield pd.DataFrame({"path": r.path, "y": y, "x": x, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    columns = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return columns.mapInPandas(run, "path string, y int, x int, r int, g int, b int")


def read_probabilities(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, y, x, p (array of channels, 0 to 1) of NPY maps of bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                a = npy_decode(bytes(content)) / 255.0
                y, x = np.divmod(np.arange(a.shape[0] * a.shape[1]), a.shape[1])
                yield pd.DataFrame({"path": path, "y": y, "x": x, "p": list(a.reshape(len(y), -1))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(paths)
    return files.select("path", "content").mapInPandas(run, "path string, y int, x int, p array<double>")


def encode_masks(pixels: DataFrame, keys: list[str], height: str = "height", width: str = "width") -> DataFrame:
    """keys, png: a grey PNG (255 on the mask's y, x) for each key, as a binary column to write as Parquet or files."""
    return encode_images(pixels, keys, [], height, width)


def encode_images(pixels: DataFrame, keys: list[str], colours: list[str], height: str = "height", width: str = "width") -> DataFrame:
    """keys, png: for each key a PNG of its pixels' r, g, b (``colours``), or grey, 255 at its pixels; other places are black.

    Pixels with null places, or beyond the image, are left out. They are brought together by key, sorted by it and
    streamed through: one image at a time is held.
    """
    rows = pixels.select(*keys, *[F.col(c).cast("int").alias(f"_{k}") for k, c in enumerate([height, width, "y", "x", *colours])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key (a row) and its image
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.select(keys)
            h, w, y, x, *values = (pc.fill_null(batch.column(f"_{k}"), -1).to_numpy(zero_copy_only=False) for k in range(4 + len(colours)))
            at = np.flatnonzero(np.diff(changes(batch, keys), prepend=-1))
            inside = (y >= 0) & (x >= 0)
            made = []
            for i, j in zip(at.tolist(), [*at[1:].tolist(), batch.num_rows], strict=True):
                if i == 0 and held is not None and held[0].equals(key.slice(0, 1)):
                    a = held[1]
                else:
                    if i == 0 and held is not None:
                        yield out(held[0], [held[1]])
                    a = np.zeros((h[i], w[i], 3) if colours else (h[i], w[i]), np.uint8)
                ok = i + np.flatnonzero(inside[i:j] & (y[i:j] < a.shape[0]) & (x[i:j] < a.shape[1]))
                a[y[ok], x[ok]] = np.stack([v[ok] for v in values], axis=-1).astype(np.uint8) if colours else 255
                made.append(a)
            yield out(key.take(pa.array(at[:-1])), made[:-1])
            held = key.slice(int(at[-1]), 1), made[-1]
        if held is not None:
            yield out(held[0], [held[1]])

    def out(key: pa.RecordBatch, images: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*key.columns, pa.array([png_encode(a) for a in images], pa.binary())], names=[*keys, "png"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    # by a hash of their own: a shuffle by the keys themselves is left out after a join by them, whose skewed partitions may be split
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInArrow(run, f"{kinds}, png binary")


def decode_png(data: bytes) -> np.ndarray:
    return png_decode(data)
