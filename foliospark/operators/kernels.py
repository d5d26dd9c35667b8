"""NumPy kernels on images: pixels are packed natively, a row for each image, and kernels run over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(pixels: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """keys, y, x and values as arrays in reading order. An image must fit into a row; tile larger ones."""
    names = ["y", "x", *(values or [])]
    rows = pixels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_p"))
    return rows.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in names])


def run(packed: DataFrame, kernel: Callable[[tuple], list[tuple]], schema: str) -> DataFrame:
    """``kernel`` on each row (a named tuple), its result rows in ``schema``."""
    names = [part.split(" ")[0] for part in _columns(schema)]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                out += kernel(row)
            yield pd.DataFrame(out, columns=names)

    return packed.mapInPandas(batches, schema)


def unpack(packed: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Arrays of equal length back to a row for each element."""
    return packed.select(*keys, F.inline(F.arrays_zip(*arrays)))


def _columns(schema: str) -> list[str]:
    """Parts of a schema string at its outermost commas."""
    depth, parts = 0, [""]
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts]
