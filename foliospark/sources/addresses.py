"""Images behind addresses, as a Data Source: ``spark.read.format("addressed_images").load(lists)``.

The lists are text files of addresses, one a line, in a folder or a file that executors see. The driver plans byte ranges
of the files and never reads an address; a task takes the lines that begin in its range. What fetches is pluggable, so
that tests take a folder for the network. An address that fails after the retries gives a row with its error.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.request import urlopen

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .named_files import _open

SCHEMA = "address string, height int, width int, content binary, error string"
#: How image and description are named in an address of the image protocol.
IMAGE, INFO = "default.jpg", "info.json"


def fetch_url(address: str, timeout: float) -> bytes:
    """The bytes behind an http(s) address."""
    if not address.startswith(("http://", "https://")):
        raise ValueError(f"not an http address: {address}")
    with urlopen(address, timeout=timeout) as f:
        return f.read()


def fetch_file(address: str, timeout: float) -> bytes:
    """The bytes of a file, such as of a mirror on a shared disk or store, named by its path or URI."""
    system, path = _open(address)
    with system.open_input_file(path) as f:
        return f.read()


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int) -> None:
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class AddressedImages(DataSource):
    """Options: ``fetcher`` (module:function of address and timeout, default ``fetch_url``), ``retries`` (3), ``wait`` (1: seconds
    before the first retry, doubling), ``timeout`` (30), ``rangeBytes`` (65536), ``content`` (true: fetch images, false: sizes only)."""

    @classmethod
    def name(cls) -> str:
        return "addressed_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.fetcher = given["path"], given.get("fetcher", f"{__name__}:fetch_url")
        self.retries, self.wait, self.timeout = int(given.get("retries", 3)), float(given.get("wait", 1)), float(given.get("timeout", 30))
        self.step, self.whole = int(given.get("rangebytes", 65536)), given.get("content", "true").lower() == "true"

    def partitions(self) -> list[Range]:
        """Byte ranges of the lists; one of no bytes if there is nothing to read."""
        system, root = _open(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        lists = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))
        return [Range(p, at, min(at + self.step, size)) for p, size in lists for at in range(0, size, self.step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        module, name = self.fetcher.split(":")
        fetch = getattr(importlib.import_module(module), name)
        kinds = pa.schema([("address", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
        for address in self._addresses(partition):
            yield pa.RecordBatch.from_pylist([self._row(address, fetch)], kinds)

    def _addresses(self, part: Range) -> Iterator[str]:
        """Lines that begin within the range; the one before the first line end belongs to the range before."""
        if not part.path:
            return
        with _open(self.path)[0].open_input_file(part.path) as f:
            at = max(part.begin - 1, 0)
            f.seek(at)
            rest = b""
            if part.begin:
                rest, at = self._past_line(f, at)
            while at < part.end:
                cut = rest.find(b"\n")
                if cut < 0:
                    block = f.read(1 << 16)
                    if not block:
                        cut = len(rest)
                        if not cut:
                            return
                    rest += block
                    if block:
                        continue
                line, rest = rest[:cut], rest[cut + 1 :]
                at += cut + 1
                if line.strip():
                    yield line.strip().decode()

    @staticmethod
    def _past_line(f: pa.NativeFile, at: int) -> tuple[bytes, int]:
        rest = b""
        while (cut := rest.find(b"\n")) < 0:
            block = f.read(1 << 16)
            if not block:
                return b"", at + len(rest)
            rest += block
        return rest[cut + 1 :], at + cut + 1

    def _row(self, address: str, fetch: Callable[[str, float], bytes]) -> dict:
        row = {"address": address, "height": None, "width": None, "content": None, "error": None}
        try:
            info = json.loads(self._tried(address.replace(IMAGE, INFO), fetch))
            row |= {"height": int(info["height"]), "width": int(info["width"])}
            if self.whole:
                row["content"] = self._tried(address, fetch)
        except Exception as e:  # a row tells it; the job goes on
            row["error"] = f"{type(e).__name__}: {e}"
        return row

    def _tried(self, address: str, fetch: Callable[[str, float], bytes]) -> bytes:
        for k in range(self.retries + 1):
            try:
                return fetch(address, self.timeout)
            except Exception:
                if k == self.retries:
                    raise
                time.sleep(self.wait * 2**k)
        raise AssertionError


def read_addressed_images(spark: SparkSession, lists: str, **options: object) -> DataFrame:
    """address, height, width, content, error of the addresses that text files list."""
    spark.dataSource.register(AddressedImages)
    return spark.read.format("addressed_images").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(lists)


def addressed_sizes(images: DataFrame) -> DataFrame:
    """filename, height, width of addresses that gave a size, for ``annotations.working_items``."""
    return images.where(F.col("error").isNull()).select(F.col("address").alias("filename"), "height", "width")
