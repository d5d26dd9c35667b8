"""Files of their own names: a Data Source writer with a commit protocol, and masks, pages and training sets on top of it.

``df.write.format("named_files").mode("append").save(folder)`` writes a file for each row (name, content). Tasks write
into folders of their own under ``_temporary``; when all have ended, the driver moves the files of the attempts that
count to their names and deletes the rest. So a failed job leaves no file, a repeated task no second one, and a
file is there whole or not at all.

With ``packed`` the files go into archives (tar.gz, about 64 MB before compression) with an index of their names beside
each: very many small files take neither a block of the disk each nor a place in the driver's listing. ``tar xzf``
of all gives the folder; ``read_named_files(..., packed=True)`` streams them, an archive a task.
"""

from __future__ import annotations

import gzip
import json
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from io import BytesIO
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import stem
from .images import encode_images, encode_masks

_ASIDE = "_temporary"
_MOVERS = 16  # files moved at once by the driver
_ARCHIVE, _INDEX = ".tar.gz", ".names.gz"
_ARCHIVE_BYTES = 1 << 26  # of an archive before compression, after which a task begins the next
_BATCH_BYTES = 1 << 22  # of contents read from an archive at once


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder both of which driver and executors see: a URI, or a path on a shared disk."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, root = pafs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder; its file ``names`` has the rows' names, one a line, as many as ``count``. Packed: its archives' number."""

    folder: str
    count: int
    archives: int | None = None


class NamedFiles(DataSource):
    """Columns name (relative, its folders are made) and content (binary or string); null contents make no file.

    ``append`` leaves other files and replaces those of the same names, ``overwrite`` empties the folder first. A name
    may be given once (``write_named_files`` checks that before anything is written). Option packed: archives of files;
    a name that an archive of the folder has isn't replaced, but an error.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if {"name", "content"} - set(schema.names):
            raise ValueError("named_files takes the columns name and content")
        return Writer(self.options["path"], overwrite, self.options.get("packed", "false") == "true", self.options.get("job"))


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, packed: bool = False, job: str | None = None) -> None:
        self.path, self.overwrite, self.packed, self.job = path, overwrite, packed, job or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        folder, n = f"{root}/{_ASIDE}/{self.job}/{uuid.uuid4().hex}", 0
        system.create_dir(folder)
        if self.packed:
            return self._pack(iterator, system, folder)
        with system.open_output_stream(f"{folder}/names") as names:
            for batch in iterator:
                for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                    if not content.is_valid:
                        continue
                    with system.open_output_stream(f"{folder}/{n}") as out:
                        out.write(content.as_buffer())
                    names.write(json.dumps(_checked(name.as_py())).encode() + b"\n")
                    n += 1
        return Written(folder, n)

    def _pack(self, iterator: Iterator[pa.RecordBatch], system: pafs.FileSystem, folder: str) -> Written:
        rows = ((_checked(name.as_py()), content.as_buffer().to_pybytes()) for batch in iterator for name, content in zip(batch.column("name"), batch.column("content"), strict=True) if content.is_valid)
        n, k, row = 0, 0, next(rows, None)
        while row is not None:
            with system.open_output_stream(f"{folder}/{k}{_ARCHIVE}", compression=None) as f, gzip.GzipFile(fileobj=f, mode="wb", compresslevel=1, mtime=0) as out, tarfile.open(fileobj=out, mode="w") as tar, system.open_output_stream(f"{folder}/{k}{_INDEX}") as names:
                while row is not None and tar.offset < _ARCHIVE_BYTES:
                    info = tarfile.TarInfo(row[0])
                    info.size = len(row[1])
                    tar.addfile(info, BytesIO(row[1]))
                    tar.members.clear()
                    names.write(json.dumps(row[0]).encode() + b"\n")
                    n, row = n + 1, next(rows, None)
            k += 1
        return Written(folder, n, k)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        if self.overwrite:
            for x in system.get_file_info(pafs.FileSelector(root)):
                if x.base_name != _ASIDE:
                    system.delete_dir(x.path) if x.type == pafs.FileType.Directory else system.delete_file(x.path)
        made: set[str] = set()  # folders

        def move(place: tuple[str, str]) -> None:
            try:
                system.move(*place)
            except OSError:  # some stores don't move onto a file
                system.delete_file(place[1])
                system.move(*place)

        with ThreadPoolExecutor(_MOVERS) as movers:
            for i, m in enumerate(messages):
                if m is None:
                    continue
                if m.archives is not None:
                    list(movers.map(move, [(f"{m.folder}/{k}{end}", f"{root}/{self.job}-{i}-{k}{end}") for k in range(m.archives) for end in (_ARCHIVE, _INDEX)]))
                    continue
                with system.open_input_stream(f"{m.folder}/names") as f:
                    places = ((f"{m.folder}/{k}", f"{root}/{json.loads(line)}") for k, line in enumerate(_lines(f)))
                    while some := list(islice(places, 1000)):
                        for parent in {to.rsplit("/", 1)[0] for _, to in some} - made:
                            system.create_dir(parent)
                            made.add(parent)
                        list(movers.map(move, some))
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_open(self.path))

    def _clean(self, system: pafs.FileSystem, root: str) -> None:
        """Deletes this job's attempts, those that failed too."""
        aside = f"{root}/{_ASIDE}"
        if system.get_file_info(f"{aside}/{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{aside}/{self.job}")
        if system.get_file_info(aside).type == pafs.FileType.Directory and not system.get_file_info(pafs.FileSelector(aside)):
            system.delete_dir(aside)


def _held(path: str, end: str, begin: str = "") -> list[str]:
    """Files right in a folder that begin and end so."""
    system, root = _open(path)
    return sorted(x.path for x in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.type == pafs.FileType.File and x.base_name.startswith(begin) and x.base_name.endswith(end))


def _lines(f: pa.NativeFile) -> Iterator[str]:
    rest = b""
    while block := f.read(1 << 20):
        *lines, rest = (rest + block).split(b"\n")
        yield from (line.decode() for line in lines)


def _checked(name: str | None) -> str:
    parts = (name or "").split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..", _ASIDE) for p in parts):
        raise ValueError(f"not a relative file name: {name!r}")
    return name


def write_named_files(files: DataFrame, path: str, name: str | Column = "name", content: str | Column = "content", mode: str = "append", packed: bool = False) -> None:
    """A file for each row; names that come twice are an error before anything is written. An empty frame writes nothing.

    ``packed``: archives of files. Rows are then made once only: names are compared by the archives' indexes, and an
    error takes away what was written.
    """
    spark = files.sparkSession
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = files.select(col(name).alias("name"), col(content).cast("binary").alias("content"))
    spark.dataSource.register(NamedFiles)
    if packed:
        job = uuid.uuid4().hex
        rows.write.format("named_files").mode(mode).option("packed", "true").option("job", job).save(path)
        twice = [json.loads(x) for x in _twice(spark.read.text(f"{path}/*{_INDEX}").withColumnRenamed("value", "name"))] if _held(path, _INDEX, job) else []
        if twice:
            system = _open(path)[0]
            for x in (*_held(path, _ARCHIVE, job), *_held(path, _INDEX, job)):
                system.delete_file(x)
    else:
        twice = _twice(rows.where(F.col("content").isNotNull()))
    if twice:
        raise ValueError(f"names that come more than once: {twice}")
    if not packed:
        rows.write.format("named_files").mode(mode).save(path)


def _twice(names: DataFrame) -> list[str]:
    return sorted(r["name"] or "" for r in names.groupBy("name").count().where("count > 1").limit(3).collect())


def read_named_files(spark: SparkSession, path: str, pattern: str = "*", packed: bool = False) -> DataFrame:
    """name (relative to the folder), content of its files, or of its archives' files."""
    if packed:
        kinds = "name string, content binary"
        if not _held(path, _ARCHIVE):
            return spark.createDataFrame([], kinds)
        places = spark.read.format("binaryFile").load(f"{path}/*{_ARCHIVE}").select("path")  # tasks read the contents
        return places.mapInArrow(lambda batches: (files for batch in batches for x in batch.column("path").to_pylist() for files in _unpacked(x, pattern)), kinds)
    root = _open(path)[1]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    full = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    return rows.select(F.substring(full, F.position(F.lit(f"{root}/"), full) + len(root) + 1, F.length(full)).alias("name"), "content")


def _unpacked(path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """name, content of an archive's files whose own names match ``pattern``; a few MB are held."""
    names, contents, size = [], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])
    system, place = _open(path)
    with system.open_input_stream(place, compression=None) as f, gzip.GzipFile(fileobj=f) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
        while (info := tar.next()) is not None:
            tar.members.clear()  # or it would hold all that it has passed
            if not fnmatchcase(info.name.rsplit("/", 1)[-1], pattern):
                continue
            names.append(info.name)
            contents.append(tar.extractfile(info).read())
            size += info.size
            if size >= _BATCH_BYTES or len(names) >= 10_000:
                yield batch()
                names, contents, size = [], [], 0
    if names:
        yield batch()


# Masks, pages and training sets


def mask_name(image: Column, label: Column) -> Column:
    """image/image-mask-label.png; the label in lower case with _ for spaces, nolabel if there is none."""
    written = F.replace(F.lower(F.regexp_replace(label, r"^[ \n]+|[ \n]+$", "")), F.lit(" "), F.lit("_"))
    return F.concat(image, F.lit("/"), image, F.lit("-mask-"), F.coalesce(written, F.lit("nolabel")), F.lit(".png"))


def write_masks(pixels: DataFrame, path: str, collection: str, image: str = "filename", label: str = "label", mode: str = "append", packed: bool = False) -> None:
    """Masks (image, label, height, width, y, x; null places: an empty mask) as path/collection/image/image-mask-label.png, 255 on the mask."""
    png = encode_masks(pixels.withColumn("_image", stem(F.col(image))), ["_image", label])
    write_named_files(png, path, F.concat(F.lit(f"{collection}/"), mask_name(F.col("_image"), F.col(label))), "png", mode, packed)


def write_pages(pages: DataFrame, path: str, creator: str, now: str, comments: str = "", form: str = "xml", mode: str = "append", packed: bool = False) -> None:
    """Layout documents, each as a file named like its image: page_12.jpg gives page_12.xml (or .json, by ``form``).

    A document that knows when it was created keeps that and gets ``now`` as its last change; ``comments`` follow its own.
    """
    from ..annotations import page_json, page_xml, updated_metadata

    if form == "xml":
        body = page_xml(creator, now, pages.schema, comments)
    else:
        pages = pages.withColumn("metadata", updated_metadata(creator, now, comments, pages.schema))
        body = page_json(pages.columns)
    write_named_files(pages.withColumn("_body", body), path, F.concat(stem(F.col("image_filename")), F.lit(f".{form}")), "_body", mode, packed)


#: Training colours of baselines, line shapes and ends of baselines.
COLOURS = {"r": (255, 0, 0), "g": (0, 255, 0), "b": (0, 0, 255)}


def set_classes(channels: str, multilabel: bool = False) -> list[tuple[int, ...]]:
    """Rows of classes.txt for the drawn channels (of rgb): black, each channel, then their sums in pairs and all three; with codes if ``multilabel``."""
    sums = [c for c in ("r", "g", "b", "rg", "rb", "gb", "rgb") if set(c) <= set(channels)]
    rows = [(0, 0, 0), *[tuple(sum(COLOURS[k][i] for k in c) for i in range(3)) for c in sums]]
    return [(*r, *[int(v > 0) for v in r]) for r in rows] if multilabel else rows


def write_training_set(images: DataFrame, pages: DataFrame, path: str, size: int, channels: str = "rb", thickness: int = 3, endpoint_radius: int = 3, multilabel: bool = False, share: float = 0.15, seed: int = 42, creator: str = "foliospark", now: str = "", packed: bool = False) -> None:
    """A folder to train from: images, labels, gt, classes.txt, set_data.csv, train_data.csv and eval_data.csv.

    images: image_id, y, x, r, g, b; pages: layout documents of image_id (with all fields of ``page_xml``). Images
    and drawn labels (``annotations.annotate_page``, channels of rgb) are resized to about ``size`` pixels, nearest
    places for labels; larger than ``size`` only. gt has the documents as they are. Pages without pixels are left out. The
    CSV tables are folders of parts, as Spark writes and reads them. ``packed``: images, labels and gt in archives.
    """
    from ..annotations import annotate_page, page_xml
    from ..operators import pairing, resample

    sizes = images.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    small = F.when(F.col("h") * F.col("w") > size, resample.scaled_dims(F.col("h"), F.col("w"), size)).otherwise(F.struct(F.col("h").alias("height"), F.col("w").alias("width")))
    sizes = sizes.join(pages.select("image_id").distinct(), "image_id", "left_semi").withColumn("_s", small).select("image_id", "h", "w", F.col("_s.height").alias("height"), F.col("_s.width").alias("width"))
    wanted = sizes.select("image_id", "height", "width")
    pixels = resample.nearest(images.join(wanted, "image_id", "left_semi"), wanted, value=["r", "g", "b"]).join(wanted, "image_id")
    drawn = annotate_page(pages, thickness, "image_id", endpoint_radius).where(F.col("channel").isin(*channels))
    on = lambda c: F.max(F.when(F.col("channel") == c, 255).otherwise(0)).alias(c)
    drawn = drawn.groupBy("image_id", "y", "x").agg(on("r"), on("g"), on("b"))
    # a label's place (y, x) is drawn like the place floor(y * h / height), floor(x * w / width) of the page
    ys = lambda at, n, m: F.sequence(F.ceil(F.col(at) * F.col(n) / F.col(m)).cast("int"), (F.ceil((F.col(at) + 1) * F.col(n) / F.col(m)) - 1).cast("int"))
    inside = drawn.join(sizes, "image_id").where("y >= 0 and x >= 0 and y < h and x < w").withColumnsRenamed({"y": "_y", "x": "_x"})
    spread = lambda d, at, n, m: d.withColumn(at[1:], F.explode(F.when(F.ceil(F.col(at) * F.col(n) / F.col(m)) <= F.ceil((F.col(at) + 1) * F.col(n) / F.col(m)) - 1, ys(at, n, m))))
    labels = spread(spread(inside, "_y", "height", "h"), "_x", "width", "w").select("image_id", "height", "width", "y", "x", "r", "g", "b")
    labels = labels.unionByName(wanted.select("image_id", "height", "width", *[F.lit(None).cast("int").alias(c) for c in ("y", "x", "r", "g", "b")]))
    named = lambda folder, end: F.concat(F.lit(f"{folder}/"), F.col("image_id").cast("string"), F.lit(end))
    write_named_files(encode_images(pixels, ["image_id"], ["r", "g", "b"]), path, named("images", ".png"), "png", "overwrite", packed)
    write_named_files(encode_images(labels, ["image_id"], ["r", "g", "b"]), path, named("labels", ".png"), "png", packed=packed)
    xml = pages.join(wanted, "image_id", "left_semi").withColumn("_body", page_xml(creator, now, pages.schema))
    write_named_files(xml, path, named("gt", ".xml"), "_body", packed=packed)
    pairs = wanted.select("image_id", named("images", ".png").alias("image"), named("labels", ".png").alias("label"))
    held, rest = pairing.split_sample(pairs, "image_id", share, seed)
    for name, rows in (("set_data", pairs), ("eval_data", held), ("train_data", rest)):
        rows.select("image", "label").write.mode("overwrite").csv(f"{path}/{name}.csv")
    table = "".join(" ".join(map(str, c)) + "\n" for c in set_classes(channels, multilabel))
    write_named_files(images.sparkSession.createDataFrame([("classes.txt", table)], "name string, content string"), path)
