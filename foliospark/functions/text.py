"""String functions of annotation files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .polygons import let


def tags(custom: Column) -> Column:
    """Types in '{type:...;}' of an attribute, greedy to the last ';}', distinct and sorted."""
    found = F.regexp_extract_all(F.coalesce(custom, F.lit("")), F.lit(r"(\{type:.*;\})"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.substring(t, F.lit(7), F.length(t) - 8))))


def one_tag(custom: Column) -> Column:
    """The only tag, null if there is none; several are an error."""
    found = tags(custom)
    return F.when(F.size(found) <= 1, F.get(found, F.lit(0))).otherwise(F.raise_error(F.lit("more than one tag")).cast("string"))


def image_name(name: Column) -> Column:
    """'.jpg' and digits after it to '.jpg'."""
    return F.regexp_replace(name, r".jpg\d*", ".jpg")


def slug(label: Column) -> Column:
    return F.lower(F.replace(F.btrim(label), F.lit(" "), F.lit("_")))


def option_label(attribute: Column, option: Column) -> Column:
    return F.lower(F.concat_ws("-", attribute, option))


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def set_name(path: Column) -> Column:
    """'ACRONYM_stem' of .../ACRONYM/name.ext, the acronym in capitals."""
    return F.concat_ws("_", F.upper(F.element_at(F.split(path, "/"), -2)), stem(path))


def iiif_parts(url: Column) -> Column:
    """name and info (the document with the dimensions) of an image URL .../identifier/region/size/rotation/quality.format."""
    parts = F.split(url, "/")
    return F.struct(F.element_at(parts, -5).alias("name"), F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 4), "/"), F.lit("/info.json")).alias("info"))


def to_boolean(text: Column) -> Column:
    return F.lower(text) == "true"


def from_boolean(flag: Column) -> Column:
    return F.when(flag, F.lit("true")).otherwise(F.lit("false"))


def parse_quad(line: Column) -> Column:
    """'file,x1,y1,...,x4,y4[,...][,SINGLE|ABNORMAL]' to struct file, quad (points), tag.

    With a tag the eight numbers before it count, else the first eight after the name.
    """

    def built(parts: Column) -> Column:
        last = F.btrim(F.element_at(parts, -1))
        tagged = last.isin("SINGLE", "ABNORMAL")
        start = F.when(tagged, F.size(parts) - 9).otherwise(F.lit(1))
        number = lambda k: F.btrim(F.get(parts, start + k)).cast("double").cast("int")
        quad = F.array(*[F.struct(number(2 * i).alias("x"), number(2 * i + 1).alias("y")) for i in range(4)])
        return F.struct(F.get(parts, F.lit(0)).alias("file"), quad.alias("quad"), F.when(tagged, last).alias("tag"))

    return let(F.split(line, ","), built)


def format_quad(file: Column, quad: Column) -> Column:
    return F.concat_ws(",", file, *[F.get(quad, F.lit(i))[c].cast("string") for i in range(4) for c in "xy"])
