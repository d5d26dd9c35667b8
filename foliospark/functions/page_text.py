"""The text of layout documents, for whole batches of rows at once: Arrow's string kernels instead of a lambda for each element."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value of the page format: the namespace of its documents.
NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"
_PIECE = 32_000_000  # bytes of rows that are written at once
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
_CELL = [("rowIndex", "row_index"), ("columnIndex", "col_index"), ("rowSpan", "row_span"), ("colSpan", "col_span"), ("header", "header"), ("embText", "embedded_text")]

Fields = dict[str, pa.Array]


def _fields(rows: pa.StructArray) -> Fields:
    """Each field; null where its row is."""
    return dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))


def _glue(*parts: pa.Array | str) -> pa.Array:
    """Strings end to end; null if one is."""
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts], pa.scalar("", pa.large_string()))


def _string(v: pa.Array) -> pa.Array:
    return v if pa.types.is_large_string(v.type) else pc.cast(v, pa.large_string())


def _escape(text: pa.Array) -> pa.Array:
    for a, b in _ESCAPES:
        if pc.any(pc.match_substring(text, a)).as_py():
            text = pc.replace_substring(text, a, b)
    return text


def _where_said(text: pa.Array, built: pa.Array) -> pa.Array:
    """``built``, or nothing where the text is null or empty."""
    return pc.if_else(pc.fill_null(pc.not_equal(text, pa.scalar("", pa.large_string())), False), built, pa.scalar("", pa.large_string()))


def _attribute(name: str, v: pa.Array) -> pa.Array:
    v = _string(v)
    return _where_said(v, _glue(f' {name}="', _escape(v), '"'))


def _joined(lists: pa.Array, strings: pa.Array, by: str) -> pa.Array:
    """The lists' elements, given as ``strings``, end to end; nothing for null and empty lists."""
    ends = pc.cumulative_sum(pc.fill_null(pc.cast(pc.list_value_length(lists), pa.int64()), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, strings), pa.scalar(by, pa.large_string()))


def _points(tag: str, p: pa.Array) -> pa.Array:
    at = _fields(p.flatten())
    x, y = _string(at["x"]), _string(at["y"])
    comma = pc.if_else(pc.and_(pc.is_valid(x), pc.is_valid(y)), pa.scalar(",", pa.large_string()), pa.scalar("", pa.large_string()))
    text = _joined(p, _glue(pc.fill_null(x, ""), comma, pc.fill_null(y, "")), " ")
    some = pc.fill_null(pc.greater(pc.list_value_length(p), 0), False)
    return pc.if_else(some, _glue(f'<{tag} points="', text, '"/>'), pa.scalar("", pa.large_string()))


def _text(text: pa.Array) -> pa.Array:
    return _glue("<TextEquiv><Unicode>", _escape(pc.fill_null(_string(text), "")), "</Unicode></TextEquiv>")


def _shape(tag: str, r: Fields, attributes: list[tuple[str, str]] = (), inside: list[pa.Array] = ()) -> pa.Array:
    more = [_attribute(a, r[b]) for a, b in attributes]
    return _glue(f"<{tag}", _attribute("id", r["id"]), _attribute("custom", r["custom_attribute"]), *more, ">", _points("Coords", r["coords"]), *inside, f"</{tag}>")


def _every(lists: pa.Array, build) -> pa.Array:
    return _joined(lists, build(_fields(lists.flatten())), "")


def _line(t: Fields) -> pa.Array:
    return _shape("TextLine", t, [], [_points("Baseline", t["baseline"]), _text(t["text"])])


def _text_region(r: Fields, whole: bool) -> pa.Array:
    inside = [_every(r["text_lines"], _line)]
    if whole and "text_equiv" in r:
        said = _string(r["text_equiv"])
        inside.append(_where_said(said, _text(said)))
    return _shape("TextRegion", r, [("type", "type")] if whole and "type" in r else [], inside)


def _table(r: Fields) -> pa.Array:
    return _shape("TableRegion", r, [("rows", "rows"), ("columns", "columns")], [_every(r["cells"], partial(_shape, "TableCell", attributes=_CELL))])


def _metadata(m: Fields) -> pa.Array:
    tags = (("Creator", "creator"), ("Created", "created"), ("LastChange", "last_change"), ("Comments", "comments"))
    return _glue("<Metadata>", *[_where_said(_string(m[c]), _glue(f"<{t}>", _escape(_string(m[c])), f"</{t}>")) for t, c in tags], "</Metadata>")


def _documents(rows: pa.StructArray, whole: bool) -> pa.Array:
    r = _fields(rows)
    body = [_every(r["text_regions"], partial(_text_region, whole=whole))]
    for column, build in (("graphic_regions", partial(_shape, "GraphicRegion")), ("separator_regions", partial(_shape, "SeparatorRegion")), ("table_regions", _table)):
        if column in r:
            body.append(_every(r[column], build))
    border = []
    if "page_border" in r:
        corners = _points("Coords", r["page_border"])
        border.append(_where_said(corners, _glue("<Border>", corners, "</Border>")))
    head = f'<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{NAMESPACE}">'
    size = [_string(r["image_width"]), '" imageHeight="', _string(r["image_height"])]
    return _glue(head, _metadata(_fields(r["_meta"])), '<Page imageFilename="', _escape(_string(r["image_filename"])), '" imageWidth="', *size, '">', *border, *body, "</Page></PcGts>")


def page_text(columns: list[Column], metadata: Column, whole: bool) -> Column:
    """The documents of rows with these columns; ``whole``: types and texts of text regions, too."""

    @F.arrow_udf("string")
    def written(rows: pa.Array) -> pa.Array:
        step = max(1, len(rows) * _PIECE // max(rows.nbytes, 1))
        return pc.cast(pa.concat_arrays([_documents(rows.slice(i, step), whole) for i in range(0, len(rows), step)] or [pa.array([], pa.large_string())]), pa.string())

    # named twice, so that made-up regions stay a column of the plan: Spark can't run a function of lambdas over constants alone
    regions = F.size("text_regions").alias("_regions")
    # a filter on the text would else take the function along to where Spark doesn't run it
    return written.asNondeterministic()(F.struct(*columns, metadata.alias("_meta"), regions)).alias("xml")
